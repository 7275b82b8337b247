import random

import corpus_pipeline
from fieldloom.llm import minhash_dedup


def kept_at(texts, percent):
    """The least document of each class, pair by pair."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in texts.items())}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(d for d in texts if find(d) == d)


def near_copies():
    """Pairs whose similarity is spread over 0.7 to 1."""
    rng, texts = random.Random(3), {}
    for i in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts[2 * i] = " ".join(words)
        cut = rng.randint(0, 35)
        texts[2 * i + 1] = " ".join(words[: 200 - cut] + [f"x{rng.randrange(10**6)}" for _ in range(cut)])
    return texts


def test_stage_links_at_80(spark):
    texts = near_copies()
    assert kept_at(texts, 80) != kept_at(texts, 85)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == kept_at(texts, 80)
    assert sorted(r.doc_id for r in minhash_dedup.near_duplicates(docs).where("kept").collect()) == kept_at(texts, 85)


def test_sketch_plan_follows_the_threshold():
    assert (minhash_dedup.bands_for(85), minhash_dedup.agreeing(85)) == (24, 176)
    assert (minhash_dedup.bands_for(80), minhash_dedup.agreeing(80)) == (35, 161)


def test_rows_without_id_pass_unless_a_copy_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, "five"), (None, a, "copy of five"), (None, b, "alone"), (None, c, "twice"), (None, c, "twice"), (None, None, "no text"), (6, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r.source for r in kept) == ["alone", "empty", "five", "no text", "twice"]
    assert all(r.doc_id is None for r in kept if r.source in ("alone", "twice", "no text"))
