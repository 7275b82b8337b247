import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import language_id, quality_gam, registry


def test_op5_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = registry.op5_quality_gam(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = rows.where("held_out").join(labels, "doc_id").toPandas()
    assert rows.count() == registry.documents(spark, sf_dir).count()
    assert (held.predicted == held.quality).mean() > 0.97 and held.score.between(0, 1).all()
    assert held[held.quality == 1].predicted.mean() > 0.98 and held[held.quality == 0].predicted.mean() < 0.1


def test_op5_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b", 3), (4, "x" * 100_000, 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in quality_gam.classify(docs, labels).collect()] == [(0.5, 1)] * 4
    assert quality_gam.classify(docs.where(F.lit(False)), labels).count() == 0


def test_features_by_brute_force():
    texts = ["Ab cd! cd 12 #é\nlonger-word", "", "  x", "a b c a b c a b c", "ÄÖ " * 3]
    raw = [t.encode() for t in texts]
    table = quality_gam.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    for row, text in zip(table, texts):
        words = text.split()
        got = dict(zip(quality_gam.FEATURES, row))
        assert np.isclose(got["words"], np.log1p(len(words)))
        assert np.isclose(np.expm1(got["longest_word"]), max((len(w.encode()) for w in words), default=0))
        assert np.isclose(got["distinct_words"] * max(1, len(words)), len({w.lower() for w in words}))
        assert np.isclose(got["distinct_triples"] * max(1, len(words) - 2), len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}))
        assert np.isclose(got["symbols"] * max(1, len(words)), sum(c in "#*$%&|<>" for c in text))
        assert np.isclose(got["lines"] * max(1, len(words)), text.count("\n"))


def test_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    table = rng.random((4000, len(quality_gam.FEATURES)))
    labels = ((table[:, 0] > 0.5) ^ (table[:, 1] > 0.5)).astype(float)
    model = quality_gam.Model(table, labels)
    assert ((model.score(table) > 0.5) == labels).mean() > 0.9


def test_op2_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = registry.op2_language_filters(spark, sf_dir)
    docs = registry.documents(spark, sf_dir)
    both = rows.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert rows.count() == docs.count() and (both.lang == both.lang_pred).mean() > 0.97 and both.score.between(0, 1).all()


def test_op2_edges(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("123 !", None), ("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), ("the dog", None), ("und die", None), ("日本", None)])], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert [got[i] for i in range(7)] == ["und", "und", "und", "en", "de", "en", "de"] and got[7] in ("de", "en")
    none = language_id.predict_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.predict_languages(docs.where(F.lit(False))).count() == 0


def joined(texts):
    parts = list(language_id.grams(texts))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(2))


def test_grams_by_brute_force():
    values, owner = joined(["Ab c", "", "é"])
    assert np.bincount(owner, minlength=3).tolist() == [3 + 1, 0, 1]
    again, _ = joined(["c AB"])
    assert set(again.tolist()) & set(values.tolist()) == set(again.tolist())


def test_long_texts_are_counted_whole(monkeypatch):
    texts = ["one two three " * 40, "", "vier fünf " * 9, chr(0x32010) * 3]
    whole = sorted(zip(*(x.tolist() for x in joined(texts))))
    monkeypatch.setattr(language_id, "SIGNS_TOGETHER", 16)
    assert len(list(language_id.grams(texts))) > 10 and sorted(zip(*(x.tolist() for x in joined(texts)))) == whole
    assert {o for _, o in whole} == {0, 2, 3}


def test_prediction_by_brute_force():
    """Filters as one set of slots a language; counts by loops; the correction and the choice as defined."""
    rng = np.random.default_rng(4)
    names = [f"l{k:03d}" for k in range(130)]
    member = rng.random((len(names), language_id.SLOTS)) < rng.uniform(0.2, 0.9, (len(names), 1))
    slots = np.zeros((3, language_id.SLOTS), np.uint64)
    for k in range(len(names)):
        slots[k // 63] |= member[k].astype(np.uint64) << np.uint64(k % 63)
    texts = ["Some text, with words", "x", "1 2 3", "ñandú " * 7]
    got = list(zip(*language_id.Filter(names, slots).predict(texts)))
    for text, (name, score) in zip(texts, got):
        parts = list(language_id.grams([text]))
        values = [v for p, _ in parts for v in p.tolist()]
        if not values:
            assert (name, score) == ("und", 0.0)
            continue
        counts = []
        for k in range(len(names)):
            chance = member[k].mean() ** 3
            hits = sum(all(member[k, v >> 20 * i & language_id.SLOTS - 1] for i in range(3)) for v in values)
            counts.append(min(max((hits - len(values) * chance) / (1 - chance), 0), len(values)))
        assert name == names[int(np.argmax(counts))] and np.isclose(score, max(counts) / len(values))


def test_more_languages_than_a_word_has_bits(spark):
    docs = spark.createDataFrame([(i, " ".join([chr(0x4E00 + 50 * k + j) * 2 for j in range(8)] * 3), f"lang{k}") for i, k in enumerate(k for k in range(70) for _ in range(3))], "doc_id long, text string, lang string")
    rows = language_id.identify(docs, language_id.learn(docs)).join(docs.drop("text"), "doc_id").collect()
    assert len(rows) == 210 and all(r.lang == r.lang_pred for r in rows)


def test_learned_masks_by_brute_force(spark):
    docs = [(1, "aa bb aa bb aa bb", "x"), (2, "aa cc aa cc aa cc aa cc aa cc", "y"), (3, "dd", "y"), (4, None, "x"), (5, "zz zz zz", None)]
    model = language_id.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    counts = {}
    for _, text, lang in docs:
        for values, _ in language_id.grams([text]) if text and lang else []:
            for v in values.tolist():
                counts.setdefault(lang, {}).setdefault(v, 0)
                counts[lang][v] += 1
    want = np.zeros(language_id.SLOTS, np.uint64)
    for k, lang in enumerate(["x", "y"]):
        for v, n in counts[lang].items():
            rates = {other: c.get(v, 0) / sum(c.values()) for other, c in counts.items()}
            if n >= language_id.LEAST_COUNT and rates[lang] >= language_id.LEAST_RATIO * max(rates.values()):
                for i in range(language_id.PROBES):
                    want[v >> 20 * i & language_id.SLOTS - 1] |= np.uint64(1 << k)
    assert model.languages == ["x", "y"] and (model.slots[0] == want).all()
