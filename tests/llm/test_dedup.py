import random
import re

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import minhash_dedup, registry
from fieldloom.llm.components import components


def brute(texts, percent=85):
    sets = {}
    for doc, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    index = {}
    for doc, items in sets.items():
        for x in items:
            index.setdefault(x, []).append(doc)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for doc, items in sets.items():
        seen = {}
        for x in items:
            for other in index[x]:
                if other < doc:
                    seen[other] = seen.get(other, 0) + 1
        for other, n in seen.items():
            if 100 * n >= percent * (len(items) + len(sets[other]) - n):
                a, b = sorted((find(doc), find(other)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(rows, texts):
    want = brute(texts)
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op9(spark, sf_dir):
    texts = {r.doc_id: r.text for r in registry.documents(spark, sf_dir).collect()}
    check(registry.op9_minhash_dedup(spark, sf_dir).collect(), texts)


def test_large_groups_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    texts = {}
    for i in range(1500):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(90)] = f"x{rng.randint(0, 10**6)}"
        texts[i] = " ".join(words)
    texts |= {2000 + i: t for i, t in enumerate(["", " ", "a b", "A  b", "a b c d e", "É é", None])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(minhash_dedup.near_duplicates(docs).collect(), texts)


def test_op9_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "z"), (1, "a b c d e f", "y"), (None, "a b c d e f", None), (7, "A B C\nd e f", "")], "doc_id long, text string, component_id string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()), key=str)
    assert rows == [(1, 1, True), (1, 1, True), (7, 1, False), (None, None, False)]
    assert minhash_dedup.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 450)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {**dict.fromkeys(range(101), 0), 400: 400, 450: 400, 500: 400}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    a, b = minhash_dedup.sketches([np.concatenate([shared, own[0]]), np.concatenate([shared, own[1]])])
    assert abs((a == b).mean() - 0.8) < 0.1
    one = minhash_dedup.sketches([np.array([7], np.uint64), np.array([7], np.uint64)])
    assert (one[0] == one[1]).all()


def test_strangers_among_near_copies_stay_linear(spark, monkeypatch):
    """A bucket of near copies with a few strangers in it is looked through in far fewer rows than its square."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rows = []
    inner = minhash_dedup.clusters
    monkeypatch.setattr(minhash_dedup, "clusters", lambda members, percent: rows.append(members.count()) or inner(members, percent))
    rng, texts = random.Random(7), {}
    base = [f"w{i}" for i in range(200)]
    for i in range(3, 900):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(3):  # halves of the text share bands with the copies, and are linked with none
        texts[i] = " ".join(base[:150] + [f"y{i}{k}" for k in range(60)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(minhash_dedup.near_duplicates(docs).collect(), texts)
    assert sum(rows) < 24 * 900 * 4


def test_large_groups_are_verified_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "GROUP_SHINGLES", 100)
    monkeypatch.setattr(minhash_dedup, "LEADERS", 1)
    rng = random.Random(9)
    texts = {}
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(25):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(60)] = f"z{rng.randrange(9)}"
            texts[g * 100 + k] = " ".join(words)
    check(minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
