import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import cover_tree, registry


def brute(rows, queries, k=5):
    out = {}
    for q, qv in queries.items():
        scored = sorted((-int(np.dot(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv))
        out[q] = [(rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return {q: r for q, r in out.items() if r}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(r) for q, r in out.items()}


def test_op1(spark, sf_dir):
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(int)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(registry.op1_cover_tree(spark, sf_dir)) == brute(rows, {i: v for i, v in rows if i % 50 == 0})


def test_op1_edges(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "ROWS_PER_PIVOT", 40)
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(4)
    table = [(i, (rng.integers(-2, 3, 3) / 4.0).tolist()) for i in range(300)] + [(1000 + i, [0.5, 0.5, 0.5]) for i in range(200)]
    good = table + [(3000, [1.0]), (3001, [2.0, 1.0]), (3050, [1.0, 2.0])]
    odd = [(2000, None), (2050, [float("nan"), 1.0, 1.0]), (2100, [None, 1.0, 1.0]), (2150, []), (2200, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in good + odd], "vec_id long, embedding array<double>, score int")
    rows = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in good]
    assert got(cover_tree.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows, {i: v for i, v in rows if i % 50 == 0})
    assert cover_tree.top_k(df.where(F.lit(False)), F.lit(True)).count() == 0
    assert got(cover_tree.top_k(df.where("vec_id < 3"), F.lit(True))) == brute(rows[:3], dict(rows[:3]))


def exact(data, queries, k=5):
    products = [[sum(a * b for a, b in zip(q, d)) for d in data.tolist()] for q in queries.tolist()]
    return [sorted((-p, i) for i, p in enumerate(line))[:k] for line in products]


def clustered(rng, n, dims=16, centres=20):
    middle = rng.normal(0, 300, (centres, dims))
    return np.rint(middle[rng.integers(0, centres, n)] + rng.normal(0, 5, (n, dims))).astype(np.int64)


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(6)
    data, queries = np.split(clustered(rng, 3100), [3000])
    scores, rows, seen = cover_tree.search(data, np.arange(3000), queries, np.full(100, -1), np.full(100, cover_tree.LOWEST), 5)
    assert [[(-s, i) for s, i in zip(*line)] for line in zip(scores.tolist(), rows.tolist())] == exact(data, queries)
    assert seen.total == 300_000 and seen.scored < 0.25 * seen.total and seen.bounds < 0.25 * seen.total
    again = cover_tree.search(data, np.arange(3000), queries, np.full(100, -1), scores[:, -1], 5)
    assert (again[0] == scores).all() and (again[1] == rows).all() and again[2].scored + again[2].bounds < 0.15 * seen.total


def test_pruning_on_embeddings(spark):
    """The given vectors have no clusters, yet under half of all pairs are scored; their single rows bound themselves."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(cover_tree.usable("embedding")).orderBy("vec_id").collect()
    data, ids = np.array([np.floor(256 * np.array(r.embedding, float)) for r in rows]).astype(np.int64), np.array([r.vec_id for r in rows])
    asks = ids % 50 == 0
    scores, found, seen = cover_tree.search(data, ids, data[asks], ids[asks], np.full(asks.sum(), cover_tree.LOWEST), 5)
    assert seen.total == len(data) * asks.sum() and seen.scored < 0.5 * seen.total
    want = exact(data, data[asks], 6)
    for line, got, i in zip(want, found.tolist(), np.flatnonzero(asks).tolist()):
        assert [r for _, r in line if r != i][:5] == got


@pytest.mark.parametrize("points", [clustered(np.random.default_rng(1), 700), np.random.default_rng(2).integers(-300, 300, (700, 64)), np.zeros((40, 3), int), np.arange(90).reshape(-1, 1) ** 3])
def test_levels_separate_and_cover(points):
    """Centres of a level's children are farther apart than the next level's radius, which covers what is below them."""
    tree = cover_tree.build(points.astype(float))
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    below = {}
    for x in reversed(range(len(tree.centre))):
        held = tree.order[tree.low[x] : tree.high[x]].tolist() + [r for c in range(tree.first[x], tree.last[x]) for r in below[c]]
        below[x] = held
        far = np.sqrt(((points[held] - points[tree.centre[x]]) ** 2).sum(1))
        assert np.isclose(far.max(), tree.radius[x]) and tree.radius[x] <= cover_tree.BASE ** float(max(tree.level[x], -1000)) * 1.0001 + (tree.radius[x] == 0)
        children = range(tree.first[x], tree.last[x])
        for i in children:
            assert tree.radius[i] <= cover_tree.BASE ** float(tree.level[x] - 1) * 1.0001
            for j in children:
                assert i == j or np.sqrt(((points[tree.centre[i]] - points[tree.centre[j]]) ** 2).sum()) > cover_tree.BASE ** float(tree.level[x] - 1) * 0.9999
        assert len(children) or len(held) <= cover_tree.LEAF or tree.radius[x] == 0


@pytest.mark.parametrize("scale", [1, 1 << 19, 1 << 30, (1 << 62) - 1])
def test_scores_are_exact_at_any_size(scale):
    rng = np.random.default_rng(9)
    data, queries = rng.integers(-scale, scale + 1, (60, 3)), rng.integers(-scale, scale + 1, (7, 3))
    scores, rows, _ = cover_tree.search(data, np.arange(60), queries, np.full(7, -1), np.full(7, cover_tree.LOWEST), 5)
    want = [sorted((max(min(s, 2**63), -(2**63 - 1)), i) for s, i in line)[:5] for line in exact(data, queries, 60)]
    assert [[(-s, i) for s, i in zip(*line)] for line in zip(scores.tolist(), rows.tolist())] == want


def test_start_and_own_id_are_held_back():
    data = np.array([[3], [3], [2], [1], [-4]])
    scores, rows, _ = cover_tree.search(data, np.array([5, 6, 7, 8, 9]), np.array([[1], [1]]), np.array([5, 0]), np.array([2, cover_tree.LOWEST]), 3)
    assert rows.tolist() == [[1, 2, -1], [0, 1, 2]] and scores[0, :2].tolist() == [3, 2]


def test_groups_of_queries_and_huge_components(spark, monkeypatch):
    for name, value in {"ROWS_PER_PIVOT": 60, "BLOCK_ROWS": 40, "GROUP_QUERIES": 7, "QUERY_BATCH": 5}.items():
        monkeypatch.setattr(cover_tree, name, value)
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(0, 1e9 if i % 3 else 1, 6).tolist()) for i in range(250)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = {q: sorted((-held(sum(a * b for a, b in zip(v, w))), i) for i, w in whole if i != q)[:5] for q, v in whole if q % 5 == 0}
    assert got(cover_tree.top_k(df, F.col("vec_id") % 5 == 0)) == {q: [(r, i, -s) for r, (s, i) in enumerate(line, 1)] for q, line in want.items()}
