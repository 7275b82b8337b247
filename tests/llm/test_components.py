import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import components as c
from fieldloom.llm.storage import materialize


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(5)
    yield "random", [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    yield "star of the largest", [(9_000, i) for i in range(900)] + [(9_001, 9_002)]
    yield "star of the least", [(-5, i) for i in range(900)]
    yield "chain of shuffled names", list(zip(names := rng.sample(range(1000), 120), names[1:]))
    yield "two stars by one link", [(0, i) for i in range(1, 500)] + [(1000, 1000 + i) for i in range(1, 500)] + [(499, 1499)]


@pytest.mark.parametrize("edges", [pytest.param(e, id=n) for n, e in graphs()])
def test_against_union_find(spark, monkeypatch, edges):
    monkeypatch.setattr(c, "FEW_ROWS", 20)
    want = union_find([e for e in edges if e[0] != e[1]])
    rows = c.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frequent_keys_are_spread(spark):
    """Of 6000 rows 2000 look up one key and 1500 a key that is not there: no partition has much more than its share."""
    key = F.when(F.col("id") < 2000, 7).when(F.col("id") < 3500, 8).otherwise(F.col("id"))
    rows = materialize(spark.range(6000).select(F.col("id").alias("node"), key.cast("long").alias("label")), "rows")
    table = materialize(spark.range(6000).where("id <> 8").select(F.col("id").alias("key"), (F.col("id") * 10).alias("found")), "table")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = c.looked_up(rows, "label", "node", table)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1.5 * 6000 / len(sizes) and len(sizes) == 8
        assert all(r.found == (None if r.label == 8 else r.label * 10) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
