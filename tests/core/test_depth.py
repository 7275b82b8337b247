from pyspark.sql import functions as F

from fieldloom.operators import paths


def test_walk_visits_all_levels(spark):
    raw = '{"a": {"b": [{"c": {"d": {"e": {"f": {"g": [1, "]}\\\\\\"{["]}}}}}]}}'
    rows = spark.createDataFrame([(1, raw), (2, "{}")], "record_key long, raw string").select("record_key", F.parse_json("raw").alias("v"))
    assert paths.depth(rows) == 9 and paths.depth(rows.where("record_key = 3")) == 0
    assert {"a.b[0].c.d.e.f.g[0]", "a.b[0].c.d.e.f.g[1]"} <= {r.path for r in paths.walk(rows).collect()}
    assert paths.walk(rows.where("record_key = 3")).count() == 0
