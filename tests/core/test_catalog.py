from pyspark.sql import functions as F

from fieldloom.functions.types import iso_time, scalar_type
from fieldloom.operators import catalog, nesting, paths, profile, reports


def test_records_of_equal_place_count_apart(spark):
    nodes = spark.createDataFrame([("a", 1, "tags[0]", "string"), ("b", 1, "tags[0]", "string"), ("b", 1, "tags[1]", "integer")], "record_key string, seq long, path string, type string")
    assert {(r.path, r.type, r.n, r.first_seen) for r in profile.type_counts(nodes).collect()} == {("tags[]", "string", 1, 1), ("tags[]", "mixed", 1, 1)}
    assert {(r.type, r.n) for r in profile.type_counts(nodes.drop("record_key")).collect()} == {("mixed", 1)}


def test_counts_within_rows_are_those_of_nodes(spark):
    texts = ['{"a": [1, "x", 2], "b": [{"c": 1, "d.e": null}, {"c": 2.5}], "": {"it\'s": [[1], [true]]}}', '{"a": [], "b": [{"c": 1}], "e": "2024-01-15T10:30:00"}', "{}", "[1, {\"k\": 2}]", '{"a": 1}', '{"a": 1}']
    records = spark.createDataFrame(list(enumerate(texts)), "seq long, raw string").select("seq", F.col("seq").alias("record_key"), F.parse_json("raw").alias("v"))
    nodes = paths.walk(records).withColumn("seq", F.col("record_key"))
    want = {tuple(r) for r in profile.type_counts(nodes).collect()}
    got = profile.record_counts(records)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    assert {(r.path, r.type) for r in got.where("path in ('a[]', 'b[].c')").collect()} == {("a[]", "mixed"), ("b[].c", "mixed"), ("b[].c", "integer")}
    assert profile.record_counts(records.limit(0)).isEmpty()
    plan = profile.record_counts(records, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_iso_times(spark):
    texts = {"1970-01-02T00:00:00": 86400, "1970-01-02T00:00:00Z": 86400, "1970-01-02T02:00:00+02:00": 86400, "1970-01-01T00:00:01.5": 1, "soon": None, "": None, None: None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", iso_time(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == texts


def test_scalar_types(spark):
    kinds = spark.createDataFrame([(k,) for k in ("null", "uuid", "string", "list", "dict", "unknown")], "k string")
    assert [r.k for r in kinds.where(scalar_type(F.col("k"))).collect()] == ["null", "uuid", "string"]


def test_flatten(spark):
    records = spark.createDataFrame([(1, '{"m": {"s": {"v": "2.1"}, "l": [1, {"a": 2}]}, "n": null, "e": {}}')], "record_key long, raw string").select("record_key", F.parse_json("raw").alias("v"))
    assert sorted((r.name, r.text) for r in paths.flatten(paths.walk(records)).collect()) == [("m_l", '[1,{"a":2}]'), ("m_s_v", "2.1"), ("n", None)]


def test_unique_candidates(spark):
    rows = [("user_id", "a"), ("user_id", "b"), ("key", "x"), ("key", "x"), ("session", "only"), ("name", "n"), ("uuid", None)]
    got = {r.path: (r.n, r.ratio, r.candidate) for r in profile.uniqueness(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"user_id": (2, 1.0, True), "key": (2, 0.5, False), "session": (1, 1.0, True), "name": (1, 1.0, False), "uuid": (0, None, True)}


def test_later_groups_win(spark):
    first, second = (spark.createDataFrame(rows, "record_key long, path string, items string") for rows in ([(1, "p", "a"), (2, "p", "a")], [(1, "p", "b"), (1, "q", "b")]))
    assert sorted(tuple(r) for r in nesting.union_groups(first, second).collect()) == [(1, "p", "b"), (1, "q", "b"), (2, "p", "a")]


def test_consistency_of_equal_and_empty_copies(spark):
    rows = spark.range(5)
    assert catalog.consistency(rows, rows, "id").first().asDict() == {"first": 5, "second": 5, "only_first": 0, "only_second": 0, "consistent": True}
    assert catalog.consistency(rows.limit(0), rows.limit(0), "id").first().consistent
    assert not catalog.consistency(rows, spark.range(1, 6), "id").first().consistent


def test_insert_counts_and_overhead(spark):
    rows = spark.createDataFrame([(1, True), (2, None), (0, False)], "base long, ok boolean")
    assert tuple(reports.insert_counts(rows, F.col("ok")).first()) == (1, 2, False)
    assert [r.overhead for r in reports.overhead(rows.withColumn("x", F.lit(3)), "x", "base").orderBy("base").collect()] == [None, 200.0, 50.0]


def test_upgrade_of_broken_and_old_documents(spark):
    documents = spark.createDataFrame([("no json",), ('{"total_records": 3, "session_start": "now"}',), (None,)], "text string")
    rows = catalog.upgraded(documents).collect()
    assert [(r.version, r.total_records, r.fields, r.session_start) for r in rows] == [(2, 0, {}, None), (2, 3, {}, "now"), (2, 0, {}, None)]
