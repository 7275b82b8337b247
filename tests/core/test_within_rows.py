"""What ingestion derives from records is worked out within their rows: the same as from their nodes, and without a shuffle."""

import json

from pyspark.sql import functions as F

from fieldloom.operators import paths, profile
from fieldloom.plans import logical
from fieldloom.sources import events
from fieldloom.sources.store import SnapshotStore
from fieldloom.streaming import ingest

ODD = [
    {"a": [1, "x", None], "b": [[1], [2, 3]], "o": [{"k": 1, "d": {"z": [1, 2]}}, {"d": {}}], "e": [], "p1": 1, "p2": "y", "we.ird": [1.5], "x[]": ["2024-01-15T10:30:00"], "n": None},
    {"a": {"k": [True, False]}, "o": [{"k": "s\\\"-@", "t": ["u", "v"]}, 3], "big": 12345678901234567890, "huge": int("9" * 40), "f": 1e3, "ip": "256.1.1.1", "ok": "1.2.3.4", "s": "a:1,b", "x[].y": [{"q": [1]}]},
    [1, 2], [{"a": 1}, {"b": [2]}], 7, {"": {"": [{"'": 1, '"': 2}]}, "d": {"l": [{"i": 1}], "m": [[{}]]}},
]


def records_of(spark, texts):
    rows = spark.createDataFrame([(f"k{i}", i, t) for i, t in enumerate(texts)], "sys_ingested_at string, seq long, raw string")
    return rows, ingest.parsed_records(rows)


def test_same_as_from_nodes(spark):
    texts = [json.dumps(r) for r in ODD] + [json.dumps(ODD[0], indent=1)] + [r.raw for r in events.generate(spark, 30).collect()]
    rows, parsed = records_of(spark, texts)
    counted = profile.text_counts(rows)
    want = {tuple(r) for r in profile.record_counts(rows.select("seq", F.parse_json("raw").alias("v"))).collect()}
    assert {tuple(r)[:5] for r in counted.collect()} == want
    nodes = paths.walk(parsed)
    repeating = {(r.record_key.seq, r.path, r.kind, r.n_items) for r in paths.repeating(nodes).collect() if not r.path.endswith(("']", '"]'))}
    levels, into_lists, numbers = ingest.list_depths(counted)
    assert into_lists and numbers
    found = paths.lists(parsed, levels, into_lists).select("record_key.seq", "path", "kind", F.size("items").alias("n"))
    assert {tuple(r) for r in found.collect()} == repeating
    rows, parsed = records_of(spark, [r.raw for r in events.generate(spark, 30).collect()])
    levels, into_lists, numbers = ingest.list_depths(profile.text_counts(rows))
    assert (levels, into_lists, numbers) == (1, False, False), "lists are looked for only where the counts have some"
    found = paths.lists(parsed, levels, into_lists).select("record_key.seq", "path", "kind", F.size("items").alias("n"))
    assert {tuple(r) for r in found.collect()} == {(r.record_key.seq, r.path, r.kind, r.n_items) for r in paths.repeating(paths.walk(parsed)).collect()}


def test_equal_shapes_have_equal_paths():
    texts = ['{"a":1}', '{"a":22}', '{"a":1.5}', '{"a":"x"}', '{"a":"y"}', '{"a":"1.2.3.4"}', '{"a":"300.2.3.4"}', '{"a":' + "9" * 39 + "}", '{"b":1}', '{ "a" : "b" , "c":1}', '{"a":"\\u0041"}', '{"a":"2024-01-15T10:30:00"}', '{"a":"2024-01-15T1"}']
    by_shape = {}
    for text in texts:
        found = by_shape.setdefault(profile.shape(text), profile.path_types(json.loads(text)))
        assert found == profile.path_types(json.loads(text)), text
    assert len(by_shape) < len(texts)


def test_derived_rows_are_not_shuffled(spark):
    rows, parsed = records_of(spark, [r.raw for r in events.generate(spark, 5).collect()])
    counted = profile.text_counts(rows).localCheckpoint()
    judged = ingest.strategies(ingest.judging(parsed, counted))
    for frame in (ingest.child_rows(parsed, None, 1, False), ingest.scalars(parsed, None), ingest.reference_rows(judged), ingest.documents(rows, counted)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(record_key" not in plan and "hashpartitioning(sys_ingested_at" not in plan


def test_items_of_a_group_are_collected_once(spark, tmp_path):
    """Payloads kept apart win over child rows; items have their nested keys behind the others, and are one list before the choice."""
    store = SnapshotStore(spark, str(tmp_path / "store"))
    texts = [json.dumps({"username": "u", "l": [{"k": i, "a": [i], "q": '"\\'} for i in range(n)]}) for n in (2, 4)]
    batch = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("v", F.parse_json("raw")).withColumn("rejected", F.lit(False))
    ingest.ingest_batch(store, batch, 0)
    items = logical.group_items(store, "l", None, None)
    assert items._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    got = sorted((len(r["items"]), [json.loads(x) for x in r["items"]]) for r in items.collect())
    assert got == [(n, [{"k": i, "a": [i], "q": '"\\'} for i in range(n)]) for n in (2, 4)]
