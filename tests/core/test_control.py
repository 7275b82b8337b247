"""The control plane of an ingested store."""

import json

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.predicates import RequestError
from fieldloom.operators import catalog
from fieldloom.plans import control, requests
from fieldloom.sources.store import SnapshotStore
from fieldloom.streaming import ingest

LOG = [{"event": "login"}, {"event": "click"}]


def batch_of(spark, records):
    raw = spark.createDataFrame([(json.dumps(r),) for r in records], "raw string")
    return raw.withColumn("v", F.try_parse_json("raw")).withColumn("rejected", F.col("v").isNull())


def strategies(store):
    return {r.path: (r.score, r.mode, list(r.reasons)) for r in store.read("strategies").collect()}


def test_hints_of_schemas(spark):
    schema = {"entities": {"a": {"unbounded": True, "shared": 1, "expected_max_items": 5 << 32}, "b": {"expected_max_items": 12.5, "frequently_updated": "true"}, "c": "text", "d": None}}
    rows = spark.createDataFrame([(json.dumps(schema),), ("{}",), ("broken {",), (None,)], "schema_json string")
    got = {r.path: tuple(r.hint) for r in catalog.entity_hints(rows).collect()}
    assert got == {"a": (False, False, True, 2**31 - 1), "b": (False, False, False, None)}


def test_schemas_judge_what_comes_after(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert control.active_schema(store) == {} and ingest.registered_hints(store) is None
    assert control.register_schema(store, {"entities": {"other": {"unbounded": True}}}) == 1
    ingest.ingest_batch(store, batch_of(spark, [{"username": "a", "log": LOG, "we.ird": {"x": 1}}]), 0)
    assert strategies(store) == {"log": (1, "embed", ["array_of_objects"]), "['we.ird']": (0, "embed", [])}
    newest = {"entities": {"log": {"unbounded": True, "frequently_updated": True}, "we.ird": {"unbounded": True}}}
    assert control.register_schema(store, newest) == 2 and control.active_schema(store) == newest
    ingest.ingest_batch(store, batch_of(spark, [{"username": "b", "log": LOG, "we.ird": {"x": 2}}]), 1)
    assert strategies(store)["log"] == (4, "reference", ["array_of_objects", "schema_hint_frequently_updated", "schema_hint_unbounded"])
    assert strategies(store)["['we.ird']"] == (2, "reference", ["schema_hint_unbounded"])
    kept = store.read("references").select("parent_sys_ingested_at", "entity_path", "payload").collect()
    assert len(kept) == 3 and all(".00000001." in r.parent_sys_ingested_at for r in kept), "what came before stays as it was judged"
    requests.execute(store, {"operation": "update", "filters": {"username": "a"}, "data": {"log": LOG[:1]}})
    assert store.read("references").where("entity_path = 'log' and change > 0").count() == 1, "an update is judged by the active schema"
    data = requests.execute(store, {"operation": "read", "fields": ["log"]})["data"]
    assert sorted(len(r.log) for r in data.collect()) == [1, 2]
    totals = {r.metric: r.value for r in ingest.totals(store).collect()}
    assert totals["versions"] == 2 and totals["records"] == 2
    with pytest.raises(RequestError):
        control.register_schema(store, ["no schema"])


def test_strategy_by_request_holds_until_the_next_record(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    control.set_strategy(store, "log", "reference")
    assert strategies(store) == {"log": (None, "reference", ["set by request"])}
    ingest.ingest_batch(store, batch_of(spark, [{"username": "a", "log": LOG}]), 0)
    control.set_strategy(store, "log", "reference", "by hand")
    ingest.ingest_batch(store, batch_of(spark, [{"username": "b"}]), 1)
    assert strategies(store) == {"log": (None, "reference", ["by hand"])}
    ingest.ingest_batch(store, batch_of(spark, [{"username": "c", "log": LOG}]), 2)
    assert strategies(store) == {"log": (1, "embed", ["array_of_objects"])}
    with pytest.raises(RequestError):
        control.set_strategy(store, "log", "cloud")


def test_parts_and_pages(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    people = [{"username": f"{'Ann' if i % 2 else 'bob'}{i}", "age": i, "log": LOG, "many": list(range(11))} for i in range(12)]
    ingest.ingest_batch(store, batch_of(spark, [*people, {"username": "ann", "rare": 1}]), 0)
    got = {(r.name, r.kind, r.path): r.instances for r in control.parts(store).collect()}
    assert got == {("records", "root", ""): 13, ("norm_log", "children", "log"): 24, ("norm_many", "children", "many"): 132, ("ref_many", "reference", "many"): 132}
    assert control.placed_fields(store) == ["age", "log", "many"], "a field that waits in the buffer is no column"
    first = control.records_page(store, limit=4, username=" ann ").collect()
    assert [r.username[:3].lower() for r in first] == ["ann"] * 4 and all(r.has_more for r in first)
    rest = control.records_page(store, limit=5000, username="ANN", after=first[-1].sys_ingested_at).collect()
    assert len(rest) == 3 and not any(r.has_more for r in rest) and not {r.username for r in rest} & {r.username for r in first}
    assert [r.username for r in control.records_page(store, limit=0, offset=-3).collect()] == ["bob0"]
    requests.execute(store, {"operation": "delete", "filters": {"age": {"$gte": 0}}})
    got = {r.name: r.instances for r in control.parts(store).collect()}
    assert got == {"records": 1, "norm_log": 0, "norm_many": 0, "ref_many": 0}
