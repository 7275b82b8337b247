"""Typed child tables in buckets by parent: the same rows at every stage of a store's life, and no shuffle of laid rows."""

import json

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.predicates import RequestError
from fieldloom.plans import layout, logical, requests
from fieldloom.sources.store import SnapshotStore
from fieldloom.streaming import ingest


def add(store, records, number):
    raw = store.spark.createDataFrame([(json.dumps(r),) for r in records], "raw string").repartition(2)
    ingest.ingest_batch(store, raw.withColumn("v", F.try_parse_json("raw")).withColumn("rejected", F.col("v").isNull()), number)


def order(i, **more):
    return {"username": f"u{i}", "age": i, "orders": [{"id": 10 * i + k, "Id": "x", "a b": k % 2 == 0} | more for k in range(i % 4)], "tags": [f"t{i}"], "note.x": "n"}


def seen(store, entity="orders", names=None):
    """Rows of the nest-join by user, which must be those of the child table."""
    rows = {r.username: [x.asDict() for x in r["items"]] for r in layout.nested(store, entity, names).collect()}
    keys = {r.sys_ingested_at: r.username for r in logical.base_rows(store, [], None)[0].collect()}
    flat = sorted((keys[r.parent_sys_ingested_at], r.item_index, str(r[2:])) for r in logical.child_table(store, entity).collect())
    assert flat == sorted((u, x["item_index"], str(tuple(list(x.values())[1:]))) for u, items in rows.items() for x in items)
    return rows


def execute(store, **request):
    answer = requests.execute(store, request)
    assert answer["success"], answer
    return answer


def test_same_rows_through_a_stores_life(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    add(store, [order(i) for i in range(8)], 0)
    loose = seen(store)
    assert len(loose) == 8 and [x["id"] for x in loose["u7"]] == [70, 71, 72] and loose["u4"] == [] and loose["u7"][0]["Id"] == "x" and loose["u7"][1]["a b"] is False
    version = layout.lay_out(store, 4)
    assert seen(store) == loose and layout.lay_out(store, 4) == version
    assert len(seen(store, "tags")) == 8 and seen(store, "norm_tags")["u3"] == [{"item_index": 0, "value": "t3"}]

    first = dict(store.manifest())
    add(store, [order(i, price=0.5) for i in range(8, 12)], 1)
    grown = seen(store)
    assert grown["u11"][0]["price"] == 0.5 and grown["u7"][0]["price"] is None and len(grown) == 12
    layout.lay_out(store, 4)
    assert seen(store) == grown and {k: v for k, v in store.manifest().items() if k in first and k.startswith("laid/")} == {k: v for k, v in first.items() if k.startswith("laid/")}

    execute(store, operation="update", filters={"username": "u7"}, data={"orders": [{"id": 1, "price": 2}]})
    execute(store, operation="update", filters={"username": "u4"}, data={"orders": [{"id": 2}], "username": "four"})
    execute(store, operation="delete", filters={"username": "u11"})
    changed = seen(store)
    assert [(x["id"], x["price"]) for x in changed["u7"]] == [(1, 2.0)] and [x["id"] for x in changed["four"]] == [2] and "u11" not in changed and len(changed) == 11
    layout.lay_out(store, 4)
    assert seen(store) == changed
    key = logical.base_rows(store, [], None)[0].where("username = 'u3'").first().sys_ingested_at
    execute(store, operation="delete", entity="orders", filters={"parent_sys_ingested_at": key, "item_index": 1})
    assert [x["id"] for x in seen(store)["u3"]] == [30, 32]
    less = seen(store)
    logical.compact(store)
    assert seen(store) == less
    layout.lay_out(store, 2)
    assert seen(store) == less and len(layout.generations(store.manifest())) == 1


def test_columns_that_outgrow_their_type(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    add(store, [{"username": "a", "orders": [{"n": 1, "m": 1.50}]}], 0)
    layout.lay_out(store, 2)
    add(store, [{"username": "b", "orders": [{"n": 2.5, "m": 1}]}], 1)
    assert seen(store)["a"][0] == {"item_index": 0, "m": 1.5, "n": 1.0}
    layout.lay_out(store, 2)
    add(store, [{"username": "c", "orders": [{"n": "x", "m": True}]}], 2)
    text = seen(store)
    assert [text[u][0]["n"] for u in "abc"] == ["1", "2.5", "x"]
    layout.lay_out(store, 2)
    assert seen(store) == text and len(layout.generations(store.manifest())) == 1


def test_laid_rows_are_not_shuffled(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    add(store, [order(i) for i in range(8)], 0)
    layout.lay_out(store, 4)
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        text = plan(layout.nested(store, "orders", ["age"]))
        assert "Exchange" not in text and "SortMergeJoin" in text
        even = plan(logical.child_table(store, "orders").where("`a b`").select("`a b`"))
        name = layout.stored_name("a b")
        assert layout.stored_name("id") not in even and f"PushedFilters: [IsNotNull({name}), EqualTo({name},true)]" in even
        execute(store, operation="delete", filters={"username": "u3"})
        assert plan(layout.nested(store, "orders", ["age"])).count("Exchange hashpartitioning") == 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_fresh_session_and_errors(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    add(store, [order(i) for i in range(4)], 0)
    layout.lay_out(store, 2)
    want = seen(store)
    for g in layout.generations(store.manifest()).values():
        for folder in [g.records, *g.groups.values()]:
            spark.sql(f"DROP TABLE fieldloom_{folder.rpartition('/')[2].split('.')[0]}")
    assert seen(store) == want
    with pytest.raises(RequestError):
        layout.nested(store, "nope")
    with pytest.raises(RequestError):
        layout.nested(store, "orders", ["orders"])
