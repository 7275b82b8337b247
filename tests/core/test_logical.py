"""Requests on an ingested store: what is written is what is read back."""

import json

import pytest
from pyspark.sql import functions as F

from fieldloom.operators.numbering import numbered
from fieldloom.plans import logical, requests
from fieldloom.sources.store import SnapshotStore
from fieldloom.streaming import ingest


def batch_of(spark, records, parts=4):
    raw = spark.createDataFrame([(json.dumps(r),) for r in records], "raw string").repartition(parts)
    return raw.withColumn("v", F.try_parse_json("raw")).withColumn("rejected", F.col("v").isNull())


def person(i):
    return {
        "username": f"u{i}", "age": i, "we.ird": f"w{i}", "active": i % 2 == 0, "profile": {"bio": f"b{i}", "site": {"url": "x"}}, "post": {"b": [{"x": i}, {"x": i + 1}]}, "tags": ["new", f"t{i}"],
        "phone1": i, "phone2": "b", "orders": [{"id": 10 * i + k, "items": [{"q": k}], "price": 0.5 + k} for k in range(i % 6)], "wide": {f"k{j}": j for j in range(i % 11)},
    }


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("filled") / "store"))
    ingest.ingest_batch(store, batch_of(spark, [person(i) for i in range(20)]), 0)
    return store


@pytest.fixture
def store(spark, filled):
    """The filled store at its first version, for one test to change."""
    return Pinned(filled)


class Pinned(SnapshotStore):
    """A store that begins with another's manifest and puts its own in a folder beside."""

    def __init__(self, other):
        super().__init__(other.spark, other.root)
        self.first, self.own = other.version(), {}

    def version(self):
        return max(self.own, default=self.first)

    def manifest(self, version=None):
        version = self.version() if version is None else version
        return self.own[version] if version in self.own else super().manifest(version)

    def begin(self):
        change, store = super().begin(), self

        def commit():
            store.own[change.base + 1] = change.held | change.staged
            change.state = "committed"
            return change.base + 1

        change.commit = commit
        return change


def get(store, fields=None, filters=None, **more):
    answer = requests.execute(store, {"operation": "read", "fields": fields, "filters": filters, **more})
    assert answer["success"], answer
    return [r.asDict() for r in answer["data"].collect()]


def test_fields_of_every_kind(filled):
    row = get(filled, ["age", "active", "profile.bio", "profile.site", "post.b", "tags", "we.ird", "phone", "orders"], {"username": "u3"})[0]
    assert (row["age"], row["active"], row["profile.bio"], row["we.ird"]) == (3, False, "b3", "w3")
    assert json.loads(row["profile.site"]) == {"url": "x"}
    assert [json.loads(x) for x in row["post.b"]] == [{"x": 3}, {"x": 4}]
    assert [json.loads(x) for x in row["tags"]] == [{"value": "new"}, {"value": "t3"}]
    assert [json.loads(x) for x in row["phone"]] == [{"value": 3}, {"value": "b"}], "numbers stay numbers"
    assert [json.loads(x) for x in row["orders"]] == person(3)["orders"], "items keep what is nested in them"


@pytest.mark.parametrize("i", [3, 5])
def test_places_and_every_item(filled, i):
    """Lists that stand in child rows (3 items) and apart from the document (5 items) read alike."""
    row = get(filled, ["orders[0].id", "orders[1].items[0].q", "tags[1]", "post.b[1].x"], {"username": f"u{i}"})[0]
    assert (row["orders[0].id"], row["orders[1].items[0].q"], row["tags[1]"], row["post.b[1].x"]) == (10 * i, 1, f"t{i}", i + 1)
    assert json.loads("[" + ",".join(get(filled, ["orders.price"], {"username": f"u{i}"})[0]["orders.price"]) + "]") == [0.5 + k for k in range(i % 6)]
    assert get(filled, ["orders[9].id"], {"username": f"u{i}"})[0]["orders[9].id"] is None


def test_referenced_values(filled):
    references = ingest.live(filled, "references")
    assert {r["entity_path"] for r in references.select("entity_path").distinct().collect()} == {"orders", "wide"}
    raw = {r.username: json.loads(r.raw) for r in filled.read("records").collect()}
    assert "orders" not in raw["u5"] and raw["u5"]["orders_ref_collection"] == "ref_orders" and raw["u3"]["orders"] == person(3)["orders"]
    rows = get(filled, ["orders", "wide"], {"username": {"$in": ["u5", "u10"]}})
    for row in rows:
        i = int(row["username"][1:])
        assert [json.loads(x) for x in row["orders"]] == person(i)["orders"] and json.loads(row["wide"]) == person(i)["wide"]
    assert get(filled, ["wide.k9"], {"username": "u10"})[0]["wide.k9"] == 9


def test_all_fields_and_pages(filled):
    rows = get(filled, limit=None)
    assert len(rows) == 20 and {"age", "orders", "post", "we.ird", "wide"} <= set(rows[0])
    assert [r["username"] for r in get(filled, ["age"], {"age": {"$gte": 15}}, limit=2)] == [r["username"] for r in get(filled, ["age"], {"age": {"$gte": 15}}, limit="2")]
    plan = requests.execute(filled, {"operation": "read", "fields": ["age"], "limit": None})["data"]._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Limit" not in plan and "Exchange" not in plan


def test_update_is_read_back(store):
    ask = lambda data, filters: requests.execute(store, {"operation": "update", "filters": filters, "data": data})
    assert ask({"age": 99, "fresh": {"a": [1]}}, {"username": "u1"})["updated"] == 1
    row = get(store, ["age", "fresh"], {"username": "u1"})[0]
    assert (row["age"], row["fresh"]) == (99, '{"a":[1]}') and get(store, ["fresh.a"], {"username": "u1"})[0]["fresh.a"] == ['{"value":1}']
    assert [r["username"] for r in get(store, ["age"], {"age": 99})] == ["u1"] and get(store, ["age"], {"age": 1}) == []
    assert get(store, ["age"], {"username": "u2"})[0]["age"] == 2
    assert ask({"profile.bio": "new", "profile.more.deep": 1}, {"username": "u4"})["updated"] == 1
    assert json.loads(get(store, ["profile"], {"username": "u4"})[0]["profile"]) == {"bio": "new", "more": {"deep": 1}, "site": {"url": "x"}}
    assert ask({"age": 5}, {"age": 99})["updated"] == 1 and get(store, ["age"], {"username": "u1"})[0]["age"] == 5, "a later change wins"
    assert ask({"username": "renamed"}, {"username": "u7"})["updated"] == 1
    assert get(store, ["age"], {"username": "renamed"})[0]["age"] == 7 and get(store, ["age"], {"username": "u7"}) == []
    assert ask({"age": 1}, {"username": "nobody"}) == {"success": True, "version": store.version(), "updated": 0}
    values = {r.record_key: r.text for r in ingest.live(store, "values").where("path = 'age'").collect()}
    assert len(values) == 20 and sorted(map(int, values.values())) == sorted([0, 5, *range(2, 20)])
    assert logical.compact(store) and get(store, ["age"], {"username": "renamed"})[0]["age"] == 7 and get(store, ["age", "profile.more.deep"], {"username": "u4"})[0]["profile.more.deep"] == 1
    assert store.read("changes").count() == 0 and ingest.live(store, "values").where("path = 'age'").count() == 20


def test_update_of_lists(store):
    """Changed lists and numbered scalars have new child rows; the old ones are void."""
    ask = lambda data, name: requests.execute(store, {"operation": "update", "filters": {"username": name}, "data": data})
    assert ask({"orders": [{"id": 1, "note": "n"}]}, "u5")["updated"] == 1
    assert [json.loads(x) for x in get(store, ["orders"], {"username": "u5"})[0]["orders"]] == [{"id": 1, "note": "n"}]
    assert ask({"orders[0].id": 7}, "u5")["updated"] == 1 and ask({"orders[4].price": 8.5}, "u11")["updated"] == 1
    assert get(store, ["orders[0].id"], {"username": "u5"})[0]["orders[0].id"] == 7
    assert [json.loads(x)["price"] for x in get(store, ["orders"], {"username": "u11"})[0]["orders"]] == [0.5, 1.5, 2.5, 3.5, 8.5]
    assert ask({"phone2": "z", "phone3": 4}, "u6")["updated"] == 1
    assert [json.loads(x)["value"] for x in get(store, ["phone"], {"username": "u6"})[0]["phone"]] == [6, "z", 4]
    assert ask({"tags": []}, "u8")["updated"] == 1 and get(store, ["tags"], {"username": "u8"})[0]["tags"] == []
    before = {i: get(store, ["orders", "phone"], {"username": f"u{i}"})[0] for i in (5, 6, 11)}
    logical.compact(store)
    assert before == {i: get(store, ["orders", "phone"], {"username": f"u{i}"})[0] for i in (5, 6, 11)}


def test_update_writes_only_what_it_hits(store, filled):
    held = filled.manifest()
    assert requests.execute(store, {"operation": "update", "filters": {"username": "u1"}, "data": {"age": 99}})["success"]
    now = store.manifest()
    assert now["records"] == held["records"] and all(set(held[t]) <= set(now[t]) for t in ("children", "values", "references", "batches"))
    assert store.read("changes").count() == 1


def test_delete_leaves_nothing(store):
    answer = requests.execute(store, {"operation": "delete", "filters": {"username": {"$in": ["u2", "u5"]}}})
    assert answer["deleted"] == 2 and answer["parts"]["records"] == 2 and answer["parts"]["references"] == 5
    keys = {r.sys_ingested_at for r in ingest.live(store, "records").collect()}
    assert len(keys) == 18
    for table, (key, _) in ingest.OWNED.items():
        assert {r[0] for r in ingest.live(store, table).select(key).collect()} <= keys, table
    assert get(store, ["age"], {"username": "u2"}) == [] and len(get(store, ["age"], limit=None)) == 18
    assert requests.sanitized(answer)["deleted"] == sum(answer["parts"].values()) and "parts" not in requests.sanitized(answer)
    assert requests.execute(store, {"operation": "delete", "filters": {"username": "u2"}})["deleted"] == 0
    logical.compact(store)
    assert store.read("records").count() == 18 and store.read("tombstones").count() == 0 and len({r.parent_sys_ingested_at for r in store.read("children").collect()} - keys) == 0


def test_insert_and_read(store):
    answer = requests.execute(store, {"operation": "insert", "data": [{"username": "new1", "age": 41, "orders": [{"id": 1, "items": [{"q": 2}]}], "_tx_id": "t"}, {"age": 42, "hobby": "chess"}]})
    assert answer["success"] and answer["inserted"] == 2
    row = get(store, ["age", "orders[0].items[0].q"], {"username": "new1"})[0]
    assert (row["age"], row["orders[0].items[0].q"]) == (41, 2) and row["sys_ingested_at"]
    assert get(store, ["hobby"], {"age": 42})[0] | {"sys_ingested_at": 0, "t_stamp": 0} == {"hobby": "chess", "username": "unknown_user", "sys_ingested_at": 0, "t_stamp": 0}
    assert requests.execute(store, {"operation": "insert", "data": {"username": "new2"}})["inserted"] == 1
    assert sorted(r.seq for r in store.read("records").collect()) == list(range(23)) and not any("_tx_id" in r.raw for r in store.read("records").collect())
    refused = requests.execute(store, {"operation": "insert", "data": {"username": "x", "age": "not_a_number"}})
    assert not refused["success"] and "Type conflict for 'age'" in refused["error"] and len(get(store, limit=None)) == 23
    assert {r.metric: r.value for r in ingest.totals(store).collect()}["records"] == 23


def test_entities(store):
    rows = get_entity(store, ["id", "price"], {"price": {"$gt": 3}})
    assert len(rows) == 9 and all(isinstance(r["price"], float) and isinstance(r["id"], int) for r in rows)
    assert logical.entity_columns(store, "orders") == {"id": "bigint", "price": "double"}
    assert requests.execute(store, {"operation": "delete", "entity": "norm_orders", "filters": {"id": 51}})["deleted"] == 1
    assert [json.loads(x)["id"] for x in get(store, ["orders"], {"username": "u5"})[0]["orders"]] == [50, 52, 53, 54]
    assert requests.execute(store, {"operation": "update", "entity": "orders", "filters": {"id": 1}, "data": {"id": 2}})["success"] is False
    kinds = {(r.entity, r.column): r.type for r in logical.describe(store).collect()}
    assert kinds["records", "we.ird"] == "string" and kinds["orders", "id"] == "integer" and kinds["tags", "value"] == "string" and ("orders", "items") not in kinds


def get_entity(store, fields, filters):
    answer = requests.execute(store, {"operation": "read", "entity": "orders", "fields": fields, "filters": filters, "limit": None})
    return [r.asDict() for r in answer["data"].collect()]


def test_errors_are_answers(filled):
    for request in [
        {"operation": "read", "limit": "x"}, {"operation": "read", "limit": -1}, {"operation": "read", "filters": {"username": {"$regex": "("}}}, {"operation": "read", "filters": "age"}, {"operation": "update", "filters": {"age": 1}, "data": {"sys_ingested_at": "k"}},
        {"operation": "update", "filters": {"age": 1}}, {"operation": "update", "data": {"age": 1}}, {"operation": "delete"}, {"operation": "insert", "data": [1]}, {"operation": "read", "fields": ["nope", "age"]}, {"operation": "update", "filters": {"age": 1}, "data": {"age": {"x": 1}}}, {"operation": None}, {"operation": "read", "entity": "nope"},
    ]:
        answer = requests.execute(filled, request)
        assert answer["success"] is False and answer["error"], request
    for filters in [{"age": "abc"}, {"age": {"$gt": "abc"}}, {"age": {"$in": ["abc"]}}, {"active": "yes"}, {"username": {"$in": []}}, {"age": True}]:
        assert get(filled, ["age"], filters) == [], filters
    assert len(get(filled, ["age"], {"age": {"$ne": "abc"}})) == 20


def test_numbers_without_gaps(spark):
    rows = spark.range(0, 1000, 1, 7).where("id % 3 <> 0").withColumn("number", F.monotonically_increasing_id())
    got = numbered(rows, "number", "n", 5).orderBy("number").collect()
    assert [r.n for r in got] == list(range(5, 5 + len(got)))


def test_buffer_slots_and_hand_placement(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    fields = {f"f{j}x": j for j in range(30)}
    ingest.ingest_batch(store, batch_of(spark, [{"username": "a", **fields} for _ in range(2)]), 0)
    before = {f for f in store.manifest()["buffer"] if "slot=" in f}
    assert store.read("buffer").count() == 60 and 1 < len(before) <= 30
    ingest.ingest_batch(store, batch_of(spark, [{"username": "a", "f7x": 1} for _ in range(8)]), 1)
    after = {f for f in store.manifest()["buffer"] if "slot=" in f}
    assert len(before - after) == 1, "only the slot of the field that was placed is rewritten"
    assert store.read("buffer").count() == 58 and store.read("values").where("path = 'f7x'").count() == 10
    assert ingest.forget_field(store, "f3x") == 2 and ingest.forget_field(store, "f3x") == 0 and store.read("buffer").where("path = 'f3x'").count() == 0
    ingest.set_placement(store, "f5x", "SQL")
    assert store.read("values").where("path = 'f5x' and backend = 'SQL'").count() == 2 and ingest.drain_placed(store) == 0
    found = {r.metric: r.value for r in ingest.totals(store).collect()}
    assert found["buffered"] == store.read("buffer").count() == 54 and found["routed"] == store.read("values").count() and found["drained"] == 6
    with pytest.raises(ValueError):
        ingest.set_placement(store, "f5x", "Cloud")
