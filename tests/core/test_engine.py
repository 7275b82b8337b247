import json

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.types import detect_type, duration, shortened, string_type
from fieldloom.operators import paths, placement, profile, reports
from fieldloom.plans import requests
from fieldloom.sources import events
from fieldloom.sources.store import ConflictError, SnapshotStore
from fieldloom.streaming import ingest

STRINGS = {
    "192.168.1.1": "ip_address", "256.1.1.1": "string", "1.2": "string", "user@example.com": "email", "https://example.com": "url",
    "550e8400-e29b-41d4-a716-446655440000": "uuid", "2024-01-15T10:30:00": "timestamp", "2024-99-99T99:99:99": "timestamp", "": "string", "hello": "string",
}


def test_type_vectors(spark):
    rows = spark.createDataFrame([(s,) for s in STRINGS], "s string").select("s", string_type(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == STRINGS
    values = {"null": "null", "true": "boolean", "42": "integer", "99999999999999999999": "integer", "1.2": "float", "1e3": "float", "[1]": "list", '{"a": 1}': "dict"}
    rows = spark.createDataFrame([(s,) for s in values], "s string").select("s", detect_type(F.parse_json("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == values


def test_placement_vectors(spark):
    cases = [("email", "email", 95, 95, "SQL"), ("altitude", "float", 30, 30, "MongoDB"), ("battery", "integer", 80, 50, "MongoDB"), ("username", "string", 100, 100, "Both"), ("few", "integer", 9, 9, "Buffer"), ("m60", "integer", 60, 60, "MongoDB"), ("m70", "string", 70, 70, "SQL"), ("m63", "integer", 63, 63, "MongoDB"), ("m64", "integer", 64, 64, "SQL"), ("d81", "integer", 90, 81, "MongoDB"), ("d82", "integer", 90, 82, "SQL"), ("nested", "dict", 20, 20, "MongoDB")]
    counts = [(p, t, top, 1, 9) for p, t, _, top, _ in cases] + [(p, "string" if t != "string" else "integer", n - top, 2, 9) for p, t, n, top, _ in cases if n > top]
    placed = placement.place(profile.field_stats(spark.createDataFrame(counts, "path string, type string, n long, first_seen long, last_seen long"), 100)).collect()
    assert {r.path: r.backend for r in placed} == {p: b for p, _, _, _, b in cases}
    by = {r.path: r for r in placed}
    assert by["email"].reason == "High frequency + stable stability [freq_zone=high(95.0%), stab_zone=stable(100.0%), confidence=0.93, boosters=1]"
    assert by["altitude"].reason == "Low frequency [freq_zone=low(30.0%), stab_zone=stable(100.0%), confidence=0.46]"
    assert by["battery"].reason.startswith("Severe drift quarantine [freq_zone=high(80.0%)") and by["battery"].quarantined


def test_walk_and_groups(spark):
    record = {"phone2": "b", "phone1": "a", "phone10": "c", "tags": ["x", "y"], "o": [{"i": 1}, {"i": 2, "deep": [{"z": None}]}], "p": {"q": {"r": 1.5}}}
    rows = spark.createDataFrame([(1, json.dumps(record))], "record_key long, raw string").select("record_key", F.parse_json("raw").alias("v"))
    nodes = paths.walk(rows)
    assert {r.path: r.type for r in nodes.collect()} == {"phone2": "string", "phone1": "string", "phone10": "string", "tags": "list", "tags[0]": "string", "tags[1]": "string", "o": "list", "o[0]": "dict", "o[1]": "dict", "o[0].i": "integer", "o[1].i": "integer", "o[1].deep": "list", "o[1].deep[0]": "dict", "o[1].deep[0].z": "null", "p": "dict", "p.q": "dict", "p.q.r": "float"}
    assert [(r.base, list(r.texts)) for r in paths.scalar_groups(nodes).collect()] == [("phone", ["a", "b", "c"])]
    assert {(r.path, r.kind, r.n_items) for r in paths.repeating(nodes).collect()} == {("tags", "primitive", 2), ("o", "entity", 2)}


def test_store_and_requests(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    people = [{"sys_ingested_at": f"k{i}", "username": f"User{i}", "age": 20 + i} for i in range(5)]
    assert requests.execute(store, {"operation": "insert", "data": people}) == {"success": True, "version": 1, "inserted": 5}
    assert not requests.execute(store, {"operation": "insert", "data": people[:1]})["success"], "a known key is refused"
    rows = requests.execute(store, {"operation": "read", "fields": ["age"], "filters": {"username": {"$starts_with": "USER"}}, "limit": 2})["data"].collect()
    assert [r.asDict() for r in rows] == [{"age": 20, "username": "User0", "sys_ingested_at": "k0"}, {"age": 21, "username": "User1", "sys_ingested_at": "k1"}]
    assert requests.execute(store, {"operation": "update", "filters": {"username": "User3"}, "data": {"age": 99, "new": "n"}})["updated"] == 1
    old, rival = store.read("records", 1), store.begin()
    assert requests.execute(store, {"operation": "delete", "filters": {"age": {"$in": [20, 99]}}})["deleted"] == 2
    assert (store.read("records").count(), old.count()) == (3, 5), "readers keep their version"
    rival.update("records", F.lit(True), {"age": F.lit(1)})
    with pytest.raises(ConflictError):
        rival.commit()
    for request, error in [({"operation": "delete", "filters": {}}, "filters or allow_all"), ({"operation": "upsert"}, "Unsupported operation: upsert"), ({"operation": "insert"}, "Missing 'data'"), ({"operation": "read", "fields": ["nope"]}, "Fields do not exist: nope"), ({"operation": "read", "filters": {"age": {"$near": 1}}}, "Unknown operator")]:
        assert error in requests.execute(store, request)["error"]
    assert requests.without_conflicts(["a.b", "a", "l[1]", "l[0]", "c", "c"]) == ["a", "c", "l[0]"]


def test_stream_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    raws = [r.raw for r in events.generate(spark, 40).collect()]
    for k in range(2):
        (landing / f"{k}.txt").write_text("\n".join([f"data: {r}" for r in raws[20 * k : 20 * k + 20]] + ["data: {broken", ": comment", ""]))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stream = events.stream_landing(spark, str(landing), 1)
    ingest.start(store, stream, str(tmp_path / "checkpoint")).awaitTermination()
    totals = store.read("batches").agg(F.sum("accepted"), F.sum("rejected")).first()
    assert tuple(totals) == (40, 2) and store.read("records").select("sys_ingested_at").distinct().count() == 40
    once = paths.walk(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "record_key long, raw string").select("record_key", F.parse_json("raw").alias("v")))
    general = once.withColumn("path", F.regexp_replace("path", r"\[[0-9]+\]", "[]")).select("record_key", "path", "type").distinct()
    want = {(r.path, r.type): r["count"] for r in general.groupBy("path", "type").count().collect()}
    assert {(r.path, r.type): r.n for r in store.read("counts").collect()} == want
    placed = {r.path: r.backend for r in ingest.placements(store).collect()}
    assert placed["username"] == "Both" and placed["orders"] == "MongoDB" and placed["timestamp"] == "SQL"


def test_small_functions(spark):
    row = spark.sql("select 1").select(shortened(F.lit("abcdefgh"), 6).alias("s"), duration(F.lit(93780)).alias("d"), duration(F.lit(59)).alias("m")).first()
    assert tuple(row) == ("abc...", "1d 2h 3m", "0m")


def batch_of(spark, records, batch=None):
    raw = spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in records], "raw string")
    return raw.withColumn("v", F.try_parse_json("raw")).withColumn("rejected", F.col("v").isNull())


def test_ingest_routes_buffers_and_drains(spark, tmp_path):
    """Two records wait in the buffer; ten more place the field, move all values and keep the place from then on."""
    store = SnapshotStore(spark, str(tmp_path / "store"))
    ingest.ingest_batch(store, batch_of(spark, [{"username": "a", "stable_score": i} for i in range(2)]), 0)
    assert store.read("buffer").count() == 2 and store.read("values").count() == 0
    ingest.ingest_batch(store, batch_of(spark, [{"username": "a", "stable_score": i, "phone1": "x", "phone2": "y", "tags": ["new", "sale"], "orders": [{"item": "pen", "price": 1.5, "deep": {"z": 1}}, {"item": "ink", "price": 2.0}]} for i in range(10)] + ["{broken"]), 1)
    assert store.read("buffer").count() == 0 and store.read("values").where("path = 'stable_score' and backend = 'SQL'").count() == 12
    children = {(r.entity, r.item_index): json.loads(r.item) for r in store.read("children").collect()}
    assert children == {("norm_tags", 0): {"value": "new"}, ("norm_tags", 1): {"value": "sale"}, ("norm_phone", 0): {"value": "x"}, ("norm_phone", 1): {"value": "y"}, ("norm_orders", 0): {"item": "pen", "price": 1.5}, ("norm_orders", 1): {"item": "ink", "price": 2.0}}
    assert store.read("values").where("path like 'phone%'").count() == 0, "numbered scalars are no columns"
    ingest.ingest_batch(store, batch_of(spark, [{"username": "a", "stable_score": "text"} for i in range(30)]), 2)
    ingest.ingest_batch(store, batch_of(spark, [{"username": "b"}]), 2)
    assert {r.backend for r in store.read("placements").where("path = 'stable_score'").collect()} == {"SQL"}, "a field keeps its place"
    found = {r.metric: r.value for r in ingest.totals(store).collect()}
    assert [found[m] for m in ("records", "rejected", "batches", "buffered", "children", "referenced")] == [42, 1, 3, 0, 60, 0]


def test_ingest_strategies_and_hints(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    hints = spark.createDataFrame([("activity_log", (True, False, True, None))], f"path string, hint struct<{ingest.HINT.replace(' ', ':')}>".replace(",:", ", "))
    ingest.ingest_batch(store, batch_of(spark, [{"username": "a", "activity_log": [{"x": 1}, {"x": 2}], "prefs": {"a": 1, "b": 2}, "many": list(range(11))}]), 0, hints)
    got = {r.path: (r.score, r.mode, list(r.reasons)) for r in store.read("strategies").collect()}
    assert got["activity_log"] == (4, "reference", ["array_of_objects", "schema_hint_frequently_updated", "schema_hint_unbounded"])
    assert got["prefs"] == (0, "embed", []) and got["many"][1] == "reference"
    rows = [(r.entity_path, r.item_index, r.payload) for r in store.read("references").where("entity_path = 'activity_log'").orderBy("item_index").collect()]
    assert rows == [("activity_log", 0, '{"x":1}'), ("activity_log", 1, '{"x":2}')]


def test_ingest_appends_only_the_batch(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    raws = [json.loads(r.raw) for r in events.generate(spark, 60).collect()]
    for k in range(3):
        ingest.ingest_batch(store, batch_of(spark, raws), k)
    sizes = [sum(f.stat().st_size for f in (tmp_path / "store" / folder).rglob("*.parquet")) for folder in store.manifest()["records"]]
    assert len(sizes) == 3 and max(sizes) < 1.2 * min(sizes) and store.read("records").count() == 180
    assert not (tmp_path / "store" / "data" / "scratch").exists() or not list((tmp_path / "store" / "data" / "scratch").iterdir())


def test_requests_on_an_ingested_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    ingest.ingest_batch(store, batch_of(spark, [{"username": f"user{i}", "profile": {"bio": f"b{i}"}, "orders": [{"item": "pen"}, {"item": f"i{i}"}]} for i in range(4)]), 0)
    answer = requests.execute(store, {"operation": "read", "fields": ["profile.bio", "orders"], "filters": {"username": "user2"}})
    row = answer["data"].first()
    assert (row["profile.bio"], [json.loads(x) for x in row.orders], row.username) == ("b2", [{"item": "pen"}, {"item": "i2"}], "user2")
    assert requests.execute(store, {"operation": "read", "fields": ["nope"]})["error"] == "Fields do not exist: nope"
    assert requests.execute(store, {"operation": "read", "filters": {"profile.bio": "b1"}})["data"].count() == 1
    assert requests.execute(store, {"operation": "delete", "entity": "orders", "filters": {"parent_sys_ingested_at": row.sys_ingested_at}})["deleted"] == 2
    assert (store.read("records").count(), store.read("children").count()) == (4, 6), "an entity's rows go, its record stays"
    assert "Unknown entity" in requests.execute(store, {"operation": "delete", "entity": "nope", "filters": {"username": "user1"}})["error"]


def test_requests_fail_without_a_trace(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    requests.execute(store, {"operation": "insert", "data": [{"sys_ingested_at": "k", "username": "u", "age": 3, "_secret": 1, "odd name": 2}]})
    assert set(store.read("records").columns) == {"age", "odd_name", "sys_ingested_at", "username"}
    answer = requests.execute(store, {"operation": "insert", "data": [{"sys_ingested_at": "l", "username": "v", "age": "not_a_number"}]})
    assert not answer["success"] and "Type conflict for 'age'" in answer["error"] and store.read("records").count() == 1
    assert not requests.execute(store, {"operation": "update", "filters": {"username": "u"}, "data": {"age": "x"}})["success"]
    assert store.version() == 1 and len(list((tmp_path / "store" / "data" / "records").iterdir())) == 1


def test_ranks_pages_and_running_counts(spark, monkeypatch):
    monkeypatch.setattr(reports, "VALUES_PER_RANGE", 3)
    monkeypatch.setattr(profile, "RECORDS_PER_BLOCK", 5)
    rows = spark.createDataFrame([(i % 2, float((i * 37) % 23)) for i in range(50)] + [(2, 1.0), (3, None)], "g int, v double")
    got = {r.g: r.p95 for r in reports.timings(rows, "g", "v").collect()}
    for g in (0, 1):
        values = sorted(float((i * 37) % 23) for i in range(50) if i % 2 == g)
        assert got[g] == values[max(1, int(len(values) * 0.95)) - 1]
    assert (got[2], got[3]) == (1.0, None)
    keys = spark.range(30).select(F.col("id").alias("k"))
    assert [(r.k, r.has_more) for r in reports.page(keys, ["k"], 5, 24).collect()] == [(k, True) for k in range(24, 29)]
    assert [(r.k, r.has_more) for r in reports.page(keys, ["k"], 5, after=(26,)).collect()] == [(k, False) for k in range(27, 30)]
    nodes = spark.createDataFrame([("p" if i % 3 else "q", i) for i in range(1, 40)], "path string, seq long")
    assert all(r.so_far == sum(1 for i in range(1, r.seq + 1) if ("p" if i % 3 else "q") == r.path) for r in profile.running(nodes).collect())


def test_ranks_of_uneven_values(spark, monkeypatch):
    """Heavy tails, ties and one far value: of a large group only what is near the rank is sorted."""
    monkeypatch.setattr(reports, "VALUES_PER_RANGE", 100)
    n = 20_000
    rows = spark.range(n).select((F.col("id") % 2).alias("g"), F.when(F.col("id") == 7, 1e9).when(F.col("id") % 2 == 0, F.floor(F.col("id") / 4) % 50).otherwise(F.pow(F.lit(1.001), F.col("id"))).cast("double").alias("v"))
    values = {}
    for r in rows.collect():
        values.setdefault(r.g, []).append(r.v)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r["at"] for r in reports.at_rank(rows, "g", "v", share).collect()}
        assert got == {g: sorted(v)[max(1, int(len(v) * share)) - 1] for g, v in values.items()}
