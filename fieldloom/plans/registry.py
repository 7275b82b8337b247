"""Queries over the star-schema tables, each applying an operator of the engine, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.predicates import predicate
from fieldloom.functions.types import detect_type, identifier, iso_time, numbered_name, sql_type, string_type
from fieldloom.operators import catalog, nesting, paths, placement, profile, reports
from fieldloom.plans import control, layout, logical, requests
from fieldloom.sources import events
from fieldloom.sources.store import scratch_store
from fieldloom.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str, filters: dict) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.where(predicate(filters, {c: F.col(c) for c in rows.columns})).select("c_custkey", "c_name", "c_mktsegment")


CUSTOMER = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE "


@query("SELECT o.o_orderkey, c.c_name AS username, count(l.l_orderkey) AS n_items, round(coalesce(sum(l.l_quantity), 0), 2) AS quantity FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def logical_records(spark, sf_dir):
    """Roots merged from two parts, with their children nested: the logical record view."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    names = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_name").alias("username"))
    lines = nesting.number_items(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    view = nesting.nest(nesting.merge_roots(orders, names, "o_orderkey"), lines, "o_orderkey", "l_orderkey", "lines")
    quantity = F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2)
    return view.select("o_orderkey", "username", F.size("lines").cast("long").alias("n_items"), quantity.alias("quantity"))


@query(CUSTOMER + "c_mktsegment = 'HOUSEHOLD'")
def read_filter_eq(spark, sf_dir):
    return customers(spark, sf_dir, {"c_mktsegment": "HOUSEHOLD"})


@query(CUSTOMER + "c_mktsegment IN ('HOUSEHOLD', 'BUILDING')")
def read_filter_in(spark, sf_dir):
    return customers(spark, sf_dir, {"c_mktsegment": {"$in": ["HOUSEHOLD", "BUILDING"]}})


@query(CUSTOMER + "false")
def read_filter_in_empty(spark, sf_dir):
    return customers(spark, sf_dir, {"c_mktsegment": {"$in": []}})


@query(CUSTOMER + "starts_with(lower(c_name), 'customer#00000001')")
def read_starts_with(spark, sf_dir):
    return customers(spark, sf_dir, {"c_name": {"$starts_with": "Customer#00000001"}})


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RE')")
def read_regex(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.where(predicate({"p_name": {"$regex": "RE", "$options": "i"}}, {"p_name": F.col("p_name")})).select("p_partkey", "p_name")


@query(CUSTOMER + "c_mktsegment = 'MACHINERY' AND c_acctbal > 100 AND c_nationkey <= 12 AND c_name IS NOT NULL")
def read_conjunction(spark, sf_dir):
    return customers(spark, sf_dir, {"c_mktsegment": "MACHINERY", "c_acctbal": {"$gt": 100}, "c_nationkey": {"$lte": 12}, "c_name": {"$exists": True}})


@query("SELECT c_name AS username, c_custkey AS sys_ingested_at, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20")
def read_request(spark, sf_dir):
    view = table(spark, sf_dir, "customer").withColumnsRenamed({"c_name": "username", "c_custkey": "sys_ingested_at"})
    return requests.read(view, {"operation": "read", "fields": ["username", "c_acctbal"], "filters": {"c_mktsegment": "BUILDING"}, "limit": 20})


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) > 60 AS has_more FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def read_page(spark, sf_dir):
    return reports.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 20, 40)


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END, o.t) AS amount, coalesce(o.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS t, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def root_merge_precedence(spark, sf_dir):
    """A column wins over the same field of the document; the document fills the gaps."""
    part = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("amount"))
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("amount"), F.count("*").alias("n"))
    merged = nesting.merge_roots(part, docs, "c_custkey").join(part.select("c_custkey"), "c_custkey", "left_semi")
    return merged.select("c_custkey", "amount", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l_orderkey AS parent, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS item_index, l_partkey AS partkey, l_quantity AS quantity FROM lineitem")
def normalize_roundtrip(spark, sf_dir):
    """Line items packed into one JSON record an order, and taken apart into child rows again."""
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    packed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    records = packed.select(F.col("l_orderkey").alias("record_key"), F.parse_json(F.to_json(F.struct("items"))).alias("v"))
    child = nesting.normalize(records, "items", {"l_partkey": "bigint", "l_quantity": "double"})
    return child.select(F.col("parent_sys_ingested_at").alias("parent"), F.col("item_index").cast("long").alias("item_index"), F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_unmapped(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    left = nesting.without_parents(table(spark, sf_dir, "lineitem"), gone, "l_orderkey", "o_orderkey")
    return left.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


TYPED = """CASE WHEN x = '' THEN 'string' WHEN regexp_matches(x, '\\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\\z') THEN 'uuid'
 WHEN regexp_matches(x, '\\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}\\z') THEN 'email' WHEN regexp_matches(x, '\\Ahttps?://[^\\s]+\\z') THEN 'url'
 WHEN regexp_matches(x, '\\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}') THEN 'timestamp' ELSE 'string' END"""


@query(f"SELECT detected, count(*) AS n FROM (SELECT {TYPED} AS detected FROM (SELECT url AS x FROM pages UNION ALL SELECT c_name FROM customer UNION ALL SELECT c_name || '@example.com' FROM customer UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders)) GROUP BY 1")
def detect_type_strings(spark, sf_dir):
    names = table(spark, sf_dir, "customer")
    parts = [table(spark, sf_dir, "pages").select(F.col("url").alias("x")), names.select("c_name"), names.select(F.concat("c_name", F.lit("@example.com"))), table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.select(string_type(F.col("x")).alias("detected")).groupBy("detected").agg(F.count("*").alias("n"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON records: user_id is a string in three of ten records and value lacks in every fifth."""
    e = table(spark, sf_dir, "events")
    user = F.when(F.col("event_id") % 10 < 3, F.concat(F.lit('"'), "user_id", F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    value = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "value": '), F.col("value").cast("string")))
    raw = F.concat(F.lit('{"event_type": "'), "event_type", F.lit('", "user_id": '), user, value, F.lit(', "tags": [1, "a"], "props": '), "props", F.lit("}"))
    return e.select(F.col("event_id").alias("record_key"), F.parse_json(raw).alias("v"))


NODES = """SELECT event_id, 'event_type' AS path, 'string' AS type FROM events UNION ALL SELECT event_id, 'user_id', CASE WHEN event_id % 10 < 3 THEN 'string' ELSE 'integer' END FROM events
 UNION ALL SELECT event_id, 'value', 'float' FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, 'tags', 'list' FROM events UNION ALL SELECT event_id, 'tags[0]', 'integer' FROM events UNION ALL SELECT event_id, 'tags[1]', 'string' FROM events
 UNION ALL SELECT event_id, 'props', 'dict' FROM events UNION ALL SELECT event_id, 'props.k', 'integer' FROM events"""


@query(f"SELECT path, type, count(*) AS n FROM ({NODES}) GROUP BY ALL")
def path_walk(spark, sf_dir):
    return paths.walk(event_records(spark, sf_dir), 2).groupBy("path", "type").agg(F.count("*").alias("n"))


PROFILED = NODES.replace("SELECT event_id, 'tags[0]', 'integer'", "SELECT event_id, 'tags[]', 'mixed'").replace(" UNION ALL SELECT event_id, 'tags[1]', 'string' FROM events", "")
STATS = f"""WITH c AS (SELECT path, type, count(*) AS n FROM ({PROFILED}) GROUP BY ALL), t AS (SELECT count(*) AS total FROM events),
 s AS (SELECT path, sum(n)::BIGINT AS appearances, max(n) AS top, arg_max(type, n) AS dominant_type FROM c GROUP BY 1),
 f AS (SELECT path, appearances, dominant_type, 100.0 * appearances / total AS frequency, 100.0 * top / appearances AS stability, 1 - 1.0 * top / appearances AS drift, 1 - 1.0 * appearances / total AS null_ratio FROM s, t)"""


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = event_records(spark, sf_dir).withColumnRenamed("record_key", "seq")
    return profile.field_stats(profile.record_counts(records, 2), table(spark, sf_dir, "events").count())


@query(STATS + " SELECT path, appearances, dominant_type, round(frequency, 4) AS frequency, round(stability, 4) AS stability, round(drift, 6) AS drift, round(null_ratio, 6) AS null_ratio FROM f")
def field_profile(spark, sf_dir):
    s = event_stats(spark, sf_dir)
    return s.select("path", "appearances", "dominant_type", F.round("frequency", 4).alias("frequency"), F.round("stability", 4).alias("stability"), F.round("drift", 6).alias("drift"), F.round("null_ratio", 6).alias("null_ratio"))


@query(STATS + """ SELECT path, CASE WHEN dominant_type IN ('dict', 'list') THEN 'MongoDB' WHEN appearances < 10 THEN 'Buffer' WHEN drift >= 0.1 THEN 'MongoDB' WHEN frequency >= 75 AND stability >= 70 THEN 'SQL' ELSE 'MongoDB' END AS backend,
 dominant_type NOT IN ('dict', 'list') AND appearances >= 10 AND drift >= 0.25 AS quarantined, round((least(frequency / 80, 1) + stability / 100) / 3, 4) AS confidence FROM f""")
def placement_rules(spark, sf_dir):
    placed = placement.place(event_stats(spark, sf_dir))
    return placed.select("path", "backend", "quarantined", F.round("confidence", 4).alias("confidence"))


@query(STATS + """ SELECT backend, count(*) AS n_fields, string_agg(path, ',' ORDER BY path) AS fields FROM (SELECT path, CASE WHEN dominant_type IN ('dict', 'list') OR drift >= 0.1 THEN 'MongoDB' ELSE 'SQL' END AS backend FROM f) GROUP BY 1""")
def placement_by_backend(spark, sf_dir):
    return placement.by_backend(placement.place(event_stats(spark, sf_dir)))


@query(STATS + " SELECT path, round(frequency, 1) AS coverage, CASE WHEN round(frequency, 1) < 100 THEN 'optional' ELSE 'required' END AS cardinality FROM f")
def field_coverage(spark, sf_dir):
    return reports.coverage(event_stats(spark, sf_dir))


@query("SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS so_far, round(100.0 * count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) / (event_id + 1), 6) AS share FROM events")
def placement_running(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("path"), (F.col("event_id") + 1).alias("seq"))
    return profile.running(rows).select("event_id", F.col("path").alias("event_type"), "so_far", F.round("share", 6).alias("share"))


@query("SELECT mode, score, reasons, count(*) AS n FROM (SELECT CASE WHEN n > 3 THEN 'reference' ELSE 'embed' END AS mode, CASE WHEN n > 10 THEN 3 WHEN n > 3 THEN 2 ELSE 1 END AS score, CASE WHEN n > 10 THEN 'array_size_gt_10,array_of_objects' WHEN n > 3 THEN 'array_size_gt_3,array_of_objects' ELSE 'array_of_objects' END AS reasons FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)) GROUP BY ALL")
def reference_score(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    score, reasons = nesting.reference_score(F.col("n"), F.lit(True), F.lit(None).cast("int"), F.lit(1), F.lit(False))
    return sizes.select(nesting.mode(score).alias("mode"), score.alias("score"), F.array_join(reasons, ",").alias("reasons")).groupBy("mode", "score", "reasons").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS record_key, 'm' AS base, 'm1,m2,m10' AS names, CAST(c_nationkey AS VARCHAR) || ',' || CAST(c_custkey AS VARCHAR) || ',' || c_mktsegment AS texts FROM customer")
def scalar_groups(spark, sf_dir):
    """Numbered scalars of a record form one list, in numeric order."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_key"), F.parse_json(F.to_json(F.struct(F.col("c_mktsegment").alias("m10"), F.col("c_custkey").alias("m2"), F.col("c_nationkey").alias("m1"), F.col("c_name").alias("name1")))).alias("v"))
    groups = paths.scalar_groups(paths.walk(rows, 1))
    return groups.select("record_key", "base", F.array_join("names", ",").alias("names"), F.array_join("texts", ",").alias("texts"))


@query("SELECT path, kind, count(*) AS n, sum(n_items)::BIGINT AS items FROM (SELECT 'lines' AS path, 'entity' AS kind, l_orderkey, count(*) AS n_items FROM lineitem GROUP BY l_orderkey UNION ALL SELECT 'parts', 'primitive', l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey) GROUP BY ALL")
def repeating_groups(spark, sf_dir):
    packed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("lines"), F.collect_list("l_partkey").alias("parts"))
    records = packed.select(F.col("l_orderkey").alias("record_key"), F.parse_json(F.to_json(F.struct("lines", "parts"))).alias("v"))
    found = paths.repeating(paths.walk(records, 2))
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"), F.sum("n_items").alias("items"))


@query("SELECT path, place, text FROM (SELECT event_type AS path, user_id::VARCHAR AS text, row_number() OVER (PARTITION BY event_type ORDER BY min(event_id), user_id::VARCHAR) AS place FROM events GROUP BY event_type, user_id) WHERE place <= 8")
def sample_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("text"), F.col("event_id").alias("seq"))
    return profile.samples(rows).withColumn("place", F.col("place").cast("long"))


@query("SELECT 'orders' AS entity, count(*) AS instances, 6 AS n_fields FROM orders UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL SELECT 'customer', count(*), 5 FROM customer")
def entity_catalog(spark, sf_dir):
    parts = [(n, table(spark, sf_dir, n)) for n in ("orders", "lineitem", "customer")]
    rows = [t.agg(F.count("*").alias("instances")).select(F.lit(n).alias("entity"), "instances", F.lit(len(t.columns)).alias("n_fields")) for n, t in parts]
    return rows[0].union(rows[1]).union(rows[2])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_copy_on_write(spark, sf_dir):
    store = scratch_store(spark)
    change = store.begin()
    change.insert("customer", table(spark, sf_dir, "customer"), "c_custkey")
    change.commit()
    change = store.begin()
    change.update("customer", F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.lit(0.0)})
    change.commit()
    return store.read("customer").select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders WHERE o_orderstatus <> 'F'")
def delete_copy_on_write(spark, sf_dir):
    store = scratch_store(spark)
    change = store.begin()
    change.insert("orders", table(spark, sf_dir, "orders"), "o_orderkey")
    change.insert("lineitem", table(spark, sf_dir, "lineitem"))
    change.commit()
    change = store.begin()
    change.delete("orders", F.col("o_orderstatus") == "F", "o_orderkey", {"lineitem": "l_orderkey"})
    change.commit()
    lines = store.read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return store.read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("SELECT backend, count(*) AS n FROM (SELECT CASE path WHEN 'user_id' THEN 'MongoDB' WHEN 'event_type' THEN 'SQL' WHEN 'value' THEN 'SQL' WHEN 'props.k' THEN 'SQL' WHEN 'tags[]' THEN 'SQL' END AS backend FROM (" + PROFILED + ") WHERE type NOT IN ('dict', 'list')) GROUP BY 1")
def buffer_drain(spark, sf_dir):
    """Buffered scalars move to the backend of their field once it is placed."""
    nodes = paths.walk(event_records(spark, sf_dir), 2).where(~F.col("type").isin("dict", "list"))
    nodes = nodes.select("record_key", F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("path")).distinct()
    routed, _ = ingest.drain(nodes, placement.place(event_stats(spark, sf_dir)))
    return routed.groupBy("backend").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS greatest, list_sort(list(value))[greatest(1, floor(count(*) * 0.95)::INT)] AS p95 FROM events GROUP BY 1")
def latency_ranks(spark, sf_dir):
    return reports.timings(table(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", F.round("mean", 4))


@query("SELECT event_type, count(*) AS runs, count(*) FILTER (value > 90) AS failures, round(avg(value), 4) AS mean_latency FROM events GROUP BY 1")
def history_stats(spark, sf_dir):
    return reports.history(table(spark, sf_dir, "events"), "event_type", F.col("value") > 90, "value").withColumn("mean_latency", F.round("mean_latency", 4))


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 10")
def top_observed(spark, sf_dir):
    return reports.top(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n", 10, "user_id")


@query("SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g') AS name, CASE WHEN p_size > 25 THEN 'REAL' ELSE 'TEXT' END AS column_type, regexp_extract(p_brand || p_size::VARCHAR, '^([A-Za-z_][A-Za-z0-9_]*?)([0-9]+)$', 2) AS number FROM part")
def names_and_types(spark, sf_dir):
    number = numbered_name(F.concat("p_brand", F.col("p_size").cast("string")))[1]
    return table(spark, sf_dir, "part").select("p_partkey", identifier(F.col("p_type")).alias("name"), sql_type(F.when(F.col("p_size") > 25, "float").otherwise("string")).alias("column_type"), number.alias("number"))


@query("SELECT type, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 2 THEN 'integer' WHEN 3 THEN 'float' WHEN 4 THEN 'list' ELSE 'dict' END AS type FROM events) GROUP BY 1")
def detect_type_json(spark, sf_dir):
    texts = F.array(*map(F.lit, ["null", "true", "12345678901234567890", "1.0", "[1, 2]", '{"a": 1}']))
    return table(spark, sf_dir, "events").select(detect_type(F.parse_json(F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int")))).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_entries(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("SELECT 6::BIGINT AS version, '{\"entities\": {}}' AS schema_json")
def schema_versions(spark, sf_dir):
    known = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("version"), F.lit("{}").alias("schema_json"))
    return catalog.active_schema(catalog.register_schema(known, '{"entities": {}}'))


@query("SELECT n_name AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'whole' WHEN n_regionkey = 1 THEN 'part' END AS hint FROM nation")
def schema_hints(spark, sf_dir):
    """Hints by whole path for every second nation, by last segment for one region."""
    nations = table(spark, sf_dir, "nation")
    named = nations.select(F.concat(F.lit("a."), "n_name").alias("path"), "n_name", "n_nationkey", "n_regionkey")
    hints = named.where("n_nationkey % 2 = 0").select("path", F.lit("whole").alias("hint")).union(named.where("n_regionkey = 1").select("n_name", F.lit("part")))
    return catalog.with_hints(named.select("path"), hints).select(F.substring("path", 3, 100).alias("path"), "hint")


@query("SELECT l_returnflag AS name, count(DISTINCT l_linestatus) AS parents FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def shared_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", F.lit("["), "l_linenumber", F.lit("]."), "l_returnflag").alias("path"))
    return catalog.shared_entities(rows)


@query("SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN 'SQL' ELSE 'MongoDB' END AS backend, CASE WHEN c_custkey % 4 = 0 THEN 'final' ELSE 'auto_finalized' END AS status FROM customer")
def finalize_unmapped(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), "c_custkey")
    mapped = rows.where("c_custkey % 4 = 0").select("path", F.lit("SQL").alias("backend"), F.lit("final").alias("status"))
    return catalog.finalize_unmapped(rows, mapped)


@query("SELECT 'props' AS entity, 'k' AS column, count(*) AS appearances FROM events UNION ALL SELECT 'root', 'value', count(*) FILTER (event_id % 5 <> 0) FROM events UNION ALL SELECT 'root', 'nope', 0")
def column_stats(spark, sf_dir):
    columns = spark.createDataFrame([("props", "k"), ("root", "value"), ("root", "nope")], "entity string, column string")
    return catalog.column_stats(columns, event_stats(spark, sf_dir)).fillna(0)


@query("SELECT r_name AS name, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey), '') AS children FROM region UNION ALL SELECT n_name, '' FROM nation")
def linked_entities(spark, sf_dir):
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    below = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    return catalog.linked_entities(regions.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent")).union(below))


@query("SELECT c_custkey AS key, 'table' AS part FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'document' FROM customer WHERE c_custkey % 2 <> 0")
def union_new_names(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return catalog.union_by_name(keys.where("key % 2 = 0").withColumn("part", F.lit("table")), keys.withColumn("part", F.lit("document")), "key")


@query("SELECT user_id, count(*) AS records, date_diff('microsecond', min(ts), max(ts)) // 1000000 AS seconds FROM events GROUP BY 1")
def session_activity(spark, sf_dir):
    return catalog.sessions(table(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT (SELECT count(*) FROM events) AS accepted, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS rejected")
def parse_event_lines(spark, sf_dir):
    """Event lines: JSON after `data: ` is taken, broken JSON is rejected, other lines are no events."""
    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat(F.lit("data: "), "props").alias("value")).union(e.where("event_id % 7 = 0").select(F.lit("data: {broken"))).union(e.select(F.lit(": keep-alive")))
    return events.parse_events(lines).agg(F.count_if(~F.col("rejected")).alias("accepted"), F.count_if("rejected").alias("rejected"))


@query("SELECT count(*) AS records, sum((NOT b)::INT)::BIGINT AS accepted FROM (SELECT event_id % 10 = 3 AS b FROM events)")
def stream_ingest_total(spark, sf_dir):
    """Events as landing lines, ingested by a stream until none is left; every tenth is broken."""
    store = scratch_store(spark)
    e = table(spark, sf_dir, "events")
    e.select(F.when(F.col("event_id") % 10 == 3, "data: {").otherwise(F.concat(F.lit("data: "), "props")).alias("value")).write.text(f"{store.root}/landing")
    ingest.start(store, events.stream_landing(spark, f"{store.root}/landing"), f"{store.root}/checkpoint").awaitTermination()
    return store.read("batches").agg((F.sum("accepted") + F.sum("rejected")).alias("records"), F.sum("accepted").alias("accepted"))


def ingested(spark: SparkSession, records: DataFrame, batches: int = 2, schemas: tuple[dict, ...] = ()):
    """A new store with records (id, v VARIANT), ingested in batches by the remainder of their id; before each, a schema is registered."""
    store = scratch_store(spark)
    for k in range(batches):
        if k < len(schemas):
            control.register_schema(store, schemas[k])
        mine = records.where(F.pmod("id", F.lit(batches)) == k).select(F.to_json("v").alias("raw"), "v", F.lit(False).alias("rejected"))
        ingest.ingest_batch(store, mine, k)
    return store


def ingested_events(spark: SparkSession, sf_dir: str):
    return ingested(spark, event_records(spark, sf_dir).withColumnRenamed("record_key", "id"))


@query("SELECT path, CASE WHEN path = 'user_id' THEN 'MongoDB' ELSE 'SQL' END AS backend, count(*) AS n FROM (" + NODES + ") WHERE path IN ('event_type', 'user_id', 'value') GROUP BY ALL")
def ingest_values(spark, sf_dir):
    """Scalars of ingested records, routed by the place of their field."""
    return ingested_events(spark, sf_dir).read("values").groupBy("path", "backend").agg(F.count("*").alias("n"))


@query("SELECT 'norm_tags' AS entity, i AS item_index, CASE i WHEN 0 THEN '{\"value\":1}' ELSE '{\"value\":\"a\"}' END AS item, count(*) AS n FROM events, (VALUES (0), (1)) t(i) GROUP BY ALL")
def ingest_children(spark, sf_dir):
    """Child rows of the repeating groups of ingested records."""
    return ingested_events(spark, sf_dir).read("children").groupBy("entity", "item_index", "item").agg(F.count("*").alias("n"))


@query("""SELECT metric, value FROM (SELECT 'records' AS metric, count(*) AS value FROM events UNION ALL SELECT 'fields_sql', 4 UNION ALL SELECT 'fields_both', 0 UNION ALL SELECT 'fields_buffer', 0 UNION ALL SELECT 'embedded', 2
 UNION ALL SELECT 'buffered', 0 UNION ALL SELECT 'children', 2 * count(*) FROM events UNION ALL SELECT 'routed', 2 * count(*) + count(*) FILTER (event_id % 5 <> 0) FROM events)""")
def ingest_totals(spark, sf_dir):
    """Totals of an ingested store; typed columns for the event's type, its value, the tags' items and props.k."""
    return ingest.totals(ingested_events(spark, sf_dir)).where(F.col("metric").isin("records", "fields_sql", "fields_both", "fields_buffer", "embedded", "buffered", "children", "routed"))


@query("SELECT (props::JSON->>'k')::BIGINT AS k, count(*) AS n FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1")
def read_nested_field(spark, sf_dir):
    """A dotted path of ingested documents, by request."""
    kind = table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    answer = requests.execute(ingested_events(spark, sf_dir), {"operation": "read", "fields": ["props.k"], "filters": {"event_type": kind}, "limit": None})
    return answer["data"].groupBy(F.col("`props.k`").alias("k")).agg(F.count("*").alias("n"))


def ingested_orders(spark: SparkSession, sf_dir: str, *more, schemas: tuple[dict, ...] = ()):
    """Orders as records with their lines as a list, ingested; `more` are further columns of the records, schemas those of the batches."""
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", F.array(F.struct(F.col("l_suppkey").alias("key"))).alias("suppliers"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    record = F.struct(F.concat(F.lit("o"), "o_orderkey").alias("username"), F.col("o_orderstatus").alias("status"), "lines", *more)
    return ingested(spark, rows.select(F.col("o_orderkey").alias("id"), F.parse_json(F.to_json(record)).alias("v")), schemas=schemas)


@query("SELECT 'o' || o_orderkey AS username, count(l_orderkey) AS n, coalesce(sum(l_partkey), 0)::BIGINT AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def read_child_lists(spark, sf_dir):
    """A repeating group of ingested records, by request: the records that the filter holds for, with their items."""
    answer = requests.execute(ingested_orders(spark, sf_dir), {"operation": "read", "fields": ["lines"], "filters": {"status": "F"}, "limit": None})
    parts = F.expr("aggregate(lines, 0L, (a, x) -> a + cast(get_json_object(x, '$.l_partkey') as bigint))")
    return answer["data"].select("username", F.size("lines").cast("long").alias("n"), parts.alias("parts"))


def answered(store, request: dict) -> dict:
    answer = requests.execute(store, request)
    if not answer["success"]:
        raise RuntimeError(answer["error"])
    return answer


@query("SELECT 'o' || o_orderkey AS username, count(l_orderkey) AS n, coalesce(sum(l_suppkey), 0)::BIGINT AS suppliers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def read_nested_items(spark, sf_dir):
    """Lists of records by request, whole: items keep the lists within them, whether they stand in child rows or apart from the document."""
    data = answered(ingested_orders(spark, sf_dir), {"operation": "read", "fields": ["lines"], "limit": None})["data"]
    keys = F.expr("aggregate(lines, 0L, (a, x) -> a + cast(get_json_object(x, '$.suppliers[0].key') as bigint))")
    return data.select("username", F.size("lines").cast("long").alias("n"), keys.alias("suppliers"))


LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS r FROM lineitem"


@query(f"SELECT 'o' || o_orderkey AS username, max(CASE WHEN r = 1 THEN l_partkey END) AS first_part, max(CASE WHEN r = 2 THEN l_suppkey END) AS second_supplier, count(r) AS n, coalesce(round(sum(l_quantity)), 0)::BIGINT AS quantity FROM orders LEFT JOIN ({LINES}) ON l_orderkey = o_orderkey GROUP BY ALL")
def read_list_places(spark, sf_dir):
    """Places of lists, lists within these, and a field of every item, by request."""
    wanted = ["lines[0].l_partkey", "lines[1].suppliers[0].key", "lines.l_quantity"]
    store = ingested_orders(spark, sf_dir)
    parts = [answered(store, {"operation": "read", "fields": [f], "limit": None})["data"].select("username", F.col(f"`{f}`").alias(name)) for f, name in zip(wanted, ("first_part", "second_supplier", "all"))]
    both = parts[0].join(parts[1], "username").join(parts[2], "username")
    quantity = F.round(F.aggregate("all", F.lit(0.0), lambda a, x: a + x.cast("double"))).cast("long")
    return both.select("username", "first_part", "second_supplier", F.size("all").cast("long").alias("n"), quantity.alias("quantity"))


@query("SELECT 'o' || o_orderkey AS username, o_orderpriority AS priority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY ALL")
def read_nested_group(spark, sf_dir):
    """A repeating group within a dictionary, and a key that has a dot, by request."""
    deep = F.struct(F.struct(F.transform("lines", lambda x: F.struct(x["l_partkey"].alias("part"))).alias("b")).alias("post"), F.col("o_orderpriority").alias("we.ird"))
    store = ingested_orders(spark, sf_dir, deep["post"].alias("post"), F.col("o_orderpriority").alias("we.ird"))
    data = answered(store, {"operation": "read", "fields": ["post.b", "we.ird"], "filters": {"status": "O"}, "limit": None})["data"]
    return data.select("username", F.col("`we.ird`").alias("priority"), F.size("`post.b`").cast("long").alias("n"))


@query("SELECT 'o' || o_orderkey AS username, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' THEN 7 ELSE count(l_orderkey) END AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def update_ingested(spark, sf_dir):
    """An update of an ingested store by request, read back: a scalar and a list that has child rows and payloads."""
    store = ingested_orders(spark, sf_dir)
    answered(store, {"operation": "update", "filters": {"status": "F"}, "data": {"status": "done", "lines": [{"l_partkey": k} for k in range(7)]}})
    data = answered(store, {"operation": "read", "fields": ["status", "lines"], "limit": None})["data"]
    return data.select("username", "status", F.size("lines").cast("long").alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1)
 SELECT 'records' AS part, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'children', coalesce(sum(n), 0)::BIGINT FROM l UNION ALL SELECT 'references', coalesce(sum(n), 0)::BIGINT FROM l WHERE n > 3
 UNION ALL SELECT 'values', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'buffer', 0 UNION ALL SELECT 'deleted', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def delete_ingested(spark, sf_dir):
    """A deletion from an ingested store by request: what every part still has."""
    store = ingested_orders(spark, sf_dir)
    gone = answered(store, {"operation": "delete", "filters": {"status": "F"}})["deleted"]
    parts = [ingest.live(store, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name in ingest.OWNED]
    out = spark.range(1).select(F.lit("deleted").alias("part"), F.lit(gone).cast("long").alias("n"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query("SELECT n_name AS username, n_nationkey AS key, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 5")
def insert_ingested(spark, sf_dir):
    """Records inserted by request into a store of ingested customers, read back by filter."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.parse_json(F.to_json(F.struct(F.col("c_name").alias("username"), F.col("c_nationkey").alias("nation")))).alias("v"))
    store = ingested(spark, people, 1)
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "n_nationkey", "r_name").collect()
    answered(store, {"operation": "insert", "data": [{"username": r.n_name, "place": {"key": r.n_nationkey, "region": r.r_name}} for r in rows]})
    data = answered(store, {"operation": "read", "fields": ["place.key", "place.region"], "filters": {"place.key": {"$gte": 5}}, "limit": None})["data"]
    return data.select("username", F.col("`place.key`").alias("key"), F.col("`place.region`").alias("region"))


@query("SELECT l_partkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def typed_child_rows(spark, sf_dir):
    """The child table of a group, with a typed column for each scalar of its items."""
    rows = logical.child_table(ingested_orders(spark, sf_dir), "lines")
    return rows.groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT 'o' || o_orderkey AS username, o_orderstatus AS status, count(l_orderkey) AS n, coalesce(sum(l_partkey), 0)::BIGINT AS parts, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL")
def nested_typed_rows(spark, sf_dir):
    """Records with the typed rows of a group, laid out in buckets by parent and put together without a shuffle; some are deleted since."""
    store = ingested_orders(spark, sf_dir)
    layout.lay_out(store, 8)
    answered(store, {"operation": "delete", "filters": {"status": "P"}})
    rows = layout.nested(store, "lines", ["status"])
    parts = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["l_partkey"])
    quantity = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"])
    return rows.select("username", "status", F.size("items").cast("long").alias("n"), parts.alias("parts"), F.round(quantity, 2).alias("quantity"))


@query("""WITH f AS (SELECT c_custkey // 8 AS f, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT -1 - c_nationkey, count(*) FROM customer GROUP BY c_nationkey)
 SELECT 'records' AS metric, count(*) AS value FROM customer UNION ALL SELECT 'buffered', coalesce(sum(n), 0)::BIGINT FROM f WHERE n < 10 UNION ALL SELECT 'routed', coalesce(sum(n), 0)::BIGINT FROM f WHERE n >= 10 UNION ALL SELECT 'fields_buffer', count(*) FROM f WHERE n < 10""")
def buffered_totals(spark, sf_dir):
    """Totals, observed while two batches were written, of a store with fields that wait in the buffer and fields drained from it."""
    nation = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"), F.lit("x"))
    rare = F.concat(F.lit("rare_"), F.floor(F.col("c_custkey") / 8).cast("string"), F.lit("x"))
    raw = F.to_json(F.map_from_arrays(F.array(F.lit("username"), nation, rare), F.array("c_name", "c_mktsegment", "c_mktsegment")))
    store = ingested(spark, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.parse_json(raw).alias("v")))
    return ingest.totals(store).where(F.col("metric").isin("records", "buffered", "routed", "fields_buffer"))


@query("SELECT (event_id % 2) AS batch, count(*) AS n, sum(CASE WHEN event_id % 2 = 0 THEN 0 ELSE (SELECT count(*) FROM events WHERE event_id % 2 = 0) END)::BIGINT + count(*) * (count(*) - 1) // 2 AS total FROM events GROUP BY 1")
def ingest_numbers(spark, sf_dir):
    """The numbers of ingested records have no gaps and go on from batch to batch."""
    rows = ingested_events(spark, sf_dir).read("records").select(F.substring(F.regexp_extract("sys_ingested_at", r"\.([0-9]{8})\.[0-9]+$", 1), 1, 8).cast("int").alias("batch"), "seq")
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.sum("seq").alias("total"))


@query("SELECT 'records' AS entity, 'username' AS \"column\", 'string' AS type UNION ALL SELECT 'records', 'status', 'string' UNION ALL SELECT 'records', 'lines', 'list' UNION ALL SELECT 'lines', 'l_linenumber', 'integer' UNION ALL SELECT 'lines', 'l_partkey', 'integer' UNION ALL SELECT 'lines', 'l_quantity', 'integer'")
def describe_store(spark, sf_dir):
    """The logical schema of an ingested store: the root's fields, and the columns of each child table."""
    return logical.describe(ingested_orders(spark, sf_dir))


LISTS = "WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"


@query(f"{LISTS} SELECT (k % 2)::INT AS batch, n > 3 AS long, count(*) AS n, count(*) FILTER (n > 3 OR k % 2 = 1) AS referenced FROM l GROUP BY ALL")
def registered_schemas(spark, sf_dir):
    """Lists that are kept apart as the schema says that was active when they came; flags that are no booleans say nothing."""
    store = ingested_orders(spark, sf_dir, schemas=({"entities": {"lines": {"unbounded": "yes", "shared": 1}}}, {"entities": {"lines": {"expected_max_items": 11}}}))
    kept = store.read("references").select(F.col("parent_sys_ingested_at").alias("key")).distinct().withColumn("kept", F.lit(1))
    rows = store.read("children").groupBy(F.col("parent_sys_ingested_at").alias("key")).agg(F.count("*").alias("items")).join(kept, "key", "left")
    batch = F.regexp_extract("key", r"\.([0-9]{8})\.[0-9]+$", 1).cast("int")
    return rows.groupBy(batch.alias("batch"), (F.col("items") > 3).alias("long")).agg(F.count("*").alias("n"), F.count("kept").alias("referenced"))


@query(f"{LISTS} SELECT 'records' AS name, 'root' AS kind, '' AS path, count(*) AS instances FROM orders UNION ALL SELECT 'norm_lines', 'children', 'lines', coalesce(sum(n), 0)::BIGINT FROM l UNION ALL SELECT 'ref_lines', 'reference', 'lines', coalesce(sum(n), 0)::BIGINT FROM l WHERE n > 3")
def store_parts(spark, sf_dir):
    """The root, child tables and collections of an ingested store, with their rows."""
    return control.parts(ingested_orders(spark, sf_dir))


@query("SELECT least(count(*), 30) AS n, count(*) > 30 AS has_more, least(count(*), 30) AS users FROM orders WHERE ('o' || o_orderkey) LIKE 'o1%'")
def records_of_page(spark, sf_dir):
    """A page of records of users whose name begins so, and whether there are more."""
    page = control.records_page(ingested_orders(spark, sf_dir), limit=30, username="O1")
    return page.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("has_more"), F.lit(False)).alias("has_more"), F.count_distinct("username").alias("users"))


@query("SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS lines")
def delete_entity_rows(spark, sf_dir):
    """A delete that names an entity takes that entity's rows and leaves the records."""
    store = scratch_store(spark)
    change = store.begin()
    change.insert("orders", table(spark, sf_dir, "orders"), "o_orderkey")
    change.insert("lineitem", table(spark, sf_dir, "lineitem"))
    change.commit()
    answer = requests.execute(store, {"operation": "delete", "entity": "lineitem", "filters": {"l_returnflag": "R"}}, root="orders", key="o_orderkey", children={"lineitem": "l_orderkey"})
    if not answer["success"]:
        raise RuntimeError(answer["error"])
    both = store.read("orders").select(F.lit(1).alias("r"), F.lit(0).alias("l")).union(store.read("lineitem").select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("r").alias("records"), F.sum("l").alias("lines"))


@query("SELECT o_orderkey, epoch(o_orderdate::TIMESTAMP)::BIGINT - CASE o_orderkey % 3 WHEN 2 THEN 7200 ELSE 0 END AS seconds FROM orders")
def iso_times(spark, sf_dir):
    """ISO times without an offset, with Z and with +02:00."""
    plain = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    suffix = F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+02:00")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iso_time(F.concat(plain, suffix)).alias("seconds"))


@query("SELECT 'event_type' AS name, count(*) AS n, 0 AS lists FROM events UNION ALL SELECT 'user_id', count(*), 0 FROM events UNION ALL SELECT 'value', count(*), 0 FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT 'tags', count(*), count(*) FROM events UNION ALL SELECT 'props_k', count(*), 0 FROM events")
def flatten_fields(spark, sf_dir):
    """Nested records as flat names; lists stay JSON text."""
    flat = paths.flatten(paths.walk(event_records(spark, sf_dir)))
    return flat.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("text") == '[1,"a"]').alias("lists"))


@query("SELECT path, count(*) AS n, round(count(DISTINCT x) / count(*), 6) AS ratio, path <> 'segment' AND count(DISTINCT x) / count(*) > 0.9 AS candidate FROM (SELECT 'custkey' AS path, c_custkey::VARCHAR AS x FROM customer UNION ALL SELECT 'nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'segment', c_mktsegment FROM customer) GROUP BY path")
def unique_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    named = {"custkey": "c_custkey", "nationkey": "c_nationkey", "segment": "c_mktsegment"}
    pairs = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), F.col(c).cast("string").alias("text")) for path, c in named.items()]))
    return profile.uniqueness(rows.select(pairs.alias("x")).select("x.*")).withColumn("ratio", F.round("ratio", 6))


@query("SELECT o_orderkey AS record_key, 'items' AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'group' WHEN o_orderkey % 2 = 0 THEN 'array' ELSE 'entity' END AS items FROM orders")
def union_of_groups(spark, sf_dir):
    """Entities, arrays and numbered scalars of the same name: the last kind wins."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_key"), F.lit("items").alias("path"))
    kinds = [keys, keys.where("record_key % 2 = 0"), keys.where("record_key % 3 = 0")]
    return nesting.union_groups(*[part.withColumn("items", F.lit(kind)) for part, kind in zip(kinds, ("entity", "array", "group"))])


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority <> '1-URGENT')
 SELECT (SELECT count(*) FROM a) AS first, (SELECT count(*) FROM b) AS second, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_first, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_second,
 NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM b) AND NOT EXISTS (SELECT k FROM b EXCEPT SELECT k FROM a) AS consistent""")
def backend_consistency(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return catalog.consistency(orders.where("o_orderstatus <> 'F'"), orders.where("o_orderpriority <> '1-URGENT'"), "o_orderkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_occurrences(spark, sf_dir):
    return catalog.first_occurrence(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT count(*) FILTER (o_totalprice > 100000) AS inserted, count(*) FILTER (NOT o_totalprice > 100000) AS failed, count(*) FILTER (NOT o_totalprice > 100000) = 0 AS success FROM orders")
def insert_totals(spark, sf_dir):
    return reports.insert_counts(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000)


@query("SELECT event_type, count(*) AS n, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS base, round((count(*) - (SELECT count(*) FROM events WHERE event_id % 2 = 0)) / (SELECT count(*) FROM events WHERE event_id % 2 = 0) * 100, 6) AS overhead FROM events GROUP BY 1")
def overhead_by_type(spark, sf_dir):
    events_ = table(spark, sf_dir, "events")
    base = events_.where("event_id % 2 = 0").agg(F.count("*")).first()[0]
    counted = events_.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("base", F.lit(base).cast("long"))
    return reports.overhead(counted, "n", "base").withColumn("overhead", F.round("overhead", 6))


@query("SELECT p_name AS path, CASE WHEN p_partkey % 2 = 0 THEN 'SQL' END AS backend, CASE WHEN p_partkey % 3 = 0 THEN 'embed' END AS mode, CASE WHEN p_partkey % 5 = 0 THEN 'Both' END AS place FROM (SELECT p_partkey, p_name || p_partkey AS p_name FROM part)")
def field_lookup(spark, sf_dir):
    """What is registered of each field."""
    fields = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"))
    part = lambda n, name, x: fields.where(F.col("p_partkey") % n == 0).select("path", F.lit(x).alias(name))
    return catalog.lookup(fields, part(2, "backend", "SQL"), part(3, "mode", "embed"), part(5, "backend", "Both"))


@query("SELECT 'order' AS entity, count(*) AS instances, 2 AS field_count FROM orders UNION ALL SELECT 'line', count(*), 1 FROM lineitem UNION ALL SELECT 'none', 0, 1")
def entity_instances(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.lit("order").alias("entity")).union(table(spark, sf_dir, "lineitem").select(F.lit("line")))
    fields = spark.sql("SELECT * FROM VALUES ('order', 'status'), ('order', 'total'), ('order', 'total'), ('line', 'quantity'), ('none', 'x') AS t(entity, name)")
    return catalog.entity_catalog(items, fields)


@query("SELECT o_orderkey AS total_records, 2 AS version, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS placed FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 0, 2, 0 FROM orders WHERE o_orderkey % 3 = 0")
def metadata_upgrade(spark, sf_dir):
    """Metadata documents of older shapes, some of them broken, in the newest shape."""
    k = F.col("o_orderkey")
    placed = F.when(k % 2 == 0, F.lit(', "current_placement": {"age": "SQL"}')).otherwise("")
    text = F.when(k % 3 == 0, F.lit("broken {")).otherwise(F.concat(F.lit('{"total_records": '), k.cast("string"), placed, F.lit("}")))
    new = catalog.upgraded(table(spark, sf_dir, "orders").select(text.alias("text")))
    return new.select("total_records", "version", F.size("current_placement").alias("placed"))
