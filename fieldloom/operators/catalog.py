"""The control plane as tables: last-writer-wins entries, schema versions, hints, entity links, field lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(entries: DataFrame, key: str, seq: str) -> DataFrame:
    """The newest entry of each key: an aggregation, so that old entries are dropped before the shuffle."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("e")).select(key, "e.*")


def register_schema(versions: DataFrame, schema_json: str) -> DataFrame:
    """versions (version, schema_json) with one more, numbered behind the greatest."""
    new = versions.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")).withColumn("schema_json", F.lit(schema_json))
    return versions.select("version", "schema_json").unionByName(new)


def active_schema(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max("version").alias("version"), F.max_by("schema_json", "version").alias("schema_json"))


def with_hints(entities: DataFrame, hints: DataFrame) -> DataFrame:
    """entities (path) with the hint of their whole path, else of its last segment; hints are (path, hint)."""
    last = F.element_at(F.split(F.regexp_replace("path", r"\[[0-9]+\]", ""), r"\."), -1)
    whole, part = hints.toDF("path", "_whole"), hints.toDF("_last", "_part")
    return entities.withColumn("_last", last).join(whole, "path", "left").join(part, "_last", "left").select(*entities.columns, F.coalesce("_whole", "_part").alias("hint"))


def entity_hints(schemas: DataFrame) -> DataFrame:
    """(path, hint) of schemas (schema_json): what their `entities` say of each path, if it is a dictionary.

    A flag holds only where it is `true`, and a number of items is taken only where it is whole.
    """
    entities = F.try_variant_get(F.try_parse_json("schema_json"), "$.entities", "map<string,variant>")
    rows = schemas.select(F.explode(F.map_entries(entities)).alias("e")).select("e.*").where(F.schema_of_variant("value").startswith("OBJECT"))
    of = lambda name, kind, cast: F.when(F.schema_of_variant(F.try_variant_get("value", f"$.{name}", "variant")) == kind, F.try_variant_get("value", f"$.{name}", cast))
    flags = [F.coalesce(of(name, "BOOLEAN", "boolean"), F.lit(False)).alias(name) for name in ("frequently_updated", "shared", "unbounded")]
    most = of("expected_max_items", "BIGINT", "long")
    items = F.when(most.isNotNull(), F.least(most, F.lit(2**31 - 1))).cast("int").alias("expected_max_items")
    return rows.select(F.col("key").alias("path"), F.struct(*flags, items).alias("hint"))


def shared_entities(nested: DataFrame) -> DataFrame:
    """(name, parents): names of nested values (path) that occur below more than one parent."""
    plain = F.regexp_replace("path", r"\[[0-9]+\]", "")
    rows = nested.select(F.element_at(F.split(plain, r"\."), -1).alias("name"), F.regexp_replace(plain, r"\.?[^.]*\z", "").alias("parent"))
    return rows.groupBy("name").agg(F.count_distinct("parent").alias("parents")).where("parents > 1")


def finalize_unmapped(observed: DataFrame, mapped: DataFrame) -> DataFrame:
    """mapped (path, backend, status) and every observed path that lacks there, sent to documents."""
    lacking = observed.select("path").distinct().join(mapped, "path", "left_anti")
    return mapped.select("path", "backend", "status").unionByName(lacking.select("path", F.lit("MongoDB").alias("backend"), F.lit("auto_finalized").alias("status")))


def column_stats(columns: DataFrame, stats: DataFrame) -> DataFrame:
    """columns (entity, column) with the statistics of `column`, else of `entity.column`, whether or not that is a list's."""
    of = stats.select(F.replace("path", F.lit("[]"), F.lit("")).alias("path"), "appearances").groupBy("path").agg(F.max("appearances").alias("appearances"))
    dotted = F.concat_ws(".", "entity", "column")
    own, full = of.toDF("_own", "_own_n"), of.toDF("_full", "_full_n")
    joined = columns.join(own, F.col("column") == F.col("_own"), "left").join(full, dotted == F.col("_full"), "left")
    return joined.select("entity", "column", F.coalesce("_own_n", "_full_n").alias("appearances"))


def linked_entities(entities: DataFrame) -> DataFrame:
    """(name, children): entities (name, parent) with the sorted names of those whose parent they are."""
    kids = entities.where("parent is not null").groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("children"))
    return entities.join(kids.withColumnRenamed("parent", "_parent"), F.col("name") == F.col("_parent"), "left").select("name", F.coalesce("children", F.lit("")).alias("children"))


def union_by_name(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """first, and the rows of second whose name is new."""
    return first.unionByName(second.join(first.select(name), name, "left_anti"))


def sessions(events: DataFrame, user: str, at: str) -> DataFrame:
    """(user, records, seconds): activity and span of each user."""
    return events.groupBy(user).agg(F.count("*").alias("records"), F.timestamp_diff("SECOND", F.min(at), F.max(at)).alias("seconds"))


def first_occurrence(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The row of each key with the least seq; an aggregation, so that later ones go before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("e")).select(*key, "e.*").select(*rows.columns)


def consistency(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(first, second, only_first, only_second, consistent): row counts of two copies and the keys that one of them lacks."""
    sides = first.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    keys = sides.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = keys.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("first"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("second"),
        F.count_if(F.col("b") == 0).alias("only_first"),
        F.count_if(F.col("a") == 0).alias("only_second"),
    )
    return sums.withColumn("consistent", (F.col("first") == F.col("second")) & (F.col("only_first") + F.col("only_second") == 0))


def lookup(fields: DataFrame, mappings: DataFrame, strategies: DataFrame, placed: DataFrame) -> DataFrame:
    """fields (path) with backend of the mapping, mode of the strategy, and place; null where nothing is registered."""
    out = fields.select("path").join(mappings.select("path", "backend"), "path", "left").join(strategies.select("path", "mode"), "path", "left")
    return out.join(placed.select("path", F.col("backend").alias("place")), "path", "left")


def entity_catalog(items: DataFrame, fields: DataFrame) -> DataFrame:
    """(entity, instances, field_count) of items (entity) and their fields (entity, name), whichever have rows."""
    counted = items.groupBy("entity").agg(F.count("*").alias("instances"))
    named = fields.groupBy("entity").agg(F.count_distinct("name").alias("field_count"))
    return counted.join(named, "entity", "full").select("entity", F.coalesce("instances", F.lit(0)).alias("instances"), F.coalesce("field_count", F.lit(0)).alias("field_count"))


#: Sections of a metadata document with their types; a document that lacks one gets its default.
METADATA = {"fields": "map<string,string>", "placement_decisions": "map<string,string>", "current_placement": "map<string,string>", "field_mappings": "map<string,string>", "total_records": "bigint", "session_start": "string", "last_updated": "string"}


def upgraded(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row a metadata document (JSON text) in its newest shape, version 2: lacking sections are empty, lacking counters 0.

    Text that is no JSON gives a fresh document.
    """
    parsed = documents.select(F.from_json(F.col(text), ", ".join(f"{name} {kind}" for name, kind in METADATA.items())).alias("m"))
    default = lambda kind: F.lit(0) if kind == "bigint" else F.create_map().cast(kind)
    columns = [F.col(f"m.{name}").alias(name) if kind == "string" else F.coalesce(f"m.{name}", default(kind)).alias(name) for name, kind in METADATA.items()]
    return parsed.select(F.lit(2).alias("version"), *columns)
