"""The control plane of an ingested store: registered schemas, strategies set by request, its catalog, and pages of records.

Entries are rows of small tables in the store's manifest, written by transactions, so that a reader sees a version's entries
with its data and the slower of two writers fails.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.predicates import RequestError
from fieldloom.functions.types import entity_name
from fieldloom.operators import catalog, reports
from fieldloom.operators.paths import is_top
from fieldloom.plans import fields as planner
from fieldloom.plans import logical
from fieldloom.sources.store import SnapshotStore
from fieldloom.streaming import ingest

MODES = ("embed", "reference")


def register_schema(store: SnapshotStore, schema: dict[str, Any]) -> int:
    """Make a schema the active one; its number. What is ingested from then on is judged with the hints of its `entities`."""
    if not isinstance(schema, dict):
        raise RequestError("A schema is a dictionary")
    change = store.begin()
    try:
        known = store.read("schemas", change.base) if "schemas" in change.held else None
        number = 1 + (known.agg(F.max("version")).first()[0] if known is not None else 0)
        row = [(number, datetime.now(UTC).isoformat(), json.dumps(schema))]
        change.append("schemas", store.spark.createDataFrame(row, "version long, registered_at string, schema_json string").coalesce(1))
        change.commit()
        return number
    except BaseException:
        change.abort()
        raise


def active_schema(store: SnapshotStore, version: int | None = None) -> dict[str, Any]:
    """The schema registered last; empty if there is none."""
    if "schemas" not in store.manifest(version):
        return {}
    return json.loads(catalog.active_schema(store.read("schemas", version)).first()["schema_json"])


def set_strategy(store: SnapshotStore, path: str, mode: str, reason: str = "set by request") -> None:
    """Register how a nested field is kept; the next record that has the field decides anew, as for all entries of this kind."""
    if mode not in MODES:
        raise RequestError(f"Unknown mode: {mode}; known: {', '.join(MODES)}")
    change = store.begin()
    try:
        seen = store.read("batches", change.base).agg(F.sum("accepted")).first()[0] if "batches" in change.held else 0
        row = store.spark.createDataFrame([(path, None, [reason], mode, (seen or 0) - 1)], "path string, score int, reasons array<string>, mode string, seq long")
        known = store.read("strategies", change.base) if "strategies" in change.held else row.limit(0)
        change.replace("strategies", known.where(F.col("path") != path).select(*row.columns).unionByName(row))
        change.commit()
    except BaseException:
        change.abort()
        raise


def parts(store: SnapshotStore, version: int | None = None) -> DataFrame:
    """(name, kind, path, instances): the root, child tables and collections of the store with the rows that each has by now.

    A group whose rows are all gone stays in the catalog with none.
    """
    counted = lambda table, column: ingest.live(store, table, version).groupBy(F.col(column).alias("path")).agg(F.count("*").alias("instances"))
    rows = counted("children", "path").withColumn("kind", F.lit("children")).unionByName(counted("references", "entity_path").withColumn("kind", F.lit("reference")))
    named = store.read("entities", version).join(rows, ["path", "kind"], "left")
    name = F.concat(F.when(F.col("kind") == "children", "norm_").otherwise("ref_"), entity_name(F.col("path")))
    root = ingest.live(store, "records", version).agg(F.count("*").alias("instances"))
    root = root.select(F.lit("records").alias("name"), F.lit("root").alias("kind"), F.lit("").alias("path"), "instances")
    return root.unionByName(named.select(name.alias("name"), "kind", "path", F.coalesce("instances", F.lit(0)).alias("instances")))


def placed_fields(store: SnapshotStore, version: int | None = None) -> list[str]:
    """First keys that have a place by now, or that an update has set; fields that wait in the buffer are not among them."""
    names = store.read("placements", version).where(is_top(F.col("path")) & (F.col("backend") != "Buffer")).select(planner.plain(F.col("path")).alias("path"))
    if "changes" in store.manifest(version):
        names = names.union(store.read("changes", version).where("not mark").select("path"))
    return sorted(r["path"] for r in names.distinct().collect() if r["path"] not in logical.CORE)


def records_page(store: SnapshotStore, limit: int = 100, offset: int = 0, username: str = "", after: str | None = None) -> DataFrame:
    """A page of records in key order with the core fields, all placed fields and has_more; of users whose name begins so.

    The limit is held to 1..1000. `after` is the key of the last record seen; it goes on from there without sorting what was
    seen, and is the way to far pages.
    """
    base = store.version()
    filters = {"username": {"$starts_with": username.strip()}} if username.strip() else None
    view = logical.logical_view(store, placed_fields(store, base), base, filters)
    return reports.page(view, [logical.KEY], limit, offset, None if after is None else (after,))
