"""Changes and deletions beside the tables they concern, merged when these are read.

An update writes a row for each record and field that it hits (record, path, value, change), a deletion a row for each record;
nothing else is rewritten. The newest change of a record's field holds, and rows derived from an older state of that field
(child rows, references, routed values) are dead, as is all that belongs to a deleted record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_deleted(rows: DataFrame, key: str, deleted: DataFrame | None) -> DataFrame:
    """rows whose record is not among the deleted (sys_ingested_at)."""
    return rows if deleted is None else rows.join(deleted.select(F.col("sys_ingested_at").alias(key)), key, "left_anti").select(*rows.columns)


def newest(changes: DataFrame) -> DataFrame:
    """(sys_ingested_at, path, change): the last change of each field that has any."""
    return changes.groupBy("sys_ingested_at", "path").agg(F.max("change").alias("change"))


def without_stale(rows: DataFrame, key: str, field, changes: DataFrame | None) -> DataFrame:
    """rows (with change) that no later change of their record's field has made stale; `field` is the column of its name."""
    if changes is None:
        return rows
    last = newest(changes).select(F.col("sys_ingested_at").alias("_key"), F.col("path").alias("_field"), F.col("change").alias("_last"))
    marked = rows.withColumn("_of", field)
    joined = marked.join(last, (F.col(key) == F.col("_key")) & (F.col("_of") == F.col("_field")), "left")
    return joined.where(F.coalesce("change", F.lit(0)) >= F.coalesce("_last", F.lit(0))).select(*rows.columns)


def changed_fields(changes: DataFrame, fields: list[str]) -> DataFrame:
    """One row a record with the newest value of each field: (sys_ingested_at, n0, c0, n1, c1, ...); n is null where none changed.

    One aggregation by record, with as many columns as fields are asked for; others are not read.
    """
    of = [F.when(F.col("path") == f, F.col("change")) for f in fields]
    parts = [x for i, c in enumerate(of) for x in (F.max(c).alias(f"n{i}"), F.max_by("value", c).alias(f"c{i}"))]
    return changes.where(F.col("path").isin(fields) & ~F.col("mark")).groupBy("sys_ingested_at").agg(*parts)
