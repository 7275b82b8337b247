"""Repeating groups as child tables, their place in documents, and putting records together again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_items(rows: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """rows with item_index from 0 within each parent."""
    return rows.withColumn("item_index", F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1)


def normalize(records: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """Child rows (parent_sys_ingested_at, item_index, fields...) of the list at `path` in records (record_key, v VARIANT).

    `fields` has the type of each column; a list of scalars has the one field `value`.
    """
    items = records.select("record_key", F.posexplode(F.try_variant_get("v", f"$.{path}", "array<variant>")).alias("item_index", "item"))
    scalar = list(fields) == ["value"]
    columns = [F.try_variant_get("item", "$" if scalar else f"$.{name}", kind).alias(name) for name, kind in fields.items()]
    return items.select(F.col("record_key").alias("parent_sys_ingested_at"), "item_index", *columns)


def nest(roots: DataFrame, child: DataFrame, key: str, parent: str, name: str, keep_index: bool = False) -> DataFrame:
    """roots with the array `name` of their child rows, ordered by item_index; [] for roots without any.

    A semi-join first, so that only children of roots at hand are shuffled and collected.
    """
    fields = [c for c in child.columns if c != parent and (keep_index or c != "item_index")]
    near = child.join(roots.select(F.col(key).alias(parent)), parent, "left_semi")
    grouped = near.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct("item_index", *[c for c in child.columns if c not in (parent, "item_index")]))).alias(name))
    plain = F.transform(F.col(name), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    joined = roots.join(grouped.withColumn(name, plain).withColumnRenamed(parent, "_parent"), F.col(key) == F.col("_parent"), "left").drop("_parent")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def merge_roots(tables: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """One logical root of the column and the document part of each record; a column wins over a document's field."""
    shared = [c for c in tables.columns if c in documents.columns and c != key]
    right = documents.select(F.col(key), *[F.col(c).alias(f"_doc_{c}" if c in shared else c) for c in documents.columns if c != key])
    joined = tables.join(right, key, "full")
    for c in shared:
        joined = joined.withColumn(c, F.coalesce(c, f"_doc_{c}")).drop(f"_doc_{c}")
    return joined


def reference_score(n_items: Column, holds_objects: Column, n_keys: Column, depth: Column, shared: Column, hints: Column | None = None) -> tuple[Column, Column]:
    """Score and reasons for keeping a nested value in a collection of its own; at 2 it is referenced, below embedded.

    n_items is null for objects and n_keys null for lists; `hints` is a struct of frequently_updated, shared, unbounded
    (booleans) and expected_max_items, or None.
    """
    terms = [
        (n_items > 10, 2, "array_size_gt_10"),
        ((n_items > 3) & (n_items <= 10), 1, "array_size_gt_3"),
        (n_items.isNotNull() & holds_objects, 1, "array_of_objects"),
        (n_keys > 8, 2, "dict_field_count_gt_8"),
        ((n_keys > 5) & (n_keys <= 8), 1, "dict_field_count_gt_5"),
        (depth >= 3, 1, "deep_nesting"),
        (shared, 1, "likely_shared_entity"),
    ]
    if hints is not None:
        terms += [
            (hints["frequently_updated"], 1, "schema_hint_frequently_updated"),
            (hints["shared"], 1, "schema_hint_shared"),
            (hints["unbounded"], 2, "schema_hint_unbounded"),
            (hints["expected_max_items"] > 10, 1, "schema_hint_expected_max_items"),
        ]
    score = F.lit(0)
    for holds, weight, _ in terms:
        score = score + F.when(holds, weight).otherwise(0)
    return score, F.array_compact(F.array(*[F.when(holds, reason) for holds, _, reason in terms]))


def mode(score: Column) -> Column:
    return F.when(score >= 2, "reference").otherwise("embed")


def without_parents(child: DataFrame, deleted: DataFrame, parent: str, key: str) -> DataFrame:
    """Child rows whose parent is not among the deleted ones."""
    return child.join(deleted.select(F.col(key).alias(parent)), parent, "left_anti")


def union_groups(*parts: DataFrame) -> DataFrame:
    """Repeating groups (record_key, path, items) of several kinds together; a later part wins on an equal record and path."""
    ranked = [part.select("record_key", "path", "items").withColumn("_rank", F.lit(rank)) for rank, part in enumerate(parts)]
    return reduce(DataFrame.unionByName, ranked).groupBy("record_key", "path").agg(F.max_by("items", "_rank").alias("items"))
