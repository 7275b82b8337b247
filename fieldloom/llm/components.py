"""Connected components by least labels and pointer jumping; nothing but row counts reaches the driver.

A class of near copies has one label and one hub, which may be the key of a third of all rows. Lookups by such a key take the
few values of frequent keys by broadcast and spread their rows, so no task has a whole class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.storage import materialize, remove, written

#: A key is frequent with more than this share of all rows, so there are at most so many of them, but not with a few rows.
MOST_FREQUENT, FEW_ROWS = 1000, 256


def looked_up(rows: DataFrame, column: str, spread: str, table: DataFrame) -> DataFrame:
    """rows with `found` from table (key, found), whose keys are unique; null where there is none.

    rows is read several times and should be a written table. Rows of a frequent key are spread by the column `spread`; their
    values, MOST_FREQUENT rows at most, are broadcast.
    """
    least = max(FEW_ROWS, rows.count() // MOST_FREQUENT)
    frequent = rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("key")
    few = frequent.join(table, "key", "left").select(F.col("key").alias("_few"), F.col("found").alias("_value"))
    marked = rows.join(F.broadcast(few), F.col(column) == F.col("_few"), "left").withColumn("_spread", F.col("_few").isNotNull())
    marked = marked.withColumn("_at", F.when(F.col("_spread"), F.col(spread)).otherwise(F.col(column)))
    rest = table.select(F.col("key").alias("_at"), F.lit(False).alias("_spread"), "found")
    joined = marked.join(rest, ["_at", "_spread"], "left")
    return joined.select(*rows.columns, F.when(F.col("_spread"), F.col("_value")).otherwise(F.col("found")).alias("found"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is called after its least node.

    Each round takes the least label among the neighbours and then the label of that label, so that chains shrink
    by half or more; labels are written to the shared folder after each round, and those of the round before are removed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels, path = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        table = labels.select(F.col("node").alias("key"), F.col("component").alias("found"))
        near = looked_up(both, "b", "a", table).groupBy("a").agg(F.min("found").alias("near"))
        least = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        least, passing = written(least, "least")
        jumped = looked_up(least, "component", "node", table).select("node", "old", F.least("component", "found").alias("component"))
        before = path
        labels, path = written(jumped, "labels")
        remove(labels.sparkSession, before)
        remove(labels.sparkSession, passing)
        if labels.where("old <> component").isEmpty():
            return labels.select("node", "component")
