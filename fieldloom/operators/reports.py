"""Rollups for inspection: coverage, history, timings, top observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(stats: DataFrame) -> DataFrame:
    """(path, coverage, cardinality): share of records that have a field, and whether it is required or optional."""
    share = F.round("frequency", 1)
    return stats.select("path", share.alias("coverage"), F.when(share < 100, "optional").otherwise("required").alias("cardinality"))


#: Sketches are off by one row in this many at most, and some four times as many rows of a group are sorted.
VALUES_PER_RANGE = 50_000


def at_rank(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, at): the value at 1-based rank max(1, int(share n)) of each group's sorted values.

    Quantile sketches, merged over all tasks, give two bounds close around the rank, whatever the values look like; rows below
    them are only counted, and just those between are sorted. A sketch is off by one row in VALUES_PER_RANGE at most, so only
    in a group with few rows can its bounds miss the rank, and there all values are sorted.
    """
    counted = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("_v"))
    off = 2.0 / VALUES_PER_RANGE
    around = F.percentile_approx("_v", [max(0.0, share - off), min(1.0, share + off)], VALUES_PER_RANGE)
    bounds = counted.groupBy(by).agg(around.alias("_bounds"), F.count("*").alias("_n"))
    bounds = bounds.select(F.col(by).alias("_by"), F.col("_bounds")[0].alias("_low"), F.col("_bounds")[1].alias("_high"), F.greatest(F.lit(1), F.floor(F.col("_n") * share)).alias("_rank"))
    joined = counted.join(bounds, F.col(by).eqNullSafe(F.col("_by")))
    sums = joined.groupBy("_by", "_low", "_high", "_rank").agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(F.col("_v") <= F.col("_high")).alias("_upto"))
    held = (F.col("_below") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))
    sums = sums.select(F.col("_by").alias("_of"), "_rank", F.when(held, F.col("_low")).alias("_from"), F.when(held, F.col("_high")).alias("_to"), F.when(held, F.col("_below")).otherwise(0).alias("_before"))
    between = counted.join(sums, F.col(by).eqNullSafe(F.col("_of"))).where(F.col("_from").isNull() | ((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))))
    values = between.groupBy(by, "_v", "_rank", "_before").agg(F.count("*").alias("_times"))
    upto = F.col("_before") + F.sum("_times").over(Window.partitionBy(by).orderBy("_v"))
    return values.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_rank")).groupBy(by).agg(F.min("_v").alias("at"))


def timings(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, least, greatest and 95th-percentile value by group."""
    v = F.col(value)
    sums = rows.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("greatest"))
    return sums.join(at_rank(rows, by, value, 0.95).withColumnRenamed("at", "p95"), by, "left")


def history(rows: DataFrame, by: str, failed: Column, latency: str) -> DataFrame:
    """Runs, failures and mean latency by operation."""
    return rows.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(failed).alias("failures"), F.avg(latency).alias("mean_latency"))


def top(rows: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(k)


def page(rows: DataFrame, key: list[str], limit: int, offset: int = 0, after: tuple | None = None) -> DataFrame:
    """A page of rows in key order with has_more; the limit is held to 1..1000 and the offset to 0 or more.

    `after`, the key of the last row seen, goes on from there without sorting what was seen: use it for far pages. The page
    itself has one row more than shown, and tells by its number whether there are others.
    """
    limit, offset = min(max(int(limit), 1), 1000), max(int(offset), 0)
    if after is not None:
        rows = rows.where(F.struct(*key) > F.struct(*[F.lit(x).cast(rows.schema[k].dataType) for k, x in zip(key, after)]))
    ahead = rows.orderBy(*key).offset(offset).limit(limit + 1)
    nth, last = Window.orderBy(*key), Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = ahead.withColumn("_nth", F.row_number().over(nth)).withColumn("has_more", F.count("*").over(last) > limit)
    return marked.where(F.col("_nth") <= limit).drop("_nth")


def overhead(measured: DataFrame, value: str, baseline: str) -> DataFrame:
    """measured with overhead, in percent of the baseline column; null where that is 0 or null."""
    return measured.withColumn("overhead", F.try_divide(F.col(value) - F.col(baseline), F.col(baseline)) * 100)


def insert_counts(rows: DataFrame, valid: Column) -> DataFrame:
    """(inserted, failed, success): how many rows of a batch are valid, and whether all are; null counts as failed."""
    good = F.coalesce(F.count_if(valid), F.lit(0))
    return rows.agg(good.alias("inserted"), (F.count("*") - good).alias("failed")).withColumn("success", F.col("failed") == 0)
