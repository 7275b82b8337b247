"""Dense numbers over a distributed table, in two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id that count rows within a partition.
ROW_BITS = 33


def numbered(rows: DataFrame, number: str, name: str, first: int = 0) -> DataFrame:
    """rows with `name`: first, first + 1, ... without gaps, in the order of `number`, a written monotonically_increasing_id.

    The rows of each partition are counted, and a partition starts behind the sum of those before it. That table has one row
    a partition, whatever the size of the data.
    """
    part = F.shiftright(number, ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before + first).alias("_start"))
    joined = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    within = F.col(number).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return joined.withColumn(name, F.col("_start") + within).drop("_part", "_start")
