"""Resharding by minimum-cost flow: from the bytes of old shards to new capacities, moving as few bytes as can be.

A layout keeps each shard's documents in blocks of consecutive slots, as folders `shard=/block=` of Parquet files. Within a
shard, large documents come first, so that what is moved, a shard's tail, consists of small ones and new sizes come out
near equal. The flow between old and new shards is solved on the driver over shard totals alone. It cuts each old shard into
consecutive segments, the kept one first; whole blocks of the kept segment stay as they are, files and slots, and only the
blocks from the first moved row on are written anew, without a shuffle. The old files stay for readers of the old layout.

Sizes are bytes of UTF-8 plus ROW_BYTES; a null text has none. Repeated rows and ids are documents of their own; an empty
table has empty shards. Extra columns, of whatever name, travel along in `doc`. A text longer than a shard's capacity makes
its shard larger than the others. `docs` is read twice and must give the same rows in the same order each time, as files do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.storage import new_path

ROW_BYTES = 8
#: Rows are numbered in groups of at most about this many, whatever share of all rows a shard has.
ROWS_PER_GROUP = 10_000
#: A shard has about this many blocks, the unit that is kept or written anew, but none below LEAST_BLOCK bytes.
BLOCKS_PER_SHARD, LEAST_BLOCK = 64, 256 << 10


def least_cost_flow(supplies: list[int], capacities: list[int], cost: np.ndarray) -> np.ndarray:
    """Bytes from each supply to each capacity that send everything at the least cost: successive shortest paths.

    Paths alternate between sending on and taking back; numpy relaxes all edges of a level at once.
    """
    left, room, flow = np.array(supplies, np.int64), np.array(capacities, np.int64), np.zeros((len(supplies), len(capacities)), np.int64)
    if left.sum() > room.sum():
        raise ValueError("the capacities are smaller than what is to be placed")
    while left.any():
        reach, by_source = np.where(left > 0, 0.0, np.inf), np.full(len(left), -1)
        dist, by_target = np.full(len(room), np.inf), np.full(len(room), -1)
        while True:
            through = reach[:, None] + cost
            nearer = through.min(0) < dist - 1e-9
            dist, by_target = np.where(nearer, through.min(0), dist), np.where(nearer, through.argmin(0), by_target)
            back = np.where(flow > 0, dist - cost, np.inf)
            better = back.min(1) < reach - 1e-9
            if not better.any():
                break
            reach, by_source = np.where(better, back.min(1), reach), np.where(better, back.argmin(1), by_source)
        j = int(np.where(room > 0, dist, np.inf).argmin())
        steps, i, end = [], int(by_target[j]), j
        while True:
            steps.append((i, end, by_source[i]))
            if by_source[i] < 0:
                break
            end = int(by_source[i])
            i = int(by_target[end])
        amount = min(int(room[j]), int(left[i]), *[int(flow[a, taken]) for a, _, taken in steps if taken >= 0])
        for a, to, taken in steps:
            flow[a, to] += amount
            if taken >= 0:
                flow[a, taken] -= amount
        left[i] -= amount
        room[j] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def move_costs(old: int, new: int) -> np.ndarray:
    """Nothing for a byte that stays in its shard, 1 for one that moves."""
    return 1.0 - np.eye(old, new)


@dataclass
class Layout:
    """Shards as parts of written tables: (path, condition on shard and block, or None for all of it)."""

    spark: SparkSession
    parts: list[tuple[str, Column | None]]
    schema: str
    shards: int
    block_bytes: int
    moved: int = 0  #: bytes that the last resharding moved
    rewritten: int = 0  #: rows that it wrote anew

    def read(self) -> DataFrame:
        """(shard, block, slot, at, size, doc): the place of each document, its first byte within the shard, and its row."""
        frames = [self.spark.read.schema(self.schema).parquet(path) if where is None else self.spark.read.schema(self.schema).parquet(path).where(where) for path, where in self.parts]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out.select("shard", "block", "slot", "at", "size", "doc")


def write_rows(rows: DataFrame, name: str) -> str:
    path = new_path(rows.sparkSession, name)
    rows.select("slot", "at", "size", "doc", "shard", "block").write.partitionBy("shard", "block").parquet(path)
    return path


def lay_out(docs: DataFrame, shard: Column, shards: int, text: str = "text") -> Layout:
    """Write docs into shards (0 to shards - 1, by the column given), with one shuffle of the texts.

    Groups of rows (shard, size class, number) are summed up first; a row's slot and byte are its group's plus its own within.
    The sums by shard and size class, at most 64 a shard, tell the driver how many groups each needs.
    """
    sized = docs.select(F.struct("*").alias("doc"), shard.cast("int").alias("shard"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    sized = sized.withColumn("class", F.length(F.bin("size")))
    classes = sized.groupBy("shard", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    block_bytes = max(LEAST_BLOCK, sum(r["bytes"] for r in classes) // (shards * BLOCKS_PER_SHARD))
    dealt = [(r["shard"], r["class"], max(-(-r["n"] // ROWS_PER_GROUP), -(-r["bytes"] // block_bytes))) for r in classes]
    groups = F.broadcast(docs.sparkSession.createDataFrame(dealt, "shard int, class int, groups long"))
    sized = sized.join(groups, ["shard", "class"]).withColumn("group", F.pmod("row", F.col("groups")))
    keys = ["shard", "class", "group"]
    before = Window.partitionBy("shard").orderBy(F.desc("class"), "group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    bases = sums.select(*keys, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy(*keys).orderBy("row")
    counted = sized.withColumns({"upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(within)}).join(bases, keys)
    rows = counted.withColumn("at", F.col("base") + F.col("upto") - F.col("size")).withColumn("slot", F.col("first") + F.col("nth") - 1)
    rows = rows.withColumn("block", F.floor(F.col("at") / block_bytes).cast("int"))
    path = write_rows(rows, "shards")
    doc = rows.schema["doc"].dataType.simpleString()
    return Layout(docs.sparkSession, [(path, None)], f"slot long, at long, size long, doc {doc}, shard int, block int", shards, block_bytes)


def segments(flow: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(old shard, first byte, end byte, new shard): each old shard in pieces, what stays first."""
    out = []
    for i, line in enumerate(flow.tolist()):
        at = 0
        for j in sorted(range(len(line)), key=lambda j: (j != i, j)):
            if line[j]:
                out.append((i, at, at + line[j], j))
                at += line[j]
    return out


def reshard(layout: Layout, shards: int, capacities: list[int] | None = None, cost: np.ndarray | None = None) -> Layout:
    """A layout of `shards` shards whose sizes come as near the capacities as whole documents allow.

    A document belongs to the segment that has its middle byte. What reaches the driver is as long as there are shards.
    """
    spark, rows = layout.spark, layout.read()
    sizes = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    supplies = [sizes.get(i, 0) for i in range(layout.shards)]
    flow = least_cost_flow(supplies, capacities or equal_capacities(sum(supplies), shards), move_costs(layout.shards, shards) if cost is None else cost)
    cuts = segments(flow)
    if not cuts:
        return Layout(spark, layout.parts, layout.schema, shards, layout.block_bytes)
    table = F.broadcast(spark.createDataFrame([(k, *c) for k, c in enumerate(cuts)], "segment int, old int, low long, high long, new int"))
    middle = 2 * F.col("at") + F.col("size")
    mine = (F.col("shard") == F.col("old")) & (middle >= 2 * F.col("low")) & (middle < 2 * F.col("high"))
    found = {r["segment"]: r for r in rows.drop("doc").join(table, mine).groupBy("segment").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("slot"), F.min("at").alias("at"), F.min("block").alias("block")).collect()}
    slots, bytes_, bases = [0] * shards, [0] * shards, {}
    for k, (i, _, _, j) in sorted(((k, c) for k, c in enumerate(cuts) if k in found), key=lambda x: (x[1][3] != x[1][0], x[0])):
        bases[k] = (slots[j] - found[k]["slot"], bytes_[j] - found[k]["at"])
        slots[j] += found[k]["n"]
        bytes_[j] += found[k]["bytes"]
    away = [(k, c) for k, c in enumerate(cuts) if k in found and c[0] != c[3]]
    never = 2**31 - 1
    first = [min((found[k]["block"] for k, c in away if c[0] == i), default=never) for i in range(layout.shards)]
    reached = F.element_at(F.array(*map(F.lit, first)), F.col("shard") + 1)
    shift = F.broadcast(spark.createDataFrame([(k, *cuts[k], *bases[k]) for k in bases], "segment int, old int, low long, high long, new int, by_slot long, by_byte long"))
    joined = rows.where(F.col("block") >= reached).join(shift, mine)
    out = joined.select((F.col("slot") + F.col("by_slot")).alias("slot"), (F.col("at") + F.col("by_byte")).alias("at"), "size", "doc", F.col("new").alias("shard"))
    path = write_rows(out.withColumn("block", F.floor(F.col("at") / layout.block_bytes).cast("int")), "reshard")
    stays = F.col("block") < reached
    parts = [(p, stays if where is None else where & stays) for p, where in layout.parts]
    made = Layout(spark, [*parts, (path, None)], layout.schema, shards, layout.block_bytes, sum(found[k]["bytes"] for k, _ in away))
    made.rewritten = spark.read.schema(layout.schema).parquet(path).count()
    return made


def places(layout: Layout) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, from the files."""
    crc = F.crc32(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary"))
    return layout.read().select(F.col("doc.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
