"""Best-fit packing of token pieces into sequences by minimum bin slack.

Each bin takes the longest remaining piece and the combination of other lengths that fills it best, found by a subset-sum
dynamic programme over a bitset; the combination is removed as often as the counts of its lengths allow, which is what
repeating the search would do. The search needs only the number of pieces of each length, at most `capacity` numbers, so
its plan stays small whatever the input; pieces are numbered within their length and mapped to bins by Spark.

Null texts count as empty (one end id). Very long texts are encoded whole and cut into pieces. Bins that fill equally well
take the longest pieces first, and pieces of one length are interchangeable, so ties change no bin's fill. Repeated documents
are packed each for itself. An empty table has no pieces. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.pretokens import vocabulary
from fieldloom.llm.storage import materialize

#: Texts encoded together; few, so that their words and ids stay in the processor's cache and need little memory.
TEXTS_TOGETHER = 256
#: Pieces of one length are numbered in this many blocks at least, more for large inputs.
BLOCKS, ROWS_PER_BLOCK = 64, 100_000
RANK_BITS = 44


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The longest length and those that fill a bin best with it: (length, times), longest first."""
    anchor = max(counts)
    room = capacity - anchor
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, times = min(counts[length] - (length == anchor), room // length), 1
        while left and not reach >> room & 1:
            times = min(times, left)
            wider = reach | reach << times * length & mask
            if wider != reach:
                steps.append((length, times, reach))
                reach = wider
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {anchor: 1}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            taken[length] = taken.get(length, 0) + times
    return sorted(taken.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, pieces of it in a bin, first bin, offset in the bin), by length and rank."""
    counts, used, plan, bins = {n: c for n, c in histogram.items() if c}, {}, [], 0
    while counts:
        chosen = fullest(counts, capacity)
        repeats, offset = min(counts[n] // k for n, k in chosen), 0
        for n, k in chosen:
            first = used.get(n, 0)
            used[n] = first + k * repeats
            plan.append((n, first, used[n], k, bins, offset))
            offset += k * n
            counts[n] -= k * repeats
            if not counts[n]:
                del counts[n]
        bins += repeats
    return sorted(plan)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids: (doc_id, piece, start, length, ids_crc32[, ids binary]); only a first is shorter."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ending = vocabulary(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_TOGETHER):
                part = batch.slice(at, TEXTS_TOGETHER)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, raw in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    raw += ending
                    n = len(raw) // 4
                    head = n - (n - 1) // capacity * capacity
                    for k, (a, b) in enumerate([(0, head), *((x, x + capacity) for x in range(head, n, capacity))]):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(raw[4 * a : 4 * b])
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def numbered(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """rank: 0, 1, ... within each length; a frequent length is numbered in blocks, so no task has all of it."""
    blocks = max(BLOCKS, -(-n_pieces // ROWS_PER_BLOCK))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(blocks)))
    sums = dealt.groupBy("length", "block").count()
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1)
    return ranked.join(bases, ["length", "block"]).withColumn("rank", F.col("base") + F.col("within")).drop("block", "base", "within")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset of each piece; `pieces` is read several times and should be a written table."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(plan_bins(histogram, capacity), np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    ranked = numbered(pieces, sum(histogram.values()))
    names = [f for f in ranked.columns if f != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << RANK_BITS) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 4] + nth // row[:, 3], row[:, 5] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences: (doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset)."""
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    return place(pieces, capacity).select(*pieces.columns, "sequence_id", "offset")
