"""Token ids in ORC files: run-length encoded integer lists in ascending id order.

Writers sort by document id, so row-index and stripe statistics prune ranges and the Bloom filters on the id column
prune point reads; stripes are read in parallel. Null texts count as empty; repeated ids keep all their rows, in order of
their text's hash; a null id comes first; an empty table gives no rows. Columns besides id and text are not written. Very long
texts are encoded and written whole. As files follow the order of ids, all rows of one id, and all of the null id, are written
by one task: ids are taken to be nearly unique.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.pretokens import vocabulary

#: Texts encoded together; few, so that their words and ids stay in the processor's cache and need little memory.
TEXTS_TOGETHER = 256
ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20)}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encode docs (doc_id, text) and write (doc_id, ids, n_tokens, part, part_start) to `path` as ORC.

    `tokenizer` is the path of a `tokenizers` file; `end_id` is put after each document. `part` numbers the files in
    ascending id order and part_start counts the ids before a document in its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ending, before = vocabulary(tokenizer), b"" if end_id is None else np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_TOGETHER):
                part = batch.slice(at, TEXTS_TOGETHER)
                raw = [r + ending for r in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                sizes = np.array([len(r) // 4 for r in raw], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(sizes), pa.array(before + ends[:-1])], names=["doc_id", "ids", "n_tokens", "part_start"])
                before += int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    encoded = ordered.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, part_start long")
    encoded.withColumn("part", F.spark_partition_id()).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens wrote, with `start`: the ids of all documents before this one.

    The starts of files come from their sums, one row a file: their number is that of the writer's tasks, which
    spark.sql.shuffle.partitions bounds.
    """
    kept = spark.read.orc(path)
    sums = kept.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return kept.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base", "part", "part_start")


def checksums(tokens: DataFrame) -> DataFrame:
    """Per document of read_tokens the CRC-32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, raw = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            sums = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
