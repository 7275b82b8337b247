"""A quality classifier: a generalised additive model with pairwise interactions.

Boosting cycles over the features; each step grows one shallow tree on a single feature's bins and adds it to that
feature's lookup table. The strongest pairs then get tables of their own in the same way. Scoring adds up one table entry
for each feature and pair. Features are counts and ratios of the whole text; labels, language, source and id are not
among them.

Null and empty texts have zero words and a score like any other; very long texts are measured whole. A text's score does
not depend on the rows around it, so repeated rows are scored alike. An id teaches once: of repeated labels the least
counts, and of repeated documents the least features. Without labelled rows of both kinds the score is 0.5 for all, and
`keep` keeps all. Ties between cuts go to the first, ties between pairs to the last features. An empty table gives no rows.
Only doc_id and text are read, so other columns may have any names; `keep` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.minhash_dedup import _chunks, mixed, word_hashes
from fieldloom.llm.storage import materialize

FEATURES = ["words", "word_bytes", "capitals", "digits", "symbols", "exclamations", "punctuation", "beyond_ascii", "adjacent_repeats", "distinct_words", "distinct_triples", "lines", "longest_word"]
#: The model is fitted on about this many labelled rows at most, chosen by a hash of their id.
TRAINING_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 48, 8, 120, 40, 6, 0.1, 3
U64 = np.uint64


def _distinct(values: np.ndarray, stops: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts))
    for i, (stop, n) in enumerate(zip(stops.tolist(), counts.tolist())):
        if n > 0:
            part = np.sort(values[stop - n : stop])
            out[i] = 1 + (part[1:] != part[:-1]).sum()
    return out


def measure(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each of the consecutive texts (bytes, end offsets)."""
    texts = len(ends)
    starts = np.concatenate([[0], ends[:-1]])

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(float)

    kinds = np.zeros(256, np.uint8)
    for k, chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!", ".,;:?\"'()-", "abcdefghijklmnopqrstuvwxyz", " \t\n\v\f\r"], 1):
        kinds[[ord(c) for c in chars]] = k
    kinds[128:] = 8
    kind = kinds[data]
    n = {k: total(kind == k) for k in range(1, 9)}
    words, owner = word_hashes(data, ends)
    counts = np.bincount(owner, minlength=texts)
    stops = np.cumsum(counts)
    repeats = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=texts)
    with np.errstate(over="ignore"):
        triples = mixed(words[:-2] + words[1:-1] * U64(0x9E3779B97F4A7C15) + words[2:] * U64(0xD6E8FEB86659FD93)) if len(words) > 2 else words[:0]
    some, threes = np.maximum(counts, 1), np.maximum(counts - 2, 0)
    solid = (ends - starts) - n[7]
    # A text of g white-space bytes has g + 1 runs between them, one after the other; a run is a word or empty.
    gaps = np.flatnonzero(kind == 7)
    runs = np.sort(np.concatenate([gaps, ends])) - np.sort(np.concatenate([starts, gaps + 1]))
    longest = np.maximum.reduceat(runs, np.cumsum(n[7] + 1).astype(int) - n[7].astype(int) - 1) if texts else np.zeros(0)
    columns = [
        np.log1p(counts), solid / some, n[1] / np.maximum(n[1] + n[6], 1), n[2] / np.maximum(solid, 1), n[3] / some, n[4] / some, n[5] / some,
        n[8] / np.maximum(solid, 1), repeats / some, _distinct(words, stops, counts) / some,
        _distinct(triples, np.minimum(stops - 2, len(triples)), threes) / np.maximum(threes, 1), total(data == 10) / some, np.log1p(longest),
    ]
    return np.stack(columns, axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, features array<double>) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, ends in _chunks(batch):
                table = measure(data, ends)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * len(FEATURES)), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], lists], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<double>")


class Model:
    """Lookup tables over binned features and pairs of features."""

    def __init__(self, table: np.ndarray, labels: np.ndarray):
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in table.T]
        self.coarse = [np.unique(np.quantile(column, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for column in table.T]
        rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias, self.single = float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        fine, wide = self._binned(table, self.edges), self._binned(table, self.coarse)
        score = np.full(len(labels), self.bias)
        for _ in range(ROUNDS):
            for f, bins in enumerate(fine.T):
                step = self._tree(bins, labels, score, len(self.single[f]))
                self.single[f] += step
                score += step[bins]
        gains = []
        residual = labels - 1 / (1 + np.exp(-score))
        for a in range(table.shape[1]):
            for b in range(a):
                cell = wide[:, a] * (PAIR_BINS + 1) + wide[:, b]
                sums, n = np.bincount(cell, residual), np.bincount(cell)
                gains.append((float((sums**2 / np.maximum(n, 20)).sum()), a, b))
        chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        self.pairs = [(a, b, np.zeros((PAIR_BINS + 1, PAIR_BINS + 1))) for a, b in chosen]
        for _ in range(PAIR_ROUNDS):
            for a, b, grid in self.pairs:
                step = self._split_both(wide[:, a], wide[:, b], labels, score)
                grid += step
                score += step[wide[:, a], wide[:, b]]

    @staticmethod
    def _binned(table: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, "right") for e, column in zip(edges, table.T)], axis=1) if len(table) else np.zeros((0, len(edges)), int)

    @staticmethod
    def _slopes(labels: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return labels - p, p * (1 - p)

    def _tree(self, bins: np.ndarray, labels: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """A tree of LEAVES leaves over one feature's bins, as the step for each bin."""
        g, h = self._slopes(labels, score)
        up, curve = np.bincount(bins, g, n), np.bincount(bins, h, n)
        cuts = [0, n]
        for _ in range(LEAVES - 1):
            best = (1e-9, 0)
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    u, c = np.cumsum(up[a:b]), np.cumsum(curve[a:b])
                    gain = u[:-1] ** 2 / (c[:-1] + 1) + (u[-1] - u[:-1]) ** 2 / (c[-1] - c[:-1] + 1) - u[-1] ** 2 / (c[-1] + 1)
                    best = max(best, (float(gain.max()), a + int(gain.argmax()) + 1))
            if best[1]:
                cuts = sorted([*cuts, best[1]])
        step = np.zeros(n)
        for a, b in zip(cuts, cuts[1:]):
            step[a:b] = RATE * up[a:b].sum() / (curve[a:b].sum() + 1)
        return step

    def _split_both(self, x: np.ndarray, y: np.ndarray, labels: np.ndarray, score: np.ndarray) -> np.ndarray:
        """A tree that cuts each of two features once, at the best pair of cuts, as the step for each cell."""
        g, h = self._slopes(labels, score)
        n = PAIR_BINS + 1
        up, curve = (np.bincount(x * n + y, w, n * n).reshape(n, n).cumsum(0).cumsum(1) for w in (g, h))
        best, step = 0.0, np.zeros((n, n))
        for i in range(n - 1):
            for j in range(n - 1):
                parts = []
                for t in (up, curve):
                    parts.append((t[i, j], t[i, -1] - t[i, j], t[-1, j] - t[i, j], t[-1, -1] - t[i, -1] - t[-1, j] + t[i, j]))
                gain = sum(u * u / (c + 1) for u, c in zip(*parts))
                if gain > best:
                    values = [RATE * u / (c + 1) for u, c in zip(*parts)]
                    best, step = gain, np.block([[np.full((i + 1, j + 1), values[0]), np.full((i + 1, n - j - 1), values[1])], [np.full((n - i - 1, j + 1), values[2]), np.full((n - i - 1, n - j - 1), values[3])]])
        return step

    def score(self, table: np.ndarray) -> np.ndarray:
        fine, wide = self._binned(table, self.edges), self._binned(table, self.coarse)
        total = np.full(len(table), self.bias)
        for values, bins in zip(self.single, fine.T):
            total += values[bins]
        for a, b, grid in self.pairs:
            total += grid[wide[:, a], wide[:, b]]
        return 1 / (1 + np.exp(-total))


def sampled(labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, quality), one row an id, of the `training_rows` labelled ids that come first by a hash."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return marked.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(training_rows)


def fit(rows: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model | None:
    """A model of quality from `rows` (doc_id, features) that `labels` (doc_id, quality) marks; None if one kind lacks.

    At most `training_rows` rows reach the driver.
    """
    marked = rows.join(F.broadcast(sampled(labels, training_rows)), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.first("quality").alias("quality"))
    chosen = marked.orderBy("doc_id").toPandas()
    if chosen["quality"].nunique() < 2:
        return None
    return Model(np.array(chosen["features"].tolist()), chosen["quality"].to_numpy(float))


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, features)."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(model), rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            values = np.full(len(table), 0.5) if shared.value is None else shared.value.score(table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    return rows.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")


def remainder(column: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id has -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % of, F.lit(-1))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted); the fold with remainder 0 is never learned from."""
    rows = materialize(measured(docs), "features")
    model = fit(rows.where(remainder("doc_id", folds) > 0), labels)
    scored = score(rows, model)
    return scored.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier predicts as good, with all their columns; they are scored where they stand."""
    learned = labels.where(remainder("doc_id", folds) > 0)
    model = fit(measured(docs.join(F.broadcast(sampled(learned).select("doc_id")), "doc_id", "left_semi")), learned)
    if model is None:
        return docs
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(place)] * 2, names=["doc_id", "text"])
            for row, stop, data, ends in _chunks(texts):
                yield batch.slice(row, stop - row).filter(pa.array(shared.value.score(measure(data, ends)) >= limit))

    return docs.mapInArrow(run, docs.schema)
