"""Language identification by one bit-sliced Bloom filter over character n-grams.

Every slot of the filter is a bitmask with one bit for each language, so the slots of an n-gram, taken together with AND,
give all languages that have it at once. The languages' counts over a text, corrected for the share of n-grams that a
filter of its fill accepts by chance, decide. An n-gram belongs to a language if it is frequent there in comparison with
the language in which it is most frequent.

Null texts and texts without a letter are `und` with score 0. Ties go to the first name. Rows without a language teach
nothing; without any, every text is `und`. Any number of languages may be learned: a slot has one 64-bit word for every 63
of them, so a filter takes 8 MB for each such word. Very long texts are counted in parts and judged whole. Repeated rows are
judged alike; an empty table gives no rows. Only doc_id and text are inputs of a prediction, so other columns may have any
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.minhash_dedup import mixed
from fieldloom.llm.quality_gam import remainder

#: The filter learns from about this many documents of each language at most, chosen by a hash of their id.
TRAINING_DOCUMENTS = 2_000
SLOTS, PROBES, LEAST_COUNT, LEAST_RATIO = 1 << 20, 3, 3, 0.25
#: Languages of a mask word, and signs whose n-grams are looked up together.
WORD_BITS, SIGNS_TOGETHER = 63, 1 << 20
U64 = np.uint64


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams around each letter of the texts, as 64-bit values, and the text of each: 3 signs, and 4 of which the
    middle two are letters. What is no letter counts as one and the same sign. They come in parts of bounded size."""
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SIGNS_TOGETHER):
            size += len(texts[stop])
            stop += 1
        lower = [t.lower() for t in texts[at:stop]]
        signs = np.frombuffer("".join(f"\n{t}\n\n" for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(at, stop), [len(t) + 3 for t in lower])
        signs = np.where(letter_table()[signs], signs, 0).astype(U64)
        for low in range(0, len(signs), SIGNS_TOGETHER):
            middle = np.flatnonzero(signs[low : low + SIGNS_TOGETHER]) + low
            if not len(middle):
                continue
            three = signs[middle - 1] << U64(42) | signs[middle] << U64(21) | signs[middle + 1]
            two = middle[signs[middle + 1] > 0]
            with np.errstate(over="ignore"):
                four = mixed((signs[two - 1] << U64(42) | signs[two] << U64(21) | signs[two + 1]) * U64(0x9E3779B97F4A7C15) + signs[two + 2] + U64(1))
            yield np.concatenate([mixed(three), four]), np.concatenate([owner[middle], owner[two]])
        at = stop


def probes(values: np.ndarray) -> list[np.ndarray]:
    return [(values >> U64(20 * k) & U64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Filter:
    """Bit-sliced filters of `languages`: slots[w] has the mask of the languages 63 w to 63 w + 62 for each slot."""

    languages: list[str]
    slots: np.ndarray

    def __post_init__(self) -> None:
        self.chance = [float((self.slots[k // WORD_BITS] >> U64(k % WORD_BITS) & U64(1)).mean()) ** PROBES for k in range(len(self.languages))]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        total, hits = np.zeros(len(texts)), np.zeros((len(self.languages), len(texts)))
        for values, owner in grams(texts):
            total += np.bincount(owner, minlength=len(texts))
            places = probes(values)
            for w, slots in enumerate(self.slots):
                masks = slots[places[0]]
                for place in places[1:]:
                    masks = masks & slots[place]
                for k in range(w * WORD_BITS, min((w + 1) * WORD_BITS, len(self.languages))):
                    hits[k] += np.bincount(owner[(masks >> U64(k % WORD_BITS) & U64(1)) == 1], minlength=len(texts))
        counts = np.zeros_like(hits)
        for k, chance in enumerate(self.chance):
            counts[k] = np.clip((hits[k] - total * chance) / (1 - chance) if chance < 1 else 0, 0, total)
        known = (total > 0) & (len(self.languages) > 0)
        best = counts.argmax(axis=0) if len(self.languages) else np.zeros(len(texts), int)
        names = [self.languages[b] if k else "und" for b, k in zip(best, known)]
        return names, [float(counts[b, i] / total[i]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]


def learn(docs: DataFrame, training_documents: int = TRAINING_DOCUMENTS) -> Filter:
    """A filter from the text and lang of docs (doc_id, text, lang)."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Filter([], np.zeros((0, SLOTS), U64))
    table = [(name, k, int(min(1.0, training_documents / sizes[name]) * 1_000_000)) for k, name in enumerate(languages)]
    known = docs.sparkSession.createDataFrame(table, "lang string, language int, share int")
    chosen = docs.join(F.broadcast(known), "lang").where(F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1_000_000)) < F.col("share")).select("language", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages_of = batch.column(0).to_numpy()
            for values, owner in grams(batch.column(1).to_pylist()):
                of = languages_of[owner]
                for language in np.unique(of):
                    found, n = np.unique(values[of == language], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), language, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], names=["language", "gram", "n"])

    counted = chosen.mapInArrow(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("language").agg(F.sum("n").alias("total"))
    # One bounded list a gram: a number for each language that has it.
    rated = counted.join(F.broadcast(totals), "language").groupBy("gram").agg(F.max(F.col("n") / F.col("total")).alias("most"), F.collect_list(F.struct("language", "n", (F.col("n") / F.col("total")).alias("rate"))).alias("of"))
    held = rated.select("gram", "most", F.explode("of").alias("x")).where((F.col("x.n") >= LEAST_COUNT) & (F.col("x.rate") >= LEAST_RATIO * F.col("most")))
    places = F.array(*[F.shiftright("gram", 20 * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(PROBES)])
    bits = held.select(F.explode(places).alias("slot"), F.floor(F.col("x.language") / WORD_BITS).alias("word"), F.expr(f"shiftleft(1L, x.language % {WORD_BITS})").alias("mask"))
    masks = bits.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    slots = np.zeros((-(-len(languages) // WORD_BITS), SLOTS), U64)
    slots[masks["word"].to_numpy(int), masks["slot"].to_numpy(int)] = masks["mask"].to_numpy(np.int64).astype(U64)
    return Filter(languages, slots)


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text)."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def predict_languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); documents whose id has the remainder `held` are not learned from."""
    model = learn(docs.where(remainder("doc_id", folds) != held))
    return identify(docs, model).select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
