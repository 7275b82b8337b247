"""Spelling variants: words one edit apart, found by bands of letter-parity bitmasks.

A word's mask has one bit for each letter that occurs in it an odd number of times. Inserting or deleting a code point flips
one bit and replacing one flips two, so of three bands of the mask at least one is equal in near words. Words meet on an
equal band and an equal or adjacent length; masks that differ in more bits go, and the edit distance decides.

Such buckets are large where words are many, and are split by what an edit leaves alone: of the first and the last AFFIX
letters, which do not overlap in a word of twice as many, it changes one at most. Words therefore meet within a bucket on
equal first or equal last letters, once for the first band and end in which they agree. What is still large is cut into blocks
of BLOCK_WORDS that meet block by block, so no bucket is one task and no pair is left out. All of it are DataFrame operations.

Occurrences are counted on the map side first, so a frequent word is one row for each task. Each word is at most once in the
tables behind the counting.

A null text has no words and a null id counts as empty text in the hash; texts of any length are read whole, repeated rows
count each time. An empty table has no rows. Extra columns, of whatever name, are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.storage import materialize, remove, written

#: Upper-case letters that are lower-cased, and the same in lower case.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Letters a to z and those from the 26th number on are dealt to the bands by turns; each has a bit of its own.
BANDS, ACCENTED = 3, 0xC0
#: Letters at either end of a word, half of the shortest word's.
AFFIX = 3
BLOCK_WORDS = 256


def deleted_at(word: Column, place: Column) -> Column:
    """word without the code point at a place counted from 0."""
    return F.concat(F.left(word, place), F.substring(word, place + 2, F.length(word)))


def words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", divisor: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): the counted words. Of a run whose hash with its document's id is divisible by `divisor` one code point is left out.

    Runs shorter than `shortest` can give no word and are not made. The place left out depends on document and run alone.
    """
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(rf"([A-Za-zÀ-ÿ]{{{shortest},}})"), F.lit(1))).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % divisor == 0, deleted_at(F.col("run"), place)).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def bands(word: Column) -> list[Column]:
    """The three bands of a word's letter-parity mask; a letter's band is its number modulo 3."""
    number = lambda c: F.when(F.ascii(c) < ACCENTED, F.ascii(c) - ord("a")).otherwise(F.ascii(c) - ACCENTED + 26)
    numbers = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), number)

    def flip(band: int):
        bit = lambda n: F.call_function("shiftleft", F.lit(1), F.floor(n / BANDS).cast("int"))
        return lambda mask, n: F.when(n % BANDS == band, mask.bitwiseXOR(bit(n))).otherwise(mask)

    return [F.aggregate(numbers, F.lit(0), flip(band)) for band in range(BANDS)]


def vocabulary(counted: DataFrame) -> DataFrame:
    """Each word (word, n) once, with its length and mask bands, written, as it is read several times."""
    masks = [mask.alias(f"m{i}") for i, mask in enumerate(bands(F.col("word")))]
    return materialize(counted.select("word", "n", F.length("word").alias("length"), *masks), "words")


def candidates(words: DataFrame) -> DataFrame:
    """(a, b): pairs of a vocabulary, each once, of words of 2 AFFIX letters or more that agree in a band and at an end, differ in
    at most two bits, and by one in length at most."""
    masks, ends = [f"m{i}" for i in range(BANDS)], [F.left("word", F.lit(AFFIX)), F.right("word", F.lit(AFFIX))]
    places = [F.struct(F.lit(2 * i + e).alias("place"), F.col(m).alias("value"), end.alias("affix")) for i, m in enumerate(masks) for e, end in enumerate(ends)]
    keyed = words.select("word", "length", *masks, F.explode(F.array(*places)).alias("x")).select("word", "length", *masks, "x.*")
    key = ["place", "value", "affix", "length"]
    large = keyed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_WORDS).cast("int").alias("blocks")).where("blocks > 1")
    longer = large.select(*key[:3], (F.col("length") - 1).alias("length"), F.col("blocks").alias("more"))
    dealt = keyed.join(large, key, "left").withColumn("block", F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int"))
    # A word meets the blocks of its own length from its own block on, and all blocks of the next length.
    sent = dealt.join(longer, key, "left")
    own = F.transform(F.sequence("block", F.coalesce("blocks", F.lit(1)) - 1), lambda to: F.struct(F.col("length").alias("length"), to.alias("to")))
    above = F.transform(F.sequence(F.lit(0), F.coalesce("more", F.lit(1)) - 1), lambda to: F.struct((F.col("length") + 1).alias("length"), to.alias("to")))
    sent = sent.select("word", *masks, *key[:3], F.col("length").alias("own"), "block", F.explode(F.concat(own, above)).alias("x")).select("word", *masks, *key[:3], "own", "block", "x.*").alias("l")
    kept = dealt.select("word", *masks, *key, F.col("block").alias("to")).alias("r")
    of = lambda side, name: F.col(f"{side}.{name}")
    apart, band = [of("l", m) != of("r", m) for m in masks], F.floor(of("l", "place") / 2)
    first_band = (band == 0) | (apart[0] & ((band == 1) | apart[1]))
    first_end = (of("l", "place") % 2 == 0) | (F.left(of("l", "word"), F.lit(AFFIX)) != F.left(of("r", "word"), F.lit(AFFIX)))
    bits = sum((F.bit_count(of("l", m).bitwiseXOR(of("r", m))) for m in masks), F.lit(0))
    once = (of("l", "own") != of("l", "length")) | (of("l", "block") != of("l", "to")) | (of("l", "word") < of("r", "word"))
    equal = [of("l", c) == of("r", c) for c in (*key, "to")]
    return sent.join(kept, [*equal, bits <= 2, first_band, first_end, once]).select(of("l", "word").alias("a"), of("r", "word").alias("b"))


def near(words: DataFrame) -> DataFrame:
    """(a, b): pairs of words that differ by exactly one inserted, deleted or replaced code point, each once."""
    return candidates(words).where(F.levenshtein("a", "b", 1) == 1)


def forms(counted: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's form is its most frequent near word, if `times` as frequent as the word itself."""
    known = vocabulary(counted)
    pairs = near(known)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    others = known.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(others, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    joined = known.select("word", "n").join(best, "word", "left")
    formed = -F.col("best.n") >= times * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n"))


def with_roots(formed: DataFrame, times: int = 5) -> DataFrame:
    """formed with root: the word at the end of the forms, found by doubling the step.

    Along the forms n grows at least `times` each step, so the greatest n bounds the number of rounds.
    """
    spark, formed = formed.sparkSession, materialize(formed, "forms")
    most, fewest = formed.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(most / fewest, times) + 1e-9) if most else 0
    links, path = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, steps - 1).bit_length()):
        ends = links.select(F.col("word").alias("root"), F.col("root").alias("end"))
        before = path
        links, path = written(links.join(ends, "root", "left").select("word", F.coalesce("end", "root").alias("root")), "roots")
        remove(spark, before)
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of documents (doc_id, text)."""
    counted = words(docs)
    return with_roots(forms(counted, times), times).select("word", "form", "root", "n", "n_near", "form_n")
