"""License scans by ordered signature rules, in DataFrame functions only.

A text's words (ASCII letters and digits and all other signs beyond ASCII, lower-cased) are matched by hand-written signature
rules (license_rules). Keywords gate a text before any rule runs. The rules of one priority are one pattern whose alternatives
stand in their order and which is tried at every word, so at each word the first rule that matches holds and detections may
overlap; only one inside another of the same or a higher priority is suppressed. Each word of a gated text carries its place,
so a match gives its span at once, and no rule matches more than MOST_WORDS words, so only the spans before a span can hold it:
time grows with the text, however many matches it has. All rules run inside the row: nothing is shuffled and every document
has one result. Results are written before they are given back, so that a filter on them does not run the rules again.

Null and empty texts have no words; very long texts are scanned whole; of equal spans the first label in the alphabet stays;
repeated rows are scanned alike; an empty table gives no rows; only doc_id and text are read, so other columns may have any
names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.license_rules import MOST_WORDS, SIGNS, rules
from fieldloom.llm.storage import materialize

#: What stands between words, and the base phrases with their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words_in(text: str) -> str:
    """The number of words in a run of words that are held apart by single spaces."""
    return f"size(array_remove(split({text}, ' '), ''))"


def placed(pattern: str) -> str:
    """A rule's pattern for words that carry their place: `word#7 next#8`."""
    return pattern.replace(r"\S+", "[^ #]+").replace(" ", r"#\d+ ")


def signature(priority: int) -> str:
    """One pattern for all rules of a priority, in their order; its group is the detection at a word, and nothing is consumed."""
    return rf"(?<= )(?=((?:{'|'.join(placed(rule) for _, rule in rules()[priority])})#\d+) )"


def label_of(words: Column, priority: int) -> Column:
    """The label of the first rule of a priority that matches words without their places."""
    first, *rest = rules()[priority]
    out = F.when(words.rlike(f"^(?:{first[1]})$"), first[0])
    for label, rule in rest:
        out = out.when(words.rlike(f"^(?:{rule})$"), label)
    return out


def gated(lower: Column) -> Column:
    """Whether a text in lower case may have a detection."""
    return reduce(Column.__or__, [F.contains(lower, F.lit(sign)) for sign in SIGNS], lower.rlike("cc0|cc" + BETWEEN + "by"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row.

    `spans` has the detections that stay: start and end in words, label, priority. `score` is 0 without labels, else the
    highest priority among the detections over 4, and at least 0.5 for base phrases.
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), "")
    out = docs.select("doc_id", "text").withColumn("_words", words)
    out = out.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.when(gated(F.lower("text")), F.concat(F.lit(" "), _lower(F.array_join("_words", " ")), F.lit(" "))).alias("_run"),
    )
    phrases = "|".join(BASE)
    out = out.withColumn("_cut", F.split("_run", rf"(?<= )(?=(?:{phrases}) )"))
    out = out.withColumn("_placed", F.expr("concat(' ', array_join(transform(split(trim(_run), ' '), (w, i) -> concat(w, '#', i)), ' '), ' ')"))
    base = [F.when(F.contains("_run", F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in BASE.items()]
    out = out.withColumns(
        {
            "n_base": F.when(F.col("_run").isNull(), 0).otherwise(F.size("_cut") - 1).cast("long"),
            "_base": F.array_sort(F.array_compact(F.array(*base))),
            **{f"_hits{p}": F.regexp_extract_all("_placed", F.lit(signature(p)), F.lit(1)) for p in rules()},
        }
    )

    def span(priority: int):
        def of(hit: Column) -> Column:
            start, end = F.regexp_extract(hit, r"#(\d+)", 1).cast("long"), F.regexp_extract(hit, r"#(\d+)$", 1).cast("long") + 1
            return F.struct(start.alias("start"), (-end).alias("minus_end"), F.lit(-priority).alias("minus_p"), label_of(F.regexp_replace(hit, r"#\d+", ""), priority).alias("label"))

        return F.transform(f"_hits{priority}", of)

    spans = F.array_sort(F.concat(*[F.coalesce(span(p), F.array().cast("array<struct<start: bigint, minus_end: bigint, minus_p: int, label: string>>")) for p in rules()]))
    reach = MOST_WORDS * len(rules())  # no more spans than these start within the longest one
    inside = f"exists(slice(_spans, greatest(1, i + 1 - {reach}), least(i, {reach})), y -> y.minus_end <= x.minus_end and y.minus_p <= x.minus_p)"
    out = out.withColumns(
        {
            "first_word": F.when(F.col("n_base") > 0, F.expr(_words_in("_cut[0]"))).cast("long"),
            "last_word": F.when(F.col("n_base") > 0, F.col("n_words") - F.expr(_words_in("element_at(_cut, -1)"))).cast("long"),
            "_spans": spans,
        }
    ).withColumn("_kept", F.expr(f"filter(_spans, (x, i) -> not {inside})"))
    labels = F.array_sort(F.array_union("_base", F.expr("transform(_kept, x -> x.label)")))
    score = F.greatest(F.expr("coalesce(array_max(transform(_kept, x -> -x.minus_p)), 0) / 4D"), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    found = out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
        F.expr("transform(_kept, x -> struct(x.start as start, -x.minus_end as `end`, x.label as label, -x.minus_p as priority))").alias("spans"),
    )
    return materialize(found, "licenses")
