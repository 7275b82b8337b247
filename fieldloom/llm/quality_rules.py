"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects documents whose ratio is above a cutoff. Per stratum (language) the rules are tightened along one path of
(rule, cutoff) steps, from nothing rejected to the strictest. The path is laid out by documents that no label calls good:
the next step is the one that adds most labelled bad documents for each document it adds. The labelled good documents, each
id once, then test the path in its order: the exact binomial test must show that all rules together reject at most `risk` of
the good ones, and the first step that fails ends it (fixed-sequence testing needs no correction within a stratum). Strata
share `error_rate` by Bonferroni. So with a probability of 1 - error_rate no stratum loses more than `risk` of its good
documents to the cutoffs. Among the steps that pass, the one with the best labelled benefit holds; a stratum with too few
good labels to show anything (some 220) gets no cutoff, and only its base rule counts.

Null and empty texts have no words and fail the base rule; very long texts are measured whole. A ratio at a cutoff passes,
so do ratios of nothing (0). Repeated rows are judged alike; of a labelled id's rows the least counts, of its labels the
worst. A null language is a stratum of its own, apart from `und`. An empty table or one without labels gives the base
verdicts. judge reads doc_id, text and the stratum only, and keep passes whole rows through, so other columns may have any
names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.storage import materialize

#: White space between words, window length and base limits of the contract.
SPACE, WINDOW, LEAST_WORDS, MOST_REPEATED = r"[\x20\x09-\x0D]+", 8, 20, 30
#: rule: (numerator, denominator, cutoffs from strict to lenient)
RULES = {
    "symbols": ("n_symbols", "n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]),
    "capitals": ("n_capitals", "word_chars", [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    "duplicate_lines": ("n_dup_lines", "n_lines", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    "repeated_words": ("n_repeat_words", "n_words", [0.02, 0.05, 0.1, 0.15, 0.2, 0.25]),
    "long_words": ("word_chars", "n_words", [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0]),
}
#: Greatest share of a stratum's good documents that its cutoffs may reject, and the probability of any error.
RISK, ERROR_RATE, COST_OF_GOOD = 0.02, 0.05, 20


def _n_repeated(words: str) -> list[tuple[str, Column]]:
    """Steps that end in n_repeat_words; each is a column of its own, so that nothing is worked out twice."""
    windows = F.expr(f"if(size({words}) < {WINDOW}, array(), transform(sequence(1, size({words}) - {WINDOW - 1}), i -> xxhash64(slice({words}, i, {WINDOW}))))")
    ordered = F.expr("if(size(array_distinct(_windows)) = size(_windows), array(), sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))))")
    places = F.expr(
        "sort_array(transform(filter(transform(_ordered, (x, j) -> struct(x.i as i, coalesce(get(_ordered, j - 1).h = x.h, false) or coalesce(get(_ordered, j + 1).h = x.h, false) as twice)), x -> x.twice), x -> x.i))"
    )
    covered = F.expr(f"aggregate(transform(_places, (p, j) -> least({WINDOW}, coalesce(get(_places, j + 1), p + {WINDOW}) - p)), 0L, (a, x) -> a + x)")
    return [("_windows", windows), ("_ordered", ordered), ("_places", places), ("n_repeat_words", covered)]


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Windows of words are compared by 64-bit hashes within one document. Write the result before filtering by it: a filter is
    pushed below the steps and would have them worked out anew.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.expr(r"filter(split(_text, '\n'), x -> btrim(x, ' \t\u000b\u000c\r') != '')")
    out = docs.withColumn("_text", text).withColumn("_words", F.array_remove(F.split("_text", SPACE), "")).withColumn("_lines", lines)
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_capitals": F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": _n_repeated("_words")[0][1],
        }
    ).drop("_words", "_lines", "_text")
    for name, step in _n_repeated("_words")[1:]:
        out = out.withColumn(name, step)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.drop("_windows", "_ordered", "_places").withColumn("base_failed", failed)


def binomial_tail(hits: int, n: int, risk: float) -> float:
    """P(X <= hits) for X ~ Binomial(n, risk), summed from the exact terms."""
    terms = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk) for k in range(hits + 1))
    return min(1.0, math.fsum(map(math.exp, terms)))


def _ratio(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below).cast("double")), F.lit(0.0))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from driver values, made by the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def steps(bad: dict[str, list[int]], rest: dict[str, list[int]]) -> list[tuple[str, float]]:
    """The path of (rule, cutoff): `bad` and `rest` have the documents that each cutoff of a rule rejects, as in RULES.

    The next step has the most bad documents for each of the rest (one more, so that few prove little); ties go to more bad
    documents and then to the first rule. Cutoffs that add no bad document are passed over.
    """
    at, path = {rule: (0, 0, len(of[2])) for rule, of in RULES.items()}, []
    while True:
        ahead = []
        for n, (rule, (b, r, k)) in enumerate(at.items()):
            more = next((j for j in range(k - 1, -1, -1) if bad[rule][j] > b), None)
            if more is not None:
                ahead.append(((bad[rule][more] - b) / (rest[rule][more] - r + 1), bad[rule][more] - b, -n, rule, more))
        if not ahead:
            return path
        *_, rule, k = max(ahead)
        at[rule] = (bad[rule][k], rest[rule][k], k)
        path.append((rule, RULES[rule][2][k]))


def passed(rejected: list[int], n_good: int, risk: float, level: float) -> int:
    """Steps of a path that the tests admit; `rejected` has the good documents rejected by each step first."""
    hits = 0
    for k, more in enumerate(rejected):
        hits += more
        if not n_good or binomial_tail(hits, n_good, risk) > level:
            return k
    return len(rejected)


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, error_rate: float = ERROR_RATE) -> list[tuple[str | None, dict[str, float]]]:
    """(stratum, cutoffs by rule), from `measured` (doc_id, stratum, measures) and `labels` (doc_id, quality).

    What reaches the driver is one row for each stratum that has good labels enough, and one for each step of its path.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    ratios = F.array(*map(_ratio, RULES)).alias("_ratios")
    rows = measured.where("not base_failed").select("doc_id", "stratum", ratios).join(marked, "doc_id", "left")
    once = rows.where("_quality is not null").groupBy("doc_id").agg(F.min(F.struct("_quality", "stratum", "_ratios")).alias("x")).select("x.*")
    once = materialize(once, "labelled")
    sizes = once.groupBy("stratum").agg(F.count_if(F.col("_quality") == 1).alias("n_good"), F.count_if(F.col("_quality") == 0).alias("n_bad"))
    strata = sizes.where(F.col("n_good") >= math.log(error_rate) / math.log1p(-risk)).collect()
    if not strata:
        return []
    known = _table(measured.sparkSession, [{"of": row["stratum"]} for row in strata], "of: string")
    # How many cutoffs each rule's ratio is above; the counts of these lay out the path.
    levels = F.array(*[F.struct(F.lit(rule).alias("rule"), sum((F.col("_ratios")[n] > c).cast("int") for c in cutoffs).alias("above")) for n, (rule, (_, _, cutoffs)) in enumerate(RULES.items())])
    others = rows.where("_quality is null or _quality <> 1").join(known, F.col("stratum").eqNullSafe(F.col("of")), "left_semi")
    counted = others.select("stratum", (F.coalesce("_quality", F.lit(1)) == 0).alias("bad"), F.explode(levels).alias("x")).groupBy("stratum", "bad", "x.rule", "x.above").count().collect()
    bad, rest = ({row["stratum"]: {rule: [0] * len(of[2]) for rule, of in RULES.items()} for row in strata} for _ in range(2))
    for r in counted:
        for table in (bad, rest) if r["bad"] else (rest,):
            for k in range(r["above"]):  # cutoffs ascend
                table[r["stratum"]][r["rule"]][k] += r["count"]
    paths = [steps(bad[row["stratum"]], rest[row["stratum"]]) for row in strata]
    number = {rule: n for n, rule in enumerate(RULES)}
    walked = [{"of": row["stratum"], "path": [{"step": k, "rule": number[rule], "cutoff": cutoff} for k, (rule, cutoff) in enumerate(path)]} for row, path in zip(strata, paths) if path]
    if not walked:
        return []
    table = _table(measured.sparkSession, walked, "of: string, path: array<struct<step: int, rule: int, cutoff: double>>")
    first = F.expr("array_min(transform(filter(path, p -> _ratios[p.rule] > p.cutoff), p -> p.step))")
    reached = once.join(table, F.col("stratum").eqNullSafe(F.col("of"))).select("of", "_quality", first.alias("step"))
    hits = {(r["of"], r["step"], r["_quality"]): r["count"] for r in reached.groupBy("of", "step", "_quality").count().collect()}
    chosen = []
    for row, path in zip(strata, paths):
        count = lambda quality: [hits.get((row["stratum"], k, quality), 0) for k in range(len(path))]  # noqa: E731, B023
        lost, caught = count(1), count(0)
        admitted = passed(lost, row["n_good"], risk, error_rate / len(strata))
        gains = [sum(caught[:k]) / max(1, row["n_bad"]) - COST_OF_GOOD * sum(lost[:k]) / row["n_good"] for k in range(admitted + 1)]
        best = max(range(admitted + 1), key=lambda k: (gains[k], -k))
        if best:
            chosen.append((row["stratum"], dict(path[:best])))
    return chosen


def judge(docs: DataFrame, labels: DataFrame, stratum_column: str = "lang") -> DataFrame:
    """Measures of every document with stratum, base_failed, failed_rules and kept: (doc_id, ..., kept)."""
    measured = measures(docs.select("doc_id", "text", F.col(stratum_column).cast("string").alias("stratum"))).drop("text")
    return verdicts(materialize(measured, "measures"), labels)


def verdicts(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """failed_rules and kept for documents that `measures` has measured, with cutoffs from `labels`."""
    return decided(measured, calibrate(measured, labels))


def decided(measured: DataFrame, cutoffs: list[tuple[str | None, dict[str, float]]]) -> DataFrame:
    """measured with failed_rules and kept, by a small table of cutoffs."""
    rows = [{"_of": stratum} | {f"_{rule}_limit": limit for rule, limit in of.items()} for stratum, of in cutoffs]
    table = _table(measured.sparkSession, rows, "_of: string, " + ", ".join(f"_{rule}_limit: double" for rule in RULES))
    wide = measured.join(table, F.col("stratum").eqNullSafe(F.col("_of")), "left")
    failed = F.array_compact(F.array(*[F.when(_ratio(rule) > F.col(f"_{rule}_limit"), F.lit(rule)) for rule in RULES]))
    wide = wide.select(*[F.col(c) for c in measured.columns], failed.alias("failed_rules"))
    return wide.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, labels: DataFrame, stratum_column: str = "lang") -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns.

    Rows and their measures are written together, once; the verdict then reads no text but that of the kept rows.
    """
    rows = docs.select("doc_id", "text", F.col(stratum_column).cast("string").alias("stratum"), F.struct("*").alias("_row"))
    measured = materialize(measures(rows).drop("text"), "measured")
    return decided(measured, calibrate(measured.drop("_row"), labels)).where("kept").select("_row.*")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
