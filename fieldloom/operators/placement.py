"""Where a field is kept: typed column (SQL), document (MongoDB), both, or a buffer until enough is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.types import SEMANTIC

# Limits of the zones in percent, and of the rules.
MANDATORY = ("username", "sys_ingested_at", "t_stamp")
HIGH, MEDIUM, STABLE, MODERATE = 75.0, 50.0, 85.0, 70.0
LEAST_OBSERVATIONS, NULL_LIMIT, DRIFT, SEVERE_DRIFT = 10, 0.05, 0.10, 0.25
MEDIUM_CONFIDENCE, BOOSTED_CONFIDENCE, BOOSTERS, BOOSTED_STABILITY = 0.60, 0.55, 2, 75.0


def identifying(name: Column) -> Column:
    """Names with id, uuid, session or key as a word of their own; _ and . count as borders."""
    return F.lower(name).rlike(r"(?:^|[^a-z0-9])(?:id|uuid|session|key)(?:$|[^a-z0-9])")


def place(stats: DataFrame, buffer: bool = True) -> DataFrame:
    """field_stats with zones, confidence, boosters, backend, reason and quarantined.

    `stats` may have distinct_ratio, the share of distinct values among samples. With `buffer`, fields seen less than
    ten times wait in the buffer; without it they go to documents at once.
    """
    f, s = F.col("frequency"), F.col("stability")
    semantic = F.col("dominant_type").isin(SEMANTIC)
    likely = (F.col("path") != "username") & identifying(F.col("path")) & (F.col("dominant_type").isin("uuid", "integer") | ((F.coalesce("distinct_ratio", F.lit(0.0)) > 0.9) if "distinct_ratio" in stats.columns else F.lit(False)))
    out = stats.withColumns(
        {
            "freq_zone": F.when((f >= HIGH) & (f <= 100), "high").when((f >= MEDIUM) & (f <= HIGH), "medium").otherwise("low"),
            "stab_zone": F.when(s >= STABLE, "stable").when(s >= MODERATE, "moderate").otherwise("unstable"),
            "confidence": (F.least(f / 80, F.lit(1.0)) + s / 100 + F.when(semantic, 0.8).otherwise(0.0)) / 3,
            "boosters": semantic.cast("int") + likely.cast("int") + (F.col("null_ratio") < NULL_LIMIT).cast("int"),
            "should_be_unique": likely,
        }
    )
    high = (F.col("freq_zone") == "high") & F.col("stab_zone").isin("stable", "moderate")
    medium = (F.col("freq_zone") == "medium") & (F.col("stab_zone") == "stable") & (F.col("confidence") >= MEDIUM_CONFIDENCE)
    boosted = (F.col("boosters") >= BOOSTERS) & (F.col("freq_zone") != "low") & (F.col("confidence") >= BOOSTED_CONFIDENCE) & (f >= MEDIUM) & (s >= BOOSTED_STABILITY)
    nested, few, drifting = F.col("dominant_type").isin("dict", "list"), F.col("appearances") < LEAST_OBSERVATIONS, F.col("drift") >= DRIFT
    backend = (
        F.when(F.col("path").isin(*MANDATORY), "Both")
        .when(nested, "MongoDB")
        .when(few, "Buffer" if buffer else "MongoDB")
        .when((high | medium | boosted) & ~drifting, "SQL")
        .otherwise("MongoDB")
    )
    head = (
        F.when(backend == "SQL", F.when(F.col("freq_zone") == "high", F.concat(F.lit("High frequency + "), "stab_zone", F.lit(" stability"))).when(F.col("boosters") >= BOOSTERS, F.format_string("Promoted by %d boosters", "boosters")).otherwise("Medium frequency with stable types"))
        .when(F.col("drift") >= SEVERE_DRIFT, "Severe drift quarantine")
        .when(drifting, "Type drift detected")
        .when(F.col("freq_zone") == "low", "Low frequency")
        .otherwise("Insufficient confidence for SQL")
    )
    details = F.concat_ws(
        ", ",
        F.format_string("freq_zone=%s(%.1f%%)", "freq_zone", f),
        F.format_string("stab_zone=%s(%.1f%%)", "stab_zone", s),
        F.format_string("confidence=%.2f", "confidence"),
        F.when(F.col("boosters") > 0, F.format_string("boosters=%d", "boosters")),
        F.when(drifting, F.format_string("drift=%.2f", "drift")),
    )
    reason = F.when(backend == "Both", "Mandatory field").when(nested, "Nested structure").when(few, "Too few observations").otherwise(F.concat(head, F.lit(" ["), details, F.lit("]")))
    judged = ~F.col("path").isin(*MANDATORY) & ~nested & ~few
    return out.withColumns({"backend": backend, "reason": reason, "quarantined": judged & (F.col("drift") >= SEVERE_DRIFT)})


def by_backend(placed: DataFrame) -> DataFrame:
    """(backend, n_fields, fields) of placements."""
    return placed.groupBy("backend").agg(F.count("*").alias("n_fields"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("fields"))
