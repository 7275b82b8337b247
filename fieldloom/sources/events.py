"""Record sources: server-sent event lines, landing folders of JSON, and a generator of test records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """(raw, v, rejected) of the lines that start with `data: `; those that are no JSON are marked and have a null v."""
    data = lines.where(F.col(column).startswith("data: ")).select(F.substring(column, 7, 1 << 30).alias("raw"))
    return data.withColumn("v", F.try_parse_json("raw")).withColumn("rejected", F.col("v").isNull())


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def stream_landing(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    return parse_events(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def enrich(records: DataFrame, seq: Column, now: Column | None = None) -> DataFrame:
    """records (v) with record_key, username and t_stamp: the server's time and a number make the key, the client's
    t_stamp stays, else its timestamp, else the server's time."""
    now = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    return records.withColumns(
        {
            "record_key": F.concat(now, F.lit("."), F.when(F.length(seq.cast("string")) < 8, F.lpad(seq.cast("string"), 8, "0")).otherwise(seq.cast("string"))),
            "username": F.coalesce(text("username"), F.lit("unknown_user")),
            "t_stamp": F.coalesce(text("t_stamp"), text("timestamp"), now),
        }
    )


def generate(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """n records (raw JSON) of users with optional scalars, a profile, orders, comments and devices."""

    def draw(name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(1_000_000)) / 1_000_000.0

    def some(name: str, share: float, value: Column) -> Column:
        return F.when(draw(name) < share, value).alias(name)

    def pick(name: str, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (draw(name + "?") * len(values)).cast("int") + 1)

    def items(name: str, most: int, body) -> Column:
        return F.transform(F.sequence(F.lit(1), (draw(name + "#") * most).cast("int") + 1), body)

    order = lambda i: F.struct(F.concat(F.lit("o-"), "id", F.lit("-"), i).alias("order_id"), pick("item", ["pen", "book", "lamp"]).alias("item"), i.alias("quantity"), F.round(draw("price") * 100 * i, 2).alias("price"))
    record = F.struct(
        F.concat(F.lit("user_"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000))).alias("username"),
        some("age", 0.7, (draw("years") * 60 + 18).cast("int")),
        some("email", 0.8, F.concat(F.lit("user"), "id", F.lit("@example.com"))),
        some("ip_address", 0.4, F.concat(F.lit("10.0."), (draw("a") * 256).cast("int"), F.lit("."), (draw("b") * 256).cast("int"))),
        some("is_active", 0.6, draw("active") < 0.5),
        some("timestamp", 0.9, F.date_format(F.timestamp_seconds(F.col("id") + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss")),
        some("profile", 0.82, F.struct(pick("language", ["en", "fr", "de"]).alias("language"), F.struct((draw("n") < 0.5).alias("notifications")).alias("preferences"))),
        some("orders", 0.78, items("orders", 6, order)),
        some("comments", 0.68, items("comments", 4, lambda i: F.struct(F.concat(F.lit("c-"), "id", F.lit("-"), i).alias("comment_id"), pick("text", ["good", "bad"]).alias("text")))),
        some("devices", 0.62, items("devices", 5, lambda i: F.struct(F.concat(F.lit("d-"), "id", F.lit("-"), i).alias("device_id"), (draw("battery") * 100).cast("int").alias("battery")))),
    )
    return spark.range(n).select(F.to_json(record).alias("raw"))
