"""Paths of nested values and the repeating groups among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.types import as_dict, as_list, bound, detect_type, numbered_name

_STRING, _BRACKET = r'"(?:[^"\\]++|\\.)*+"', r"[^\[\]{}]+"

#: Keys that a path has in quotes, and paths of one step.
ODD_KEY, TOP = r"""[.\[\]'"]|\A\z""", r"""\A(?:[^.\[]+|\['[^']*'\]|\["[^"]*"\])\z"""


def quoted(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("'")), F.concat(F.lit('["'), key, F.lit('"]'))).otherwise(F.concat(F.lit("['"), key, F.lit("']")))


def is_top(path: Column) -> Column:
    """Whether a path is a key of the record itself."""
    return path.rlike(TOP)


def top_of(path: Column) -> Column:
    """The first key of a path, as it is in the record."""
    first = F.regexp_extract(path, r"""\A(\['[^']*'\]|\["[^"]*"\]|[^.\[]+)""", 1)
    return F.regexp_replace(first, r"""\A\[['"]|['"]\]\z""", "")


def depth_of(text: Column) -> Column:
    """The greatest number of dictionaries and lists within one another in a JSON text."""
    brackets = F.regexp_replace(F.regexp_replace(text, _STRING, ""), _BRACKET, "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.greatest(s["most"], s["at"] + x).alias("most")), lambda s: s["most"])


def depth(records: DataFrame) -> int:
    """depth_of all records (v VARIANT)."""
    return records.agg(F.max(depth_of(F.to_json("v")))).first()[0] or 0


def walk(records: DataFrame, levels: int | None = None) -> DataFrame:
    """(record_key, path, value, type): one row for every node of records (record_key, v VARIANT), each once a record.

    Dictionary keys are joined by dots and list places stand in brackets; a key that has a dot, bracket or quote, or is empty,
    stands in brackets and quotes. All levels are visited, or `levels` of them.
    Each level puts a node's children beside the node in one pass, so that a record is parsed once and never shuffled.
    """
    nodes = _visited(records, depth(records) if levels is None else levels)
    return nodes.where("path <> ''").select("record_key", "path", "value", detect_type(F.col("value")).alias("type"))


def _visited(records: DataFrame, levels: int, nested: bool = False, into_lists: bool = True) -> DataFrame:
    """(record_key, path, value) of records and their nodes down to a level: all, or with `nested` dictionaries and lists only."""
    value, path, place, key = F.col("value"), F.col("path"), F.col("i") - 1, F.get("keys", F.col("i") - 1)
    keyed = F.when(key.rlike(ODD_KEY), F.concat(path, quoted(key))).otherwise(F.concat(path, F.when(path != "", ".").otherwise(""), key))
    step = F.when(F.col("keys").isNull(), F.concat(path, F.lit("["), place.cast("string"), F.lit("]"))).otherwise(keyed)
    nodes = records.select("record_key", F.lit("").alias("path"), F.col("v").alias("value"), F.lit(True).alias("open"))
    for _ in range(levels):
        nodes = nodes.withColumns({"dict": F.when(F.col("open"), as_dict(value)), "list": F.when(F.col("open") & F.lit(into_lists), as_list(value))})
        below = F.coalesce(F.col("list"), F.map_values("dict"), F.array().cast("array<variant>"))
        nodes = nodes.select("record_key", "path", F.map_keys("dict").alias("keys"), F.posexplode_outer(F.concat(F.array(value), below)).alias("i", "value"))
        if nested:
            nodes = nodes.where((F.col("i") == 0) | as_list(value).isNotNull() | as_dict(value).isNotNull())
        nodes = nodes.select("record_key", F.when(F.col("i") == 0, path).otherwise(step).alias("path"), "value", (F.col("i") > 0).alias("open"))
    return nodes.select("record_key", "path", "value")


def lists(records: DataFrame, levels: int, into_lists: bool = True) -> DataFrame:
    """(record_key, path, kind, items): what `repeating` tells of records (record_key, v VARIANT), with the items of each list:
    structs of value and keys, the map of a dictionary.

    Lists of odd keys, which `repeating` counts among their own items, are none. `levels` are those below which there is no such list; lists within lists are looked for only if asked. A list is judged by
    its own items, so nothing is shuffled. Here and in ingestion lists are exploded by the outer forms, before which Spark puts
    no filter that would work them out again.
    """
    found = _visited(records, levels, True, into_lists).select("record_key", "path", as_list(F.col("value")).alias("items"))
    items = F.transform("items", lambda x: F.struct(x.alias("value"), as_dict(x).alias("keys")))
    entity = lambda of: ~F.contains("path", F.lit("[")) & F.forall(of, lambda x: x["keys"].isNotNull())
    primitive = lambda of: ~F.exists(of, lambda x: x["keys"].isNotNull() | as_list(x["value"]).isNotNull())
    named = ~F.col("path").rlike(r"""['"]\]\z""")
    kind = lambda of: F.when(named & (F.size(of) > 0), F.when(entity(of), "entity").when(primitive(of), "primitive"))
    judged = bound(items, lambda of: F.struct(of.alias("items"), kind(of).alias("kind")))
    return found.select("record_key", "path", F.explode_outer(F.array(judged)).alias("x")).select("record_key", "path", "x.kind", "x.items").where("kind is not null")


def repeating(nodes: DataFrame) -> DataFrame:
    """(record_key, path, kind, n_items): lists that are all objects (`entity`, not inside lists) or all scalars (`primitive`)."""
    items = nodes.where(F.col("path").endswith("]")).withColumn("parent", F.regexp_replace("path", r"\[[0-9]+\]\z", ""))
    sizes = items.groupBy("record_key", F.col("parent").alias("path")).agg(
        F.count("*").alias("n_items"), F.count_if(F.col("type") == "dict").alias("n_dict"), F.count_if(~F.col("type").isin("dict", "list")).alias("n_scalar")
    )
    kind = F.when((F.col("n_dict") == F.col("n_items")) & ~F.contains("path", F.lit("[")), "entity").when(F.col("n_scalar") == F.col("n_items"), "primitive")
    return sizes.withColumn("kind", kind).where("kind is not null").select("record_key", "path", "kind", "n_items")


def scalar_groups(nodes: DataFrame, core: tuple[str, ...] = ("username", "sys_ingested_at", "t_stamp")) -> DataFrame:
    """(record_key, base, names, texts, values): two or more top-level scalars base1, base2, ..., ordered by number; values are JSON."""
    base, number = numbered_name(F.col("path"))
    top = nodes.where(~F.col("path").rlike(r"[.\[]") & ~F.col("type").isin("dict", "list") & ~F.col("path").isin(*core))
    rows = top.select("record_key", base.alias("base"), number.cast("long").alias("number"), "path", F.try_variant_get("value", "$", "string").alias("text"), F.to_json("value").alias("json")).where("base <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("number", "path", "text", "json")))
    groups = rows.groupBy("record_key", "base").agg(ordered.alias("items")).where(F.size("items") >= 2)
    return groups.select("record_key", "base", F.expr("transform(items, x -> x.path)").alias("names"), F.expr("transform(items, x -> x.text)").alias("texts"), F.expr("transform(items, x -> x.json)").alias("values"))


def flatten(nodes: DataFrame) -> DataFrame:
    """(record_key, name, text) from nodes (record_key, path, type, value): dictionaries unfolded into names joined by _, lists as JSON."""
    leaves = nodes.where(~F.contains("path", F.lit("[")) & (F.col("type") != "dict"))
    text = F.when(F.col("type") == "list", F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    return leaves.select("record_key", F.replace("path", F.lit("."), F.lit("_")).alias("name"), text.alias("text"))
