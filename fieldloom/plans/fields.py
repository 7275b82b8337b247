"""Which stored values a requested field stands for: a planner over the catalogued paths of an ingested store.

A request names a path as a user writes it: `age`, `profile.bio`, `orders[0].id`, `tags[1]`, `orders.id` (of every item), or a
key that itself has a dot (`we.ird`). The catalog knows paths with list places as [] and odd keys in quotes, so a name is
matched by its bare form on the cluster, and only the few rows that match reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.predicates import RequestError

#: A key in quotes, a list place, or a plain key.
TOKEN = re.compile(r"""\['([^']*)'\]|\["([^"]*)"\]|\[([0-9]*)\]|\.?([^.\[]+)""")
COLUMN_TYPES = {"integer": "bigint", "float": "double", "boolean": "boolean"}
NESTED = ("dict", "list", "mixed", "unknown")


@dataclass
class Field:
    name: str
    steps: list[str | int | None]  #: keys, list places, and None for every item
    kind: str  #: the most frequent semantic type
    group: str | None = None  #: the catalogued path of the repeating group or referenced value that holds it
    inside: int = 0  #: steps that the group's path has

    @property
    def top(self) -> str:
        return str(self.steps[0])


def tokens(path: str) -> list[str | int | None]:
    """The steps of a catalogued path; [] is None."""
    out: list[str | int | None] = []
    for single, double, place, key in TOKEN.findall(path):
        out.append(single or double or key or (int(place) if place else None))
    return out


def bare(path: str) -> str:
    return re.sub(r"\[[0-9]*\]", "", path)


def plain(path: Column) -> Column:
    """A catalogued path as a user writes it: without quotes."""
    return F.regexp_replace(F.regexp_replace(path, r"""\[(['"])(.*?)\1\]""", ".$2"), r"\A\.", "")


def aligned(steps: list[str | int | None], name: str) -> list[str | int | None]:
    """The steps with the list places that the name gives."""
    out, rest = [], name
    for step in steps:
        if step is None:
            found = re.match(r"\[([0-9]*)\]", rest)
            rest = rest[found.end() :] if found else rest
            out.append(int(found[1]) if found and found[1] else None)
        else:
            rest = rest.removeprefix(".").removeprefix(str(step))
            out.append(step)
    return out


def plan(names: list[str], counts: DataFrame, entities: DataFrame, changed: DataFrame | None = None) -> dict[str, Field]:
    """A Field for each name; counts (path, type, n), entities (path, kind) and changed (path) are the catalog.

    Where a quoted key and nested keys read alike, the quoted one is meant. A field that only updates have set is found by
    its first key. A RequestError tells the names that there are none of.
    """
    forms = sorted({bare(n) for n in names})
    if not forms:
        return {}
    matching = counts.groupBy("path").agg(F.max_by("type", "n").alias("kind")).withColumn("plain", plain(F.col("path"))).where(F.replace("plain", F.lit("[]"), F.lit("")).isin(forms)).collect()
    tops = sorted({f for name in names for f in prefixes(name)})
    groups = {r["path"]: r["kind"] for r in entities.where(F.col("path").isin(tops)).select("path", "kind").distinct().collect()}
    set_later = {r["path"] for r in changed.where(F.col("path").isin(tops)).select("path").distinct().collect()} if changed is not None else set()
    found, unknown = {}, []
    for name in names:
        general = re.sub(r"\[[0-9]+\]", "[]", name)
        rows = [r for r in matching if r["plain"] == general] or [r for r in matching if bare(r["plain"]) == bare(name)]
        split = tokens(name)
        if rows:
            best = min(rows, key=lambda r: (len(tokens(r["path"])), r["path"]))
            found[name] = Field(name, aligned(tokens(best["path"]), name), best["kind"])
        elif name in groups:
            found[name] = Field(name, [name], "list")
        elif split and str(split[0]) in set_later:
            found[name] = Field(name, split, "unknown")
        else:
            unknown.append(name)
            continue
        field = found[name]
        for n in range(1, len(field.steps) + 1):
            keys = field.steps[:n]
            if all(isinstance(k, str) for k in keys) and (path := ".".join(keys)) in groups:
                field.group, field.inside = path, n
    if unknown:
        raise RequestError(f"Fields do not exist: {', '.join(unknown)}")
    return found


def prefixes(name: str) -> list[str]:
    """The paths of keys that a name begins with."""
    keys = []
    for step in tokens(name):
        if not isinstance(step, str):
            break
        keys.append(step)
    return [".".join(keys[:n]) for n in range(1, len(keys) + 1)]


def json_path(steps: list[str | int]) -> str:
    """A path expression; keys with dots, brackets or quotes stand in quotes."""
    out = "$"
    for step in steps:
        if isinstance(step, int):
            out += f"[{step}]"
        elif re.search(r"""[.\[\]'"]""", step) or not step:
            out += f"['{step}']" if "'" not in step else f'["{step}"]'
        else:
            out += "." + step
    return out


def sub(value: Column, steps: list[str | int]) -> Column:
    return F.try_variant_get(value, json_path(steps), "variant") if steps else value


def items_at(value: Column, steps: list[str | int | None]) -> Column:
    """JSON of what the steps reach in every item; the steps hold None at least once."""
    at = steps.index(None)
    items = F.try_variant_get(sub(value, steps[:at]), "$", "array<variant>")
    return F.transform(items, lambda x: F.coalesce(json_at(x, steps[at + 1 :]), F.lit("null")))


def json_at(value: Column, steps: list[str | int | None]) -> Column:
    """JSON text of what the steps reach."""
    if None in steps:
        return F.concat(F.lit("["), F.array_join(items_at(value, steps), ","), F.lit("]"))
    return F.to_json(sub(value, steps))


def leaf(value: Column, steps: list[str | int | None], kind: str) -> Column:
    """What the steps reach, typed by its semantic type; nested values are JSON, and every item's an array of JSON."""
    if None in steps:
        return items_at(value, steps)
    reached = sub(value, steps)
    return F.to_json(reached) if kind in NESTED else F.try_variant_get(reached, "$", COLUMN_TYPES.get(kind, "string"))


def replaced(value: Column, steps: list[str | int], new: Column) -> Column:
    """A VARIANT with what the steps reach replaced; lacking dictionaries are made, list places must be there."""
    if not steps:
        return new
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):
        items = F.try_variant_get(value, "$", "array<variant>")
        text = F.transform(items, lambda x, i: F.to_json(F.when(i == step, replaced(x, rest, new)).otherwise(x)))
        return F.parse_json(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")))
    known = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    others = F.map_filter(known, lambda k, _: k != step)
    inner = replaced(F.try_variant_get(value, json_path([step]), "variant"), rest, new)
    return F.parse_json(F.to_json(F.map_concat(others, F.create_map(F.lit(step), inner))))
