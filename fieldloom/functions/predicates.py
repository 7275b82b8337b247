"""Filters of the request grammar as Column expressions."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class RequestError(ValueError):
    """A request that cannot be run; the text is the answer."""


COMPARISONS = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__, "$ne": Column.__ne__}


def condition(column: Column, wanted: Any) -> Column:
    """One entry of a filter. A value compares for equality; a missing or null field never matches, but $exists false."""
    if not isinstance(wanted, dict):
        return column.isNull() if wanted is None else column == wanted
    parts = []
    for operator, value in wanted.items():
        if operator == "$in":
            parts.append(column.isin(list(value)) if value else F.lit(False))
        elif operator == "$starts_with":
            parts.append(F.lower(column.cast("string")).startswith(str(value).lower()))
        elif operator == "$regex":
            flags = wanted.get("$options", "")
            parts.append(column.cast("string").rlike(f"(?{flags}){value}" if flags else value))
        elif operator == "$exists":
            parts.append(column.isNotNull() if value else column.isNull())
        elif operator in COMPARISONS:
            parts.append(COMPARISONS[operator](column, F.lit(value)))
        elif operator != "$options":
            raise RequestError(f"Unknown operator: {operator}")
    return reduce(Column.__and__, parts, F.lit(True))


def fits(kind: str, value: Any) -> bool:
    """Whether a literal can be compared with a column of a type (Spark's short name) at all."""
    if kind in ("bigint", "int", "double", "float", "smallint", "tinyint") or kind.startswith("decimal"):
        if isinstance(value, str):
            try:
                return math.isfinite(float(value)) and value.strip() != "" and (kind == "double" or kind == "float" or value.strip().lstrip("+-").isdigit())
            except ValueError:
                return False
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "boolean":
        return isinstance(value, bool)
    return not isinstance(value, (dict, list))


def typed(wanted: Any, kind: str | None) -> Any:
    """A filter entry without literals of other types, which match nothing: a row's value is never equal to one, nor in order with it."""
    if kind is None or wanted is None:
        return wanted
    if not isinstance(wanted, dict):
        return wanted if fits(kind, wanted) else {"$in": []}
    if any(op in ("$gt", "$gte", "$lt", "$lte") and not fits(kind, x) for op, x in wanted.items()):
        return {"$in": []}
    out = {op: [x for x in value if fits(kind, x)] if op == "$in" and isinstance(value, (list, tuple)) else value for op, value in wanted.items()}
    return {"$exists" if op == "$ne" and not fits(kind, x) else op: True if op == "$ne" and not fits(kind, x) else x for op, x in out.items()}


def predicate(filters: dict[str, Any] | None, columns: dict[str, Column], kinds: dict[str, str] | None = None) -> Column:
    """The conjunction of all entries; an empty filter holds for all rows. `kinds` has the columns' types, where known."""
    filters = {f: typed(w, (kinds or {}).get(f)) for f, w in (filters or {}).items()}
    unknown = [f for f in filters or {} if f not in columns]
    if unknown:
        raise RequestError(f"Fields do not exist: {', '.join(unknown)}")
    return reduce(Column.__and__, (condition(columns[f], w) for f, w in (filters or {}).items()), F.lit(True))
