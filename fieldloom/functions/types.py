"""Semantic types of JSON values, as Column expressions over VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the string family (ASCII digits, whole string but for the timestamp), tested in this order,
# and the SQL column type of each semantic type.
UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
IP = r"\A(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z"
EMAIL = r"\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
URL = r"\Ahttps?://[^\s]+\z"
TIMESTAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
SQL_TYPES = {"boolean": "BOOLEAN", "integer": "INTEGER", "float": "REAL", "uuid": "VARCHAR(36)", "ip_address": "VARCHAR(15)", "email": "VARCHAR(255)", "timestamp": "TIMESTAMP"}
SEMANTIC = ["uuid", "email", "ip_address", "timestamp", "url", "phone", "datetime", "date"]


def string_type(text: Column) -> Column:
    """The semantic type of a string."""
    octets = F.forall(F.split(text, r"\."), lambda x: x.try_cast("int") <= 255)
    return (
        F.when(text == "", "string")
        .when(text.rlike(UUID), "uuid")
        .when(text.rlike(IP), F.when(octets, "ip_address").otherwise("string"))
        .when(text.rlike(EMAIL), "email")
        .when(text.rlike(URL), "url")
        .when(text.rlike(TIMESTAMP), "timestamp")
        .otherwise("string")
    )


def as_dict(value: Column) -> Column:
    """A VARIANT dictionary as a map; null for other values."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_list(value: Column) -> Column:
    """A VARIANT list as an array; null for other values."""
    return F.try_variant_get(value, "$", "array<variant>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) where value is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def detect_type(value: Column) -> Column:
    """The semantic type of a VARIANT value; any number with a point or exponent is a float, whole ones of any size are integers.

    Nested values are told by their own kind first, as the schema of one is that of all that it holds.
    """
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    plain = F.create_map(*map(F.lit, ("BIGINT", "integer", "BOOLEAN", "boolean", "DOUBLE", "float", "FLOAT", "float")))
    whole = kind.startswith("DECIMAL") & text.rlike(r"\A-?[0-9]{19,}\z")
    rest = F.when(kind == "STRING", string_type(text)).when(whole, "integer").when(kind.startswith("DECIMAL"), "float").otherwise("unknown")
    return (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(as_list(value).isNotNull(), "list")
        .when(as_dict(value).isNotNull(), "dict")
        .otherwise(F.coalesce(F.try_element_at(plain, kind), rest))
    )


def sql_type(semantic: Column) -> Column:
    """The column type for a semantic type; TEXT where none is fixed."""
    table = F.create_map(*[F.lit(x) for pair in SQL_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, semantic), F.lit("TEXT"))


def identifier(name: Column) -> Column:
    """A column name: other signs become _, an empty name is `field`, a leading digit gets f_ in front."""
    plain = F.regexp_replace(name, r"(?U)[^\p{Alnum}_]", "_")
    return F.when(plain == "", "field").when(plain.rlike(r"(?U)\A\p{Digit}"), F.concat(F.lit("f_"), plain)).otherwise(plain)


def entity_name(path: Column) -> Column:
    """A table name part for a path: dots and opening brackets become _, closing brackets go."""
    return F.translate(path, ".[]", "__")


def depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def numbered_name(name: Column) -> tuple[Column, Column]:
    """Base and number of a name that ends in digits; empty strings for others."""
    pattern = r"\A([A-Za-z_][A-Za-z0-9_]*?)([0-9]+)\z"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def duration(seconds: Column) -> Column:
    """Seconds as `1d 2h 3m`, without leading zero parts."""
    days, hours, minutes = F.floor(seconds / 86400), F.floor(F.pmod(seconds, F.lit(86400)) / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.concat_ws(" ", F.when(days > 0, F.concat(days, F.lit("d"))), F.when((days > 0) | (hours > 0), F.concat(hours, F.lit("h"))), F.concat(minutes, F.lit("m")))


def iso_time(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time; without an offset it is UTC, and what is none is null."""
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\z"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_seconds(F.try_to_timestamp(F.replace(zoned, F.lit("T"), F.lit(" "))))


def scalar_type(semantic: Column) -> Column:
    """Whether a semantic type fits a typed column: all but lists, dictionaries and unknown ones."""
    return semantic.isin("null", "string", "url", *SQL_TYPES)
