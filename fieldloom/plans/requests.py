"""JSON requests on one logical record view: read, insert, update, delete.

On a store filled by streaming.ingest, requests go through plans.logical: inserts are ingested, updates and deletions are
written beside the records. On plain tables they change the table's snapshot.
"""

from __future__ import annotations

import re
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.predicates import RequestError, predicate
from fieldloom.plans import logical
from fieldloom.plans.logical import CORE, without_conflicts  # noqa: F401
from fieldloom.sources.store import ConflictError, SnapshotStore

OPERATIONS = ("read", "insert", "update", "delete")
DEFAULT_LIMIT = 100


def read(view: DataFrame, request: dict[str, Any], key: str = "sys_ingested_at") -> DataFrame:
    """The rows a read request asks for, in key order; Catalyst prunes what the fields and filters do not need.

    The limit is DEFAULT_LIMIT where the request has none. With `limit: null` there is no page: all rows, in no order, so that
    nothing runs through a single task.
    """
    limit, offset = whole_number(request, "limit", DEFAULT_LIMIT), whole_number(request, "offset", 0)
    fields = request.get("fields") or view.columns
    unknown = [f for f in fields if f not in view.columns and f not in CORE]
    if unknown:
        raise RequestError(f"Fields do not exist: {', '.join(unknown)}")
    wanted = [c for c in dict.fromkeys([*without_conflicts(list(fields)), *CORE]) if c in view.columns]
    rows = view.where(predicate(request.get("filters"), {c: F.col(f"`{c}`") for c in view.columns}, dict(view.dtypes)))
    if limit is not None or offset:
        rows = rows.orderBy(key) if key in view.columns else rows
        rows = rows.offset(offset) if offset else rows
        rows = rows.limit(limit) if limit is not None else rows
    return rows.select(*[F.col(f"`{c}`") for c in wanted])


def whole_number(request: dict[str, Any], name: str, default: int) -> int | None:
    """A number of a request that is 0 or more; null is None."""
    value = request.get(name, default)
    if value is None:
        return None
    if isinstance(value, bool) or not re.fullmatch(r"[0-9]+", str(value).removesuffix(".0")):
        raise RequestError(f"'{name}' is no whole number: {value}")
    return int(float(value))


def checked_patterns(store: SnapshotStore, filters: Any) -> None:
    """A RequestError for filters that are no dictionary and for patterns that Java cannot read."""
    if filters is not None and not isinstance(filters, dict):
        raise RequestError("'filters' is no dictionary")
    for name, wanted in (filters or {}).items():
        if isinstance(wanted, dict) and "$regex" in wanted:
            flags = str(wanted.get("$options", ""))
            try:
                store.spark._jvm.java.util.regex.Pattern.compile(f"(?{flags}){wanted['$regex']}" if flags else str(wanted["$regex"]))
            except Exception as error:
                raise RequestError(f"Bad pattern for '{name}': {wanted['$regex']}") from error


def entity_rows(store: SnapshotStore, entity: str, children: dict[str, str] | None, version: int) -> tuple[str, Column]:
    """The table that has an entity's rows, and which of its rows these are."""
    manifest = store.manifest(version)
    if entity in (children or {}) and entity in manifest:
        return entity, F.lit(True)
    if "children" in manifest and {"path", "entity"} <= set(store.read("children", version).columns):
        mine = F.col("path").eqNullSafe(entity) | F.col("entity").eqNullSafe(entity)
        if not store.read("children", version).where(mine).isEmpty():
            return "children", mine
    raise RequestError(f"Unknown entity: {entity}")


def checked(store: SnapshotStore, table: str, rows: DataFrame, version: int) -> DataFrame:
    """Rows for a table: keys that begin with _ dropped, names cleaned, and values held against the column types it has."""
    names = {c: re.sub(r"\W", "_", c) for c in rows.columns if not c.startswith("_")}
    rows = rows.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()])
    if table not in store.manifest(version):
        return rows
    kinds = {f.name: f.dataType for f in store.read(table, version).schema}
    for f in rows.schema:
        kind = kinds.get(f.name)
        if kind is not None and f.dataType != kind and f.dataType.typeName() != "void":
            widening = (f.dataType.typeName(), kind.typeName()) in {("long", "double"), ("integer", "long"), ("integer", "double")} or kind.typeName() == "string"
            if not widening:
                raise RequestError(f"Type conflict for '{f.name}': expected {kind.simpleString()}, got {f.dataType.simpleString()}")
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])


def execute(store: SnapshotStore, request: dict[str, Any], root: str = "records", key: str = "sys_ingested_at", children: dict[str, str] | None = None) -> dict[str, Any]:
    """Run one request against the store's root table, or the rows of its `entity`; an answer has success and data or error.

    Every failure aborts what was staged and is an answer. `children` has the tables of child rows with their parent column.
    """
    operation = str(request.get("operation", "")).strip().lower()
    request = request | {"operation": operation}
    transaction = None
    try:
        if operation not in OPERATIONS:
            raise RequestError(f"Unsupported operation: {operation}; supported: {', '.join(OPERATIONS)}")
        base = store.version()
        checked_patterns(store, request.get("filters"))
        if root == "records" and "counts" in store.manifest(base):
            return logical.execute(store, request, base)
        entity = request.get("entity")
        table, mine = entity_rows(store, entity, children, base) if entity and entity != root else (root, F.lit(True))
        if operation == "read":
            return {"success": True, "data": read(store.read(table, base).where(mine), request, key)}
        transaction = store.begin()
        if operation == "insert":
            data = request.get("data")
            if not data:
                raise RequestError("Missing 'data' for insert")
            rows = data if isinstance(data, list) else [data]
            try:
                frame = store.spark.createDataFrame(rows, samplingRatio=1.0)
            except Exception as error:
                raise RequestError(f"Records of one insert differ in type: {error}") from error
            transaction.insert(table, checked(store, table, frame, base), key if table == root else None)
            count = {"inserted": len(rows)}
        else:
            view = store.read(table, transaction.base)
            where = mine & predicate(logical.guarded(request), {c: F.col(f"`{c}`") for c in view.columns}, dict(view.dtypes))
            count = {f"{operation}d": view.where(where).count()}
            if operation == "update":
                if not request.get("data"):
                    raise RequestError("Missing 'data' for update")
                if nested := [c for c, x in request["data"].items() if isinstance(x, (dict, list))]:
                    raise RequestError(f"Nested values need an ingested store: {', '.join(nested)}")
                changes = checked(store, table, store.spark.createDataFrame([request["data"]]), transaction.base)
                transaction.update(table, where, {c: F.lit(request["data"][c]).cast(changes.schema[c].dataType) for c in changes.columns})
            else:
                transaction.delete(table, where, key if table == root else None, children if table == root else None)
        return {"success": True, "version": transaction.commit(), **count}
    except (RequestError, ConflictError) as error:
        return {"success": False, "error": str(error)}
    except (PySparkException, Py4JError, RuntimeError, ValueError, TypeError, KeyError) as error:
        return {"success": False, "error": f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"}
    finally:
        if transaction is not None and transaction.state != "committed":
            transaction.abort()


def sanitized(answer: dict[str, Any]) -> dict[str, Any]:
    """An answer as users see it: how many rows went from all parts together, and nothing about where they were."""
    out = {k: answer[k] for k in ("success", "error", "data", "inserted", "updated") if k in answer}
    return out | ({"deleted": sum((answer.get("parts") or {"records": answer["deleted"]}).values())} if "deleted" in answer else {})
