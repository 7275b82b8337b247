"""The logical record view of an ingested store, and requests on it.

A record is put together at read: its document, the newest change of each field, child rows of its repeating groups and the
payloads kept apart for it. A filter on fields of the document is applied before anything is joined, and then only children
and payloads of the records that it left are shuffled.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.predicates import RequestError, predicate
from fieldloom.functions.types import bound, detect_type, numbered_name
from fieldloom.operators.overlay import changed_fields, without_deleted
from fieldloom.operators.paths import is_top, scalar_groups, top_of
from fieldloom.operators.profile import text_counts
from fieldloom.plans import fields as planner
from fieldloom.plans import layout
from fieldloom.plans.fields import Field
from fieldloom.sources.store import SnapshotStore
from fieldloom.streaming import ingest

CORE = ("username", "sys_ingested_at", "t_stamp")
KEY = "sys_ingested_at"


def without_conflicts(fields: list[str]) -> list[str]:
    """Paths of which none is below another; of list places of one list the first in order stays."""
    kept: list[str] = []
    for path in sorted(dict.fromkeys(fields)):
        outer = any(path.startswith((k + ".", k + "[")) for k in kept)
        stem, bracket, _ = path.rpartition("[")
        twin = bracket and any(k.startswith(stem + "[") for k in kept)
        if not outer and not twin:
            kept.append(path)
    return kept


def guarded(request: dict[str, Any]) -> dict[str, Any]:
    filters = request.get("filters") or {}
    if not filters and not request.get("allow_all"):
        raise RequestError(f"{request['operation']} needs filters or allow_all")
    return filters


def known_fields(store: SnapshotStore, names: list[str], version: int | None = None) -> dict[str, Field]:
    """The plan of each name that is no core field."""
    changed = store.read("changes", version) if "changes" in store.manifest(version) else None
    return planner.plan([n for n in names if n not in CORE], store.read("counts", version), store.read("entities", version), changed)


def top_fields(store: SnapshotStore, version: int | None = None) -> list[str]:
    """Every field of a record: the keys that are catalogued, those that updates have added, and groups of numbered scalars."""
    tops = store.read("counts", version).where(is_top(F.col("path"))).select(planner.plain(F.col("path")).alias("path"))
    if "changes" in store.manifest(version):
        tops = tops.union(store.read("changes", version).where("not mark").select("path"))
    return sorted(r["path"] for r in tops.distinct().collect() if r["path"] not in CORE)


def base_rows(store: SnapshotStore, tops: list[str], version: int | None, records: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """(key, username, t_stamp, seq, doc, ...) of all records, or of those given, and the VARIANT of each first key, with its newest change."""
    manifest = store.manifest(version)
    rows = without_deleted(store.read("records", version) if records is None else records, KEY, store.read("tombstones", version) if "tombstones" in manifest else None)
    rows = rows.select(KEY, "username", "t_stamp", "seq", F.parse_json("raw").alias("doc"))
    at = {top: F.try_variant_get("doc", planner.json_path([top]), "variant") for top in tops}
    if "changes" not in manifest:
        return rows, at
    names = [*tops, "username", "t_stamp"]
    rows = rows.join(changed_fields(store.read("changes", version), names), KEY, "left")
    now = lambda i, before, kind=None: F.when(F.col(f"n{i}").isNotNull(), F.parse_json(f"c{i}") if kind is None else F.try_variant_get(F.parse_json(f"c{i}"), "$", kind)).otherwise(before)
    n = len(tops)
    rows = rows.withColumns({"username": now(n, F.col("username"), "string"), "t_stamp": now(n + 1, F.col("t_stamp"), "string")})
    return rows, {top: now(i, at[top]) for i, top in enumerate(tops)}


def group_items(store: SnapshotStore, path: str, keys: DataFrame | None, version: int | None) -> DataFrame:
    """(key, items, whole): JSON of a group's items in order for each record that has any, of `keys` if these are given.

    Payloads kept apart are taken where a record has them, else its child rows; whole is that of a dictionary kept apart.
    """
    children = ingest.live(store, "children", version).where(F.col("path") == path)
    both = F.concat(F.left("item", F.length("item") - 1), F.lit(","), F.substring("rest", 2, 1 << 30))
    item = F.when(F.col("rest").isNull(), F.col("item")).otherwise(both)
    rows = children.select(F.col("parent_sys_ingested_at").alias(KEY), F.lit(True).alias("near"), F.lit(False).alias("whole"), "item_index", item.alias("json"))
    payloads = ingest.live(store, "references", version).where(top_of(F.col("entity_path")) == path)
    rows = rows.unionByName(payloads.select(F.col("parent_sys_ingested_at").alias(KEY), F.lit(False).alias("near"), "whole", "item_index", F.col("payload").alias("json")))
    if keys is not None:
        rows = rows.join(keys.select(KEY), KEY, "left_semi")
    grouped = rows.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("near", "item_index", "json"))).alias("all"), F.bool_or("whole").alias("whole"))
    chosen = lambda of: F.transform(F.filter(of, lambda x: x["near"] == F.get(of, F.lit(0))["near"]), lambda x: x["json"])
    return grouped.select(KEY, bound(F.col("all"), chosen).alias("items"), "whole")


def field_column(field: Field, tops: dict[str, Column], groups: list[str]) -> Column:
    """The value of a planned field in a row that has its first keys and its groups' items."""
    if field.group is None:
        return planner.leaf(tops[field.top], field.steps[1:], field.kind)
    at = groups.index(field.group)
    items, rest = F.coalesce(F.col(f"items{at}"), F.array().cast("array<string>")), field.steps[field.inside :]
    whole = F.coalesce(F.col(f"whole{at}"), F.lit(False))
    dictionary = F.when(whole, F.parse_json(F.get(items, F.lit(0)))).otherwise(tops[field.top])
    if field.kind == "dict" and not rest:
        return F.to_json(dictionary)
    if rest and isinstance(rest[0], str):
        return planner.leaf(dictionary, rest, field.kind)
    if not rest or rest == [None]:
        return items
    value = F.parse_json(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    scalars = F.when(whole, value).otherwise(value)
    return planner.leaf(unwrapped(scalars) if len(rest) == 1 else scalars, rest, field.kind)


def unwrapped(items: Column) -> Column:
    """A list whose items are {"value": x} as the list of x; other items stay."""
    one = lambda x: F.when((F.size(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))) == 1) & F.try_variant_get(x, "$.value", "variant").isNotNull(), F.try_variant_get(x, "$.value", "variant")).otherwise(x)
    return F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get(items, "$", "array<variant>"), lambda x: F.to_json(one(x))), ","), F.lit("]")))


def logical_view(store: SnapshotStore, names: list[str], version: int | None = None, filters: dict[str, Any] | None = None) -> DataFrame:
    """Records with core fields and the named ones, those that the filters hold for.

    Scalars are typed by their catalogued type, repeating groups and referenced lists are arrays of JSON in item order, other
    nested values JSON text.
    """
    asked = [n for n in dict.fromkeys([*names, *(filters or {})]) if n not in CORE]
    plans = known_fields(store, asked, version)
    tops_needed = sorted({f.top for f in plans.values()})
    rows, tops = base_rows(store, tops_needed, version)
    columns = {c: F.col(c) for c in CORE}
    direct = {n: field_column(f, tops, []) for n, f in plans.items() if f.group is None}
    early = {n: w for n, w in (filters or {}).items() if n in direct or n in CORE}
    late = {n: w for n, w in (filters or {}).items() if n not in early}
    kinds = {n: planner.COLUMN_TYPES.get(f.kind, "string") for n, f in plans.items() if f.group is None}
    if early:
        rows = rows.where(predicate(early, columns | direct, kinds | dict.fromkeys(CORE, "string")))
    groups = sorted({f.group for f in plans.values() if f.group is not None})
    keys = rows.select(KEY) if early else None
    for i, path in enumerate(groups):
        rows = rows.join(group_items(store, path, keys, version).toDF(KEY, f"items{i}", f"whole{i}"), KEY, "left")
    out = {n: field_column(f, tops, groups) for n, f in plans.items()}
    view = rows.select(*CORE, *[c.alias(n) for n, c in out.items()])
    return view.where(predicate(late, {n: F.col(f"`{n}`") for n in late}, dict(view.dtypes))) if late else view


def entity_path(store: SnapshotStore, entity: str, version: int | None) -> str:
    """The path of a group, by that or by its table's name."""
    found = store.read("children", version).where((F.col("path") == entity) | (F.col("entity") == entity)).select("path").limit(1).collect()
    if not found:
        raise RequestError(f"Unknown entity: {entity}")
    return found[0]["path"]


def entity_columns(store: SnapshotStore, path: str, version: int | None = None) -> dict[str, str]:
    """The columns of a group's child table with their types: integers and floats together are double, other mixtures text."""
    below = store.read("counts", version).where(F.col("path").startswith(f"{path}[]")).select("path", "type").distinct().collect()
    kinds: dict[str, set[str]] = {}
    for r in below:
        name = r["path"].removeprefix(f"{path}[]")
        if name == "" or (name.startswith(".") and not re.search(r"[.\[]", name[1:])):
            kinds.setdefault(name[1:] or "value", set()).add(r["type"])
    columns = {}
    for name, of in sorted(kinds.items()):
        of = of - {"null"}
        if of & {"dict", "list"} or not of:
            continue
        columns[name] = planner.COLUMN_TYPES.get(next(iter(of)), "string") if len(of) == 1 else "double" if of == {"integer", "float"} else "string"
    return columns or {"value": "string"}


def child_table(store: SnapshotStore, entity: str, version: int | None = None) -> DataFrame:
    """(parent_sys_ingested_at, item_index, ...): the rows of a group with a typed column for each catalogued scalar of its items."""
    return layout.child_rows(store, entity_path(store, entity, version), version)


def describe(store: SnapshotStore, version: int | None = None) -> DataFrame:
    """(entity, column, type): the columns of the logical root (`records`) and of each child table."""
    counts = store.read("counts", version).groupBy("path").agg(F.max_by("type", "n").alias("type"))
    root = counts.where(is_top(F.col("path"))).select(F.lit("records").alias("entity"), planner.plain(F.col("path")).alias("column"), "type")
    lists = store.read("entities", version).where("kind = 'children'").select(F.col("path").alias("entity"))
    split = counts.select(F.regexp_extract("path", r"\A([^\[]+)\[\](?:\.([^.\[]+))?\z", 1).alias("entity"), F.regexp_extract("path", r"\A([^\[]+)\[\](?:\.([^.\[]+))?\z", 2).alias("column"), "type").where("entity <> ''")
    children = split.join(lists, "entity").where(~F.col("type").isin("dict", "list")).select("entity", F.when(F.col("column") == "", "value").otherwise(F.col("column")).alias("column"), "type")
    return root.unionByName(children)


def execute(store: SnapshotStore, request: dict[str, Any], base: int) -> dict[str, Any]:
    """Run one request on an ingested store; the caller turns errors into answers."""
    operation, entity = request["operation"], request.get("entity")
    if entity and entity != "records":
        return {"read": read_entity, "delete": delete_entity}.get(operation, refuse)(store, request, base)
    return {"read": read_records, "insert": insert, "update": update, "delete": delete}[operation](store, request, base)


def refuse(store: SnapshotStore, request: dict[str, Any], base: int) -> dict[str, Any]:
    raise RequestError(f"{request['operation']} is not for the rows of an entity: {request['entity']}")


def read_records(store: SnapshotStore, request: dict[str, Any], base: int) -> dict[str, Any]:
    from fieldloom.plans.requests import read

    wanted = without_conflicts(list(request.get("fields") or top_fields(store, base)))
    view = logical_view(store, wanted, base, request.get("filters"))
    return {"success": True, "data": read(view, {k: request[k] for k in ("limit", "offset") if k in request} | {"fields": wanted})}


def read_entity(store: SnapshotStore, request: dict[str, Any], base: int) -> dict[str, Any]:
    from fieldloom.plans.requests import read

    rows = child_table(store, request["entity"], base)
    fields = [*dict.fromkeys(["parent_sys_ingested_at", "item_index", *(request.get("fields") or rows.columns)])]
    return {"success": True, "data": read(rows, request | {"fields": fields}, "parent_sys_ingested_at")}


def insert(store: SnapshotStore, request: dict[str, Any], base: int) -> dict[str, Any]:
    """Ingest the records as one batch with generated keys: all of them or none."""
    data = request.get("data")
    if not data:
        raise RequestError("Missing 'data' for insert")
    records = data if isinstance(data, list) else [data]
    if not all(isinstance(r, dict) for r in records):
        raise RequestError("A record is no dictionary")
    check_types(store, records, base)
    texts = [(json.dumps({k: v for k, v in r.items() if not k.startswith("_") and k != KEY}),) for r in records]
    raw = store.spark.createDataFrame(texts, "raw string")
    number = store.read("batches", base).where("kind = 'insert'").count()
    batch = raw.withColumn("v", F.try_parse_json("raw")).withColumn("rejected", F.col("v").isNull())
    seen = ingest.ingest_batch(store, batch, number, kind="insert")
    if not seen:
        raise RequestError("Another insert was faster")
    return {"success": seen["rejected"] == 0, "version": store.version(), "inserted": seen["accepted"], "failed": seen["rejected"]}


def check_types(store: SnapshotStore, records: list[dict[str, Any]], base: int) -> None:
    """A RequestError for a value that does not fit the typed column of its field."""
    names = sorted({k for r in records for k in r})
    columns = {r["path"]: r["dominant_type"] for r in store.read("placements", base).where(F.col("path").isin(names) & F.col("backend").isin("SQL", "Both")).select("path", "dominant_type").collect()}
    wanted = {"integer": lambda x: isinstance(x, int) and not isinstance(x, bool), "float": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "boolean": lambda x: isinstance(x, bool)}
    for record in records:
        for name, value in record.items():
            fits = wanted.get(columns.get(name))
            if value is not None and fits and not fits(value):
                raise RequestError(f"Type conflict for '{name}': expected {columns[name]}, got {json.dumps(value)}")


def hit_records(store: SnapshotStore, change, filters: dict[str, Any], base: int) -> DataFrame:
    """The keys that filters hold for, written once."""
    return change.scratch(logical_view(store, [], base, filters).select(KEY))


def update(store: SnapshotStore, request: dict[str, Any], base: int) -> dict[str, Any]:
    """Write the new values beside the records: a row for each record hit and field, and what is derived from these fields.

    Names may be paths into a field, which then is written whole. A field that is new is readable from then on. A nested
    value replaces the child rows and payloads of its field.
    """
    filters, data = guarded(request), request.get("data")
    if not isinstance(data, dict) or not data:
        raise RequestError("Missing 'data' for update")
    if KEY in data:
        raise RequestError(f"'{KEY}' cannot be changed")
    check_types(store, [data], base)
    change, number, seen = store.begin(), base + 1, dict.fromkeys(ingest.COUNTERS, 0)
    try:
        hits = hit_records(store, change, filters, base)
        if not (n := hits.count()):
            change.abort()
            return {"success": True, "version": base, "updated": 0}
        plans = update_plans(store, data, base)
        tops = sorted({str(steps[0]) for steps in plans.values()})
        whole = {top: group for top, group in zip(tops, [current_top(store, top, base) if any(len(s) > 1 and s[0] == top for s in plans.values()) else None for top in tops])}
        rows, at = base_rows(store, tops, base)
        rows = rows.join(hits, KEY, "left_semi")
        for i, top in enumerate(tops):
            if whole[top]:
                rows = rows.join(group_items(store, top, hits, base).toDF(KEY, f"u{i}", f"w{i}"), KEY, "left")
                listed = F.parse_json(F.concat(F.lit("["), F.array_join(f"u{i}", ","), F.lit("]")))
                at[top] = F.when(F.col(f"w{i}"), F.parse_json(F.get(f"u{i}", F.lit(0)))).when(F.size(f"u{i}") > 0, unwrapped(listed)).otherwise(at[top])
            for name, steps in plans.items():
                if steps[0] == top:
                    at[top] = planner.replaced(at[top], list(steps[1:]), F.parse_json(F.lit(json.dumps(data[name]))))
        new = rows.select(KEY, "seq", F.explode(F.array(*[F.struct(F.lit(top).alias("path"), F.to_json(at[top]).alias("value")) for top in tops])).alias("x")).select(KEY, "seq", "x.*")
        new = change.scratch(new)
        derive_changes(store, change, new, base, number, seen)
        ingest.note(change, None, "update", seen | {"updated": n})
        return {"success": True, "version": change.commit(), "updated": n}
    finally:
        if change.state != "committed":
            change.abort()


def update_plans(store: SnapshotStore, data: dict[str, Any], base: int) -> dict[str, list[str | int]]:
    """The steps that each name of an update stands for; a name that is not known is a new field, or split at its dots."""
    plans = {}
    for name in data:
        try:
            steps = known_fields(store, [name], base)[name].steps if name not in CORE else [name]
        except RequestError:
            steps = planner.tokens(name)
        if not steps or None in steps:
            raise RequestError(f"'{name}' names no single value")
        plans[name] = steps
    return plans


def current_top(store: SnapshotStore, top: str, base: int) -> bool:
    """Whether a field's values may stand in child rows or apart from the document."""
    return not store.read("entities", base).where(top_of(F.col("path")) == top).isEmpty()


def derive_changes(store: SnapshotStore, change, new: DataFrame, base: int, number: int, seen: dict[str, int]) -> None:
    """Append changes (key, path, value) with their number, and the rows that follow from them."""
    fields = new.groupBy(KEY, "seq").agg(F.map_from_entries(F.collect_list(F.struct("path", F.parse_json("value").alias("v")))).alias("m"))
    texts = change.scratch(fields.select(KEY, "seq", F.to_json("m").alias("raw")))
    parsed = texts.select(F.struct(KEY, "seq").alias("record_key"), F.parse_json("raw").alias("v"))
    counted = change.scratch(text_counts(texts))
    groups, bases = touched_groups(store, new, base)
    judged = ingest.strategies(ingest.judging(parsed, counted, ingest.registered_hints(store, base))).where(~F.col("path").isin(*CORE))
    stamped = new.select(KEY, "path", "value", F.lit(number).cast("long").alias("change"), F.lit(False).alias("mark"))
    marks = new.join(bases, new["path"] == bases["name"]).select(KEY, F.col("base").alias("path"), F.lit(None).cast("string").alias("value"), F.lit(number).cast("long").alias("change"), F.lit(True).alias("mark")).distinct()
    change.append("changes", stamped.unionByName(marks))
    ingest.derive(change, parsed, counted, judged, store.read("placements", base), seen, number, groups)


def touched_groups(store: SnapshotStore, new: DataFrame, base: int) -> tuple[DataFrame | None, DataFrame]:
    """Groups of numbered scalars of the records hit, with the changes, that a change belongs to; and (name, base) of the changed names.

    Without a changed name that ends in a number there are no groups, and no record is read for them.
    """
    stem, digits = numbered_name(F.col("path"))
    bases = new.select("path").distinct().select(F.col("path").alias("name"), stem.alias("base"), digits.alias("digits")).where("base <> ''").select("name", "base")
    if bases.isEmpty():
        return None, bases
    held = without_deleted(store.read("records", base), KEY, store.read("tombstones", base) if "tombstones" in store.manifest(base) else None)
    entries = F.explode(F.map_entries(F.try_variant_get(F.parse_json("raw"), "$", "map<string,variant>"))).alias("e")
    stored = held.join(new.select(KEY).distinct(), KEY, "left_semi").select(KEY, "seq", entries).select(KEY, "seq", F.col("e.key").alias("path"), F.to_json("e.value").alias("value"), F.lit(0).cast("long").alias("change"))
    if "changes" in store.manifest(base):
        stored = stored.unionByName(store.read("changes", base).where("not mark").join(new.select(KEY, "seq").distinct(), KEY).select(KEY, "seq", "path", "value", "change"))
    everything = stored.unionByName(new.select(KEY, "seq", "path", "value", F.lit(base + 1).cast("long").alias("change")))
    stem_, _ = numbered_name(F.col("path"))
    mine = everything.withColumn("base", stem_).join(bases.select("base").distinct(), "base", "left_semi").groupBy(KEY, "path").agg(F.max_by("value", "change").alias("value"))
    value = F.parse_json("value")
    nodes = mine.select(F.col(KEY).alias("record_key"), "path", value.alias("value"), detect_type(value).alias("type"))
    return scalar_groups(nodes), bases


def delete(store: SnapshotStore, request: dict[str, Any], base: int) -> dict[str, Any]:
    """Write the keys of the records that go; all that belongs to them is left out of every read from then on.

    The answer counts what went from each part.
    """
    filters = guarded(request)
    change, seen = store.begin(), dict.fromkeys(ingest.COUNTERS, 0)
    try:
        hits = hit_records(store, change, filters, base)
        if not (n := hits.count()):
            change.abort()
            return {"success": True, "version": base, "deleted": 0, "parts": {}}
        parts = {table: ingest.live(store, table, base).join(hits.select(F.col(KEY).alias(key)), key, "left_semi").count() for table, (key, _) in ingest.OWNED.items() if table != "records" and table in store.manifest(base)}
        change.append("tombstones", hits)
        ingest.note(change, None, "delete", seen | {"deleted": n})
        return {"success": True, "version": change.commit(), "deleted": n, "parts": {"records": n} | parts}
    finally:
        if change.state != "committed":
            change.abort()


def delete_entity(store: SnapshotStore, request: dict[str, Any], base: int) -> dict[str, Any]:
    """Take rows of a group out of the child rows and payloads; only folders that hold such rows are rewritten."""
    filters = guarded(request)
    path = entity_path(store, request["entity"], base)
    table = child_table(store, path, base)
    change, seen = store.begin(), dict.fromkeys(ingest.COUNTERS, 0)
    try:
        gone = change.scratch(table.where(predicate(filters, {c: F.col(f"`{c}`") for c in table.columns}, dict(table.dtypes))).select("parent_sys_ingested_at", "item_index"))
        n = gone.count()
        if n:
            for name, column in (("children", "path"), ("references", "entity_path")):
                mine = (F.col(column) == path) if name == "children" else top_of(F.col(column)) == path
                rewrite_without(store, change, name, gone.withColumn("_mine", F.lit(True)), mine)
            ingest.note(change, None, "delete", seen | {"deleted": n})
            return {"success": True, "version": change.commit(), "deleted": n}
        change.abort()
        return {"success": True, "version": base, "deleted": 0}
    finally:
        if change.state != "committed":
            change.abort()


def rewrite_without(store: SnapshotStore, change, table: str, gone: DataFrame, mine: Column) -> None:
    """Rewrite the folders of a table that hold rows (parent, item_index) that go; the others stay as they are."""
    folders = change.held.get(table, [])
    for folder in folders:
        rows = store.folders([folder])
        keys = ["parent_sys_ingested_at", "item_index"]
        marked = rows.withColumn("_mine", mine).join(gone, [*keys, "_mine"], "left_semi")
        if not marked.isEmpty():
            change.forget(table, [folder])
            change.append(table, rows.withColumn("_mine", mine).join(gone, [*keys, "_mine"], "left_anti").select(*rows.columns))


def compact(store: SnapshotStore) -> int:
    """Write the tables without void rows, with changes put into the documents; the version that has it.

    For times of little load: reads need it never, but are faster behind it.
    """
    base, manifest = store.version(), store.manifest()
    change = store.begin()
    try:
        for table in (t for t in ("children", "references", "values", "buffer") if t in manifest):
            rows = ingest.live(store, table, base)
            if table == "buffer":
                change.forget("buffer", list(change.held["buffer"]))
                change.append("buffer", rows.limit(0))
                ingest.stow(change, rows.withColumn("change", F.lit(0).cast("long")))
            else:
                change.replace(table, rows.withColumn("change", F.lit(0).cast("long")))
        change.replace("records", folded(store, base))
        if "changes" in manifest:
            change.replace("counts", store.read("counts", base).unionByName(counts_of_changes(store, base)))
        for table in ("changes", "tombstones"):
            if table in manifest:
                change.replace(table, store.read(table, base).limit(0))
        return change.commit()
    except BaseException:
        change.abort()
        raise


def counts_of_changes(store: SnapshotStore, base: int) -> DataFrame:
    """Statistics (path, type, n, ...) of paths that only updates have set, so that the catalog knows them once changes are folded."""
    last = store.read("changes", base).where("not mark").groupBy(KEY, "path").agg(F.max_by("value", "change").alias("value"))
    fields = last.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("path", F.parse_json("value").alias("v")))).alias("m"))
    counts = store.read("counts", base)
    new = text_counts(fields.select(F.lit(0).cast("long").alias("seq"), F.to_json("m").alias("raw"))).join(counts.select("path").distinct(), "path", "left_anti")
    return new.select(*counts.columns)


def folded(store: SnapshotStore, base: int) -> DataFrame:
    """Records that are not deleted, with changed fields in their documents; fields kept apart keep their mark."""
    manifest = store.manifest(base)
    rows = without_deleted(store.read("records", base), KEY, store.read("tombstones", base) if "tombstones" in manifest else None)
    if "changes" not in manifest:
        return rows
    last = store.read("changes", base).where("not mark").groupBy(KEY, "path").agg(F.max_by("value", "change").alias("value"))
    entries = last.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("path", F.parse_json("value").alias("v")))).alias("m"))
    apart = ingest.live(store, "references", base).groupBy(F.col("parent_sys_ingested_at").alias(KEY)).agg(F.collect_set(top_of(F.col("entity_path"))).alias("apart"))
    fields = F.try_variant_get(F.parse_json("raw"), "$", "map<string,variant>")
    stays = F.map_filter(fields, lambda k, _: ~F.map_contains_key("m", k) & ~F.map_contains_key("m", F.regexp_replace(k, r"_ref_collection\z", "")))
    inside = F.map_filter("m", lambda k, _: ~F.coalesce(F.array_contains("apart", k), F.lit(False)))
    marks = F.transform_values(F.map_filter("m", lambda k, _: F.coalesce(F.array_contains("apart", k), F.lit(False))), lambda k, _: F.parse_json(F.to_json(F.array(ingest.collection(k)))))
    marks = F.map_from_entries(F.transform(F.map_entries(marks), lambda e: F.struct(F.concat(e["key"], F.lit("_ref_collection")).alias("key"), F.variant_get(e["value"], "$[0]", "variant").alias("value"))))
    text = F.to_json(F.map_concat(stays, inside, marks))
    of = lambda name: F.when(F.map_contains_key("m", F.lit(name)), F.try_variant_get(F.try_element_at("m", F.lit(name)), "$", "string")).otherwise(F.col(name))
    joined = rows.join(entries, KEY, "left").join(apart, KEY, "left")
    changed = F.col("m").isNotNull()
    return joined.select(KEY, F.when(changed, of("username")).otherwise(F.col("username")).alias("username"), F.when(changed, of("t_stamp")).otherwise(F.col("t_stamp")).alias("t_stamp"), F.when(changed, text).otherwise(F.col("raw")).alias("raw"), "seq")
