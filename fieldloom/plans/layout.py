"""Child tables with typed columns, laid out by their parent, and the nest-join on them that moves no row.

`lay_out` writes a generation: the records and the child rows that no generation has yet, both in buckets of the record's
key, with one table a group and one typed column for each catalogued scalar of its items. So what is written grows with what
is new. A record and its items lie in buckets of one number, and `nested` puts them together bucket by bucket.

The manifest names a generation's source folders. If one of them has been rewritten since, the generation is left out of
reads, and its rows come from the sources again until the next `lay_out`; the same holds for a group whose columns have
outgrown their types, but for added columns (null there) and integers that became floats (widened at read). Child rows that
updates have written stay loose, and so are joined to every generation, until `logical.compact` folds them in. Changes and
deletions are merged at read as elsewhere; only they are shuffled, to the buckets.

Items without a value of a column are null there, and so are values of another type. Column names that differ only in case
or have odd signs are kept apart, though a filter cannot tell the former from one another. A bucket holds whole records, so it is as uneven as records are large, not as groups are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fieldloom.functions.predicates import RequestError
from fieldloom.operators.overlay import without_deleted
from fieldloom.operators.paths import top_of
from fieldloom.plans import fields as planner
from fieldloom.sources.store import SnapshotStore
from fieldloom.streaming import ingest

KEY, PARENT, PLACE = "sys_ingested_at", "parent_sys_ingested_at", "item_index"
PREFIX = "laid/"


@dataclass
class Generation:
    sources: list[str] = field(default_factory=list)  #: folders of records and children that it has taken over
    records: str | None = None
    groups: dict[str, str] = field(default_factory=dict)  #: the folder of each group's rows, by the group's path


def generations(manifest: dict[str, list[str]]) -> dict[str, Generation]:
    """The generations whose sources are all as they were, by their number."""
    found: dict[str, Generation] = {}
    for name, folders in manifest.items():
        if name.startswith(PREFIX):
            number, part, *path = name.removeprefix(PREFIX).split("/", 2)
            of = found.setdefault(number, Generation())
            if part == "sources":
                of.sources = folders
            elif part == "records":
                of.records = folders[0]
            else:
                of.groups[path[0]] = folders[0]
    held = {*manifest.get("records", []), *manifest.get("children", [])}
    return {n: g for n, g in found.items() if held.issuperset(g.sources)}


def item_columns(store: SnapshotStore, path: str, version: int | None) -> dict[str, str]:
    """The typed columns of a group's items; names of the table's own columns are left to these."""
    from fieldloom.plans.logical import entity_columns

    return {c: k for c, k in entity_columns(store, path, version).items() if c not in (PARENT, PLACE)}


def stored_name(column: str) -> str:
    """A column's name in files: letters and digits only, and other for each other name."""
    return "c_" + column.encode().hex()


def typed_items(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(parent_sys_ingested_at, item_index, change, typed columns by their stored names) of child rows that are JSON."""
    item = F.parse_json("item")
    return rows.select(PARENT, PLACE, F.coalesce("change", F.lit(0)).alias("change"), *[F.try_variant_get(item, planner.json_path([name]), kind).alias(stored_name(name)) for name, kind in columns.items()])


def widened(held: dict[str, str], columns: dict[str, str]) -> bool:
    """Whether columns as stored can be read as the catalogued ones."""
    return all(held.get(stored_name(n), kind) in (kind, "bigint" if kind == "double" else kind) for n, kind in columns.items())


def typed_laid(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    held = dict(rows.dtypes)
    of = lambda name, kind: F.col(stored_name(name)) if stored_name(name) in held else F.lit(None)
    return rows.select(PARENT, PLACE, F.lit(0).cast("long").alias("change"), *[of(n, k).cast(k).alias(stored_name(n)) for n, k in columns.items()])


def loose_folders(manifest: dict[str, list[str]], table: str, known: dict[str, Generation]) -> list[str]:
    """The folders of a table that no generation has."""
    taken = {f for g in known.values() for f in g.sources}
    return [f for f in manifest.get(table, []) if f not in taken]


def lay_out(store: SnapshotStore, buckets: int | None = None) -> int:
    """Write what no generation has yet as a new one, and give back the version that has it; the same one if there is nothing.

    `buckets` is spark.sql.shuffle.partitions unless given; a generation keeps its number. Generations that cannot be read
    any more, or one of whose groups has outgrown its types, are written anew with it.
    """
    base = store.version()
    manifest = store.manifest(base)
    paths = sorted(r["path"] for r in store.read("entities", base).where("kind = 'children'").select("path").distinct().collect())
    columns = {path: item_columns(store, path, base) for path in paths}
    known = {n: g for n, g in generations(manifest).items() if all(widened(dict(store.folders([f]).dtypes), columns[p]) for p, f in g.groups.items())}
    records, children = loose_folders(manifest, "records", known), loose_folders(manifest, "children", known)
    if children:
        folder = F.regexp_extract("_metadata.file_path", r"data/children/[0-9a-f]+", 0)
        changed = {r["folder"] for r in store.folders(children).where("change > 0").select(folder.alias("folder")).distinct().collect()}
        children = [f for f in children if f not in changed]
    if not records and not children:
        return base
    buckets = buckets or int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    change = store.begin()
    try:
        for name in [n for n in change.held if n.startswith(PREFIX) and n.removeprefix(PREFIX).split("/", 1)[0] not in known]:
            del change.held[name]
        name = f"{PREFIX}{base + 1}/"
        if records:
            change.append_buckets(name + "records", store.folders(records), KEY, [KEY], buckets)
        if children:
            one = F.concat(F.lit("e"), F.md5("path"))
            apart = change.scratch(store.folders(children).withColumn("group_of", one), "group_of")
            rows = {path: typed_items(apart.where((F.col("group_of") == F.concat(F.lit("e"), F.md5(F.lit(path)))) & (F.col("path") == path)), columns[path]).drop("change") for path in paths}
            for path, typed in rows.items():
                change.append_buckets(f"{name}of/{path}", typed, PARENT, [PARENT, PLACE], buckets)
        change.staged[name + "sources"] = [*records, *children]
        return change.commit()
    except BaseException:
        change.abort()
        raise


def settled(store: SnapshotStore, rows: DataFrame, key: str, path: str, version: int | None) -> DataFrame:
    """Laid child rows without those of deleted records and of records whose field has been changed since."""
    manifest = store.manifest(version)
    rows = without_deleted(rows, key, store.read("tombstones", version) if "tombstones" in manifest else None)
    if "changes" not in manifest:
        return rows
    later = store.read("changes", version).where(F.col("path") == top_of(F.lit(path))).select(F.col(KEY).alias(key)).distinct()
    return rows.join(later, key, "left_anti").select(*rows.columns)


def laid_rows(store: SnapshotStore, g: Generation, path: str, columns: dict[str, str], version: int | None) -> DataFrame | None:
    """A group's rows in a generation that no change has made void; None if it has none."""
    if path not in g.groups:
        return None
    stored = store.buckets(g.groups[path], PARENT)
    if not widened(dict(stored.dtypes), columns):
        rows = store.folders([f for f in g.sources if f.startswith("data/children/")]).where(F.col("path") == path)
        return settled(store, typed_items(rows, columns), PARENT, path, version)
    return settled(store, typed_laid(stored, columns), PARENT, path, version)


def loose_rows(store: SnapshotStore, known: dict[str, Generation], path: str, columns: dict[str, str], version: int | None) -> DataFrame | None:
    """A group's live rows that no generation has; None if no folder can have any."""
    folders = loose_folders(store.manifest(version), "children", known)
    return typed_items(ingest.live(store, "children", version, folders).where(F.col("path") == path), columns) if folders else None


def child_rows(store: SnapshotStore, path: str, version: int | None = None) -> DataFrame:
    """(parent_sys_ingested_at, item_index, typed columns): a group's live rows, from its laid tables where there are any.

    Only the columns asked for are read there, and filters on them reach the files.
    """
    known, columns = generations(store.manifest(version)), item_columns(store, path, version)
    parts = [laid_rows(store, g, path, columns, version) for g in known.values()]
    parts = [p for p in [*parts, loose_rows(store, known, path, columns, version)] if p is not None]
    if not parts:
        parts = [typed_items(store.read("children", version).limit(0), columns)]
    return reduce(DataFrame.unionByName, parts).select(PARENT, PLACE, *[F.col(stored_name(c)).alias(c) for c in columns])


def nested(store: SnapshotStore, entity: str, names: list[str] | None = None, version: int | None = None) -> DataFrame:
    """(sys_ingested_at, username, t_stamp, named fields, items): every record with the typed rows of a group in order.

    Records without items have an empty list. Named fields are those of the document. Within a generation neither records nor
    its child rows are shuffled.
    """
    from fieldloom.plans import logical

    version = store.version() if version is None else version
    path = logical.entity_path(store, entity, version)
    columns = item_columns(store, path, version)
    plans = logical.known_fields(store, names or [], version)
    if inside := sorted(n for n, f in plans.items() if f.group is not None):
        raise RequestError(f"'{inside[0]}' is no field of the document")
    manifest = store.manifest(version)
    known = generations(manifest)
    item = F.struct(PLACE, *[F.col(stored_name(c)).alias(c) for c in columns])
    listed = lambda rows, name: rows.groupBy(F.col(PARENT).alias(KEY)).agg(F.collect_list(item).alias(name))
    loose = loose_rows(store, known, path, columns, version)

    empty = ArrayType(typed_items(store.read("children", version), columns).select(item.alias("x")).schema["x"].dataType)

    def part(records: DataFrame, laid: DataFrame | None) -> DataFrame:
        rows, tops = logical.base_rows(store, sorted({f.top for f in plans.values()}), version, records)
        lists: list[Column] = []
        for of, name in ((laid, "near"), (loose, "far")):
            if of is not None:
                rows = rows.join(listed(of, name), KEY, "left")
                lists.append(F.coalesce(F.col(name), F.array().cast(empty)))
        items = F.sort_array(F.concat(*lists)) if lists else F.array().cast(empty)
        return rows.select(KEY, "username", "t_stamp", *[logical.field_column(f, tops, []).alias(n) for n, f in plans.items()], items.alias("items"))

    parts = [part(store.buckets(g.records, KEY), laid_rows(store, g, path, columns, version)) for g in known.values() if g.records]
    if rest := loose_folders(manifest, "records", known):
        parts.append(part(store.folders(rest), None))
    return reduce(DataFrame.unionByName, parts)
