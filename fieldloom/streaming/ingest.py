"""Streaming ingestion: each micro-batch is profiled, placed, routed, normalized and appended in one transaction.

Tables of a store that is filled this way:

records      sys_ingested_at, core fields, raw JSON (the document), seq: a number without gaps over all batches
counts       statistics by path and type; placements: where each field goes; strategies: embedded or referenced
values       routed scalars; buffer: scalars of fields seen too seldom to be placed, by slots of their path's hash
children     items of repeating groups: scalar keys in item, nested ones in rest
references   values that are kept apart; the document has `<field>_ref_collection` in place of the field
entities     paths of groups and referenced values; batches: a ledger of what each batch or request has added
changes, tombstones    updates and deletions, see operators.overlay
schemas      registered schemas by version, see plans.control

What a batch adds goes into new folders, so bytes written grow with the batch. Only tables with some rows a field are
rewritten, and of the buffer the slots of fields that the batch has placed. Totals are observed while the rows are written.
What a record gives is worked out within its row, from the record itself and from what the batch's counts tell of its paths:
of all that belongs to single records, only groups of numbered scalars are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.functions.types import as_dict, as_list, bound, depth, detect_type, entity_name, numbered_name
from fieldloom.operators.catalog import active_schema, entity_hints, latest, shared_entities, with_hints
from fieldloom.operators.nesting import mode, reference_score
from fieldloom.operators.numbering import numbered
from fieldloom.operators.overlay import without_deleted, without_stale
from fieldloom.operators.paths import ODD_KEY, is_top, lists, quoted, scalar_groups, top_of
from fieldloom.operators.placement import place
from fieldloom.operators.profile import field_stats, merge_counts, text_counts
from fieldloom.sources.events import enrich
from fieldloom.sources.store import SnapshotStore, Transaction

CORE = ("username", "sys_ingested_at", "t_stamp")
HINT = "frequently_updated boolean, shared boolean, unbounded boolean, expected_max_items int"
#: Parts of the buffer by the hash of the path; a drain rewrites the parts of the fields that were placed.
BUFFER_SLOTS = 64
#: Columns of the ledger beside batch_id and kind.
COUNTERS = ("accepted", "rejected", "children", "references", "routed", "buffered", "drained", "updated", "deleted")
#: Tables whose rows belong to a record, by the column that names it and the one with the path they come from.
OWNED = {"records": ("sys_ingested_at", None), "children": ("parent_sys_ingested_at", "path"), "references": ("parent_sys_ingested_at", "entity_path"), "values": ("record_key", "path"), "buffer": ("record_key", "path")}


def live(store: SnapshotStore, table: str, version: int | None = None, folders: list[str] | None = None) -> DataFrame:
    """The rows of a table, or of some of its folders, that neither a deletion nor a later change of their field has made void."""
    manifest, (key, path) = store.manifest(version), OWNED[table]
    rows = without_deleted(store.folders(folders) if folders else store.read(table, version), key, store.read("tombstones", version) if "tombstones" in manifest else None)
    return without_stale(rows, key, top_of(F.col(path)), store.read("changes", version) if "changes" in manifest else None) if path else rows


def observed(change: Transaction, table: str, rows: DataFrame, seen: dict[str, int], counter: str) -> DataFrame:
    """Append rows and add their number, observed in the same pass, to a counter."""
    watch = Observation()
    out = change.append(table, rows.observe(watch, F.count(F.lit(1)).alias("n")))
    seen[counter] += watch.get.get("n", 0)
    return out


def together(*writes: Callable[[], object]) -> list:
    """The results of several writes that do not need one another, run at the same time so that small jobs fill the cluster."""
    with ThreadPoolExecutor(len(writes)) as pool:
        return [f.result() for f in [pool.submit(w) for w in writes]]


def note(change: Transaction, batch_id: int | None, kind: str, seen: dict[str, int]) -> None:
    """Put a batch or request into the ledger."""
    row = [(batch_id, kind, *(seen.get(c, 0) for c in COUNTERS))]
    change.append("batches", change.store.spark.createDataFrame(row, "batch_id long, kind string, " + ", ".join(f"{c} long" for c in COUNTERS)).coalesce(1))


def ingest_batch(store: SnapshotStore, batch: DataFrame, batch_id: int, hints: DataFrame | None = None, kind: str = "batch") -> dict[str, int]:
    """Add parsed events (raw, v, rejected) to the store and give back what was counted; a batch that is in stays in once.

    Records of later batches sort behind those of earlier ones. Field statistics are merged, not recomputed. A field that
    was placed keeps its place. `hints` are (path, hint struct), those of the store's active schema if none are given.
    """
    known = store.manifest()
    ledger = store.read("batches") if "batches" in known else None
    if ledger is not None and not ledger.where((F.col("batch_id") == batch_id) & (F.col("kind") == kind)).isEmpty():
        return {}
    before = ledger.agg(F.sum("accepted")).first()[0] if ledger is not None else 0
    hints = registered_hints(store) if hints is None else hints
    change, seen = store.begin(), dict.fromkeys(COUNTERS, 0)
    try:
        watch = Observation()
        sizes = [F.count_if(~F.col("rejected")).alias("accepted"), F.count_if("rejected").alias("rejected")]
        fresh = batch.observe(watch, *sizes).where("not rejected").withColumn("number", F.monotonically_increasing_id())
        named = enrich(fresh, F.concat(F.lit(f"{kind[0] if kind != 'batch' else ''}{batch_id:08d}."), F.lpad(F.col("number").cast("string"), 16, "0")))
        staged = change.scratch(named.select(F.col("record_key").alias("sys_ingested_at"), "username", "t_stamp", "raw", "number"))
        found = watch.get
        seen["accepted"], seen["rejected"] = found.get("accepted") or 0, found.get("rejected") or 0
        records = numbered(staged, "number", "seq", before)
        parsed = parsed_records(records)
        counted = change.scratch(text_counts(records))
        held = store.read("placements") if "placements" in known else None
        new = counted.drop("nested")
        counts = change.replace("counts", merge_counts(store.read("counts"), new) if "counts" in known else new)
        placed = change.replace("placements", sticky(held, place(field_stats(counts, before + seen["accepted"]))))
        judged = strategies(judging(parsed, counted, hints))
        ends = records.join(F.broadcast(counted.where("nested").select(F.col("last_seen").alias("seq")).distinct()), "seq", "left_semi")
        newest = latest(strategies(judging(parsed_records(ends), counted, hints)).select("path", "score", "reasons", "mode", "seq"), "path", "seq")
        if "strategies" in known:
            newest = latest(store.read("strategies").unionByName(newest), "path", "seq")
        together(
            lambda: change.append("records", documents(records, counted, hints).select("sys_ingested_at", "username", "t_stamp", "raw", "seq")),
            lambda: change.replace("strategies", newest),
            lambda: derive(change, parsed, counted, judged, placed, seen, all_placed=placed.where("backend = 'Buffer'").isEmpty()),
        )
        if held is not None and "buffer" in known:
            drain_slots(change, placed, placed.join(held.where("backend <> 'Buffer'"), "path", "left_anti"), seen)
        note(change, batch_id, kind, seen)
        change.commit()
        return seen
    except BaseException:
        change.abort()
        raise


def parsed_records(records: DataFrame) -> DataFrame:
    return records.select(F.struct("sys_ingested_at", "seq").alias("record_key"), F.parse_json("raw").alias("v"))


def registered_hints(store: SnapshotStore, version: int | None = None) -> DataFrame | None:
    """(path, hint) of the active schema, as long as that schema has entities; None without a schema."""
    return entity_hints(active_schema(store.read("schemas", version))) if "schemas" in store.manifest(version) else None


def derive(change: Transaction, parsed: DataFrame, counted: DataFrame, judged: DataFrame, placed: DataFrame, seen: dict[str, int], number: int = 0, groups: DataFrame | None = None, all_placed: bool = False) -> None:
    """Append what follows from records parsed (record_key, v): child rows, references, routed and buffered values, and the paths
    of groups. `counted` are the text_counts of the same records, and `judged` their strategies.

    `number` is that of the change that the records come from, 0 for ingested ones; with `all_placed` no field waits.
    """
    levels, into_lists, numbered_names = list_depths(counted)
    groups = scalar_groups(top_fields(parsed).withColumn("type", detect_type(F.col("value")))) if groups is None and numbered_names and not number else groups
    stamp = F.lit(number).cast("long").alias("change")
    waiting = scalars(parsed, groups).select("record_key", "path", "type", "text", stamp)
    routed, rest = drain(waiting, placed)
    rest = rest.limit(0) if all_placed else rest
    children, references, *_ = together(
        lambda: observed(change, "children", child_rows(parsed, groups, levels, into_lists).select("*", stamp), seen, "children"),
        lambda: observed(change, "references", reference_rows(judged).select("*", stamp), seen, "references"),
        lambda: observed(change, "values", routed.select("record_key", "path", "type", "text", "change", "backend"), seen, "routed"),
        lambda: stow(change, rest.select("record_key", "path", "type", "text", "change"), seen),
    )
    paths = children.select("path", F.lit("children").alias("kind")).unionByName(references.select(F.col("entity_path").alias("path"), F.lit("reference").alias("kind"))).distinct()
    known = change.store.folders(change.held["entities"]).select("path", "kind") if "entities" in change.held else None
    change.replace("entities", paths if known is None else known.unionByName(paths).distinct())


def slot(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUFFER_SLOTS)).cast("int")


def stow(change: Transaction, rest: DataFrame, seen: dict[str, int] | None = None) -> None:
    """Add values to the buffer, each slot in a folder of its own."""
    if "buffer" not in change.staged and "buffer" not in change.held:
        change.append("buffer", rest.limit(0))
    watch = Observation()
    change.append_parts("buffer", rest.withColumn("slot", slot(F.col("path"))).repartition("slot").observe(watch, F.count(F.lit(1)).alias("n")), "slot")
    if seen is not None:
        seen["buffered"] += watch.get.get("n", 0)


def slots_of(change: Transaction, paths: DataFrame) -> list[str]:
    """The folders of the buffer that may hold some paths: the driver gets at most BUFFER_SLOTS numbers."""
    wanted = {f"slot={r['slot']}" for r in paths.select(slot(F.col("path")).alias("slot")).distinct().collect()}
    return [f for f in change.held.get("buffer", []) if f.rpartition("/")[2] in wanted]


def drain_slots(change: Transaction, placed: DataFrame, paths: DataFrame, seen: dict[str, int]) -> None:
    """Move buffered values of placed fields among `paths` to the values; only the slots of these paths are read and rewritten."""
    folders = slots_of(change, paths.where("backend <> 'Buffer'"))
    if not folders:
        return
    moved, rest = drain(change.store.folders(folders), placed)
    before = seen["routed"]
    observed(change, "values", moved.select("record_key", "path", "type", "text", "change", "backend"), seen, "routed")
    seen["drained"] += seen["routed"] - before
    change.forget("buffer", folders)
    stow(change, rest.select("record_key", "path", "type", "text", "change"))


def drain_placed(store: SnapshotStore) -> int:
    """Move what the buffer still holds of placed fields, as at start-up or after a field was placed by hand; the number of values."""
    manifest = store.manifest()
    if not {"buffer", "placements"} <= set(manifest):
        return 0
    waiting = store.read("buffer").select("path").distinct()
    placed = store.read("placements").join(waiting, "path", "left_semi")
    change, seen = store.begin(), dict.fromkeys(COUNTERS, 0)
    try:
        drain_slots(change, placed, placed, seen)
        if not seen["drained"]:
            change.abort()
            return 0
        note(change, None, "drain", seen)
        change.commit()
        return seen["drained"]
    except BaseException:
        change.abort()
        raise


def forget_field(store: SnapshotStore, path: str) -> int:
    """Take a field out of the buffer: only its slot is rewritten. The number of values that went."""
    change, seen = store.begin(), dict.fromkeys(COUNTERS, 0)
    try:
        folders = slots_of(change, store.spark.createDataFrame([(path,)], "path string"))
        rows = store.folders(folders) if folders else None
        gone = rows.where(F.col("path") == path).count() if folders else 0
        if not gone:
            change.abort()
            return 0
        change.forget("buffer", folders)
        stow(change, rows.where(F.col("path") != path))
        note(change, None, "forget", seen | {"drained": gone})
        change.commit()
        return gone
    except BaseException:
        change.abort()
        raise


def set_placement(store: SnapshotStore, path: str, backend: str, reason: str = "set by request") -> None:
    """Place a field by hand, new or not; it keeps this place, and what the buffer has of it is drained."""
    if backend not in ("SQL", "MongoDB", "Both", "Buffer"):
        raise ValueError(f"Unknown backend: {backend}")
    change = store.begin()
    try:
        row = store.spark.createDataFrame([(path, backend, reason, None, None, None, False)], "path string, backend string, reason string, dominant_type string, frequency double, stability double, quarantined boolean")
        known = store.read("placements") if "placements" in store.manifest() else row.limit(0)
        same = known.where(F.col("path") == path).select("path", "dominant_type", "frequency", "stability")
        new = row.select("path", "backend", "reason", "quarantined").join(same, "path", "left").select(*row.columns)
        change.replace("placements", known.where(F.col("path") != path).select(*row.columns).unionByName(new))
        change.commit()
    except BaseException:
        change.abort()
        raise
    drain_placed(store)


def sticky(before: DataFrame | None, placed: DataFrame) -> DataFrame:
    """placed (path, ...) where fields that `before` placed anywhere but in the buffer keep that row."""
    columns = ["path", "backend", "reason", "dominant_type", "frequency", "stability", "quarantined"]
    placed = placed.select(columns)
    if before is None:
        return placed
    held = before.where("backend <> 'Buffer'").select(columns)
    return held.unionByName(placed.join(held.select("path"), "path", "left_anti"))


def list_depths(counted: DataFrame) -> tuple[int, bool, bool]:
    """What text_counts tell of lists and numbers: a level below which there is no repeating list, whether one may be within
    another list, and whether there may be groups of numbered scalars."""
    path, odd = F.col("path"), r"""\[['"]"""
    steps = F.size(F.split(path, r"\.")) + F.regexp_count(path, F.lit(odd)) + F.regexp_count(path, F.lit(r"\[\]"))
    inner = path.endswith("[]") & F.contains(F.left(path, F.length(path) - 2), F.lit("[]"))
    scalar = inner & (~F.col("type").isin("dict", "list"))
    listed, base = F.col("nested") & F.col("type").isin("list", "mixed"), numbered_name(path)[0]
    found = counted.agg(
        F.max(F.when(listed & ~F.contains(path, F.lit("[]")), steps)).alias("outer"), F.max(F.when(listed, steps)).alias("all"), F.bool_or(scalar).alias("inner"), F.count_if((base != "") & ~F.col("type").isin("dict", "list")).alias("numbers"), F.bool_or(path.startswith("[]") | path.rlike(r"""\[['"].*\[\].*['"]\]""")).alias("odd")
    ).first()
    inside = bool(found["inner"] or found["odd"])
    return (found["all"] if inside else found["outer"]) or 0, inside, found["numbers"] > 1


def top_fields(parsed: DataFrame) -> DataFrame:
    """(record_key, seq, path, value): the fields of records themselves that are neither dictionaries nor lists nor core fields."""
    fields = parsed.select("record_key.*", F.explode_outer(as_dict(F.col("v"))).alias("key", "value")).where(F.col("key").isNotNull() & ~F.col("key").isin(*CORE))
    fields = fields.where(as_list(F.col("value")).isNull() & as_dict(F.col("value")).isNull())
    return fields.select(F.col("sys_ingested_at").alias("record_key"), "seq", F.when(F.col("key").rlike(ODD_KEY), quoted(F.col("key"))).otherwise(F.col("key")).alias("path"), "value")


def scalars(parsed: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(record_key, path, type, text): top-level scalars that are neither core fields nor part of a numbered group."""
    top = top_fields(parsed).where(is_top(F.col("path")))
    if groups is not None:
        top = top.join(groups.select("record_key", F.explode("names").alias("path")), ["record_key", "path"], "left_anti")
    return top.select("record_key", "path", detect_type(F.col("value")).alias("type"), F.try_variant_get("value", "$", "string").alias("text"))


def child_rows(parsed: DataFrame, groups: DataFrame | None, levels: int, into_lists: bool = True) -> DataFrame:
    """(entity, path, parent_sys_ingested_at, item_index, item, rest): items of repeating groups as JSON; dictionaries have their
    scalar keys in item and the others in rest, scalars become {"value": ...}. Numbered scalars come last and win over a list
    of the same name. Dictionaries without scalar keys are no rows. `levels` and `into_lists` are those of paths.lists."""
    nested = lambda x: as_list(x).isNotNull() | as_dict(x).isNotNull()
    split = lambda keys, deep: F.struct(F.when(F.size(deep) == 0, keys).otherwise(F.map_filter(keys, lambda k, _: ~F.map_contains_key(deep, k))).alias("plain"), deep.alias("deep"))
    text = lambda part: F.when(F.size(part) > 0, F.to_json(part))
    row = lambda item, rest: F.struct(item.alias("item"), rest.alias("rest"))
    of_dict = lambda x: bound(bound(F.map_filter(x["keys"], lambda _, y: nested(y)), lambda deep: split(x["keys"], deep)), lambda of: row(text(of["plain"]), text(of["deep"])))
    of_scalar = lambda x: row(F.concat(F.lit('{"value":'), F.to_json(x["value"]), F.lit("}")), F.lit(None).cast("string"))
    each = F.when(F.col("kind") == "entity", F.transform("items", of_dict)).otherwise(F.transform("items", of_scalar))
    items = lists(parsed, levels, into_lists).select("path", F.col("record_key.sys_ingested_at").alias("record_key"), F.posexplode_outer(each).alias("item_index", "x"))
    rows = items.select("path", "record_key", "item_index", "x.item", "x.rest").where("item is not null")
    if groups is not None:
        numbered = groups.select(F.col("base").alias("path"), "record_key", F.posexplode("values").alias("item_index", "json"))
        numbered = numbered.select("path", "record_key", "item_index", F.concat(F.lit('{"value":'), "json", F.lit("}")).alias("item"), F.lit(None).cast("string").alias("rest"))
        rows = rows.join(numbered.select("record_key", "path").distinct(), ["record_key", "path"], "left_anti").unionByName(numbered)
    return rows.select(F.concat(F.lit("norm_"), entity_name(F.col("path"))).alias("entity"), "path", F.col("record_key").alias("parent_sys_ingested_at"), "item_index", "item", "rest")


def judging(parsed: DataFrame, counted: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """parsed (record_key, v, ...) with `judged`: path, value, type, score, reasons and mode of each top-level nested value,
    embedded or kept apart; values are there only where they are referenced.

    A name is shared if it occurs under several parents among the paths of `counted`. Those names and the hints have a row a
    field, and stand beside each record, which is judged by itself.
    """
    nested = counted.where("nested").select(F.regexp_replace("path", r"\[\](?=[.\[]|\z)", "").alias("path")).distinct()
    shared = shared_entities(nested).select("name").join(nested.where(is_top(F.col("path"))).select(F.col("path").alias("name")), "name", "left_semi")
    rows = parsed.crossJoin(F.broadcast(shared.agg(F.collect_list("name").alias("_shared"))))
    kind = f"struct<{HINT.replace(' ', ': ').replace(',: ', ', ')}>"
    hint = lambda _: F.lit(None).cast(kind)
    if hints is not None:
        once = hints.dropDuplicates(["path"])
        rows = rows.crossJoin(F.broadcast(once.agg(F.map_from_entries(F.collect_list(F.struct("path", "hint"))).alias("_hints"))))
        last = lambda name: F.element_at(F.split(F.regexp_replace(name, r"\[[0-9]+\]", ""), r"\."), -1)
        hint = lambda name: F.coalesce(F.try_element_at("_hints", name), F.try_element_at("_hints", last(name)))
    of = lambda **columns: F.struct(*[c.alias(name) for name, c in columns.items()])
    fields = F.transform(F.map_entries(as_dict(F.col("v"))), lambda e: of(key=e["key"], value=e["value"], items=as_list(e["value"]), keys=as_dict(e["value"])))
    fields = F.filter(fields, lambda x: x["items"].isNotNull() | x["keys"].isNotNull())
    holds = lambda x: F.coalesce(F.exists(x["items"], lambda y: as_dict(y).isNotNull()), F.lit(False))
    sized = F.transform(fields, lambda x: of(path=F.when(x["key"].rlike(ODD_KEY), quoted(x["key"])).otherwise(x["key"]), value=x["value"], n_items=F.size(x["items"]), holds=holds(x), n_keys=F.size(x["keys"]), hint=hint(x["key"])))

    def scored(x: Column) -> Column:
        n_items, n_keys = F.when(x["n_items"] >= 0, x["n_items"]), F.when(x["n_keys"] >= 0, x["n_keys"])
        score, reasons = reference_score(n_items, x["holds"], n_keys, depth(x["path"]), F.array_contains("_shared", x["path"]), x["hint"])
        return of(path=x["path"], value=x["value"], type=F.when(n_items.isNotNull(), "list").otherwise("dict"), score=score, reasons=reasons)

    of_mode = lambda x: of(path=x["path"], value=F.when(x["score"] >= 2, x["value"]), type=x["type"], score=x["score"], reasons=x["reasons"], mode=mode(x["score"]))
    return rows.select(*parsed.columns, F.transform(F.transform(sized, scored), of_mode).alias("judged"))


def strategies(judged: DataFrame) -> DataFrame:
    """(record_key, seq, path, value, type, score, reasons, mode) of top-level nested values, one row each."""
    return judged.select("record_key.*", F.explode_outer("judged").alias("x")).where("x is not null").select(F.col("sys_ingested_at").alias("record_key"), "seq", "x.*")


def collection(path: Column) -> Column:
    """The name of the collection that has the referenced values of a field."""
    return F.concat(F.lit("ref_"), entity_name(path))


def documents(records: DataFrame, counted: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """records (sys_ingested_at, raw, ...) with `<field>_ref_collection` in raw in place of each field that is judged to be kept apart.

    Only documents that have such a field are written anew; the others stay letter by letter.
    """
    judged = judging(records.withColumn("v", F.parse_json("raw")), counted, hints)
    apart = F.filter("judged", lambda x: x["mode"] == "reference")
    marks = F.map_from_entries(F.transform(apart, lambda x: F.struct(F.concat(top_of(x["path"]), F.lit("_ref_collection")).alias("k"), collection(x["path"]).alias("v"))))
    kept = lambda of: F.map_filter(as_dict(F.col("v")), lambda k, _: ~F.map_contains_key(of, F.concat(k, F.lit("_ref_collection"))) & ~F.map_contains_key(of, k))
    marked = lambda of: F.transform_values(of, lambda _, v: F.variant_get(F.parse_json(F.to_json(F.array(v))), "$[0]", "variant"))
    text = lambda of: F.when(F.size(of) == 0, F.col("raw")).otherwise(F.to_json(F.map_concat(kept(of), marked(of))))
    return judged.withColumn("raw", bound(marks, text)).select(*records.columns)


def reference_rows(judged: DataFrame) -> DataFrame:
    """(entity_path, parent_sys_ingested_at, item_index, payload, whole): one document for each item of a referenced list, and
    one that is whole for a dictionary."""
    apart = judged.where("mode = 'reference'")
    whole = F.col("type") == "dict"
    items = F.when(whole, F.array("value")).otherwise(F.try_variant_get("value", "$", "array<variant>"))
    rows = apart.select(F.col("path").alias("entity_path"), F.col("record_key").alias("parent_sys_ingested_at"), whole.alias("whole"), F.posexplode_outer(items).alias("item_index", "x")).where("item_index is not null")
    return rows.select("entity_path", "parent_sys_ingested_at", "item_index", F.to_json("x").alias("payload"), "whole")


def start(store: SnapshotStore, events: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingest a stream; what the buffer still holds of placed fields is drained first."""
    drain_placed(store)
    writer = events.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(store, batch, batch_id) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def placements(store: SnapshotStore) -> DataFrame:
    """Where each field goes, by all statistics so far."""
    total = store.read("batches").agg(F.sum("accepted")).first()[0]
    return place(field_stats(store.read("counts"), total))


def drain(buffered: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buffered values (record_key, path, ...) of fields that are placed by now, with their backend, and the rest."""
    decided = placed.where("backend <> 'Buffer'").select("path", "backend")
    return buffered.join(decided, "path"), buffered.join(decided, "path", "left_anti")


def totals(store: SnapshotStore) -> DataFrame:
    """(metric, value): records, rejected, batches, fields, fields by backend, strategies by mode, schema versions, and rows of each kind.

    Rows were counted while they were written, so only the ledger and the tables with some rows a field are read.
    """
    ledger = store.read("batches")
    sums = ledger.agg(
        F.sum("accepted").alias("records"), F.sum("rejected").alias("rejected"), F.count_if(F.col("kind").isin("batch", "insert")).alias("batches"), *[F.sum(c).alias(c) for c in ("routed", "children", "references", "drained", "updated", "deleted")],
        (F.sum("buffered") - F.sum("drained")).alias("buffered"),
    )
    backends = [F.count_if(F.col("backend") == b).alias(f"fields_{b.lower()}") for b in ("SQL", "MongoDB", "Both", "Buffer")]
    fields = store.read("placements").agg(F.count("*").alias("fields"), F.count_if(F.col("backend") != "Buffer").alias("decisions"), *backends)
    modes = store.read("strategies").agg(F.count_if(F.col("mode") == "reference").alias("referenced"), F.count_if(F.col("mode") == "embed").alias("embedded"))
    tables = store.read("entities").agg(F.count_if(F.col("kind") == "children").alias("tables"), F.count_if(F.col("kind") == "reference").alias("collections"))
    schemas = store.read("schemas") if "schemas" in store.manifest() else None
    versions = (ledger.limit(0) if schemas is None else schemas).agg(F.count("*").alias("versions"))
    metrics = lambda part: part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for c in part.columns])).alias("x")).select("x.*")
    return reduce(DataFrame.unionByName, map(metrics, [sums, fields, modes, tables, versions]))
