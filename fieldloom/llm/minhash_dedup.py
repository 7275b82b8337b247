"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Sketching: round i hashes every shingle of a document to one of SIZE bins and keeps each bin's least value; a bin filled
in an earlier round stays. After SIZE rounds, round SIZE + j puts all shingles in bin j, so every bin fills. Two sketches
agree in a bin with the sets' Jaccard similarity as probability, concentrated as for independent bins.

Banding: groups of BAND_ROWS bins; documents that share a band meet. The threshold, in percent, is an argument; so many
bands are made that a pair at the threshold t meets in none with probability (1 - t^5)^bands < 1e-6 (24 bands at 85 percent,
35 at 80).

Verification, in passes. First every document of a bucket is checked against the bucket's least document, on full shingle
sets; the links give components. In buckets that still hold several components, a document outside the largest one, chosen
by a hash so that a few strangers with small ids do not lead again, is then checked against all others. What is left of a bucket are its documents outside the largest
component, and only these are held against all others: in blocks of bounded size, pairs of different components whose
sketches agree in enough bins (5 standard deviations below the link threshold: 176 at 85 percent, 161 at 80) are verified on
full sets. A bucket of n documents with r outside its largest component costs n (r / BLOCK + 1) rows; no list of all pairs of
a bucket is made, and no bucket is cut short.

Empty and null texts have no shingles and are linked with nothing (component_id is the own id). Equal sets share one node.
In near_duplicates, rows with a null doc_id have a null component and are not kept; in keep they count as documents of
their own, which go only if a copy stays. Repeated rows share their component; every one is kept whose id is the
component's. Very long texts are taken whole; a similarity just at the threshold links. An empty table gives no rows. Only
doc_id and text are read, so other columns may have any names; keep passes them through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.components import components, looked_up
from fieldloom.llm.storage import materialize

#: Words of a shingle, and the least similarity in percent of a link: of near_duplicates by its contract, and of keep.
WORDS, PERCENT, KEEP_PERCENT = 5, 85, 80
#: Bins of a sketch and of a band; the greatest probability that a pair at the threshold meets in no band.
SIZE, BAND_ROWS, MISSED = 240, 5, 1e-6
#: Ids from here on stand for rows without one, so that they come behind the others.
NO_ID = 1 << 62
#: Text bytes worked on at once, documents of a bucket in each side of a block, passes by a leader, and shingles that one
#: group of documents may have to be verified together.
CHUNK_BYTES, BLOCK, LEADERS, GROUP_SHINGLES = 1 << 21, 256, 2, 1 << 21
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bands_for(percent: int) -> int:
    """Bands that a pair at the threshold misses with a probability below MISSED."""
    bands = math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** BAND_ROWS))) if percent < 100 else 1
    if bands * BAND_ROWS > SIZE:
        raise ValueError(f"sketches of {SIZE} bins are too short for links at {percent} percent")
    return bands


def agreeing(percent: int) -> int:
    """Bins in which the sketches of a pair at the threshold agree, less 5 standard deviations."""
    t = percent / 100
    return math.floor(SIZE * t - 5 * math.sqrt(SIZE * t * (1 - t)))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts (bytes, end offsets), and the text of each word; A-Z count as a-z."""
    letters = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~solid[:-1]
    fresh[ends[:-1][ends[:-1] < len(data)]] = True
    starts = np.flatnonzero(solid & fresh)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    places = np.flatnonzero(solid)
    first = np.searchsorted(places, starts)
    lengths = np.diff(np.append(first, len(places)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, U64))
        nth = np.arange(len(places)) - np.repeat(first, lengths)
        sums = np.add.reduceat((letters[places].astype(U64) + U64(1)) * powers[nth], first)
        return mixed(sums + lengths.astype(U64)), np.searchsorted(ends, starts, "right")


def shingle_sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, owner = word_hashes(data, ends)
    counts = np.bincount(owner, minlength=len(ends))
    stops = np.cumsum(counts)
    factors = mixed(np.arange(1, WORDS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WORDS + 1)
        runs = np.zeros(n, U64)
        for k in range(WORDS):
            runs += words[k : k + n] * factors[k]
        runs = mixed(runs)
        out = []
        for stop, count in zip(stops.tolist(), counts.tolist()):
            if count >= WORDS:
                found = np.sort(runs[stop - count : stop - WORDS + 1])
                out.append(found[np.append(True, found[1:] != found[:-1])])
            elif count:
                out.append(mixed(np.array([(words[stop - count : stop] * factors[:count]).sum() + U64(count)], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SIZE 32-bit values for each set; rows of empty sets stay unfilled."""
    empty, many = U64(0xFFFFFFFFFFFFFFFF), len(sets)
    table = np.full(many * SIZE, empty, U64)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate([*sets, np.zeros(0, U64)]), np.repeat(np.arange(many), sizes)
    with np.errstate(over="ignore"):
        for turn in range(2 * SIZE):
            if not len(values):
                break
            hashes = mixed(values + U64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            bins = ((hashes >> U64(32)) * U64(SIZE) >> U64(32)).astype(np.int64) if turn < SIZE else np.full(len(values), turn - SIZE)
            np.minimum.at(table, owner * SIZE + bins, U64(turn) << U64(32) | hashes & U64(0xFFFFFFFF))
            if turn < 12 or turn % 16 == 0:
                open_rows = (table.reshape(many, SIZE) == empty).any(axis=1)
                stay = open_rows[owner]
                if not stay.all():
                    values, owner = values[stay], owner[stay]
        return (mixed(table) >> U64(32)).astype(np.uint32).reshape(many, SIZE)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with the bytes and end offsets of their texts (column 1)."""
    texts = batch.column(1).cast(pa.large_string()).fill_null("")
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], (offsets[row + 1 : stop + 1] - offsets[row])
        row = stop


def signatures(docs: DataFrame, bands_made: int) -> DataFrame:
    """(doc_id, tag, n_shingles, print, sketch, bands): a hash of the text, a 128-bit print of the set, the low bytes of
    its sketch, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, ends in _chunks(batch):
                sets = shingle_sets(data, ends)
                table = sketches(sets)
                with np.errstate(over="ignore"):
                    keys = np.tile(np.arange(1, bands_made + 1, dtype=U64), (len(sets), 1))
                    for k in range(BAND_ROWS):
                        keys = mixed(keys * U64(0x9E3779B97F4A7C15) + table[:, k : bands_made * BAND_ROWS : BAND_ROWS])
                low = (table & 0xFF).astype(np.uint8)
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands_made), pa.array(keys.view(np.int64).ravel()))
                columns = [batch.column(0)[row:stop], batch.column(2)[row:stop], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "n_shingles", "print", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, tag long, n_shingles long, print binary, sketch binary, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the documents that are nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, ends in _chunks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], pa.array([s.tobytes() for s in shingle_sets(data, ends)], pa.binary())], names=["node", "shingles"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    return wanted.mapInArrow(run, "node long, shingles binary")


def linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose set sizes and sketches allow a link."""
    least = agreeing(percent)
    of = nodes.select("node", "n_shingles", "sketch")
    wide = pairs.join(of.toDF("a", "n_a", "s_a"), "a").join(of.toDF("b", "n_b", "s_b"), "b")
    wide = wide.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIZE) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return wide.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that are linked on their full sets."""
    wide = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return wide.mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of complete groups, from batches sorted by their first columns; a batch's last group waits for the next."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        columns = columns if held is None else [h + c for h, c in zip(held, columns)]
        marks = list(zip(*columns[:keys]))
        starts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1])]
        for a, b in zip(starts, starts[1:]):
            yield [c[a:b] for c in columns]
        held = [c[starts[-1] :] for c in columns] if marks else held
    if held is not None:
        yield held


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of n items' class under the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def clusters(members: DataFrame, percent: int) -> DataFrame:
    """(cluster, node): nodes of a bucket whose sketches may link them across components, for exact verification.

    `members` has (key, p, q, rest, node, component, n_shingles, sketch): a bucket's block and its rows, of which those with
    `rest` are held against the others.
    """
    least = agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, nodes = [], []
        for _, _, _, rest, node, component, size, sketch in _groups(batches, 3):
            rest, node, component, size = np.array(rest), np.array(node), np.array(component), np.array(size)
            table = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SIZE)
            others = np.flatnonzero(~rest)
            if not len(others):
                continue
            sizes, parts, sketches_of = size[others], component[others], table[others]
            left, right = [], []
            for i in np.flatnonzero(rest).tolist():
                near = np.flatnonzero((parts != component[i]) & (np.minimum(sizes, size[i]) * 100 >= np.maximum(sizes, size[i]) * percent))
                if len(near):
                    near = near[(sketches_of[near] == table[i]).sum(axis=1) >= least]
                    left.append(np.full(len(near), i))
                    right.append(others[near])
            a, b = (node[np.concatenate([*x, np.zeros(0, int)]).astype(int)] for x in (left, right))
            if not len(a):
                continue
            members_of, places = np.unique(np.concatenate([a, b]), return_inverse=True)
            size_of = dict(zip(node.tolist(), size.tolist()))
            together = sum(size_of[x] for x in members_of.tolist())
            if len(a) <= 2 * len(members_of) or together > GROUP_SHINGLES:
                found = [np.unique([x, y]) for x, y in zip(a.tolist(), b.tolist())]
            else:
                root = _roots(len(members_of), places[: len(a)], places[len(a) :])
                found = [members_of[root == r] for r in np.unique(root)]
            for group in found:
                name = int.from_bytes(hashlib.blake2b(group.tobytes(), digest_size=8).digest(), "little", signed=True)
                names += [name] * len(group)
                nodes += group.tolist()
            if len(names) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(nodes, pa.int64())], names=["cluster", "node"])
                names, nodes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(nodes, pa.int64())], names=["cluster", "node"])

    dealt = members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.select("key", "p", "q", "rest", "node", "component", "n_shingles", "sketch").mapInArrow(run, "cluster long, node long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of all pairs of sets, as products of 0/1 matrices of the elements that occur twice or more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    common = counts[place] > 1
    owner, place = owner[common], column[place[common]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        out += part @ part.T
    return out


def cluster_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what full sets link within each cluster; rows are (cluster, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, shingles in _groups(batches, 1):
            if len(node) == 2:
                a, b = ([node[0]], [node[1]]) if linked(*shingles, percent) else ([], [])
            else:
                sets = [np.frombuffer(s, U64) for s in shingles]
                sizes, shared = np.array([len(s) for s in sets], np.float64), intersections(sets).astype(np.float64)
                left, right = np.nonzero(100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared))
                root = _roots(len(node), left, right)
                a, b = [node[r] for r in root], node
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("cluster", "node", "shingles").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "a long, b long").where("a <> b")


def looked_through(within: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between what is outside a bucket's largest component and the rest of the bucket; `within` has
    (key, node, component, big, n, n_big)."""
    wide = within.join(nodes.select("node", "n_shingles", "sketch"), "node")
    blocks, rests = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("n_big")) / BLOCK).cast("int")
    place = lambda name, of: F.pmod(F.xxhash64(F.lit(name), "node"), of).cast("int")
    columns = ["key", "p", "q", "rest", "node", "component", "n_shingles", "sketch"]
    every = wide.withColumns({"rest": F.lit(False), "p": place("p", blocks), "q": F.explode(F.sequence(F.lit(0), rests - 1))})
    outside = wide.where("component <> big").withColumns({"rest": F.lit(True), "q": place("q", rests), "p": F.explode(F.sequence(F.lit(0), blocks - 1))})
    found = materialize(clusters(every.select(columns).union(outside.select(columns)), percent).distinct(), "clusters")
    sets = materialize(full_sets(docs, found.select("node").distinct()), "sets")
    return cluster_links(found.join(sets, "node"), percent)


def merged(whole: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) of `whole` with more links (a, b) between nodes."""

    def lifted(edges: DataFrame, column: str, other: str) -> DataFrame:
        named = looked_up(edges, column, other, whole.toDF("key", "found"))
        return named.withColumn(column, F.coalesce("found", column)).drop("found")

    links = materialize(links, "links")
    if links.isEmpty():
        return whole
    half = materialize(lifted(links, "a", "b"), "lifted")
    above = materialize(components(lifted(half, "b", "a")), "above")
    known = looked_up(whole, "component", "node", above.toDF("key", "found")).select("node", F.coalesce("found", "component").alias("component"))
    alone = above.toDF("node", "component").join(whole, "node", "left_anti")
    return materialize(known.unionByName(alone), "whole")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    return classes(docs, percent).drop("tag")


def keep(docs: DataFrame, percent: int = KEEP_PERCENT) -> DataFrame:
    """One row of docs, with all its columns, for each class of near duplicates; rows without words stay, as do their copies."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID)))
    found = classes(docs.select(own.alias("doc_id"), "text"), percent).where("kept")
    found = found.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("n_shingles").alias("_n")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), own.alias("_id"), F.xxhash64("text").alias("_tag"))
    once = rows.join(found, ["_id", "_tag"]).withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_tag").orderBy(F.lit(0))))
    return once.where("_nth = 1 or _n = 0").select("_row.*")


def classes(docs: DataFrame, percent: int) -> DataFrame:
    """near_duplicates with a hash of each row's text."""
    signed = materialize(signatures(docs, bands_for(percent)), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    prints = filled.groupBy("print").agg(F.min("doc_id").alias("node"))
    prints = materialize(prints, "prints")
    nodes = filled.join(prints, "print").where("doc_id = node").select("node", "n_shingles", "sketch", "bands")
    nodes = materialize(nodes, "nodes")
    bands = nodes.select("node", F.explode("bands").alias("key"))
    # Written, so that the join's sides are plain shuffles, of which Spark can split a partition with a hot bucket.
    buckets = materialize(bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    shared = materialize(bands.join(buckets, "key"), "buckets")

    def linked_by(pairs: DataFrame) -> DataFrame:
        close = materialize(alike(pairs.distinct(), nodes, percent), "stars")
        sets = full_sets(docs, close.select(F.col("a").alias("node")).union(close.select("b")).distinct())
        return verified(close, materialize(sets, "sets"), percent)

    whole = components(linked_by(shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))))
    for turn in range(LEADERS):
        held = shared.select("key", "node").join(whole, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        held = materialize(held, "held")
        parts = held.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("node").alias("low"))
        split = parts.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("big"), F.sum("n").alias("n"), F.max("n").alias("n_big"), F.count("*").alias("parts"))
        split = materialize(split.where("parts > 1"), "split")
        if split.isEmpty():
            break
        within = materialize(held.join(split, "key"), "within")
        if turn < LEADERS - 1:
            leads = within.where("component <> big").groupBy("key").agg(F.min_by(F.struct("node", "component"), F.struct(F.xxhash64("node"), "node")).alias("lead"))
            pairs = within.join(materialize(leads, "leads"), "key").where(F.col("component") != F.col("lead.component"))
            found = linked_by(pairs.select(F.col("lead.node").alias("a"), F.col("node").alias("b")))
        else:
            found = looked_through(within, docs, nodes, percent)
        whole = merged(whole, found)
    classes = prints.join(whole, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "tag", "n_shingles", "print").join(classes, "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    own = F.when(F.col("n_shingles") > 0, own).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tag", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))
