"""Exact top-k inner-product search with cover trees over queries and data.

Rows go to the nearest of a bounded number of pivots and, within a pivot, to blocks of bounded size. A block's rows form
one cover tree; queries arrive in batches, each with a tree of its own, and both trees are walked together: a query node
goes down with the data nodes that can still matter to it. A pair of nodes goes when its bound cannot reach the worst k-th
score of the query node. By the covering radii, no two rows of the nodes are nearer than the centres' distance less both
radii, and a product is half of the squared norms less the squared distance; the bound by the centres' product and the radii
is used where it is the lower one. A first pass over one block near each query gives its k-th score a start; the second
visits only pivots whose bound reaches that start, and deals the queries of a block to groups of bounded size.

Components are floor(scale * x) as long (what is beyond a long is held to its ends), and scores are exact at any size; a
score beyond a long counts as the nearest long. Ties go to the smaller id. Vectors that are null, empty, or hold null or
non-finite components, and rows with a null id, take no part. Only vectors of one length are compared. A repeated id is
queried once, with its first vector in order, and is no candidate of its own query; repeated rows are candidates each. An
empty table gives no rows. Only vec_id, embedding and what is_query names are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.storage import materialize

#: Most pivots, rows of a block, queries in a batch and in a group of a block, points of a leaf of
#: data and of queries, base of the levels' radii.
MOST_PIVOTS, ROWS_PER_PIVOT, BLOCK_ROWS, QUERY_BATCH, GROUP_QUERIES, LEAF, QUERY_LEAF, BASE = 256, 8192, 8192, 512, 1 << 16, 16, 4, 4 / 3
LEAVES_TOGETHER, BEAM = 64, 8
LOWEST = -(1 << 63)


@dataclass
class Tree:
    """A cover tree in arrays: node 0 is the root, children follow one another, a leaf's rows are order[low:high]."""

    points: np.ndarray
    order: np.ndarray
    level: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self) -> None:
        self.at = self.points[self.centre]
        self.squares = np.einsum("ij,ij->i", self.at, self.at)


def net(points: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """Rows in groups around centres, each group's first row: centres are farther apart than `radius`, which covers each group."""
    out: list[np.ndarray] = []
    while len(rows):
        near = _far(points[rows[:256]], points[rows[:256]]) <= radius
        centres, open_ = [], np.ones(len(near), bool)
        for i in range(len(near)):
            if open_[i]:
                centres.append(i)
                open_ &= ~near[i]
        far = _far(points[rows], points[rows[centres]])
        nearest = far.argmin(axis=1)
        nearest[centres] = np.arange(len(centres))
        inside = far[np.arange(len(rows)), nearest] <= radius
        inside[centres] = True
        for k, c in enumerate(centres):
            held = inside & (nearest == k)
            held[c] = False
            out.append(np.concatenate([rows[c : c + 1], rows[held]]))
        rows = rows[~inside]
    return out


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :]
    return np.sqrt(squares.clip(0))


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree over points: the children of a node at level i, at most BASE^i wide, are a net of BASE^(i - 1)."""
    norms = np.sqrt(np.einsum("ij,ij->i", points, points))
    rows_of, level, centre, radius, norm, first, last = [np.arange(len(points))], [], [], [], [], [], []
    at = 0
    while at < len(rows_of):
        rows = rows_of[at]
        far = _far(points[rows], points[rows[:1]])[:, 0]
        wide = float(far.max(initial=0.0))
        at += 1
        level.append(int(np.ceil(np.log(wide) / np.log(BASE))) if wide > 0 else -(1 << 30))
        centre.append(rows[0])
        radius.append(wide)
        norm.append(float(norms[rows].max()))
        first.append(len(rows_of))
        if len(rows) > leaf and wide > 0:
            parts = net(points, rows, BASE ** (level[-1] - 1))
            rows_of += parts if len(parts) > 1 else []
        last.append(len(rows_of))
    order, low, high, end = [], [], [], 0
    for rows, a, b in zip(rows_of, first, last):
        low.append(end)
        if a == b:
            order.append(rows)
            end += len(rows)
        high.append(end)
    arrays = (np.array(x) for x in (level, centre, radius, norm, first, last, low, high))
    return Tree(points, np.concatenate(order), *arrays)


@dataclass
class Visits:
    """Pairs of a query and a row that were scored, of all there are; pairs of nodes whose bound was worked out."""

    scored: int = 0
    total: int = 0
    bounds: int = 0


def bounds(queries: Tree, q: int, data: Tree, nodes: np.ndarray) -> np.ndarray:
    """No product of a row below query node q with one below the data nodes is greater."""
    product = data.at[nodes] @ queries.at[q]
    wide, radius = queries.radius[q], data.radius[nodes]
    long, norm = queries.norm[q], data.norm[nodes]
    by_centres = product + wide * np.sqrt(data.squares[nodes]) + radius * np.sqrt(queries.squares[q]) + wide * radius
    gap = np.sqrt((queries.squares[q] + data.squares[nodes] - 2 * product).clip(0)) - wide - radius
    by_distance = (long**2 + norm**2 - gap.clip(0) ** 2) / 2
    return np.minimum(by_centres, by_distance) + 1e-9 * (long**2 + norm**2) + 1e-3


def search(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, start: np.ndarray, k: int, tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray, Visits]:
    """Scores and data rows (k columns, best first, row -1 where fewer) of each query with scores of `start` at least.

    `ids` ascends, so that a score and the row's place make one number that breaks ties: score * n + (n - 1 - row). These
    numbers are 64-bit where all fit, and of any size elsewhere.
    """
    n, seen = len(data), Visits(total=len(data) * len(queries))
    tree, asked = tree or build(data.astype(np.float64)), build(queries.astype(np.float64), QUERY_LEAF)
    reach = max(1.0, float(np.abs(data).max()) * float(np.abs(queries).max()) * data.shape[1])
    small = reach < 2.0**52 and reach * n < 2.0**61
    least = -(1 << 62) if small else -int(reach * 2 + 2) * n - n
    if small:
        best = np.repeat(np.where(start > -(1 << 61) // n, np.maximum(start, -(1 << 61) // n) * n - 1, least)[:, None], k, axis=1)
    else:
        best = np.repeat(np.array([int(x) * n - 1 if x > LOWEST else least for x in start], object)[:, None], k, axis=1)
        exact_data, exact_queries = data.astype(object), queries.astype(object)

    def score(of: np.ndarray, rows: np.ndarray) -> None:
        if small:
            keys = np.rint(asked.points[of] @ tree.points[rows].T).astype(np.int64) * n
        else:
            keys = np.clip(exact_queries[of] @ exact_data[rows].T, -(1 << 63), (1 << 63) - 1) * n
        keys = keys + (n - 1 - rows)[None, :]
        keys[own[of][:, None] == ids[rows][None, :]] = least - 1
        merged = np.concatenate([best[of], keys], axis=1)
        if small and merged.shape[1] > 4 * k:
            merged = np.take_along_axis(merged, np.argpartition(-merged, k - 1, axis=1)[:, :k], axis=1)
        best[of] = -np.sort(-merged, axis=1)[:, :k]
        seen.scored += len(of) * len(rows)

    def held(reaches: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which nodes, by their bounds, may still give one of the queries a row."""
        worst = min(best[of, -1].tolist())
        if small:
            return np.floor(reaches) * n + n - 1 >= worst
        return np.array([int(np.floor(x)) * n + n - 1 >= worst for x in reaches], bool)

    def below(q: int) -> np.ndarray:
        found, todo = [], [q]
        while todo:
            x = todo.pop()
            found.append(asked.order[asked.low[x] : asked.high[x]])
            todo += range(asked.first[x], asked.last[x])
        return np.concatenate(found)

    # Queries without a start get one from the few leaves that the greatest bounds lead to.
    for q in np.flatnonzero(asked.first == asked.last).tolist():
        of, nodes = asked.order[asked.low[q] : asked.high[q]], np.array([0])
        while (best[of, -1] == least).any():
            reaches = bounds(asked, q, tree, nodes)
            seen.bounds += len(nodes)
            nodes = nodes[np.argsort(-reaches, kind="stable")[:BEAM]]
            inner = tree.first[nodes] < tree.last[nodes]
            if not inner.any():
                score(of, np.concatenate([tree.order[tree.low[x] : tree.high[x]] for x in nodes]))
                break
            nodes = np.concatenate([nodes[~inner], *[np.arange(tree.first[x], tree.last[x]) for x in nodes[inner]]])
    # Only the scores stay: the rows are found again below.
    floor = best[:, -1:]
    floor = np.where((floor > least) & (start[:, None] <= LOWEST), floor // n * n - 1, floor)
    best = np.repeat(floor, k, axis=1)

    todo = [(0, np.array([0]))]
    while todo:
        q, nodes = todo.pop()
        of = below(q)
        reaches = bounds(asked, q, tree, nodes)
        seen.bounds += len(nodes)
        keep = held(reaches, of)
        nodes, reaches = nodes[keep], reaches[keep]
        inner = tree.first[nodes] < tree.last[nodes]
        if not len(nodes):
            continue
        if asked.first[q] < asked.last[q] and (not inner.any() or tree.radius[nodes].max() <= asked.radius[q]):
            todo += [(child, nodes) for child in range(asked.first[q], asked.last[q])]
        elif inner.any():
            wide = inner & (tree.radius[nodes] >= BASE ** -1 * tree.radius[nodes][inner].max())
            children = [np.arange(tree.first[x], tree.last[x]) for x in nodes[wide]]
            todo.append((q, np.concatenate([nodes[~wide], *children])))
        else:
            order = np.argsort(-reaches, kind="stable")
            a, together = 0, 2
            while a < len(order):
                part = order[a : a + together]
                a, together = a + together, min(2 * together, LEAVES_TOGETHER)
                part = part[held(reaches[part], of)]
                if not len(part):
                    break
                score(of, np.concatenate([tree.order[tree.low[x] : tree.high[x]] for x in nodes[part]]))
    some = best > least
    scores, rows = best // n, n - 1 - best % n
    some &= (scores >= start[:, None]) | (start[:, None] <= LOWEST)
    scores = np.where(some, scores, 0)
    return scores.astype(np.int64), np.where(some, rows, -1).astype(np.int64), seen


def usable(column: str) -> Column:
    bad = "x -> x is null or isnan(cast(x as double)) or abs(cast(x as double)) = double('infinity')"
    return F.expr(f"{column} is not null and size({column}) > 0 and not exists({column}, {bad})")


def _array(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _visits(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each block for each query sent to it; `rows` has data (kind 0) and
    queries (kind 1), keyed by dim, pivot, block, part. A block's data is held; its queries stream by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None, "data": [], "queries": [], "tree": None}

        def flush() -> pa.RecordBatch | None:
            held, state["queries"] = state["queries"], []
            if not held or not state["data"]:
                return None
            if state["tree"] is None:
                ids, data = np.concatenate([i for i, _ in state["data"]]), np.concatenate([x for _, x in state["data"]])
                state["data"], state["tree"] = [(ids, data)], build(data.astype(np.float64))
            ids, data = state["data"][0]
            own, vectors, start = (np.concatenate([h[n] for h in held]) for n in range(3))
            scores, rows, _ = search(data, ids, vectors, own, start, k, state["tree"])
            which, place = np.nonzero(rows >= 0)
            return pa.RecordBatch.from_arrays([pa.array(own[which]), pa.array(ids[rows[which, place]]), pa.array(scores[which, place])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            key = np.stack([batch.column(n).to_numpy() for n in ("dim", "pivot", "block", "part", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), tuple(key[a, :4].tolist())
                if here != state["key"]:
                    if (out := flush()) is not None:
                        yield out
                    state.update(key=here, data=[], tree=None)
                ids, vectors = part.column("vec_id").to_numpy(), _array(part.column("vector"))
                if key[a, 4] == 0:
                    state["data"].append((ids, vectors))
                else:
                    for c in range(0, b - a, QUERY_BATCH):
                        state["queries"].append((ids[c : c + QUERY_BATCH], vectors[c : c + QUERY_BATCH], part.column("start").to_numpy()[c : c + QUERY_BATCH]))
                        if sum(len(h[0]) for h in state["queries"]) >= QUERY_BATCH and (out := flush()) is not None:
                            yield out
        if (out := flush()) is not None:
            yield out

    keyed = rows.select("dim", "pivot", "block", "part", "kind", "vec_id", "start", "vector").repartition("dim", "pivot", "block", "part")
    return keyed.sortWithinPartitions("dim", "pivot", "block", "part", "kind", "vec_id").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `vectors` (vec_id, embedding) for each row that is_query marks."""
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), is_query.alias("asks"), whole.alias("vector"))
    rows = materialize(rows.withColumn("dim", F.size("vector")), "vectors")
    n = rows.count()
    wanted = min(MOST_PIVOTS, max(1, n // ROWS_PER_PIVOT))
    pivots: dict[int, np.ndarray] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("dim", "vector").collect():
        pivots[r.dim] = np.array([*pivots.get(r.dim, []), r.vector], float)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                points = _array(part.column("vector")).astype(np.float64)
                centres = shared.value.get(int(dim), np.zeros((1, int(dim))))
                far = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]).clip(0)
                nearest = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest.astype(np.int32)), pa.array(np.sqrt(far.min(axis=1)))], names=[*part.schema.names, "pivot", "away"])

    placed = materialize(rows.mapInArrow(assign, "vec_id long, asks boolean, vector array<long>, dim int, pivot int, away double"), "placed")
    cells = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    blocks = {(c.dim, c.pivot): -(-c.n // BLOCK_ROWS) for c in cells}
    table = rows.sparkSession.createDataFrame([(*key, b) for key, b in blocks.items()] or [(0, 0, 1)], "dim int, pivot int, blocks int")
    data = placed.join(F.broadcast(table), ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    data = data.select("dim", "pivot", "block", F.lit(0).alias("kind"), "vec_id", F.lit(LOWEST).alias("start"), "vector")
    asked = materialize(placed.where("asks").groupBy("vec_id").agg(F.min(F.struct("vector", "dim", "pivot")).alias("q")).select("vec_id", "q.*"), "asked")
    groups = max(1, -(-asked.count() // GROUP_QUERIES))

    def visited(queries: DataFrame) -> DataFrame:
        """_visits of queries (dim, pivot, block, vec_id, start, vector); a block goes to each group that asks it."""
        dealt = queries.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(groups)).cast("int")).withColumn("kind", F.lit(1))
        copies = data.join(dealt.select("dim", "pivot", "block", "part").distinct(), ["dim", "pivot", "block"])
        return _visits(copies.unionByName(dealt), k)

    home = asked.join(F.broadcast(table), ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    home = home.select("dim", "pivot", "block", "vec_id", F.lit(LOWEST).alias("start"), "vector")
    near = visited(home).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(LOWEST)).alias("start"))
    started = asked.drop("pivot").join(near, asked.vec_id == near.query_id, "left").select("vec_id", "vector", "dim", F.coalesce("start", F.lit(LOWEST)).alias("start"))

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, start = batch.column("dim").to_numpy(), batch.column("start").to_numpy()
            for cell in cells:
                at = np.flatnonzero(dims == cell.dim)
                if len(at):
                    points = _array(batch.column("vector").take(pa.array(at))).astype(np.float64)
                    centre = shared.value.get(cell.dim, np.zeros((1, cell.dim)))[cell.pivot]
                    long, middle = np.sqrt((points**2).sum(1)), float(np.sqrt(centre @ centre))
                    bound = points @ centre + long * cell.radius
                    at = at[bound + 1e-9 * long * (middle + cell.radius) + 1e-3 >= start[at]]
                    for block in range(blocks[cell.dim, cell.pivot]):
                        part = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(np.full(len(at), cell.pivot, np.int32)), pa.array(np.full(len(at), block, np.int32)), part.column("vec_id"), part.column("start"), part.column("vector")], names=["dim", "pivot", "block", "vec_id", "start", "vector"])

    sent = materialize(started.mapInArrow(reachable, "dim int, pivot int, block int, vec_id long, start long, vector array<long>"), "sent")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return visited(sent).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
