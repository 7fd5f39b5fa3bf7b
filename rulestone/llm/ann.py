"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Largest inner products become nearest points by one more coordinate, which brings all candidates to one length. Vectors
are projected to a few dimensions by independent Gaussians; the squared length of a projected difference, over that of
the difference itself, follows a chi-square law. The projected space is cut into cells by one kd-tree. A query first looks
into the cells nearest to it; from what it finds there the chi-square test tells which others can hold a better neighbour,
and it is sent to these alone. Within a cell candidates stand in a kd-tree, are met by projected distance, and are verified on
their original vectors until the test says that a better one than the k-th found would have been met by now with the
wanted chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

#: Projected dimensions (even), the chance of the stopping test, seed of the Gaussians.
PROJECTED, CHANCE, SEED = 16, 0.97, 20
#: Candidates of one part of a cell; queries that meet it in one task; points of a tree's leaf; leaves before the first test.
BLOCK, QUERY_BLOCK, LEAF, STEP = 16384, 4096, 48, 8
#: Queries of a block that are taken together; what single precision may err by, for vectors of length 1.
TOGETHER, SLACK = 64, 2e-5
#: Cells that a query looks into at first.
PROBES = 4
#: Most projected vectors that the cells are cut by; all vectors are dealt to cells.
SAMPLE = 65_536
#: Rows of a table that is broadcast at most; larger ones are joined by a shuffle.
SMALL_ROWS = 100_000


def chi_square(x: float, dimensions: int) -> float:
    """Distribution function, for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dimensions // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def stopping_ratio(chance: float = CHANCE, dimensions: int = PROJECTED) -> float:
    """The value that a chi-square variable stays under with that chance."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < chance else (low, middle)
    return high


@dataclass
class Space:
    """The projection of vectors of one length: reach is the largest squared length of a candidate."""

    dim: int
    reach: float

    def __post_init__(self) -> None:
        self.gaussians = np.random.default_rng([SEED, self.dim]).standard_normal((self.dim + 1, PROJECTED))

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        norms = (vectors * vectors).sum(1)
        return np.c_[vectors, np.sqrt(np.maximum(self.reach - norms, 0))] @ self.gaussians

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        """Queries are scaled to the candidates' length, which leaves their order; the added coordinate is 0."""
        lengths = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        return (vectors * (np.sqrt(self.reach) / lengths)) @ self.gaussians[:-1]

    def far(self, score: float, length: float) -> float:
        """Squared distance of a candidate with that score from the scaled query."""
        return max(0.0, 2 * self.reach - 2 * score * np.sqrt(self.reach) / length)


@dataclass
class Tree:
    """order: points leaf by leaf; bounds: first and last place of each leaf; low, high: its box."""

    order: np.ndarray
    bounds: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Cut at the median of the widest dimension down to leaves."""
    order, todo, leaves = np.arange(len(points)), [(0, len(points))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            leaves.append((lo, hi))
            continue
        own = points[order[lo:hi]]
        axis, middle = int(np.argmax(own.max(0) - own.min(0))), (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], middle)]
        todo += [(lo, lo + middle), (lo + middle, hi)]
    bounds = np.array(leaves)
    low = np.array([points[order[a:b]].min(0) for a, b in leaves])
    high = np.array([points[order[a:b]].max(0) for a, b in leaves])
    return Tree(order, bounds, low, high)


@dataclass
class Cells:
    """Cuts of a projected space: for each node its axis and value, and its two children, cells being -1 - number."""

    axis: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    number: int = 1

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        found = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.axis else []
        while todo:
            node, own = todo.pop()
            above = points[own, self.axis[node]] > self.value[node]
            for child, part in zip(self.children[node], (own[~above], own[above]), strict=True):
                if child < 0:
                    found[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return found


def cut_cells(points: np.ndarray, wanted: int) -> Cells:
    """Cuts at medians of the widest dimensions, largest pieces first, until there are so many cells or no cut is left."""
    cells = Cells()
    if not len(points):
        return cells
    pieces: list[tuple[int, np.ndarray, tuple[int, int] | None]] = [(len(points), np.arange(len(points)), None)]
    done: list[tuple[int, int] | None] = []
    while pieces:
        pieces.sort(key=lambda p: p[0])
        n, own, slot = pieces.pop()
        axis = int(np.argmax(points[own].max(0) - points[own].min(0)))
        value = float(np.median(points[own, axis]))
        above = points[own, axis] > value
        if len(pieces) + len(done) + 2 > wanted or n < 2 or above.all() or not above.any():
            done.append(slot)
            continue
        node = len(cells.axis)
        cells.axis.append(axis)
        cells.value.append(value)
        cells.children.append([0, 0])
        if slot is not None:
            cells.children[slot[0]][slot[1]] = node
        pieces += [(int((~above).sum()), own[~above], (node, 0)), (int(above.sum()), own[above], (node, 1))]
    for number, slot in enumerate(done):
        if slot is not None:
            cells.children[slot[0]][slot[1]] = -1 - number
    cells.number = len(done)
    return cells


class Block:
    """Candidates of one part of a cell with their tree: distinct vectors, each with its least ids in order.

    The walk is made on single-precision copies of one scale, with SLACK on all that it leaves out; what can be among the
    best is scored anew on the original vectors, alike for equal ones."""

    def __init__(self, space: Space, vectors: np.ndarray, ids: list[list[int]], chance: float):
        points = space.candidates(vectors)
        tree = build_tree(points)
        self.space, self.ratio, self.scale = space, stopping_ratio(chance), float(np.sqrt(space.reach))
        self.vectors, self.ids = vectors[tree.order], [ids[i] for i in tree.order.tolist()]
        self.unit = (self.vectors / self.scale).astype(np.float32)
        self.points = (points[tree.order] / self.scale).astype(np.float32)
        self.norms = (self.points * self.points).sum(1)
        self.bounds, self.low, self.high = tree.bounds, tree.low / self.scale, tree.high / self.scale

    def floors(self, shown: np.ndarray) -> np.ndarray:
        """Squared projected distance of each query from each leaf's box."""
        found = np.zeros((len(shown), len(self.bounds)))
        for axis in range(shown.shape[1]):
            at = shown[:, axis, None]
            gap = np.maximum(np.maximum(self.low[:, axis] - at, at - self.high[:, axis]), 0)
            found += gap * gap
        return found

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        """Places of the leaves' points."""
        begins, ends = self.bounds[leaves, 0], self.bounds[leaves, 1]
        sizes = ends - begins
        return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)

    def nearest(self, queries: np.ndarray, shown: np.ndarray, k: int, far: np.ndarray) -> Iterator[tuple[int, list[tuple[float, int]], int]]:
        """For each query its place, (score, id) of the k best found, ties to smaller ids, and how many candidates were
        verified. shown: projected queries; far: squared distance of the k-th found elsewhere. Queries near each other are
        taken together, so that leaves open to none of them are left out before points are looked at."""
        floors = self.floors(shown / self.scale)
        alike = np.argsort(floors.argmin(1), kind="stable")
        for at in range(0, len(alike), TOGETHER):
            own = alike[at : at + TOGETHER]
            yield from self._together(own, queries[own], (shown[own] / self.scale).astype(np.float32), floors[own], k, far[own] / self.space.reach)

    def _together(self, names: np.ndarray, queries: np.ndarray, shown: np.ndarray, floors: np.ndarray, k: int, far: np.ndarray) -> Iterator[tuple[int, list[tuple[float, int]], int]]:
        lengths = np.sqrt((queries * queries).sum(1))
        directions = (queries / lengths[:, None]).astype(np.float32)
        walks = [_Walk(self, directions[i], k, float(far[i])) for i in range(len(names))]
        nearest = np.argsort(floors, axis=1, kind="stable")[:, :STEP]
        for i, walk in enumerate(walks):
            walk.verify(self.rows(np.sort(nearest[i][floors[i, nearest[i]] <= walk.reach()])))
        open_ = floors <= np.array([walk.reach() for walk in walks])[:, None]
        np.put_along_axis(open_, nearest, False, 1)
        leaves = np.flatnonzero(open_.any(0))
        if len(leaves):
            rows = self.rows(leaves)
            of_leaf = np.repeat(leaves, self.bounds[leaves, 1] - self.bounds[leaves, 0])
            away = self.norms[rows] + (shown * shown).sum(1)[:, None] - 2 * (shown @ self.points[rows].T)
            for i, walk in enumerate(walks):
                own = np.flatnonzero(open_[i, of_leaf] & (away[i] <= walk.reach()))
                step = STEP * LEAF
                while len(own):  # by projected distance, twice as many each time
                    if len(own) > 2 * step:
                        by = np.argpartition(away[i, own], step)
                        own, then = own[by[:step]], own[by[step:]]
                    else:
                        then = own[:0]
                    walk.verify(rows[np.sort(own)])
                    own, step = then[away[i, then] <= walk.reach()], 2 * step
        for name, query, walk in zip(names.tolist(), queries, walks, strict=True):
            own = walk.places
            scores = (self.vectors[own] * query).sum(1)
            best = [(score, j) for score, point in zip(scores.tolist(), own.tolist(), strict=True) for j in self.ids[point][:k]]
            best.sort(key=lambda x: (-x[0], x[1]))
            yield name, best[:k], walk.verified


class _Walk:
    """One query's way through a block: the candidates verified so far that can be among its k best."""

    def __init__(self, block: Block, direction: np.ndarray, k: int, far: float):
        self.block, self.direction, self.k, self.far = block, direction, k, far
        self.verified, self.places, self.scores = 0, np.empty(0, np.int64), np.empty(0, np.float32)

    def least(self) -> float:
        """The k-th score less SLACK."""
        if len(self.scores) < self.k:
            return -np.inf
        return float(np.partition(self.scores, len(self.scores) - self.k)[len(self.scores) - self.k]) - SLACK

    def reach(self) -> float:
        """Squared projected distance from which on a better one is too unlikely."""
        bound = min(self.far, max(0.0, 2 - 2 * self.least()))
        return self.block.ratio * bound + PROJECTED * SLACK

    def verify(self, places: np.ndarray) -> None:
        found = self.block.unit[places] @ self.direction
        self.verified += len(places)
        keep = found >= self.least()
        self.places, self.scores = np.concatenate([self.places, places[keep]]), np.concatenate([self.scores, found[keep]])
        keep = self.scores >= self.least()
        self.places, self.scores = self.places[keep], self.scores[keep]


def usable(vector: str = "embedding") -> Column:
    """Neither null, empty nor zero, without null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def placed(rows: DataFrame, spaces: dict[int, Space], cells: dict[int, Cells], *, queries: bool) -> DataFrame:
    """rows (id, dim, v and, of candidates, ids) with p, the projected vector, and cell."""
    ids = F.lit(None).cast("array<long>").alias("ids") if queries else F.col("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                vectors = _matrix(own.column(2), own.num_rows)
                shown = spaces[dim].queries(vectors) if queries else spaces[dim].candidates(vectors)
                at = cells.get(dim, Cells()).of(shown)
                yield pa.RecordBatch.from_arrays([*own.columns, _lists(shown), pa.array(at)], names=["id", "dim", "v", "ids", "p", "cell"])

    return rows.select("id", "dim", "v", ids).mapInArrow(run, "id long, dim int, v array<double>, ids array<long>, p array<double>, cell long")


FOUND = "id long, vec_id long, score double, verified long"


def _meet(queries: DataFrame, candidates: DataFrame, spaces: dict[int, Space], k: int, chance: float) -> DataFrame:
    """queries: id, dim, cell, part, v, p, far; candidates: dim, cell, part, v, ids. Each query's best k in that part of
    its cell: id, vec_id, score, and verified (in one of its rows, 0 in the others; a query that finds nothing has a row
    with null vec_id). Queries of one part of a cell are dealt out by QUERY_BLOCK."""
    unit = ["dim", "cell", "part"]
    counts = queries.groupBy(*unit).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    counts = checkpoint(counts)
    counts = F.broadcast(counts) if counts.count() <= SMALL_ROWS else counts
    none = F.lit(None)
    asking = queries.join(counts, unit).select(
        *unit, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v", "p", "far", none.cast("array<long>").alias("ids")
    )
    offered = candidates.join(counts, unit).select(
        *unit,
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        none.cast("long").alias("id"),
        "v",
        none.cast("array<double>").alias("p"),
        none.cast("double").alias("far"),
        "ids",
    )

    def run(key: tuple, group: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, float | None, int]] = []
        is_query = group.column("id").is_valid().to_numpy()
        theirs = group.filter(pa.array(~is_query))
        if is_query.any():
            own = group.filter(pa.array(is_query))
            index = None
            if theirs.num_rows:
                index = Block(spaces[key[0].as_py()], _matrix(theirs.column("v"), theirs.num_rows), theirs.column("ids").to_pylist(), chance)
            names = own.column("id").to_pylist()
            far = np.array([np.inf if x is None else x for x in own.column("far").to_pylist()])
            nothing = ((at, [], 0) for at in range(len(names)))
            asked = index.nearest(_matrix(own.column("v"), own.num_rows), _matrix(own.column("p"), own.num_rows), k, far) if index else nothing
            for of, best, verified in asked:
                name = names[of]
                out += [(name, i, s, 0 if at else verified) for at, (s, i) in enumerate(best)] or [(name, None, None, verified)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "vec_id", "score", "verified"])

    return asking.unionByName(offered).groupBy(*unit, "block").applyInArrow(run, FOUND)


def search(vectors: DataFrame, every: int = 20, k: int = 20, chance: float = CHANCE, block: int = BLOCK) -> DataFrame:
    """Queries: rows whose vec_id is divisible by every; candidates: all rows but those of the query's id. Returns
    query_id, rank (from 1), vec_id, score (inner product in double precision), verified (how many distinct candidates
    were scored for the query).

    Vectors that usable() rejects, and rows without vec_id, take no part; vectors are compared with those of as many
    components; repeated rows count once; ties go to the smaller id; a query with fewer candidates gets all; other
    columns are not looked at; an empty table gives an empty one.

    Equal vectors are one point with its k + 1 least ids, and one query, so a vector that a third of all rows hold is
    searched once. Cells are cut by at most SAMPLE projected vectors; a cell of more than `block` candidates is dealt out
    in parts by hash, so each task meets bounded numbers of both sides, and a query's best of all tasks are merged.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable()).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim")
    )
    rows = checkpoint(rows.distinct())
    wanted = k + 1  # the query itself may be among them
    least = F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))
    few = rows.withColumn("r", least).filter(F.col("r") <= wanted)
    points = few.groupBy("dim", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = checkpoint(points.withColumn("id", F.monotonically_increasing_id()))
    asked = rows.filter(F.col("vec_id") % every == 0)
    distinct = checkpoint(asked.select("dim", "v").distinct().withColumn("id", F.monotonically_increasing_id()))

    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    sizes = {r.dim: (r.reach, r.n) for r in points.groupBy("dim").agg(F.max(norm).alias("reach"), F.count("*").alias("n")).collect()}
    spaces = {dim: Space(dim, reach) for dim, (reach, _) in sizes.items()}
    total = sum(n for _, n in sizes.values())
    share = min(1.0, SAMPLE / max(total, 1))
    picked = points.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE)
    sample = placed(picked, spaces, {}, queries=False).select("dim", "p").toArrow()
    of = sample.column("dim").to_numpy()
    shown = _matrix(sample.column("p"), sample.num_rows) if sample.num_rows else np.empty((0, PROJECTED))
    cells = {dim: cut_cells(shown[of == dim], -(-n // block)) for dim, (_, n) in sizes.items()}

    dealt = checkpoint(placed(points, spaces, cells, queries=False))
    boxes = [F.struct(*[f(F.get("p", F.lit(i))).alias(f"c{i}") for i in range(PROJECTED)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    found = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), *boxes).collect()  # at most SAMPLE cells, and one for each length
    units: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    for dim in sizes:
        own = [r for r in found if r.dim == dim]
        units[dim] = np.array([r.cell for r in own]), np.array([-(-r.n // block) for r in own]), np.array([tuple(r.low) for r in own]), np.array([tuple(r.high) for r in own])
    shared = rows.sparkSession.sparkContext.broadcast(units)
    ratio = stopping_ratio(chance)
    parts = rows.sparkSession.createDataFrame([(r.dim, r.cell, int(-(-r.n // block))) for r in found], "dim int, cell long, parts int")
    parts = F.broadcast(parts) if len(found) <= SMALL_ROWS else parts
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    candidates = dealt.join(parts, ["dim", "cell"]).select("dim", "cell", part, "v", "ids")

    queries = checkpoint(placed(distinct, spaces, cells, queries=True).select("id", "dim", "v", "p"))

    def routed(asking: DataFrame, first: bool) -> DataFrame:
        """id, dim, cell, part, far for each part of a cell that a query goes to: the nearest at first, then all others
        that can hold a better neighbour than the worst it has."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, int, int, float | None]] = []
                for name, dim, query, shown, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at, of_cell, low, high = shared.value[dim]
                    gap = np.maximum(np.maximum(low - shown, np.array(shown) - high), 0)
                    floor = (gap * gap).sum(1)
                    nearest = np.argsort(floor, kind="stable")[:PROBES].tolist()
                    probed = {(int(at[c]), name % int(of_cell[c])) for c in nearest}
                    if first:
                        out += [(name, dim, c, p, None) for c, p in sorted(probed)]
                        continue
                    far = None if score is None else spaces[dim].far(score, float(np.sqrt(np.dot(query, query))))
                    open_ = floor <= ratio * (np.inf if far is None else far)
                    out += [(name, dim, c, p, far) for c, n in zip(at[open_].tolist(), of_cell[open_].tolist(), strict=True) for p in range(n) if (c, p) not in probed]
                columns = list(zip(*out, strict=True)) or [(), (), (), (), ()]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "dim", "cell", "part", "far"])

        return checkpoint(asking.select("id", "dim", "v", "p", "worst").mapInArrow(run, "id long, dim int, cell long, part int, far double"))

    def meet(asking: DataFrame, first: bool) -> DataFrame:
        return _meet(routed(asking, first).join(queries.select("id", "v", "p"), "id"), candidates, spaces, wanted, chance)

    first = checkpoint(meet(queries.withColumn("worst", F.lit(None).cast("double")), True))
    ranked = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "vec_id"))
    best = first.filter(F.col("vec_id").isNotNull()).withColumn("at", ranked).filter(F.col("at") <= wanted)
    worst = best.groupBy("id").agg(F.when(F.count("*") == wanted, F.min("score")).alias("worst"))
    second = meet(queries.join(worst, "id", "left"), False)

    both = checkpoint(first.unionByName(second))
    best = both.filter(F.col("vec_id").isNotNull()).withColumn("at", ranked).filter(F.col("at") <= wanted)
    best = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("best"))
    best = best.join(both.groupBy("id").agg(F.sum("verified").alias("verified")), "id").join(distinct, "id").select("dim", "v", "best", "verified")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.withColumnRenamed("vec_id", "query_id")
        .join(best, ["dim", "v"])
        .select("query_id", "verified", others.alias("best"))
        .select("query_id", "verified", F.posexplode("best").alias("at", "b"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score", "verified")
    )
