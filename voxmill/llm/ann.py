"""Approximate nearest neighbours by stable projections and kd-trees.

Largest inner product becomes nearest distance by one more coordinate:
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), with M the largest norm, have
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x. A Gaussian (2-stable) projection to a few
dimensions keeps these distances up to a chi-square factor: projected distance
over true distance, squared, is chi-square with that many degrees of freedom.

Rows are cut into cells by a kd-tree over the projections, and each cell into
leaves by a finer one. A query takes the rows of the leaves that it cannot
exclude one after the other in order of their projected distance, verifies
each by its inner product, and stops at the first whose projected distance is
so large that a row nearer than the k-th best so far would, with the set
confidence, have been projected nearer. The first pass searches a query's own
cell, the second all others that its bound cannot exclude.

Equal vectors are one entry with their smallest ids, so copies cost nothing
and ties come out by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

PROJECTED = 16  # even, for the closed form of chi-square
CONFIDENCE = 0.95
CELL_ROWS = 4096
CELLS = (16, 1 << 14)
LEAF = 64
STEP = 256  # rows that are verified between two looks at the bound
SAMPLE = 1 << 16  # rows that choose the cells' borders; every row is indexed
SEED = 20


def chi_square_quantile(p: float, degrees: int) -> float:
    """For even degrees."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(degrees // 2))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


class Projection:
    def __init__(self, d: int, most: float, m: int = PROJECTED, seed: int = SEED):
        self.d, self.most, self.normal = d, most, np.random.default_rng(seed).standard_normal((d + 1, m))

    def rows(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.most**2 - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.normal[:-1] + extra[:, None] * self.normal[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.normal[:-1]

    def squared(self, norm2: float, product: float) -> float:
        """True squared distance from an inner product."""
        return max(norm2 + self.most**2 - 2 * product, 0.0) if product > -math.inf else math.inf


def _gaps(lo: np.ndarray, hi: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point to every box."""
    return (np.maximum(np.maximum(lo - point, point - hi), 0) ** 2).sum(axis=1)


class Cells:
    """A kd-tree's borders: 2^depth cells that fill the projected space."""

    def __init__(self, sample: np.ndarray, depth: int):
        m = sample.shape[1]
        self.depth, n = depth, 1 << depth
        self.axis, self.at = np.zeros(n, np.int64), np.zeros(n)
        self.lo, self.hi = np.full((n, m), -np.inf), np.full((n, m), np.inf)
        self._split(sample, 1, np.full(m, -np.inf), np.full(m, np.inf))

    def _split(self, points: np.ndarray, node: int, lo: np.ndarray, hi: np.ndarray) -> None:
        if node >= 1 << self.depth:
            self.lo[node - (1 << self.depth)], self.hi[node - (1 << self.depth)] = lo, hi
            return
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
        at = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.at[node] = axis, at
        left = points[:, axis] <= at if len(points) else np.zeros(0, bool)
        low, high = hi.copy(), lo.copy()
        low[axis], high[axis] = min(at, hi[axis]), max(at, lo[axis])
        self._split(points[left], 2 * node, lo, low)
        self._split(points[~left], 2 * node + 1, high, hi)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)

    def gaps(self, point: np.ndarray) -> np.ndarray:
        return _gaps(self.lo, self.hi, point)


def _leaves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree, cut at medians of the widest axis."""
    if len(rows) <= LEAF:
        return [rows]
    own = points[rows]
    axis = int(np.argmax(np.ptp(own, axis=0)))
    order = np.argpartition(own[:, axis], len(rows) // 2)
    return _leaves(points, rows[order[: len(rows) // 2]]) + _leaves(points, rows[order[len(rows) // 2 :]])


class Tree:
    """The rows of one cell under a kd-tree over their projections."""

    def __init__(self, projection: Projection, x: np.ndarray, ids: np.ndarray):
        points = projection.rows(x)
        leaves = _leaves(points, np.arange(len(x)))
        order = np.concatenate(leaves)
        self.projection, self.x, self.ids, self.points = projection, x[order], ids[order], points[order]
        ends = np.cumsum([len(r) for r in leaves])
        self.leaf = np.repeat(np.arange(len(leaves)), [len(r) for r in leaves])
        starts = np.concatenate(([0], ends[:-1]))
        self.lo, self.hi = np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts)

    def nearest(self, q: np.ndarray, k: int, factor: float, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and products of the k best rows, ties to the smaller id, of those that are of use, and how many rows were verified.

        floor: a product that k rows elsewhere reach. A row's product is a sum
        in fixed order, so it doesn't depend on the rows beside it.
        """
        target, norm2 = self.projection.queries(q[None])[0], float(np.einsum("i,i->", q, q))
        bound = self.projection.squared(norm2, floor) * factor
        rows = np.flatnonzero((_gaps(self.lo, self.hi, target) <= bound)[self.leaf])
        far = ((self.points[rows] - target) ** 2).sum(axis=1)
        within = far <= bound
        rows, far = rows[within], far[within]
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], far[order]
        scores, ids, at = np.zeros(0), np.zeros(0, np.int64), 0
        while at < len(rows):
            stop = min(at + STEP, int(np.searchsorted(far, bound, side="right")))
            if stop <= at:
                break
            own = rows[at:stop]
            found = np.einsum("ij,j->i", self.x[own], q)
            use = found >= floor
            if use.any():
                scores, ids = np.concatenate((scores, found[use])), np.concatenate((ids, self.ids[own[use]]))
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    floor = max(floor, float(scores[-1]))
                    bound = self.projection.squared(norm2, floor) * factor
            at = stop
        return ids, scores, at


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, projected: int = PROJECTED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, verified: for each row whose id is divisible by `every`, its k rows of largest inner product, without itself; verified is the number of different vectors that were compared in full for it.

    Ties go to the smaller id. Vectors that are null, empty, zero, or hold a
    null or non-finite component, and rows with a null id take no part.
    Vectors of different lengths have no inner product: each length is searched
    by itself. Rows that repeat id and vector count once; of an id with several
    vectors each is a candidate. An empty table gives an empty one. Other
    columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark, 4096)
    v = F.col(vector_col).cast("array<double>")
    own = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    own = own.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)).distinct()
    own = written(own, "ann-rows")
    lengths = own.groupBy(F.size("vec").alias("d")).agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).orderBy("d").collect()  # one row per length of vectors
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    for r in lengths:
        found = _of_length(own.filter(F.size("vec") == r["d"]), k, every, Projection(r["d"], math.sqrt(r["most"]), projected), chi_square_quantile(confidence, projected))
        out = found if len(lengths) == 1 else out.unionByName(found)
    return out


def _of_length(own: DataFrame, k: int, every: int, projection: Projection, factor: float) -> DataFrame:
    d = projection.d
    # classes of equal vectors; only a class's k + 1 smallest ids can be among anyone's k nearest
    classes = written(own.groupBy("vec").agg(F.min("id").alias("head"), F.max(F.col("id") % every == 0).alias("asks")), "ann-classes")
    placed = written(own.join(classes.select("vec", "head"), "vec").select("id", "head"), "ann-placed")
    by_id = Window.partitionBy("head").orderBy("id")
    members = placed.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1).select("head", "id")

    n = classes.count()
    depth = max(0, min(int(math.log2(CELLS[1])), max(int(math.log2(CELLS[0])) if n > CELLS[0] * 128 else 0, math.ceil(math.log2(max(n / CELL_ROWS, 1))))))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = projection.rows(_matrix(b.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), points.shape[1]).cast(pa.list_(pa.float64()))], ["point"])

    sample = classes.select("vec").orderBy(F.xxhash64("vec")).limit(min(SAMPLE, 64 << depth)).mapInArrow(project, "point array<double>").toArrow()  # bounded by SAMPLE points of few dimensions
    cells = Cells(_matrix(sample.column(0), projection.normal.shape[1]), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cells.of(projection.rows(x)).astype(np.int32)), pa.array(cells.of(projection.queries(x)).astype(np.int32))], ["head", "vec", "asks", "cell", "home"])

    index = written(classes.select("head", "vec", "asks").mapInArrow(place, "head long, vec array<double>, asks boolean, cell int, home int"), "ann-index")
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL_ROWS)).cast("int").alias("blocks")).collect()  # one row per cell
    blocks = np.zeros(1 << depth, np.int64)  # a cell with more rows than others is searched in blocks; an empty one not at all
    for r in sizes:
        blocks[r["cell"]] = r["blocks"]
    parts = own.sparkSession.createDataFrame([(r["cell"], r["blocks"]) for r in sizes], "cell int, blocks int")
    rows = index.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("head"), "blocks").cast("int").alias("block"), "head", "vec")  # one row per cell

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        q, floor = _matrix(left.column("vec"), d), left.column("floor").to_numpy()
        names, ids, scores, seen = left.column("q").to_numpy(), [], [], []
        if len(q) and right.num_rows:
            tree = Tree(projection, _matrix(right.column("vec"), d), right.column("head").to_numpy())
            for one, least in zip(q, floor.tolist(), strict=True):
                found, products, n = tree.nearest(one, k + 1, factor, least)
                ids.append(found)
                scores.append(products)
                seen.append(n)
        owner = np.repeat(names[: len(ids)], [len(x) for x in ids])
        none = np.full(len(seen), None)
        return pa.table({
            "q": pa.array(np.concatenate((owner, names[: len(seen)])), pa.int64()), "id": pa.array([*(x for y in ids for x in y.tolist()), *none], pa.int64()),
            "score": pa.array([*(x for y in scores for x in y.tolist()), *none], pa.float64()), "verified": pa.array([*[0] * len(owner), *seen], pa.int64()),
        })

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where a query has to look: its home first; then all other cells within its bound."""
        for b in batches:
            q, floor = _matrix(b.column(1), d), b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            first = b.column(4).to_numpy(zero_copy_only=False)
            points, norms2 = projection.queries(q), np.einsum("ij,ij->i", q, q)
            row, cell, block = [], [], []
            for i, home in enumerate(b.column(2).to_pylist()):
                if first[i]:
                    near = [home]
                else:
                    near = [c for c in np.flatnonzero(cells.gaps(points[i]) <= projection.squared(norms2[i], floor[i]) * factor).tolist() if c != home]
                for c in near:
                    row += [i] * int(blocks[c])
                    cell += [c] * int(blocks[c])
                    block += range(int(blocks[c]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(block, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(floor).take(at)], ["cell", "block", "q", "vec", "floor"])

    def passed(queries: DataFrame) -> DataFrame:
        asked = queries.mapInArrow(ask, "cell int, block int, q long, vec array<double>, floor double")
        return asked.groupBy("cell", "block").cogroup(rows.groupBy("cell", "block")).applyInArrow(look, "q long, id long, score double, verified long")

    queries = index.filter("asks").select(F.col("head").alias("q"), "vec", "home")
    one = written(passed(queries.select("q", "vec", "home", F.lit(float("-inf")).alias("floor"), F.lit(True).alias("first"))), "ann-first")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    # the score that a row must reach to be of use: that of the (k + 1)-th so far; at most k + 1 rows a query and block
    known = one.filter("id IS NOT NULL").withColumn("r", F.row_number().over(order)).filter(F.col("r") == k + 1).select("q", F.col("score").alias("floor"))
    two = written(passed(queries.join(known, "q", "left").select("q", "vec", "home", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.lit(False).alias("first"))), "ann-second")
    both = one.unionByName(two)
    seen = both.groupBy("q").agg(F.sum("verified").alias("verified"))
    best = written(both.filter("id IS NOT NULL").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("q", F.col("id").alias("head"), "score"), "ann-best")

    spread = best.join(members, "head").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = spread.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("near"))  # k + 1 each
    asking = placed.filter(F.col("id") % every == 0).select(F.col("head").alias("q"), F.col("id").alias("query_id"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asking.join(lists.join(seen, "q"), "q").select("query_id", F.posexplode(others).alias("rank", "x"), "verified")
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"), "verified")
