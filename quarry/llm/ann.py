"""Approximate nearest neighbours by largest cosine: vectors of unit length are projected to a few dimensions by a 2-stable
(Gaussian) matrix and kept in kd-trees; projected neighbours come in order of their distance and are verified on the original
vectors, until a chi-square test says that a nearer one has hardly been missed.

For true distance d, the squared projected distance over d^2 is chi-square with as many degrees as projected dimensions. So once
all points within projected distance r are verified and the k-th best is at d_k, a nearer point is missing with a chance of at
most 1 - CDF(r^2 / d_k^2), and the search stops where CDF reaches the wanted confidence.

The upper levels of the kd-tree split the space into cells, one task each; a query goes to its own cell first and then to the
cells that the same test can't rule out by their distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import sampled, stored


#: More than a cosine of unit vectors in single precision can be off, for the few that are then scored in full.
SINGLE = 1e-4


@dataclass(frozen=True)
class AnnParams:
    """k: neighbours. dims: of the projection, even. confidence: of the stopping test. cell_rows: vectors of a cell. sample_rows:
    vectors, in hash order, that the cells' borders are fitted on (every vector is indexed). leaf: points of a kd-tree leaf."""

    k: int = 5
    dims: int = 16
    confidence: float = 0.97
    cell_rows: int = 8192
    sample_rows: int = 20_000
    leaf: int = 64
    seed: int = 5


def usable(vector: Column) -> Column:
    """Neither null, zero, empty nor with null or non-finite components."""
    least, most = F.array_min(vector), F.array_max(vector)  # these pass over nulls; NaN is above infinity
    finite = (least > float("-inf")) & (most < float("inf")) & ~F.exists(vector, lambda x: x.isNull())
    return F.coalesce(finite & ((least != 0) | (most != 0)), F.lit(False))


def chi_square_bound(dims: int, confidence: float) -> float:
    """Where the chi-square distribution of an even number of degrees reaches the confidence."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        half = (middle := (low + high) / 2) / 2
        below = 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))
        low, high = (middle, high) if below < confidence else (low, middle)
    return high


class Projection:
    def __init__(self, size: int, params: AnnParams) -> None:
        self.matrix = np.random.default_rng(params.seed).standard_normal((size, params.dims))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ self.matrix


class KDTree:
    """Median splits of the widest dimension; the leaves are runs of `order` with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool = True) -> None:
        """tight: boxes are of the leaf's own points; else they are the leaf's share of the whole space, as new points need."""
        self.splits: dict[int, tuple[int, float]] = {}
        self.leaf_of: dict[int, int] = {}
        runs, low, high = [], [], []
        everywhere = np.full(points.shape[1], np.inf)
        todo = [(0, np.arange(len(points)), -everywhere, everywhere)]
        while todo:
            node, own, lo, hi = todo.pop()
            wide = int(np.ptp(points[own], axis=0).argmax()) if len(own) else 0
            if len(own) <= leaf:
                self.leaf_of[node] = len(runs)
                runs.append(own)
                low.append(points[own].min(axis=0) if tight and len(own) else lo)
                high.append(points[own].max(axis=0) if tight and len(own) else hi)
                continue
            half = len(own) // 2
            own = own[np.argpartition(points[own, wide], half)]
            at = float(points[own[half], wide])
            self.splits[node] = (wide, at)
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[wide] = right_lo[wide] = at
            todo += [(2 * node + 1, own[:half], lo, left_hi), (2 * node + 2, own[half:], right_lo, hi)]
        self.order, self.low, self.high = np.concatenate(runs), np.array(low), np.array(high)
        self.starts = np.cumsum([0, *map(len, runs)])

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, by the splits."""
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node in self.leaf_of:
                out[own] = self.leaf_of[node]
            elif len(own):
                wide, at = self.splits[node]
                right = points[own, wide] >= at
                todo += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each leaf's box; some points at a time, by dimension."""
        out = np.zeros((len(points), len(self.low)))
        some = max(1, (1 << 15) // len(self.low))
        for lo in range(0, len(points), some):
            part, to = points[lo : lo + some], out[lo : lo + some]
            for at, low, high in zip(part.T[:, :, None], self.low.T, self.high.T, strict=True):
                off = np.maximum(low - at, at - high)
                np.maximum(off, 0, out=off)
                off *= off
                to += off
        return out


class Cell:
    """The vectors of a cell behind a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection, params: AnnParams) -> None:
        points = projection(vectors)
        self.tree = KDTree(points, params.leaf)
        self.ids, self.vectors, points = ids[self.tree.order], vectors[self.tree.order], points[self.tree.order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.units = (self.vectors / self.norms[:, None]).astype(np.float32)
        self.tests = np.column_stack([points, (points * points).sum(axis=1), np.ones(len(points))])
        self.k, self.bound = params.k + 1, chi_square_bound(params.dims, params.confidence)

    def search(self, queries: np.ndarray, projected: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of queries, id and score of the k + 1 nearest found of each, best first (one may be the query itself), without
        those farther than what is known to be enough, and how many vectors were verified for each query. farthest: squared
        distances known to be enough. Leaves come in order of projected distance, one, two, four ... at a time; the test is
        made before each portion and on each point of it.

        The queries that ask for a leaf meet its points in two matrix products: one of the projections, whose sign is the test
        of a point, and one of unit vectors in single precision. What that leaves is scored in double precision, vector by
        vector, so equal vectors score alike."""
        farthest, verified = np.maximum(farthest, 1e-9), np.zeros(len(queries), np.int64)
        norms = np.sqrt((queries * queries).sum(axis=1))
        units, squares = (queries / norms[:, None]).astype(np.float32), (projected * projected).sum(axis=1)
        apart = self.tree.distances(projected)
        order = np.argsort(apart, axis=1, kind="stable")
        apart = np.take_along_axis(apart, order, axis=1)
        row, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < order.shape[1]:
            asked, nth = np.nonzero(apart[:, at : at + step] <= self.bound * farthest[:, None])
            if not len(asked):
                break
            leaf = order[asked, at + nth]
            by_leaf = np.argsort(leaf, kind="stable")
            asked, leaf = asked[by_leaf], leaf[by_leaf]
            tests = np.column_stack([-2 * projected, np.ones(len(queries)), squares - self.bound * farthest])
            enough = (1 - farthest / 2 - SINGLE)[:, None].astype(np.float32)
            more, edges = [(row, ids, scores)], np.flatnonzero(np.diff(leaf)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(leaf)], strict=True):
                start, end = self.tree.starts[leaf[lo]], self.tree.starts[leaf[lo] + 1]
                for one in range(lo, hi, 1024):
                    who = asked[one : min(one + 1024, hi)]
                    near = tests[who] @ self.tests[start:end].T <= 0
                    verified[who] += np.count_nonzero(near, axis=1)
                    near &= units[who] @ self.units[start:end].T >= enough[who]
                    nth, point = np.divmod(np.flatnonzero(near), end - start)
                    who, point = who[nth], start + point
                    more.append((who, self.ids[point], (self.vectors[point] * queries[who]).sum(axis=1) / (self.norms[point] * norms[who])))
            row, ids, scores = (np.concatenate(x) for x in zip(*more, strict=True))
            best = np.lexsort((ids, -scores, row))
            row, ids, scores = row[best], ids[best], scores[best]
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            nth = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
            last = np.flatnonzero(nth == self.k - 1)
            farthest[row[last]] = np.maximum(np.minimum(farthest[row[last]], 2 - 2 * scores[last]), 1e-9)
            row, ids, scores = row[nth < self.k], ids[nth < self.k], scores[nth < self.k]
            at, step = at + step, step * 2
        return row, ids, scores, verified


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search_cells(rows: DataFrame, size: int, params: AnnParams) -> DataFrame:
    """rows: cell, asked (0: to be searched, 1: a query), id, vector, farthest. Gives query, id, score, and verified: the vectors
    verified for the query in this cell, on one of its rows (one with a score of -inf if all were too far). Sorted by cell, a task holds one cell's vectors at a time, and the
    queries of the cell stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, now, held, cell = Projection(size, params), None, [], None
        for batch in batches:
            cells, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, vectors, farthest = batch.column(2).to_numpy(), _matrix(batch.column(3)), batch.column(4).to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asked) != 0)) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for start, end in zip([0, *edges], [*edges, len(cells)], strict=True):
                if cells[start] != now:
                    now, held, cell = cells[start], [], None
                if not asked[start]:
                    held.append((ids[start:end], vectors[start:end]))
                    continue
                if cell is None and held:
                    cell = Cell(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), projection, params)
                for lo in range(start, end, 2048) if cell else ():
                    part = slice(lo, min(lo + 2048, end))
                    row, found, scores, verified = cell.search(vectors[part], projection(vectors[part]), farthest[part])
                    out.append((ids[part][row], found, scores, np.where(np.diff(row, prepend=-1) != 0, verified[row], 0)))
                    bare = np.setdiff1d(np.flatnonzero(verified), row)
                    out.append((ids[part][bare], ids[part][bare], np.full(len(bare), -np.inf), verified[bare]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query", "id", "score", "verified"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "asked").select("cell", "asked", "id", "vector", "farthest")
    return dealt.mapInArrow(run, "query long, id long, score double, verified long")


def _routed(queries: DataFrame, top: KDTree, size: int, params: AnnParams, home: bool) -> DataFrame:
    """queries: id, vector, farthest. Each with its own cell, or with the others that the stopping test leaves."""
    bound = chi_square_bound(params.dims, params.confidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = Projection(size, params)
        for batch in batches:
            points, farthest = projection(_matrix(batch.column(1))), batch.column(2).to_numpy()
            own = top.place(points)
            some = len(points) if home else 256  # of which each may go to every cell
            for lo in range(0, len(points), max(some, 1)):
                if home:
                    taken, cells = batch, own
                else:
                    near = top.distances(points[lo : lo + some]) <= bound * np.maximum(farthest[lo : lo + some], 1e-9)[:, None]
                    near[np.arange(len(near)), own[lo : lo + some]] = False
                    rows, cells = np.nonzero(near)
                    taken = batch.take(pa.array(lo + rows))
                yield pa.RecordBatch.from_arrays([pa.array(cells), *taken.columns], names=["cell", "id", "vector", "farthest"])

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.mapInArrow(run, f"cell long, id long, vector {kind}, farthest double")


def _one_size(base: DataFrame, queries: DataFrame, size: int, params: AnnParams) -> DataFrame:
    """base: id, vector, at most k + 1 of each vector; queries: id, vector. Gives query, id, score, verified: k + 1 of each query."""
    total = base.count()
    sample = sampled(base, F.col("id"), params.sample_rows, total).orderBy(F.xxhash64("id"), "id").limit(params.sample_rows).select("vector").toArrow()
    points = Projection(size, params)(_matrix(sample.column("vector").combine_chunks()))
    cells = max(1, 1 << math.ceil(math.log2(total / params.cell_rows))) if total > params.cell_rows else 1
    top = KDTree(points, max(1, math.ceil(len(points) / cells)), tight=False)
    none = F.lit(4.0).alias("farthest")  # unit vectors are no farther apart, squared
    placed = stored(_routed(base.select("id", "vector", none), top, size, params, home=True).withColumn("asked", F.lit(0)))
    asked = stored(queries.select("id", "vector", none))
    first = stored(_search_cells(placed.unionByName(_routed(asked, top, size, params, home=True).withColumn("asked", F.lit(1))), size, params))
    seen = first.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = F.when(F.col("n") > params.k, 2 - 2 * F.col("least")).otherwise(4.0)
    second = asked.drop("farthest").join(seen.withColumnRenamed("query", "id"), "id", "left")
    second = _routed(second.select("id", "vector", F.coalesce(known, F.lit(4.0)).alias("farthest")), top, size, params, home=False)
    both = first.unionByName(_search_cells(placed.unionByName(second.withColumn("asked", F.lit(1))), size, params))
    own = Window.partitionBy("query")
    ranked = both.withColumns({"n": F.row_number().over(own.orderBy(F.desc("score"), "id")), "verified": F.sum("verified").over(own)})
    return ranked.where((F.col("n") <= params.k + 1) & (F.col("score") > float("-inf"))).drop("n")


def nearest(vectors: DataFrame, every: int = 50, params: AnnParams = AnnParams()) -> DataFrame:
    """vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by every, candidates all but the query's own.
    Gives query_id, rank, vec_id, score: the k nearest found, nearest first, ties to the smaller vec_id; then verified: how many
    vectors passed the tests to be compared with the query in full.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part, and vectors of other
    lengths aren't compared. Each distinct vector is asked once, and only its k + 1 smallest ids are indexed: equal vectors
    tie, so no other can be in a result. Vectors are told to be equal by 128 bits of hashes. Rows of one id and vector count once;
    an empty table gives no rows."""
    known = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).where(F.col("vec_id").isNotNull())
    hashes = {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(params.seed), "vector")}  # 128 bits, in which 0.0 is -0.0
    rows, queries = (some.where(usable(F.col("vector"))).withColumns(hashes) for some in (known, known.where(F.col("id") % every == 0)))
    least = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("n", F.dense_rank().over(least)).where(F.col("n") <= params.k + 1).withColumn("before", F.lag("id").over(least))
    base = stored(few.where(F.col("before").isNull() | (F.col("before") != F.col("id"))).select("id", "vector"))
    queries = stored(queries)
    asked = stored(queries.withColumn("n", F.row_number().over(least)).where(F.col("n") == 1).drop("n"))
    found = None
    for size in sorted(r[0] for r in asked.select(F.size("vector")).distinct().collect()):  # as many as lengths of vectors
        fits = F.size("vector") == size
        one = _one_size(base.where(fits), asked.where(fits), size, params)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    same = asked.select("h1", "h2", F.col("id").alias("query"))
    of = queries.select("id", "h1", "h2").distinct().join(same, ["h1", "h2"]).select(F.col("id").alias("query_id"), "query")
    others = of.join(found, "query").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= params.k).select("query_id", "rank", F.col("id").alias("vec_id"), "score", "verified")
