"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Nearness is the inner product. With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes
(q M / |q|, 0): all have length M, so the nearest by distance is the one with the largest inner product.

Method. Vectors are projected to ``DIMENSIONS`` (16) random Gaussian directions. For a neighbour at distance d the squared projected
distance is d^2 times a chi-square variable with 16 degrees of freedom. A query verifies projected neighbours by increasing projected distance D on the
original vectors, and stops as soon as a neighbour nearer than the k-th best found, at distance d_k, would have come by now with probability
``CONFIDENCE`` (0.93): chi-square distribution function of D^2 / d_k^2. So each of the true neighbours is found with that probability at
least, the nearer ones with more (measured recall on the tables: README). As d_k falls with the number of vectors, so does the share verified.

Execution. A kd-tree over a bounded sample of the projections (``SAMPLE`` vectors at most) cuts the space into cells; all vectors are indexed,
each in its cell, a cell of more than ``CELL`` vectors in slices by a hash. Round 1 sends every query to its own cell, round 2 to the cells whose box the
test does not exclude, given d_k of round 1. Queries of a cell beyond ``QUERY_SLICE`` are dealt over slices, and only vectors of such cells are
copied, once a slice. A unit (cell slice, query slice) orders its vectors by projected distance and verifies them in growing blocks until the test
holds. Equal vectors are collapsed first to their k + 1 smallest ids (no more can be in an answer), so a vector that a third of all rows
share is a few rows. Scores are summed in double precision in one fixed order, so equal vectors tie exactly.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as candidates or queries; nor
do those whose length is not the most frequent one (ties: the smaller), as no inner product is defined; rows with the query's own id are not candidates;
a null id takes no part; fewer candidates than k give them all; repeated rows (id and vector) count once; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.tables import Tables

DIMENSIONS, CONFIDENCE, NEIGHBOURS = 16, 0.93, 20
SAMPLE, CELL, MAX_CELLS, QUERY_SLICE = 1 << 16, 1 << 13, 1 << 12, 1 << 11
FIRST, CHUNK = 128, 128


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the distribution function for an even number of degrees of freedom."""
    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def valid(vector: str) -> Column:
    """Not null, not zero, all components finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1) if len(arr) else np.zeros((0, 0))


class Projection:
    def __init__(self, length: int, norm: float, seed: int):
        self.matrix = np.random.Generator(np.random.PCG64(seed)).standard_normal((length + 1, DIMENSIONS))
        self.norm = norm

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(1), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q * (self.norm / np.sqrt((q * q).sum(1)))[:, None] @ self.matrix[:-1]

    def squared_distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Between a query and a vector, from their inner product."""
        return np.maximum(2 * self.norm ** 2 - 2 * self.norm * score / np.sqrt((q * q).sum(1)), 0)


def kd_tree(points: np.ndarray, size: int) -> list[tuple]:
    """Nodes (axis, threshold, left, right), a leaf as (-1, 0, cell, 0); for cells of about ``size`` of these points."""
    nodes: list = [None]
    todo, cells = [(0, np.arange(len(points)))], 0
    while todo:
        at, rows = todo.pop()
        p = points[rows]
        spread = p.max(0) - p.min(0) if len(rows) else np.zeros(DIMENSIONS)
        axis = int(np.argmax(spread))
        cut = float(np.median(p[:, axis])) if len(rows) else 0.0
        left = p[:, axis] <= cut if len(rows) else np.zeros(0, bool)
        if len(rows) <= size or not spread[axis] or left.all():
            nodes[at] = (-1, 0.0, cells, 0)
            cells += 1
            continue
        nodes[at] = (axis, cut, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(len(nodes) - 2, rows[left]), (len(nodes) - 1, rows[~left])]
    return nodes


def cell_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        axis, cut, left, right = nodes[at]
        if axis < 0:
            out[rows] = left
        else:
            low = points[rows, axis] <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point (rows) from every box (columns)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0) ** 2
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, ties to the smaller id."""
    if len(scores) > k:
        enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(enough)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_cell(projection: Projection, ids, vectors, qid, queries, reach, k: int, limit: float):
    """(query id, ids, scores, number verified): each query's k best of the cell, as far as the test lets it look. ``reach``: squared distance of the k-th best known before (inf: none)."""
    points, asked = projection.points(vectors), projection.queries(queries)
    slack, own = 1e-9 * projection.norm ** 2, (points * points).sum(1)
    for at in range(0, len(qid), CHUNK):
        part = asked[at: at + CHUNK]
        away = np.maximum((part * part).sum(1)[:, None] + own - 2 * part @ points.T, 0)
        for i, far in enumerate(away):
            q, x, bound = at + i, queries[at + i], reach[at + i]
            near = np.flatnonzero(far <= limit * bound + slack)
            if len(near) > FIRST:  # the nearest ones give a bound before the others are ordered
                first = near[np.argpartition(far[near], FIRST)[:FIRST]]
                best = np.sort((vectors[first] * x).sum(1)[ids[first] != qid[q]])[-k:]
                if len(best) == k:
                    bound = min(bound, float(projection.squared_distance(queries[q: q + 1], best[:1])[0]))
                    near = near[far[near] <= limit * bound + slack]
            near = near[np.argsort(far[near], kind="stable")]
            scores, names, step, size, seen = np.zeros(0), np.zeros(0, np.int64), 0, 2 * FIRST, 0
            while step < len(near) and far[near[step]] <= limit * bound + slack:
                rows = near[step: step + size]
                rows = rows[: int(np.searchsorted(far[rows], limit * bound + slack, "right"))]
                step, size, seen = step + len(rows), 2 * size, seen + len(rows)
                rows = rows[ids[rows] != qid[q]]
                scores, names = np.concatenate((scores, (vectors[rows] * x).sum(1))), np.concatenate((names, ids[rows]))
                keep = _best(scores, names, k)
                scores, names = scores[keep], names[keep]
                if len(scores) == k:
                    bound = min(bound, float(projection.squared_distance(queries[q: q + 1], scores[-1:])[0]))
            yield qid[q], names, scores, seen


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query: Column | None = None, k: int = NEIGHBOURS, confidence: float = CONFIDENCE, seed: int = 11, cell_rows: int = CELL) -> DataFrame:
    """query_id, rank (from 1), id, score of the k nearest found of every query row (default: ids divisible by 20)."""
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession, "neighbours")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & valid("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], out).withColumnRenamed("vec_id", id_col)
    rows = tables.write(rows.where(F.size("v") == lengths["n"]).distinct(), "vectors")
    asked = rows.where(query if query is not None else F.col("id") % 20 == 0)
    same = Window.partitionBy("v").orderBy("id")
    told = tables.write(rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "candidates")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm, count = told.agg(F.sqrt(F.max(square)), F.count("*")).first()
    projection = Projection(lengths["n"], norm, seed)
    share = min(1.0, SAMPLE / count)
    picked = told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("v").limit(SAMPLE).toArrow()
    size = max(len(picked) / MAX_CELLS, cell_rows * len(picked) / count)
    shared = spark.sparkContext.broadcast((projection, kd_tree(projection.points(_matrix(picked.column("v"))), size) if len(picked) else [(-1, 0.0, 0, 0)]))
    limit = chi_square_quantile(confidence, DIMENSIONS)

    def place(batches):
        p, tree = shared.value
        for b in batches:
            x = _matrix(b.column("v"))
            if len(x):
                pts = p.points(x)
                yield pa.record_batch({"cell": pa.array(cell_of(tree, pts)), "id": b.column("id"), "v": b.column("v").cast(pa.list_(pa.float64())), "low": pa.array(list(pts)), "high": pa.array(list(pts))})
    placed = tables.write(told.mapInArrow(place, "cell int, id long, v array<double>, low array<double>, high array<double>"), "cells")
    box = [f(F.element_at(c, d + 1)).alias(f"{c}{d}") for c, f in (("low", F.min), ("high", F.max)) for d in range(DIMENSIONS)]
    boxes = sorted(placed.groupBy("cell").agg(F.count("*").alias("n"), *box).collect())  # MAX_CELLS and a few at most
    numbers = np.array([list(r)[2:] for r in boxes])
    known = spark.sparkContext.broadcast((np.array([r[0] for r in boxes], np.int32), numbers[:, :DIMENSIONS], numbers[:, DIMENSIONS:]))
    cuts = F.broadcast(spark.createDataFrame([(r[0], -(-r[1] // cell_rows)) for r in boxes], "cell int, slices int"))
    points = placed.join(cuts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "v")

    def route(first: bool):
        def run(batches):
            p, _ = shared.value
            cells, low, high = known.value
            for b in batches:
                for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                    x = _matrix(part.column("v"))
                    away = box_distance(p.queries(x), low, high)
                    home = away.argmin(1)
                    if first:
                        at = np.arange(len(x)), home
                    else:
                        reach = part.column("reach").to_numpy()
                        want = away <= limit * reach[:, None] + 1e-9 * p.norm ** 2
                        want[np.arange(len(x)), home] = False
                        at = np.nonzero(want)
                    q, c = at
                    yield pa.record_batch({"cell": pa.array(cells[c]), "id": part.column("id").take(pa.array(q)), "v": part.column("v").cast(pa.list_(pa.float64())).take(pa.array(q)),
                                           "reach": pa.array(np.full(len(q), np.inf) if first else reach[q])})
        return run

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, score, who = [], [], []
        if left.num_rows and right.num_rows:
            for q, names, scores, _ in search_cell(shared.value[0], left.column("id").to_numpy(), _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v")),
                                                   right.column("reach").to_numpy(), k, limit):
                who += [q] * len(names)
                ids += names.tolist()
                score += scores.tolist()
        return pa.table({"query_id": pa.array(who, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    def search(asking: DataFrame, first: bool) -> DataFrame:
        sent = tables.write(asking.mapInArrow(route(first), "cell int, id long, v array<double>, reach double"), f"routed{int(first)}")
        load = sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_SLICE).cast("int").alias("shares"))  # MAX_CELLS rows at most
        load = F.broadcast(spark.createDataFrame(load.collect(), "cell int, shares int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        copies = points.join(load, "cell").select("cell", "slice", every("shares").alias("share"), "id", "v")
        dealt = sent.join(load, "cell").join(cuts, "cell").select("cell", every("slices").alias("slice"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "id", "v", "reach")
        unit = ["cell", "slice", "share"]
        return copies.groupBy(*unit).cogroup(dealt.groupBy(*unit)).applyInArrow(look, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    queries = asked.select("id", "v").distinct()
    home = tables.write(search(queries, True), "home")
    far = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    reach = F.when(F.col("n") >= k, F.greatest(F.lit(2 * norm ** 2) - 2 * norm * F.col("least") / length, F.lit(0.0))).otherwise(F.lit(float("inf")))
    again = queries.join(far, F.col("id") == F.col("query_id"), "left").withColumn("reach", reach).select("id", "v", "reach")
    found = tables.write(search(again, False), "far")
    for name in ("cells", "routed0", "routed1", "candidates", "vectors"):
        tables.drop(name)
    found = home.unionAll(found).distinct()
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
