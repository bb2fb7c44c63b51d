"""Exact top-k by integer inner product: a Voronoi kNN join.

Components are floor(64 x); the score is their integer inner product. With M the largest norm, a vector x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0): their squared distance is M^2 + |q|^2 - 2 q.x, so the nearest are those of the largest
score, and the bounds of a metric space hold.

Method. ``PIVOTS`` vectors at most, the square root of all at small sizes, are drawn by a hash; every vector and every query goes to the cell of its nearest
pivot. Summaries: of each cell the number, the least and largest distance from its pivot and the k + 1 smallest; of each query cell the
largest distance U. For a query q of cell i, |q p_i| + (the (k+1)-th smallest of |p_i p_j| + |p_j s| over all cells) bounds the distance of its
(k+1)-th nearest; theta_i is the bound for |q p_i| = U. A vector s of cell j can be in an answer of cell i only if |s p_j| lies in [|p_i p_j| - U - theta_i,
|p_i p_j| + U + theta_i] and |p_i p_j| / 2 - U <= theta_i. Only such vectors are replicated. k + 1, as a query's own row is found and dropped.

Execution. Neighbouring query cells are packed into groups of about ``QUERIES`` queries, neighbouring cells into shards of about ``SHARD`` vectors; a cell that is
larger is cut in slices by a hash. A unit is (group, slice, shard, slice): the queries of the one, the replicated vectors of the other, solved locally as a
matrix product; what lies beyond a query's own bound isn't returned. Tasks merge to the k + 1 best of each query by Spark's partial group limit.
What reaches the driver is bounded: pivots, their summaries and the table of (group, cell) intervals, at most ``PIVOTS`` squared.
Equal vectors are one class with their k + 1 smallest ids (no more can be in an answer), and queries of equal vectors are solved once, so a vector that
a third of all rows share is one row.

In many dimensions distances are alike and the bounds exclude little; the join then is the whole query set against all rows, in blocks. Products
are exact: in float64 while the largest squared norm is below 2^53, else in 64-bit integers; norms of 2^62 or more raise ArithmeticError.

Defined results: vectors that are null or hold null or non-finite components take no part, as candidates or queries; nor do those whose length is not the most
frequent one (ties: the smaller), as no product is defined, nor rows with a null id; zero vectors do take part; rows that repeat as a whole count once; rows of
one id with different vectors are different rows, each with its own ranks as a query; fewer candidates than k give them all; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.tables import Tables

NEIGHBOURS, SCALE = 20, 64
PIVOTS, QUERIES, SHARD, CHUNK = 512, 2048, 8192, 256


def _matrix(column, kind=np.float64) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(arr), -1) if len(arr) else np.zeros((0, 0), kind)


class Space:
    """Pivots in the space with one more dimension, in which all candidates have norm M."""

    def __init__(self, square: int, pivots: np.ndarray):
        self.square, self.pivots = float(square), pivots
        self.extra = self._rest(pivots)
        self.slack = 1e-6 * math.sqrt(self.square) + 1e-9

    def _rest(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))

    def away(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distances (rows of x, pivots)."""
        own = (x * x).sum(1) if query else np.full(len(x), self.square)
        dot = x @ self.pivots.T + (0 if query else self._rest(x)[:, None] * self.extra)
        return np.sqrt(np.maximum(own[:, None] + self.square - 2 * dot, 0))


def pack(points: np.ndarray, counts: np.ndarray, limit: int) -> list[np.ndarray]:
    """Cells with rows, as groups of neighbours: halves by rows along the widest direction until a group has ``limit`` rows or one cell."""
    out, todo = [], [np.flatnonzero(counts > 0)]
    while todo:
        cells = todo.pop()
        if len(cells) < 2 or counts[cells].sum() <= limit:
            out += [cells] if len(cells) else []
            continue
        p = points[cells]
        order = cells[np.argsort(p[:, int(np.argmax(p.max(0) - p.min(0)))], kind="stable")]
        run = np.cumsum(counts[order])
        half = min(max(int(np.searchsorted(run, run[-1] / 2)), 1), len(order) - 1)
        todo += [order[:half], order[half:]]
    return out


def bounds(between: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Of each pivot i the k-th smallest of |p_i p_j| + |p_j s| over the summaries (inf if there are fewer)."""
    return np.array([np.partition((row[:, None] + near).ravel(), k - 1)[k - 1] for row in between])


def solve(query, vectors, ids: pa.Array, classes, least, k: int, whole: bool):
    """Of each query its k best rows (score, id, class): all of at least ``least``, ties to the smaller id, then the smaller class."""
    offsets, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
    offsets = offsets - offsets[0]
    for at in range(0, len(query), CHUNK):
        part = query[at: at + CHUNK]
        score = part @ vectors.T if not whole else np.einsum("qd,vd->qv", part, vectors)
        cut = np.partition(score, score.shape[1] - k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(part), score.min())
        for q, row in enumerate(score):
            hit = np.flatnonzero(row >= max(cut[q], least[at + q]))
            many = offsets[hit + 1] - offsets[hit]
            who = np.repeat(hit, many)
            rows = flat[np.arange(len(who)) - np.repeat(np.cumsum(many) - many - offsets[hit], many)]
            points = row[who].astype(np.int64)
            best = np.lexsort((classes[who], rows, -points))[:k]
            yield at + q, points[best], rows[best], classes[who[best]]


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query: Column | None = None, k: int = NEIGHBOURS, scale: int = SCALE,
          pivots: int = PIVOTS, queries: int = QUERIES, shard: int = SHARD, seed: int = 12) -> DataFrame:
    """query_id, rank (from 1), id, score of the k best rows of every query row (default: ids divisible by 20)."""
    spark, tables, k1 = vectors.sparkSession, Tables(vectors.sparkSession, "voronoi"), k + 1
    v = F.col(vector_col)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("raw"), fine.alias("fine")).where(F.col("id").isNotNull() & F.col("fine"))
    lengths = rows.groupBy(F.size("raw").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    rows = rows.where(F.size("raw") == lengths["n"]).select("id", F.transform("raw", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    rows = tables.write(rows.distinct(), "rows")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = rows.agg(F.max(square)).first()[0]
    if largest >= 2.0 ** 62:
        raise ArithmeticError("scores of these vectors don't fit a long")
    same = Window.partitionBy("v").orderBy("id")
    classes = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = tables.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    asked = tables.write(rows.where(query if query is not None else F.col("id") % 20 == 0).join(classes.select("v", "c"), "v").select(F.col("id").alias("query_id"), "c"), "asked")
    count = classes.count()
    drawn = classes.orderBy(F.xxhash64("v", F.lit(seed)), "c").limit(min(pivots, max(1, math.isqrt(count)))).select("v").toArrow()
    whole = largest >= 2.0 ** 53
    space = Space(int(largest), _matrix(drawn.column("v")))
    shared = spark.sparkContext.broadcast(space)

    def place(is_query: bool):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    away = shared.value.away(_matrix(part.column("v")), is_query)
                    cell = away.argmin(1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], names=[*part.schema.names, "cell", "away"])
        return run
    placed = tables.write(classes.select("c", "ids", "v").mapInArrow(place(False), "c long, ids array<long>, v array<long>, cell int, away double"), "candidates")
    wanted = classes.join(asked.select("c").distinct(), "c", "left_semi").select("c", "v")
    wanted = tables.write(wanted.mapInArrow(place(True), "c long, v array<long>, cell int, away double"), "queries")

    routes, groups, shards, reach = _plan(placed, wanted, space, k1, queries, shard)
    routes, groups, shards = (spark.createDataFrame(x) for x in (routes, groups, shards))
    slot = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    units = routes.select("group", "shard").distinct().join(shards.select("shard", "shard_slices").distinct(), "shard")
    sent = placed.join(shards, "cell").withColumn("s", slot("shard_slices")).join(routes.drop("shard"), "cell").where("away BETWEEN low AND high") \
        .join(groups.select("group", "group_slices").distinct(), "group").select("group", every("group_slices").alias("g"), "shard", "s", "c", "ids", "v")
    asking = wanted.join(groups, "cell").withColumn("g", slot("group_slices")).join(units, "group") \
        .select("group", "g", "shard", every("shard_slices").alias("s"), "c", "v", F.element_at(F.lit(reach.tolist()).cast("array<double>"), F.col("cell") + 1).alias("reach"), "away")

    def local(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            kind = np.int64 if whole else np.float64
            q, names = _matrix(left.column("v"), kind), left.column("c").to_numpy()
            far = left.column("reach").to_numpy() + left.column("away").to_numpy() + space_slack
            least = ((q.astype(np.float64) ** 2).sum(1) + largest - far * far) / 2 - 1 - 1e-9 * largest
            ids = right.column("ids").combine_chunks()
            for i, score, who, c in solve(q, _matrix(right.column("v"), kind), ids, right.column("c").to_numpy(), least, k1, whole):
                for col, x in zip(out, (np.full(len(who), names[i]), who, c, score)):
                    col.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in out], names=["c", "id", "class", "score"])
    space_slack, unit = space.slack, ["group", "g", "shard", "s"]
    found = asking.groupBy(*unit).cogroup(sent.groupBy(*unit)).applyInArrow(local, "c long, id long, class long, score long")
    best = Window.partitionBy("c").orderBy(F.desc("score"), "id", "class")
    found = tables.write(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k1).drop("n"), "best")
    own = Window.partitionBy("query_id", "c").orderBy(F.desc("score"), "id", "class")
    return asked.join(found, "c").where((F.col("id") != F.col("query_id")) | (F.col("class") != F.col("c"))) \
        .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _plan(placed: DataFrame, wanted: DataFrame, space: Space, k1: int, queries: int, shard: int):
    """Arrow tables (group, cell, shard, low, high), (cell, group, group_slices) and (cell, shard, shard_slices), and of each cell the bound of a query at its pivot."""
    n = len(space.pivots)
    many, low, high, near = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n), np.full((n, k1), np.inf)
    for r in placed.groupBy("cell").agg(F.count("*"), F.min("away"), F.max("away")).collect():
        many[r[0]], low[r[0]], high[r[0]] = r[1:]
    first = Window.partitionBy("cell").orderBy("away")
    for cell, i, away in placed.select("cell", F.row_number().over(first).alias("i"), "away").where(F.col("i") <= k1).collect():  # PIVOTS * (k + 1)
        near[cell, i - 1] = away
    asked, widest = np.zeros(n, np.int64), np.zeros(n)
    for r in wanted.groupBy("cell").agg(F.count("*"), F.max("away")).collect():
        asked[r[0]], widest[r[0]] = r[1:]
    between = space.away(space.pivots, False)
    reach = bounds(between, near, k1)
    theta = widest + reach + space.slack
    groups, shards = pack(space.pivots, asked, queries), pack(space.pivots, many, shard)
    shard_of = np.zeros(n, np.int32)
    for i, cells in enumerate(shards):
        shard_of[cells] = i
    out = []
    for g, cells in enumerate(groups):
        d, u, t = between[cells], widest[cells][:, None], theta[cells][:, None]
        a, b = d - u - t - space.slack, d + u + t + space.slack
        need = (many > 0) & (d / 2 - u - space.slack <= t) & (a <= high) & (b >= low)
        for j in np.flatnonzero(need.any(0)):
            out.append((g, int(j), int(shard_of[j]), float(a[need[:, j], j].min()), float(b[need[:, j], j].max())))
    routes = pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["group", "cell", "shard", "low", "high"])

    def cut(packed, counts, limit, name):
        rows = [(int(c), i, max(1, -(-int(counts[cells].sum()) // limit))) for i, cells in enumerate(packed) for c in cells]
        return pa.table([pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], names=["cell", name, f"{name}_slices"])
    return routes, cut(groups, asked, queries, "group"), cut(shards, many, shard, "shard"), reach


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
n AS (SELECT len(v) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
e AS (SELECT row_number() OVER () AS i, vec_id, v::DOUBLE[] AS v FROM v WHERE len(v) = (SELECT n FROM n)),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.i <> c.i WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
