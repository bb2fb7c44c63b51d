"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets. A source's target is its weight's share of ``total`` times all words, at most ``most`` times
its own words; what is above is shared again by weight. That is one level L for all: target =
min(most * size, L * weight), found by ordering the sources by size / weight.

Blocks. A block is one taking of one document. In every source, documents are put in a random
order (by a hash of seed, id and text) once; each pass over the source takes them in it, and the last pass stops
where the target is reached, in the middle of a document if need be. So sources are taken to the word, and no
document is taken more than ceil(target / size) <= ``most`` times.

Splitting tree. Each source's number of blocks is its quota. The root holds all quotas and all output shards; a node
splits its shards in two halves and draws, from the multivariate hypergeometric distribution, how many of each
source's blocks go left. The leaves are exact quotas for each shard; a source's blocks, in random order, are dealt to its
shards in runs of these lengths, so the draws are disjoint. Within a shard blocks are shuffled by a hash.

Execution. Sizes are summed by (source, bucket of the hash) first; that table says in which bucket each source's
last pass ends and at which rank each bucket begins, so ranks and running sums are needed inside buckets
only, and a source with a third of all rows spreads over all of them. Only the list of sources (one row each, the caller's
weights) and their sums reach the driver. The tree depends on quotas and the seed alone: reruns agree.

Defined results: null or wordless text has size 0 and target share 0 of its own (taken 0, no block); a null source is
a source of its own, after the others; repeated rows are separate documents (those that tie in hash are equal rows, so
the result as a set of rows doesn't depend on their order); an empty table gives an empty result; a source whose words are
all in one document is taken to the word as well; other columns are ignored.
"""
from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.tables import Tables, free_name, partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2.0


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, most: float = MOST) -> list[float]:
    """Of each source min(most * size, level * weight), so that they add up to total * sum(sizes)."""
    goal, out = total * sum(sizes), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    filled, weight = 0.0, float(sum(weights))
    for k, i in enumerate(order):
        level = (goal - filled) / weight
        if level * weights[i] <= most * sizes[i]:
            for j in order[k:]:
                out[j] = level * weights[j]
            return out
        out[i] = most * sizes[i]
        filled += out[i]
        weight -= weights[i]
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): the blocks of each source in each output shard; shards differ by one block at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid, total = (a + b) // 2, int(have.sum())
        draw = np.random.Generator(np.random.PCG64([seed, a, b]))
        left, need, rest = np.zeros_like(have), total * (mid - a) // (b - a), total
        for i, n in enumerate(have.tolist()):  # one hypergeometric draw for each source, given what is still needed
            rest -= n
            left[i] = _hypergeometric(draw, n, rest, need)
            need -= int(left[i])
        todo += [(a, mid, left), (mid, b, have - left)]
    return out


def _hypergeometric(draw, good: int, bad: int, n: int) -> int:
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return n
    if good + bad < 10 ** 9:
        return int(draw.hypergeometric(good, bad, n))
    return _large_hypergeometric(draw, good, bad, n)


def _log_factorial(n: int) -> Decimal:
    """To 40 digits: Stirling's series, exact products below 64."""
    if n < 64:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = sum((Decimal(a) / Decimal(b) / x ** (2 * k + 1) for k, (a, b) in enumerate(STIRLING)), Decimal(0))
    return x * x.ln() - x + (x * TWO_PI).ln() / 2 + series


#: 2 pi to 50 digits, and the coefficients B(2k) / (2k (2k - 1)) of Stirling's series (fixed values).
TWO_PI = Decimal("6.2831853071795864769252867665590057683943387987502")
STIRLING = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400), (43867, 244188), (-174611, 125400), (77683, 5796), (-236364091, 1506960))


def _large_hypergeometric(draw, good: int, bad: int, n: int) -> int:
    """Beyond numpy's range: the same distribution by rejection from a ratio of uniforms, its probabilities in 40 digits."""
    with localcontext() as context:
        context.prec = 50
        total, least, most = good + bad, max(0, n - bad), min(n, good)

        def weight(k: int) -> Decimal:
            return _log_factorial(k) + _log_factorial(good - k) + _log_factorial(n - k) + _log_factorial(bad - n + k)
        mean = n * good / total
        spread = math.sqrt(max(mean * (bad / total) * ((total - n) / max(total - 1, 1)), 0) + 0.5)
        peak = weight(min(max((n + 1) * (good + 1) // (total + 2), least), most))
        # the hat of Stadlober's ratio of uniforms: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
        width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        while True:
            u, v = draw.random(), draw.random()
            if not u:
                continue
            k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
            if least <= k <= most and 2 * math.log(u) <= float(peak - weight(k)):
                return k


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: float = TOTAL,
        most: float = MOST, shards: int | None = None, seed: int = 0, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks). Documents: row, id, text_key, source, size, source_size, target of every row. Blocks: shard, place (order
    in the shard), row, id, text_key, pass, words (taken from the document's beginning). text_key: ``key``, or else a hash of the text."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "mixing")
    buckets = partitions(spark, docs)
    shards = shards or buckets
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), (key if key is not None else F.xxhash64(text_col)).alias("text_key")) \
        .select("id", "text_key", "source", word_count("text").alias("size"), order.alias("order")) \
        .withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")) \
        .withColumn("row", F.monotonically_increasing_id())
    rows = tables.write(rows, "rows")  # the row numbers are those of the written table
    groups = tables.write(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.sum((F.col("size") > 0).cast("long")).alias("full")), "groups")
    listed = [(r["source"], r["size"], r["full"]) for r in groups.groupBy("source").agg(F.sum("size").alias("size"), F.sum("full").alias("full")).collect()]
    listed.sort(key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    goal = targets([r[1] for r in listed], [weights[i % len(weights)] for i in range(len(listed))], total, most)
    plan = spark.createDataFrame([(i, r[0], r[1], r[2], g, *(divmod(math.floor(g + 0.5), r[1]) if r[1] else (0, 0))) for i, (r, g) in enumerate(zip(listed, goal))],
                                 "source_no int, g_source string, source_size long, source_docs long, target double, passes long, last long")
    same = F.col("source").eqNullSafe(F.col("g_source"))
    # how many words and documents stand before each bucket of a source
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = groups.select("source", F.col("bucket").alias("g_bucket"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("words_before"),
                           F.coalesce(F.sum("full").over(before), F.lit(0)).alias("rank_before")).join(plan, same).drop("source")
    places = tables.write(places, "places")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "id", "size")
    placed = rows.where("size > 0").select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("words_in"), (F.row_number().over(inside) - 1).alias("rank_in")) \
        .join(places, same & (F.col("bucket") == F.col("g_bucket")))
    rest = F.col("last") - F.col("words_before") - F.coalesce("words_in", F.lit(0))
    placed = placed.withColumn("rest", F.least(F.greatest(rest, F.lit(0)), "size"))
    takings = F.transform(F.sequence(F.lit(1), F.col("passes") + 1), lambda p: F.struct(
        p.alias("pass"), F.when(p <= F.col("passes"), F.col("size")).otherwise(F.col("rest")).alias("words"),
        ((p - 1) * F.col("source_docs") + F.col("rank_before") + F.col("rank_in")).alias("number")))
    names = ["row", "id", "text_key", "order", "source_no", "size"]
    placed = placed.select(*names, F.explode(takings).alias("t")).select(*names, "t.*").where("words > 0")
    placed = tables.write(placed, "takings")
    quota = {r["source_no"]: r["n"] for r in placed.groupBy("source_no").agg(F.count("*").alias("n")).collect()}
    dealt = split(np.array([quota.get(i, 0) for i in range(len(listed))], np.int64), shards, seed)
    ends = spark.sparkContext.broadcast(np.cumsum(dealt, axis=0).T.copy())  # sources x shards numbers

    def deal(batches):
        for b in batches:
            source, number = b.column("source_no").to_numpy(), b.column("number").to_numpy()
            shard = np.zeros(len(source), np.int32)
            for s in np.unique(source):
                shard[source == s] = np.searchsorted(ends.value[s], number[source == s], "right")
            yield pa.RecordBatch.from_arrays([pa.array(shard), *b.columns], names=["shard", *b.schema.names])
    blocks = placed.mapInArrow(deal, f"shard int, {', '.join(f'{n} {t}' for n, t in placed.dtypes)}") \
        .select("shard", F.xxhash64(F.lit(seed), "order", "pass").alias("place"), "row", "id", "text_key", "pass", "words", "size")
    documents = rows.join(plan.select("g_source", "source_size", "target"), same).select("row", "id", "text_key", "source", "size", "source_size", "target")
    return documents, tables.write(blocks, "blocks")


def taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row a document: id, size, source_size, target, taken (words of its blocks, repeats counted)."""
    documents, blocks = mix(docs, id_col, **options)
    words = blocks.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(words, "row", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix: ``docs``' columns, a row for each block, dealt over the output shards in their order.

    A block that ends inside its document has that document's first words joined by one space, and their
    number of characters in ``chars_col`` if there is one.
    """
    a, b = free_name(docs, "mix_id"), free_name(docs, "mix_row")
    own = F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith("map")])  # equal rows share their blocks
    _, blocks = mix(docs, id_col, text_col, source_col, key=own, **options)
    right = blocks.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias(a), F.col("text_key").alias(b), F.struct("shard", "place", "words", "size").alias("block_"))
    left = docs.withColumns({a: F.coalesce(F.col(id_col).cast("string"), F.lit("")), b: own}).dropDuplicates([a, b])
    block = free_name(docs, "block_")
    every = left.join(right.withColumnRenamed("block_", block), [a, b])
    cut = F.col(f"{block}.words") < F.col(f"{block}.size")
    words = F.array_remove(F.split(text_col, r"[\x20\x09-\x0D]+"), "")
    head = F.array_join(F.slice(words, F.lit(1), F.col(f"{block}.words").cast("int")), " ")
    changed = {text_col: F.when(cut, head).otherwise(F.col(text_col))}
    out = every.withColumns(changed)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(cut, F.length(text_col).cast(dict(docs.dtypes)[chars_col])).otherwise(F.col(chars_col)))
    shards = options.get("shards") or partitions(docs.sparkSession, docs)
    return out.repartition(shards, F.col(f"{block}.shard")).sortWithinPartitions(f"{block}.shard", f"{block}.place").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, (CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight FROM s),
c AS (SELECT *, row_number() OVER o AS r, coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM w WINDOW o AS (ORDER BY source_size / weight, k)),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - filled) / rest AS level FROM c),
f AS (SELECT r AS r0, level AS level0 FROM l WHERE level * weight <= 2.0::DOUBLE * source_size ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN r < r0 THEN 2.0::DOUBLE * source_size ELSE level0 * weight END AS target FROM l, f),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t),
p AS (SELECT doc_id, size, source_size, target, goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (goal // source_size) * size + least(greatest(goal % source_size - before, 0), size) END::BIGINT AS taken FROM p
"""
