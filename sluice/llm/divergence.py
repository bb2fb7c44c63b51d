"""Source divergence audit: which sources of a language use which terms more than the language does, and how far sources are apart.

Terms are runs of letters A-Z and of characters beyond ASCII, only A-Z lower-cased. A language keeps the V terms that stand in at least
``MIN_DOCS`` of its documents. A (language, source) group, or a whole language, gives a term with n occurrences the share
p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N its sum of n over kept terms; two shares differ by f = floor((p - q)^2 / (p + q)). All in integers.

Method (part ``term``). f depends on a term's two counts alone, so the terms of a group are counted by (count in the group, count in the
language), f is worked out once for each of these cells, cells of equal f are merged, and the merged cells are ranked by f with the running sum of
their multiplicities. Cells that begin beyond the wanted rank hold no answer; the others are expanded to their terms, in UTF-8 order, and cut
at that rank.

Part ``pair``: the sum of f over all kept terms for two sources. Most terms miss in one of them. With z the share of count 0, the sum is
V f(z1, z2) + sum over terms of source 1 of (f(p1, z2) - f(z1, z2)) + the same for source 2 + sum over terms of both of (f(p1, p2) - f(p1, z2) - f(z1, p2) +
f(z1, z2)); the first three need each source's histogram of counts only, the last a join of the terms that both have.

Execution. One pass over the texts counts terms, batch by batch, for each (language, source): occurrences and documents, flushed at ``FLUSH``
entries. So a language, source or term that a third of all rows share is a few rows a task before the first shuffle. All else works on these counts.
The ten best of a group are taken with Spark's partial group limit, so a cell of a million equal terms never meets in one task.

Defined results: null text, language and source count as ''; a group without terms stands in part ``pair`` with count 0 of every term; a language that keeps
no term has value 0 for all pairs and no term row; a language of one source has no pair; repeated rows are documents of their own; ids aren't read; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.arrays import column_bytes, released, slices
from sluice.llm.tables import Tables

MIN_DOCS, TOP, FLUSH = 10, 10, 1 << 19
GROUP = ["lang", "source"]
#: A-Z to a-z, other ASCII than letters to a space, other bytes as they are.
FOLD = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(batches):
    """(lang, source, term, n, docs) of parts of the input; and a row without a term for each group that occurs."""
    counts: dict = {}
    held = 0

    def flush():
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                                              pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        counts.clear()
    for batch in batches:
        for part in slices(batch, "text"):
            raw, off = column_bytes(part.column("text"))
            folded = raw.tobytes().translate(FOLD)
            for lang, source, a, b in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                words = folded[a:b].split()
                held -= len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n)
                if held > FLUSH:
                    yield from flush()
                    held = 0
    yield from flush()


def share(count: Column, whole: Column, kept: Column) -> Column:
    scaled = (count + 2).cast("decimal(19,0)") * F.lit(10 ** 9).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", scaled, (whole + 2 * kept).cast("decimal(20,0)")) + 1)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` of all other sources, part ``term`` of the ``top`` terms."""
    tables = Tables(docs.sparkSession, "divergence")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.col(text_col).alias("text")) \
        .mapInArrow(released(term_counts), "lang string, source string, term string, n long, docs long")
    every = tables.write(parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    found = every.where(F.col("term").isNotNull())
    kept = tables.write(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= min_docs).drop("docs"), "kept")
    counts = found.join(kept, ["lang", "term"]).select(*GROUP, "term", "n", "of_lang")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = tables.write(counts, "postings")
    groups = every.select(*GROUP).distinct().join(counts.groupBy(*GROUP).agg(F.sum("n").alias("group_sum")), GROUP, "left").join(langs, "lang", "left")
    groups = groups.select(*GROUP, zero("group_sum"), zero("kept"), zero("lang_sum")).withColumn("z", share(F.lit(0).cast("long"), F.col("group_sum"), F.col("kept")))
    groups = tables.write(groups, "groups")
    return _terms(counts, groups, tables, top).unionByName(_pairs(counts, groups, tables))


def _terms(counts: DataFrame, groups: DataFrame, tables: Tables, top: int) -> DataFrame:
    cells = counts.groupBy(*GROUP, "n", "of_lang").agg(F.count("*").alias("terms")).join(groups, GROUP) \
        .withColumns({"p": share(F.col("n"), F.col("group_sum"), F.col("kept")), "q": share(F.col("of_lang"), F.col("lang_sum"), F.col("kept"))}).where("p > q") \
        .select(*GROUP, "n", "of_lang", "terms", apart(F.col("p"), F.col("q")).alias("value"))
    cells = tables.write(cells, "cells")
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    merged = cells.groupBy(*GROUP, "value").agg(F.sum("terms").alias("terms")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= top)  # a merged cell has one term at least
    before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = merged.withColumn("before", before).where(F.col("before") < top).select(*GROUP, "value")
    first = tables.write(cells.join(first, [*GROUP, "value"]).drop("terms"), "first")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "term")
    return counts.join(first, [*GROUP, "n", "of_lang"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(counts: DataFrame, groups: DataFrame, tables: Tables) -> DataFrame:
    shares = counts.join(groups, GROUP).select("lang", "source", "term", share(F.col("n"), F.col("group_sum"), F.col("kept")).alias("p"), "z")
    shares = tables.write(shares, "shares")
    side = lambda df, k, *cols: df.select("lang", F.col("source").alias(f"s{k}"), *[F.col(c).alias(f"{c}{k}") for c in cols])
    pair = ["lang", F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")]
    p1, p2, z1, z2 = map(F.col, ("p1", "p2", "z1", "z2"))
    neither = side(groups, 1, "z", "kept").join(side(groups, 2, "z"), "lang").where("s1 < s2") \
        .select("lang", "s1", "s2", F.when(F.col("kept1") > 0, F.col("kept1") * apart(z1, z2)).otherwise(0).alias("value"))
    histogram = tables.write(shares.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("terms")), "histogram")
    one = side(histogram, 1, "p", "z", "terms").join(side(groups, 2, "z"), "lang").where("s1 <> s2") \
        .select(*pair, (F.col("terms1") * (apart(p1, z2) - apart(z1, z2))).alias("value"))
    held = lambda k: shares.select("lang", "term", F.col("source").alias(f"s{k}"), F.col("p").alias(f"p{k}"), F.col("z").alias(f"z{k}"))
    both = held(1).join(held(2), ["lang", "term"]).where("s1 < s2") \
        .select("lang", "s1", "s2", (apart(p1, p2) - apart(p1, z2) - apart(z1, p2) + apart(z1, z2)).alias("value"))
    sums = [x.groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value")) for x in (neither, one, both)]
    whole = tables.write(sums[0].unionAll(sums[1]).unionAll(sums[2]).groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value")), "pairs")
    ways = F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))).alias("w")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return whole.select("lang", "value", ways).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(order))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS of_lang FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT a.lang, source, term, a.n, 1 + 1000000000::HUGEINT * (a.n + 2) // (sum(a.n) OVER (PARTITION BY a.lang, source) + 2 * v) AS p, 1 + 1000000000::HUGEINT * (of_lang + 2) // (v.n + 2 * v) AS q FROM a JOIN v USING (lang)),
pairs AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT pairs.lang, pairs.source, 'pair' AS part, pairs.item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN f USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10
"""
