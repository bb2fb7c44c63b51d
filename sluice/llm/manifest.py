"""Merkle manifest of a dataset: leaves, roots and inclusion proofs, from levels kept as concatenated strings.

A row's leaf is the SHA-256 of its fields, each as its UTF-8 byte count, ``:`` and its value (null: ``-``). Per group leaves
ascend by id; runs of 8 nodes become their hash until one is left, the group's subroot; subroots, ordered by group, likewise
give the root. All digests are hashed as lower-case hex text. A proof lists, level by level, what stands left and right of the node
in its run (nothing on both sides if it is alone there).

Method. Ranks cut a group into aligned blocks of 8 ** ``LEVELS`` leaves. A block keeps each of its levels as one hex string: 64
characters a node, so a run is a substring of 512, the next level is the hashes of these substrings joined, and a
node's siblings are the substrings left and right of its own 64 characters. A block ends in one node; these are the leaves of the next
tier, which is built in the same way, until each group has one node. The tree over the groups is built by the same code. Then proofs are handed
down, tier by tier: a block's proof is joined to the block and follows each member's own segment.

Execution. Ranks come from a range partitioning by (group, id, leaf) and the row counts of its parts, so a group with all rows is
spread over all tasks; the last sort key is the row's place in the written leaf table, so repeated rows spread as well. A block is the
largest thing that one task gathers; the number of tiers is the logarithm of the largest group to the block's size.

Defined results: a null group is a group of its own, before the others; a null id stands before the others; equal ids stand in the order of their
leaves, so rows that repeat as a whole are leaves of their own, whose proofs differ by place; null, empty and long texts are values like any other;
an empty table gives an empty result; other columns are ignored. The result as a set of rows does not depend on how Spark deals the rows.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.tables import Tables, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 3
DIGEST, RUN = 64, 8
PROOF = "array<struct<before:string,after:string>>"
#: Tables of part offsets up to this many rows are broadcast (about 40 bytes a row).
MAX_OFFSETS = 200_000


def leaf(fields: list[Column]) -> Column:
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings, level by level, left to right, as one string."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _ranked(leaves: DataFrame, tables: Tables, name: str) -> tuple[DataFrame, int]:
    """Leaves (g, id, node, own) with ``rank`` in their group and its size ``m``; and the largest size."""
    order = [F.col("g"), F.col("id").asc_nulls_first(), F.col("node"), F.col("tie")]
    ordered = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(leaves.sparkSession, leaves), *order) \
        .sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("tie", "id")
    ordered = tables.write(ordered, f"{name}-ordered").withColumn("part", F.shiftright("at", 33))
    parts = tables.write(ordered.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), f"{name}-parts")
    sizes = parts.groupBy("g").agg(F.sum("n").alias("m"))
    largest, rows = sizes.agg(F.max("m")).first()[0] or 0, parts.count()
    running = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("g", "part", "first", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")).join(sizes, "g")
    nodes = ordered.join(F.broadcast(offsets) if rows <= MAX_OFFSETS else offsets, ["g", "part"])
    return nodes.select("g", "m", (F.col("at") - F.col("first") + F.col("before")).alias("rank"), "node", "own"), largest


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks (g, m, block, members, levels): levels as strings, leaves first, until one node is left or the block's levels are used up."""
    size = RUN ** levels
    height = F.lit(levels)
    for h in reversed(range(levels)):
        height = F.when(F.col("m") <= RUN ** h, h).otherwise(height)

    def up(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (RUN * DIGEST)).cast("int") - 1)
        return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (RUN * DIGEST) + 1, F.lit(RUN * DIGEST)), 256)), "")
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(F.array_join("members.node", "")),
                        lambda have, i: F.when(i <= height, F.concat(have, F.transform(F.slice(have, -1, 1), up))).otherwise(have))
    return nodes.groupBy("g", "m", F.floor(F.col("rank") / size).alias("block")) \
        .agg(F.sort_array(F.collect_list(F.struct("rank", "node", "own"))).alias("members")).withColumn("levels", grown)


def _tiers(leaves: DataFrame, tables: Tables, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The written blocks of every tier, and each group's last node (g, block, node)."""
    nodes, largest = _ranked(leaves, tables, name)
    tiers = []
    while True:
        tiers.append(tables.write(_blocks(nodes, levels), f"{name}-{len(tiers)}"))
        size = RUN ** levels
        nodes = tiers[-1].select("g", F.ceil(F.col("m") / size).alias("m"), F.col("block").alias("rank"), F.element_at("levels", -1).alias("node"), F.lit(0).alias("own"))
        if largest <= size:
            return tiers, nodes.select("g", F.col("rank").alias("block"), "node")
        largest = -(-largest // size)


def _unfold(blocks: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """Members of the blocks with their whole proofs; ``above``: (g, block, proof, carried columns) of the blocks' own nodes."""
    place = lambda run, level: F.call_function("shiftright", run, level * 3)
    wide = F.lit(RUN * DIGEST)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("members") - 1) / RUN).cast("int")), lambda r: F.struct(
        r.alias("run"), F.slice("members", r * RUN + 1, F.lit(RUN)).alias("members"),
        F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), lambda s, l: F.substring(s, place(r, l) * (RUN * DIGEST) + 1, wide)).alias("around")))
    each = blocks.join(above, ["g", "block"]).select("g", "proof", *carried, F.explode(runs).alias("r")) \
        .select("g", "proof", *carried, "r.run", "r.around", F.posexplode("r.members").alias("p", "member"))

    def flanks(s: Column, l: Column) -> Column:
        at = F.when(l == 0, F.col("p")).otherwise(place(F.col("run"), F.greatest(l - 1, F.lit(0))) % RUN) * DIGEST
        return F.struct(F.substring(s, F.lit(1), at).alias("before"), F.substring(s, at + DIGEST + 1, wide).alias("after"))
    return each.select("g", "member.rank", "member.node", "member.own", F.concat(F.transform("around", flanks), "proof").cast(PROOF).alias("proof"), *carried)


def build(docs: DataFrame, keep: dict[str, Column], fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", levels: int = LEVELS) -> DataFrame:
    """One row a document: the ``keep`` columns, leaf, subroot, root, proof (from the leaf's level to the root's)."""
    tables = Tables(docs.sparkSession, "manifest")
    group = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(group.alias("g"), F.col(id_col).alias("id"), leaf([F.col(c) for c in fields]).alias("node"), F.struct(*[c.alias(n) for n, c in keep.items()]).alias("own"))
    tiers, subroots = _tiers(tables.write(leaves, "leaves"), tables, "group", levels)
    top, root = _tiers(tables.write(subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), "node", F.col("g").alias("own")), "subroots"), tables, "top", levels)
    above = root.select("g", "block", F.array().cast(PROOF).alias("proof"), F.col("node").alias("root"))
    for blocks in reversed(top):
        below = _unfold(blocks, above, ["root"])
        above = below.select("g", F.col("rank").alias("block"), "proof", "root")
    above = below.select(F.col("own").alias("g"), F.lit(0).cast("long").alias("block"), "proof", "root", F.col("node").alias("subroot"))
    for blocks in reversed(tiers):
        below = _unfold(blocks, above, ["root", "subroot"])
        above = below.select("g", F.col("rank").alias("block"), "proof", "root", "subroot")
    return below.select("own.*", F.col("node").alias("leaf"), "subroot", "root", "proof")


def audit(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """The manifest's digests, and the root that each row's proof gives after every third row (by the id's crc32) had its text's A-Z lower-cased."""
    lower = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    bent = F.when(F.crc32(F.col(id_col).cast("string")) % 3 == 0, leaf([lower if c == text_col else F.col(c) for c in fields]))
    rows = build(docs, {"id": F.col(id_col), "bent": bent}, fields, id_col, group_col, levels)
    folded = fold(F.coalesce("bent", "leaf"), F.col("proof"))
    return rows.select(F.col("id").alias(id_col), "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE c AS (SELECT *, list_reduce([ord(x) FOR x IN string_split(doc_id::VARCHAR, '')], lambda a, b: list_reduce(range(8), lambda h, i: xor(h >> 1, 3988292384 * (h & 1)), xor(a, b)), 4294967295) AS crc FROM documents),
d AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS bent,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM c),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(bent) || ':' || bent, '-')) AS bent FROM d),
r AS (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM l),
t(g, level, k, h, n) AS (SELECT g, 0, k, leaf, count(*) OVER (PARTITION BY g) FROM r
  UNION ALL SELECT g, level, k, h, count(*) OVER (PARTITION BY g) FROM (SELECT g, level + 1 AS level, k // 8 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM t WHERE n > 1 GROUP BY g, level, k // 8)),
s AS (SELECT g, level AS top, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k FROM t WHERE n = 1),
u(level, k, h, n) AS (SELECT 0, k, subroot, count(*) OVER () FROM s
  UNION ALL SELECT level, k, h, count(*) OVER () FROM (SELECT level + 1 AS level, k // 8 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM u WHERE n > 1 GROUP BY level, k // 8)),
nodes AS (SELECT g, t.level, t.k, t.h FROM t JOIN s USING (g) WHERE t.level < top
  UNION ALL SELECT s.g, s.top + u.level, u.k, u.h FROM u, s WHERE u.n > 1),
ways AS (SELECT r.g, r.k AS leaf_k, top, s.k AS group_k FROM r JOIN s USING (g)),
steps AS (SELECT w.g, leaf_k, nodes.level, max(CASE WHEN nodes.k = x THEN 1 ELSE 0 END) AS own, coalesce(string_agg(h, '' ORDER BY nodes.k) FILTER (nodes.k < x), '') AS before, coalesce(string_agg(h, '' ORDER BY nodes.k) FILTER (nodes.k > x), '') AS after
  FROM (SELECT w.*, n.level AS at, CASE WHEN n.level < top THEN leaf_k // (8 ** n.level)::BIGINT ELSE group_k // (8 ** (n.level - top))::BIGINT END AS x FROM ways w JOIN (SELECT DISTINCT g, level FROM nodes) n USING (g)) w
  JOIN nodes ON nodes.g = w.g AND nodes.level = w.at AND nodes.k // 8 = x // 8 GROUP BY w.g, leaf_k, nodes.level),
f(g, k, level, h) AS (SELECT g, k, 0, bent FROM r
  UNION ALL SELECT f.g, f.k, f.level + 1, sha256(before || h || after) FROM f JOIN steps ON steps.g = f.g AND leaf_k = f.k AND steps.level = f.level),
p AS (SELECT g, leaf_k AS k, string_agg(before || after, '' ORDER BY level) AS p FROM steps GROUP BY g, leaf_k),
e AS (SELECT g, k, arg_max(h, level) AS folded_root FROM f GROUP BY g, k)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM r JOIN (SELECT g, subroot FROM s) USING (g) JOIN e USING (g, k) LEFT JOIN p USING (g, k), (SELECT h AS root FROM u WHERE n = 1)
"""
