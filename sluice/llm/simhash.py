"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprint: words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased) in
shingles of ``shingle`` words, repeats included; each shingle is hashed with XXH64
(seed 42) and a bit is 1 if more than half the hashes set it. Fingerprints link at
``radius`` (3) or fewer differing bits.

Method. Two fingerprints at distance 2 meet at a variant that is one flip from both.
For the odd third bit one of four 16-bit blocks is left out in turn: if fingerprints
differ in three bits, leaving out a block that holds one of them leaves a distance of at
most 2. So every different fingerprint emits, for each block, what remains of it and all
variants of that within one flip (4 * 49), the rows are shuffled on (block, variant), and
colliding pairs are verified on all 64 bits. Within a bucket only a spanning forest of
the verified links is kept, so a large group of near copies never becomes all its
pairs: short buckets compare their members directly, longer ones spread labels through a
table over the left-out block (851 look-ups a member, whatever the bucket's size).
A variant's bucket holds different fingerprints only, 49 * 65536 at most.

Components: alternating large-star and small-star over the forests' edges.

Defined results: null or wordless text has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle; repeated rows share fingerprint and
component; a null id is kept and never names a component unless all its ids are null; an
empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.arrays import released, trim
from sluice.llm.tables import Tables, free_name, partitions

RADIUS = 3
BLOCKS, BLOCK_BITS = 4, 16
KEPT_BITS = 64 - BLOCK_BITS
KEPT = (1 << KEPT_BITS) - 1
SEED = 42
SHORT_BUCKET = 64  # up to here members are compared directly; longer buckets take the table: same links


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash of one text."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    flat, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, w), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    n = len(w) - shingle + 1
    h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])), np.uint64, n)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_key, fp) of every row; text_key is a hash of the text, fp the unsigned fingerprint in a signed long."""
    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
            yield pa.record_batch({"id": b.column("id"), "text_key": b.column("text_key"), "fp": pa.array(fp.view(np.int64))})
            trim()
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")) \
        .mapInArrow(released(run), "id long, text_key long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each block the fingerprint without it, and that with each bit flipped; the block's number is in the key's top bits."""
    def turned(block: int):  # the left-out block on top
        s = BLOCK_BITS * block
        return F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")
    kept = F.array(*[turned(b).bitwiseAND(F.lit(KEPT)).bitwiseOR(F.lit(b << KEPT_BITS)) for b in range(BLOCKS)])
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << i for i in range(KEPT_BITS)))])
    return fps.select("fp", F.explode(kept).alias("kept")).select("fp", "kept", F.explode(flips).alias("flip")) \
        .select(F.col("kept").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def _masks(most: int) -> list[int]:
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= most]


MASKS = [_masks(k) for k in range(RADIUS + 1)]
Pairs = tuple[np.ndarray, np.ndarray]


def _long_bucket(key: int, fp: np.ndarray) -> Pairs:
    """Forest of one bucket's links, by labels that spread through a table: a row for each flip, a cell for each left-out value.

    Members with the same flip link within 3 bits of the left-out block, an unflipped and a
    flipped one within 2, two flipped at different bits within 1.
    """
    fp = np.sort(fp)
    s = np.uint64(BLOCK_BITS * (key >> KEPT_BITS))
    turned = (fp << s) | (fp >> (np.uint64(64) - s)) if s else fp
    flip = (turned & np.uint64(KEPT)) ^ np.uint64(key & KEPT)
    rows, row = np.unique(flip, return_inverse=True)
    value = (turned >> np.uint64(KEPT_BITS)).astype(np.int64)
    cell, flipped, n = row * (1 << BLOCK_BITS) + value, flip != 0, len(fp)
    table = np.full((len(rows), 1 << BLOCK_BITS), n, np.int32)
    flat, label = table.reshape(-1), np.arange(n, dtype=np.int32)
    none = np.full(1 << BLOCK_BITS, n, np.int32)
    while True:
        flat[cell] = label
        new = label.copy()
        for m in MASKS[3]:
            np.minimum(new, flat[cell ^ m], out=new)
        plain = table[0] if rows[0] == 0 else none
        other = table[rows != 0].min(0, initial=n)
        for m in MASKS[2]:
            np.minimum(new, np.where(flipped, plain[value ^ m], other[value ^ m]), out=new)
        for m in MASKS[1]:
            np.minimum(new, np.where(flipped, other[value ^ m], n), out=new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = label != np.arange(n)
    return fp[label[tied]], fp[tied]


def _buckets(key: np.ndarray, fp: np.ndarray) -> list[Pairs]:
    """Verified links of whole buckets, given in key order."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    out = [_long_bucket(int(key[a]), fp[a: a + n]) for a, n in zip(begin[size > SHORT_BUCKET], size[size > SHORT_BUCKET])]
    short = np.repeat((size > 1) & (size <= SHORT_BUCKET), size)
    key, fp = key[short], fp[short]
    for gap in range(1, SHORT_BUCKET):
        at = np.flatnonzero(key[gap:] == key[:-gap])
        if not len(at):
            break
        a, b = fp[at], fp[at + gap]
        near = np.bitwise_count(a ^ b) <= RADIUS
        out.append((a[near], b[near]))
    return out


def _forest(links: list[Pairs]) -> Pairs:
    """One link from the smallest member to each other member of every group that ``links`` join."""
    a, b = (np.concatenate([x[i] for x in links] or [np.zeros(0, np.uint64)]) for i in (0, 1))
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a):], np.arange(len(node))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = label != np.arange(len(node))
    return node[label[tied]], node[tied]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): verified links that join what is linked; ``fps`` holds different fingerprints."""
    def run(batches):
        tail_key: list = []
        tail_fp: list = []
        found: list[Pairs] = []

        def send():
            a, b = _forest(found)
            found.clear()
            for i in range(0, len(a), 1 << 16):
                yield pa.record_batch({"a": a[i: i + (1 << 16)].view(np.int64), "b": b[i: i + (1 << 16)].view(np.int64)})
        for batch in batches:
            key, fp = (batch.column(c).to_numpy() for c in ("key", "fp"))
            fp = fp.view(np.uint64)
            if not len(key):
                continue
            if tail_key and key[-1] == tail_key[0][0]:  # still the same bucket
                tail_key.append(key)
                tail_fp.append(fp)
                continue
            last = int(np.searchsorted(key, key[-1]))
            found += _buckets(np.concatenate([*tail_key, key[:last]]), np.concatenate([*tail_fp, fp[:last]])) if tail_key or last else []
            tail_key, tail_fp = [key[last:]], [fp[last:]]
            if sum(len(x[0]) for x in found) > 1 << 20:
                yield from send()
        if tail_key:
            found += _buckets(np.concatenate(tail_key), np.concatenate(tail_fp))
        yield from send()
    dealt = variants(fps).repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b), by large-star and small-star rounds.

    Smallest neighbours are written before they are joined back, so that both sides of the
    join are plain exchanges whose hot keys Spark splits.
    """
    def star(e: DataFrame, name: str, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        low = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), f"{name}-low")
        to = both.join(low, "a")
        if large:
            new = to.where("b > a").select(F.col("low").alias("a"), "b")
        else:
            new = to.select(F.col("low").alias("a"), "b").where("a <> b").unionAll(low.select(F.col("low").alias("a"), F.col("a").alias("b")))
        out = tables.write(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
        tables.drop(f"{name}-low")
        return out

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    names, k = ["star0"], 0
    e = tables.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "star0")
    was = state(e)
    while was[0]:
        k += 1
        for large in (True, False):
            names.append(f"star{k}{'l' if large else 's'}")
            e = star(e, names[-1], large)
        for old in names[:-1]:
            tables.drop(old)
        names, now = names[-1:], state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[Tables, DataFrame, DataFrame]:
    """Written tables: (id, text_key, fp) of every row; (fp, least, root) of every different fingerprint."""
    tables = Tables(docs.sparkSession, "simhash")
    rows = tables.write(fingerprints(docs, id_col, text_col, shingle), "rows")
    least = tables.write(rows.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    root = components(links(least.select("fp")), tables)
    return tables, rows, tables.write(least.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row a text: id, fingerprint (16 lower-case hex digits), component_id (smallest id reachable)."""
    tables, rows, named = _groups(docs, id_col, text_col, shingle)
    low = tables.write(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of = tables.write(named.join(low, "root").select("fp", "component_id"), "of")
    return rows.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest id (null last), then the smallest hash of the text."""
    tables, rows, named = _groups(docs, id_col, text_col, shingle)
    first = rows.groupBy("fp").agg(F.min(F.struct(F.isnull("id"), "id", "text_key")).alias("first")).join(named, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return docs_with(docs, tables.write(first.select("first.id", "first.text_key"), "kept"), id_col, text_col)


def docs_with(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each (id, text_key) of ``wanted``; equal rows count once."""
    a, b, c = (free_name(docs, x) for x in ("key_id", "key_null", "key_text"))
    keys = {a: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), b: F.col(id_col).isNull(), c: F.xxhash64(text_col)}
    right = wanted.select(F.coalesce("id", F.lit(0)).alias(a), F.isnull("id").alias(b), F.col("text_key").alias(c))
    return docs.withColumns(keys).join(right, [a, b, c], "left_semi").dropDuplicates([a, b, c]).select(*docs.columns)
