"""Substring dedup: remove word runs that also occur elsewhere, found by difference-cover anchors.

A window is ``window`` consecutive words of one text. A word goes if some window
over it has a word sequence that also starts at another place (another text or
the same one); windows are judged on the input, not on what is left.

Method. Positions count from the start of their text. Only positions whose
remainder by ``period`` lies in a difference cover are hashed, each as an anchor of
``window - period + 1`` words. For any two places there is a shift below ``period``
that brings both to cover positions, so two equal windows always share an anchor
at the same shift. Repeated anchors are then extended: each window over one is
compared as a whole by a 128-bit value of its words. Other windows can't repeat
and are never shuffled.

Execution. Equal rows (same id and text) are counted, in each batch before the exchange and in each part after it, and
stand for all their copies from there on. Texts are dealt to parts once by a hash of their id and text (that
exchange is used by all three steps). A part sends each different value once,
packed, to the value's bucket; the bucket answers with one bit for each value, "also
in another part". So a passage that a third of all texts share costs one value for
each part, and no task gathers the places of a passage. Parts and buckets are as many as the input's bytes ask for (``PART_BYTES``), so that what a
task holds doesn't grow with the input; a packed row holds at least one value, so there are never more rows than values.

Defined results: null text is empty text (0 words); texts shorter than a window keep
all words; repeated rows are separate texts, so their windows repeat; null ids are kept
as null; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import arrays as A
from sluice.llm.tables import input_bytes, partitions, small_batches

#: Input bytes of a part, whose texts a task holds at once.
PART_BYTES = 16 << 20
#: Copies of one row that are written out by one step.
COPIES = 10_000
#: Perfect difference sets: each non-zero remainder of the period is the difference of exactly one pair.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
ANCHOR_BASE, LEFT_BASE, RIGHT_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5


def is_cover(period: int, cover) -> bool:
    """True if every remainder of ``period`` is a difference of two cover positions."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Part:
    """The texts of one part: anchors, then windows over repeated anchors."""

    def __init__(self, table: pa.Table, window: int, period: int):
        self.window, self.period = window, period
        value, self.count = [], []
        for piece in A.slices(table.select(["text"]), "text"):
            w = A.words(piece.column("text"))
            value.append(w.value)
            self.count.append(w.count)
        self.value = np.concatenate(value or [np.zeros(0, np.uint64)])
        self.count = np.concatenate(self.count or [np.zeros(0, np.int64)])
        copies = table.column("n").to_numpy() if table.num_rows else np.zeros(0, np.int64)
        self.copies = np.repeat(copies, self.count) if (copies > 1).any() else None  # of each word those of its text
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.place = np.arange(len(self.value)) - np.repeat(self.first[:-1], self.count)
        self.left = np.repeat(self.count, self.count) - self.place  # words from here to the end of the text

    def anchors(self):
        """Different anchor values in ascending order; of each anchor its place and the index of its value."""
        length = self.window - self.period + 1
        at = np.flatnonzero(np.isin(self.place % self.period, COVERS[self.period]) & (self.left >= length) & (self.place + self.left >= self.window))
        value = A.windows(self.value, length, ANCHOR_BASE)[at] if len(at) else np.zeros(0, np.uint64)
        keys, index = np.unique(value, return_inverse=True)
        return keys.reshape(-1, 1), at, index, self._times(at, index, len(keys))

    def _times(self, at: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """How often each of ``n`` values occurs in the part, copies included."""
        return np.bincount(index, None if self.copies is None else self.copies[at], minlength=n)

    def windows(self, repeated: np.ndarray):
        """The same for windows over one of the ``repeated`` anchor places. Keys have two 64-bit columns."""
        near = np.zeros(len(self.value) + 1, np.int32)
        np.add.at(near, np.maximum(repeated - self.period + 1, self.first[np.searchsorted(self.first, repeated, "right") - 1]), 1)
        np.add.at(near, repeated + 1, -1)
        at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= self.window))
        if not len(at):
            return np.zeros((0, 2), np.uint64), at, at, at
        key = np.empty((len(at), 2), np.uint64)
        key[:, 0] = A.windows(self.value, self.window, LEFT_BASE)[at]
        key[:, 1] = A.windows(A.mix(self.value, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F), self.window, RIGHT_BASE)[at]
        order = np.lexsort((key[:, 1], key[:, 0]))
        new = np.ones(len(at), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]).any(1)
        index = np.empty(len(at), np.int64)
        index[order] = np.cumsum(new) - 1
        return key[order[new]], at, index, self._times(at, index, int(new.sum()))


def _bucket_starts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending keys; the bucket follows from the high 32 bits."""
    return np.searchsorted((keys[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _sent(part: int, keys: np.ndarray, buckets: int) -> pa.Table:
    at = _bucket_starts(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array(np.full(len(full), part), pa.int32()), "keys": pa.array([keys[at[b]: at[b + 1]].tobytes() for b in full], pa.binary())})


def _answered(keys: np.ndarray, count: np.ndarray, rows: pa.Table, step: int, buckets: int) -> np.ndarray:
    """Of each key whether it occurs twice: here, or by the buckets' answers elsewhere too."""
    twice, at = count > 1, _bucket_starts(keys, buckets)
    for s, b, bits in zip(*(rows.column(c).to_pylist() for c in ("step", "bucket", "bits"))):
        if s == step:
            twice[at[b]: at[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=at[b + 1] - at[b]).astype(bool)
    return twice


def _elsewhere(step: int, width: int):
    """Bucket side: each part's keys -> one bit a key, set if another part sent it too."""
    def answer(table: pa.Table) -> pa.Table:
        parts, blobs = table.column("part").to_pylist(), table.column("keys").to_pylist()
        each = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in blobs]
        keys, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        order = np.lexsort(keys.T[::-1])
        same = (keys[order[1:]] == keys[order[:-1]]).all(1)
        hit = np.zeros(len(keys), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends)]
        rows = [(p, step, table.column("bucket")[0].as_py(), x) for p, x in zip(parts, bits) if any(x)]
        return pa.table({n: pa.array(c, t) for (n, t), c in zip((("part", pa.int32()), ("step", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())), zip(*rows) if rows else ([], [], [], []))})
    return answer


def _counted(batches):
    """Equal rows of a batch as one row and their number."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["id", "text"], use_threads=False).aggregate([([], "count_all")])
        yield from t.select(["id", "text", "count_all"]).rename_columns(["id", "text", "n"]).combine_chunks().to_batches()


BITS = "part int, step int, bucket int, bits binary"
SENT = "bucket int, part int, keys binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, period: int = 21, with_text: bool = False) -> DataFrame:
    """One row a text: id, n_words, n_removed, kept_sha256 (kept words joined by one space), and kept_text if asked for."""
    if not is_cover(period, COVERS[period]) or window < period:
        raise ValueError("window must be at least as long as the period of a difference cover")
    session = partitions(docs.sparkSession)
    small_batches(docs.sparkSession)
    buckets = max(session, -(-input_bytes(docs) // PART_BYTES))
    parted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_counted, "id long, text string, n long") \
        .withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int"))
    parted = parted.repartition(buckets, "part") if buckets > session else parted.repartition("part")
    parted = parted.groupBy("part", "id", "text").agg(F.sum("n").alias("n"))  # inside the part: no further exchange

    def send_anchors(table: pa.Table) -> pa.Table:
        return _sent(table.column("part")[0].as_py(), _Part(table, window, period).anchors()[0], buckets)

    def repeated_windows(table: pa.Table, bits: pa.Table):
        p = _Part(table, window, period)
        keys, at, index, count = p.anchors()
        hit = _answered(keys, count, bits, 1, buckets)[index] if len(at) else np.zeros(0, bool)
        return p, p.windows(at[hit])

    def send_windows(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, np.zeros((0, 2), np.uint64), buckets)
        return _sent(table.column("part")[0].as_py(), repeated_windows(table, bits)[1][0], buckets)

    def cut(table: pa.Table, bits: pa.Table) -> pa.Table:
        out = {"id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": [], "n": []}
        if table.num_rows:
            p, (keys, at, index, count) = repeated_windows(table, bits)
            change = np.zeros(len(p.value) + 1, np.int32)
            if len(at):
                hit = at[_answered(keys, count, bits, 2, buckets)[index]]
                np.add.at(change, hit, 1)
                np.add.at(change, hit + window, -1)
            kept = np.cumsum(change[:-1]) == 0
            gone = np.concatenate(([0], np.cumsum(~kept)))
            for k, text in enumerate(table.column("text").to_pylist()):
                a, b = p.first[k], p.first[k + 1]
                w, n = (text or "").encode().split(), int(gone[b] - gone[a])
                left = b" ".join(compress(w, kept[a:b].tolist()) if n else w)
                out["n_words"].append(int(b - a))
                out["n_removed"].append(n)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept_text"].append(left.decode() if with_text else None)
            out["id"], out["n"] = table.column("id"), table.column("n")
        kinds = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string(), "n": pa.int64()}
        return pa.table({c: out[c] if isinstance(out[c], pa.ChunkedArray) else pa.array(out[c], t) for c, t in kinds.items()})

    by_part = parted.groupBy("part")
    anchors = by_part.applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(_elsewhere(1, 1), BITS)
    wide = by_part.cogroup(anchors.groupBy("part")).applyInArrow(send_windows, SENT) \
        .groupBy("bucket").applyInArrow(_elsewhere(2, 2), BITS)
    done = by_part.cogroup(anchors.unionAll(wide).groupBy("part")) \
        .applyInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string, n long")
    done = done.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES)))) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("from"), F.lit(COPIES)))))
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
