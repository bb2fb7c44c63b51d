"""Words and word windows of whole Arrow string columns as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All texts of a column are
treated at once, without a Python loop over words; each value depends on the
words alone, not on where in the column they stand. Memory is about 40 bytes for
each byte of text, so callers pass slices (``slices``).
"""
from __future__ import annotations

import ctypes
import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
MASK = (1 << 64) - 1
CHUNK = 1 << 21
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP = 0x9E3779B97F4A7C15 | 1
BACK = pow(STEP, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, one text after the other, and where each begins (n + 1 places). Null: empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset: arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch, column: str, limit: int = 1 << 22):
    """``batch`` (RecordBatch or Table) in row ranges of at most ``limit`` text bytes, or one longer text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, total[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray, a: int = 0xBF58476D1CE4E5B9, b: int = 0x94D049BB133111EB) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(a)
    x = (x ^ (x >> U64(27))) * U64(b)
    return x ^ (x >> U64(31))


def release() -> None:
    """Give a worker's free memory back: called at the end of a task, as workers outlive it and stand beside the executor's heap."""
    _CACHE.clear()
    gc.collect()
    trim()


def trim() -> None:
    """The same without a search for garbage: called after a batch, so that workers of one executor don't all hold what their largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


def released(run):
    """A function of batches that calls ``release`` when its input ends."""
    def every(batches):
        yield from run(batches)
        release()
    return every


@dataclass
class Words:
    data: np.ndarray      # text bytes
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    first: np.ndarray     # of each text the index of its first word; n + 1 places
    value: np.ndarray     # 64-bit value of each word

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Of each word the text it belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    @property
    def place(self) -> np.ndarray:
        """Of each word its index inside its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)


def _powers(base: int, n: int, cache: dict) -> np.ndarray:
    have = cache.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = U64(base)
        np.cumprod(have, out=have)
        cache[base] = have
    return have[:n]


_CACHE: dict = {}


def words(column, space: np.ndarray = IS_SPACE, table: np.ndarray = BYTE_VALUE) -> Words:
    """Words of every text of a column. ``table``: the value of each byte (equal values fold bytes together)."""
    data, off = column_bytes(column)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(off), np.int64), np.zeros(0, np.uint64))
    body = ~space[data]
    first, last = body.copy(), body.copy()
    first[1:] &= ~body[:-1]
    last[:-1] &= ~body[1:]
    heads = off[:-1][off[:-1] < n]
    first[heads] = body[heads]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = body[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, off), _values(data, start, end, table))


def _values(data, start, end, table) -> np.ndarray:
    """sum(table[byte] * STEP ** place) of each word, by one running sum for each chunk of bytes."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + CHUNK, "right"))
        if j <= i:  # a word longer than a chunk
            out[i] = xxhash.xxh64_intdigest(table[data[start[i]: end[i]]].tobytes())
            i += 1
            continue
        a, b = int(start[i]), int(end[j - 1])
        run = np.empty(b - a + 1, np.uint64)
        run[0] = 0
        np.cumsum(table[data[a:b]] * _powers(STEP, b - a, _CACHE), out=run[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (run[e] - run[s]) * _powers(BACK, b - a + 1, _CACHE)[s]
        i = j
    return mix(out)


def windows(value: np.ndarray, length: int, base: int) -> np.ndarray:
    """A 64-bit value for every run of ``length`` items: a polynomial built by doubling."""
    n = len(value) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole, done, part, size, power, rest = None, 0, value, 1, base & MASK, length
    while True:
        if rest & 1:
            piece = part[done: done + n]
            whole = piece.copy() if whole is None else whole * U64(power) + piece
            done += size
        rest >>= 1
        if not rest:
            return mix(whole)
        part = part[:-size] * U64(power) + part[size:]
        power = power * power & MASK
        size *= 2
