"""Static range asymmetric numeral system: token ids as interleaved, checkpointed, checksummed blocks.

Model: one frequency table for the whole corpus, ``1 << scale`` slots in all; symbol s owns
``freq[s]`` slots from ``base[s]``. A block holds ``LANES`` interleaved coders: token i belongs to
lane i % LANES, so each step moves all lanes at once in numpy. States are in [2**31, 2**63) and are
renormalised by 32-bit words. Every ``CHECK_STEPS`` steps the block keeps a checkpoint (word offset
and lane states): segments between checkpoints decode independently of each other.

Block layout, little-endian::

    4s   magic "RNS1"        u32  documents      u32  tokens       u16 lanes   u16 segments
    documents x (i64 doc id, u32 tokens, u8 flags: 1 null id, 2 goes on in the next block, 4 goes on from the last)
    segments  x (u32 first word, u32 crc32 of the segment's ids as u32, lanes x u64 states)
    u32 words, words x u32     u32  crc32 of all that stands before
"""
from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, LANES, CHECK_STEPS = b"RNS1", 2048, 128
LOW = np.uint64(1 << 31)
HEAD = "<4sIIHH"
DOC = np.dtype([("id", "<i8"), ("n", "<u4"), ("flags", "u1")])
NULL_ID, GOES_ON, GOES_BACK = 1, 2, 4


class Model:
    """Slots of every symbol, from its count in the whole corpus."""

    def __init__(self, symbols, counts, scale: int | None = None):
        self.symbol = np.asarray(symbols, np.uint32)
        n = len(self.symbol)
        self.scale = scale or max(16, (4 * n - 1).bit_length())
        slots, total = 1 << self.scale, sum(int(c) for c in counts)
        freq = np.array([1 + int(c) * (slots - n) // total for c in counts], np.int64)
        if n:
            freq[int(np.argmax(freq))] += slots - int(freq.sum())
        self.freq, self.base = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(n, dtype=np.uint32), freq)
        self.freq_of_slot = np.repeat(self.freq, freq)
        self.place_in_slot = np.arange(len(self.of_slot), dtype=np.uint64) - np.repeat(self.base, freq)
        self.index = np.zeros(int(self.symbol.max()) + 1 if n else 0, np.uint32)
        self.index[self.symbol] = np.arange(n, dtype=np.uint32)

    def encode(self, ids: np.ndarray) -> tuple[list, np.ndarray]:
        """Checkpoints (word offset, crc32, states) and words of one block."""
        steps = -(-len(ids) // LANES)
        at = np.zeros(steps * LANES, np.uint32)
        at[: len(ids)] = self.index[ids]
        at = at.reshape(steps, LANES)
        freq, base = self.freq[at], self.base[at]
        limit = freq * ((LOW >> np.uint64(self.scale)) << np.uint64(32))
        x, out, marks, sent = np.full(LANES, LOW), [], [], 0
        scale, half = np.uint64(self.scale), np.uint64(32)
        for t in range(steps - 1, -1, -1):
            over = np.flatnonzero(x >= limit[t])
            if len(over):
                w = x[over]
                out.append(w.astype(np.uint32))
                sent += len(w)
                x[over] = w >> half
            q = x // freq[t]
            x += (q << scale) - q * freq[t] + base[t]
            if t % CHECK_STEPS == 0:
                part = ids[t * LANES: (t + CHECK_STEPS) * LANES]
                marks.append((sent, zlib.crc32(part.astype("<u4").tobytes()), x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        return [(sent - s, c, x) for s, c, x in marks[::-1]], words

    def decode(self, n: int, first: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """``n`` ids of one segment."""
        steps = -(-n // LANES)
        slots = np.empty((steps, LANES), np.uint64)
        x, at = states.copy(), first
        scale, half, mask = np.uint64(self.scale), np.uint64(32), np.uint64((1 << self.scale) - 1)
        for t in range(steps):
            slots[t] = slot = x & mask
            x >>= scale
            x *= self.freq_of_slot[slot]
            x += self.place_in_slot[slot]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << half) | words[at: at + len(low)]
                at += len(low)
        return self.symbol[self.of_slot[slots.reshape(-1)[:n]]]


def pack(model: Model, docs: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of whole bytes; ``docs`` as DOC."""
    marks, words = model.encode(ids)
    parts = [struct.pack(HEAD, MAGIC, len(docs), len(ids), LANES, len(marks)), docs.tobytes()]
    for first, crc, states in marks:
        parts += [struct.pack("<II", first, crc), states.astype("<u8").tobytes()]
    parts += [struct.pack("<I", len(words)), words.astype("<u4").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(model: Model, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and ids of a block; ValueError if a checksum doesn't hold."""
    magic, n_docs, n, lanes, segments = struct.unpack_from(HEAD, block)
    if magic != MAGIC or lanes != LANES or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    at = struct.calcsize(HEAD)
    docs = np.frombuffer(block, DOC, n_docs, at)
    at += n_docs * DOC.itemsize
    mark = np.dtype([("first", "<u4"), ("crc", "<u4"), ("states", "<u8", (LANES,))])
    marks = np.frombuffer(block, mark, segments, at)
    at += segments * mark.itemsize
    words = np.frombuffer(block, "<u4", struct.unpack_from("<I", block, at)[0], at + 4).astype(np.uint64)
    ids = np.empty(n, np.uint32)
    for k, m in enumerate(marks):
        a = k * CHECK_STEPS * LANES
        part = model.decode(min(n - a, CHECK_STEPS * LANES), int(m["first"]), m["states"].astype(np.uint64), words)
        if zlib.crc32(part.astype("<u4").tobytes()) != m["crc"]:
            raise ValueError("damaged segment")
        ids[a: a + len(part)] = part
    return docs, ids


def crc32_combine(a: int, b: int, length: int) -> int:
    """crc32 of two pieces from theirs; ``length``: bytes of the second (polynomial arithmetic over GF(2))."""
    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, c) for c in step]
    while length:
        if length & 1:
            a = times(step, a)
        step = [times(step, c) for c in step]
        length >>= 1
    return a ^ b
