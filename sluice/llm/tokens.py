"""Token-ID output: tokenise whole texts, write rANS blocks in ascending id order, read them back.

Writing. 1. Texts become ids in place; each row's ids go, packed, to a written table, so that no text is
tokenised twice. 2. Counts of all ids make one frequency table (a row for each vocabulary entry at most).
3. Rows are range-partitioned by (id, hash of the ids) and sorted: partition k writes shard k as blocks
of at most ``BLOCK`` tokens (``rans`` has the layout; a longer text goes on in the next block). The
blocks are the rows of a Parquet table, so that Spark's committer, not the task, makes them final.
4. A manifest has each shard's tokens, hence where it starts.

Reading. Any block decodes on its own from the frequency table; a text's start is its shard's start,
plus its block's, plus its place in it. Checksums of blocks and segments are verified.

Tokenising. Byte-level BPE never joins a non-space character with a space that follows it, nor a line break
between two of them with either, so the ids of a text are those of its space-separated words one after the other. Each
different word of a slice is looked up once: Latin letters go to the library's model and their ids are kept
(``CACHE_WORDS`` a worker), marks after them and all other words go through the library's whole encoding. Texts
with other white space or runs of it are encoded as a whole, and so are those that hold the content of an added token (such as
``<|endoftext|>``), which the library finds before it splits words.

Defined results: null text is empty text; every text gets ``end_id`` appended, so an empty one has
one token; a null id comes first; rows of one id are ordered by a hash of their ids (rows that tie have the same ids);
an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import rans
from sluice.llm.arrays import released, slices, trim
from sluice.llm.tables import Tables, partitions

BLOCK, SLICE = 1 << 19, 1 << 22
CACHE_WORDS = 250_000
MARKS = ".,!?;:%&*#$|"


class WordTokenizer:
    """Ids of whole texts as little-endian bytes (u16 if the vocabulary allows, else u32), each word encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        self.stems, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())  # letters only, as they stand after a space
        bare = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: bare.pre_tokenize_str(chr(i))[0][0] for i in range(128)}  # how the vocabulary writes each byte
        self.space = self.shown[0x20]
        for i in range(64):
            self.shown[0x80 + i] = bare.pre_tokenize_str(chr(0x100 + i))[0][0][1]
        for i in range(2, 8):
            self.shown[0xC0 + i] = bare.pre_tokenize_str(chr(i << 6))[0][0][0]
        for i in (8, 9):
            self.shown[0xC0 + i] = bare.pre_tokenize_str(chr(i << 6))[0][0][0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, text: str) -> str:
        """Letters after a space, as the vocabulary writes their bytes."""
        return self.space + text if text.isascii() else (" " + text).encode().decode("latin-1").translate(self.shown)

    def _learn(self, stems: list[str]) -> pa.Array:
        """Ids of Latin letters after a space: one piece for the model's pre-tokenizer, so the model alone is asked."""
        tokenize, counts, flat = self.lib.model.tokenize, [], []
        for x in stems:
            ids = tokenize(self._spaced(x))
            counts.append(len(ids))
            flat += [t.id for t in ids]
        data = np.array(flat, self.dtype)
        ends = np.cumsum([0, *counts], dtype=np.int64) * data.itemsize
        return pa.Array.from_buffers(pa.binary(), len(stems), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    def _words(self, words) -> tuple[pa.Array, np.ndarray]:
        """Ids of different words as they stand after a space (those with a line break before them: as they are), and which words the rule doesn't cover."""
        stems = pc.utf8_rtrim(words, characters=MARKS)
        coded = stems.dictionary_encode()
        code, stem = coded.indices.to_numpy(), coded.dictionary
        at = pc.fill_null(pc.index_in(stem, value_set=self.stems), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero((at < 0) & pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False))
        named = stem.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist()
        latin = np.array([x.isascii() or max(x) < "\u0250" for x in named], bool)
        new, named = new[latin], [x for x, ok in zip(named, latin) if ok]
        at[new] = len(self.stems) + np.arange(len(new))
        self.stems = pa.concat_arrays([self.stems, pa.array(named, pa.string())])
        self.ids = pa.concat_arrays([self.ids, self._learn(named)])
        of, known = at[code], (at >= 0)[code]
        # marks after letters are a piece of their own
        tail = np.zeros(len(code), np.int64)
        marked = np.flatnonzero(known & (pc.binary_length(words).to_numpy() > pc.binary_length(stems).to_numpy()))
        whole, bare = (x.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist() for x in (words, stems))
        marks: dict[str, int] = {"": 0}
        tail[marked] = [marks.setdefault(w[len(x):], len(marks)) for w, x in zip(whole, bare)]
        # all other words go to the library as they are
        rest = np.flatnonzero(~known)
        other = words.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist()
        odd = [w.split() != [w.removeprefix("\n")] for w in other]
        given = self._ids(["" if o else w if w[0] == "\n" else " " + w for w, o in zip(other, odd)])
        of[rest] = len(self.ids) + np.arange(len(rest))
        head = pa.concat_arrays([self.ids, pa.array(given, pa.binary())]).take(pa.array(of))
        if len(self.stems) > CACHE_WORDS:  # keep those of this column
            held = pa.array(at[at >= 0])
            self.stems, self.ids = self.stems.take(held), self.ids.take(held)
        ends = pa.array(self._ids(list(marks)), pa.binary()).take(pa.array(tail))
        return pc.binary_join_element_wise(head, ends, pa.scalar(b"", pa.binary())), rest[np.array(odd, bool)]

    def column(self, texts) -> list[bytes]:
        """Ids of every text of an Arrow string column; each different word of the column is looked up once."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        at, code = at - at[0], words.indices.to_numpy().astype(np.int64)
        first, begin = np.unique(code[at[:-1]], return_inverse=True)
        outer = words.dictionary.take(pa.array(first)).to_pylist()
        inner, odd = self._words(words.dictionary)
        strange = np.zeros(len(inner), bool)
        strange[odd] = True
        strange = strange[code]
        strange[at[:-1]] = np.array([x.split() != [x] for x in outer])[begin] & (np.diff(at) > 1)
        strange = np.add.reduceat(strange, at[:-1], dtype=np.int64) > 0
        for token in self.added:
            strange |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        code[at[:-1]] = len(inner) + begin
        flat = pa.concat_arrays([inner, pa.array(self._ids(outer), pa.binary())]).take(pa.array(code))
        _, ends, data = flat.buffers()
        ends, data = np.frombuffer(ends, np.int32)[at].tolist(), memoryview(data or b"")
        return [self._ids([texts[i].as_py()])[0] if strange[i] else bytes(data[ends[i]: ends[i + 1]]) for i in range(len(texts))]


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One a worker process, so that its words are kept from task to task."""
    return WordTokenizer(path)


def _squeeze(ids: bytes, width: int, tool: zstandard.ZstdCompressor) -> bytes:
    """Ids of ``width`` bytes each as compressed byte planes."""
    return bytes([width]) + tool.compress(np.frombuffer(ids, np.uint8).reshape(-1, width).T.tobytes())


def _unsqueeze(data: bytes, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    width = data[0]
    return np.frombuffer(tool.decompress(data[1:]), np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").reshape(-1)


def token_rows(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """(id, order, ids, counts): the ids of each text with the end id, packed; a slice's first row counts the ids of the slice."""
    def run(batches):
        from sluice.llm import tokens  # the worker's own module, which lives longer than a task
        encode, tool = tokens.tokenizer(tokenizer_path), zstandard.ZstdCompressor(1)
        end, width = np.array([end_id], encode.dtype).tobytes(), int(encode.dtype[2])
        for b in batches:
            for part in slices(b, "text", SLICE):
                each = [x + end for x in encode.column(part.column("text"))]
                seen = np.bincount(np.frombuffer(b"".join(each), encode.dtype))
                at = np.flatnonzero(seen)
                counts = at.astype("<i8").tobytes() + seen[at].astype("<i8").tobytes()
                yield pa.record_batch({"id": part.column("id"), "order": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                                       "ids": pa.array([_squeeze(x, width, tool) for x in each], pa.binary()),
                                       "counts": pa.array([counts] + [None] * (len(each) - 1), pa.binary())})
                del each, seen
            trim()
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), "id long, order long, ids binary, counts binary")


def counts(rows: DataFrame) -> DataFrame:
    """(symbol, n): how often each id occurs in all rows."""
    def run(batches):
        for b in batches:
            for x in b.column("counts"):
                symbol, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                yield pa.record_batch({"symbol": symbol, "n": n})
    return rows.select("counts").where("counts is not null").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


BLOCKS = "shard int, block int, start long, n_tokens long, first_doc long, last_doc long, data binary"


def blocks(rows: DataFrame, model, limit: int = BLOCK) -> DataFrame:
    """One row a block; shards are range partitions in ascending id order. ``model``: a broadcast rans.Model."""
    def run(batches):
        shard, tool, m = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), model.value
        held, entries, size, start, number = [], [], 0, 0, 0

        def send():
            docs, ids = np.array(entries, rans.DOC), np.concatenate(held).astype(np.uint32)
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "start": pa.array([start], pa.int64()),
                                    "n_tokens": pa.array([size], pa.int64()), "first_doc": pa.array([int(docs["id"][0])], pa.int64()),
                                    "last_doc": pa.array([int(docs["id"][-1])], pa.int64()), "data": pa.array([rans.pack(m, docs, ids)], pa.binary())})
        for b in batches:
            for doc, packed in zip(b.column("id").to_pylist(), b.column("ids")):
                ids, back = _unsqueeze(packed.as_py(), tool), 0
                null = rans.NULL_ID if doc is None else 0
                while len(ids):
                    if size and size + len(ids) > limit:
                        yield send()
                        held, entries, start, number, size = [], [], start + size, number + 1, 0
                    part, ids = ids[:limit], ids[limit:]
                    held.append(part)
                    entries.append((doc or 0, len(part), null | back | (rans.GOES_ON if len(ids) else 0)))
                    size, back = size + len(part), rans.GOES_BACK
        if size:
            yield send()
    dealt = rows.select("id", "order", "ids").repartitionByRange(partitions(rows.sparkSession, rows), "id", "order").sortWithinPartitions("id", "order")
    return dealt.select("id", "ids").mapInArrow(released(run), BLOCKS)


def write(docs: DataFrame, folder: str, id_col: str, text_col: str, tokenizer_path: str, end_id: int = 0, block: int = BLOCK) -> None:
    """Write the files below ``folder``: ``frequencies``, ``blocks`` and ``manifest``."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "tokens")
    rows = tables.write(token_rows(docs, id_col, text_col, tokenizer_path, end_id), "rows", "uncompressed")
    counts(rows).coalesce(1).write.parquet(f"{folder}/frequencies")
    blocks(rows, spark.sparkContext.broadcast(read_model(spark, folder)), block).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    tables.drop("rows")
    shards = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row a partition
    starts = np.cumsum([0, *(r["n"] for r in shards)]).tolist()
    spark.createDataFrame([(r["shard"], s, r["n"]) for r, s in zip(shards, starts)], "shard int, start long, n_tokens long").coalesce(1).write.parquet(f"{folder}/manifest")


def read_model(spark: SparkSession, folder: str) -> rans.Model:
    """The shared frequency table: a row for each vocabulary entry that occurs."""
    rows = spark.read.parquet(f"{folder}/frequencies").orderBy("symbol").collect()
    return rans.Model([r["symbol"] for r in rows], [r["n"] for r in rows])


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 of every text, and its ids (binary, u32) if asked for."""
    model = spark.sparkContext.broadcast(read_model(spark, folder))

    def run(batches):
        for b in batches:
            for shard, number, start, data in zip(*(b.column(c) for c in ("shard", "block", "start", "data"))):
                docs, ids = rans.unpack(model.value, data.as_py())
                end = np.cumsum(docs["n"].astype(np.int64))
                first = end - docs["n"]
                flat = ids.astype("<u4")
                parts = [flat[x:y].tobytes() for x, y in zip(first, end)]
                yield pa.record_batch({
                    "id": pa.array(docs["id"], pa.int64(), mask=(docs["flags"] & rans.NULL_ID).astype(bool)),
                    "shard": pa.array(np.full(len(docs), shard.as_py()), pa.int32()), "at": pa.array(first + start.as_py(), pa.int64()),
                    "n": pa.array(docs["n"].astype(np.int64)), "crc": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    "whole": pa.array((docs["flags"] & (rans.GOES_ON | rans.GOES_BACK)) == 0), "ends": pa.array((docs["flags"] & rans.GOES_ON) == 0),
                    "ids": pa.array(parts if with_ids else [None] * len(parts), pa.binary())})
    schema = "id long, shard int, at long, n long, crc long, whole boolean, ends boolean, ids binary"
    pieces = Tables(spark, "decoded").write(spark.read.parquet(f"{folder}/blocks").mapInArrow(released(run), schema), "pieces")
    # a text in several blocks: its last piece is the first end at or after each piece, in the shard's order
    ends = pieces.where("not whole and ends").select("shard", F.col("at").alias("end_at"))
    cut = pieces.where("not whole").join(ends, "shard").where("end_at >= at").groupBy("shard", "at", "n", "crc", "id", "ids").agg(F.min("end_at").alias("end_at"))

    def joined(table: pa.Table) -> pa.Table:
        t = table.sort_by("at").to_pylist()
        crc = t[0]["crc"]
        for r in t[1:]:
            crc = rans.crc32_combine(crc, r["crc"], 4 * r["n"])
        return pa.table({"id": pa.array([t[0]["id"]], pa.int64()), "shard": pa.array([t[0]["shard"]], pa.int32()), "at": pa.array([t[0]["at"]], pa.int64()),
                         "n": pa.array([sum(r["n"] for r in t)], pa.int64()), "crc": pa.array([crc], pa.int64()),
                         "ids": pa.array([b"".join(r["ids"] for r in t) if with_ids else None], pa.binary())})
    whole = pieces.where("whole").select("id", "shard", "at", "n", "crc", "ids")
    every = whole.unionAll(cut.groupBy("shard", "end_at").applyInArrow(joined, "id long, shard int, at long, n long, crc long, ids binary"))
    shards = spark.read.parquet(f"{folder}/manifest").select("shard", F.col("start").alias("shard_start"))
    return every.join(shards, "shard").select(F.col("id").alias("doc_id"), (F.col("shard_start") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"),
                                              F.col("crc").alias("ids_crc32"), *(["ids"] if with_ids else []))


def write_and_read(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Write ``docs`` below the shared folder and return what the files say."""
    folder = Tables(docs.sparkSession, "token-files").path("files")
    write(docs, folder, id_col, text_col, tokenizer_path, end_id, block)
    return read(docs.sparkSession, folder, with_ids)
