"""WARC archives: write one record a page, read them back with segment reassembly.

Writing. Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is a response, the others are revisit records
(identical-payload-digest) that name it; all others are responses. The payload is framed as an HTTP message with chunked
transfer coding. A block longer than ``segment`` bytes is cut: the first piece is segment 1 of the response, the others are
continuation records that name it as their origin, the last with the total length. Continuations are written after a shuffle, away from their
origins, as in archives whose files are full. Files are plain WARC 1.1, written by Spark's text writer (a record's last line feed is the line's end).

Reading. Whole files are parsed by content length. Records in one piece are decoded where they are; segments are
grouped by origin id, ordered by segment number, checked (numbers 1 to n, total length) and joined, then the chunked
framing is decoded and the payload's digest compared with the header's. Revisits take their payload's length from the response that they name.

Execution. Only digests that occur more than once are joined back to pages, only segmented records are shuffled on reading; a group is the
segments of one record.

Defined results: null html is an empty payload; a null id is always a response with a null page_id; rows that share id and payload
are all responses if theirs is the smallest id (each has a record of its own); a null url leaves the target URI out; an empty
table gives no files and an empty result; other columns are ignored. A missing segment, a wrong length or digest raises an error: an archive is never read in part.
"""
from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.tables import Tables, partitions

MIN_REVISIT, SEGMENT, CHUNK = 100, 1 << 14, 1 << 13
#: Most bytes of an archive file (but for headers longer than SHORT), and of a short record.
FILE_BYTES, SHORT = 1 << 28, 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    return b"".join([*(b"%x\r\n%b\r\n" % (len(payload[k: k + size]), payload[k: k + size]) for k in range(0, len(payload), size)), b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size: at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at: at + size])
        at += size + 2


def _record(headers: dict, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r"  # the writer adds the line feed


def records(batches, segment: int):
    """Record bytes of pages (page_id, url, html, digest, origin); ``later``: a continuation."""
    task = TaskContext.get().partitionId()
    number = 0
    for b in batches:
        for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
            out: list[bytes] = []
            later: list[bool] = []
            for page, url, html, digest, origin in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "origin"))):
                number += 1
                name = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page} {digest} {task} {number}'.encode()).digest()[:16])}>"
                uri = re.sub(r"[^!-~]", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), url) if url else None
                common = {"WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Page-ID": page, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
                if origin is not None:
                    out.append(_record({"WARC-Type": "revisit", **common, "WARC-Profile": PROFILE, "WARC-Refers-To-Page-ID": origin}, HTTP))
                    later.append(False)
                    continue
                block = HTTP + chunked((html or "").encode())
                pieces = [block[k: k + segment] for k in range(0, len(block), segment)]
                out.append(_record({"WARC-Type": "response", **common, "WARC-Segment-Number": 1 if len(pieces) > 1 else None}, pieces[0]))
                later.append(False)
                for k, piece in enumerate(pieces[1:], 2):
                    own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{name} {k}'.encode()).digest()[:16])}>"
                    out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": k,
                                        "WARC-Segment-Total-Length": len(block) if k == len(pieces) else None}, piece))
                    later.append(True)
            yield pa.record_batch({"record": pa.array(out, pa.binary()), "later": pa.array(later, pa.bool_()), "long": pa.array([len(x) > SHORT for x in out], pa.bool_())})


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, segment: int = SEGMENT) -> None:
    """Write the archives below ``folder``: ``pages`` and ``continued``."""
    spark, tables = pages.sparkSession, Tables(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    long = rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = tables.write(long.where("first < last").select(F.col("digest").alias("d"), "first"), "shared")
    told = rows.join(shared, F.col("digest") == F.col("d"), "left") \
        .select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("origin"))
    made = tables.write(told.mapInArrow(lambda batches: records(batches, segment), "record binary, later boolean, long boolean"), "records", "zstd")
    text = F.col("record").cast("string").alias("value")
    # a file is one value for its reader: no more records in it than FILE_BYTES has room for, long ones in files of their own
    made.where("not later and not long").select(text).write.option("maxRecordsPerFile", max(1, FILE_BYTES // SHORT)).text(f"{folder}/pages")
    room = max(1, FILE_BYTES // (segment + SHORT))
    made.where("not later and long").select(text).write.mode("append").option("maxRecordsPerFile", room).text(f"{folder}/pages")
    made.where("later").repartition(partitions(spark, made), F.xxhash64("record")).select(text).write.option("maxRecordsPerFile", room).text(f"{folder}/continued")
    tables.drop("records")


def parse(data: bytes):
    """(headers, block) of each record of a file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4: end + 4 + size]
        at = end + 4 + size
        if data[at: at + 4] != b"\r\n\r\n":
            raise ValueError("broken record end")
        at += 4


def payload(block: bytes) -> bytes:
    """Of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


PIECES = "record_id string, segment int, total long, type string, page_id long, refers_to long, digest string, n long, block binary"


def _decoded(block: bytes, digest: str | None) -> tuple[int, str]:
    body = payload(block)
    found = hashlib.sha256(body).hexdigest()
    if digest is not None and found != digest:
        raise ValueError("payload digest differs")
    return len(body), found


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record."""
    tables = Tables(spark, "warc-read")

    def number(h, key):
        return int(h[key]) if key in h else None

    def pieces(batches):
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            for data in b.column("content"):
                out = []
                for h, block in parse(data.as_py()):
                    digest = h["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in h else None
                    cut, kind, n = "warc-segment-number" in h, h["warc-type"], None
                    if not cut and kind == "response":
                        n, digest = _decoded(block, digest)
                    out.append((h.get("warc-segment-origin-id", h["warc-record-id"]), number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), kind,
                                number(h, "warc-page-id"), number(h, "warc-refers-to-page-id"), digest, n, block if cut else None))
                cols = list(zip(*out)) if out else [[]] * len(names)
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def reassembled(table: pa.Table) -> pa.Table:
        t = table.sort_by("segment").to_pylist()
        block = b"".join(r["block"] for r in t)
        if [r["segment"] for r in t] != list(range(1, len(t) + 1)) or t[-1]["total"] != len(block):
            raise ValueError(f"segments missing for {t[0]['record_id']}")
        n, digest = _decoded(block, t[0]["digest"])
        return pa.table({"page_id": pa.array([t[0]["page_id"]], pa.int64()), "n": pa.array([n], pa.int64()), "digest": pa.array([digest], pa.string())})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{folder}/pages", f"{folder}/continued"]).select("content")
    every = tables.write(files.mapInArrow(pieces, PIECES), "pieces")
    joined = every.where("segment is not null").groupBy("record_id").applyInArrow(reassembled, "page_id long, n long, digest string")
    whole = every.where("segment is null and type = 'response'").select("page_id", "n", "digest")
    responses = tables.write(whole.unionAll(joined), "responses")
    revisits = every.where("type = 'revisit'").select("page_id", "refers_to", "digest")
    named = responses.select(F.col("page_id").alias("r"), F.col("digest").alias("d"), "n").distinct()
    resolved = revisits.join(named, (F.col("refers_to") == F.col("r")) & (F.col("digest") == F.col("d")))
    return responses.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")) \
        .unionAll(resolved.select("page_id", "n", "digest", F.lit("revisit"), "refers_to"))


def write_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, segment: int = SEGMENT) -> DataFrame:
    folder = Tables(pages.sparkSession, "archives").path("files")
    write(pages, folder, id_col, url_col, html_col, min_revisit, segment)
    return read(pages.sparkSession, folder)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)
"""
