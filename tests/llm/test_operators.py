"""Each operator against a brute-force version on tables with nulls, empty and long texts, ties, repeats and clashing columns."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from sluice.llm import arrays, decontam, html, langid, mixing, neighbours, quality, rans, simhash, substring, tokens, warc
from sluice.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 977}" for i in range(20000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
DOCS = [(0, "the cat sat on the mat and the dog ran", "en", "a"), (1, None, "en", "a"), (2, "", None, "b"), (3, " \t\n", "fr", None),
        (4, LONG, "en", "a"), (5, LONG + " more", "en", "b"), (6, f"start here {PASSAGE} end", "en", "a"), (7, f"other words {PASSAGE}", "fr", "a"),
        (8, "Le chat noir dort sur la table avec son ami", "fr", "b"), (9, "Le chat noir dort sur la table avec son ami", "fr", "b"),
        (9, "Le chat noir dort sur la table avec son ami", "fr", "b"), (None, "no id here", "en", "a"), (10, "ÀÉ 12\r\n x  y\tz", "fr", "é"), (11, "?!", "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(DOCS, SCHEMA)
    for c in ("id", "fp", "part", "component_id", "order", "row", "size", "h", "key", "block_", "Key_ID", "identified", "mix_row"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_difference_covers():
    assert all(substring.is_cover(p, c) for p, c in substring.COVERS.items()) and not substring.is_cover(7, (0, 1, 2))


def test_word_windows():
    import pyarrow as pa
    w = arrays.words(pa.array(["a b c a b c", None, "", "b c a b"]))
    seen = arrays.windows(w.value, 3, 0x1235)
    flat = "a b c a b c b c a b".split()
    runs = [tuple(flat[i:i + 3]) for i in range(8)]
    assert all((runs[i] == runs[j]) == (seen[i] == seen[j]) for i in range(8) for j in range(8))


def test_substring(docs, nothing):
    count, each = collections.Counter(), [(r[0], words(r[1])) for r in DOCS]
    for _, w in each:
        count.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    want = []
    for i, w in each:
        keep = [True] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j:j + 35])] > 1:
                keep[j:j + 35] = [False] * 35
        left = b" ".join(x for x, k in zip(w, keep) if k)
        want.append((i, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()))
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=str) == sorted(want, key=str)
    assert substring.remove_repeats(nothing).count() == 0


def test_simhash(docs, nothing):
    import xxhash
    fps = []
    for r in DOCS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        parts = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in parts]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    low = {g: min((DOCS[i][0] for i in range(len(fps)) if group[i] == g and DOCS[i][0] is not None), default=None) for g in group}
    want = sorted(((r[0], f"{f:016x}", low[g]) for r, f, g in zip(DOCS, fps, group)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_long_bucket_forest():
    draw = np.random.default_rng(3)
    base = int(draw.integers(1 << 63))
    fp = np.unique(np.array([base ^ (int(draw.integers(1 << 16)) << 48) ^ (1 << int(draw.integers(48))) * int(draw.integers(2)) for _ in range(400)], np.uint64))
    a, b = simhash._long_bucket(base & simhash.KEPT, fp)
    joined = simhash._forest([(a, b)])
    pairs = [(x, y) for i, x in enumerate(fp) for y in fp[i + 1:] if int(x ^ y).bit_count() <= 3]
    want = simhash._forest([tuple(np.array(p, np.uint64) for p in zip(*pairs))]) if pairs else joined
    assert set(zip(*map(list, joined))) == set(zip(*map(list, want)))


def test_contained(spark, docs, nothing):
    items = spark.createDataFrame([(1, PASSAGE), (2, "the cat sat on the mat and the"), (3, None), (4, "short"), (None, PASSAGE.upper()), (5, "not in any of them at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contained(docs, items).collect()}
    assert got == {(6, 1), (7, 1), (6, None), (7, None), (0, 2)}  # "short" is a word of no text
    left = decontam.remove_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(DOCS) - 3
    assert decontam.contained(nothing, items).count() == 0 and decontam.contained(docs, items.limit(0)).count() == 0


def test_token_files(docs, nothing):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path())
    for block in (tokens.BLOCK, 700):
        got = tokens.write_and_read(docs, tokenizer_path(), block=block, with_ids=True).orderBy("start").collect()
        at, want = 0, collections.Counter()
        for r in DOCS:
            want[r[0], np.array(lib.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
        for r in got:
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
            at += r.n_tokens
        assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
        assert [r.doc_id for r in got] == sorted((r[0] for r in DOCS), key=lambda i: -1 if i is None else i)
    assert tokens.write_and_read(nothing, tokenizer_path()).count() == 0


def test_rans_blocks():
    ids = np.random.default_rng(1).integers(0, 300, 300_000).astype(np.uint32) ** 2 // 300
    model = rans.Model(*np.unique(ids, return_counts=True))
    docs = np.zeros(3, rans.DOC)
    for n in (0, 1, 2047, 2048, 2049, len(ids)):
        block = rans.pack(model, docs, ids[:n])
        assert (rans.unpack(model, block)[1] == ids[:n]).all()
    with pytest.raises(ValueError):
        rans.unpack(model, block[:100] + bytes([block[100] ^ 1]) + block[101:])
    assert rans.crc32_combine(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_mixing(docs, nothing):
    rows = mixing.taken(docs).collect()
    goal, got = {}, collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
    documents, blocks = mixing.mix(docs, shards=3)
    got = collections.Counter(dict(blocks.join(documents, "row").groupBy("source").sum("words").collect()))
    goal = {r.source: r.target for r in documents.select("source", "target").distinct().collect()}
    assert all(abs(got[s] - t) <= 1 for s, t in goal.items()) and abs(sum(goal.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    per = [r["count"] for r in blocks.groupBy("shard").count().collect()]
    assert max(per) - min(per) <= 1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == blocks.count()
    assert sorted(map(tuple, mixing.taken(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.taken(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_split_keeps_quotas():
    got = mixing.split(np.array([1000, 0, 17, 4]), 7, 5)
    assert got.sum(0).tolist() == [1000, 0, 17, 4] and set(got.sum(1)) == {145, 146}


def test_language_id(docs, nothing):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (11, "und"), (8, "fr")} <= got
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 8, 9}
    assert langid.identify(nothing).count() == 0


def test_html(spark):
    site = [(i, f"http://h/{i}", f"<body><div>Welcome</div><p>story {i} &amp; text</p><div><span>Follow</span></div></body>") for i in range(8)]
    same = [(20 + i, f"http://k/{i}", "<div>kept</div><p>copy</p>") for i in range(8)]
    odd = [(40, None, None), (None, "x", "<p>q"), (41, "http://z/", "<article><header><h1>T</h1></header><p>a <b>b</b>c<br>d<div class='share'>s</div><section id=comments>no</section></article><footer>f</footer>"),
           (42, "http://z/", "<div>" * 3000 + "deep"), (43, "http://z/", "x <3 & <b")]
    df = spark.createDataFrame(site + same + odd, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got[3][0] == "story 3 & text" and got[21][0] == "kept\ncopy" and got[40] == ("", 0) and got[None][0] == "q"
    assert got[41][0] == "T\na bc d" and got[42][0] == "deep" and got[43][0] == "x <3 &"
    assert html.extract(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "u", "x" * 200), (2, None, "x" * 200), (2, "v", "x" * 200), (3, "é \r\n", None), (4, "u", ""), (5, "u", "y" * 99), (6, "u", "y" * 99), (None, "u", "x" * 200), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.write_and_read(df).collect()), key=str)
    text = [(i, (h or "").encode()) for i, _, h in rows]
    want = [(i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, p in text]
    assert got == sorted(want, key=str)
    assert warc.write_and_read(df.limit(0)).count() == 0
    assert warc.unchunked(warc.chunked(b"a" * 20000)) == b"a" * 20000


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((400, 6)).astype(np.float32)
    x[50:90] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 6), (1040, [float("nan")] * 6), (1060, [1.0]), (None, [1.0] * 6)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 400, 20):
        s = (x.astype(np.float64) * x[q].astype(np.float64)).sum(1)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(400), -s))[:20].tolist()) & set(got[q]))
    assert set(got) == set(range(0, 400, 20)) and hit >= 0.95 * 400
    assert got[60][:5] == [0, 50, 51, 52, 53]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 < r.p_quality < 1 and 0 <= r.p_toxic < 1 for r in got)
    assert quality.score(docs, labels.limit(0)).count() == len(DOCS) and quality.score(nothing, labels).count() == 0


def test_quality_held_out(spark):
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "gamma", "delta"], 30)) + (" vile nasty" if i % 5 == 0 else ""), "en", f"s{i % 3}") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600) if i % 2], "doc_id long, quality int, toxic int")
    got = quality.score(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert np.mean([(r.p_toxic >= 0.5) == (r.doc_id % 5 == 0) for r in got if r.doc_id % 2 == 0]) > 0.98
