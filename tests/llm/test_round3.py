"""Divergence audit, exact top-k and dataset manifest against brute force on tables with nulls, long texts, ties, repeats and clashing columns."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import divergence, manifest, voronoi

LONG = " ".join(f"w{i % 97} und Straße" for i in range(5000))
DOCS = [(0, "The cat sat on the mat", "en", "a", 22), (1, None, "en", "a", None), (2, "", None, "b", 0), (3, "the CAT", "fr", None, 7), (4, LONG, "en", "b", len(LONG)), (4, LONG, "en", "b", len(LONG)),
        (None, "no id, the cat", "en", "a", 5), (None, None, None, None, None), (5, "ÀÉ é ñ x12y the", "en", "c", 15), (5, "another the text", "en", "c", 16), (6, "le chat LE Chat", "fr", "b", 15), (7, "?!", "de", "b", 2)] \
    + [(100 + i, f"the Cat {i} déjà " + "mat " * (i % 4), "en", "ab"[i % 2], i) for i in range(150)] + [(500 + i, "Le chat noir", "", "b", 12) for i in range(9)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    for c in ("g", "id", "node", "own", "m", "block", "at", "part", "term", "n", "item", "value", "kept", "z"):
        df = df.withColumn(c, F.lit(1))
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute_audit(table, min_docs, top):
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")), r[2] or "", r[3] or "") for r in table]
    out = []
    for lang in {w[1] for w in words}:
        mine = [w for w in words if w[1] == lang]
        df = collections.Counter(t for w in mine for t in set(w[0]))
        kept = [t for t in df if df[t] >= min_docs]

        def shares(some):
            n = collections.Counter(t for w in some for t in w[0])
            whole = sum(n[t] for t in kept)
            return n, {t: 1 + 10 ** 9 * (n[t] + 2) // (whole + 2 * len(kept)) for t in kept}
        _, q = shares(mine)
        groups = {s: shares([w for w in mine if w[2] == s]) for s in {w[2] for w in mine}}

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s, (n, p) in groups.items():
            pair = sorted(((o, sum(f(p[t], groups[o][1][t]) for t in kept)) for o in groups if o != s), key=lambda x: (-x[1], x[0].encode()))
            term = sorted(((t, f(p[t], q[t])) for t in kept if n[t] > 0 and p[t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out += [(lang, s, part, item, value, i + 1) for part, ranked in (("pair", pair), ("term", term)) for i, (item, value) in enumerate(ranked)]
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs, top", [(10, 10), (1, 3)])
def test_divergence(docs, min_docs, top):
    assert rows(divergence.audit(docs, min_docs=min_docs, top=top)) == brute_audit(DOCS, min_docs, top)


def test_divergence_many_ties(spark):
    table = [(i, " ".join(f"{chr(97 + i % 7)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(300)), "en", "s" + str(i % 7), 0) for i in range(70)]
    assert rows(divergence.audit(spark.createDataFrame(table, SCHEMA))) == brute_audit(table, 10, 10)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_term_counts_flush(monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", 3)
    batch = pa.record_batch({"lang": ["x"] * 3, "source": ["s"] * 3, "text": ["A b c", "a d e a", None]})
    got = collections.Counter()
    for b in divergence.term_counts([batch]):
        for r in b.to_pylist():
            got[r["term"]] += np.array([r["n"], r["docs"]])
    assert {t: tuple(x) for t, x in got.items()} == {None: (0, 0), "a": (3, 2), "b": (1, 1), "c": (1, 1), "d": (1, 1), "e": (1, 1)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(table):
    def leaf(r, text):
        return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))

    def proofs(nodes):
        """Root and each node's steps (before, after)."""
        at, steps = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // 8 * 8: p // 8 * 8 + 8]
                steps[i].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
            nodes, at = [sha(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
        return nodes[0], steps
    groups = collections.defaultdict(list)
    for r in table:
        groups[r[2]].append((leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    done = {g: proofs([x[0] for x in groups[g]]) for g in order}
    root, above = proofs([done[g][0] for g in order])
    out = []
    for g, up in zip(order, above):
        for (node, r), steps in zip(groups[g], done[g][1]):
            steps, h = steps + up, node
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                h = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for a, b in steps:
                h = sha(a, h, b)
            out.append((r[0], node, done[g][0], root, sha(*(x for s in steps for x in s)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest(docs, levels):
    assert rows(manifest.audit(docs, levels=levels)) == brute_manifest(DOCS)


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65, 600])
def test_manifest_sizes(spark, count):
    table = [(i * 7 % 1000, f"Text {i}", None if count == 9 else "en", "s", i) for i in range(count)]
    assert rows(manifest.audit(spark.createDataFrame(table, SCHEMA))) == brute_manifest(table)


def test_manifest_many_groups_and_none(spark, docs):
    table = [(i, f"T{i}", f"l{i % 70}", "s", i) for i in range(140)]
    assert rows(manifest.audit(spark.createDataFrame(table, SCHEMA), levels=1)) == brute_manifest(table)
    assert manifest.audit(docs.limit(0)).count() == 0


def brute_top(table, k):
    ok = {(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v in table if i is not None and v is not None and None not in v and all(np.isfinite(v))}
    length = collections.Counter(len(v) for _, v in ok)
    size = min(length, key=lambda n: (-length[n], n))
    ok = [x for x in ok if len(x[1]) == size]
    out = []
    for i, v in ok:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if (j, w) != (i, v))[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"queries": 3, "shard": 20, "pivots": 9}, {"k": 500}])
def test_top_k(spark, options):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((300, 5)) * draw.choice([0.1, 1, 30], (300, 1))
    x[40:110] = x[0]
    x[200:204] = 0
    table = [(i, [float(y) for y in v]) for i, v in enumerate(x.astype(np.float32))] + [(20, [1.0] * 5), (20, [1.0] * 5), (60, x[1].astype(np.float32).astype(float).tolist())]
    table += [(1000, None), (1020, [None] * 5), (1040, [float("nan")] * 5), (1060, [1.0]), (None, [1.0] * 5), (1080, []), (1100, [float("inf")] * 5), (-20, [0.5] * 5)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS c", "3 AS cell", "4 AS away", "5 AS v")
    assert rows(voronoi.top_k(df, **options)) == brute_top(table, options.get("k", 20))
    assert voronoi.top_k(df.limit(0)).count() == 0


def test_top_k_large_values(spark):
    draw = np.random.default_rng(5)
    table = [(i, [float(y) for y in v]) for i, v in enumerate(draw.integers(-(1 << 24), 1 << 24, (60, 3)))]
    assert rows(voronoi.top_k(spark.createDataFrame(table, "vec_id long, embedding array<double>"), k=5)) == brute_top(table, 5)
    with pytest.raises(ArithmeticError):
        voronoi.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"))


def test_bounds_exclude_far_cells(spark):
    """Ten far clusters: a query's group gets its own cluster only, and all of its nearest are among what it gets."""
    draw = np.random.default_rng(6)
    x = np.floor(64 * (np.repeat(draw.standard_normal((10, 4)) * 40, 60, 0) + draw.standard_normal((600, 4))))
    x *= 10000 / np.sqrt((x * x).sum(1))[:, None]
    x = np.floor(x)
    space = voronoi.Space(int((x * x).sum(1).max()), x[::25])

    def table(v, query):
        away = space.away(v, query)
        cell = away.argmin(1)
        return spark.createDataFrame([(i, int(c), float(a[c])) for i, (c, a) in enumerate(zip(cell, away))], "c long, cell int, away double"), cell, away
    placed, cell, away = table(x, False)
    wanted, home, _ = table(x[::20], True)
    routes, groups, _, _ = voronoi._plan(placed, wanted, space, 6, 1, 100)
    group = dict(zip(groups.column("cell").to_pylist(), groups.column("group").to_pylist()))
    sent = collections.defaultdict(set)
    for r in routes.to_pylist():
        sent[r["group"]] |= {i for i in range(600) if cell[i] == r["cell"] and r["low"] <= away[i, cell[i]] <= r["high"]}
    for q in range(30):
        best = np.argsort(-(x @ x[20 * q]), kind="stable")[:6]
        assert set(best.tolist()) <= sent[group[home[q]]]
    assert np.mean([len(s) for s in sent.values()]) < 200


def test_neighbours_over_many_cells(spark):
    """Recall against brute force with cells of 300 vectors, and the share verified falls as vectors grow in number."""
    from sluice.llm import neighbours
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((12, 24))
    x = (centres[draw.integers(12, size=3000)] + 0.5 * draw.standard_normal((3000, 24))).astype(np.float32)
    rows_ = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows_, "vec_id long, embedding array<float>"), cell_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit, x = 0, x.astype(np.float64)
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(1)
        assert all(abs(s[i] - score) < 1e-9 for i, score in got[q]) and q not in dict(got[q]) and len(got[q]) == 20
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & set(dict(got[q])))
    assert set(got) == set(range(0, 3000, 20)) and hit >= 0.9 * 3000
    limit, shares = neighbours.chi_square_quantile(neighbours.CONFIDENCE, neighbours.DIMENSIONS), []
    for n in (300, 3000):
        part = x[:n]
        projection = neighbours.Projection(24, float(np.sqrt((part * part).sum(1).max())), 11)
        seen = [r[3] for r in neighbours.search_cell(projection, np.arange(n), part, np.arange(0, 300, 20), part[:300:20], np.full(15, np.inf), 20, limit)]
        shares.append(np.mean(seen) / n)
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.5


def test_short_items_and_unspaced_scripts(spark):
    """Items of one to four words stand in a row; a character of a script without spaces is a word; rows of one id apart; the SQL agrees."""
    import duckdb

    from sluice.llm import decontam
    docs_ = [(1, "say Hello, wide World now"), (2, "hello there wide world"), (3, "今日は良い天気です、そうですね"), (4, "今日は悪い天気です"), (5, None), (6, "one two three four"), (6, "four five six seven eight nine ten"),
             (7, "x " * 30000 + "alpha beta gamma delta epsilon zeta"), (None, "hello wide world"), (8, "hello")]
    items = [(1, "hello wide world"), (2, "Hello"), (3, "良い天気です"), (4, "three four five six seven"), (5, "two three"), (6, ""), (7, None), (8, "alpha beta gamma delta epsilon zeta"), (9, "天気"), (1, "nine ten")]
    df, it = spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.contained(df, it).select("doc_id", "item_id", "n_shared", "n_shingles", "containment").collect()), key=str)
    assert {(r[0], r[1]) for r in got} == {(1, 1), (None, 1), (1, 2), (2, 2), (8, 2), (None, 2), (3, 3), (6, 5), (7, 8), (3, 9), (4, 9), (6, 1)}
    con = duckdb.connect()
    for name, x in (("documents", df), ("benchmark", it)):
        con.register(name, x.toArrow())
    assert got == sorted(con.sql(f"SELECT doc_id, item_id, n_shared, n_shingles, containment FROM ({decontam.ORACLE})").fetchall(), key=str)
    left = decontam.remove_contaminated(df, it)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([docs_[4]], key=str)


def test_hypergeometric_beyond_numpy_is_the_same_distribution():
    """Log factorials to 35 digits; draws of the large path against exact probabilities on a small urn, and moments on a large one."""
    import math
    from decimal import Decimal, localcontext

    from sluice.llm import mixing
    with localcontext() as c:
        c.prec = 50
        for n in (0, 1, 5, 63, 64, 65, 200, 2000):
            assert abs(mixing._log_factorial(n) - Decimal(math.factorial(n)).ln()) < Decimal(10) ** -32
    draw = np.random.Generator(np.random.PCG64(1))
    for good, bad, n in ((12, 30, 10), (500, 700, 400)):
        got = collections.Counter(mixing._large_hypergeometric(draw, good, bad, n) for _ in range(4000))
        chi, kinds = 0.0, 0
        for k in range(max(0, n - bad), min(n, good) + 1):
            want = 4000 * math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            if want >= 5:
                chi, kinds = chi + (got[k] - want) ** 2 / want, kinds + 1
        assert chi < kinds + 4 * math.sqrt(2 * kinds)
    good, bad, n = 3 * 10 ** 12, 10 ** 13, 4 * 10 ** 12
    many = np.array([mixing._hypergeometric(draw, good, bad, n) for _ in range(300)], dtype=float)
    mean, m = n * good / (good + bad), good + bad
    spread = math.sqrt(mean * bad / m * (m - n) / (m - 1))
    assert abs(many.mean() - mean) < 4 * spread / math.sqrt(300) and 0.85 < many.std() / spread < 1.15
    assert mixing._hypergeometric(draw, 10 ** 12, 0, 7) == 7 and mixing._hypergeometric(draw, 10 ** 12, 5, 10 ** 12 + 5) == 10 ** 12
    split = mixing.split(np.array([2 * 10 ** 9, 0, 10 ** 9 + 1]), 3, 4)
    assert split.sum(0).tolist() == [2 * 10 ** 9, 0, 10 ** 9 + 1] and max(split.sum(1)) - min(split.sum(1)) <= 1


def test_warc_files_are_bounded(spark, tmp_path, monkeypatch):
    """Files of short and of long records, none larger than the bound allows; all pages read back."""
    import glob
    import os

    from sluice.llm import warc
    monkeypatch.setattr(warc, "FILE_BYTES", 40000)
    monkeypatch.setattr(warc, "SHORT", 4000)
    pages = [(i, f"u{i}", f"{i} " * (100 if i % 5 else 4000)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.write_and_read(df, segment=6000).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in pages}
    warc.write(df, str(tmp_path / "a"), segment=6000)
    files = glob.glob(str(tmp_path / "a" / "*" / "part-*"))
    assert len(files) > 8 and max(map(os.path.getsize, files)) <= 44000


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    from sluice.llm import tables
    spark.range(20000).selectExpr("id", "uuid() AS x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.partitions(spark, df) == n and tables.input_bytes(df) > 100_000
    monkeypatch.setattr(tables, "PART_BYTES", 10_000)
    assert tables.partitions(spark, df) == -(-tables.input_bytes(df) // 10_000) > n and tables.partitions(spark) == n
