"""The pipeline: every stage on what its predecessor kept, against plain Python; nulls, repeats, clashing names, empty tables; the whole run."""
import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as CP
from sluice.llm.queries import tokenizer_path

EN = "the cat and dog of a house ran to that old river with many red birds while rain fell on green hills".split()
FR = "le chat et chien de une maison sont dans la vieille rivière avec des oiseaux rouges pendant que tombe".split()
ITEM = "what is the name of the old red river that ran to the green hills"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    draw = np.random.default_rng(9)
    rows = []
    for i in range(70):
        ws, lang = ((EN, "en"), (FR, "fr"))[i % 2]
        rows.append((i, " ".join(draw.choice(ws, int(draw.integers(8, 60)))), lang, f"s{i % 3}" if i % 11 else None))
    rows += [(100 + k, rows[4][1], "en", "s1") for k in range(4)]                                # copies
    rows += [(110, rows[6][1].upper(), "en", "s0"), (110, rows[6][1].upper(), "en", "s0")]       # equal but for case, and one row twice
    rows += [(120 + k, f"{rows[8 + 2 * k][1]} {ITEM} {rows[20 + 2 * k][1]}", "en", "s2") for k in range(3)]
    rows += [(130, None, "en", "s0"), (131, "", None, None), (132, "12 34 !!", "en", "s1"), (133, "x9$kQ zz#7 pL!! 0qW vv%% " * 8, None, "s0"), (None, rows[10][1] + " cat", "en", "s2"),
             (134, " ".join(draw.choice(EN, 6000)), "en", "s1")]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame(texts(), COLUMNS).select("*", *[F.lit(1).alias(c) for c in ("id", "row", "size", "identified", "block_", "mix_row", "key_id", "fp", "order")])
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "zz top never")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    h = [xxhash.xxh64(b" ".join(w[i:i + 3]), seed=42).intdigest() for i in range(len(w) - 2)] or ([xxhash.xxh64(b" ".join(w), seed=42).intdigest()] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_every_stage(spark, folder):
    from tokenizers import Tokenizer
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in CP.STAGES:
        out = stage(spark, docs, folder)
        if name != "token_output":
            assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append([r.asDict() for r in docs.collect()])
    assert [n for n, _ in CP.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    named, one, clean, mix, tokens = kept
    # language: nothing without a letter or in no learned language, all else
    assert collections.Counter((r["doc_id"], r["text"]) for r in named) == collections.Counter((r[0], r[1]) for r in texts() if r[0] not in (130, 131, 132, 133))
    # near-dedup: one document of each group of linked fingerprints
    fps = [fingerprint(r["text"]) for r in named]
    group = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    have = collections.defaultdict(set)
    for r, g in zip(named, group):
        have[g].add((r["doc_id"], r["text"]))
    assert len(one) == len(have) and all(sum((r["doc_id"], r["text"]) in members for r in one) == 1 for members in have.values())

    # decontamination: texts that hold four fifths of the item's runs of five words
    def runs(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    need = runs(ITEM)
    assert sorted((str(r["doc_id"]), r["text"]) for r in clean) == sorted((str(r["doc_id"]), r["text"]) for r in one if len(need & runs(r["text"])) < 0.8 * len(need))
    assert not {120, 121, 122} & {r["doc_id"] for r in clean}
    # mixing: words of each source near its target, each row a text or its first words
    size = collections.Counter()
    for r in clean:
        size[r["source"]] += len(r["text"].split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, goal, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), {}
    free = set(order)
    while free:
        left, total = goal - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * size[s] + 1e-9}
        target.update({s: 2.0 * size[s] for s in over} if over else {s: left * weight[s] / total for s in free})
        free = free - over if over else set()
    taken, source = collections.Counter(), {(r["doc_id"], r["source"]): r["text"].split() for r in clean}
    for r in mix:
        w = r["text"].split()
        taken[r["source"]] += len(w)
        assert source[r["doc_id"], r["source"]][:len(w)] == w and r["n_chars"] == len(r["text"])
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    # tokens: the library's ids of the mixed texts, one after the other
    import zlib
    lib = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in mix:
        ids = np.array(lib.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == want
    at = 0
    for r in sorted(tokens, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    # the whole run gives the same rows
    assert sorted(map(str, (r.asDict() for r in CP.run(spark, folder).collect()))) == sorted(map(str, tokens))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert CP.run(spark, str(tmp_path)).count() == 0


def test_benchmarks_without_items_remove_nothing(spark, tmp_path):
    docs = spark.createDataFrame([r for r in texts() if r[1]], COLUMNS)
    for name, items in (("none", []), ("blank", [(1, None), (2, ""), (3, " \t ")])):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        kept = CP.benchmark_decontamination(spark, docs, f"{tmp_path}/{name}")
        assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(map(tuple, docs.collect()))
