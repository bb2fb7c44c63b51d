"""Substring dedup where one row is a third of the table and parts outnumber the session's partitions, against plain Python."""
import collections
import hashlib
import random

from sluice.llm import substring


def brute(rows, window=35):
    each = [(i, (t or "").encode().split()) for i, t in rows]
    count, out = collections.Counter(), []
    for _, w in each:
        count.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    for i, w in each:
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j:j + window])] > 1:
                keep[j:j + window] = [False] * window
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, k in zip(w, keep) if k)).hexdigest()))
    return sorted(out, key=str)


def made(seed=4):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(draw.randrange(5, 90))] + (passage[: draw.randrange(30, 60)] if i % 3 else []))) for i in range(60)]
    hot = " ".join(word() for _ in range(50))
    short = "three short words"
    rows += [(77, hot)] * 41 + [(78, short)] * 23 + [(None, None)] * 9 + [(None, "")] * 3 + [(5, rows[5][1])] + [(901, hot + " tail")]
    once = " ".join(passage[:20] * 4)  # repeats inside one text
    rows += [(902, once)]
    draw.shuffle(rows)
    return rows


def test_equal_rows_and_many_parts(spark, tmp_path, monkeypatch):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=str) == brute(rows)
    monkeypatch.setattr(substring, "PART_BYTES", 500)
    monkeypatch.setattr(substring, "COPIES", 7)
    got = substring.remove_repeats(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_the_exchange_of_texts_is_reused(spark, tmp_path):
    """Texts are shuffled once: the count inside a part needs no exchange of its own."""
    spark.createDataFrame(made(), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    plan = substring.remove_repeats(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(part#0, id" not in plan
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert not any(", id#" in x for x in exchanges)
