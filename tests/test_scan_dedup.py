"""Skew-safe rank and the claim fold against brute force, with one key holding a third of the rows."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.operators.dedup import claim_chain
from sluice.operators.scan import rank_within


def _skewed(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{rnd.randrange(200)}"
        rows.append((k, rnd.randrange(0, 20 * 24 * 3600), i, rnd.random() < 0.8))
    return rows


def test_rank_within_matches_row_number(spark):
    df = spark.createDataFrame(_skewed(), "k string, t long, i long, ok boolean").repartition(7)
    got = rank_within(df, ["k"], ["t", "i"], out="rn")
    w = Window.partitionBy("k").orderBy("t", "i")
    want = df.withColumn("rn2", F.row_number().over(w))
    bad = got.join(want, ["k", "t", "i"]).where("rn != rn2").count()
    assert bad == 0 and got.count() == df.count()


def test_weighted_running_sum(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("b", 1, 1), ("a", 4, 1)],
                               "k string, t long, w int")
    got = {(r["k"], r["t"]): r["c"] for r in rank_within(df, ["k"], ["t"], out="c", weight="w").collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("a", 4): 3, ("b", 1): 1}


def _fold(rows, ttl_s, release):
    by = {}
    for k, t, i, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(k, []).append((t, i, ok))
    out = {}
    for k, evs in by.items():
        claim = None
        for t, i, ok in evs:
            if claim is not None and t < claim + ttl_s:
                out[i] = "duplicate"
            else:
                out[i] = "claimed"
                claim = t if (ok or not release) else None
    return out


def _run(spark, rows, ttl_s, release, small_max=256):
    df = spark.createDataFrame(rows, "k string, t long, i long, ok boolean").withColumn(
        "clock", F.timestamp_seconds("t"))
    res = claim_chain(df, "k", "clock", ["i"], F.col("ok") if release else None, ttl_s,
                      small_group_max=small_max)
    return {r["i"]: r["dedup_status"] for r in res.collect()}


def test_claim_fold_matches_sequential(spark):
    rows = _skewed(1500)  # the hot key (500 rows) takes the pointer-doubling path, the rest the small fold
    for release in (False, True):
        assert _run(spark, rows, 48 * 3600, release) == _fold(rows, 48 * 3600, release)


def test_both_fold_paths_agree(spark):
    rows = _skewed(600, seed=11)
    want = _fold(rows, 48 * 3600, True)
    assert _run(spark, rows, 48 * 3600, True, small_max=0) == want      # everything by pointer doubling
    assert _run(spark, rows, 48 * 3600, True, small_max=10**6) == want  # everything by the bounded fold


def test_fixed_window_not_sliding(spark):
    h = 3600
    rows = [("e", x * h, x, True) for x in (0, 47, 49, 96, 97)]
    got = _run(spark, rows, 48 * h, False)
    assert [i for i in sorted(got) if got[i] == "claimed"] == [0, 49, 97]


def test_failure_releases_claim(spark):
    h = 3600
    rows = [("e", 0, 0, False), ("e", 1 * h, 1, True), ("e", 2 * h, 2, True)]
    got = _run(spark, rows, 48 * h, True)
    assert got == {0: "claimed", 1: "claimed", 2: "duplicate"}


def test_partition_count_does_not_change_result(spark):
    rows = _skewed(900, seed=3)
    a = _run(spark, rows, 48 * 3600, True)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = _run(spark, rows, 48 * 3600, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b
