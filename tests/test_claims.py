"""Claims across runs, rows without a key or clock, and a hot id's plan."""
from pyspark.sql import functions as F

from sluice.operators.dedup import claim_chain, open_claims
from test_scan_dedup import _fold, _skewed

H = 3600
SCHEMA = "event_id string, t long, i long, ok boolean"


def _mark(spark, rows, prior=None, small_max=256):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("clock", F.timestamp_seconds("t"))
    return claim_chain(df, "event_id", "clock", ["i"], F.col("ok"), 48 * H, prior=prior, small_group_max=small_max)


def test_two_runs_equal_one(spark):
    rows = sorted(_skewed(1200, seed=21), key=lambda r: (r[1], r[2]))
    want = _fold(rows, 48 * H, True)
    for cut in (1, 500, 1199):
        first = _mark(spark, rows[:cut])
        now = F.timestamp_seconds(F.lit(rows[cut][1]))
        prior = open_claims(first, now, tiebreak=["i"], ok=F.col("ok"))
        second = _mark(spark, rows[cut:], prior)
        got = {r.i: r.dedup_status for r in first.unionByName(second).collect()}
        assert got == want


def test_prior_claims_stay_open_over_an_idle_run(spark):
    first = _mark(spark, [("a", 0, 0, True), ("b", 0, 1, False)])
    prior = open_claims(first, F.timestamp_seconds(F.lit(H)), tiebreak=["i"], ok=F.col("ok"))
    idle = _mark(spark, [("c", 2 * H, 2, True)], prior)
    after = open_claims(idle, F.timestamp_seconds(F.lit(3 * H)), tiebreak=["i"], ok=F.col("ok"), prior=prior)
    assert {r.event_id for r in after.collect()} == {"a", "c"}
    ended = open_claims(idle, F.timestamp_seconds(F.lit(48 * H)), tiebreak=["i"], ok=F.col("ok"), prior=prior)
    assert {r.event_id for r in ended.collect()} == {"c"}


def test_null_key_or_clock_is_claimed_on_both_paths(spark):
    rows = [("a", None, 0, True), ("a", 1, 1, True), ("a", 2, 2, True), (None, 1, 3, True), (None, 1, 4, True)]
    for small in (256, 0):
        got = {r.i: r.dedup_status for r in _mark(spark, rows, small_max=small).collect()}
        assert got == {0: "claimed", 1: "claimed", 2: "duplicate", 3: "claimed", 4: "claimed"}


def test_row_long_before_a_prior_claim_is_claimed(spark):
    """Claim at hour 100 of the run before; then hours 0, 1 (in the window of 0), 60 (shares one with 100), 147 and 148."""
    prior = spark.createDataFrame([("a", 100 * H)], "event_id string, t long").select("event_id", F.timestamp_seconds("t").alias("claim_time"))
    rows = [("a", h * H, i, True) for i, h in enumerate((0, 1, 60, 147, 148))]
    got = {r.i: r.dedup_status for r in _mark(spark, rows, prior).collect()}
    assert got == {0: "claimed", 1: "duplicate", 2: "duplicate", 3: "duplicate", 4: "claimed"}


def test_join_with_lazy_prior_claims_is_split(spark, monkeypatch):
    """The plan of the join that reads ``prior``, for a lazy aggregate and an id with a third of the rows."""
    import sluice.operators.dedup as D
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    plans, write = {}, D.materialize

    def seen(df, name):
        if name == "claim-held":
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df.repartition(8) if name == "claim-base" else df, name)
    monkeypatch.setattr(D, "materialize", seen)
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = [("hot" if i % 3 else f"e{i}", i, i, True) for i in range(6000)]
        first = spark.createDataFrame(rows[::3], SCHEMA).groupBy("event_id").agg(F.timestamp_seconds(F.max("t")).alias("claim_time"))
        _mark(spark, rows, first)
        assert "skew=true" in plans["claim-held"]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
