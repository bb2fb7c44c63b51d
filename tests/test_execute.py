"""Python handlers on claimed rows only: calls and outcomes as told row by row."""
import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import handlers as H
from sluice.operators import route as R
from sluice.operators.execute import run_claimed
from sluice.plans import triage as TR
from test_stream_claims import H as HOUR, skewed


def told(rows, ttl, prior):
    claim, out, calls = dict(prior), {}, []
    for k, t, i, ok in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        if t is not None and k in claim and abs(t - claim[k]) < ttl:
            out[i] = ("duplicate", None)
            continue
        calls.append(i)
        out[i] = ("claimed", None if ok else "panic: no")
        if ok and t is not None:
            claim[k] = t
    return out, sorted(calls)


@pytest.mark.parametrize("seed, prior", [(1, {}), (2, {"e0": 300 * HOUR, "e3": 10 * HOUR, "gone": 0})])
def test_calls_are_those_of_a_worker(spark, tmp_path, seed, prior):
    """One id has a third of the rows, over several slices; each id's rows in order; no call for a duplicate."""
    rows = skewed(700, seed)
    seen = str(tmp_path / "calls")

    def handle(row):
        with open(seen, "a") as f:
            f.write(f"{row['i']}\n")
        if not row["ok"]:
            raise RuntimeError("no")
    df = spark.createDataFrame([(k, t, i, ok, "x", 0, i) for k, t, i, ok in rows], "event_id string, t long, i long, ok boolean, topic string, partition int, offset long") \
        .withColumns({"clock": F.timestamp_seconds("t"), "routed": F.lit(True), "processor": F.lit("P"), "error_class": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    before = spark.createDataFrame(list(prior.items()), "event_id string, t long").select("event_id", F.timestamp_seconds("t").alias("claim_time")) if prior else None
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run_claimed(df, {"P": handle}, ["i", "ok"], prior=before).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, calls = told(rows, 48 * HOUR, prior)
    assert {r.i: (r.dedup_status, r.error) for r in got} == want
    assert sorted(map(int, open(seen).read().split())) == calls


def test_triage_with_a_python_handler_equals_the_native_one(spark):
    from sluice.plans import queries as Q
    raw = Q._messages(spark, "/root/testdata/sf0.001")

    def visit(row):
        if row["fault"] == "panic":
            raise RuntimeError("simulated handler panic")
        if row["fault"] == "error":
            raise ValueError("x")
    hs = dict(H.DEFAULT_HANDLERS)
    reg, tops = R.registry_frame(spark), R.topics_frame(spark)
    hs["NOTIFICATION_TRIGGERED"] = H.Handler("NOTIFICATION_TRIGGERED", H.python_handler(visit, ["fault"]))
    got = TR.run_triage(raw, reg, tops, handlers=hs)
    t = TR.run_triage(raw, reg, tops, fault_col="fault")
    # the Python one does not read the payload: compare where the payload is no cause
    same = t.where("processor = 'NOTIFICATION_TRIGGERED' AND coalesce(error_class, '') <> 'business_validation'").select("topic", "partition", "offset", "event_id")
    clean = same.join(t.where("error_class = 'business_validation'").select("event_id").distinct(), "event_id", "left_anti")
    cols = ["topic", "partition", "offset", "outcome"]
    pick = lambda df: collections.Counter(map(tuple, df.join(clean.drop("event_id"), ["topic", "partition", "offset"]).select(*cols).collect()))
    assert pick(got) == pick(t) and sum(pick(t).values()) > 100
    assert got.count() == t.count() and set(got.columns) >= {"dedup_status", "error", "error_class"}


def test_every_row_runs_without_dedup(spark):
    df = spark.createDataFrame([("a", 0, i, "x", 0, i) for i in range(4)], "event_id string, t long, i long, topic string, partition int, offset long") \
        .withColumns({"clock": F.timestamp_seconds("t"), "routed": F.lit(True), "processor": F.lit("P"), "error_class": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})

    def handle(row):
        raise H.BusinessError("bad")
    assert [(r.dedup_status, r.error_class) for r in run_claimed(df, {"P": handle}, [], dedup=False).collect()] == [("claimed", "business_validation")] * 4
    assert run_claimed(df.limit(0), {"P": handle}, ["i"]).count() == 0
