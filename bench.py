"""Benchmark: headline triage operators over the message log derived from ``events``.

Prints one JSON line. Environment: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8). The raw log is built from ``events`` once and written as
parquet (the shape of a topic dump); every timed query then reads that log, so
the timings are what a job reading raw records pays.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import functions as F

    from sluice.operators import dedup as D
    from sluice.operators import metrics as M
    from sluice.operators import progress as PR
    from sluice.operators import retry as RT
    from sluice.operators import route as R
    from sluice.operators.parse import parse_retry_envelope
    from sluice.plans import triage as TR
    from sluice.session import checkpoint_dir, get_spark
    from sluice.sources.fixtures import fixture_messages, retry_log

    spark = get_spark(f"local[{cpus}]", app="sluice-bench", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": "16g"})
    scratch = os.path.join(checkpoint_dir(spark), f"bench-{int(time.time())}")
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    raw_path = os.path.join(scratch, "raw")
    timed("build_log", lambda: fixture_messages(spark, sf_dir).write.parquet(raw_path))
    raw = spark.read.parquet(raw_path)
    n = raw.count()
    reg, tops = R.registry_frame(spark), R.topics_frame(spark)

    tri_path = os.path.join(scratch, "triaged")
    timed("run_triage", lambda: TR.run_triage(raw, reg, tops, fault_col="fault")
          .drop("data").write.parquet(tri_path))
    tri = spark.read.parquet(tri_path)

    prep_path = os.path.join(scratch, "prepared")
    timed("prepare", lambda: TR.prepare(raw, reg, tops, fault_col="fault").drop("data", "value")
                                 .write.parquet(prep_path))
    prep = spark.read.parquet(prep_path)
    timed("dedup_claims", lambda: sink(D.dedup_claims(prep, clock="clock", where=F.col("routed"))))

    rl_path = os.path.join(scratch, "retry_log")
    timed("retry_log", lambda: retry_log(tri, raw).write.parquet(rl_path))
    rlog = spark.read.parquet(rl_path)
    timed("due_retries", lambda: RT.due_retries(
        RT.schedule_retries(parse_retry_envelope(rlog)), F.lit("2024-01-16 00:00:00").cast("timestamp"))
        .collect())

    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    done_at = F.timestamp_micros(F.unix_micros("timestamp") + (F.col("duration_s") * 60_000_000).cast("bigint"))
    prog = raw.where(F.col("timestamp") <= as_of).select("topic", "partition", "offset",
                                                         (done_at <= as_of).alias("completed"))
    timed("committable_offsets", lambda: PR.committable_offsets(prog).collect())
    timed("metrics", lambda: [sink(f(tri)) for f in (M.messages_received, M.messages_processed,
                                                      M.messages_failed, M.processing_duration, M.lane_load)])
    # run_triage is the whole chain; prepare and dedup_claims are its two halves timed alone
    headline = ["run_triage", "prepare", "dedup_claims", "due_retries", "committable_offsets", "metrics"]
    total = round(sum(times[k] for k in headline), 3)
    print(json.dumps({"metric": "triage_headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "rows": n,
                      "run_triage_rows_per_s": round(n / times["run_triage"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
