"""Python handlers run on claimed rows only, as a worker that claims an id before it runs.

Whether a row is a duplicate depends on how earlier rows of its id ended, so rows of one id run one after the other.
They are sorted by (id, time, position) over range partitions and written; a partition's rows of one id are a
slice. A round runs the first open slice of every id, each slice in order inside one task, from the claim that the rounds before
left. Slices that lie within that claim's window are duplicates without a call. Nearly all ids have one slice, so
the first round is nearly all work; an id with a third of all rows takes a round for each of its slices that needs a call, and
no task ever more than one slice of it.

Each round's results are written before the next begins: a lost executor repeats the calls of its unfinished tasks, no others.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import constants as K
from sluice.operators import handlers as H
from sluice.operators.dedup import CLAIMED, DUPLICATE
from sluice.session import discard, materialize

POSITION = ("topic", "partition", "offset")
RESULT = "dedup_status string, error_class string, error string"


def _runner(functions: Mapping[str, Callable[[dict], None]], columns: Sequence[str], ids: Sequence[str], ttl_us: int):
    """Rows of whole slices, sorted: the fold with the calls in it."""
    def call(name, row):
        try:
            functions[name](row)
        except H.BusinessError as e:
            return K.EC_BUSINESS, K.BUSINESS + str(e)
        except Exception as e:  # noqa: BLE001 -- a row's failure is the row's
            return K.EC_PANIC, K.PANIC + str(e)
        return None, None

    def run(batches):
        last, claim = object(), None
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("_k", "_t", "_claim", "_name", "_class", "_error")}
            args = b.select(list(columns)).to_pylist() if columns else [{}] * b.num_rows
            status, classes, errors = [], [], []
            for i, (k, t) in enumerate(zip(c["_k"], c["_t"])):
                if k is None or t is None:
                    last, claim = object(), None
                elif k != last:
                    last, claim = k, c["_claim"][i]
                if claim is not None and abs(t - claim) < ttl_us:
                    status.append(DUPLICATE)
                    classes.append(None)
                    errors.append(None)
                    continue
                kind, error = call(c["_name"][i], args[i]) if c["_name"][i] in functions else (c["_class"][i], c["_error"][i])
                status.append(CLAIMED)
                classes.append(kind)
                errors.append(error)
                if error is None and k is not None and t is not None:
                    claim = t
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in (*ids, "_k", "_t")], *[pa.array(x, pa.string()) for x in (status, classes, errors)]],
                                             names=[*ids, "_k", "_t", "dedup_status", "error_class", "error"])
    return run


def run_claimed(prepared: DataFrame, functions: Mapping[str, Callable[[dict], None]], columns: Sequence[str], where: str = "routed",
                clock: str = "clock", key: str = "event_id", ids: Sequence[str] = POSITION, ttl_s: int = K.DEDUP_TTL_S,
                prior: DataFrame | None = None, dedup: bool = True) -> DataFrame:
    """``prepared`` with dedup_status, error_class and error of every row that passes ``where``.

    ``functions`` maps a processor to its Python handler, called with a dict of ``columns``; rows of other processors keep the
    error columns they have. Duplicates have no error. ``prior`` is as in ``claim_chain``. Without ``dedup`` every row runs.
    """
    ttl_us, order = ttl_s * 1_000_000, ["_k", "_t", *ids]
    wanted = list(dict.fromkeys(c for c in columns if c not in ids))
    rows = prepared.where(where).select(*ids, *wanted, F.col(key).alias("_k"), F.unix_micros(clock).alias("_t"), F.col("processor").alias("_name"),
                                        F.col("error_class").alias("_class"), F.col("error").alias("_error"))
    types = dict(rows.dtypes)
    out = ", ".join(f"`{n}` {types[n]}" for n in (*ids, "_k", "_t")) + ", " + RESULT
    run = _runner(dict(functions), list(columns), list(ids), ttl_us)
    alone = F.col("_k").isNull() | F.col("_t").isNull() | F.lit(not dedup)
    sorted_rows = rows.where(~alone).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_slice", F.spark_partition_id())
    base = materialize(sorted_rows, "run-rows")
    none = F.lit(None).cast("bigint")
    free = rows.where(alone).withColumns({"_claim": none, "_k": F.lit(None).cast("string")})
    done = [materialize(free.mapInArrow(run, out), "run-free")]
    slices = materialize(base.groupBy("_k", "_slice").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to")), "run-slices")
    temp = [base, slices]
    claims = materialize(prior.select(F.col("event_id").alias("_k"), F.unix_micros("claim_time").alias("_claim")) if prior is not None
                         else base.limit(0).select("_k", none.alias("_claim")), "run-claims")
    while True:
        temp.append(claims)
        open_ = slices.join(claims, "_k", "left")
        within = F.col("_claim").isNotNull() & (F.col("_to") < F.col("_claim") + ttl_us) & (F.col("_from") > F.col("_claim") - ttl_us)
        # slices inside a window hold nothing to run; of the others each id's first
        quiet = materialize(open_.where(within).select("_k", "_slice"), "run-quiet")
        first = materialize(open_.where(~within).groupBy("_k", "_claim").agg(F.min("_slice").alias("_slice")), "run-first")
        temp += [quiet, first]
        still = base.join(quiet, ["_k", "_slice"]).select(*ids, "_k", "_t", F.lit(DUPLICATE).alias("dedup_status"),
                                                          F.lit(None).cast("string").alias("error_class"), F.lit(None).cast("string").alias("error"))
        ran = base.join(first, ["_k", "_slice"]).repartition("_k", "_slice").sortWithinPartitions(*order).mapInArrow(run, out)
        ran = materialize(ran, "run-round")
        done += [ran, materialize(still, "run-still")]
        gone = quiet.unionByName(first.select("_k", "_slice"))
        left = materialize(slices.join(gone, ["_k", "_slice"], "left_anti"), "run-slices")
        temp.append(left)
        if not left.limit(1).collect():
            break
        made = ran.where((F.col("dedup_status") == CLAIMED) & F.col("error").isNull()).groupBy("_k").agg(F.max("_t").alias("_new"))
        claims = materialize(claims.join(made, "_k", "full").select("_k", F.coalesce("_new", "_claim").alias("_claim")), "run-claims")
        slices = left
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    result = materialize(result.drop("_k", "_t"), "run-results")
    discard(*temp, *done)
    return prepared.drop("error_class", "error").join(result, list(ids), "left")
