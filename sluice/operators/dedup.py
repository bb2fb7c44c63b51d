"""Fixed-window claims per event id (first event claims for 48 h; a failed run releases).

The rule is a sequential fold per event id over arrival order:

    claim = None
    for e in events(id):
        if claim is not None and e.t < claim + ttl:  duplicate
        else:                                        claimed; claim = e.t if e.ok else None

It is not a window function. Doing it per id with ``collect_list`` or a
per-key window puts a hot id (which may hold a third of all rows) in one task,
so it is computed with joins whose keys are unique per event instead:

1. ``next(i)`` -- the event processed after i if i is processed -- is the first
   later event with ``t >= t_i + ttl`` when i succeeds, else the next event.
   With events and "probe" rows (at ``t_i + ttl``) in one globally
   range-sorted order, it is a skew-safe running count of events per id.
2. The claimed events are the chain ``1 -> next(1) -> ...`` of each id, found by
   pointer doubling: jump tables ``J_{k+1} = J_k o J_k`` joined on (id, rank),
   then the chain is unfolded from the first event, longest jumps first.
   ``log2(longest chain)`` rounds; each round is a shuffle join on unique
   (id, rank) pairs, so no task holds more than its share.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import constants as K
from sluice.operators.scan import rank_within
from sluice.session import discard, materialize

CLAIMED, DUPLICATE = "claimed", "duplicate"


def _has_rows(df: DataFrame) -> bool:
    return len(df.limit(1).collect()) > 0


# Ids with at most this many events are folded inside one aggregate (a bounded group);
# ids above it go through the pointer-doubling path, which never puts a key in one task.
SMALL_GROUP_MAX = 256


def claim_chain(df: DataFrame, key: str, clock: str, tiebreak: Sequence[str], ok: Column | None,
                ttl_s: int = K.DEDUP_TTL_S, id_cols: Sequence[str] | None = None,
                out: str = "dedup_status", where: Column | None = None,
                small_group_max: int = SMALL_GROUP_MAX, prior: DataFrame | None = None) -> DataFrame:
    """Mark each row ``claimed`` or ``duplicate`` by the fixed-window claim fold.

    ``ok`` is the per-row handler success (``None``: every processed row claims).
    ``id_cols`` identify a row uniquely (default: ``tiebreak``). Rows failing
    ``where`` take no part and get a NULL status. A row whose key or clock is NULL
    can't be compared with others: it is ``claimed`` and opens no window.

    ``prior`` (``event_id, claim_time``, one row per id; see ``open_claims``) holds the
    claims still open from earlier runs: rows less than ``ttl_s`` after it, or before it (they would have
    shared a window with it), are duplicates; the fold takes the others.

    Only duplicates are computed and joined back; an id seen once never enters the fold.
    """
    ids = list(id_cols or tiebreak)
    okc = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    inc = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    # the few needed columns once (flags computed a single time), then filtered
    base = materialize(df.select(F.col(key).alias("_k"), F.unix_micros(F.col(clock)).alias("_t"),
                                 *[F.col(c) for c in dict.fromkeys([*tiebreak, *ids])], okc.alias("_ok"),
                                 inc.alias("_in")).where("_in AND _k IS NOT NULL AND _t IS NOT NULL").drop("_in"),
                       "claim-base")
    done, before = [base], None
    if prior is not None:
        # written first: ``prior`` is an aggregate as a rule, and only a join of two scans lets AQE split a hot id
        claims = materialize(prior.select(F.col("event_id").alias("_k"), F.unix_micros("claim_time").alias("_claim")), "claim-prior")
        held = materialize(base.join(claims, "_k", "left").withColumn(
            "_held", F.coalesce(F.abs(F.col("_t") - F.col("_claim")) < F.lit(ttl_s * 1_000_000), F.lit(False))).drop("_claim"),
            "claim-held")
        done += [claims, held]
        before, base = held.where("_held").select(*ids), held.where("NOT _held").drop("_held")
    # a written table of the repeated ids: the join reads two scans, so AQE splits the rows of a hot id over tasks
    # (with the aggregate inside the join's stage it can't)
    sizes = materialize(base.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "claim-sizes")
    sized = materialize(base.join(sizes, "_k"), "claim-sized")
    done += [sizes, sized]
    dups = _fold_small(sized.where(F.col("_n") <= small_group_max), tiebreak, ids, ttl_s, out)
    big = sized.where(F.col("_n") > small_group_max).drop("_n")
    if _has_rows(big):
        chained, temp = _chain(big, tiebreak, ids, ttl_s, out)
        dups, done = dups.unionByName(chained), done + temp
    dups = dups.where(F.col(out) == DUPLICATE).select(*ids)
    if before is not None:
        dups = dups.unionByName(before)
    # its size is known from the files: Spark broadcasts it below autoBroadcastJoinThreshold bytes, else shuffles
    dups = materialize(dups.withColumn("_dup", F.lit(True)), "claim-dups")
    discard(*done)
    return (df.join(dups, ids, "left")
            .withColumn(out, F.when(F.col("_dup"), F.lit(DUPLICATE)).when(inc, F.lit(CLAIMED))).drop("_dup"))


def open_claims(marked: DataFrame, now: Column, key: str = "event_id", clock: str = "clock",
                tiebreak: Sequence[str] = ("topic", "partition", "offset"), ok: Column | None = None,
                ttl_s: int = K.DEDUP_TTL_S, prior: DataFrame | None = None) -> DataFrame:
    """Claims that outlive this run: ``event_id, claim_time``, to be the next run's ``prior``.

    The last row that ran decides (a later run starts only once the earlier claim has ended);
    a failed one leaves no claim. One aggregate with map-side combine.
    """
    okc = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    order = F.struct(F.col(clock), *[F.col(c) for c in tiebreak])
    ran = (marked.where((F.col("dedup_status") == CLAIMED) & F.col(key).isNotNull() & F.col(clock).isNotNull())
           .groupBy(F.col(key).alias("event_id"))
           .agg(F.max_by(F.struct(F.col(clock).alias("claim_time"), okc.alias("ok")), order).alias("c"))
           .select("event_id", "c.claim_time", "c.ok"))
    if prior is not None:
        ran = (ran.unionByName(prior.select("event_id", "claim_time", F.lit(True).alias("ok")))
               .groupBy("event_id").agg(F.max_by(F.struct("claim_time", "ok"), F.col("claim_time")).alias("c"))
               .select("event_id", "c.claim_time", "c.ok"))
    end = F.unix_micros("claim_time") + F.lit(ttl_s * 1_000_000)
    return ran.where(F.col("ok") & (end > F.unix_micros(now))).select("event_id", "claim_time")


def _fold_small(rows: DataFrame, tiebreak: Sequence[str], ids: Sequence[str], ttl_s: int,
                out: str) -> DataFrame:
    """The fold itself, per id, over a sorted array of at most ``SMALL_GROUP_MAX`` events."""
    ttl_us = F.lit(ttl_s * 1_000_000)
    ev = F.struct(F.col("_t"), *[F.col(c) for c in tiebreak],
                  F.struct(*[F.col(c) for c in ids]).alias("_id"), F.col("_ok"))
    g = rows.groupBy("_k").agg(F.array_sort(F.collect_list(ev)).alias("_evs"))
    init = F.struct(F.lit(None).cast("bigint").alias("claim"), F.array().cast("array<boolean>").alias("dup"))

    def step(acc, x):
        dup = acc["claim"].isNotNull() & (x["_t"] < acc["claim"] + ttl_us)
        claim = F.when(dup, acc["claim"]).when(x["_ok"], x["_t"])
        return F.struct(claim.alias("claim"), F.concat(acc["dup"], F.array(dup)).alias("dup"))

    folded = g.select("_evs", F.aggregate("_evs", init, step)["dup"].alias("_dup"))
    pairs = F.transform("_evs", lambda x, i: F.struct(x["_id"].alias("_id"),
                                                      F.element_at(F.col("_dup"), i + 1).alias("_d")))
    return folded.select(F.explode(pairs).alias("_e")).select(
        *[F.col("_e._id")[c].alias(c) for c in ids],
        F.when(F.col("_e._d"), F.lit(DUPLICATE)).otherwise(F.lit(CLAIMED)).alias(out))


def _chain(base: DataFrame, tiebreak: Sequence[str], ids: Sequence[str], ttl_s: int,
           out: str) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer-doubling form of the fold for ids of any size (see module doc).

    Returns the marked rows and the written tables they read.
    """
    ev = base.withColumns({"_kind": F.lit(1), "_w": F.lit(1), "_st": F.col("_t")})
    pr = base.where("_ok").withColumns({"_kind": F.lit(0), "_w": F.lit(0),
                                        "_st": F.col("_t") + F.lit(ttl_s * 1_000_000)})
    ranked = rank_within(ev.unionByName(pr), ["_k"], ["_st", "_kind", *tiebreak], out="_c", weight="_w")
    evr = ranked.where("_kind = 1").select("_k", *ids, "_ok", F.col("_c").alias("_rn"))
    prr = ranked.where("_kind = 0").select(*ids, (F.col("_c") + 1).alias("_target"))
    nodes = (evr.join(prr, ids, "left")
             .withColumn("_nxt", F.when(F.col("_ok"), F.col("_target")).otherwise(F.col("_rn") + 1))
             .drop("_target"))
    nodes = materialize(nodes, "claim-nodes")

    # jump tables J_k: (key, rank) -> rank reached after 2^k processed steps
    levels, temp = [nodes.select("_k", "_rn", "_nxt")], [nodes]
    while True:
        a, b = levels[-1].alias("a"), levels[-1].alias("b")
        nxt = (a.join(b, (F.col("a._k") == F.col("b._k")) & (F.col("a._nxt") == F.col("b._rn")), "left")
               .select(F.col("a._k").alias("_k"), F.col("a._rn").alias("_rn"),
                       F.col("b._nxt").alias("_nxt")))
        nxt = materialize(nxt.where(F.col("_nxt").isNotNull()), "claim-jump")
        temp.append(nxt)
        if not _has_rows(nxt):
            break
        levels.append(nxt)
        if len(levels) > 64:
            raise RuntimeError("claim chain longer than 2^64")
    # unfold the chain of every key from its first event
    chain = nodes.where("_rn = 1").select("_k", "_rn")
    for lv in reversed(levels):
        step = chain.join(lv, ["_k", "_rn"]).select("_k", F.col("_nxt").alias("_rn"))
        chain = materialize(chain.unionByName(step), "claim-chain")
        temp.append(chain)
    marked = (nodes.join(chain.withColumn("_on", F.lit(True)), ["_k", "_rn"], "left")
              .select(*ids, F.when(F.col("_on"), F.lit(CLAIMED)).otherwise(F.lit(DUPLICATE)).alias(out)))
    return marked, temp


def dedup_claims(handled: DataFrame, clock: str = "clock", key: str = "event_id",
                 tiebreak: Sequence[str] = ("topic", "partition", "offset"),
                 ttl_s: int = K.DEDUP_TTL_S, where: Column | None = None,
                 prior: DataFrame | None = None) -> DataFrame:
    """Every processed event claims its id for ``ttl_s`` (no release)."""
    return claim_chain(handled, key, clock, list(tiebreak), None, ttl_s, where=where, prior=prior)


def dedup_release(handled: DataFrame, clock: str = "clock", key: str = "event_id",
                  tiebreak: Sequence[str] = ("topic", "partition", "offset"),
                  ttl_s: int = K.DEDUP_TTL_S, where: Column | None = None,
                 prior: DataFrame | None = None) -> DataFrame:
    """Only a successful run keeps its claim; a failed one releases it (needs ``error``)."""
    return claim_chain(handled, key, clock, list(tiebreak), F.col("error").isNull(), ttl_s, where=where,
                       prior=prior)


def dedup_within_watermark(events: DataFrame, clock: str = "clock", key: str = "event_id",
                           delay: str = "48 hours") -> DataFrame:
    """Spark's built-in bounded dedup (an approximation: not the fixed claim window)."""
    return events.withWatermark(clock, delay).dropDuplicatesWithinWatermark([key])
