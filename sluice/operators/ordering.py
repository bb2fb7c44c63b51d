"""Per-entity order: events of one (topic, affinity key) are handled in arrival order.

``ordered_by_affinity`` numbers each event inside its (topic, key) with the
skew-safe scan (a hot tenant spreads over many tasks).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sluice.operators.scan import rank_within

ARRIVAL = ("clock", "topic", "partition", "offset")


def ordered_by_affinity(events: DataFrame, key: str = "affinity_key",
                        arrival: Sequence[str] = ARRIVAL, out: str = "seq") -> DataFrame:
    return rank_within(events, ["topic", key], list(arrival), out=out)
