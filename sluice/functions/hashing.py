"""Lane assignment: exact 32-bit FNV-1a of the UTF-8 key, modulo the lane count."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: FNV-1a 32-bit parameters ----------------------------------
FNV32_OFFSET = 2166136261
FNV32_PRIME = 16777619


def fnv1a32(key: Column) -> Column:
    """FNV-1a 32 over the UTF-8 bytes of ``key`` as a native expression (BIGINT in [0, 2^32))."""
    # ISO 8859-1 has one character for each byte, of the byte's value
    each = F.split(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1"), "")
    return F.when(key == "", F.lit(FNV32_OFFSET).cast("bigint")).otherwise(
        F.aggregate(each, F.lit(FNV32_OFFSET).cast("bigint"),
                    lambda h, b: (h.bitwiseXOR(F.ascii(b).cast("bigint")) * F.lit(FNV32_PRIME)).bitwiseAND(F.lit((1 << 32) - 1))))


def lane_of(key: Column, lanes: Column) -> Column:
    """Exact lane index of the worker pool (FNV-1a 32 mod lane count)."""
    return F.pmod(fnv1a32(key), lanes.cast("bigint"))


def fast_lane_of(key: Column, lanes: Column) -> Column:
    """Cheaper lane index with the same role (uniform spread), not bit-equal to FNV-1a."""
    return F.pmod(F.xxhash64(key), lanes.cast("bigint"))
