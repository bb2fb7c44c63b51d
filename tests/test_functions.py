from pyspark.sql import functions as F

from sluice.functions.clock import backoff_seconds, format_rfc3339
from sluice.functions.hashing import fnv1a32
from sluice.operators.outcome import is_retriable


def test_fnv1a32_vectors(spark):
    df = spark.createDataFrame([("a",), ("foobar",), ("",), ("t1:c42",)], "k string")
    got = [r[0] for r in df.select(fnv1a32(F.col("k"))).collect()]
    assert got[:3] == [3826002220, 3214735720, 2166136261]

    def ref(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) % (1 << 32)
        return h
    assert got[3] == ref("t1:c42")


def test_backoff_clamps_both_ends(spark):
    df = spark.createDataFrame([(n,) for n in (-3, 0, 1, 2, 3, 4, 5, 6, 50)], "n long")
    got = [r[0] for r in df.select(backoff_seconds(F.col("n"))).collect()]
    assert got == [30, 30, 30, 60, 300, 900, 1800, 1800, 1800]


def test_retriable_classes(spark):
    df = spark.createDataFrame([("invalid_envelope",), ("business_validation",), ("panic",),
                                ("processing_error",), (None,)], "c string")
    assert [r[0] for r in df.select(is_retriable(F.col("c"))).collect()] == [False, False, True, True, False]


def test_rfc3339_format_trims_zeros(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07.179570",), ("2024-01-01 00:00:10",)], "t string")
    got = [r[0] for r in df.select(format_rfc3339(F.col("t").cast("timestamp"))).collect()]
    assert got == ["2024-01-01T00:00:07.17957Z", "2024-01-01T00:00:10Z"]
