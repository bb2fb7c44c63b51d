"""Language identification learns from all training texts, and tells its quartiles from histograms."""
import numpy as np
from pyspark.sql import functions as F

from sluice.llm import langid


def test_every_training_text_is_counted(spark):
    """More documents of a language than any bound on a sample would take."""
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    counts = langid.gram_counts(langid.training(rows, "doc_id", "text", "lang"))
    got = {(r.length, r.gram): r.n for r in counts.collect()}
    texts = [r.text.encode() for r in rows.where(~langid.held_out("doc_id")).collect()]
    want: dict = {}
    for t in texts:
        for k in range(1, langid.ORDER + 2):
            for i in range(len(t) - k + 1):
                g = int.from_bytes(t[i: i + k], "big")
                want[k, g] = want.get((k, g), 0) + 1
    assert len(texts) > 6000 and got == want


def test_short_and_empty_texts_are_counted(spark):
    rows = spark.createDataFrame([("", "en"), ("A", "en"), ("ab", "en"), ("abcde", "fr")], "text string, lang string")
    got = {(r.lang, r.length, r.gram.to_bytes(r.length, "big")): r.n for r in langid.gram_counts(rows).collect()}
    assert got == {("en", 1, b"a"): 2, ("en", 1, b"b"): 1, ("en", 2, b"ab"): 1, **{("fr", k, b"abcde"[i: i + k]): 1 for k in range(1, 5) for i in range(6 - k)}}


def test_quartiles_of_a_histogram(spark):
    draw = np.random.default_rng(1)
    for n in (8, 9, 10, 11, 500):
        rates = draw.integers(0, 50, n)
        seen = spark.createDataFrame([("en", 0, int(x)) for x in rates], "lang string, k int, rate long").groupBy("lang", "k", "rate").agg(F.count("*").alias("c"))
        r, = langid.quartiles(seen).collect()
        assert r.n == n and np.allclose([r.median, r.upper], np.quantile(rates, [0.5, 0.75]))
