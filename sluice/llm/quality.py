"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Evidence. A logistic model on the different words of a text (folded, hashed to 2**18), their 4- and 5-byte beginnings and the shares of
kinds of bytes (upper case, digits, marks, repeated words), fitted on at most ``SAMPLE`` (20,000) labelled rows (a documented
bound: those below a hash threshold, the few above the bound cut in order of id), one weight vector for each label (quality, toxic). A text's evidence is its log odds less those of the labelled base rate.

Priors. Hosts' rates are Beta distributed around the global rate, paths' rates around their host's. Both strengths are estimated by the
method of moments from grouped sums: the variance of the group means beyond what their sizes explain. A host's posterior mean is (strength *
global + sum of its texts' probabilities) / (strength + texts); a path's the same around its host's. Sparse sites shrink to what is above them.
A text's own contribution is left out of its path's sums before they become its prior, so evidence is not counted twice.

Posterior. log odds = evidence + log odds of the path's prior, for each label; ``keep`` says that a text is more
likely good than not and more likely clean than toxic.

Execution. Each text is scored once (a written table of a few numbers a row); hosts and paths are grouped sums with partial
aggregation, joined back on (host, path) - small tables broadcast below the session's threshold, hot sites split as skewed
joins beyond. The driver sees the sample's features and one row of moments a level.

Defined results: null or empty text has no words, hence the evidence of the intercept; null hosts and paths are groups of their own; labels
that are null are left out; with no labelled row, or one class only, the evidence is 0 and the rate that of the labels (1/2 without any); repeated rows are
separate texts with equal results (a labelled id that has several rows gives its label to all of them); an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import arrays as A
from sluice.llm.tables import Tables

SAMPLE, BITS, ROUNDS, Z_LEAST, LABELS = 20_000, 18, 200, 4.5, ("quality", "toxic")
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLDED = A.BYTE_VALUE.copy()
FOLDED[65:91] = FOLDED[97:123]
KINDS = [np.isin(np.arange(256), x) for x in ([*range(65, 91)], [*range(97, 123)], [*range(48, 58)], [*b".,"], [*b"!?"], [*b"|"], [*b"#$%&*@"], [*b"\n"], [*range(128, 256)])]


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every text of a column, words with repeats; features are below 2 ** BITS."""
    w = A.words(column, ~LETTERS, FOLDED)
    shift, text = np.uint64(64 - BITS), w.text
    parts, of = [w.value >> shift], [text]
    for length in (4, 5):
        longer = np.flatnonzero(w.end - w.start > length)
        start = w.start[longer]
        parts.append(A.mix(A._values(w.data, start, start + length, FOLDED) ^ np.uint64(length)) >> shift)
        of.append(text[longer])
    raw, off = A.column_bytes(column)
    size, full = np.diff(off), np.flatnonzero(np.diff(off))
    for k, kind in enumerate(KINDS):
        share = np.zeros(len(size))
        if len(full):
            share[full] = np.add.reduceat(kind[raw].astype(np.int64), off[:-1][full]) / size[full]
        step = np.ceil(np.log2(1 + 255 * share)).astype(np.uint64)
        parts.append(A.mix(np.uint64(1000 * (k + 1)) + step) >> shift)
        of.append(np.arange(len(size)))
    count = w.count
    half, bounds = np.unique(np.stack((text, w.value.view(np.int64)), 1), axis=0)[:, 0] if len(text) else text, np.arange(len(size) + 1)
    kinds = np.diff(np.searchsorted(half, bounds))
    twice = np.bincount(text[1:][(w.value[1:] == w.value[:-1]) & (text[1:] == text[:-1])], minlength=len(size)) if len(text) else kinds
    for k, x in enumerate((count, 20 * twice / np.maximum(count, 1), 20 * kinds / np.maximum(count, 1), 4 * size / np.maximum(count, 1))):
        parts.append(A.mix(np.uint64(1000 * (len(KINDS) + k + 1)) + (np.log2(1 + x) if k == 0 else x).astype(np.uint64)) >> shift)
        of.append(np.arange(len(size)))
    return np.concatenate(of), np.concatenate(parts).astype(np.int64)


def different(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text << BITS | feature)
    return key >> BITS, key & (1 << BITS) - 1


class Model:
    """Weights of every feature, one column a label, and base rates."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray):
        n, size = len(sets), 1 << BITS
        self.rate = labels.mean(0) if n else np.full(len(LABELS), 0.5)
        self.weight, self.bias = np.zeros((size, len(LABELS))), np.log(np.clip(self.rate, 1e-6, 1 - 1e-6) / (1 - np.clip(self.rate, 1e-6, 1 - 1e-6)))
        for c in range(len(LABELS)):
            if n and 0 < self.rate[c] < 1:
                y, r, one, both = labels[:, c], self.rate[c], np.zeros(size), np.zeros(size)
                for k in range(n):
                    both[sets[k]] += 1
                    one[sets[k]] += y[k]
                # features whose share of texts differs between the classes by more than chance over all of them
                p = both / n
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = np.nan_to_num((one / (n * r) - (both - one) / (n * (1 - r))) / np.sqrt(p * (1 - p) * (1 / (n * r) + 1 / (n * (1 - r)))))
                use = np.abs(z) > Z_LEAST
                kept = [x[use[x]] for x in sets]
                self._fit(c, np.repeat(np.arange(n), [len(x) for x in kept]), np.concatenate(kept), y, n, size)
        self.used = (self.weight != 0).any(1)
        self.weight = self.weight.astype(np.float32)

    def _fit(self, c, row, feature, y, n, size) -> None:
        w, b, m, v, mb, vb = np.zeros(size), self.bias[c], np.zeros(size), np.zeros(size), 0.0, 0.0
        balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for t in range(1, ROUNDS + 1):  # Adam on all rows at once
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feature], n) + b, -30, 30)))
            e = (p - y) * balance / n
            g, gb = np.bincount(feature, e[row], size) + 1e-4 * w, e.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            step = 0.1 * np.sqrt(1 - 0.99 ** t) / (1 - 0.9 ** t)
            w, b = w - step * m / (np.sqrt(v) + 1e-8), b - step * mb / (np.sqrt(vb) + 1e-8)
        self.weight[:, c], self.bias[c] = w, b + np.log(self.rate[c] / (1 - self.rate[c]))

    def evidence(self, column) -> np.ndarray:
        """(texts, labels): log odds less the base rates'."""
        out = np.zeros((len(column), len(LABELS)))
        text, feature = features(column)
        some = self.used[feature]
        text, feature = different(text[some], feature[some])
        for c in range(len(LABELS)):
            out[:, c] = np.bincount(text, self.weight[feature, c], len(column)) + self.bias[c] - np.log(max(self.rate[c], 1e-6) / max(1 - self.rate[c], 1e-6))
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> Model:
    known = labels.where(F.col(LABELS[0]).isNotNull() & F.col(LABELS[1]).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), *LABELS)
    share = min(1.0, sample / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, F.col("id") == F.col("k")).select("id", "text", *LABELS)

    def sets(batches):
        for b in batches:
            for part in A.slices(b, "text", 1 << 21):
                text, feature = different(*features(part.column("text")))
                ends = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, *(part.column(c).cast(pa.int32()) for c in LABELS)], names=["id", "features", *LABELS])
    kind = dict(rows.dtypes)["id"]
    got = rows.mapInArrow(sets, f"id {kind}, features array<int>, {LABELS[0]} int, {LABELS[1]} int").orderBy("id").limit(sample).toArrow()
    y = np.stack([got.column(c).to_numpy() for c in LABELS], 1).astype(np.float64) if got.num_rows else np.zeros((0, len(LABELS)))
    return Model([x.values.to_numpy() for x in got.column("features")], y)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, mean: str, total: str, n: str, around: str) -> float:
    """Beta strength of group means around what is above them, by moments; between 1 and a million."""
    m = F.col(total) / F.col(n)
    noise = F.col(around) * (1 - F.col(around))
    r = groups.agg(F.avg((m - F.col(around)) ** 2), F.avg(noise / F.col(n)), F.avg(noise)).first()
    if r[0] is None:
        return 1.0
    between = max(r[0] - r[1], 1e-9)
    return min(max(r[2] / between - 1, 1.0), 1e6)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row a text: id, host, path, evidence_quality, prior_quality, p_quality, p_toxic, keep."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "quality")
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, sample))
    rates = [float(x) for x in shared.value.rate]

    def run(batches):
        for b in batches:
            for part in A.slices(b, "text", 1 << 21):
                e = shared.value.evidence(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), part.column("path"), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["id", "host", "path", "e0", "e1"])
    rows = docs.select(F.col(id_col).alias("id"), (host if host is not None else F.col("source")).cast("string").alias("host"), (path if path is not None else F.col("lang")).cast("string").alias("path"), F.col(text_col).alias("text"))
    rows = tables.write(rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, host string, path string, e0 double, e1 double"), "evidence")
    own = [(1 / (1 + F.exp(-(F.col(f"e{c}") + _logit(F.lit(rates[c])))))).alias(f"p{c}") for c in range(2)]
    rows = rows.select("*", *own)
    paths = tables.write(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p0").alias("s0"), F.sum("p1").alias("s1")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s0").alias("h0"), F.sum("s1").alias("h1"))
    every = hosts.agg(F.sum("hn"), F.sum("h0"), F.sum("h1")).first()
    mean = [(every[c + 1] / every[0]) if every[0] else 0.5 for c in range(2)]
    for c in range(2):
        s = _strength(hosts.withColumn("g", F.lit(mean[c])), f"m{c}", f"h{c}", "hn", "g")
        hosts = hosts.withColumn(f"m{c}", (s * mean[c] + F.col(f"h{c}")) / (s + F.col("hn")))
    hosts = hosts.select(F.col("host").alias("hh"), "m0", "m1")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("hh")))
    for c in range(2):
        sites = sites.withColumn(f"k{c}", F.lit(_strength(sites, f"s{c}", f"s{c}", "n", f"m{c}")))
    sites = tables.write(sites.select(F.col("host").alias("sh"), F.col("path").alias("sp"), "n", "s0", "s1", "m0", "m1", "k0", "k1"), "sites")
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("sh")) & F.col("path").eqNullSafe(F.col("sp")))
    prior = [(F.col(f"k{c}") * F.col(f"m{c}") + F.col(f"s{c}") - F.col(f"p{c}")) / (F.col(f"k{c}") + F.col("n") - 1) for c in range(2)]
    post = [1 / (1 + F.exp(-(F.col(f"e{c}") + _logit(prior[c])))) for c in range(2)]
    return joined.select(F.col("id").alias(id_col), "host", "path", F.col("e0").alias("evidence_quality"), prior[0].alias("prior_quality"), post[0].alias("p_quality"), post[1].alias("p_toxic"),
                         ((post[0] >= 0.5) & (post[1] < 0.5)).alias("keep"))
