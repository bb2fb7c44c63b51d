"""Posteriors by plain sums over hosts and paths, and held-out accuracy on labelled documents."""
import collections
import math

import numpy as np

from sluice.llm import quality


def test_posterior_by_brute_force(spark):
    draw = np.random.default_rng(11)
    good, bad = "alpha beta gamma delta epsilon".split(), "click free winner prize now".split()
    rows = [(i, " ".join(draw.choice(good if (i + i // 40) % 3 else bad, int(draw.integers(3, 30)))) if i % 29 else None, f"p{i % 4}" if i % 13 else None, f"h{int(draw.zipf(1.6)) % 9}" if i % 17 else None)
            for i in range(400)] + [(5, "alpha beta", "p1", "lonely"), (None, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(bool((i + i // 40) % 3)), int(i % 11 == 0)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = quality.score(df, labels).collect()
    model = quality.train(df, labels, "doc_id", "text", quality.SAMPLE)
    import pyarrow as pa
    evidence = model.evidence(pa.array([r[1] for r in rows], pa.string()))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    want = []
    posts = []
    for c in range(2):
        p = [sigmoid(e[c] + logit(float(model.rate[c]))) for e in evidence]
        host, path = collections.defaultdict(list), collections.defaultdict(list)
        for r, x in zip(rows, p):
            host[r[3]].append(x)
            path[r[3], r[2]].append(x)
        overall = sum(p) / len(p)

        def strength(groups, around):
            between = np.mean([(np.mean(x) - around(k)) ** 2 for k, x in groups.items()]) - np.mean([around(k) * (1 - around(k)) / len(x) for k, x in groups.items()])
            return min(max(np.mean([around(k) * (1 - around(k)) for k in groups]) / max(between, 1e-9) - 1, 1.0), 1e6)
        s = strength(host, lambda k: overall)
        mean = {k: (s * overall + sum(x)) / (s + len(x)) for k, x in host.items()}
        t = strength(path, lambda k: mean[k[0]])
        prior = [(t * mean[r[3]] + sum(path[r[3], r[2]]) - x) / (t + len(path[r[3], r[2]]) - 1) for r, x in zip(rows, p)]
        posts.append((prior, [sigmoid(e[c] + logit(q)) for e, q in zip(evidence, prior)]))
    for k, r in enumerate(rows):
        want.append((r[0], r[3], r[2], posts[0][0][k], posts[0][1][k], posts[1][1][k]))
    key = lambda x: tuple(str(v) for v in x[:3]) + tuple(round(v, 6) for v in x[3:])
    told = sorted(((r.doc_id, r.host, r.path, r.prior_quality, r.p_quality, r.p_toxic) for r in got), key=key)
    for a, b in zip(told, sorted(want, key=key)):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=1e-6)
    assert len(told) == len(want) and all(r.keep == (r.p_quality >= 0.5 and r.p_toxic < 0.5) for r in got)
    # a host of one text stays near what is above it, a host with many near its own mean
    assert len({r.prior_quality for r in got}) > 10


def test_held_out_accuracy(spark):
    """Fitted on the labels of odd ids of the sf0.1 documents, judged on those of even ids."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where("quality IS NOT NULL AND toxic IS NOT NULL")
    asked = labels.where("doc_id % 2 = 0")
    got = quality.score(docs, labels.where("doc_id % 2 = 1")).join(asked, "doc_id").selectExpr("avg(int((p_quality >= 0.5) = (quality = 1)))", "avg(int((p_toxic >= 0.5) = (toxic = 1)))", "count(*)").first()
    assert got[2] > 500 and got[0] >= 0.97 and got[1] >= 0.95
