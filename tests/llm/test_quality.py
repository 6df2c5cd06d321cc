import random
import zlib

import numpy as np

from loresift.llm import quality
from loresift.llm.quality import LEAST_SPREAD, POOL, SHRINK, STATISTICS, accepted, classify, fit

SCHEMA = "doc_id long, text string, score string"


def corpus(rng, n):
    good = lambda: " ".join(rng.choice(["Rain", "fell", "on", "the", "old", "roof,", "and", "nobody", "came.", "Later"]) + rng.choice("abcde") for _ in range(80))
    bad = lambda: " ".join(rng.choice(["WIN!!", "$$$", "now###", "CLICK!!", "|"]) for _ in range(80))
    return [(i, good() if i % 3 else bad(), "") for i in range(n)]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(random.Random(1), 300)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, *_ in rows if i % 2] + [(1, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    odd = [(1000, None, ""), (1001, "", ""), (None, "Rain fell.", ""), (1002, "word " * 100_000, ""), (5, rows[5][1], "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.97
    stay = accepted(docs, labels)
    assert stay.columns == docs.columns and stay.count() == sum(r.predicted for r in got)


def test_scores_are_those_of_a_discriminant_computed_from_the_rows(spark):
    rng = np.random.default_rng(4)
    d = len(STATISTICS)
    x = rng.standard_normal((400, d)) @ rng.standard_normal((d, d)) + 3
    y = rng.integers(0, 2, 400)
    x[y == 1] = x[y == 1] * 1.3 + 0.7
    rows = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x, strict=True)], "quality int, stats array<double>")
    got = fit(rows).scores(x)
    # from the rows themselves: standardise, shrink towards the pooled covariance and the identity, log densities by determinant and solve
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * covs[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        cov = (1 - POOL) * covs[c] + POOL * pooled
        cov = (1 - SHRINK) * cov + SHRINK * (np.trace(cov) / d + LEAST_SPREAD) * np.eye(d)
        away = z - z[y == c].mean(axis=0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (away * np.linalg.solve(cov, away.T).T).sum(axis=1))
    assert np.allclose(got, 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6) and 0.05 < got.std()


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(0, "a b", ""), (1, "c", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in classify(docs, none).collect()] == [0.5, 0.5]
    only = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    assert {r.score for r in classify(docs, only).collect()} == {1.0}
    assert classify(docs.limit(0), none).count() == 0


def test_labels_meet_statistics_and_not_texts(spark, monkeypatch):
    rng, plans, fitted = random.Random(3), [], quality.fit
    rows = [(i, " ".join(rng.choice(["word", "Word", "x1", "##", "more"]) for _ in range(30 + i % 50)), "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)] + [(0, 1)], "doc_id long, quality int")

    def watched(taught):
        plans.append(taught._jdf.queryExecution().analyzed().toString() + taught._jdf.queryExecution().executedPlan().toString())
        return fitted(taught)

    monkeypatch.setattr(quality, "fit", watched)
    stay = accepted(docs, labels)
    assert len(plans) == 1 and "stats" in plans[0] and "text" not in plans[0].split("AdaptiveSparkPlan")[1] and "ArrowEvalPython" not in plans[0]
    assert stay.columns == docs.columns and {tuple(r) for r in stay.collect()} <= set(rows)
    assert {r.doc_id for r in stay.collect()} == {r.doc_id for r in classify(docs, labels).collect() if r.predicted}
