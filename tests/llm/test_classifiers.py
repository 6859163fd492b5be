import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import quality, toxicity

from .fixtures import odd

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("operator", "label", "modulus", "rest", "least"), [(quality, "quality", 3, 1, 0.97), (toxicity, "toxic", 5, 0, 0.97)])
def test_held_out(given, operator, label, modulus, rest, least):
    docs, labels = given
    rows = operator.classify(docs, labels).join(labels.select("doc_id", label), "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % modulus == rest for d in rows.doc_id]).all()
    assert ((rows.score >= 0.5) == rows.predicted.astype(bool)).all()
    test = rows[rows.held_out & rows[label].notna()]
    assert (test.predicted == test[label]).mean() >= least
    few = 1 - int(test[label].mean() > 0.5)
    assert (test[test[label] == few].predicted == few).mean() >= 0.9


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd(spark, given, operator):
    docs = odd(spark)
    labels = given[1].withColumn("label", F.lit("x")).limit(50)
    out = operator.classify(docs, labels.limit(0)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert operator.classify(docs.limit(0), labels).count() == 0
    both = docs.selectExpr("doc_id", "text").union(given[0].select("doc_id", "text").limit(2000))
    more = spark.createDataFrame([(900002, 1, 0), (900002, 1, 0), (None, 0, 1), (900006, None, None)], "doc_id long, quality int, toxic int").union(given[1].select("doc_id", "quality", "toxic"))
    out = operator.classify(both, more).collect()
    assert len(out) == both.count() and all(0 <= r.score <= 1 for r in out)


def test_labels_held_out_are_not_read(spark, given):
    docs, labels = given
    small = docs.limit(600).cache()
    flipped = labels.withColumn("quality", F.when(quality.remainder("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.classify(small, x).collect()) for x in (labels, flipped))
    assert a == b


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    model = quality.Machine(np.zeros((1, 1)), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    at, value, cut = np.array([1, 4, 7, 2, 8]), rng.normal(size=5), np.array([0, 3, 5])
    got, _ = model.margin(at, value, cut)
    for row, (lo, hi) in enumerate([(0, 3), (3, 5)]):
        want = 0.3 + sum(model.w[at[i]] * value[i] for i in range(lo, hi))
        want += sum(model.v[at[i]] @ model.v[at[j]] * value[i] * value[j] for i in range(lo, hi) for j in range(i + 1, hi))
        assert abs(got[row] - want) < 1e-9


def test_isotonic_is_monotone_and_close_to_the_means():
    rng = np.random.default_rng(2)
    margin = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * margin))).astype(float)
    steps, values = toxicity.isotonic(margin, y)
    assert (np.diff(steps) >= 0).all() and (np.diff(values) >= 0).all() and 0 <= values.min() and values.max() <= 1


def test_toxicity_features():
    text = ["You IDIOT! moron", "an 1d1ot walks", ""]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    keys = toxicity._hash_list(["idiot", "moron"])
    x = toxicity.features(data, np.array([0, 16, 30, 30]), keys, np.array([1.0, 2.0]))
    f = dict(zip(toxicity.FEATURES, x.T, strict=True))
    assert f["hits"].tolist() == [2, 0, 0] and f["disguised_hits"].tolist() == [0, 1, 0]
    assert f["nearest_you"].tolist() == [1, toxicity.FAR, toxicity.FAR] and f["hits_near_you"].tolist() == [2, 0, 0]
    assert f["capitals"][0] > 0.4 and f["n_words"].tolist() == [np.log1p(3), np.log1p(3), 0]


def grown(x, g, h, rows, level, edges):
    """The best tree on some rows, by trying every feature and threshold: nested (feature, threshold, left, right) or a leaf's value."""
    if level == toxicity.LEVELS:
        return toxicity.RATE * g[rows].sum() / (h[rows].sum() + toxicity.SHRINK)
    worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + toxicity.SHRINK)
    best, cut = 1e-9, None
    for f, own in enumerate(edges):
        for threshold in own:
            left = rows & (x[:, f] <= threshold)
            gain = worth(left) + worth(rows & ~left) - worth(rows)
            if gain > best + 1e-9:
                best, cut = gain, (f, threshold)
    if cut is None:
        value = toxicity.RATE * g[rows].sum() / (h[rows].sum() + toxicity.SHRINK)
        return value if level else value
    left = rows & (x[:, cut[0]] <= cut[1])
    return (*cut, grown(x, g, h, left, level + 1, edges), grown(x, g, h, rows & ~left, level + 1, edges))


def test_boost_is_newton_boosting_by_hand(monkeypatch):
    """Margins of a few trees against trees that are grown node by node over all thresholds."""
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(400, 3)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) * 0.3 > 0).astype(float)
    model = toxicity.boost(x, y)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, toxicity.BINS + 1)[1:-1])) for c in x.T]
    share = (y.sum() + 0.5) / (len(y) + 1)
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        tree = grown(x, g, h, np.ones(len(y), bool), 0, edges)
        for i in range(len(y)):
            node = tree
            while isinstance(node, tuple):
                node = node[2] if x[i, node[0]] <= node[1] else node[3]
            margin[i] += node
    assert np.allclose(model.margin(x), margin, atol=1e-6)


def test_isotonic_is_the_least_squares_fit():
    """Before smoothing, the fit at i is the greatest, over starts up to i, of the least mean over ends from i."""
    rng = np.random.default_rng(3)
    margin = np.sort(rng.normal(size=60))
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    steps, values = toxicity.isotonic(margin, y)
    fit = np.array([max(min(y[j : k + 1].mean() for k in range(i, 60)) for j in range(i + 1)) for i in range(60)])
    # smoothing moves a block of n by half a label of either kind
    want = np.zeros(60)
    for v in np.unique(fit):
        own = np.isclose(fit, v)
        want[own] = (y[own].sum() + 0.5) / (own.sum() + 1)
    assert np.allclose(np.interp(margin, steps, values), np.maximum.accumulate(want), atol=1e-9)
