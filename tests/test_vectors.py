import numpy as np
import pytest

from palimpsest.operators import recall

SCHEMA = "fragment_id long, embedding array<double>"


def nearest(queries, vectors, k, floor, skip_self):
    unit = lambda rows: np.array([np.array(e) / max(np.linalg.norm(e), 1e-300) for _, e in rows])
    sim = np.round(unit(queries) @ unit(vectors).T, 6)
    out = {}
    for (q, _), row in zip(queries, sim, strict=True):
        best = sorted((-s, v) for s, (v, _) in zip(row, vectors, strict=True) if s >= floor and not (skip_self and v == q))[:k]
        out |= {(q, i): (v, float(-s)) for i, (s, v) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("k", "floor", "skip_self"), [(5, 0.2, False), (3, -1.0, True), (40, 0.9, False)])
def test_as_all_pairs(spark, monkeypatch, k, floor, skip_self):
    """Clusters, repeated vectors, a vector of zeros, and noise: the same rows as by comparing all pairs, most of which aren't met."""
    monkeypatch.setattr(recall, "CELL_ROWS", 20)
    monkeypatch.setattr(recall, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(recall, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(500)]
    rows += [(1000 + i, centres[3].tolist()) for i in range(200)] + [(2000, [0.0] * 16)] + [(3000 + i, rng.normal(size=16).tolist()) for i in range(20)]
    vectors = spark.createDataFrame([*rows, (9999, None)], SCHEMA)
    queries = [r for r in rows if r[0] % 7 == 0] + [(2000, [0.0] * 16)]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    met = {}
    got = {(r.query_id, r.rank): (r.fragment_id, r.similarity) for r in recall.vector_topk(asked, vectors, k, floor, skip_self, met).collect()}
    want = nearest(queries, rows, k, floor, skip_self)
    assert {key: v for key, (v, _) in got.items()} == {key: v for key, (v, _) in want.items()}
    assert all(abs(got[key][1] - s) < 2e-6 for key, (_, s) in want.items())
    # a query of zeros is as far from everything, so that it meets all; those of clusters meet a few cells
    assert met["of"] == len(rows) * len(queries) and met["pairs"] < (0.9 if k == 40 or floor < 0 else 0.5) * met["of"]


def test_few_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    asked = one.selectExpr("fragment_id as query_id", "embedding")
    assert recall.vector_topk(asked, none, 3).collect() == []
    assert recall.vector_topk(asked.limit(0), one, 3).collect() == []
    assert [tuple(r) for r in recall.vector_topk(asked, one, 3).collect()] == [(1, 1, 1.0, 1)]
    assert recall.vector_topk(asked, one, 3, skip_self=True).collect() == []
