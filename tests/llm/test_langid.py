import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid, queries

from .fixtures import SF, documents, odd


def test_held_out(spark):
    docs = documents(spark)
    rows = queries.op12_langid(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows.doc_id]).all()
    letters = np.array([any(c.isalpha() for c in t or "") for t in rows.text])
    assert ((rows.lang_pred == "und") == ~letters).all()
    test = rows[rows.held_out & letters & rows.lang.notna()]
    assert (test.lang_pred == test.lang).mean() >= 0.97
    assert all((part.lang_pred == lang).mean() >= 0.9 for lang, part in test.groupby("lang"))


def test_held_out_languages_are_not_read(spark):
    docs = documents(spark).limit(300).cache()
    other = docs.withColumn("lang", F.when(langid.remainder("doc_id", 3) == 1, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = (sorted(tuple(r) for r in langid.identify(d).collect()) for d in (docs, other))
    assert a == b


def test_odd_rows(spark):
    docs = odd(spark)
    out = langid.identify(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.lang_pred in ("en", "und") for r in out)
    assert langid.identify(docs.limit(0)).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.identify(docs.drop("lang")).count() == docs.count()
    mixed = documents(spark).select("doc_id", "text", "lang").union(docs.selectExpr("doc_id", "text", "lang")).select("*", F.lit(1).alias("score"), F.lit(2).alias("Lang"), F.lit("x").alias("known"))
    found = langid.identify(mixed).collect()
    assert len(found) == mixed.count()
    assert {r.lang_pred for r in found if r.doc_id in (900002, 900007)} == {"und"}


def test_ties_and_votes():
    """Three languages of a family: most votes win, then margins, then names."""
    rng = np.random.default_rng(4)
    machines = {p: rng.normal(size=2 * langid.PLACES + 1) for p in (("de", "en"), ("de", "nl"), ("en", "nl"))}
    model = langid.Model(["de", "en", "fr", "nl"], ["germanic", "romance"], np.stack([np.zeros(2 * langid.PLACES), np.full(2 * langid.PLACES, -1.0)]).astype(np.float32), np.zeros(2), machines)
    counts = rng.poisson(0.02, (200, 2 * langid.PLACES)).astype(np.float32)
    lang, score = model.predict(counts)
    x = langid.scaled(counts)
    for i in range(200):
        votes, sums = dict.fromkeys(("de", "en", "nl"), 0), dict.fromkeys(("de", "en", "nl"), 0.0)
        for (a, b), w in machines.items():
            m = float(x[i] @ w[:-1].astype(np.float32) + np.float32(w[-1]))
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        assert lang[i] == max(("nl", "en", "de"), key=lambda k: (votes[k], sums[k]))
    assert ((score >= 0) & (score <= 1)).all()


def test_machine_is_the_least_squared_hinge(monkeypatch):
    """Dual descent ends where the primal's gradient is zero."""
    monkeypatch.setattr(langid, "PASSES", 300)
    monkeypatch.setattr(langid, "PRICE", 0.1)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0, 1.0, -1.0)
    w, wide = langid.descend(x, y), np.column_stack([x, np.ones(80)])
    short = np.maximum(1 - y * (wide @ w), 0)
    assert np.abs(w - 2 * langid.PRICE * ((short * y) @ wide)).max() < 1e-6


@pytest.mark.parametrize(("lang", "family"), [("de", "germanic"), ("pt-BR", "romance"), ("ca", "romance"), ("xx", "=xx"), ("zh_TW", "=zh_TW")])
def test_families(lang, family):
    assert langid.family(lang) == family


def test_features_do_not_cross_rows():
    import pyarrow as pa

    texts = ["Ab c", None, "", "déjà vu 123!", "x" * 3000]
    apart = np.concatenate([np.concatenate([c for *_, c in langid.features(pa.array([t], pa.string()))]) for t in texts])
    together = np.concatenate([c for *_, c in langid.features(pa.array(texts, pa.string()))])
    assert (apart == together).all() and together[1].sum() == together[2].sum() == 0
