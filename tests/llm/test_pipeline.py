from pyspark.sql import functions as F

import corpus_pipeline as p
from palimpsest.llm import packing

from .fixtures import SF, documents, odd
from .test_decontaminate import brute as contamination
from .test_jaccard import brute as near
from .test_native import lower  # noqa: F401


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = documents(spark)
    kept = p.materialize(p.quality_stage(spark, docs, SF))
    assert kept.columns == docs.columns and 0.7 < kept.count() / docs.count() < 1

    exact = p.materialize(p.exact_stage(spark, kept, SF))
    best = {}
    for r in kept.select("doc_id", "text").collect():
        key = "".join(r.text.split(" ")).translate(dict.fromkeys(range(9, 14)))
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text), r.doc_id))
    assert ids(exact) == sorted(d for _, d in best.values()) and exact.columns == docs.columns

    apart = p.materialize(p.near_stage(spark, exact, SF))
    assert ids(apart) == sorted({k[3] for k in near(exact.select("doc_id", "text").collect())})

    clean = p.materialize(p.benchmark_stage(spark, apart, SF))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    assert ids(clean) == sorted(k[0] for k in contamination(apart.select("doc_id", "text").collect(), items) if not k[5])

    packed = p.packing_stage(spark, clean, SF)
    want = sum(r.n for r in clean.select(packing.tokens(clean.text).alias("n")).collect())
    assert sum(r.length for r in packed.collect()) == want and set(ids(packed)) == set(ids(clean))


def test_run_is_the_stages(spark):
    got = p.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "bin_id", "bin_capacity"} <= set(got.columns)


def test_odd_rows_pass(spark):
    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        for _, stage in p.STAGES:
            out = stage(spark, rows, SF)
            assert out.count() <= 100


def test_clashing_names(spark):
    """Columns named as the stages' own, and one that only case tells from the text: the same documents stay, with their columns' values."""
    docs = documents(spark).limit(150)
    more = docs.select(F.lit("other").alias("Text"), "*", F.lit("r").alias("_row"), (F.col("doc_id") * 2).alias("_QUALITY"), F.lit(1).alias("row_key"), F.lit(2).alias("group_id"), F.lit(3).alias("digest"))
    for name, stage in p.STAGES[:-1]:
        want = {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}
        out = p.materialize(stage(spark, more, SF))
        assert out.columns == [*docs.columns, "_row", "_QUALITY", "row_key", "group_id", "digest"], name
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == want and all(r._row == "r" and r._QUALITY == 2 * r.doc_id and r.row_key == 1 for r in rows)
    assert sorted(ids(p.packing_stage(spark, more, SF))) == sorted(ids(p.packing_stage(spark, docs, SF)))


def test_null_and_repeated_ids(spark):
    """Each text stays once, whatever ids its rows have."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a + "  "), (1, a), (None, b), (7, c), (7, c + " "), (7, "another text that is clean"), (7, "a third text of one id")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([a + "  ", b, c + " ", "another text that is clean", "a third text of one id"])
    for stage in (p.exact_stage, p.near_stage, p.benchmark_stage):
        docs = p.materialize(stage(spark, docs, SF))
        assert sorted(r.text for r in docs.collect()) == want
