import random
import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.postings import Postings
from palimpsest.operators.recall import bm25_topk
from palimpsest.operators.tables import scratch

SCHEMA = "owner_id long, fragment_id long, content string"
WORDS = [f"w{i}" for i in range(300)]


def made(rng, ids):
    """Words of falling frequency; long and short texts."""
    texts = (" ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(300)], k=rng.choice([0, 3, 8, 30, 120]))) for _ in ids)
    return [(i % 3 if i % 40 else None, i, x if i % 17 else None) for i, x in zip(ids, texts)]


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "fragment_id", "score", "rank").collect())


@pytest.fixture
def index(spark):
    return Postings(spark, f"{scratch(spark)}/test-postings-{uuid.uuid4().hex}", 4)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(3)
    rows = [(q, q % 3, " ".join(rng.sample(WORDS, 5)) + " w1") for q in range(20)] + [(20, 0, ""), (21, 1, None), (22, 9, "w1"), (23, 0, "unknown")]
    return spark.createDataFrame(rows, "query_id long, owner_id long, query string")


def test_batches_removals_and_merges(spark, index, queries, monkeypatch):
    """Whatever the batches, the best are those of one pass over the live documents."""
    rng = random.Random(1)
    docs = made(rng, range(900))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert found(index.search(queries, 5)) == []
    index.append(frame(docs[:500]), 1)
    index.append(frame(docs[500:]), 2)
    index.append(frame(docs[500:]), 2)  # a batch again, as after a failure
    assert found(index.search(queries, 5)) == found(bm25_topk(queries, frame(docs), 5))
    index.remove(frame(docs[100:400]), 3)
    left = docs[:100] + docs[400:]
    assert found(index.search(queries, 5)) == found(bm25_topk(queries, frame(left), 5))
    # some of them come back with another text, under another owner
    again = [(owner, i, f"w1 w2 {content}") for owner, i, content in made(rng, range(100, 200))]
    index.append(frame(again), 4)
    want = found(bm25_topk(queries, frame(left + again), 5))
    assert found(index.search(queries, 5)) == want
    # a merge that stopped before its commit changes nothing; then it counts alone
    with monkeypatch.context() as patch:
        patch.setattr(index, "_write", lambda blocks, stats, batch, **more: index._put(blocks, batch))
        index.compact(5)
    assert index.batches() == [1, 2, 3, 4] and found(index.search(queries, 5)) == want
    index.compact(5)
    assert index.batches() == [5] and index.gone() is None and found(index.search(queries, 5)) == want
    # the folder is all that another session needs
    spark.sql(f"DROP TABLE {index.table}")
    other = Postings(spark, index.path)
    assert other.buckets == 4 and found(other.search(queries, 5)) == want
    assert sorted(map(tuple, other.search(queries.limit(0), 5).collect())) == []


def test_bounds_hold_and_prune(spark, index):
    """No document scores above its cell's bound, and most cells are never scored."""
    rng = random.Random(2)
    rows = [(0, i, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(300)], k=rng.choice([20, 40, 90])))) for i in range(4000)]
    rows += [(0, 5000 + i, f"w{250 + i % 3} w{253 + i % 2} w{256 + i % 5} " * 3) for i in range(60)]
    index.append(spark.createDataFrame(rows, SCHEMA), 1)
    queries = spark.createDataFrame([(1, 0, "w250 w253 w256"), (2, 0, "w251 w254 w1 w2")], "query_id long, owner_id long, query string")
    weights, cells = index.bounds(queries)
    first, others = index.first_cells(cells, 10)
    top = index._scores(weights, first, 1.2, 0.75).cache()
    left = index.worth(others, top, 10)
    assert first.count() + left.count() < 0.7 * cells.count()
    for row in cells.collect():
        best = index._scores(weights, cells.filter((F.col("cell") == row.cell) & (F.col("query_id") == row.query_id)), 1.2, 0.75).agg(F.max("score")).first()[0] if rng.random() < 0.03 else 0
        assert best <= row.bound + 1e-6
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(index.search(queries, 10)) == found(bm25_topk(queries, docs, 10))


def test_words_are_counted_where_a_cell_is(spark, index, monkeypatch):
    """Texts are dealt by cell once; no row for each word of a document is made or shuffled."""
    plans, put = [], Postings._put
    monkeypatch.setattr(Postings, "_put", lambda self, blocks, batch: (plans.append(blocks._jdf.queryExecution().optimizedPlan().toString()), put(self, blocks, batch)))
    index.append(spark.createDataFrame([(1, 1, "a b a"), (1, 2, "b"), (1, 3, None), (1, 4, "--"), (2, 5, "a"), (1, 6, "b"), (1, 6, "b")], SCHEMA), 1)
    assert "Generate" not in plans[0]
    rows = sorted((r.owner_id, r.token, p.id, p.tf, p.dl) for r in index.blocks().collect() for p in r.posts)
    assert rows == [(1, "a", 1, 2, 3), (1, "b", 1, 1, 3), (1, "b", 2, 1, 1), (1, "b", 6, 2, 1), (2, "a", 5, 1, 1)]
    assert {(r.owner_id, r.n, r.dl) for r in index.commits().collect()} == {(None, 0, 0), (1, 6, 6), (2, 1, 1)}


def test_evidence_may_begin_and_end_inside_a_word(spark, tmp_path):
    from palimpsest.plans import q_recall

    docs = [(1, "unhappy red fox jumps"), (2, "happy red fox"), (3, "a happy  red fox"), (4, None), (5, "ox yox")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' as lang", "'src1' as source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "happy red fo"), (2, "ox"), (3, "no such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in q_recall._evidence(spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 5)}


def test_postings_are_not_shuffled(spark, index, monkeypatch):
    """Texts are dealt by the buckets' columns before their words are gathered, and a cell is scored where its blocks lie."""
    plans, put = [], Postings._put
    monkeypatch.setattr(Postings, "_put", lambda self, blocks, batch: (plans.append(blocks._jdf.queryExecution().executedPlan().toString()), put(self, blocks, batch)))
    rows = [(i % 2, i, f"w{i % 7} w{i % 5} w{i % 3} " * (1 + i % 4)) for i in range(600)]
    index.append(spark.createDataFrame(rows, SCHEMA), 1)
    assert plans[0].count("Exchange hashpartitioning") == 1
    queries = spark.createDataFrame([(1, 0, "w1 w4 w6"), (2, 1, "w2"), (3, 0, "none")], "query_id long, owner_id long, query string")
    scores = index._scores(*index.bounds(queries), 1.2, 0.75)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Generate" not in plan
    assert found(index.search(queries, 7)) == found(bm25_topk(queries, spark.createDataFrame(rows, SCHEMA), 7)) and scores.select("query_id").distinct().count() == 2
