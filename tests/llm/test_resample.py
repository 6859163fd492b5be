import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import queries, resample

from .fixtures import SF, documents, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(run):
    return zlib.crc32(run.encode()) % 10000


def wanted(docs, target):
    """(doc_id, n_features, weight, score, rank) by the contract, one document after the other."""
    s, t = (Counter(bucket(r) for x in texts for r in runs(x)[1]) for texts in ([d for _, d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, own = runs(text)
        weight = sum(gain[bucket(r)] for r in own)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: 5 * len(fit) // 100]
    return Counter([(*r[:4], i) for i, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in [*fit[len(drawn) :], *(r for r in rows if r[4] < 20)]])


def test_given_documents(spark):
    docs = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op13_resample(spark, SF).collect()) == wanted(docs, target)


def test_odd_rows(spark):
    more = spark.createDataFrame([(5, "the same words " * 10)] * 300 + [(None, "no id here " * 9)] * 40 + [(7, "é" * 70 + " " + "x" * 5000 + " short")], "doc_id long, text string")
    docs = odd(spark).select("doc_id", "text").union(more).select("*", F.lit("x").alias("row"), F.lit(1).alias("Text"), F.lit(3).alias("segment"), F.lit(1).alias("weight"))
    target = spark.createDataFrame([("short the same words",), (None,), ("",)], "text string")
    rows = [(r[0], r[1]) for r in docs.collect()]
    assert Counter(tuple(r) for r in resample.resample(docs, target).collect()) == wanted(rows, [r.text for r in target.collect()])
    assert resample.resample(docs, target.limit(0)).count() == len(rows)
    assert resample.resample(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("segments", [1, 7, 50])
def test_ranks_are_those_of_one_sort(spark, segments):
    rng = random.Random(segments)
    rows = [(rng.choice([5, 6, rng.randrange(1000)]), rng.choice([1, None, rng.randrange(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", segments)
    try:
        for drawn in (0, 1, 1234, 3000):
            got = {r.row: r.rank for r in resample.sort_ranks(df, drawn, 3000).collect()}
            want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
            assert got == {r[2]: i if i <= drawn else None for i, r in enumerate(want, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_buckets():
    texts = ["", "One two THREE four", "é" * 40 + " " + "y" * 63 + " " + "z" * 64 + " " + "q" * 65 + " end", "...", "x" * 9000 + " a b"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, bounds = resample.buckets(np.frombuffer(data, np.uint8), offsets)
    for i, text in enumerate(texts):
        got = [int(b[j]) for b, whole in found for j in range(bounds[i], bounds[i + 1]) if whole[j]]
        assert sorted(got) == sorted(bucket(r) for r in runs(text)[1])
