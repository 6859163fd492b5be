import hashlib
import re
from collections import Counter

import pytest

from palimpsest.llm import decontaminate

from .fixtures import SF, documents, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    by_window = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            by_window.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes, out = {len(w) for w in by_window}, Counter()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := by_window.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        out[(doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
ITEMS = [(1, LONG), (2, "under the"), (3, "Word"), (4, None), (5, " .,"), (6, "a b c d e f"), (7, "word word word word word word"), (8, LONG + " pi"), (8, "ab")]
DOCS = [
    (1, f"x {LONG.upper()}! y", 1),
    (2, LONG.replace("iota", "jota"), 2),
    (3, " ".join(LONG.split()[:13]) + " z " * 400, 3),
    (4, "É under\nthe a b c d e f a b c d e f", 4),
    (4, "a b c d e", 5),
]


def test_given(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = decontaminate.digest_columns(decontaminate.decontaminate(documents(spark), benchmark)).collect()
    want = brute(documents(spark).select("doc_id", "text").collect(), benchmark.select("item_id", "text").collect())
    assert Counter(map(tuple, got)) == want and any(r.contaminated for r in got)


@pytest.mark.parametrize("items", [ITEMS, ITEMS[3:5], []])
def test_odd(spark, items):
    benchmark = spark.createDataFrame([(*x, 0) for x in items], "item_id int, text string, token int")
    docs = odd(spark).select("doc_id", "text").union(spark.createDataFrame(DOCS, "doc_id long, text string, place int").select("doc_id", "text")).selectExpr("*", "0 as k", "'' as place")
    got = decontaminate.digest_columns(decontaminate.decontaminate(docs, benchmark)).collect()
    assert Counter(map(tuple, got)) == brute(docs.select("doc_id", "text").collect(), items)


def test_empty(spark):
    got = decontaminate.decontaminate(odd(spark).limit(0), spark.createDataFrame(ITEMS, "item_id int, text string"))
    assert got.count() == 0
