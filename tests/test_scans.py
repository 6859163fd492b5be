"""Terms in texts, by one pass over their bytes: all places of brute force, whatever the pieces."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import linking, scans

LETTERS = "ab e動画ß😀"


def _made(seed=5):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 2, 3, 9, 70, 400]))) for i in range(60)] + [(60, None), (61, "x" * 200 + "yy" + "ab" * 90), (62, "xx" + "yy" + "ab" * 90)]
    held = [x[k : k + n] for _, x in texts if x for n in (2, 3, 4, 5, 8, 17, 40, 66, 90) for k in (0, len(x) // 3, len(x) - n) if 0 <= k <= len(x) - n]
    terms = list(enumerate(sorted({*held, *[word(n) for n in (1, 2, 3, 4, 6, 30, 80)], "a", "x" * 70 + "yy" + "ab" * 90, "zq" + "a" * 70, "x" * 64, "x" * 65})))
    return texts, terms


@pytest.mark.parametrize("piece", [64, 1 << 16])
def test_mentions_equal_brute_force(spark, monkeypatch, piece):
    """Of one byte to more than are hashed, at the ends of texts and over the ends of pieces; the tasks get the sizes with the code."""
    monkeypatch.setattr(scans, "PIECE", piece)
    texts, terms = _made()
    find = scans._finder
    pieces = lambda *a: _with(find(*a), piece)
    monkeypatch.setattr(scans, "_finder", pieces)
    fold = str.maketrans("画", "畫")
    low = [(i, (x or "").translate(fold).lower()) for i, x in texts]
    want = {(i, e, w) for i, x in low for e, w in ((e, w.translate(fold).lower()) for e, w in terms) if len(w) >= 2 and w in x}
    got = [tuple(r) for r in linking.mention_join(spark.createDataFrame(texts, "text_id long, content string"), spark.createDataFrame(terms, "entity_id long, term string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def _with(find, piece):
    def run(batches):
        from palimpsest.operators import scans

        scans.PIECE = piece
        yield from find(batches)

    return run


def test_no_terms(spark):
    texts = spark.createDataFrame([(1, "some text")], "text_id long, content string")
    terms = spark.createDataFrame([(1, "a"), (2, None)], "entity_id long, term string")
    assert linking.mention_join(texts, terms).collect() == []
    assert linking.mention_join(texts.filter("false"), spark.createDataFrame([(1, "some")], "entity_id long, term string")).collect() == []


def test_mentions_make_no_row_for_runs_of_a_text(spark):
    """Only windows that may be terms leave the pass over a text; before, a row for each of its runs of three characters did."""
    texts = spark.range(20).select(F.col("id").alias("text_id"), F.expr("concat_ws(' ', transform(sequence(1, 2000), i -> sha(cast(id * 2000 + i as string))))").alias("_low"))
    terms = spark.createDataFrame([(i, f"no such name {i}") for i in range(500)], "entity_id long, term string")
    made = []
    plain = scans._finder

    def counted(*a):
        made.append(a)
        return plain(*a)

    scans._finder = counted
    try:
        assert scans.contained(texts, terms, []).count() == 0
    finally:
        scans._finder = plain
    said = texts.mapInArrow(plain(*made[0]), "text_id long, _token binary")
    assert said.count() < 100  # of 1.6 million bytes


def test_fold_and_key_tokens_pass_over_other_characters_alone(spark):
    """The whole table is folded, its first and last characters too, and all words that begin a key token are found."""
    import re

    from palimpsest.functions import text as t

    rows = [(f"x{a}y", f"x{b}y") for a, b in zip(t.SIMPLIFIED, t.TRADITIONAL, strict=True)] + [("plain éß", "plain éß"), ("한글 鿿 一", "한글 鿿 一")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.b for r in df.select("b", t.fold(F.col("a")).alias("f")).collect() if r.b != r.f] == []
    said = [f"a{w}b" for w in [*t.TIMES, *t.NUMERALS.replace("0-9", "0189"), *[x + "日" for x in t.WEEK.split("|")]]] + ["", "none", "12今天x3后天"]
    got = spark.createDataFrame([(x,) for x in said], "s string").select("s", t.key_tokens(F.col("s")).alias("k")).collect()
    assert [r.s for r in got if r.k != "|".join(sorted(re.findall(t.KEY, r.s)))] == []


def test_pair_sums(spark):
    """Sums over a text's distinct pairs of characters, whatever stands in the same batch; the pairs of small sets alone are kept."""
    from functools import reduce

    texts = [x for _, x in _made(7)[0] if x is not None] + ["", "好", "aaaa", "abab", "baba"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, _n string").coalesce(1)
    every = {r.id: r for r in scans.pair_sums(df, None).collect()}
    few = {r.id: r for r in scans.pair_sums(df, 5).collect()}
    hashes = {}
    for i, x in enumerate(texts):
        pairs, r = {x[k : k + 2] for k in range(len(x) - 1)}, every[i]
        assert r._size == len(pairs) == len(set(r._h)) and few[i][:-1] == r[:-1] and few[i]._h == (r._h if r._size <= 5 else [])
        xor = lambda hs: reduce(lambda a, b: a ^ b, hs, 0)
        assert r._xor == xor(r._h) and r._h0 == xor(h for h in r._h if not h >> 7 & 1) and r._h1 == xor(h for h in r._h if h >> 7 & 1)
        hashes.setdefault(frozenset(pairs), set()).add(frozenset(r._h))
    assert all(len(h) == 1 for h in hashes.values()) and len({h for hs in hashes.values() for h in hs}) == len(hashes)
