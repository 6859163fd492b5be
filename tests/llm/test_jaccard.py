import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from palimpsest.llm import jaccard

from .fixtures import documents, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows):
    classes = defaultdict(list)
    for doc, text in rows:
        classes[frozenset(bag(text).items())].append(doc)
    keys = list(classes)
    sets = [frozenset(k for k, _ in key) for key in keys]
    by_token = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            by_token[t].append(i)
    links, root = [0] * len(keys), list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for t in s for j in by_token[t] if j < i)
        for j, n in common.items():
            if n >= 0.8 * len(s | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = lambda ids: min((x for x in ids if x is not None), default=None)
    members = defaultdict(list)
    for i, key in enumerate(keys):
        members[find(i)] += classes[key]
    return Counter((doc, low(classes[key]), links[i], low(members[find(i)]), len(classes[key])) for i, key in enumerate(keys) for doc in classes[key])


def near(n, words=120, seed=5):
    """Groups of edited copies of a few base texts, some closer than 0.8 and some not."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for i in range(n):
        if i % 40 == 0:
            base = rng.choices(vocabulary, k=words)
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            text[rng.randrange(words)] = rng.choice(vocabulary)
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("kind", ["given", "odd", "near", "empty"])
def test_brute_force(spark, kind):
    docs = {"given": documents, "odd": odd, "empty": lambda s: odd(s).limit(0), "near": lambda s: s.createDataFrame(near(600), "doc_id long, text string")}[kind](spark)
    got = Counter(map(tuple, jaccard.join(docs).collect()))
    want = brute(docs.select("doc_id", "text").collect())
    assert got == want


def test_short_texts(spark):
    """Texts of 8 to 20 words, each with a copy that one more word brings to a similarity of 0.8 or a little above."""
    rng, rows = random.Random(3), []
    for i in range(600):
        text = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([8, 8, 8, 12, 16, 20]))]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, f"v{rng.randrange(10**6)}"]))]
    assert Counter(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_large_buckets_split_and_block(spark, monkeypatch):
    """Small leaves, so that the group of edited copies has to be split and at last dealt into blocks."""
    rows = near(300, seed=9)
    rows = [(i, t) for i, t in rows] + [(1000 + i, rows[0][1] + f" tail{i}") for i in range(200)]
    monkeypatch.setattr(jaccard, "LEAF", 20)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "DEPTH", 3)
    got = Counter(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_runs_grow_with_the_target():
    assert jaccard.runs(0.9) <= jaccard.runs(0.999) <= jaccard.runs(0.999999) and (1 - 0.8**jaccard.PATH * 0.9375) ** jaccard.runs() <= 1e-4


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100, 102: 100}


def counted(rows):
    """Links of texts that all have different bags, by a product of matrices."""
    import numpy as np

    sets = [frozenset(bag(t)) for _, t in rows]
    place = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[t] for t in s]] = 1
    both, size = m @ m.T, m.sum(1)
    linked = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    return linked.sum(1)


def copies(n, edits, seed=1, words=150):
    """Texts that differ from one base by as many changed words as ``edits`` says for each."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = set()
    while len(out) < n:
        text = list(base)
        for at in rng.sample(range(words), edits(rng)):
            text[at] = f"e{rng.randrange(10**6)}"
        out.add(" ".join(text))
    return [(i, t) for i, t in enumerate(sorted(out))]


@pytest.mark.parametrize("edits", [lambda r: 1, lambda r: r.choice([1, 1, 2, 2, 3])], ids=["one", "some"])
def test_many_near_copies(spark, edits):
    """A group that no split divides: placements stay linear in its rows, and no link is lost."""
    rows = copies(2400, edits)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.join(docs).collect()}
    want = counted(rows)
    assert abs(sum(want) - sum(r.n_links for r in got.values())) <= 1e-4 * sum(want)
    assert all(r.n_links <= w for (_, r), w in zip(sorted(got.items()), want, strict=True))
    assert {r.group_id for r in got.values() if r.n_links} == {min(i for i, r in got.items() if r.n_links)}


def test_near_copies_are_placed_once_a_run(spark):
    docs = spark.createDataFrame(copies(2400, lambda r: 1), "doc_id long, text string")
    classes = jaccard.materialize(docs.mapInArrow(jaccard._signatures, "doc_id long, digest binary, n long, signature binary").withColumn("node", F.col("doc_id")))
    small, stuck = jaccard.leaves(classes, jaccard.runs())
    assert small.count() + stuck.count() <= 2 * jaccard.runs() * 2400
