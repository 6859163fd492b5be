import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import packing

from .fixtures import documents, odd


@pytest.mark.parametrize("kind", ["given", "odd", "empty"])
def test_every_token_once(spark, kind):
    docs = {"given": documents, "odd": odd, "empty": lambda s: odd(s).limit(0)}[kind](spark)
    rows = packing.pack(docs).collect()
    want = Counter((r.doc_id, -(-len((r.text or "").encode()) // 4) + 1) for r in docs.select("doc_id", "text").collect())
    sizes = {k: sum(c * v for (d, v), c in want.items() if d == k) for k in {d for d, _ in want}}
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        bins[r.bin_id].append((r.bin_offset, r.bin_offset + r.length, r.bin_capacity))
    assert got == sizes and sorted(bins) == list(range(len(bins)))
    for parts in bins.values():
        at, capacity = 0, parts[0][2]
        for start, end, c in sorted(parts):
            assert start == at and c == capacity
            at = end
        assert at <= capacity and (capacity == min(packing.CAPACITIES) or at > max(c for c in packing.CAPACITIES if c < capacity))
    if kind == "given":
        used, made = sum(got.values()), sum(p[0][2] for p in bins.values())
        assert used / made > 0.9


def one_by_one(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        i = min(fit, key=lambda i: rooms[i]) if fit else len(rooms)
        if not fit:
            rooms.append(capacity)
        rooms[i] -= x
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 60))]
        segments, final = packing.plan(Counter(lengths), (30,))
        load = Counter()
        for length, _, number, first, offset in segments:
            for b in range(first, first + number):
                assert load[b] == offset
                load[b] += length
        assert sum(load.values()) == sum(lengths)
        assert sorted(30 - v for v in load.values()) == one_by_one(lengths, 30)
        assert sum(h - lo for lo, h, _ in final) == len(load)


def cheapest(lengths, sizes):
    best = float("inf")
    for where in product(range(len(lengths)), repeat=len(lengths)):
        load = Counter()
        for b, x in zip(where, lengths, strict=True):
            load[b] += x
        if max(load.values()) <= max(sizes):
            best = min(best, sum(packing.cost(min(s for s in sizes if s >= v)) for v in load.values()))
    return best


def test_near_the_cheapest_packing():
    rng = random.Random(8)
    ratios = []
    for _ in range(25):
        lengths, sizes = [rng.randint(1, 16) for _ in range(5)], (4, 8, 16)
        _, final = packing.plan(Counter(lengths), sizes)
        ratios.append(sum((h - lo) * packing.cost(c) for lo, h, c in final) / cheapest(lengths, sizes))
    assert min(ratios) >= 1 - 1e-9 and sum(ratios) / len(ratios) < 1.2


def test_own_lengths(spark):
    docs = spark.createDataFrame([(1, 10), (2, None), (3, 25)], "doc_id long, n long")
    rows = packing.pack(docs, (10,), F.col("n")).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == {(1, 10): 1, (2, 1): 1, (3, 10): 2, (3, 5): 1}
