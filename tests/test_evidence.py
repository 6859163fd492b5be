"""Current states against a plain re-reading of the rules, and vector search against numpy."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import evidence, recall, status


def replay(rows):
    """(owner, statement) to (action, state, replaced), with lists searched from the newest state on."""
    active, out = {}, {}
    for owner, sid, at, by, content, ttl in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        now, tokens = at.timestamp(), content.lower().split()
        mine = [s for s in active.get(owner, []) if s["end"] is None or s["end"] > now]
        score = lambda s: sum(w in s["text"] for w in tokens) / len(tokens) if tokens else 0  # noqa: E731, B023
        best = max(reversed(mine), key=score, default=None)
        share = score(best) if best else 0
        best = best if share > 0 else None
        end = None if ttl is None else now + ttl
        hit, gone = (best if share > 0.8 else None), None
        if hit is None and by == "companion":
            last = [s for s in mine if s["by"] == "companion" and now - s["at"] < 1800]
            if last and share < 0.8 and (share > 0.15 or len({w for w in content.split() if len(w) > 1} & set(last[-1]["words"])) >= 2):
                hit = last[-1]
        if hit is not None:
            hit["text"], hit["words"], hit["end"] = tokens, [w for w in content.split() if len(w) > 1], hit["end"] if end is None else end
            out[owner, sid] = ("updated", hit["id"], None)
        else:
            if share > 0.5:
                mine.remove(best)
                gone = best["id"]
            said = [s for s in mine if s["by"] == "companion" and int(s["at"] // 86400) == int(now // 86400)]
            if by == "deep_cycle" and said and share < 0.4:
                out[owner, sid] = ("skipped", said[-1]["id"], None)
            else:
                mine.append({"id": sid, "at": now, "by": by, "text": tokens, "words": [w for w in content.split() if len(w) > 1], "end": end})
                out[owner, sid] = ("created", sid, gone)
        active[owner] = mine
    return out


def statements(n, seed=2):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    words = [f"w{i}" for i in range(14)]
    return [(rng.randrange(3), i, start + dt.timedelta(minutes=rng.randrange(4000)), rng.choice(["companion", "deep_cycle", "user"]), " ".join(rng.sample(words, rng.randrange(7))), rng.choice([None, 3600.0, 90000.0])) for i in range(n)]


def test_upsert_states(spark):
    rows = statements(400)
    df = spark.createDataFrame(rows, "owner_id long, statement_id long, at timestamp, by string, content string, ttl double")
    got = {(r.owner_id, r.statement_id): (r.action, r.state_id, r.replaces) for r in evidence.upsert_states(df).collect()}
    assert got == replay(rows) and len({a for a, _, _ in got.values()}) == 3


def test_vector_blocks(spark, monkeypatch):
    """Small blocks: each query's best are those of all vectors together."""
    monkeypatch.setattr(recall, "QUERY_BLOCK", 7)
    monkeypatch.setattr(recall, "VECTOR_BLOCK", 30)
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(200, 8)), 3)
    v[5] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(200)]
    vectors = spark.createDataFrame([*rows, (900, None)], "fragment_id long, embedding array<double>")
    got = recall.vector_topk(vectors.filter("fragment_id < 20").withColumnRenamed("fragment_id", "query_id"), vectors, 4, 0.0, skip_self=True).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6)
    want = {(q, i): r + 1 for q in range(20) for r, i in enumerate(sorted((i for i in range(200) if i != q and sim[q, i] >= 0), key=lambda i: (-sim[q, i], i))[:4])}
    assert {(r.query_id, r.fragment_id): r["rank"] for r in got} == want


def test_json_ids(spark):
    texts = ['[1,"2",{"id":3},{"id":"4"},null,-1,0,"x",1,2.5,5.0]', "[]", "x", None, '{"id":1}', "[[1]]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    assert [r.ids for r in df.select("i", status.json_ids(F.col("text")).alias("ids")).orderBy("i").collect()] == [[1, 2, 3, 4, 5], [], [], [], [], []]


def test_contradiction_targets_without_caps(spark):
    """All entities that a verdict names count, and all entries about one of them."""
    names = spark.createDataFrame([(i, f"name{i}x") for i in range(6)], "entity_id long, term string")
    verdicts = spark.createDataFrame([(0, 1, " ".join(f"name{i}x" for i in range(5)), [7, 8])], "owner_id long, verdict_id long, content string, fragment_ids array<long>")
    rows = [(0, 10 * i + j, f"of name{i}x" if j % 2 else "", "active", [100], [] if j % 2 else [i]) for i in range(6) for j in range(6)] + [(1, 90, "name0x", "active", [7], [0]), (0, 91, "name0x", "gone", [7], [0])]
    model = spark.createDataFrame(rows, "owner_id long, entry_id long, content string, status string, fragment_ids array<long>, entity_ids array<long>")
    got = sorted(tuple(r) for r in evidence.contradiction_targets(verdicts, model, names).select("verdict_id", "entry_id", "fragment_id", "why").collect())
    assert got == [(1, 10 * i + j, 7, "entity") for i in range(5) for j in range(6)]
