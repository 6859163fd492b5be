import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import queries, repair

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def cheapest(rows):
    """(cost, initials, turns) by trying every edit, from the end; rows are (role, text, fault)."""

    @cache
    def rest(i, state):
        due = "user" if state != "U" else "assistant"
        behind = due[0].upper()
        ways = [(0, "", ())] if i == len(rows) and state in "NA" else []
        if i < len(rows):
            role, text, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            ways.append((4, "D", (), i + 1, state))
            if fault not in ("blank", "duplicate"):
                if role[:1] == "s" and state == "N":
                    ways.append((more, "K", ((role, text),), i + 1, "S"))
                if role[:1] == due[0]:
                    ways.append((more, "K", ((role, text),), i + 1, behind))
                ways.append((3 + more, "R", ((due, text),), i + 1, behind))
        # at most two turns are inserted in one place
        ways.append((3, "I", ((due, ""),), i, behind))
        return ways

    @cache
    def best(i, state, inserted=0):
        found = []
        for way in rest(i, state):
            if len(way) == 3:
                found.append(way)
            elif way[1] != "I" or inserted < 2:
                cost, initials, turns = best(way[3], way[4], inserted + 1 if way[1] == "I" else 0)
                if initials is not None:
                    found.append((way[0] + cost, way[1] + initials, way[2] + turns))
        return min(found) if found else (1 << 30, None, ())

    for i in range(len(rows), -1, -1):
        for state in "NSUA":
            best(i, state)
    return best(0, "N")


def wanted(rows, ids):
    groups = {c: [] for c in ids}
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, text))
    out = []
    for conv, own in groups.items():
        own.sort()
        seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [t for given, t, *_ in own if given]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, said = cheapest(tuple(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    (None, None, None, None), (None, None, "user", "Hi."), (None, None, "user", "Hi."), (None, 3, "assistant", "Yes!"),
    (1001, None, "user", "first"), (1001, 0, "system", "S."), (1001, 0, "system", "S."), (1001, 1, "unknown", "what?"), (1001, 2, "tool", " \t\n "), (1001, 2, "", "x"),
    (1002, 5, "user", "a" * 300000 + "." + " " * 50000), (1002, 6, "assistant", "é😀.\x0b"), (1002, -3, "user", "Up ."), (1002, 9, "assistant", "ends "),
    *[(1003, t, "user", "Same.") for t in range(40)], *[(1003, 77, "assistant", "Copy.")] * 50,
    *[(1004, None, None, None)] * 30,
    (1005, 1, "assistant", "Only."), (1006, 1, "system", "Only."),
]


@pytest.mark.parametrize("log2_chunk", [repair.LOG2_CHUNK, 0, 2])
def test_as_by_trying_all_edits(spark, monkeypatch, log2_chunk):
    monkeypatch.setattr(repair, "LOG2_CHUNK", log2_chunk)
    rng = random.Random(log2_chunk)
    rows = list(ODD)
    for conv in range(300):
        for turn in range(rng.randint(0, 14)):
            text = rng.choice(["One.", "Two!", "Three", "", f"{turn}.", f"{turn}?", f"{turn}", " "])
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", None]), text))
    for turn in range(500):
        rows.append((2000, turn // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice([f"{turn}.", f"{turn}", "Twice."])))
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("clash").alias("at"), F.lit(1).alias("Text"), F.lit(2).alias("edits"), F.lit(3).alias("chunk"))
    assert got(repair.digest(repair.repair(repair.damage(given)), given)) == wanted(damaged(rows), {r[0] for r in rows})
    # undamaged rows, and the turns themselves
    done = repair.repair(given)
    assert got(repair.digest(done, given)) == wanted([(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows], {r[0] for r in rows})
    turns = repair.repaired_turns(done).filter("conv_id = 2000").orderBy("at", "place").collect()
    assert [t.role for t in turns][-2:] == ["user", "assistant"] and all(a.role != b.role for a, b in zip(turns, turns[1:]))


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_repair(spark, SF)) == wanted(damaged(rows), {r[0] for r in rows})


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.digest(repair.repair(repair.damage(empty)), empty).count() == 0
    assert repair.repaired_turns(repair.repair(empty)).count() == 0


def test_blocks_are_single_steps():
    t = repair.tables()
    rng = random.Random(1)
    for _ in range(500):
        symbols, vector = [rng.randrange(10) for _ in range(repair.BLOCK)], rng.randrange(len(t.vectors))
        costs = t.vectors[vector].tolist()
        for symbol in reversed(symbols):
            costs = repair._before(symbol, tuple(costs))
        number = int("".join(map(str, symbols)))
        norm, least = repair._norm(costs)
        assert tuple(t.vectors[t.block_step[number, vector]]) == norm and (least >= repair._FAR or t.block_fee[number, vector] == least)
