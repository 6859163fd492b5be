import json
from collections import defaultdict

import pytest

from palimpsest.llm import toolcalls as t

SCHEMA = json.dumps({"type": "object", "properties": {"q": {"type": "string", "maxLength": 5}, "n": {"type": "integer", "minimum": 1}}, "required": ["q"]})
NONE: list = []
CALLS = [
    (1, "a", 0, 0, "search", '{"q":"x", "n":2}', NONE),
    (1, "b", 1, 0, "search", '{"n":0}', ["c"]),
    (1, "c", 2, 0, "search", '{"q":"toolong"}', ["a"]),
    (1, "a", 3, 0, "search", "{}", NONE),
    (2, "d", 0, 0, "none", "not json", ["e"]),
    (2, "e", 0, 1, "search", '{"q":1}', ["d"]),
    (3, None, 0, 0, None, None, None),
    (3, "f", 5, 0, "none", "[1]", ["missing", "f2"]),
    (3, "f2", 4, 0, "search", '{"q":"é\\n"}', NONE),
]
RESULTS = [(1, "a", 4, "late"), (1, "a", 1, "early"), (1, "zz", 0, None), (1, None, 0, "x"), (3, "f2", 6, "ok")]


@pytest.fixture(scope="module")
def out(spark):
    schemas = spark.createDataFrame([("search", SCHEMA), ("search", SCHEMA)], "name string, schema string")
    linked = t.link(spark.createDataFrame(CALLS, t.CALLS), spark.createDataFrame(RESULTS, t.RESULTS))
    return t.serialise(t.order(linked), schemas).collect()


def test_nothing_is_lost(out):
    assert len([r for r in out if json.loads(r.json)["type"] == "call"]) == len(CALLS)
    assert sorted(str(r.status) for r in out) == sorted(["linked"] * 2 + ["unanswered"] * 4 + ["cycle"] * 2 + ["duplicate_call"] + ["orphan_result"] * 2 + ["duplicate_result"])


def test_order_is_topological(out):
    spot = {r.call_id: r.position for r in out if r.status in ("linked", "unanswered")}
    assert spot["a"] < spot["c"] < spot["b"] and spot["f2"] < spot["f"]
    by = defaultdict(list)
    for r in out:
        by[r.conv_id].append(r.position)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_links_and_errors(out):
    row = {(r.call_id, r.status): r for r in out}
    assert json.loads(row["a", "linked"].json)["content"] == "early" and row["a", "linked"].errors == []
    assert row["b", "unanswered"].errors == ["$.q: required", "$.n: below minimum"]
    assert row["c", "unanswered"].errors == ["$.q: too long"] and row["d", "cycle"].errors == ["$: not JSON"]
    assert row["e", "cycle"].errors == ["$.q: not string"] and row["f", "unanswered"].errors == ["$: unknown tool", "$.depends_on: missing missing"]
    assert row["f2", "linked"].json == '{"arguments":{"q":"é\\n"},"content":"ok","depends_on":[],"id":"f2","name":"search","status":"linked","type":"call"}'


def brute(rows):
    """Links of plain chats, message by message."""
    text = {(c, n): (role, x) for c, n, role, x in rows}
    want = set()
    for (c, n), (role, x) in text.items():
        if role == "user":
            reply = text.get((c, n + 1), (None, None))
            before = text.get((c, n - 2), (None, None))[0] == "user"
            made = {"arguments": {"prompt": x, "turn": n}, "content": reply[1] if reply[0] == "assistant" else None, "depends_on": [f"{c}:{n - 2}"] if before else [],
                    "id": f"{c}:{n}", "name": "reply", "status": "linked" if reply[0] == "assistant" else "unanswered", "type": "call"}
            want.add(t.canonical(made))
        elif role == "assistant" and text.get((c, n - 1), (None, None))[0] != "user":
            want.add(t.canonical({"content": x, "id": f"{c}:{n - 1}", "status": "orphan_result", "type": "result"}))
    return want


def test_given(spark):
    messages = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = t.format_chat(messages).collect()
    assert {r.json for r in got} == brute([tuple(r) for r in messages.select("conv_id", "turn", "role", "text").collect()])
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append((r.position, r.turn))
    assert all([x for _, x in sorted(v)] == sorted(x for _, x in v) for v in by.values())


def test_stated_calls_and_odd_rows(spark):
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"k","name":"reply","arguments":"{\\"prompt\\":\\"p\\",\\"turn\\":1}"}]}', 1),
        (1, 1, "tool", '{"tool_call_id":"k","content":"done"}', 1),
        (1, 1, "tool", '{"tool_call_id":"k","content":"done"}', 1),
        (None, None, "user", None, 1),
        (2, None, "assistant", "{", 1),
        (2, 0, None, "x", 1),
        (2, 0, "user", "x" * 100000, 1),
        (2, 0, "user", "again", 1),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, status int")
    got = t.format_chat(messages).collect()
    assert sorted(r.status for r in got) == ["duplicate_call", "duplicate_result", "linked", "orphan_result", "unanswered", "unanswered"]
    assert next(r for r in got if r.call_id == "k" and r.status == "linked").errors == []
    assert t.format_chat(messages.limit(0)).count() == 0


def test_every_turn_has_a_row(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, None, "x"), (1, 4, "critic", None), (1, 5, "assistant", '{"tool_calls":[]}')]
    got = t.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), every_turn=True).collect()
    assert [(r.turn, r.status) for r in sorted(got, key=lambda r: r.position)] == [(0, "system_turn"), (1, "linked"), (3, "other_turn"), (4, "other_turn"), (5, "orphan_result")]
    assert got and json.loads(next(r.json for r in got if r.turn == 0)) == {"content": "be brief", "role": "system", "status": "system_turn", "type": "turn"}


def test_deep_chains_are_no_cycles(spark):
    """A chain of 300 calls with one forward dependency, a ladder on it whose calls have two each, and a true cycle with a call behind it."""
    calls = [(1, f"c{i}", i, 0, "x", "{}", [f"c{i - 1}"] if i else ["late"]) for i in range(300)] + [(1, "late", 999, 0, "x", "{}", NONE)]
    calls += [(1, f"l{i}", 300 + i, 0, "x", "{}", ["c299", f"l{i - 1}"] if i else ["c299", "c5"]) for i in range(4)]
    calls += [(2, "p", 0, 0, "x", "{}", ["q"]), (2, "q", 1, 0, "x", "{}", ["p"]), (2, "r", 2, 0, "x", "{}", ["q"]), (2, "s", 3, 0, "x", "{}", ["r", "u"]), (2, "u", 4, 0, "x", "{}", NONE)]
    rows = t.order(t.link(spark.createDataFrame(calls, t.CALLS), spark.createDataFrame([], t.RESULTS))).collect()
    spot = {r.call_id: r.position for r in rows}
    assert {r.call_id for r in rows if r.status == "cycle"} == {"p", "q", "r", "s"} and len(rows) == len(calls)
    assert all(spot[d] < spot[c[1]] for c in calls if c[0] == 1 for d in c[6])


def test_identifiers_belong_to_their_conversation(spark):
    calls = [(c, "call_1", 0, 0, "x", "{}", NONE) for c in (1, 2, None)] + [(1, "call_2", 2, 0, "x", "{}", ["call_1", "call_9"]), (2, "call_9", 5, 0, "x", "{}", NONE)]
    results = [(1, "call_1", 1, "one"), (2, "call_1", 1, "two"), (None, "call_1", 1, "none"), (3, "call_1", 1, "three")]
    rows = t.order(t.link(spark.createDataFrame(calls, t.CALLS), spark.createDataFrame(results, t.RESULTS))).collect()
    got = sorted((str(r.conv_id), r.call_id, r.status, r.content, r.missing) for r in rows)
    want = [("1", "call_1", "linked", "one", None), ("1", "call_2", "unanswered", None, ["call_9"]), ("2", "call_1", "linked", "two", None), ("2", "call_9", "unanswered", None, None),
            ("3", "call_1", "orphan_result", "three", None), ("None", "call_1", "orphan_result", "none", None), ("None", "call_1", "unanswered", None, None)]
    assert got == want


def test_no_arguments_end_the_job(spark):
    many = "9" * 400
    bad = ["1e999", "-1e999", '"\\ud800"', '{"q":"\\udfff"}', "NaN", "[Infinity]", "9" * 5000, "", None, "{", '{"q":1,}', "\u0000"]
    good = [many, f'{{"q":"a","n":{many}}}', '{"q":"\\ud83d\\ude00"}', "1.5e308", "null", "true", "[[]]", '{"q":"a","n":1.0}', '{"n":0.5,"q":"a"}']
    calls = [(1, f"c{i}", i, 0, "search", a, NONE) for i, a in enumerate(bad + good)] + [(2, n, i, 0, n, '{"q":"a"}', NONE) for i, n in enumerate(["broken", "no", "any", "odd"])]
    calls.append((3, "deep", 0, 0, "search", "[" * 100000 + "]" * 100000, NONE))
    schemas = spark.createDataFrame([("search", SCHEMA), ("broken", "{"), ("no", "false"), ("any", "true"), ("odd", '{"type":["string","null"],"minimum":"x"}')], "name string, schema string")
    rows = t.serialise(t.order(t.link(spark.createDataFrame(calls, t.CALLS), spark.createDataFrame([], t.RESULTS))), schemas).collect()
    got = {r.call_id: r for r in rows}
    assert len(rows) == len(calls)
    assert got["deep"].errors in (["$: not JSON"], ["$: not object"])
    for i, text in enumerate(bad):
        assert got[f"c{i}"].errors == ["$: not JSON"] and json.loads(got[f"c{i}"].json)["arguments"] == text
    assert [got[f"c{len(bad) + i}"].errors for i in range(len(good))] == [["$: not object"], [], [], ["$: not object"], ["$: not object"], ["$: not object"], ["$: not object"], [], ["$.n: not integer", "$.n: below minimum"][:1]]
    assert [got[n].errors for n in ("broken", "no", "any", "odd")] == [["$: schema not readable"], ["$: not allowed"], [], ["$: not string or null"]]
