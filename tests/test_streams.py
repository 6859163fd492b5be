"""Stateful streams against batch operators and plain loops."""

import random
import time
import uuid
from collections import defaultdict

from palimpsest.operators import evidence
from palimpsest.operators.tables import scratch
from palimpsest.plans import q_evidence, q_streaming
from palimpsest.sources import adapter as a
from palimpsest.streaming import jobs

SF = "/root/testdata/sf0.001"


def batches(rows, end):
    """Batches of each chat by asking at every second at which something may be due, up to ``end``."""
    chats, out = defaultdict(list), []
    for chat, msg, at, strong in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        chats[chat].append((at, msg, strong))
    for chat, messages in chats.items():
        wait, went = [], None
        moments = sorted({(at + more, late) for at, *_ in messages for more, late in ((0, 1), (1200, 0), (14400, 0))})
        for now, arrivals in moments:
            if now > end and not arrivals:
                break
            # what is due without a message comes before those of that second
            for message in [None, *([m for m in messages if m[0] == now] if arrivals else [])]:
                wait += [message] if message else []
                silent = bool(wait) and now - wait[-1][0] >= 1200
                stale = len(wait) >= 30 and (went is None or now - went >= 14400)
                why = "force" if len(wait) >= 100 else "stale" if stale else "emotion" if silent and any(w[2] for w in wait) else "silence" if silent and len(wait) >= 60 else None
                if why:
                    out += [(chat, why, part[0][1], part[-1][1], len(part)) for part in (wait[i : i + 60] for i in range(0, len(wait), 60))]
                    wait, went = [], wait[-1][0]
    return sorted(out)


def streamed(spark, parts, schema, job):
    """The rows of a job over a folder of one file a batch, in the order of ``parts``."""
    folder = f"{scratch(spark)}/parts-{uuid.uuid4().hex}"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(0.01)  # files are read by their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return [tuple(r) for r in jobs.run(job(stream), "append").drop("batch_id").collect()]


def test_extraction_batches(spark):
    got = sorted((r.chat_id, r.reason, r.first_id, r.last_id, r.n) for r in q_streaming.extraction(spark, SF).collect())
    rows = [(r.user_id % 5, r.event_id, r.s, r.event_id % 40 == 0) for r in a.read(spark, SF, "events").selectExpr("user_id", "event_id", "floor(unix_micros(cast(ts as timestamp)) / 1e6) as s").collect()]
    assert got == batches(rows, max(r[2] for r in rows)) and len({r[1] for r in got}) >= 2


def test_a_silent_chat_goes_by_the_watermark_alone(spark):
    """The first chat's messages end, and its batches go as the other chat's time passes; however the messages are dealt into batches."""
    rng = random.Random(4)
    rows = [(1, i, 1000 + 10 * i, False) for i in range(70)] + [(2, 500 + i, 1000 + 60 * i, i == 50) for i in range(90)] + [(3, 900, 1500, True), (3, 901, 6000, True)]
    rows = sorted({r[2]: r for r in rows}.values(), key=lambda r: r[2])  # no two at once: a batch's rows have to be later than the last one's
    schema = "chat_id long, msg_id long, at long, strong boolean"
    want = batches(rows, max(r[2] for r in rows))
    assert {(1, "stale"), (1, "silence"), (3, "emotion")} & {r[:2] for r in want} and (3, "emotion", 900, 900, 1) in want
    assert not any(r[2] == 901 for r in want)  # its silence lies beyond the watermark
    for cuts in ([], sorted(rng.sample(range(1, len(rows)), 3))):
        parts = [rows[lo:hi] for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        assert sorted(streamed(spark, parts, schema, lambda df: jobs.extraction_batches(df, "0 seconds"))) == want


def test_entities_are_known_for_half_an_hour(spark):
    rows = [(o, m, 1000 + 60 * at, e) for o, m, at, e in [(1, 1, 0, [7]), (1, 2, 29, []), (1, 3, 31, []), (1, 4, 40, [8, 9]), (1, 5, 50, [8]), (1, 6, 75, None), (2, 7, 76, [])]]
    schema = "owner_id long, msg_id long, at long, entity_ids array<long>"
    want = [(1, 1, []), (1, 2, [7]), (1, 3, []), (1, 4, []), (1, 5, [8, 9]), (1, 6, [8]), (2, 7, [])]
    for parts in ([rows], [rows[:1], rows[1:3], rows[3:6], rows[6:]]):
        assert sorted(streamed(spark, parts, schema, lambda df: jobs.entity_cache(df, "1 second"))) == want


def test_rules_of_pending():
    def fed(n, step, strong=(), went=0.0):
        p, out = jobs.Pending([(went, None, None)]), []
        for i in range(n):
            out += p.due(i * step) + p.arrive(i * step, i, i in strong)
        return p, out

    assert fed(100, 1)[1] == [("force", 0, 59, 60), ("force", 60, 99, 40)]
    p, out = fed(60, 1)
    assert not out and p.next() == 59 + 1200 and not p.due(1258) and jobs.Pending(p.rows()).due(1259) == [("silence", 0, 59, 60)]
    p, out = fed(3, 1, strong=[1])
    assert not out and p.due(5000) == [("emotion", 0, 2, 3)] and p.next() is None and p.rows() == [(2, None, None)]
    p, out = fed(40, 500)
    assert out == [("stale", 0, 29, 30)] and p.next() is None
    # where none went yet, thirty are enough
    p = jobs.Pending()
    assert [b for i in range(30) for b in p.arrive(i, i, False)] == [("stale", 0, 29, 30)]


def test_stream_of_states_equals_batch(spark):
    key = lambda r: (r.owner_id, r.statement_id, r.action, r.state_id, r.replaces)
    rows = q_streaming.states(spark, SF).collect()
    assert sorted((key(r) for r in rows if r.action != "expired"), key=str) == sorted(map(key, q_evidence.states(spark, SF).collect()), key=str)
    ended = [(r.owner_id, r.state_id) for r in rows if r.action == "expired"]
    made = {(r.owner_id, r.state_id) for r in rows if r.action == "created"}
    assert ended and len(set(ended)) == len(ended) and set(ended) <= made
    assert {"created", "updated", "skipped"} & {r.action for r in evidence.upsert_states(a.messages(spark, SF).selectExpr("owner_id", "msg_id as statement_id", "ts as at", "'companion' as by", "content", "40 as ttl")).collect()}


def test_a_state_ends_by_its_timer(spark):
    rows = [(1, 10, 10.0, "companion", 100.0, ["a", "b"], ["aa"]), (2, 11, 50.0, "companion", None, ["c"], ["cc"]), (2, 12, 1000.0, "companion", 5.0, ["d"], ["dd"])]
    schema = "owner_id long, statement_id long, at double, by string, ttl double, tokens array<string>, words array<string>"
    got = streamed(spark, [rows[:1], rows[1:2], rows[2:]], schema, lambda df: jobs.current_states(df, "1 second"))
    assert sorted(got, key=str) == sorted([(1, 10, "created", 10, None), (2, 11, "created", 11, None), (2, 12, "created", 12, None), (1, None, "expired", 10, None)], key=str)


def test_idle_once_in_a_week():
    own, hours = jobs.Idle(), [0, 1, 8, 9, 20, 168, 177, 360]
    assert [h for h in hours if own.write(h * 3600)] == [8, 177, 360]


def test_a_key_gives_its_rows_in_frames():
    """A batch's rows of a key become objects, and frames of the result, a few at a time."""
    import pandas as pd
    import pyarrow as pa

    class Kept:
        get, put, clear = (lambda self: []), (lambda self, rows: None), (lambda self: None)

    class Handle:
        getListState, listTimers, registerTimer = (lambda self, name, schema: Kept()), (lambda self: []), (lambda self, at: None)

    step = lambda own, r: [(r.msg_id, own.known(), [own.put(r.at, int(x)) for x in r.entity_ids])[:2]]
    timed = jobs.Timed(jobs.Recent, "at double, item long", step, ["at", "msg_id"], "owner_id long, msg_id long, known array<long>", pa.schema([("msg_id", pa.int64()), ("at", pa.int64()), ("entity_ids", pa.list_(pa.int64()))]))
    timed.FRAME = 4
    timed.init(Handle())
    frames = (pd.DataFrame({"owner_id": 7, "msg_id": [i, 20 - i], "at": [i, 20 - i], "entity_ids": [[], [20 - i]]}) for i in range(10))
    out = list(timed.handleInputRows((7,), frames, None))
    assert [len(x) for x in out] == [4, 4, 4, 4, 4]
    rows = pd.concat(out)
    assert list(rows.msg_id) == [*range(10), *range(11, 21)] and rows.known.iloc[-1] == list(range(11, 20)) and set(rows.owner_id) == {7}
