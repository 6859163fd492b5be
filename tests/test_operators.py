"""Operators on small tables: anchors and properties."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as t
from palimpsest.operators import emotion, graph, linking, protection, recall, tables
from palimpsest.plans import registry
from palimpsest.sources import chat
from palimpsest.streaming import jobs

NOW = datetime(2024, 6, 1)
now = lambda: F.lit(NOW).cast("timestamp")
ago = lambda d: NOW - timedelta(days=d)


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([3, 4, 9, 1])], "k string, i int, c int")
    got = recall.take_within_budget(df, ["k"], [F.col("i")], F.col("c"), 10).collect()
    assert sorted(r.i for r in got) == [0, 1]


def test_fragment_gc_steps(spark):
    rows = [(1, "active", ago(20), None, ago(20), 0), (2, "active", ago(20), None, ago(20), 1), (3, "cooling", ago(90), None, ago(31), 0), (4, "cooling", ago(90), ago(1), ago(40), 0), (5, "frozen", ago(300), None, ago(91), 0), (6, "active", ago(13), None, ago(13), 0)]
    df = spark.createDataFrame([(*r, "text") for r in rows], "id int, status string, created_at timestamp, last_accessed_at timestamp, lifecycle_updated_at timestamp, cited_count int, content string")
    once = tables.fragment_gc(df, now())
    got = {r.id: (r.status, r.content) for r in once.collect()}
    assert got == {1: ("cooling", "text"), 2: ("active", "text"), 3: ("frozen", "text"), 4: ("active", "text"), 5: ("tombstone", "[expired]"), 6: ("active", "text")}
    later = {r.id: r.status for r in tables.fragment_gc(once.filter("id <> 4"), now()).collect()}
    assert later == {k: v[0] for k, v in got.items() if k != 4}


def test_episode_decay_and_weight(spark):
    df = spark.createDataFrame([(1, "permanent", None, 5.0, ago(200)), (2, "permanent", "flash", 5.0, ago(200)), (3, "mature", None, 2.0, ago(361)), (4, "permanent", None, 1.5, ago(200))], "id int, status string, consolidation_type string, weight double, updated_at timestamp").withColumn("last_accessed_at", F.lit(None).cast("timestamp"))
    got = {r.id: (r.status, r.weight) for r in tables.episode_decay(df, now()).collect()}
    assert got == {1: ("mature", 2.5), 2: ("permanent", 5.0), 3: ("archived", 2.0), 4: ("mature", 1.0)}
    w = spark.createDataFrame([(ago(0), ago(1)), (ago(65), None), (ago(900), None)], "c timestamp, a timestamp").select(tables.episode_weight(F.col("c"), F.col("a"), now()).alias("w"))
    assert [r.w for r in w.collect()] == [7, 4, 2]


def test_quotes(spark):
    messages = spark.createDataFrame([("b", "user", "I was at Home, today", ago(2)), ("b", "ai", "You were at home today?", ago(3)), ("c", "ai", "only mine", ago(1))], "batch_id string, sender string, content string, ts timestamp")
    entries = spark.createDataFrame([(1, "b", "x", "at home today"), (2, "b", "x", "at home tonight"), (3, "c", "x", "only mine"), (4, "b", "x", None), (5, "b", "x", "a" * 61), (6, "b", "x", "a")], "entry_id int, batch_id string, type string, quote string")
    got = {r.entry_id: (r.source, r.reason, r.first_at) for r in linking.verify_quotes(entries, messages).collect()}
    assert got[1] == ("user", None, ago(3)) and got[2][:2] == (None, "not_found") and got[3][:2] == ("ai", None)
    assert [got[i][1] for i in (4, 5, 6)] == ["missing", "too_long", "too_short"]


def test_near_duplicates_keep_facts_apart(spark):
    rows = [(1, "e", "我每個週三晚上都會去公園跑步運動"), (2, "e", "我每個週三晚上都會去公園跑步運動了"), (3, "e", "我每個週五晚上都會去公園跑步運動"), (4, "f", "我每個週三晚上都會去公園跑步運動")]
    df = spark.createDataFrame(rows, "fragment_id int, entity string, content string")
    assert {tuple(r) for r in linking.near_duplicates(df).collect()} == {(1, 2), (2, 1)}


def test_near_duplicates_equal_brute_force(spark):
    """Short and long texts, each with copies that gain, lose or change a letter, equal ones and ones of a single character."""
    import random

    rng, rows = random.Random(4), [(9000, "e", "好"), (9001, "e", "好 "), (9002, "f", "好"), (9003, "e", ""), (9004, "e", None), (9005, "e", "ab"), (9006, "e", "abc")]
    for i in range(40):
        base = "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥abcdefghijklmnop") for _ in range(rng.choice([4, 5, 6, 12, 16, 17, 18, 19, 40, 300])))
        rows += [(100 * i + 1, "e", base), (100 * i + 2, "e", base + "q"), (100 * i + 3, "e", base[:-1]), (100 * i + 4, "e", base[:2] + "Z" + base[3:]), (100 * i + 5, "e", base.upper()), (100 * i + 6, "e", base + "qr")]
    df = spark.createDataFrame(rows, "fragment_id int, entity string, content string")
    norm = [(r.fragment_id, r.entity, r.n, r.k) for r in df.select("fragment_id", "entity", t.normalise(F.col("content")).alias("n"), t.key_tokens(t.normalise(F.col("content"))).alias("k")).collect() if r.n]
    grams = {r[0]: {r[2][i : i + 2] for i in range(len(r[2]) - 1)} for r in norm}

    def same(x, y):
        a, b = grams[x[0]], grams[y[0]]
        near = a and b and x[3] == y[3] and len(a & b) >= 0.8 * len(a | b) and len(a ^ b) <= 1
        return x[1] == y[1] and (x[2] == y[2] or near)

    want = {(x[0], min(y[0] for y in norm if y[0] != x[0] and same(x, y))) for x in norm if any(y[0] != x[0] and same(x, y) for y in norm)}
    assert {tuple(r) for r in linking.near_duplicates(df).collect()} == want


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "we saw Alpha Beta there"), (2, "alpha only"), (3, "去看媽媽的動畫片")], "text_id int, content string")
    terms = spark.createDataFrame([(7, "alpha beta"), (8, "動畫片"), (9, "a")], "entity_id int, term string")
    assert {(r.text_id, r.entity_id) for r in linking.mention_join(texts, terms).collect()} == {(1, 7), (3, 8)}
    # inside longer words, of two characters, of several owners; a term none of whose runs stands in order isn't there
    texts = spark.createDataFrame([(1, 1, "Xalphabet"), (2, 2, "ALPHA bo"), (1, 3, "habo phalal"), (2, 4, None), (1, 5, "")], "owner_id int, text_id int, content string")
    terms = spark.createDataFrame([(1, 7, "alpha"), (1, 8, "bo"), (2, 9, "Bo"), (2, 10, "alphab"), (1, 11, "zz"), (1, 12, "xalphabet")], "owner_id int, entity_id int, term string")
    assert {(r.text_id, r.entity_id) for r in linking.mention_join(texts, terms, ("owner_id",)).collect()} == {(1, 7), (1, 12), (2, 9), (3, 8)}
    every = {(r.text_id, r.entity_id) for r in linking.mention_join(texts.drop("owner_id"), terms.drop("owner_id")).collect()}
    assert every == {(1, 7), (1, 10), (1, 12), (2, 7), (2, 8), (2, 9), (3, 8), (3, 9)}


def test_decayed_sums_do_not_depend_on_order(spark):
    rng = random.Random(3)
    events = [(1, ago(rng.uniform(0, 90)), float(rng.random() < 0.3), rng.random()) for _ in range(60)]
    rng.shuffle(events)
    got = emotion.decayed_stats(spark.createDataFrame(events, "k int, t timestamp, hit double, mag double"), ["k"]).first()
    n = hits = mag = 0.0
    last = None
    for _, t, h, m in sorted(events, key=lambda e: e[1]):
        f = 0.5 ** ((t - last).total_seconds() / 86400 / 30) if last else 1
        n, hits, mag, last = n * f + 1, hits * f + h, mag * f + m, t
    assert math.isclose(got.n, n, rel_tol=1e-9) and math.isclose(got.hits, hits, rel_tol=1e-9) and math.isclose(got.mag, mag, rel_tol=1e-9)


def observations(spark, n=400):
    rng = random.Random(1)
    rows = [(i % 3, i, "joy", min(1.0, max(0.0, rng.gauss(0.3, 0.1) + (0.6 if i in (310, 377) else 0))), datetime(2024, 1, 1) + timedelta(hours=3 * i)) for i in range(n)]
    return spark.createDataFrame(rows, "owner_id long, obs_id long, dim string, y double, t timestamp")


def test_filter_finds_shocks_and_stops_learning(spark):
    rows = {r.obs_id: r for r in emotion.replay(observations(spark)).collect()}
    assert len(rows) == 400 and rows[310].anomaly and rows[377].anomaly and sum(r.anomaly for r in rows.values()) < 40
    assert rows[0].learning and not rows[399].learning and abs(rows[0].mu - emotion.PRIOR_MU) < 1e-12


def test_stream_equals_replay(spark, tmp_path):
    obs = emotion.with_slot(observations(spark)).select("owner_id", "dim", "obs_id", "y", "slot", (F.unix_micros("t") / F.lit(3.6e9)).alias("hours"))
    for part in range(4):
        obs.filter(f"obs_id div 100 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {r.obs_id: r for r in jobs.run(jobs.online_baseline(stream), "append").collect()}
    want = {r.obs_id: r for r in emotion.replay(observations(spark)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k].z, want[k].z, abs_tol=1e-9) for k in want)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(1, 61).toDF("id")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60)], "a long, b long")
    got = {r.id: r.component for r in graph.components(nodes, pairs).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[60] == 50 and got[45] == 45


def test_protection(spark):
    keys = {"k1": b"a" * 32, "k2": b"b" * 32}
    df = spark.createDataFrame([(1, "Hello"), (2, None), (3, "plain")], "id int, v string")
    sealed = df.withColumn("v", F.when(F.col("id") < 3, protection.seal(F.col("v"), "t", "v", "k1", keys["k1"])).otherwise(F.col("v")))
    opened = protection.rotate(sealed, "t", ["v"], keys, "k2").select("id", protection.open_(F.col("v"), "t", "v", {"k2": keys["k2"]}).alias("v"), protection.open_(F.col("v"), "t", "w", keys).alias("w"))
    assert {r.id: (r.v, r.w) for r in opened.collect()} == {1: ("Hello", None), 2: (None, None), 3: ("plain", None)}
    with pytest.raises(ValueError):
        protection.rotate(sealed, "t", ["v"], {"k2": keys["k2"]}, "k2")
    like = sealed.select(protection.sealed_like(F.col("v"), "HEL%", "t", "v", keys).alias("x")).collect()
    assert [r.x for r in like] == [True, None, False]


def test_chat_sources(spark, tmp_path):
    files = {
        "a.json": '[{"role":"user","content":"hi"},{"role":"assistant","content":[{"type":"text","text":"yes<system_reminder>x</system_reminder>"},{"type":"image"}],"timestamp":1700000000}]',
        "b.jsonl": '{"sender":"me","text":"one","time":"2024-01-02 03:04:05"}\nnot json\n{"post_type":"message","user_id":1,"self_id":1,"raw_message":"bot"}',
        "c.txt": "[2024-01-01 10:00] me: hello: there\n2024-01-01 11:00 Bot：fine\nno name\n\nEmpty:",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = Counter((r.file.rsplit("/", 1)[1], r.sender, r.content, r.ts is not None) for r in chat.read_chat(spark, str(tmp_path)).collect())
    assert got == Counter([("a.json", "user", "hi", False), ("a.json", "ai", "yes", True), ("b.jsonl", "user", "one", True), ("b.jsonl", "ai", "bot", False), ("c.txt", "user", "hello: there", True), ("c.txt", "ai", "fine", True), ("c.txt", "user", "no name", False)])


def test_replies(spark):
    rows = [(1, '{"entries":[{"a":1},{"b":[2]}]}'), (2, 'Sure: {"entries":[{"a":1},{"b":"x]"},{"c":'), (3, "nothing"), (4, '{"entries":[{"a":1}]} and more'), (5, None)]
    entries, status = chat.parse_replies(spark.createDataFrame(rows, "reply_id int, reply string"))
    assert {r.reply_id: (r.n, r.truncated) for r in status.collect()} == {1: (2, False), 2: (2, True), 3: (0, True), 4: (1, False), 5: (0, True)}
    assert sorted((r.reply_id, r.entry) for r in entries.collect())[2] == (2, '{"a": 1}')


def test_export_and_import(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "id long, name string, ids array<long>")
    chat.export_store({"t": df, "u": df}, str(tmp_path / "x"))
    lines = spark.read.text(str(tmp_path / "x"))
    target = spark.createDataFrame([(2, "kept", None)], df.schema)
    ids = lambda mode: {r.id: r.name for r in chat.import_store(lines, target, "t", ["id"], mode).collect()}
    assert ids("ignore") == {1: "a", 2: "kept"} and ids("merge") == {1: "a", 2: None}


def test_dialogues(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"conv_id":"c","conversation":{"session_1":[{"dia_id":"D1:1","speaker":"A","text":"x"},{"dia_id":"D1:2","speaker":"B","text":"y"}],"session_1_date_time":"1:56 pm on 8 May, 2023"},"qa":[{"question":"q","answer":"a","category":1,"evidence":["D1:2; D9:9"]}]}')
    turns, qa = chat.read_dialogues(spark, str(tmp_path))
    assert [r.ts for r in turns.collect()] == [datetime(2023, 5, 8, 13, 56)] * 2 and qa.first().evidence == ["D1:2"]
    assert chat.shift_timeline(turns, now()).first().ts == ago(1)


def test_no_cross_joins_and_no_row_python(spark):
    for name in ("r1_recall", "j7_mention_join", "p1_verify_quotes", "t1_fragment_gc", "j23_cooccurring", "e3_blind_index"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name


def test_every_sql_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_emotion_maps(spark):
    rows = [({"Happy": "0.7", "anger": "2", "x": "1"},), ({},), ({"x": "1"},), ({"joy": "-1", "happy": "0.2"},), (None,)]
    df = spark.createDataFrame(rows, "m map<string,string>").select(emotion.sanitise(F.col("m"), {"happy": "joy"}, ["joy", "anger"]).alias("m"))
    assert [r.m for r in df.collect()] == [{"joy": 0.7, "anger": 1.0}, {}, None, {"joy": 0.2}, None]


def test_pairs_of_large_groups(spark):
    """A day of many entities: blocks give each pair once, and entities that can't reach the best pairs aren't paired."""
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 5), (2, 7), (3, 9)], "g int, x int")
    got = [tuple(r) for r in linking.pairs_within(rows, "g", "x", 40).collect()]
    assert len(got) == len(set(got)) == 300 * 299 // 2 + 1 and set(got) == {(1, i, j) for j in range(300) for i in range(j)} | {(2, 5, 7)}
    rng = random.Random(6)
    few = [(f, rng.randrange(60)) for f in range(300) for _ in range(6)]
    hot = spark.range(100_000).selectExpr("cast(9999 as int) as fragment_id", "cast(id + 1000 as int) as entity_id")
    links = spark.createDataFrame(few, "fragment_id int, entity_id int").union(hot)
    entities = links.select("entity_id").distinct().withColumn("status", F.lit("active"))
    want = {}
    for f in range(300):
        own = sorted({e for g, e in few if g == f})
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                want[x, y] = want.get((x, y), 0) + 1
    best = sorted(((-n, x, y) for (x, y), n in want.items() if n >= 2))[:30]
    assert [(-r.shared, r.a, r.b) for r in linking.cooccurring(links, entities, 2, 30, 40).collect()] == best
