"""Model entries, queues and verdicts on small tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.operators import state as o

AT = datetime(2024, 6, 1)


def test_state_expiry(spark):
    rows = [(1, "physical", "days", None), (2, "other", "hours", None), (3, "relational", "until_event", None), (4, None, None, None), (5, "physical", "day", AT + timedelta(days=200)), (6, "physical", "day", AT + timedelta(days=2))]
    df = spark.createDataFrame([(*r, AT) for r in rows], "id int, c string, k string, stated timestamp, at timestamp")
    got = {r.id: (r.e - AT).total_seconds() / 3600 for r in df.select("id", o.state_expiry(F.col("at"), F.col("c"), F.col("k"), F.col("stated")).alias("e")).collect()}
    assert got == {1: 72, 2: 4, 3: 48, 4: 48, 5: 90 * 24, 6: 48}


def test_initial_confidence(spark):
    df = spark.createDataFrame([(1, "stable_trait", "direct_statement", 0.8), (2, "odd", "inferred", 0.9), (3, "odd", None, 0.9), (4, None, "direct_statement", 0.5)], "id int, t string, q string, c double")
    assert {r.id: round(r.x, 6) for r in df.select("id", o.initial_confidence(F.col("t"), F.col("q"), F.col("c")).alias("x")).collect()} == {1: 0.85, 2: 0.7, 3: 0.9, 4: 0.65}


def test_ascii_like(spark):
    df = spark.createDataFrame([("ABC",), ("xabcx",), ("Äbc",), (None,)], "v string")
    assert [r.m for r in df.select(o.ascii_like(F.col("v"), "%aBc%").alias("m")).collect()] == [True, True, False, None]
    assert [r.m for r in df.select(o.ascii_like(F.col("v"), "äbc").alias("m")).collect()] == [False, False, False, None]


def test_routing_creates_and_never_repeats(spark):
    f = spark.createDataFrame([(1, ["a", "a", "b"]), (2, None), (3, ["c"])], "fragment_id long, tags array<string>")
    routing = spark.createDataFrame([("a", "A", 0.85), ("b", "A", 0.6), ("c", "C", 0.6)], "tag string, name string, confidence double")
    entities, links = spark.createDataFrame([(9, "A")], "entity_id long, name string"), spark.createDataFrame([], "fragment_id long, entity_id long")
    new, missing = o.route_links(f, routing, entities, links)
    assert [tuple(r) for r in new.collect()] == [(1, 9, 0.85)] and [r.name for r in missing.collect()] == ["C"]
    assert o.route_links(f, routing, entities, new)[0].count() == 0


def test_proposals_and_verdicts(spark):
    found = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (4, 5)], "a long, b long")
    queue = o.queue_proposals(found, spark.createDataFrame([(4, 5, "rejected")], "a long, b long, status string"))
    assert sorted(map(tuple, queue.collect())) == [(1, 2, "pending"), (4, 5, "rejected")]
    done = o.decide_proposals(queue, spark.createDataFrame([(1, 2, True), (4, 5, True)], "a long, b long, accepted boolean"))
    assert sorted(map(tuple, done.collect())) == [(1, 2, "approved"), (4, 5, "rejected")]
    episodes = spark.createDataFrame([(1, 4.0, "permanent"), (2, 4.0, "permanent"), (3, 4.0, "mature")], "memory_id long, weight double, status string")
    verdicts = spark.createDataFrame([(1, "distorted"), (1, "distorted"), (2, "fabricated"), (2, "accurate")], "memory_id long, verdict string")
    assert sorted(map(tuple, o.apply_episode_verdicts(episodes, verdicts).collect())) == [(1, 2.0, "permanent"), (2, 4.0, "archived"), (3, 4.0, "mature")]


def test_browse_escapes_the_keyword(spark):
    e, links = spark.createDataFrame([(1,)], "entity_id long"), spark.createDataFrame([(1, 5), (1, 6)], "entity_id long, fragment_id long")
    f = spark.createDataFrame([(5, AT, "100% sure"), (6, AT, "100 sure")], "fragment_id long, created_at timestamp, content string")
    assert [(r.n_fragments, r.fragment_id) for r in o.browse(e, links, f, "0% S").collect()] == [(2, 5)]
