"""An owner's few terms are looked for one by one, many by their runs: both find the same."""

from palimpsest.operators import context, linking, screening

TEXTS = [(o, 10 * o + i, x) for o in range(3) for i, x in enumerate(["Ann met Bob Ray", "bob ray again", "", None, "Canny annex of 动画"])]
TERMS = [(0, 1, "ann"), (0, 2, "bob ray"), (1, 1, "Ann"), (1, 3, "動畫"), (2, 4, "x"), (0, 1, "ann"), (None, 5, "ann")]


def test_mentions_within(spark):
    texts = spark.createDataFrame(TEXTS, "owner_id long, text_id long, content string")
    terms = spark.createDataFrame(TERMS, "owner_id long, entity_id long, term string")
    want = {(0, 1, "ann"), (4, 1, "ann"), (0, 2, "bob ray"), (1, 2, "bob ray"), (10, 1, "ann"), (14, 1, "ann"), (14, 3, "動畫")}
    for few in (0, 1, 9):
        got = [tuple(r) for r in linking.mentions_within(texts, terms, ["owner_id"], few).select("text_id", "entity_id", "term").collect()]
        assert set(got) == want and len(got) == len(want)


def test_triggered(spark):
    entries = spark.createDataFrame([(0, 1, ["Bob Ray", "zz"], "Ann met Bob Ray"), (1, 2, ["annex"], "q"), (2, 3, None, "Ann met Bob Ray")], "owner_id long, entry_id long, tags array<string>, content string")
    contexts = spark.createDataFrame(TEXTS, "owner_id long, context_id long, content string")
    stop = spark.createDataFrame([("zz",), ("Ray",)], "token string")
    want = {(1, 0, "tag"), (1, 1, "tag"), (2, 14, "tag"), (3, 20, "words")}  # "ob " stands in "bob ray again"
    for few in (0, 2, 99):
        assert {tuple(r) for r in screening.triggered(entries, contexts, stop, 4, few).collect()} == want


def test_intuition_names_of_the_owner_alone(spark):
    """An entity that another owner names in its own words isn't called to mind by them."""
    m = spark.sql("select * from values (0, 1, timestamp'2024-01-01', 'about ann'), (1, 2, timestamp'2024-01-01', 'about ann') as t(owner_id, msg_id, ts, content)")
    names = spark.createDataFrame([(0, 7, "ann"), (1, 7, "bob")], "owner_id int, entity_id int, term string")
    facts = spark.createDataFrame([(7, "is here")], "entity_id int, fact string")
    none = m.filter("false").selectExpr("owner_id", "msg_id as entry_id", "content", "ts as last_evidence_at", "ts as expires_at")
    got = context.intuition(m, none, names, facts, none.selectExpr("owner_id", "entry_id as pattern_id", "content"), 900).collect()
    assert [(r.msg_id, r.kind, r.item_id) for r in got] == [(1, "entity", 7)]
