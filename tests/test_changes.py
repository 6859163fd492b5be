import uuid

import pytest

from palimpsest.operators import changes
from palimpsest.operators.tables import scratch
from palimpsest.plans.q_changes import RULES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())  # as text, in which a NaN equals itself


@pytest.mark.parametrize("rule", sorted(RULES))
def test_the_log_replays_its_run(spark, rule):
    """Old and log give new, new and log give old; a second run logs nothing and changes nothing."""
    read, step, keys = RULES[rule]
    old = read(spark, SF).cache()
    new = step(spark, SF)(old)
    new = new.select([c for c in old.columns if c in new.columns])
    log = changes.diff(old, new, keys, rule, "r").cache()
    assert log.count() > 0 and rows(changes.replay(old, log, keys)) == rows(new)
    assert rows(changes.replay(new, log, keys)) == rows(new) and rows(changes.undo(new, log, keys)) == rows(old.select(new.columns))
    book = changes.ChangeLog(spark, f"{scratch(spark)}/changes-{uuid.uuid4().hex}", keys)
    first = book.run(old, step(spark, SF), rule, "run-1")
    assert rows(first) == rows(new) and rows(book.log("run-1").select("action", "before", "after")) == rows(log.select("action", "before", "after"))

    def never(df):
        raise AssertionError("a logged run is made again")

    assert rows(book.run(old, never, rule, "run-1")) == rows(book.run(new, never, rule, "run-1")) == rows(new)


def test_nulls_and_kinds_of_change(spark):
    schema = "k long, j string, v double, tags array<string>"
    old = spark.createDataFrame([(1, "a", 1.0, ["x"]), (2, None, None, None), (None, "b", 0.0, []), (4, "d", float("nan"), ["y"])], schema)
    new = spark.createDataFrame([(1, "a", 1.0, ["x", "z"]), (2, None, None, None), (None, "b", None, []), (5, "e", 2.0, None), (4, "d", float("nan"), ["y"])], schema)
    log = changes.diff(old, new, ["k", "j"], "rule", "r")
    assert sorted((r.action, tuple(r.changed)) for r in log.collect()) == [("insert", ("k", "j", "v")), ("update", ("tags",)), ("update", ("v",))]
    assert rows(changes.replay(old, log, ["k", "j"])) == rows(new) and rows(changes.undo(new, log, ["k", "j"])) == rows(old)
    assert changes.diff(old.limit(0), new.limit(0), ["k"], "rule", "r").count() == 0
