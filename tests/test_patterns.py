"""Patterns meet all messages and all patterns, whatever their ids."""

import pytest

import __spark_entry__


@pytest.fixture
def folder(spark, tmp_path):
    items = [(0, "one two three four"), (1, "one two three five"), (2, "six seven")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(1, 0, "user", "one two three four"), (2, 0, "user", "one two five three"), (3, 0, "user", "eight")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_match_across_owners(spark, folder):
    got = sorted(map(tuple, __spark_entry__.queries()["j20_pattern_match"](spark, folder).collect()))
    assert got == [(1000, 0, 1.0), (2000, 1, 1.0)]


def test_pairs_across_owners(spark, folder):
    got = sorted(map(tuple, __spark_entry__.queries()["j21_pattern_pairs"](spark, folder).collect()))
    assert got == [(0, 1, 0.75)]
