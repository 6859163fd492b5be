"""Sums and roundings of doubles against the SQL, on rows whose means lie between two roundings."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__


def both(spark, folder, name):
    """Sorted rows of a query and of its SQL over the events of a folder."""
    df = __spark_entry__.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


def test_baseline_status_in_doubles(spark, tmp_path):
    """One owner's slots of which one lies between two thousandths."""
    spark.read.parquet("/root/testdata/sf0.01/events.parquet").filter("user_id = 97").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, tmp_path, "a26_baseline_status")
    assert got == want and len(got) == 5


def test_dominant_emotion_between_hundredths(spark, tmp_path):
    """42.75 / 150 is 0.285 by its shortest decimal, and less than that as a double."""
    rows = spark.createDataFrame([(i, 1, "view", 42.75) for i in range(3)] + [(3, 2, "click", 42.75), (4, 2, "view", 42.9), (5, 3, "cart", 120.0), (6, 3, "cart", None)], "event_id long, user_id long, event_type string, value double")
    rows.withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, tmp_path, "a35_dominant_emotion")
    assert got == want and len(got) == 3
