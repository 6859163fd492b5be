"""Dates in text: stated cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import dates as o

EVENTS = [
    ("我下個月十五號要去面試", "2026-06-01", None, "2026-07-15"), ("下个月十五号", "2026-06-01", None, "2026-07-15"), ("下個月五號", "2026-12-20", None, "2027-01-05"), ("2月30日", "2026-01-10", None, None),
    ("三日後", "2026-06-29", None, "2026-07-02"), ("十天后", "2026-06-01", None, "2026-06-11"), ("兩週後", "2026-06-01", None, "2026-06-15"), ("下個月底", "2026-01-31", None, "2026-02-28"), ("月底前要搬家", "2026-06-01", None, "2026-06-30"),
    ("下週五", "2026-06-01", None, "2026-06-12"), ("下個禮拜天", "2026-06-01", None, "2026-06-14"), ("周三", "2026-06-01", None, "2026-06-03"), ("週六去過那家店", "2026-01-20", None, "2026-01-17"), ("週六約好了要去爬山", "2026-01-20", None, "2026-01-24"),
    ("累死了，週六去爬山", "2026-01-20", None, "2026-01-24"), ("我週六過生日", "2026-01-20", None, "2026-01-24"), ("週二剛跑完步", "2026-01-20", None, "2026-01-20"), ("週六的報告寫完了", "2026-01-20", "2026-01-23", "2026-01-24"), ("週六在公園遇到她", "2026-01-20", "2026-01-17", "2026-01-17"),
    ("上週六去爬山", "2026-01-20", "2026-01-31", "2026-01-17"), ("今天聽說 2026.3.5 開會", "2026-01-20", None, "2026-03-05"), ("昨天很累", "2026-01-20", None, "2026-01-19"), ("3月5日去看醫生", "2026-06-01", None, "2026-03-05"), ("12/25 見", "2026-06-01", None, "2026-12-25"), ("", "2026-06-01", None, None), (None, "2026-06-01", None, None),
]


def test_event_dates(spark):
    df = spark.createDataFrame([(i, q, date.fromisoformat(r), h) for i, (q, r, h, _) in enumerate(EVENTS)], "entry_id int, quote string, ref date, hint string")
    got = {r.entry_id: str(r.event_date) for r in o.event_dates(df, "entry_id", "quote", "ref", "hint").collect()}
    assert got == {i: e[3] for i, e in enumerate(EVENTS) if e[3]}


def test_numbers(spark):
    words = {"15": 15, "十": 10, "十五": 15, "二十": 20, "三十一": 31, "兩": 2, "五": 5, "好": None, "二五": None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.n for r in df.select("w", o.number(F.col("w")).alias("n")).collect()} == words


def test_repair(spark):
    rows = [
        (1, "3月19日（週三）", "下週三", "2026-03-10"), (2, "8月12日（週六）", "週六", "2026-08-11"), (3, "3月19日（週三）", "3/19", "2026-03-10"), (4, "3月19日（週四）", "3/19", "2026-03-10"),
        (5, "3月19日（週三）", "下週三", None), (6, "約3月19日（週三）和2026年3月21日(星期天)。", "", "2026-03-10"), (7, "", None, "2026-03-10"), (8, None, None, "2026-03-10"),
    ]
    df = spark.createDataFrame(rows, "fragment_id int, content string, quote string, ref string")
    got = {r.fragment_id: (r.content, [f.how for f in r.fixes]) for r in o.repair_weekdays(df).collect()}
    assert got == {1: ("3月18日（週三）", ["relative"]), 2: ("8月15日（週六）", ["nearest"]), 3: ("3月19日（週四）", ["weekday"]), 6: ("約3月18日（週三）和2026年3月22日(星期天)。", ["nearest", "nearest"])}


def test_event_at_and_upcoming(spark):
    at = datetime(2026, 1, 20, 3)
    rows = [(1, "fact", "明天去", "2026-01-25", at), (2, "event", "明天去", None, at), (3, "event", "沒有", "2026-01-20", at), (4, "event", "沒有", "2026-02", at), (5, "event", None, "2026-13", at), (6, None, None, "2026-02-03", at)]
    df = spark.createDataFrame(rows, "entry_id int, type string, quote string, event_at string, raised_at timestamp")
    assert {r.entry_id: r.event_at for r in o.event_at(df).collect()} == {1: None, 2: "2026-01-21", 3: None, 4: "2026-02", 5: None, 6: "2026-02-03"}
    rows = [(1, 1, "明天去", at, None, "active"), (2, 1, "三天後", at, None, "active"), (3, 1, "十天後", at, None, "active"), (4, 1, "明天", at, None, "frozen"), (5, 1, None, at, date(2026, 1, 20), "active"), (6, 1, "昨天", at, None, "active")]
    df = spark.createDataFrame(rows, "fragment_id int, owner_id int, content string, created_at timestamp, event_at date, status string")
    assert [(r.fragment_id, r.days_until) for r in o.upcoming(df, F.lit(at)).orderBy("rank").collect()] == [(5, 0), (1, 1), (2, 3)]


@pytest.mark.parametrize("quote,want", [("b c", 2), ("zz", 1), (None, 1)])
def test_quote_dates(spark, quote, want):
    m = spark.createDataFrame([(1, "a b", datetime(2026, 1, 1)), (1, "b c", datetime(2026, 1, 2)), (1, "b c", None)], "batch_id int, content string, ts timestamp")
    e = spark.createDataFrame([(7, 1, quote)], "entry_id int, batch_id int, quote string")
    assert o.quote_dates(e, m).first().quoted_at == datetime(2026, 1, want)
