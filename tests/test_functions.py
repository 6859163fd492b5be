"""Anchor values of the column functions."""

import hashlib
import hmac
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring as s
from palimpsest.functions import text as t


@pytest.fixture(scope="module")
def ev(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first().x


def test_tokens(ev):
    tok = lambda x: ev(t.index_tokens(F.lit(x)))
    assert tok("動畫片") == ["動畫", "畫片"] and tok("我 iPhone 15") == ["我", "iphone", "15"] and tok("用Claude寫程式") == ["用", "claude", "寫程", "程式"]
    assert ev(t.index_tokens(F.lit(None).cast("string"))) == [] and tok("") == [] and tok("，。!") == []
    assert ev(t.query_tokens(F.lit("我在哪上班"))) == ["哪上", "上班"]


def test_normalise_folds(ev):
    same = lambda a, b: ev(t.normalise(F.lit(a))) == ev(t.normalise(F.lit(b)))
    assert same("妈妈生日", "媽媽生日") and same("ＡＢＣ　１２３", "abc123") and same("Hello, World!", "hello world") and not same("週三", "週五")
    assert ev(F.length(t.fold(F.lit("软件和内存")))) == 5 and ev(t.fold(F.lit("abc"))) == "abc"


def test_hash_and_hmac(ev):
    assert ev(t.hmac_sha256(F.lit("token"), b"key")) == hmac.new(b"key", b"token", hashlib.sha256).hexdigest()
    assert ev(t.content_hash(F.lit("A"), F.lit("b c"))) == hashlib.sha256(b"a\0bc").hexdigest()


def test_key_tokens(ev):
    assert ev(t.key_tokens(F.lit("週三下午3點"))) != ev(t.key_tokens(F.lit("週五下午3點"))) and ev(t.key_tokens(F.lit("貓"))) == ""


def test_intent_and_gate(ev):
    intent = lambda x: ev(t.intent(F.lit(x)))
    assert [intent(x) for x in ("以前看過什麼書", "最近如何", "多少錢", "3 元", "hello")] == ["long_term", "summary", "fact", "fact", "semantic"]
    gate = lambda x, e=False, c=False: ev(t.gate(F.lit(x), F.lit(e), F.lit(c)))
    assert gate("x", True) == "entity" and gate("那次真好") == "cue" and gate("嗯嗯") == "smalltalk" and gate("幫我開燈") == "command" and gate("abc") == "too_short"
    assert gate("we went hiking", c=True) == "continuation" and gate("is it so?") == "question" and gate("we went hiking") == "default"


@pytest.mark.parametrize(
    ("value", "want"),
    [("1700000000", datetime(2023, 11, 14, 22, 13, 20)), ("1700000000000", datetime(2023, 11, 14, 22, 13, 20)), ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02 03:04:05", datetime(2024, 1, 1, 19, 4, 5)), ("soon", None)],
)
def test_to_utc(ev, value, want):
    got = ev(F.date_format(t.to_utc(F.lit(value), "Asia/Taipei"), "yyyy-MM-dd HH:mm:ss"))
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


def test_slots(ev):
    assert [ev(t.day_slot(F.lit(h))) for h in (4, 5, 10, 11, 16, 17, 22, 23)] == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night"]


def test_ranking_anchors(ev):
    assert abs(ev(s.decay(F.lit(0.0), F.lit(0.5))) - (0.7 + 0.3 * 0.65)) < 1e-9
    assert ev(s.decay(F.lit(5.0), F.lit(0.0))) == ev(s.decay(F.lit(5.0), F.lit(0.5)))
    assert [ev(s.recency(F.lit(float(d)))) for d in (1, 3, 7, 8)] == [1.3, 1.15, 1.05, 1.0]
    assert abs(ev(s.novelty(F.lit(35))) - 0.39) < 0.01 and ev(s.novelty(F.lit(None).cast("long"))) == 1.0
    permission = lambda d, tier, src: ev(s.permission(F.lit(d), F.lit(tier), F.lit(src)))
    assert [permission(1.0, "high", "BOTH"), permission(30.0, "high", "BOTH"), permission(90.0, "high", "BOTH"), permission(1.0, "low", "FTS")] == ["cite", "cautious", "associate", "associate"]
    now = F.lit(datetime(2024, 1, 10)).cast("timestamp")
    assert ev(s.age_days(F.lit(None).cast("timestamp"), now)) == 365 and ev(s.age_days(F.lit(datetime(2024, 2, 1)).cast("timestamp"), now)) == 0
    assert abs(ev(s.faded(F.lit(1.0), F.lit(-1.0), F.lit(60.0))) - 0.5) < 1e-9 and abs(ev(s.faded(F.lit(1.0), F.lit(1.0), F.lit(120.0))) - 0.5) < 1e-9


def test_mention_weight_and_change(ev):
    assert ev(t.mention_weight(F.lit("媽媽ab"))) == 3.0 and ev(t.change_ratio(F.lit("abcd"), F.lit("abce"))) == 0.25
