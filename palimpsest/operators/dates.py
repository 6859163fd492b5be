"""Dates named in Chinese text, relative to the day it was written: mentions, event dates, upcoming events, weekday repair.

A text is split into clauses and one pattern finds the mentions of each clause from left to right; every mention is a small row, so
long texts never travel. Numbers are Arabic or Chinese, weeks start on Monday. Null and empty texts name no date; days that do not
exist (30 February) name none either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .recall import top_n
from .tables import settle

#: Numerals, weekdays, day words with their offsets, tense words, types without a time.
DIGITS, VALUES = "零〇一二兩三四五六七八九", "001223456789"
NUMBER = f"(?:[0-9]{{1,3}}|[{DIGITS}十]{{1,3}})"
WEEK, WEEKDAYS = "(?:週|周|星期|禮拜|礼拜)", "一二三四五六日"
DAY_WORDS = {"大後天": 3, "後天": 2, "明天": 1, "明日": 1, "大前天": -3, "前天": -2, "昨天": -1, "昨日": -1, "昨晚": -1, "今天": 0, "今日": 0, "今晚": 0, "今早": 0, "今晨": 0}
DONE = "了|(?<!不)過(?![來去幾生年節夜]|日子)|剛|刚"
PLANNED = "要|會|打算|準備|准备|預計|预计|計畫|計劃|计划|將|将|想去|約好|约好|排了"
CLAUSE_END = r"[，,。．；;！!？?\n]|(?<![0-9])\.|\.(?![0-9])"
TIMELESS = ["preference", "fact", "entity_new", "reflection"]

#: The forms of a mention, the strongest first where two name the same day.
FORMS = {
    "full": r"([0-9]{4})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})\s*[日號]?",
    "day_of_month": rf"(下個?|上個?|這個?|本)月\s*({NUMBER})\s*[日號]",
    "month_end": r"(下個?|上個?|這個?|本)?月底",
    "days_later": rf"({NUMBER})\s*個?\s*[天日]\s*[之以]?後",
    "weeks_later": rf"({NUMBER})\s*個?\s*{WEEK}\s*[之以]?後",
    "days_ago": rf"({NUMBER})\s*個?\s*[天日]\s*[之以]?前",
    "month_and_day": rf"({NUMBER})\s*月\s*({NUMBER})\s*[日號]",
    "slash": r"(?<![0-9/])([0-9]{1,2})/([0-9]{1,2})(?![0-9/])",
    "weekday": rf"(上個?|下個?|這個?|本個?)?{WEEK}([{WEEKDAYS}天])",
    "word": "|".join(DAY_WORDS),
}
ANY = "|".join(FORMS.values())
NUMBERS = rf"[0-9]+|[{DIGITS}十]+"
#: What every mention holds; cheap to look for in texts without one.
HINT = "[月日週周期拜後前天今昨/]|[0-9]{4}[-.年]"
STATED = rf"(?:([0-9]{{4}})年)?([0-9]{{1,2}})月([0-9]{{1,2}})[日號号]\s*([（(])\s*({WEEK})([{WEEKDAYS}天])\s*([）)])"


def number(text: Column) -> Column:
    """Arabic numbers, one Chinese digit, or Chinese tens (十五, 二十, 三十一); null for anything else."""
    digits = F.translate(text, DIGITS, VALUES)
    part = lambda i, missing: F.coalesce(F.regexp_extract(digits, "^([1-9]?)十([1-9]?)$", i).try_cast("int"), F.lit(missing))
    return F.when(text.rlike("^[0-9]+$") | (F.length(text) == 1) & digits.rlike("^[0-9]$"), digits.try_cast("int")).when(digits.rlike("^[1-9]?十[1-9]?$"), part(1, 1) * 10 + part(2, 0))


def day(year: Column, month: Column, of_month: Column) -> Column:
    """The date, or null where there is none such."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), of_month.cast("string")).try_cast("date")


def occurrence(month: Column, of_month: Column, ref: Column, nearest: bool, ahead: int = 240) -> Column:
    """A date without a year. Next: the first from ``ref`` on. Nearest: that, if it is at most ``ahead`` days off, else the last before."""
    years = lambda low, high: [day(F.year(ref) + i, month, of_month) for i in range(low, high)]
    if not nearest:
        return F.coalesce(*[F.when(d >= ref, d) for d in years(0, 5)])
    future, past = F.coalesce(*[F.when(d >= ref, d) for d in years(0, 2)]), F.coalesce(*[F.when(d < ref, d) for d in reversed(years(-1, 1))])
    return F.when(F.datediff(future, ref) <= ahead, future).otherwise(F.coalesce(past, future))


def _resolved(rule: str, text: Column, numbers: Column, ref: Column, done: Column, nearest: bool) -> Column:
    """The date of one form's mention with its numbers."""
    n = lambda i: F.get(numbers, i)
    within = lambda most: F.when(n(0).between(1, most), n(0))
    months = F.when(text.startswith("下"), 1).when(text.startswith("上"), -1).otherwise(0)
    if rule == "full":
        return day(n(0), n(1), n(2))
    if rule == "day_of_month":
        month = F.add_months(F.trunc(ref, "month"), months)
        return day(F.year(month), F.month(month), n(0))
    if rule == "month_end":
        return F.last_day(F.add_months(F.trunc(ref, "month"), months))
    if rule in ("days_later", "days_ago"):
        return F.date_add(ref, within(730) * (1 if rule == "days_later" else -1))
    if rule == "weeks_later":
        return F.date_add(ref, within(104) * 7)
    if rule in ("month_and_day", "slash"):
        return occurrence(n(0), n(1), ref, nearest)
    if rule == "weekday":
        place = weekday_index(text)
        monday, forward = F.date_sub(ref, F.weekday(ref)), F.pmod(place - F.weekday(ref), F.lit(7))
        week = F.when(text.startswith("上"), -7).when(text.startswith("下"), 7).when(text.rlike("^[這本]"), 0)
        bare = F.date_add(ref, forward - F.when(done & (forward > 0), 7).otherwise(0))
        return F.when(week.isNotNull(), F.date_add(monday, place + week)).otherwise(bare)
    offsets = F.create_map(*[F.lit(x) for pair in DAY_WORDS.items() for x in pair])
    return F.date_add(ref, offsets[text])


def weekday_index(name: Column) -> Column:
    """0 (Monday) to 6 by the last character."""
    return F.instr(F.lit(WEEKDAYS), F.translate(F.right(name, F.lit(1)), "天", "日")) - 1


def mentions(df: DataFrame, keys: list[str], text: str, ref: str, past: bool = False, nearest: bool = False) -> DataFrame:
    """keys, ref, clause, place, mention, form, date, weak, before, after: one row for each date that a text names.

    ``past`` also takes what has happened (last week, days ago, yesterday) and reads the tense of a bare weekday's clause; such a
    weekday carries the days ``before`` and ``after`` that it may mean. Today and yesterday are weak: they only place the telling.
    """
    may = lambda c: c.rlike(HINT)
    named = df.filter(F.col(ref).isNotNull() & may(F.col(text)))
    clauses = named.select(*keys, F.col(ref).cast("date").alias("_ref"), F.posexplode_outer(F.filter(F.split(F.col(text), CLAUSE_END, -1), may)).alias("clause", "_text"))
    clauses = clauses.withColumn("_text", t.fold(F.col("_text")))
    done = F.col("_text").rlike(DONE) & ~F.col("_text").rlike(PLANNED) if past else F.lit(False)
    form = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), i) for i, p in enumerate(FORMS.values())])
    part = lambda m: F.struct(m.alias("mention"), form(m).alias("form"), F.transform(F.regexp_extract_all(m, F.lit(NUMBERS), F.lit(0)), number).alias("numbers"))
    found = F.transform(F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)), part)
    rows = clauses.select(*keys, "_ref", done.alias("_done"), "clause", F.posexplode_outer(found).alias("place", "_m"))
    rows = rows.select(*keys, "_ref", "_done", "clause", "place", F.col("_m.mention").alias("mention"), F.col("_m.form").alias("_form"), F.col("_m.numbers").alias("_numbers"))
    m, at, names = F.col("mention"), F.col("_form"), list(FORMS)
    date = F.coalesce(*[F.when(at == i, _resolved(rule, m, F.col("_numbers"), F.col("_ref"), F.col("_done"), nearest)) for i, rule in enumerate(names)])
    gone = m.startswith("上") | (at == names.index("days_ago")) | m.isin([w for w, n in DAY_WORDS.items() if n <= 0])
    dated = rows.withColumn("date", date).filter(F.col("date").isNotNull() & (F.lit(past) | ~gone))
    bare = F.lit(past) & m.rlike(f"^{WEEK}") & (at == names.index("weekday")) & (F.col("date") != F.col("_ref"))
    late = F.col("date") > F.col("_ref")
    dated = dated.withColumn("weak", m.isin([w for w, n in DAY_WORDS.items() if n <= 0])).withColumn("before", F.when(bare, F.when(late, F.date_sub("date", 7)).otherwise(F.col("date")))).withColumn("after", F.when(bare, F.when(late, F.col("date")).otherwise(F.date_add("date", 7))))
    once = top_n(dated, [*keys, "date"], [F.asc("_form"), F.asc("clause"), F.asc("place")], 1, "_nth")
    return once.withColumn("form", F.element_at(F.array(*[F.lit(n) for n in names]), at + 1)).select(*keys, F.col("_ref").alias("ref"), "clause", "place", "mention", "form", "date", "weak", "before", "after")


def event_dates(df: DataFrame, key: str, text: str, ref: str, hint: str | None = None) -> DataFrame:
    """(key, event_date): the first strong mention of a text, a weak one if there is no other. A bare weekday means the day nearer
    to ``hint``, a date from elsewhere, if there is one; else its clause's tense decides."""
    found = mentions(df, [key], text, ref, past=True, nearest=True)
    first = found.groupBy(key).agg(F.min(F.struct("weak", "clause", "place", "date", "before", "after")).alias("m")).select(key, "m.date", "m.before", "m.after")
    if hint is None:
        return first.select(key, F.col("date").alias("event_date"))
    hints = df.select(key, F.col(hint).cast("date").alias("_hint")).filter("_hint is not null")
    far = lambda c: F.abs(F.datediff("_hint", c))
    chosen = F.when(far("before") < far("after"), F.col("before")).when(far("after") < far("before"), F.col("after")).otherwise(F.col("date"))
    return first.join(hints, key, "left").select(key, chosen.alias("event_date"))


def event_at(entries: DataFrame, zone: str = "UTC") -> DataFrame:
    """entry_id, event_at (``YYYY-MM-DD`` or ``YYYY-MM``) of entries (entry_id, type, quote, event_at, raised_at): none for types
    without a time; the date that the quote names; else the stated one, unless it only repeats the day of the message."""
    local, utc = F.date_format(F.from_utc_timestamp("raised_at", zone), "yyyy-MM-dd"), F.date_format("raised_at", "yyyy-MM-dd")
    given = F.trim("event_at")
    valid = given.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$") & given.try_cast("date").isNotNull()
    own = F.when(valid & ~F.coalesce(given.isin(local) | given.isin(utc), F.lit(False)), given)
    timed = entries.withColumn("_own", own).withColumn("_day", local.cast("date")).withColumn("_hint", F.when(F.length("_own") == 10, F.col("_own")))
    named = event_dates(timed.filter(~F.coalesce(F.col("type").isin(TIMELESS), F.lit(False))), "entry_id", "quote", "_day", "_hint")
    said = F.coalesce(F.date_format("event_date", "yyyy-MM-dd"), F.col("_own"))
    return timed.join(named, "entry_id", "left").select("entry_id", F.when(~F.coalesce(F.col("type").isin(TIMELESS), F.lit(False)), said).alias("event_at"))


def quote_dates(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """(entry_id, quoted_at): the time of the first message of the batch that holds the quote, else of the batch's first message."""
    m = messages.select("batch_id", F.col("content").alias("_text"), F.col("ts").alias("_ts")).filter("_ts is not null")
    quote = F.trim(F.coalesce("quote", F.lit("")))
    both = entries.select("entry_id", "batch_id", quote.alias("_quote")).join(m, "batch_id")
    held = F.when((F.col("_quote") != "") & F.contains("_text", "_quote"), F.col("_ts"))
    return both.groupBy("entry_id").agg(F.coalesce(F.min(held), F.min("_ts")).alias("quoted_at"))


def upcoming(fragments: DataFrame, now: Column, days: int = 7, lookback: int = 180, most: int = 3) -> DataFrame:
    """The first ``most`` events of each owner within ``days`` from now: active fragments' event dates or, without one, the dates that
    a text of the last ``lookback`` days names. owner_id, fragment_id, event_date, days_until, rank."""
    today = F.to_date(now)
    live = fragments.filter("status = 'active'").select("fragment_id", "owner_id", "content", F.to_date("created_at").alias("_day"), F.col("event_at").cast("date").alias("event_date"))
    stated = live.filter("event_date is not null").select("owner_id", "fragment_id", "event_date")
    told = mentions(live.filter(F.col("event_date").isNull() & (F.datediff(today, "_day") <= lookback)), ["owner_id", "fragment_id"], "content", "_day")
    # the terms that find a date are more than a sort's generated code may hold
    told = settle(told.select("owner_id", "fragment_id", F.col("date").alias("event_date")))
    dates = stated.unionByName(told).withColumn("days_until", F.datediff("event_date", today)).filter(F.col("days_until").between(0, days))
    one = dates.groupBy("owner_id", "fragment_id").agg(F.min("event_date").alias("event_date"), F.min("days_until").alias("days_until"))
    return top_n(one, ["owner_id"], [F.asc("days_until"), F.asc("fragment_id")], most)


def repair_weekdays(df: DataFrame, key: str = "fragment_id") -> DataFrame:
    """(key, content, fixes) of the rows whose content states dates with a wrong weekday, like 3月19日（週三）, repaired.

    ``df`` has content, quote (what was said) and ref (the day of saying it). A date that the quote names keeps and gets its weekday;
    else the weekday holds: the one quoted date of that weekday, or the nearest day within three. A bare weekday in the quote is no date.
    """
    rows = df.select(key, "content", "quote", F.col("ref").cast("date").alias("ref")).filter(F.col("ref").isNotNull() & F.col("content").rlike(STATED))
    found = rows.select(key, "ref", F.posexplode_outer(F.regexp_extract_all("content", F.lit(STATED), F.lit(0))).alias("place", "was"))
    found = found.withColumn("numbers", F.transform(F.regexp_extract_all("was", F.lit("[0-9]+"), F.lit(0)), number))
    n, has_year = lambda i: F.element_at("numbers", i), F.size("numbers") == 3
    stated = F.when(has_year, day(F.get("numbers", F.lit(0)), n(-2), n(-1))).otherwise(occurrence(n(-2), n(-1), F.col("ref"), True))
    found = found.withColumn("stated", stated).withColumn("name", F.regexp_extract("was", STATED, 6)).withColumn("want", weekday_index(F.col("name")))
    wrong = found.filter(F.col("stated").isNotNull() & (F.weekday("stated") != F.col("want")))
    quotes = rows.withColumn("_quote", F.regexp_replace("quote", f"(?<![上下這这本個个]){WEEK}[{WEEKDAYS}天]", " "))
    said = mentions(quotes, [key], "_quote", "ref", past=True, nearest=True).groupBy(key).agg(F.collect_set("date").alias("said"))
    both = wrong.join(said, key, "left").withColumn("said", F.coalesce("said", F.array().cast("array<date>")))
    same = F.filter("said", lambda d: F.weekday(d) == F.col("want"))
    how = F.when(F.exists("said", lambda d: F.date_format(d, "MM-dd") == F.date_format("stated", "MM-dd")), "weekday").when(F.size(same) == 1, "relative").otherwise("nearest")
    ahead = F.pmod(F.col("want") - F.weekday("stated"), F.lit(7))
    both = both.withColumn("how", how).withColumn("to", F.when(F.col("how") == "weekday", F.col("stated")).when(F.col("how") == "relative", F.get(same, 0)).otherwise(F.date_add("stated", F.when(ahead > 3, ahead - 7).otherwise(ahead))))
    name = F.when(F.col("how") == "weekday", F.substring(F.lit(WEEKDAYS), F.weekday("stated") + 1, F.lit(1))).otherwise(F.col("name"))
    g = lambda i: F.regexp_extract("was", STATED, i)
    text = F.concat(F.when(has_year, F.concat(F.year("to"), F.lit("年"))).otherwise(""), F.month("to"), F.lit("月"), F.day("to"), F.lit("日"), g(4), g(5), name, g(7))
    fixes = both.select(key, F.struct("place", F.col("was").alias("from"), text.alias("to"), "how").alias("fix")).groupBy(key).agg(F.array_sort(F.collect_list("fix")).alias("fixes"))
    changed = rows.join(fixes, key)
    at = F.map_from_arrays(F.transform("fixes", lambda f: f["place"]), F.transform("fixes", lambda f: f["to"]))
    kept = F.transform(F.regexp_extract_all("content", F.lit(STATED), F.lit(0)), lambda s, i: F.coalesce(F.try_element_at(at, i), s))
    whole = F.array_join(F.zip_with(F.split("content", STATED, -1), kept, lambda piece, s: F.concat(piece, F.coalesce(s, F.lit("")))), "")
    return changed.select(key, whole.alias("content"), "fixes")
