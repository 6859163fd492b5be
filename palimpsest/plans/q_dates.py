"""Date queries: every fragment's whole text behind a phrase that names a date, chosen by its id; their SQL knows the phrase."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import dates as o
from ..sources import adapter as a

#: Phrases by ``fragment_id % 8``; {n} is a day from 1 to 28, {m} a month.
PHRASES = ["我下個月{n}號要去面試。", "{n}天後交報告。", "下週五開會。", "昨天說過，{m}月{n}日見面。", "月底前搬家。", "週六去爬山。", "上週三去過了。", "昨天很累。"]


def _phrased(spark, d):
    i = F.col("fragment_id")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (i % 8 + 1).cast("int"))
    phrase = F.replace(F.replace(phrase, F.lit("{n}"), (i % 28 + 1).cast("string")), F.lit("{m}"), (i % 12 + 1).cast("string"))
    return a.fragments(spark, d).withColumn("content", F.concat(phrase, F.coalesce("content", F.lit("")))).withColumn("ref", F.to_date("created_at"))


PHRASED = "SELECT fragment_id AS id, owner_id, status, created_at::DATE AS ref, (fragment_id%28+1)::INT AS n, (fragment_id%12+1)::INT AS m, fragment_id%8 AS k FROM fragments"
OCCURS = "SELECT *, CASE WHEN make_date(year(ref)::INT,m,n)>=ref THEN make_date(year(ref)::INT,m,n) ELSE make_date(year(ref)::INT+1,m,n) END AS nxt, CASE WHEN make_date(year(ref)::INT,m,n)<ref THEN make_date(year(ref)::INT,m,n) ELSE make_date(year(ref)::INT-1,m,n) END AS prv FROM ph"
NAMED = """SELECT *, CASE k WHEN 0 THEN (date_trunc('month',ref)+INTERVAL 1 MONTH)::DATE+n-1 WHEN 1 THEN ref+n WHEN 2 THEN date_trunc('week',ref)::DATE+11 WHEN 3 THEN {0} WHEN 4 THEN last_day(ref)
    WHEN 5 THEN ref+((5-(isodow(ref)-1)+7)%7)::INT {1} END AS ev FROM oc"""
CTES = {"ph": PHRASED, "oc": OCCURS}
NEAREST = "CASE WHEN nxt-ref<=240 THEN nxt ELSE prv END"


def events(spark, d):
    out = o.event_dates(_phrased(spark, d), "fragment_id", "content", "ref")
    return out.select("fragment_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


def mentioned(spark, d):
    m = o.mentions(_phrased(spark, d), ["fragment_id"], "content", "ref", past=True, nearest=True)
    return m.select("fragment_id", "form", F.date_format("date", "yyyy-MM-dd").alias("date"), "weak")


def entry_events(spark, d):
    i = F.col("fragment_id")
    e = _phrased(spark, d).select(i.alias("entry_id"), F.when(i % 5 == 0, "fact").otherwise("event").alias("type"), F.when(i % 3 == 0, F.col("content")).alias("quote"), F.when(i % 2 == 0, F.date_format("created_at", "yyyy-MM-dd")).when(i % 7 == 1, "2024-05").otherwise("2024-02-09").alias("event_at"), F.col("created_at").alias("raised_at"))
    return o.event_at(e)


def coming(spark, d):
    f = _phrased(spark, d).withColumn("event_at", F.when(F.col("fragment_id") % 50 == 7, F.lit("2024-02-03")))
    return o.upcoming(f, a.now()).select("owner_id", "fragment_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "days_until", "rank")


def _dated(spark, d):
    """Each text behind a date with the weekday ``id % 7``; said were the date, the coming week's weekday, or neither."""
    i, f = F.col("fragment_id"), _phrased(spark, d)
    name = F.substring(F.lit(o.WEEKDAYS), (i % 7 + 1).cast("int"), F.lit(1))
    month, of_month = (i % 12 + 1).cast("string"), (i % 28 + 1).cast("string")
    text = F.concat(month, F.lit("月"), of_month, F.lit("日（週"), name, F.lit("）見面。"), F.col("content"))
    quote = F.when(i % 3 == 1, F.concat(month, F.lit("/"), of_month, F.lit("見"))).when(i % 3 == 2, F.concat(F.lit("下週"), name))
    return f.select("fragment_id", text.alias("content"), quote.alias("quote"), "ref", F.length("content").alias("rest"))


def repaired(spark, d):
    out = o.repair_weekdays(_dated(spark, d))
    return out.select("fragment_id", F.get("fixes", 0)["to"].alias("to"), F.get("fixes", 0)["how"].alias("how"), F.length("content").alias("n"))


def store(spark, d):
    """The store after repair: changed rows replace their old ones."""
    old = _dated(spark, d)
    new = o.repair_weekdays(old).select("fragment_id", F.col("content").alias("fixed"))
    return old.join(new, "fragment_id", "left").select("fragment_id", F.substring(F.coalesce("fixed", "content"), 1, 8).alias("head"), F.col("fixed").isNotNull().alias("changed"))


def quoted(spark, d):
    m = a.messages(spark, d)
    e = m.select(F.col("msg_id").alias("entry_id"), F.col("chat_id").alias("batch_id"), F.when(F.col("msg_id") % 3 > 0, F.substring("content", 3, 30)).alias("quote"))
    return o.quote_dates(e, m.withColumnRenamed("chat_id", "batch_id")).select("entry_id", F.unix_timestamp("quoted_at").alias("quoted_at"))


Q = {"f9_date_mentions": mentioned, "f10_event_dates": events, "f11_event_at": entry_events, "f12_repair_weekdays": repaired, "t20_upcoming": coming, "t32_repair_store": store, "j33_quote_dates": quoted}

WD = "substr('一二三四五六日', (isodow({0}))::INT, 1)"
FIX = {
    **CTES,
    "st": f"SELECT *, {NEAREST} AS stated, id%7 AS want, (isodow({NEAREST})-1) AS has FROM oc",
    "fx": f"""SELECT *, how, CASE how WHEN 'weekday' THEN stated WHEN 'relative' THEN date_trunc('week',ref)::DATE+(7+want)::INT ELSE stated+(CASE WHEN (want-has+7)%7>3 THEN (want-has+7)%7-7 ELSE (want-has+7)%7 END)::INT END AS good
        FROM (SELECT *, CASE id%3 WHEN 1 THEN 'weekday' WHEN 2 THEN CASE WHEN month(date_trunc('week',ref)::DATE+(7+want)::INT)=m AND day(date_trunc('week',ref)::DATE+(7+want)::INT)=n THEN 'weekday' ELSE 'relative' END ELSE 'nearest' END AS how FROM st WHERE has<>want)""",
    "ou": "SELECT id, how, good, month(good)||'月'||day(good)||'日（週'||CASE how WHEN 'weekday' THEN " + WD.format("good") + " ELSE substr('一二三四五六日', (want+1)::INT, 1) END||'）' AS to_text FROM fx",
}
_length = f"length({reduce(lambda s, kp: f'CASE WHEN fragment_id%8={kp[0]} THEN replace(replace({kp[1]!r}, chr(123)||chr(110)||chr(125), (fragment_id%28+1)::VARCHAR), chr(123)||chr(109)||chr(125), (fragment_id%12+1)::VARCHAR) ELSE {s} END', enumerate(PHRASES), repr(''))}||coalesce(content,''))"

S = {
    "f10_event_dates": a.sql("fragments", "SELECT id AS fragment_id, strftime(ev,'%Y-%m-%d') AS event_date FROM nm WHERE ev IS NOT NULL", **CTES, nm=NAMED.format(NEAREST, "WHEN 6 THEN date_trunc('week',ref)::DATE-5 WHEN 7 THEN ref-1")),
    "f9_date_mentions": a.sql("fragments", """SELECT id AS fragment_id, CASE k WHEN 0 THEN 'day_of_month' WHEN 1 THEN 'days_later' WHEN 3 THEN 'month_and_day' WHEN 4 THEN 'month_end' WHEN 7 THEN 'word' ELSE 'weekday' END AS form, strftime(ev,'%Y-%m-%d') AS date, k=7 AS weak FROM nm
        UNION ALL SELECT id, 'word', strftime(ref-1,'%Y-%m-%d'), TRUE FROM nm WHERE k=3 AND ev<>ref-1""", **CTES, nm=NAMED.format(NEAREST, "WHEN 6 THEN date_trunc('week',ref)::DATE-5 WHEN 7 THEN ref-1")),
    "f11_event_at": a.sql("fragments", "SELECT id AS entry_id, CASE WHEN id%5=0 THEN NULL WHEN id%3=0 THEN strftime(ev,'%Y-%m-%d') WHEN id%2=0 THEN NULL WHEN id%7=1 THEN '2024-05' ELSE '2024-02-09' END AS event_at FROM nm",
                          **CTES, nm=NAMED.format(NEAREST, "- CASE WHEN id%2=1 AND id%7<>1 AND abs(DATE '2024-02-09'-(ref+((5-(isodow(ref)-1)+7)%7)::INT-7))<abs(DATE '2024-02-09'-(ref+((5-(isodow(ref)-1)+7)%7)::INT)) AND isodow(ref)<>6 THEN 7 ELSE 0 END WHEN 6 THEN date_trunc('week',ref)::DATE-5 WHEN 7 THEN ref-1")),
    "t20_upcoming": a.sql("fragments", """SELECT owner_id, fragment_id, strftime(ev,'%Y-%m-%d') AS event_date, days_until, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY days_until, fragment_id) AS rank FROM
        (SELECT owner_id, id AS fragment_id, e AS ev, (e-DATE '2024-02-01')::INT AS days_until FROM (SELECT *, CASE WHEN id%50=7 THEN DATE '2024-02-03' ELSE ev END AS e FROM nm WHERE status='active') WHERE e BETWEEN DATE '2024-02-01' AND DATE '2024-02-08')) WHERE rank<=3""", **CTES, nm=NAMED.format("nxt", "")),
    "f12_repair_weekdays": a.sql("fragments", f"SELECT ou.id AS fragment_id, to_text AS \"to\", how, (length(to_text||'見面。')+{_length})::INT AS n FROM ou JOIN fragments f ON f.fragment_id=ou.id", **FIX),
    "t32_repair_store": a.sql("fragments", "SELECT st.id AS fragment_id, substr(coalesce(to_text, st.m||'月'||st.n||'日（週'||substr('一二三四五六日',(want+1)::INT,1)||'）')||'見面。我你他', 1, 8) AS head, to_text IS NOT NULL AS changed FROM st LEFT JOIN ou ON ou.id=st.id", **FIX),
    "j33_quote_dates": a.sql("messages", """SELECT e.msg_id AS entry_id, epoch(coalesce(min(CASE WHEN q<>'' AND contains(m.content, q) THEN m.ts END), min(m.ts)))::BIGINT AS quoted_at
        FROM (SELECT msg_id, chat_id, trim(coalesce(CASE WHEN msg_id%3>0 THEN substr(content,3,30) END,'')) AS q FROM messages) e JOIN messages m USING (chat_id) GROUP BY 1"""),
}
