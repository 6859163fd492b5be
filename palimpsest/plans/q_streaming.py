"""Streaming queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import emotion
from ..operators import evidence
from ..operators.screening import STRONG
from ..sources import adapter as a
from ..streaming import jobs

#: A table's files are in no order of time: those of a stateful job are one batch, in which nothing is late.
WHOLE, AT_ONCE = 1 << 30, "0 seconds"


def _messages(spark, d):
    c = jobs.read_table(spark, d, "conversations")
    ts = F.timestamp_seconds(F.lit(a.START) + F.col("conv_id") * 3600 + F.col("turn") * 10)
    return c.select(F.col("conv_id").alias("chat_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "role", ts.alias("ts"))


def unique_messages(spark, d):
    twice = _messages(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = jobs.run(jobs.unique_messages(twice, "60 days"), "append")
    return out.select("chat_id", "msg_id", "role", F.unix_timestamp("ts").alias("sec"))


def sessions(spark, d):
    m = a.messages(spark, d).withColumn("chat_id", F.col("chat_id") % 7)
    return jobs.silence_sessions(m, "2 hours").select("chat_id", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "n")


def daily(spark, d):
    e = jobs.read_table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.latest(jobs.run(jobs.daily_counts(e, "event_type"), "update"), ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")


def sliding(spark, d):
    e = jobs.read_table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.latest(jobs.run(jobs.daily_counts(e, "event_type", every="7 days", slide="1 day"), "update"), ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")


def online(spark, d):
    e = jobs.read_table(spark, d, "events", WHOLE)
    t = F.col("ts").cast("timestamp")
    obs = e.select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("dim"), F.col("event_id").alias("obs_id"), F.least(F.lit(1.0), F.col("value") / 150).alias("y"), t.alias("t"))
    rows = emotion.with_slot(obs).select("owner_id", "dim", "obs_id", "y", "slot", (F.unix_micros("t") / F.lit(3.6e9)).alias("hours"))
    out = jobs.run(jobs.online_baseline(rows), "append")
    return out.select("owner_id", "dim", "obs_id", F.round("z", 6).alias("z"), F.round("mu", 6).alias("mu"), "anomaly", "learning")


def _events(spark, d, owners: int):
    e = jobs.read_table(spark, d, "events", WHOLE)
    return e.select((F.col("user_id") % owners).alias("owner_id"), F.col("event_id").cast("long").alias("obs_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long").alias("at"))


def extraction(spark, d):
    """Events are messages of five chats; every fortieth speaks of strong emotion."""
    e = _events(spark, d, 5).select(F.col("owner_id").cast("long").alias("chat_id"), F.col("obs_id").alias("msg_id"), "at", (F.col("obs_id") % 40 == 0).alias("strong"))
    return jobs.run(jobs.extraction_batches(e, AT_ONCE), "append").drop("batch_id")


def emotion_batches(spark, d):
    """Turns are messages; a phrase chosen by the id stands before each text."""
    c = jobs.read_table(spark, d, "conversations", WHOLE)
    text = F.concat(F.when(F.col("turn") % 4 == 3, F.lit("我好難過 ")).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    m = c.select((F.col("conv_id") % 3).cast("long").alias("chat_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("msg_id"), (F.lit(a.START) + F.col("conv_id") * 3600 + F.col("turn") * 10).alias("at"), text.rlike("|".join(STRONG)).alias("strong"))
    return jobs.run(jobs.extraction_batches(m, AT_ONCE), "append").drop("batch_id")


def pool(spark, d):
    return jobs.run(jobs.working_pool(_events(spark, d, 5), delay=AT_ONCE), "append").drop("batch_id")


def cached(spark, d):
    """Events are messages of five owners; two in five name an entity."""
    e = _events(spark, d, 5).withColumnRenamed("obs_id", "msg_id")
    named = F.when(F.col("msg_id") % 5 < 2, F.array(F.col("msg_id") % 17)).otherwise(F.array().cast("array<bigint>"))
    out = jobs.run(jobs.entity_cache(e.withColumn("entity_ids", named), AT_ONCE), "append")
    return out.select("owner_id", "msg_id", F.array_join(F.transform("known", lambda x: x.cast("string")), ",").alias("known"))


def states(spark, d):
    c = jobs.read_table(spark, d, "conversations", WHOLE)
    i = F.col("conv_id") * 1000 + F.col("turn")
    by = F.when(F.col("role") == "user", "companion").otherwise("deep_cycle")
    ts = F.timestamp_seconds(F.lit(a.START) + F.col("conv_id") * 3600 + F.col("turn") * 10)
    m = c.select(F.col("conv_id").alias("owner_id"), i.alias("statement_id"), ts.alias("at"), by.alias("by"), F.col("text").alias("content"), F.when(i % 3 > 0, F.lit(40)).alias("ttl"))
    return jobs.run(jobs.current_states(evidence.statements(m), AT_ONCE), "append").drop("batch_id")


def idle(spark, d):
    return jobs.run(jobs.idle_triggers(_events(spark, d, 200).withColumnRenamed("obs_id", "msg_id")), "append").select("owner_id", "msg_id", F.col("at").cast("long").alias("at"))


#: Messages of a chat one after another: what waits, when it goes before the next message comes, and what goes with it.
_PENDING = """WITH RECURSIVE x AS ({0}),
        e AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY s, msg_id) AS k FROM x),
        r AS (SELECT chat_id, k, s AS last, 1::BIGINT AS n, strong, NULL::BIGINT AS went, NULL::VARCHAR AS why, 0::BIGINT AS gone, 0::BIGINT AS before FROM e WHERE k=1 UNION ALL
          SELECT chat_id, k, last, CASE WHEN post IS NULL THEN m ELSE 0 END, post IS NULL AND hot, CASE WHEN post IS NULL THEN w ELSE last END, coalesce(pre, post), CASE WHEN pre IS NOT NULL THEN k-1 ELSE k END, CASE WHEN pre IS NOT NULL THEN n WHEN post IS NOT NULL THEN m ELSE 0 END FROM (
            SELECT *, CASE WHEN m>=100 THEN 'force' WHEN m>=30 AND (w IS NULL OR last>=w+14400) THEN 'stale' END AS post FROM (
              SELECT *, CASE WHEN pre IS NULL THEN n+1 ELSE 1 END AS m, CASE WHEN pre IS NULL THEN was OR strong ELSE strong END AS hot, CASE WHEN pre IS NULL THEN went ELSE prev END AS w FROM (
                SELECT e.chat_id, e.k, e.s AS last, e.strong, r.n, r.strong AS was, r.last AS prev, r.went,
                  CASE WHEN r.n>=30 AND r.went+14400<=e.s AND (r.went+14400<=r.last+1200 OR NOT (r.strong OR r.n>=60)) THEN 'stale' WHEN r.n>0 AND r.last+1200<=e.s AND r.strong THEN 'emotion' WHEN r.n>=60 AND r.last+1200<=e.s THEN 'silence' END AS pre
                FROM r JOIN e ON e.chat_id=r.chat_id AND e.k=r.k+1)))),
        z AS (SELECT *, (SELECT max(s) FROM x) AS wm FROM r QUALIFY k=max(k) OVER (PARTITION BY chat_id)),
        f AS (SELECT chat_id, why, gone, before FROM r WHERE why IS NOT NULL UNION ALL
          SELECT chat_id, why, k, n FROM (SELECT *, CASE WHEN n>=30 AND went+14400<=wm AND (went+14400<=last+1200 OR NOT (strong OR n>=60)) THEN 'stale' WHEN n>0 AND last+1200<=wm AND strong THEN 'emotion' WHEN n>=60 AND last+1200<=wm THEN 'silence' END AS why FROM (SELECT * EXCLUDE why FROM z)) WHERE why IS NOT NULL),
        p AS (SELECT chat_id, why, gone-before+60*part+1 AS lo, least(gone, gone-before+60*(part+1)) AS hi FROM f, range(0, 2000) t(part) WHERE 60*part<before)
        SELECT p.chat_id, why AS reason, a.msg_id AS first_id, b.msg_id AS last_id, hi-lo+1 AS n FROM p JOIN e a ON a.chat_id=p.chat_id AND a.k=lo JOIN e b ON b.chat_id=p.chat_id AND b.k=hi"""

Q = {"g1_unique_messages": unique_messages, "g2_silence_sessions": sessions, "g8_daily_counts": daily, "g7_sliding_counts": sliding, "g3_online_baseline": online,
     "g2_extraction_batches": extraction, "g2_emotion_batches": emotion_batches, "g4_working_pool": pool, "g4_entity_cache": cached, "g5_current_states": states, "g6_idle_triggers": idle}
S = {
    "g2_extraction_batches": _PENDING.format("SELECT (user_id%5)::BIGINT AS chat_id, event_id::BIGINT AS msg_id, floor(epoch(ts::TIMESTAMP))::BIGINT AS s, event_id%40=0 AS strong FROM events"),
    "g2_emotion_batches": _PENDING.format(f"SELECT (conv_id%3)::BIGINT AS chat_id, conv_id*1000+turn AS msg_id, {a.START}+conv_id*3600+turn*10 AS s, turn%4=3 AS strong FROM conversations"),
    "g4_entity_cache": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY s, msg_id) AS k FROM (SELECT user_id%5 AS owner_id, event_id AS msg_id, floor(epoch(ts::TIMESTAMP))::BIGINT AS s FROM events)),
        n AS (SELECT owner_id, k, s, msg_id%17 AS entity FROM e WHERE msg_id%5<2)
        SELECT e.owner_id, e.msg_id, coalesce(array_to_string(list_sort(list_distinct(list(entity) FILTER (entity IS NOT NULL))), ','), '') AS known FROM e LEFT JOIN n ON n.owner_id=e.owner_id AND n.k<e.k AND n.s>=e.s-1800 GROUP BY ALL""",
    "g1_unique_messages": a.sql("messages", "SELECT chat_id, msg_id, role, epoch(ts)::BIGINT AS sec FROM messages"),
    "g2_silence_sessions": a.sql("messages", "SELECT chat_id, min(s) AS start_s, max(s)+7200 AS end_s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY chat_id ORDER BY s, msg_id) AS k FROM x) GROUP BY chat_id, k",
                                 x="SELECT chat_id%7 AS chat_id, msg_id, epoch(ts)::BIGINT AS s, CASE WHEN epoch(ts)-lag(epoch(ts)) OVER (PARTITION BY chat_id%7 ORDER BY ts, msg_id)<7200 THEN 0 ELSE 1 END AS new FROM messages"),
    "g8_daily_counts": "SELECT epoch(date_trunc('day', ts::TIMESTAMP))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL",
    "g7_sliding_counts": "SELECT epoch(date_trunc('day', ts::TIMESTAMP))::BIGINT - k*86400 AS start_s, event_type, count(*) AS n FROM events, range(7) r(k) GROUP BY ALL",
    "g4_working_pool": "SELECT owner_id, obs_id, least(count(*) OVER (PARTITION BY owner_id ORDER BY s RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY owner_id, s) - row_number() OVER (PARTITION BY owner_id, s ORDER BY obs_id)),5) AS pool FROM (SELECT user_id%5 AS owner_id, event_id AS obs_id, floor(epoch(ts::TIMESTAMP))::BIGINT AS s FROM events)",
    "g6_idle_triggers": """WITH RECURSIVE e AS (SELECT user_id%200 AS owner_id, event_id AS msg_id, floor(epoch(ts::TIMESTAMP))::BIGINT AS s FROM events),
        g AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY s, msg_id) AS n FROM (SELECT *, s-lag(s) OVER (PARTITION BY owner_id ORDER BY s, msg_id) AS gap FROM e) WHERE gap>=6*3600),
        r AS (SELECT owner_id, msg_id, s, n, TRUE AS fires, s AS fired FROM g WHERE n=1 UNION ALL SELECT g.owner_id, g.msg_id, g.s, g.n, g.s-r.fired>=7*86400, CASE WHEN g.s-r.fired>=7*86400 THEN g.s ELSE r.fired END FROM r JOIN g ON g.owner_id=r.owner_id AND g.n=r.n+1)
        SELECT owner_id, msg_id, s AS at FROM r WHERE fires""",
}
