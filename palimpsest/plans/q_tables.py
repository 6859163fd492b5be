"""Life-cycle and window queries over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as o
from ..sources import adapter as a

sec = lambda c: F.unix_timestamp(c).alias(c if isinstance(c, str) else "ts")
T = f"make_timestamp({a.NOW}::BIGINT*1000000)"
DAYS = lambda n: f"make_timestamp(({a.NOW}::BIGINT-{n}*86400)*1000000)"


def _accessed(spark, d):
    at = F.when(F.col("fragment_id") % 3 == 0, F.timestamp_seconds(F.unix_timestamp("created_at") + (F.col("fragment_id") % 20) * 86400))
    return a.fragments(spark, d).withColumn("last_accessed_at", at)


ACCESSED = "SELECT *, CASE WHEN fragment_id%3=0 THEN created_at + to_days((fragment_id%20)::INT) END AS last_accessed_at FROM fragments"


def gc(spark, d):
    out = o.fragment_gc(_accessed(spark, d), a.now(), 14, 20, 25)
    return out.select("fragment_id", "status", F.unix_timestamp("lifecycle_updated_at").alias("at"), (F.col("content") == "[expired]").alias("expired"))


def _step(name, before, was, to, rule, expire=False):
    content = f"CASE WHEN status='{was}' AND ({rule}) THEN '[expired]' ELSE content END" if expire else "content"
    return f"SELECT fragment_id, created_at, last_accessed_at, cited_count, {content} AS content, CASE WHEN status='{was}' AND ({rule}) THEN '{to}' ELSE status END AS status, CASE WHEN status='{was}' AND ({rule}) THEN {T} ELSE lifecycle_updated_at END AS lifecycle_updated_at FROM {before}"


GC = {
    "acc": ACCESSED,
    "s1": _step("s1", "acc", "active", "cooling", f"cited_count=0 AND (last_accessed_at IS NULL OR last_accessed_at<{DAYS(14)}) AND created_at<{DAYS(14)}"),
    "s2": _step("s2", "s1", "cooling", "active", "cited_count>0 OR coalesce(last_accessed_at>lifecycle_updated_at, FALSE)"),
    "s3": _step("s3", "s2", "cooling", "frozen", f"lifecycle_updated_at<{DAYS(20)}"),
    "s4": _step("s4", "s3", "frozen", "tombstone", f"lifecycle_updated_at<{DAYS(25)}", True),
}


def _episodes(spark, d):
    """An episode for each source and day of creation."""
    f = a.fragments(spark, d)
    g = f.groupBy("entity", "created_at").agg(F.min("fragment_id").alias("memory_id"), F.count(F.lit(1)).alias("members"), F.max("emotional_weight").alias("top"))
    return g.select(
        "memory_id", "entity", "members", F.col("created_at"), F.when(F.col("memory_id") % 4 == 3, "mature").otherwise("permanent").alias("status"), F.when(F.col("memory_id") % 5 == 0, "flash").alias("consolidation_type"),
        (F.lit(5.0) + F.col("memory_id") % 4).alias("weight"), F.timestamp_seconds(F.unix_timestamp("created_at") - (F.col("memory_id") % 14) * 30 * 86400).alias("updated_at"),
        F.when(F.col("memory_id") % 2 == 0, F.timestamp_seconds(F.unix_timestamp("created_at") - (F.col("memory_id") % 9) * 30 * 86400)).alias("last_accessed_at"),
    )


EPISODES = """SELECT memory_id, entity, members, created_at, CASE WHEN memory_id%4=3 THEN 'mature' ELSE 'permanent' END AS status, CASE WHEN memory_id%5=0 THEN 'flash' END AS consolidation_type, (5+memory_id%4)::DOUBLE AS weight,
    created_at - to_days((memory_id%14*30)::INT) AS updated_at, CASE WHEN memory_id%2=0 THEN created_at - to_days((memory_id%9*30)::INT) END AS last_accessed_at
    FROM (SELECT entity, created_at, min(fragment_id) AS memory_id, count(*) AS members FROM fragments GROUP BY ALL)"""


def episode_decay(spark, d):
    return o.episode_decay(_episodes(spark, d), a.now()).select("memory_id", "status", "weight", F.unix_timestamp("updated_at").alias("at"))


def _lim(n):
    return f"CASE WHEN consolidation_type='flash' THEN {DAYS(n * 60)} ELSE {DAYS(n * 30)} END"


DECAY = {
    "ep": EPISODES,
    "e1": f"SELECT *, status='permanent' AND (last_accessed_at IS NULL OR last_accessed_at<{_lim(6)}) AND (updated_at IS NULL OR updated_at<{_lim(6)}) AS m FROM ep",
    "e2": f"SELECT memory_id, consolidation_type, CASE WHEN m THEN 'mature' ELSE status END AS status, CASE WHEN m THEN greatest(1.0, weight/2) ELSE weight END AS weight, CASE WHEN m THEN {T} ELSE updated_at END AS updated_at FROM e1",
    "e3": f"SELECT *, status='mature' AND updated_at<{_lim(12)} AS g FROM e2",
}


def weights(spark, d):
    return _episodes(spark, d).select("memory_id", o.episode_weight(F.col("created_at"), F.col("last_accessed_at"), a.now()).cast("long").alias("weight"))


def _model(spark, d):
    """Model entries of an owner: one per event type and day with an event."""
    e = a.observations(spark, d)
    g = e.groupBy("owner_id", F.to_date("t").alias("day")).agg(F.min("obs_id").alias("entry_id"), F.count(F.lit(1)).alias("n"))
    return g.select("owner_id", "entry_id", F.lit("current_state").alias("type"), F.lit("active").alias("status"), F.when(F.col("entry_id") % 3 == 0, "chat_companion").otherwise("scribe").alias("created_by"), F.col("day").cast("timestamp").alias("created_at"))


def cap(spark, d):
    return o.cap_states(_model(spark, d), 4).select("owner_id", "entry_id", "status")


CAP = {
    "m": "SELECT owner_id, t::DATE AS day, min(obs_id) AS entry_id FROM observations GROUP BY ALL",
    "r": "SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY (entry_id%3=0)::INT, day, entry_id) AS k, count(*) OVER (PARTITION BY owner_id) AS n FROM m",
}


def batches(spark, d):
    out = o.make_batches(a.messages(spark, d).withColumn("chat_id", F.col("chat_id") % 7), 60, 10)
    return out.select("chat_id", "batch", "place", "msg_id", "is_context")


BATCH = {
    "n_": "SELECT chat_id%7 AS chat_id, msg_id, row_number() OVER (PARTITION BY chat_id%7 ORDER BY ts, msg_id)-1 AS n, count(*) OVER (PARTITION BY chat_id%7) AS total FROM messages",
    "b_": "SELECT chat_id, msg_id, n, n//60 AS batch, FALSE AS is_context FROM n_ UNION ALL SELECT chat_id, msg_id, n, n//60+1, TRUE FROM n_ WHERE n%60>=50 AND (n//60+1)*60<total",
}


def fill(spark, d):
    m = a.messages(spark, d).withColumn("pos", F.col("msg_id") % 1000)
    m = m.withColumn("ts", F.when(F.col("msg_id") % 3 == 1, F.col("ts")))
    return o.fill_timestamps(m, a.now()).select("msg_id", F.unix_timestamp("ts").alias("at"))


FILL = {
    "m": "SELECT msg_id, chat_id, msg_id%1000 AS pos, CASE WHEN msg_id%3=1 THEN epoch(ts)::BIGINT END AS sec FROM messages",
    "x": "SELECT msg_id, pos, sec, min(CASE WHEN sec IS NOT NULL THEN pos END) OVER w AS np, max(pos) OVER (PARTITION BY chat_id) AS last, chat_id FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}


def idle(spark, d):
    return o.idle_gaps(a.messages(spark, d).withColumn("owner_id", F.col("owner_id") % 7)).select("owner_id", "msg_id", "gap_s")


def around(spark, d):
    return o.context_window(a.messages(spark, d)).select("msg_id", F.array_join(F.transform("around", lambda x: x.cast("string")), ",").alias("around"))


def page(spark, d):
    f = a.fragments(spark, d).filter("status = 'active' and emotional_weight >= 0.3")
    return o.list_page(f, [F.desc("created_at"), F.asc("fragment_id")], 2, 50).select("fragment_id", "position", "emotional_weight")


def stats(spark, d):
    return o.fragment_stats(a.fragments(spark, d))


def months(spark, d):
    return o.months(_episodes(spark, d).withColumn("at", F.col("updated_at")), "at")


def due(spark, d):
    m = a.messages(spark, d).withColumn("chat_id", F.col("chat_id") % 7)
    done = m.groupBy("chat_id").agg(F.percentile("msg_id", F.lit(0.2)).cast("long").alias("end_message_id"), F.count(F.lit(1)).alias("n")).filter("chat_id < 4").withColumn("round_end", F.col("chat_id") + 1)
    return o.summaries_due(m, done, 20)


def usage(spark, d):
    e = a.read(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "cited").otherwise("injected")
    log = e.select((F.col("event_id") % 500).alias("fragment_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    f = a.fragments(spark, d).withColumn("last_accessed_at", F.col("created_at"))
    return o.usage(f, log).select("fragment_id", "injected_count", "cited_count", "read_count", F.unix_timestamp("last_accessed_at").alias("at"))


def _pattern_rows(spark, d):
    e = a.observations(spark, d)
    p = e.groupBy("owner_id", "dim").agg(F.min("obs_id").alias("pattern_id"), F.max("t").alias("seen"))
    return p.select("pattern_id", F.when(F.col("pattern_id") % 2 == 0, "active").otherwise("dormant").alias("status"), ((F.col("pattern_id") % 10) / 10.0).alias("confidence"), F.timestamp_seconds(F.unix_timestamp("seen") - (F.col("pattern_id") % 5) * 60 * 86400).alias("last_seen"))


def patterns(spark, d):
    return o.pattern_states(_pattern_rows(spark, d), a.now()).select("pattern_id", "status")


PATTERNS = {
    "p": f"SELECT pid, CASE WHEN pid%2=0 THEN 'active' ELSE 'dormant' END AS status, (pid%10)/10.0::DOUBLE AS confidence, ({a.NOW}-(floor(epoch(seen))-(pid%5)*60*86400))/86400 AS days FROM (SELECT owner_id, dim, min(obs_id) AS pid, max(t) AS seen FROM observations GROUP BY ALL)",
}
PATTERN_STATES = "SELECT pid AS pattern_id, CASE WHEN days>180 AND confidence<0.4 THEN 'archived' WHEN status='active' AND days>30 THEN 'dormant' WHEN status='dormant' AND days<=30 THEN 'active' ELSE status END AS status FROM p"

Q = {
    "t1_fragment_gc": gc, "t2_episode_decay": episode_decay, "t3_episode_weight": weights, "w9_cap_states": cap, "w2_make_batches": batches, "w7_fill_timestamps": fill, "w13_idle_gaps": idle,
    "w6_context_window": around, "p8_list_fragments": page, "a3_fragment_stats": stats, "a4_months": months, "a33_summaries_due": due, "t16_usage": usage, "t5_pattern_states": patterns,
}
S = {
    "t1_fragment_gc": a.sql("fragments", "SELECT fragment_id, status, epoch(lifecycle_updated_at)::BIGINT AS at, content='[expired]' AS expired FROM s4", **GC),
    "t2_episode_decay": a.sql("fragments", f"SELECT memory_id, CASE WHEN g THEN 'archived' ELSE status END AS status, weight, epoch(CASE WHEN g THEN {T} ELSE updated_at END)::BIGINT AS at FROM e3", **DECAY),
    "t3_episode_weight": a.sql("fragments", f"""SELECT memory_id, CASE WHEN raw<2 THEN 2 WHEN raw>8 THEN 8 ELSE trunc(raw) END::BIGINT AS weight FROM (SELECT memory_id, 5+CASE WHEN last_accessed_at>{DAYS(7)} THEN 2 WHEN last_accessed_at>{DAYS(30)} THEN 1 ELSE 0 END
        - floor(({a.NOW}-epoch(created_at))/2592000)*0.5 AS raw FROM ep)""", ep=EPISODES),
    "w9_cap_states": a.sql("observations", "SELECT owner_id, entry_id, CASE WHEN k<=n-4 THEN 'resolved' ELSE 'active' END AS status FROM r", **CAP),
    "w2_make_batches": a.sql("messages", "SELECT chat_id, batch, n-batch*60 AS place, msg_id, is_context FROM b_", **BATCH),
    "w7_fill_timestamps": a.sql("messages", f"SELECT x.msg_id, coalesce(x.sec, coalesce(y.sec, {a.NOW}) - (coalesce(x.np, x.last+1)-x.pos)) AS at FROM x LEFT JOIN m y ON y.chat_id=x.chat_id AND y.pos=x.np", **FILL),
    "w13_idle_gaps": a.sql("messages", "SELECT owner_id, msg_id, gap_s FROM (SELECT owner_id%7 AS owner_id, msg_id, (epoch(ts)-epoch(lag(ts) OVER (PARTITION BY owner_id%7 ORDER BY ts, msg_id)))::BIGINT AS gap_s FROM messages) WHERE gap_s>=21600"),
    "w6_context_window": a.sql("messages", "SELECT msg_id, array_to_string(list(msg_id) OVER (PARTITION BY chat_id ORDER BY ts, msg_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),',') AS around FROM messages"),
    "p8_list_fragments": a.sql("fragments", "SELECT fragment_id, position, emotional_weight FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, fragment_id) AS position FROM fragments WHERE status='active' AND emotional_weight>=0.3) WHERE position BETWEEN 51 AND 100"),
    "a3_fragment_stats": a.sql("fragments", "SELECT status, count(*) AS n, round(avg(emotional_weight),2) AS mean_weight FROM fragments GROUP BY status"),
    "a4_months": a.sql("fragments", "SELECT strftime(updated_at,'%Y-%m') AS month, count(*) AS n FROM ep GROUP BY 1", ep=EPISODES),
    "a33_summaries_due": a.sql("messages", "SELECT m.chat_id, count(*) AS waiting, max(coalesce(round_end,0))+1 AS round FROM m LEFT JOIN dn ON dn.chat_id=m.chat_id WHERE sender='ai' AND msg_id>coalesce(end_message_id,-1) GROUP BY 1 HAVING count(*)>=20",
                               m="SELECT * REPLACE (chat_id%7 AS chat_id) FROM messages", dn="SELECT chat_id, trunc(quantile_cont(msg_id,0.2))::BIGINT AS end_message_id, chat_id+1 AS round_end FROM m WHERE chat_id<4 GROUP BY chat_id"),
    "t16_usage": a.sql("fragments", "SELECT fragment_id, injected_count+coalesce(i,0) AS injected_count, cited_count+coalesce(c,0) AS cited_count, read_count+coalesce(r,0) AS read_count, floor(epoch(greatest(created_at, seen)))::BIGINT AS at FROM fragments LEFT JOIN lg USING (fragment_id)",
                       lg="SELECT event_id%500 AS fragment_id, count(*) FILTER (event_type NOT IN ('view','click')) AS i, count(*) FILTER (event_type='click') AS c, count(*) FILTER (event_type='view') AS r, max(ts)::TIMESTAMP AS seen FROM events GROUP BY 1"),
    "t5_pattern_states": a.sql("observations", PATTERN_STATES, **PATTERNS),
}
