"""Screening queries over the derived tables, with their SQL. The tables hold no Chinese: a phrase chosen by the id stands before each
whole text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import screening as o
from ..sources import adapter as a
from .q_linking import NORM
from .q_recall import TOKENS

ENTRY = ["", "很開心 ", "難過 提醒 ", "Mori開心 ", "Mori開心 使用者 ", "焦慮 "]
FACTS = ["你住在台北。", "你今天在公司。", "我住在台北。", "你 ", ""]
STRONG = ["", "", "", "我好難過 "]
KINDS = ["observation", "state", "reflection", "fact"]


def _pick(values: list[str], of):
    return F.element_at(F.array(*map(F.lit, values)), (of % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], of: str) -> str:
    return f"[{','.join(repr(v) for v in values)}][({of}%{len(values)}+1)::BIGINT]"


def chitchat(spark, d):
    f = a.fragments(spark, d).select("fragment_id", _pick(KINDS, F.col("fragment_id")).alias("kind"), F.concat(_pick(ENTRY, F.col("fragment_id")), F.col("content")).alias("content"))
    return f.select("fragment_id", o.ai_chitchat(F.col("kind"), F.col("content"), "Mori", ["user", "使用者", "用戶", "你"]).alias("dropped"))


def facts(spark, d):
    f = a.fragments(spark, d).withColumn("content", F.concat(_pick(FACTS, F.col("fragment_id")), F.col("content")))
    known = a.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("owner_id"), F.col("n_name").alias("fact"))
    return o.fact_candidates(f, known, ["你"], a.now()).select("owner_id", "fragment_id")


def signal(spark, d):
    m = a.messages(spark, d).select(F.col("chat_id").alias("batch_id"), F.concat(_pick(STRONG, F.col("msg_id")), F.col("content")).alias("content"))
    return o.emotion_signal(m)


def _memories(spark, d):
    """One entry for each chat: its tags are the first word of the first turn and two words of the last."""
    m = a.messages(spark, d).withColumn("w", t.index_tokens(F.col("content")))
    own = m.groupBy("owner_id").agg(F.min_by("w", "msg_id").alias("first"), F.max_by("w", "msg_id").alias("last"), F.min_by("content", "msg_id").alias("content"))
    tags = F.filter(F.array(F.get("first", F.lit(0)), F.array_join(F.slice("last", 3, 2), " ")), lambda x: x.isNotNull() & (x != ""))
    return own.select("owner_id", F.col("owner_id").alias("entry_id"), tags.alias("tags"), "content")


def triggered(spark, d):
    m = a.messages(spark, d)
    stop = m.filter("chat_id % 10 = 0").select(F.get(t.index_tokens(F.col("content")), F.lit(0)).alias("token")).filter("token is not null").distinct()
    return o.triggered(_memories(spark, d), m.select("owner_id", F.col("msg_id").alias("context_id"), "content"), stop)


def audits(spark, d):
    m = a.messages(spark, d).withColumn("content", F.when(F.col("chat_id") % 11 == 0, F.lit(" ")).otherwise(F.col("content")))
    e = m.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.when(F.col("msg_id") % 2 == 0, F.col("msg_id")))).alias("ids"), F.min("ts").alias("created_at"))
    status = F.when(F.col("chat_id") % 5 == 0, "ok").when(F.col("chat_id") % 5 == 1, "")
    e = e.select(F.col("chat_id").alias("memory_id"), (F.col("chat_id") % 10).alias("owner_id"), F.when(F.col("chat_id") % 4 == 3, "saga").otherwise("standard").alias("kind"), status.alias("audit_status"),
                 F.when(F.col("chat_id") % 7 > 0, F.col("ids")).alias("source_msg_ids"), "created_at")
    return o.audit_candidates(e, m)


def monitors(spark, d):
    q = a.questions(spark, d)
    w = t.index_tokens(F.col("query"))
    i = F.col("query_id")
    m = q.select(
        (i % 50).alias("owner_id"), i.alias("monitor_id"), _pick(["keyword", "entity", "schedule", "threshold"], i).alias("kind"), F.slice(w, 3, 2).alias("keywords"), (F.lit(100) + i % 25).cast("long").alias("entity_id"),
        (i % 3 * 24).alias("interval_hours"), F.when(i % 5 > 0, F.timestamp_seconds(F.lit(a.NOW) - i % 4 * 86400)).alias("last_at"), F.when(i % 8 == 3, "entity_frag_count").otherwise("correction_count").alias("metric"),
        F.when(i % 3 > 0, i % 3 * 2).alias("value"),
    )
    f = a.fragments(spark, d)
    wrong = f.select("owner_id", F.when(F.col("fragment_id") % 6 == 0, "active").otherwise("void").alias("status"))
    new = f.filter(F.col("created_at") >= F.timestamp_seconds(F.lit(a.NOW - 5 * 86400)))
    return o.match_triggers(m, new, a.links(spark, d), f, wrong, a.now())


Q = {"p3_ai_chitchat": chitchat, "p11_fact_candidates": facts, "p14_emotion_signal": signal, "p15_triggered": triggered, "p18_audit_candidates": audits, "p23_match_triggers": monitors}
W = TOKENS.format("content")
S = {
    "p3_ai_chitchat": a.sql("fragments", f"""SELECT fragment_id, NOT (kind<>'fact' AND regexp_matches(n,'{t._any(o.FEELINGS)}') AND NOT regexp_matches(n,'{t._any(o.CHAT)}')
        AND (NOT contains(n,'mori') OR regexp_matches(replace(n,'mori',''),'user|使用者|用戶|你'))) AS dropped FROM x""",
        x=f"SELECT fragment_id, {_pick_sql(KINDS, 'fragment_id')} AS kind, {NORM.format(_pick_sql(ENTRY, 'fragment_id') + '||content')} AS n FROM fragments"),
    "p11_fact_candidates": a.sql("fragments", f"""SELECT owner_id, fragment_id FROM x WHERE contains(c,'你') AND regexp_matches(c,'{t._any(o.LASTING)}|\\d{{4}}年') AND NOT regexp_matches(c,'{t._any(o.PASSING)}')
        AND NOT EXISTS (FROM nation WHERE n_nationkey=owner_id AND 1-length(translate(lower(c),lower(n_name),''))/length(c)>0.7)""",
        x=f"SELECT owner_id, fragment_id, {_pick_sql(FACTS, 'fragment_id')}||coalesce(content,'') AS c FROM fragments WHERE status='active' AND epoch(created_at)>{a.NOW}-7*86400 QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, fragment_id)<=100"),
    "p14_emotion_signal": a.sql("messages", f"SELECT chat_id AS batch_id, bool_or(regexp_matches({_pick_sql(STRONG, 'msg_id')}||coalesce(content,''),'{t._any(o.STRONG)}')) AS signal FROM messages GROUP BY 1"),
    "p15_triggered": a.sql("messages", "SELECT entry_id, context_id, min(why) AS why FROM (SELECT DISTINCT entry_id, msg_id AS context_id, 'tag' AS why FROM pr JOIN messages USING (owner_id) WHERE contains(content,probe) UNION ALL SELECT entry_id, context_id, 'words' FROM ew JOIN cw USING (owner_id, token) GROUP BY ALL HAVING count(*)>=5) GROUP BY 1,2",
        wm=f"SELECT *, {W} AS w FROM messages", stop="SELECT DISTINCT w[1] AS token FROM wm WHERE chat_id%10=0 AND len(w)>0",
        e="SELECT owner_id, owner_id AS entry_id, [arg_min(w,msg_id)[1], array_to_string(arg_max(w,msg_id)[3:4],' ')] AS tags, arg_min(content,msg_id) AS content FROM wm GROUP BY owner_id",
        tg="SELECT * FROM (SELECT owner_id, entry_id, unnest(tags) AS tag FROM e) WHERE length(tag)>0 AND tag NOT IN (SELECT token FROM stop)",
        pr="SELECT DISTINCT * FROM (SELECT owner_id, entry_id, tag AS probe FROM tg UNION ALL SELECT * FROM (SELECT owner_id, entry_id, unnest(list_transform(range(1,length(tag)-1), lambda i: substr(tag,i::BIGINT,3))) AS p FROM tg WHERE length(tag)>=4) WHERE p NOT IN (SELECT token FROM stop))",
        ew=f"SELECT owner_id, entry_id, unnest(list_distinct({W})) AS token FROM e", cw="SELECT owner_id, msg_id AS context_id, unnest(w) AS token FROM wm"),
    "p18_audit_candidates": a.sql("messages", """SELECT owner_id, memory_id, CASE WHEN coalesce(len(ids),0)=0 THEN 'skipped_no_sources' WHEN NOT coalesce(has,FALSE) THEN 'skipped_empty_msgs' ELSE 'audit' END AS audit_status, lines FROM ch LEFT JOIN sd USING (memory_id)""",
        m="SELECT * REPLACE (CASE WHEN chat_id%11=0 THEN ' ' ELSE content END AS content) FROM messages",
        e="SELECT chat_id AS memory_id, chat_id%10 AS owner_id, CASE WHEN chat_id%7>0 THEN list_sort(list(msg_id) FILTER (msg_id%2=0)) END AS ids, min(ts) AS created_at FROM m WHERE chat_id%4<>3 AND chat_id%5<>0 GROUP BY chat_id",
        ch="SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, memory_id)<=3",
        sd="SELECT memory_id, string_agg('['||sender||'] '||substr(content,1,150), chr(10) ORDER BY msg_id) AS lines, bool_or(trim(content)<>'') AS has FROM (SELECT memory_id, unnest(ids[1:5]) AS msg_id FROM ch) JOIN m USING (msg_id) GROUP BY 1"),
    "p23_match_triggers": a.sql("questions fragments links", """SELECT monitor_id, kind FROM q WHERE
        (kind='keyword' AND EXISTS (FROM new n WHERE n.owner_id=q.owner_id AND list_bool_or(list_transform(ks, lambda k: contains(lower(n.content),k)))))
        OR (kind='entity' AND EXISTS (FROM new n JOIN links l USING (fragment_id) WHERE n.owner_id=q.owner_id AND l.entity_id=q.entity_id))
        OR (kind='schedule' AND monitor_id%3>0 AND (monitor_id%5=0 OR monitor_id%4*24>=monitor_id%3*24))
        OR (kind='threshold' AND monitor_id%8=3 AND (SELECT count(*) FROM links l JOIN fragments f USING (fragment_id) WHERE status='active' AND f.owner_id=q.owner_id AND l.entity_id=q.entity_id)>=greatest(v,1))
        OR (kind='threshold' AND monitor_id%8<>3 AND (SELECT count(*) FROM fragments f WHERE fragment_id%6=0 AND f.owner_id=q.owner_id)>=greatest(coalesce(nullif(monitor_id%3*2,0),5),1))""",
        q=f"SELECT query_id%50 AS owner_id, query_id AS monitor_id, {_pick_sql(['keyword', 'entity', 'schedule', 'threshold'], 'query_id')} AS kind, ({TOKENS.format('query')})[3:4] AS ks, 100+query_id%25 AS entity_id, coalesce(nullif(query_id%3*2,0),10) AS v FROM questions",
        new=f"SELECT * FROM fragments WHERE epoch(created_at)>={a.NOW - 5 * 86400}"),
}
