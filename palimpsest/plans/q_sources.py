"""Queries of sources and small functions over data that is derived from the given tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as t
from ..operators import emotion, protection, tables
from ..sources import adapter as a
from ..sources import chat

KEYS = {"k1": b"0123456789abcdef0123456789abcdef"}
#: A turn's text on one line, without what would be read as JSON or a reminder.
FLAT = r"trim(regexp_replace(regexp_replace(content, '[\s]+', ' ', 'g'), '[\[\]{}<>:：\\]', ' ', 'g'))"


def _flat(spark, d):
    m = a.messages(spark, d)
    text = F.trim(F.regexp_replace(F.regexp_replace("content", r"[\s]+", " "), r"[\[\]{}<>:：\\]", " "))
    return m.select("chat_id", "msg_id", "role", F.unix_timestamp("ts").alias("sec"), text.alias("flat"))


def lines(spark, d):
    """Chat lines: with a boxed time and a name, with a name alone, and with neither."""
    m = _flat(spark, d)
    who = F.when(F.col("role") == "user", "User").otherwise("Mori")
    line = F.when(F.col("msg_id") % 3 == 0, F.concat(F.lit("["), F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd HH:mm:ss"), F.lit("] "), who, F.lit(": "), F.col("flat"))).when(F.col("msg_id") % 3 == 1, F.concat(who, F.lit("： "), F.col("flat"))).otherwise(F.col("flat"))
    return chat.parse_line(m.select("msg_id", line.alias("value"))).select("msg_id", "sender", "content", F.unix_timestamp("ts").alias("sec"))


def events(spark, d):
    """Webhook events of both forms, with seconds and milliseconds."""
    m = _flat(spark, d)
    simple = F.to_json(F.struct(F.col("role").alias("sender"), F.col("flat").alias("content"), F.col("sec").cast("string").alias("timestamp")))
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("flat").alias("text")))
    listed = F.to_json(F.struct(F.col("role").alias("role"), F.to_json(parts).alias("text"), (F.col("sec") * 1000).cast("string").alias("time")))
    bot = F.to_json(F.struct(F.lit("message").alias("post_type"), F.col("flat").alias("raw_message"), (F.col("msg_id") % 2).cast("string").alias("user_id"), F.lit("1").alias("self_id"), F.col("sec").cast("string").alias("time")))
    value = F.when(F.col("msg_id") % 3 == 0, simple).when(F.col("msg_id") % 3 == 1, listed).otherwise(bot)
    return chat.normalise_ingest(m.select("msg_id", value.alias("value"))).select("msg_id", "sender", "content", F.unix_timestamp("ts").alias("sec"))


def files(spark, d):
    """Every chat's turns written as JSON lines and read again."""
    folder = f"{tables.scratch(spark)}/chat-{uuid.uuid4().hex}"
    _flat(spark, d).select(F.to_json(F.struct(F.col("role").alias("sender"), F.concat(F.col("msg_id").cast("string"), F.lit(" "), F.col("flat")).alias("content"), F.col("sec").cast("string").alias("timestamp"))).alias("value")).write.text(folder)
    read = chat.read_chat(spark, folder)
    return read.select(F.split("content", " ")[0].cast("long").alias("msg_id"), "sender", F.length("content").cast("long").alias("chars"), F.unix_timestamp("ts").alias("sec"))


def senders(spark, d):
    return _flat(spark, d).select("msg_id", chat.sender(F.concat(F.lit("  "), F.upper("role"))).alias("sender"))


def contents(spark, d):
    """A string, a list of strings and parts, and one with a reminder."""
    m = _flat(spark, d)
    parts = F.concat(F.lit('["'), F.translate("flat", '"', "'"), F.lit('",{"type":"image","url":"x"},{"type":"text","text":"and '), F.col("msg_id").cast("string"), F.lit('"}]'))
    text = F.when(F.col("msg_id") % 3 == 0, parts).when(F.col("msg_id") % 3 == 1, F.concat(F.col("flat"), F.lit("<system_reminder>a\nb</system_reminder>"))).otherwise(F.col("flat"))
    return m.select("msg_id", chat.plain_text(text).alias("text"))


def prompts(spark, d):
    m = a.messages(spark, d).withColumn("message_type", F.when(F.col("msg_id") % 4 == 0, "image"))
    return chat.prompt_text(m).select("msg_id", "payload")


def dialogues(spark, d):
    """Each conversation as one line of a benchmark file: two sessions and a question whose evidence names a turn that is there and one
    that isn't."""
    folder = f"{tables.scratch(spark)}/dialogues-{uuid.uuid4().hex}"
    turns = _flat(spark, d).withColumn("session", F.col("msg_id") % 2 + 1)
    one = turns.groupBy("chat_id", "session").agg(F.array_sort(F.collect_list(F.struct(F.col("msg_id"), F.concat(F.lit("D"), F.col("session").cast("string"), F.lit(":"), F.col("msg_id").cast("string")).alias("dia_id"), F.col("role").alias("speaker"), F.col("flat").alias("text")))).alias("turns"), F.min("sec").alias("sec"))
    pairs = F.struct(F.concat(F.lit("session_"), F.col("session").cast("string")).alias("key"), F.to_json("turns").alias("value"))
    dated = F.struct(F.concat(F.lit("session_"), F.col("session").cast("string"), F.lit("_date_time")).alias("key"), F.lit("2024-01-02 08:00").alias("value"))
    qa = F.concat(F.lit('[{"question":"q?","answer":"a","category":2,"evidence":"D1:'), (F.col("chat_id") * 1000).cast("string"), F.lit('; D9:9"}]'))
    whole = one.groupBy("chat_id").agg(F.map_from_entries(F.flatten(F.collect_list(F.array(pairs, dated)))).alias("conversation"))
    whole.select(F.to_json(F.struct(F.col("chat_id").cast("string").alias("conv_id"), "conversation", qa.alias("qa"))).alias("value")).write.text(folder)
    return chat.read_dialogues(spark, folder)


def turns(spark, d):
    return dialogues(spark, d)[0].select(F.col("conv_id").cast("long").alias("conv_id"), "session", F.col("turn_seq").cast("long").alias("turn_seq"), "dia_id", "speaker", F.unix_timestamp("ts").alias("sec"))


def questions(spark, d):
    return dialogues(spark, d)[1].select(F.col("conv_id").cast("long").alias("conv_id"), "question", "answer", "category", F.array_join("evidence", ",").alias("evidence"))


def shifted(spark, d):
    m = a.messages(spark, d).select(F.col("chat_id").alias("conv_id"), "msg_id", "ts")
    return chat.shift_timeline(m, a.now()).select("msg_id", F.unix_timestamp("ts").alias("sec"))


def replies(spark, d):
    """Raw replies: whole ones, ones with prose around the list, and ones that are cut off."""
    m = _flat(spark, d)
    i = F.col("msg_id").cast("string")
    items = F.concat(F.lit('[{"id":'), i, F.lit('},{"id":0,"s":"a]b"}'))
    text = F.when(F.col("msg_id") % 3 == 0, F.concat(F.lit('{"entries":'), items, F.lit("]}"))).when(F.col("msg_id") % 3 == 1, F.concat(F.col("flat"), F.lit(" so "), items, F.lit("] done"))).otherwise(F.concat(items, F.lit(',{"id":5,"t":"cu')))
    return chat.parse_replies(m.select(F.col("msg_id").alias("reply_id"), text.alias("reply")))


def entries(spark, d):
    return replies(spark, d)[0].select("reply_id", F.col("pos").cast("long").alias("pos"), F.get_json_object("entry", "$.id").alias("id"))


def statuses(spark, d):
    return replies(spark, d)[1].select("reply_id", F.col("n").cast("long").alias("n"), "truncated", "salvaged")


def stored(spark, d):
    """Fragments exported and imported into a store that has half of them, with other contents."""
    folder = f"{tables.scratch(spark)}/store-{uuid.uuid4().hex}"
    f = a.fragments(spark, d).select("fragment_id", "content", "confidence")
    chat.export_store({"fragments": f, "links": a.links(spark, d)}, folder)
    half = f.filter("fragment_id % 2 = 0").withColumn("content", F.lit("old"))
    both = spark.read.text(folder)
    return chat.import_store(both, half, "fragments", ["fragment_id"]).select("fragment_id", F.md5("content").alias("digest"), F.round("confidence", 6).alias("confidence"))


def upserted(spark, d):
    f = a.fragments(spark, d).select("fragment_id", "confidence")
    new = f.filter("fragment_id % 3 = 0").select((F.col("fragment_id") * 2).alias("fragment_id"), F.lit(0.0).alias("confidence"))
    return tables.upsert(f, new, ["fragment_id"]).select("fragment_id", F.round("confidence", 6).alias("confidence"))


def small(spark, d):
    """Change ratios of neighbouring names, what names say, thinned lists of ids."""
    n = a.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    far = n.join(n.select((F.col("id") + 1).alias("id"), F.col("name").alias("before")), "id")
    ids = F.sequence(F.lit(1).cast("long"), F.col("id") * 5)
    return far.select("id", F.round(t.change_ratio(F.col("before"), F.col("name")), 6).alias("ratio"), t.mention_weight(F.concat(F.lit("小明"), F.col("name"))).cast("double").alias("weight"), F.aggregate(tables.evidence_thinning(ids), F.lit(0).cast("long"), lambda x, y: x + y).alias("thinned"))


def cosines(spark, d):
    v = a.vectors(spark, d)
    near = v.join(v.select((F.col("fragment_id") + 1).alias("fragment_id"), F.col("embedding").alias("before")), "fragment_id")
    return near.select("fragment_id", F.round(sc.cosine(F.col("embedding"), F.col("before")), 4).alias("cosine"))


def times(spark, d):
    """Times as seconds, milliseconds, zoned and unzoned text, and as nothing of the kind."""
    m = _flat(spark, d)
    s, at = F.col("sec"), F.timestamp_seconds("sec")
    text = F.element_at(F.array(s.cast("string"), (s * 1000).cast("string"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("soon")), (F.col("msg_id") % 5 + 1).cast("int"))
    return m.select("msg_id", F.unix_timestamp(t.to_utc(text, "Asia/Taipei")).alias("sec"))


def scores(spark, d):
    """Raw scores with aliases, unknown names, numbers out of range and no numbers."""
    o = a.observations(spark, d)
    raw = F.map_from_arrays(F.array(F.lit("Joy"), F.lit("sad"), F.lit("odd")), F.array((F.col("y") * 2).cast("string"), F.when(F.col("obs_id") % 3 == 0, F.lit("x")).otherwise((-F.col("y")).cast("string")), F.lit("1")))
    clean = emotion.sanitise(raw, {"joy": "happy"}, ["happy", "sad"])
    return o.select("obs_id", F.round(clean["happy"], 6).alias("happy"), clean["sad"].alias("sad"), F.size(clean).cast("long").alias("n"))


def sealed(spark, d):
    n = a.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), protection.seal(F.col("n_name"), "nation", "n_name", "k1", KEYS["k1"]).alias("sealed"))
    return n.select("id", protection.sealed_like(F.col("sealed"), "%iN%", "nation", "n_name", KEYS).alias("hit"), protection.sealed_length(F.col("sealed"), "nation", "n_name", KEYS).cast("long").alias("chars"))


Q = {
    "s1_parse_lines": lines, "s2_normalise_ingest": events, "s3_to_utc": times, "s4_export_import": stored, "s6_read_chat": files, "s7_dialogue_turns": turns, "s7_dialogue_questions": questions, "s7_shift_timeline": shifted, "s8_reply_entries": entries,
    "s8_reply_status": statuses, "s9_upsert": upserted, "s10_sender": senders, "s10_plain_text": contents, "s10_prompt_text": prompts, "f26_small_functions": small, "f27_cosine": cosines, "f19_sanitise": scores, "p17_sealed_like": sealed,
}
FL = {"fl": f"SELECT *, {FLAT} AS flat, epoch(ts)::BIGINT AS sec FROM messages"}
LOWER = "CASE WHEN role='user' THEN 'user' ELSE 'ai' END"
S = {
    "s1_parse_lines": a.sql("messages", f"SELECT msg_id, CASE WHEN msg_id%3=2 THEN 'user' ELSE {LOWER} END AS sender, flat AS content, CASE WHEN msg_id%3=0 THEN sec END AS sec FROM fl WHERE flat<>''", **FL),
    "s2_normalise_ingest": a.sql("messages", f"SELECT msg_id, CASE WHEN msg_id%3=2 THEN CASE WHEN msg_id%2=1 THEN 'ai' ELSE 'user' END ELSE {LOWER} END AS sender, flat AS content, sec FROM fl WHERE flat<>''", **FL),
    "s3_to_utc": a.sql("messages", "SELECT msg_id, CASE msg_id%5 WHEN 4 THEN NULL WHEN 3 THEN epoch(ts)::BIGINT-8*3600 ELSE epoch(ts)::BIGINT END AS sec FROM messages"),
    "s4_export_import": a.sql("fragments", "SELECT fragment_id, md5(CASE WHEN fragment_id%2=0 THEN 'old' ELSE content END) AS digest, round(confidence,6) AS confidence FROM fragments"),
    "s6_read_chat": a.sql("messages", f"SELECT msg_id, {LOWER} AS sender, length(trim(msg_id||' '||flat)) AS chars, sec FROM fl", **FL),
    "s7_dialogue_turns": a.sql("messages", "SELECT chat_id AS conv_id, (msg_id%2+1)::INT AS session, row_number() OVER (PARTITION BY chat_id, msg_id%2 ORDER BY msg_id)-1 AS turn_seq, 'D'||(msg_id%2+1)||':'||msg_id AS dia_id, role AS speaker, 1704153600::BIGINT AS sec FROM messages"),
    "s7_dialogue_questions": a.sql("messages", "SELECT DISTINCT chat_id AS conv_id, 'q?' AS question, 'a' AS answer, 2::INT AS category, 'D1:'||(chat_id*1000) AS evidence FROM messages"),
    "s7_shift_timeline": a.sql("messages", f"SELECT msg_id, (epoch(ts)-max(epoch(ts)) OVER (PARTITION BY chat_id)+{a.NOW}-86400)::BIGINT AS sec FROM messages"),
    "s8_reply_entries": a.sql("messages", "SELECT msg_id AS reply_id, 0::BIGINT AS pos, msg_id::VARCHAR AS id FROM messages UNION ALL SELECT msg_id, 1, '0' FROM messages"),
    "s8_reply_status": a.sql("messages", "SELECT msg_id AS reply_id, 2::BIGINT AS n, msg_id%3=2 AS truncated, msg_id%3>0 AS salvaged FROM messages"),
    "s9_upsert": a.sql("fragments", "SELECT fragment_id, round(confidence,6) AS confidence FROM fragments WHERE fragment_id NOT IN (SELECT fragment_id*2 FROM fragments WHERE fragment_id%3=0) UNION ALL SELECT fragment_id*2, 0.0::DOUBLE FROM fragments WHERE fragment_id%3=0"),
    "s10_sender": a.sql("messages", f"SELECT msg_id, {LOWER} AS sender FROM messages"),
    "s10_plain_text": a.sql("messages", "SELECT msg_id, CASE WHEN msg_id%3=0 THEN trim(translate(flat,'\"','''')||chr(10)||'and '||msg_id) ELSE flat END AS text FROM fl", **FL),
    "s10_prompt_text": a.sql("messages", "SELECT msg_id, substr(content,1,500) AS payload FROM messages WHERE msg_id%4<>0"),
    "f26_small_functions": "WITH n AS (SELECT n_nationkey::BIGINT AS id, n_name, lower(regexp_replace(n_name,'[^A-Za-z0-9]','','g')) AS k FROM nation) SELECT x.id, round(levenshtein(y.k,x.k)/greatest(length(x.k),length(y.k),1),6) AS ratio, 2+length(x.k)/2 AS weight, CASE WHEN x.id*5<=50 THEN (x.id*5)*(x.id*5+1)//2 ELSE 325+(x.id*5)*(x.id*5+1)//2-(x.id*5-25)*(x.id*5-24)//2 END AS thinned FROM n x JOIN n y ON y.id+1=x.id",
    "f27_cosine": a.sql("vectors", "SELECT x.fragment_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]),4) AS cosine FROM vectors x JOIN vectors y ON y.fragment_id+1=x.fragment_id"),
    "f19_sanitise": a.sql("observations", "SELECT obs_id, round(least(1.0::DOUBLE,y*2),6) AS happy, CASE WHEN obs_id%3<>0 THEN greatest(0.0::DOUBLE,-y) END AS sad, CASE WHEN obs_id%3=0 THEN 1 ELSE 2 END::BIGINT AS n FROM observations"),
    "p17_sealed_like": "SELECT n_nationkey::BIGINT AS id, contains(lower(n_name),'in') AS hit, length(n_name) AS chars FROM nation",
}
