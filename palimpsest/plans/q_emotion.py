"""Emotion, graph and protection queries over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..operators import emotion as o
from ..operators import graph as g
from ..operators import protection as p
from ..operators import recall as r
from ..sources import adapter as a
from .q_linking import NORM
from .q_recall import TOKENS

R6 = lambda c: F.round(c, 6).alias(c)
FADE = "pow(2.0::DOUBLE, -(epoch_us(last_at)-epoch_us(t))/(86400e6*30.0))"


def _events(spark, d):
    obs = a.observations(spark, d)
    return obs.select((F.col("owner_id") % 40).alias("entity_id"), "dim", "t", (F.col("y") >= 0.5).cast("double").alias("hit"), F.when(F.col("y") >= 0.5, F.col("y")).otherwise(0.0).alias("mag"))


EVENTS = {"ev": "SELECT owner_id%40 AS entity_id, dim, t, (y>=0.5)::INT::DOUBLE AS hit, CASE WHEN y>=0.5 THEN y ELSE 0.0 END AS mag FROM observations",
          "st": f"SELECT entity_id, dim, last_at, sum({FADE}) AS n, sum({FADE}*hit) AS hits, sum({FADE}*mag) AS mag FROM (SELECT *, max(t) OVER (PARTITION BY entity_id, dim) AS last_at FROM ev) GROUP BY ALL"}


def stats(spark, d):
    out = o.decayed_stats(_events(spark, d), ["entity_id", "dim"])
    return out.select("entity_id", "dim", F.unix_timestamp("last_at").alias("last_s"), R6("n"), R6("hits"), R6("mag"))


def rates(spark, d):
    out = o.rates(o.decayed_stats(_events(spark, d), ["entity_id", "dim"]), a.now())
    return out.select("entity_id", "dim", R6("rate"), R6("lift"))


RATES = {**EVENTS, "fa": f"SELECT entity_id, dim, n*f AS n, hits*f AS hits FROM (SELECT *, pow(2.0::DOUBLE, -greatest(0.0::DOUBLE, ({a.NOW}*1000000::BIGINT-epoch_us(last_at))/(86400e6*30.0))) AS f FROM st)",
         "p0": "SELECT *, (sum(hits) OVER (PARTITION BY dim)+0.3)/(sum(n) OVER (PARTITION BY dim)+3.0) AS p0 FROM fa"}
SLOT = "CASE WHEN hour(t) BETWEEN 5 AND 10 THEN 'morning' WHEN hour(t) BETWEEN 11 AND 16 THEN 'afternoon' WHEN hour(t) BETWEEN 17 AND 22 THEN 'evening' ELSE 'night' END"


def topics(spark, d):
    obs = o.with_slot(a.observations(spark, d)).withColumn("category", F.when(F.col("owner_id") % 2 == 0, "even").otherwise("odd"))
    return o.topic_slots(obs).select("category", "slot", "dim", R6("n"), R6("mean"))


def baselines(spark, d):
    return o.baselines(o.with_slot(a.observations(spark, d))).select("owner_id", "dim", "slot", "n", R6("overall"), R6("mu"))


def arcs(spark, d):
    obs = a.observations(spark, d).withColumn("event_at", F.date_add(F.lit("2024-01-05").cast("date"), (F.col("owner_id") % 20).cast("int")))
    out = o.event_arcs(obs.withColumn("event", F.concat_ws("/", F.col("owner_id").cast("string"), "dim")))
    return out.select("event", "n", R6("before"), R6("after"), R6("delta"))


def high_days(spark, d):
    return o.high_days(a.fragments(spark, d)).select("owner_id", F.col("day").cast("string").alias("day"), "n", R6("mean"), "rank")


def replay(spark, d):
    return o.replay(a.observations(spark, d)).select("owner_id", "dim", "obs_id", R6("z"), R6("mu"), R6("x"), "anomaly", "learning")


def anniversaries(spark, d):
    f = a.fragments(spark, d).withColumn("created_at", F.timestamp_seconds(F.unix_timestamp("created_at") + 86400 * (F.col("fragment_id") % 3) - 365 * 86400 * (F.col("fragment_id") % 2)))
    return o.anniversaries(f, a.now(), "Asia/Taipei").select("fragment_id")


def z(spark, d):
    """z-score and cut squared residual of each observation against its dimension's mean and spread."""
    obs = a.observations(spark, d)
    base = obs.groupBy("dim").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    out = obs.join(F.broadcast(base), "dim").withColumn("z", s.z_score(F.col("y"), F.col("m"), F.col("sd")))  # one row a dimension
    return out.select("obs_id", R6("z"), F.round(s.winsorised(F.col("z")), 6).alias("r2"))


def fading(spark, d):
    f = a.fragments(spark, d).withColumn("days", s.age_days(F.col("created_at"), a.now()))
    valence = (F.col("fragment_id") % 5 - 2) / 20.0
    return f.select("fragment_id", F.round(s.faded(F.col("emotional_weight"), valence, F.col("days")), 6).alias("left"))


def _pairs(spark, d):
    """Chains inside an owner: fragments of neighbouring ids with the same source or weight."""
    f = a.fragments(spark, d).select(F.col("fragment_id").alias("id"))
    pairs = f.filter("id % 7 not in (0, 3)").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionByName(f.filter("id % 30 = 29").select(F.col("id").alias("a"), (F.col("id") - 28).alias("b")))
    return f, pairs.join(f.select(F.col("id").alias("b")), "b", "left_semi")


EDGES = {"pr": "SELECT x AS a, y AS b FROM (SELECT fragment_id AS x, fragment_id-1 AS y FROM fragments WHERE fragment_id%7 NOT IN (0,3) UNION ALL SELECT fragment_id, fragment_id-28 FROM fragments WHERE fragment_id%30=29) WHERE y IN (SELECT fragment_id FROM fragments)",
         "both_": "SELECT a, b FROM pr UNION SELECT b, a FROM pr"}


def components(spark, d):
    return g.components(*_pairs(spark, d))


def clusters(spark, d):
    return g.clusters(*_pairs(spark, d), 5)


def episodes(spark, d):
    f = a.fragments(spark, d).select((F.col("fragment_id") % 113).alias("cluster"), "fragment_id", "emotional_weight", (F.col("fragment_id") % 9).cast("double").alias("significance"))
    return g.build_episodes(f).select("cluster", "members", "first", F.col("weight").cast("double").alias("weight"))


def sagas(spark, d):
    m = a.messages(spark, d).groupBy("chat_id").agg(F.min_by(F.substring("content", 1, 6), "msg_id").alias("title"), F.collect_list("msg_id").alias("members"))
    return g.upsert_sagas(m).select("title_key", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


#: Keys of the demonstration queries only; a deployment passes its own.
KEYS = {"k1": b"0123456789abcdef0123456789abcdef", "k2": b"fedcba9876543210fedcba9876543210"}


def sealing(spark, d):
    """Every fragment sealed under one key, rotated to another, opened again: its digest and length, and the key in use."""
    f = a.fragments(spark, d).select("fragment_id", p.seal(F.col("content"), "memory_fragments", "content", "k1", KEYS["k1"]).alias("content"))
    out = p.rotate(f, "memory_fragments", ["content"], KEYS, "k2")
    text = p.open_(F.col("content"), "memory_fragments", "content", {"k2": KEYS["k2"]})
    wrong = p.open_(F.col("content"), "memory_fragments", "other", KEYS)
    return out.select("fragment_id", F.md5(F.encode(text, "UTF-8")).alias("digest"), F.length(text).cast("long").alias("chars"), wrong.isNull().alias("wrong_column_is_null"), F.split("content", ":")[1].alias("key_id"))


def blind_index(spark, d):
    """Blinded tokens of every message: as many distinct ones as plain ones, and their document frequency."""
    key = p.sub_key(KEYS["k1"], "messages", "content")
    tokens = r.exploded(a.messages(spark, d), ["msg_id"], F.array_distinct(t.index_tokens(F.col("content"))))
    named = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    blinded = named.withColumn("blind", F.get(p.blind(F.array("token"), key), F.lit(0)))
    return blinded.groupBy("blind").agg(F.sum("df").alias("df"), F.min("token").alias("token")).select("token", "df", F.length("blind").cast("long").alias("chars"))


def hash_check(spark, d):
    """Keyed content hash of every fragment."""
    return a.fragments(spark, d).select("fragment_id", t.content_hash(F.col("entity"), F.col("content")).alias("content_hash"))


Q = {
    "a8_entity_emotion_stats": stats, "a9_emotion_rates": rates, "a10_topic_slots": topics, "a25_baselines": baselines, "a11_event_arcs": arcs, "a12_high_days": high_days, "t27_replay": replay,
    "t21_anniversaries": anniversaries, "f21_z_scores": z, "f20_fading": fading, "a24_components": components, "a24_clusters": clusters, "a19_build_episodes": episodes, "a21_upsert_sagas": sagas,
    "e1_seal_rotate_open": sealing, "e3_blind_index": blind_index, "e4_content_hash": hash_check,
}

S = {
    "a8_entity_emotion_stats": a.sql("observations", "SELECT entity_id, dim, floor(epoch(last_at))::BIGINT AS last_s, round(n,6) AS n, round(hits,6) AS hits, round(mag,6) AS mag FROM st", **EVENTS),
    "a9_emotion_rates": a.sql("observations", "SELECT entity_id, dim, round((hits+3.0*p0)/(n+3.0),6) AS rate, round((hits+3.0*p0)/(n+3.0)/p0,6) AS lift FROM p0", **RATES),
    "a10_topic_slots": a.sql("observations", f"SELECT category, slot, dim, round(sum({FADE}),6) AS n, round(sum({FADE}*y)/sum({FADE}),6) AS mean FROM (SELECT *, max(t) OVER (PARTITION BY category, slot, dim) AS last_at FROM x) GROUP BY ALL", x=f"SELECT *, {SLOT} AS slot, CASE WHEN owner_id%2=0 THEN 'even' ELSE 'odd' END AS category FROM observations"),
    "a25_baselines": a.sql("observations", "SELECT owner_id, dim, slot, n, round(overall,6) AS overall, round((s::DOUBLE+8*overall)/(n+8),6) AS mu FROM (SELECT *, ((sum(s) OVER w)::DOUBLE+10*0.2::DOUBLE)/(sum(n) OVER w+10) AS overall FROM x WINDOW w AS (PARTITION BY owner_id, dim))", x=f"SELECT owner_id, dim, {SLOT} AS slot, count(*) AS n, sum(y::DECIMAL(25,12)) AS s FROM observations GROUP BY ALL"),
    "a11_event_arcs": a.sql("observations", "SELECT event, count(*) AS n, round(avg(y) FILTER (NOT f),6) AS before, round(avg(y) FILTER (f),6) AS after, round(avg(y) FILTER (f)-avg(y) FILTER (NOT f),6) AS delta FROM x GROUP BY event", x="SELECT y, owner_id||'/'||dim AS event, t::DATE >= DATE '2024-01-05' + (owner_id%20)::INT AS f FROM observations"),
    "a12_high_days": a.sql("fragments", "SELECT owner_id, strftime(day,'%Y-%m-%d') AS day, n, round(mean,6) AS mean, row_number() OVER (PARTITION BY owner_id ORDER BY day DESC) AS rank FROM (SELECT owner_id, created_at::DATE AS day, count(*) AS n, avg(emotional_weight) AS mean FROM fragments WHERE emotional_weight>=0.6 GROUP BY ALL HAVING count(*)>=3) QUALIFY rank<=5"),
    "t21_anniversaries": a.sql("fragments", f"SELECT fragment_id FROM (SELECT fragment_id, created_at + to_days((fragment_id%3-365*(fragment_id%2))::INT) + INTERVAL 8 HOUR AS l FROM fragments) WHERE strftime(l,'%m-%d')=strftime(make_timestamp({a.NOW}*1000000::BIGINT)+INTERVAL 8 HOUR,'%m-%d') AND year(l)<2024"),
    "f21_z_scores": a.sql("observations", "SELECT obs_id, round(z,6) AS z, round(pow(greatest(-2.0,least(2.0,z)),2),6) AS r2 FROM (SELECT obs_id, (y-m)/sd AS z FROM observations JOIN (SELECT dim, avg(y) AS m, stddev_pop(y) AS sd FROM observations GROUP BY 1) USING (dim))"),
    "f20_fading": a.sql("fragments", f"SELECT fragment_id, round(emotional_weight*pow(0.5::DOUBLE, (({a.NOW}-epoch(created_at))/86400.0)/(60+60*least(1.0,greatest(0.0,((fragment_id%5-2)/20.0::DOUBLE+0.1)/0.2)))),6) AS left FROM fragments"),
    "a24_components": "WITH RECURSIVE " + a.sql("fragments", "", **EDGES)[5:] + ", reach AS (SELECT fragment_id AS id, fragment_id AS r FROM fragments UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON both_.a=reach.r) SELECT id, min(r) AS component FROM reach GROUP BY id",
    "a24_clusters": "WITH RECURSIVE " + a.sql("fragments", "", **EDGES)[5:] + ", reach AS (SELECT fragment_id AS id, fragment_id AS r FROM fragments UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON both_.a=reach.r), c AS (SELECT id, min(r) AS component, count(*) AS size FROM reach GROUP BY id) SELECT component, id, size, row_number() OVER (PARTITION BY component ORDER BY id DESC) AS rank FROM c WHERE size>1 QUALIFY rank<=5",
    "a19_build_episodes": a.sql("fragments", "SELECT cluster, members, first, least(10.0, round(0.7*sig+0.3*(5+3*mean)))::DOUBLE AS weight FROM (SELECT fragment_id%113 AS cluster, count(*) AS members, min(fragment_id) AS first, avg(emotional_weight) AS mean, max((fragment_id%9)::DOUBLE) AS sig FROM fragments GROUP BY 1) WHERE members>=3 AND sig>=4"),
    "a21_upsert_sagas": a.sql("messages", f"SELECT {NORM.format('title')} AS title_key, count(*) AS n, string_agg(msg_id::VARCHAR, ',' ORDER BY msg_id) AS members FROM (SELECT msg_id, arg_min(content[1:6], msg_id) OVER (PARTITION BY chat_id) AS title FROM messages) GROUP BY 1"),
    "e1_seal_rotate_open": a.sql("fragments", "SELECT fragment_id, md5(content) AS digest, length(content) AS chars, TRUE AS wrong_column_is_null, 'k2' AS key_id FROM fragments"),
    "e3_blind_index": a.sql("messages", f"SELECT token, count(*) AS df, 16::BIGINT AS chars FROM (SELECT msg_id, unnest(list_distinct({TOKENS.format('content')})) AS token FROM messages) GROUP BY token"),
    "e4_content_hash": a.sql("fragments", f"SELECT fragment_id, sha256({NORM.format('entity')}||chr(0)||{NORM.format('content')}) AS content_hash FROM fragments"),
}
