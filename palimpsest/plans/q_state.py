"""Queries over model entries, routing, queues and reports on the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recall as r
from ..operators import state as o
from ..sources import adapter as a
from .q_recall import PLAIN, TOKENS, _vector_queries
from .q_tables import EPISODES, T, _episodes
from .q_upkeep import HOLDS

TYPES = ["immutable_fact", "stable_trait", "current_state", "active_hypothesis", "other"]
CATEGORIES = ["physical", "emotional", "situational", "relational", "unknown"]
CLASSES = ["hours", "day", "days", "until_event"]
pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
pick_sql = lambda words, i: f"[{', '.join(map(repr, words))}][({i}%{len(words)}+1)::INT]"
R6 = lambda c, name: F.round(c, 6).alias(name)


def expiry(spark, d):
    f, i = a.fragments(spark, d), F.col("fragment_id")
    stated = F.when(i % 9 == 0, F.timestamp_seconds(F.unix_timestamp("created_at") + (i % 200) * 86400))
    return f.select("fragment_id", F.unix_timestamp(o.state_expiry(F.col("created_at"), pick(CATEGORIES, i), pick(CLASSES, F.floor(i / 5)), stated)).alias("expires_at"))


def confidence(spark, d):
    i = F.col("fragment_id")
    return a.fragments(spark, d).select("fragment_id", R6(o.initial_confidence(pick(TYPES, i), pick(["direct_statement", "inferred", "observed"], i), F.col("confidence")), "confidence"))


def like(spark, d):
    return a.fragments(spark, d).select("fragment_id", F.coalesce(o.ascii_like(F.col("content"), "%The%ER%"), F.lit(False)).alias("met"))


def excluded(spark, d):
    return o.exclude_sources(a.fragments(spark, d), ["src1", "src2"]).select("fragment_id", "source")


def listed(spark, d):
    return o.list_episodes(_episodes(spark, d), "mature", "2024-01").select("memory_id", "weight")


def _routes(spark, d):
    tagged = a.fragments(spark, d).select("fragment_id", F.array("type", F.concat(F.lit("src"), (F.col("fragment_id") % 23).cast("string"))).alias("tags"))
    words = a.entities(spark, d).select(F.col("name").alias("tag"), "name", F.lit(0.6).alias("confidence"))
    return o.route_links(tagged, words.unionByName(spark.range(1).select(F.lit("fr").alias("tag"), F.lit("FRANCE").alias("name"), F.lit(0.85).alias("confidence"))), a.entities(spark, d), a.links(spark, d))


def routed(spark, d):
    return _routes(spark, d)[0]


def hints(spark, d):
    near = r.vector_topk(_vector_queries(spark, d), a.vectors(spark, d), 10).select("query_id", "fragment_id", F.round("similarity", 4).alias("similarity"))
    return o.vector_hints(near, a.links(spark, d)).select("query_id", "entity_id", "votes", F.round("score", 4).alias("score"))


def backfill(spark, d):
    short = a.questions(spark, d).select(F.col("query_id").alias("entity_id"), F.regexp_extract("query", r"^(\S+)", 1).alias("term"))
    return o.alias_backfill(short, a.fragments(spark, d), a.links(spark, d)).select("entity_id", "fragment_id", "rank")


def _behind(spark, d):
    m = a.messages(spark, d)
    return a.fragments(spark, d).select("fragment_id", (F.col("fragment_id") % 100).alias("owner_id")).join(m.select("owner_id", "msg_id", "ts"), "owner_id")


def sources(spark, d):
    hits = a.fragments(spark, d).select((F.col("fragment_id") % 40).alias("query_id"), "fragment_id", (F.floor(F.col("fragment_id") / 40) + 1).alias("rank"))
    return o.hit_sources(hits, _behind(spark, d), a.messages(spark, d), last=4)


def span(spark, d):
    f = a.fragments(spark, d)
    said = _behind(spark, d).filter("fragment_id % 2 = 0").select("fragment_id", "ts")
    out = o.observed_span(f.select((F.col("fragment_id") % 37).alias("entry_id"), "fragment_id"), f, said)
    return out.select("entry_id", F.unix_timestamp("first_at").alias("first_at"), F.unix_timestamp("last_at").alias("last_at"))


def proposals(spark, d):
    l = a.links(spark, d)  # noqa: E741
    own, place = l.filter("entity_id < 100").select("fragment_id", F.col("entity_id").alias("a")), l.filter("entity_id >= 100").select("fragment_id", F.col("entity_id").alias("b"))
    found = own.join(place, "fragment_id").select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    known = found.filter("b % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("rejected").alias("status"))
    queue = o.queue_proposals(found, known)
    return o.decide_proposals(queue, queue.filter("a % 2 = 0").select("a", "b", (F.col("b") % 2 == 0).alias("accepted")))


def verdicts(spark, d):
    e = _episodes(spark, d)
    v = e.select("memory_id", pick(["distorted", "accurate", "fabricated"], F.col("memory_id")).alias("verdict"))
    return o.apply_episode_verdicts(e, v.unionByName(v)).select("memory_id", "weight", "status")


def relations(spark, d):
    i = F.col("entity_id")
    at = F.when(i % 3 > 0, F.timestamp_seconds(F.lit(a.NOW) - (i % 45) * 86400))
    e = a.entities(spark, d).select("entity_id", F.when(i % 2 == 0, "friend").alias("relation"), pick(["low", "high", "medium", "none"], i).alias("confidence"), F.when(i % 5 > 0, i % 60).alias("evaluated_count"), at.alias("evaluated_at"))
    return o.relation_queue(e, a.links(spark, d), a.fragments(spark, d), a.now())


def queues(spark, d):
    i = F.col("fragment_id")
    tags = F.when(i % 3 == 0, F.array(F.lit("needs_review"))).otherwise(F.array().cast("array<string>"))
    m = a.fragments(spark, d).select("owner_id", i.alias("entry_id"), pick(TYPES, F.floor(i / 50)).alias("type"), "status", "evidence_count", "confidence", (i % 7).alias("priority"), tags.alias("tags"))
    return o.review_queues(m)


def checks(spark, d):
    """Fragments are the model; their last evidence is as old as the id's number of days within two months."""
    i = F.col("fragment_id")
    seen = F.when(i % 4 > 0, F.timestamp_seconds(F.lit(a.NOW) - i % 60 * 86400))
    m = a.fragments(spark, d).select("owner_id", i.alias("entry_id"), pick(TYPES, F.floor(i / 50)).alias("type"), "status", "content", seen.alias("last_evidence_at"))
    return o.trait_checks(m, a.fragments(spark, d), a.now())


def judged(spark, d):
    """A judge's links of every fragment to a place, some of them there already, and rematches."""
    i = F.col("fragment_id")
    f = a.fragments(spark, d)
    first = f.select("fragment_id", (F.lit(100) + i % 25).cast("long").alias("entity_id"), F.when(i % 4 > 0, i % 4 / F.lit(4.0)).alias("confidence"))
    now = o.add_judged_links(a.links(spark, d), first.unionByName(first), 0.3)
    again = f.select("fragment_id", (F.lit(100) + (i + 1) % 25).cast("long").alias("entity_id"), F.lit(1.0).alias("confidence")).filter("fragment_id % 2 = 0")
    return o.add_judged_links(now, again, fixed=0.6).select("fragment_id", "entity_id", R6(F.col("confidence"), "confidence"))


def report(spark, d):
    members = a.fragments(spark, d).filter("fragment_id % 3 = 0").select("entity", "created_at", "fragment_id").join(_episodes(spark, d).select("memory_id", "entity", "created_at"), ["entity", "created_at"])
    return o.consolidation_report(_episodes(spark, d), members).withColumn("last_run", F.unix_timestamp("last_run"))


def browsed(spark, d):
    return o.browse(a.entities(spark, d), a.links(spark, d), a.fragments(spark, d), "ER")


Q = {
    "f24_state_expiry": expiry, "f25_initial_confidence": confidence, "f32_ascii_like": like, "p10_exclude_sources": excluded, "p9_list_episodes": listed, "j11_route_links": routed, "j14_vector_hints": hints, "j44_alias_backfill": backfill,
    "j43_hit_sources": sources, "a23_observed_span": span, "t9_merge_queue": proposals, "t24_episode_verdicts": verdicts, "a14_relation_queue": relations, "p22_review_queues": queues, "p22_trait_checks": checks, "t24_judged_links": judged, "a38_consolidation_report": report, "p24_browse": browsed,
}

_hours = " ".join(f"WHEN cat='{c}' AND cls='{k}' THEN {h}" for c, row in (*o.TTL_HOURS.items(), ("unknown", o.TTL_HOURS["emotional"])) for k, h in row.items())
_caps = " ".join(f"WHEN '{k}' THEN {v}" for k, v in o.DIRECT_CAPS.items())
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BEHIND = "SELECT fragment_id, msg_id, ts FROM (SELECT fragment_id, fragment_id%100 AS owner_id FROM fragments) JOIN messages USING (owner_id)"
FOUND = "SELECT DISTINCT x.entity_id AS a, y.entity_id AS b FROM links x JOIN links y USING (fragment_id) WHERE x.entity_id<100 AND y.entity_id>=100"
OWN = "SELECT DISTINCT entity_id, fragment_id FROM links"

S = {
    "f24_state_expiry": a.sql("fragments", f"SELECT fragment_id, CASE WHEN fragment_id%9=0 THEN epoch(created_at)::BIGINT+least(fragment_id%200,90)*86400 ELSE epoch(created_at)::BIGINT+3600*(CASE {_hours} ELSE 48 END) END AS expires_at FROM (SELECT *, {pick_sql(CATEGORIES, 'fragment_id')} AS cat, {pick_sql(CLASSES, '(fragment_id//5)')} AS cls FROM fragments)"),
    "f25_initial_confidence": a.sql("fragments", f"SELECT fragment_id, round(CASE fragment_id%3 WHEN 0 THEN least(CASE {pick_sql(TYPES, 'fragment_id')} {_caps} ELSE 0.85 END::DOUBLE, confidence+0.15::DOUBLE) WHEN 1 THEN least(0.7::DOUBLE, confidence) ELSE confidence END, 6) AS confidence FROM fragments"),
    "f32_ascii_like": a.sql("fragments", f"SELECT fragment_id, coalesce({LOW.format('content')} LIKE '%the%er%', FALSE) AS met FROM fragments"),
    "p10_exclude_sources": a.sql("fragments", "SELECT fragment_id, source FROM fragments WHERE source IS NULL OR source NOT IN ('src1','src2')"),
    "p9_list_episodes": a.sql("fragments", "SELECT memory_id, weight FROM ep WHERE status='mature' AND strftime(created_at,'%Y-%m')='2024-01'", ep=EPISODES),
    "j11_route_links": a.sql("fragments entities links", """SELECT fragment_id, entity_id, max(confidence) AS confidence FROM (SELECT fragment_id, unnest([type, 'src'||(fragment_id%23)]) AS tag FROM fragments) t
        JOIN (SELECT name AS tag, entity_id, 0.6::DOUBLE AS confidence FROM entities UNION ALL SELECT 'fr', entity_id, 0.85::DOUBLE FROM entities WHERE name='FRANCE') USING (tag) WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.fragment_id=t.fragment_id AND l.entity_id IN (SELECT e.entity_id FROM entities e WHERE e.name=CASE WHEN tag='fr' THEN 'FRANCE' ELSE tag END)) GROUP BY 1,2"""),
    "j14_vector_hints": a.sql("vectors links", "SELECT query_id, entity_id, votes, round(score,4) AS score FROM (SELECT query_id, entity_id, count(*) AS votes, round(count(*)*max(round(similarity,4)),6) AS score FROM vec JOIN (SELECT DISTINCT fragment_id, entity_id FROM links) USING (fragment_id) GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id)<=3", **PLAIN),
    "j44_alias_backfill": a.sql("fragments links questions", "SELECT entity_id, fragment_id, row_number() OVER (PARTITION BY entity_id ORDER BY fragment_id DESC) AS rank FROM m QUALIFY rank<=15", tm=r"SELECT query_id AS entity_id, lower(regexp_extract(query, '^(\S+)', 1)) AS term FROM questions WHERE length(regexp_extract(query, '^(\S+)', 1)) BETWEEN 2 AND 4",
                               m=f"SELECT DISTINCT entity_id, fragment_id FROM fragments JOIN tm ON {HOLDS} WHERE status='active' AND NOT EXISTS (SELECT 1 FROM links l WHERE l.fragment_id=fragments.fragment_id AND l.entity_id=tm.entity_id)"),
    "j43_hit_sources": a.sql("fragments messages", """SELECT query_id, fragment_id, msg_id, row_number() OVER (PARTITION BY query_id, fragment_id ORDER BY ts, msg_id) AS place FROM (SELECT fragment_id%40 AS query_id, * FROM bh WHERE fragment_id//40+1<=3
        QUALIFY row_number() OVER (PARTITION BY fragment_id ORDER BY ts DESC, msg_id DESC)<=4)""", bh=BEHIND),
    "a23_observed_span": a.sql("fragments messages", "SELECT fragment_id%37 AS entry_id, epoch(min(coalesce(f, created_at)))::BIGINT AS first_at, epoch(max(coalesce(l, created_at)))::BIGINT AS last_at FROM fragments LEFT JOIN (SELECT fragment_id, min(ts) AS f, max(ts) AS l FROM bh WHERE fragment_id%2=0 GROUP BY 1) USING (fragment_id) GROUP BY 1", bh=BEHIND),
    "t9_merge_queue": a.sql("links", "SELECT a, b, CASE WHEN a%3=0 THEN 'rejected' WHEN a%2=0 THEN CASE WHEN b%2=0 THEN 'approved' ELSE 'rejected' END ELSE 'pending' END AS status FROM fo", fo=FOUND),
    "t24_episode_verdicts": a.sql("fragments", "SELECT memory_id, CASE WHEN memory_id%3=0 THEN weight*0.5 ELSE weight END AS weight, CASE WHEN memory_id%3=2 THEN 'archived' ELSE status END AS status FROM ep", ep=EPISODES),
    "a14_relation_queue": a.sql("fragments links entities", f"""SELECT entity_id, n, n_new, reason FROM (SELECT *, CASE WHEN entity_id%2=1 AND n>=5 AND (last=0 OR n>=last+3) THEN 'new' WHEN entity_id%4 IN (0,2) AND (seen IS NULL OR seen<{T}-INTERVAL 1 DAY) AND n_new>=3 THEN 'recheck' WHEN entity_id%4=1 AND seen<{T}-INTERVAL 30 DAY AND n_new>=5 THEN 'stale' END AS reason
        FROM (SELECT entity_id, last, seen, count(*) AS n, count(*) FILTER (seen IS NULL OR f.created_at>seen) AS n_new FROM ee JOIN ow USING (entity_id) JOIN fragments f USING (fragment_id) WHERE f.status='active' GROUP BY ALL)) WHERE reason IS NOT NULL""",
                               ow=OWN, ee=f"SELECT entity_id, CASE WHEN entity_id%5>0 THEN entity_id%60 ELSE 0 END AS last, CASE WHEN entity_id%3>0 THEN {T}-to_days((entity_id%45)::INT) END AS seen FROM entities"),
    "p22_trait_checks": a.sql("fragments", """SELECT owner_id, entry_id, place, b.fragment_id, shared, rank FROM tr LEFT JOIN (SELECT e AS entry_id, fragment_id, n AS shared, row_number() OVER (PARTITION BY e ORDER BY n DESC, fragment_id) AS rank FROM
        (SELECT x.entry_id AS e, y.fragment_id, count(*) AS n FROM xt x JOIN yt y USING (owner_id, token) WHERE x.entry_id<>y.fragment_id GROUP BY 1,2 HAVING count(*)>=2) QUALIFY rank<=5) b USING (entry_id)""",
        tr=f"SELECT owner_id, fragment_id AS entry_id, content, row_number() OVER (PARTITION BY owner_id ORDER BY CASE WHEN fragment_id%4=0 THEN 1 ELSE 0 END DESC, CASE WHEN fragment_id%4>0 THEN fragment_id%60 END DESC, fragment_id) AS place FROM (SELECT *, {pick_sql(TYPES, '(fragment_id//50)')} AS t4 FROM fragments WHERE status='active') WHERE t4='stable_trait' QUALIFY place<=5",
        xt=f"SELECT owner_id, entry_id, unnest(list_distinct({TOKENS.format('content')})) AS token FROM tr", yt=f"SELECT owner_id, fragment_id, unnest(list_distinct({TOKENS.format('content')})) AS token FROM fragments WHERE status='active' AND epoch(created_at)>={a.NOW}-14*86400"),
    "t24_judged_links": a.sql("fragments links", """SELECT fragment_id, entity_id, round(confidence,6) AS confidence FROM n1 UNION ALL SELECT fragment_id, 100+(fragment_id+1)%25, 0.6 FROM fragments WHERE fragment_id%2=0 AND NOT EXISTS (FROM n1 WHERE n1.fragment_id=fragments.fragment_id AND n1.entity_id=100+(fragments.fragment_id+1)%25)""",
        n1="SELECT fragment_id, entity_id, confidence FROM links UNION ALL SELECT fragment_id, 100+fragment_id%25, c FROM (SELECT fragment_id, CASE WHEN fragment_id%4=0 THEN 0.7 ELSE fragment_id%4/4.0 END::DOUBLE AS c FROM fragments) x WHERE c>=0.3 AND NOT EXISTS (FROM links l WHERE l.fragment_id=x.fragment_id AND l.entity_id=100+x.fragment_id%25)"),
    "p22_review_queues": a.sql("fragments", """SELECT owner_id, fragment_id AS entry_id, 'validate' AS queue FROM fr WHERE type4='active_hypothesis' AND evidence_count>=3 UNION ALL SELECT owner_id, fragment_id, 'review' FROM (SELECT * FROM fr WHERE type4='stable_trait' AND fragment_id%3=0
        QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY fragment_id%7 DESC, confidence, fragment_id)<=5)""", fr=f"SELECT *, {pick_sql(TYPES, '(fragment_id//50)')} AS type4 FROM fragments WHERE status='active'"),
    "a38_consolidation_report": a.sql("fragments", "SELECT count(*) AS episodes, count(*) FILTER (n>0) AS with_sources, coalesce(sum(n),0)::BIGINT AS consolidated, max(epoch(created_at)::BIGINT) AS last_run FROM ep LEFT JOIN (SELECT entity, created_at, count(*) AS n FROM fragments WHERE fragment_id%3=0 GROUP BY 1,2) USING (entity, created_at)", ep=EPISODES),
    "p24_browse": a.sql("fragments links entities", f"""SELECT entity_id, n_fragments, fragment_id, rank FROM (SELECT entity_id FROM entities) JOIN (SELECT entity_id, count(*) AS n_fragments FROM ow JOIN fragments USING (fragment_id) GROUP BY 1) USING (entity_id)
        LEFT JOIN (SELECT entity_id, fragment_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, fragment_id DESC) AS rank FROM ow JOIN fragments USING (fragment_id) WHERE contains({LOW.format('content')}, 'er') QUALIFY rank<=5) USING (entity_id)""", ow=OWN),
}
