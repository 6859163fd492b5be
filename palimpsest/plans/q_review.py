"""Reports and review queues over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as s
from ..operators import review as o
from ..sources import adapter as a
from .q_recall import AGE, BM25, TOKENS, _fts
from .q_tables import DAYS, _model

R6 = lambda c: F.round(c, 6).alias(c)


def brightness(spark, d):
    f = a.fragments(spark, d).withColumn("days", s.age_days(F.col("created_at"), a.now()))
    return f.select("fragment_id", F.round(o.brightness(F.col("emotional_weight"), F.col("days"), F.col("read_count"), F.col("status")), 6).alias("brightness"))


def constellation(spark, d):
    return o.constellation(a.fragments(spark, d), a.links(spark, d), a.entities(spark, d)).select("entity_id", "name", "total", "cooling", R6("depth"), "stars", "first_star")


def health(spark, d):
    return o.health(a.fragments(spark, d), a.links(spark, d).filter("confidence < 0.7"), a.entities(spark, d))


def flash(spark, d):
    return o.flash_groups(a.fragments(spark, d).withColumn("day", F.to_date("created_at").cast("string")), ["owner_id", "day"], 2, 0.8, 0.9).select("owner_id", "day", "strong", "top")


def modes(spark, d):
    m = a.messages(spark, d).select((F.col("chat_id") % 7).alias("batch"), F.col("role").alias("mode"), "msg_id")
    return o.dominant_mode(m)


def known(spark, d):
    return o.known_entities(a.fragments(spark, d), a.now(), 20, 10).select("entity", "n", F.unix_timestamp("last").alias("last_s"))


def status(spark, d):
    return o.status_candidates(a.fragments(spark, d), a.now(), 10).select("entity", "fragment_id", "rank", "n")


def by_date(spark, d):
    return o.recall_by_date(a.fragments(spark, d), a.messages(spark, d), "2024-01-03", "2024-01-05", "the").select("kind", "id", F.col("day").cast("string").alias("day"))


def spot(spark, d):
    return o.link_spot_check(a.links(spark, d), a.entities(spark, d)).select("fragment_id", "entity_id", "name")


def continues(spark, d):
    return o.continuation(a.messages(spark, d)).select("msg_id", "gap", R6("overlap"))


def versions(spark, d):
    e = a.observations(spark, d).withColumn("passed", F.col("y") < 0.5)
    return o.versions(e, "owner_id", "obs_id", "passed").select("owner_id", "obs_id", "version", "active", "last_passed")


def decay(spark, d):
    m = _model(spark, d).withColumns({
        "type": F.when(F.col("entry_id") % 2 == 0, "current_state").otherwise("active_hypothesis"), "category": F.when(F.col("entry_id") % 3 == 0, "physical").otherwise("emotional"), "evidence_count": F.col("entry_id") % 5,
        "expires_at": F.when(F.col("entry_id") % 7 == 0, F.timestamp_seconds(F.unix_timestamp("created_at") + 20 * 86400)), "last_evidence_at": F.when(F.col("entry_id") % 11 == 0, F.timestamp_seconds(F.unix_timestamp("created_at") + 5 * 86400)),
    })
    return o.model_decay(m, a.now(), {"physical": 240.0, "emotional": 120.0}).select("owner_id", "entry_id", "status")


MODEL = """SELECT owner_id, entry_id, CASE WHEN entry_id%2=0 THEN 'current_state' ELSE 'active_hypothesis' END AS type, CASE WHEN entry_id%3=0 THEN 240.0 ELSE 120.0 END AS ttl, entry_id%5 AS ev, epoch(day) AS c,
    CASE WHEN entry_id%7=0 THEN epoch(day)+20*86400 END AS ex, CASE WHEN entry_id%11=0 THEN epoch(day)+5*86400 END AS le FROM (SELECT owner_id, t::DATE AS day, min(obs_id) AS entry_id FROM observations GROUP BY ALL)"""


def _patterns(spark, d):
    return a.questions(spark, d).select(F.col("query_id").alias("pattern_id"), F.col("query").alias("content"))


PATTERN = {"pt": f"SELECT pattern_id, len(w) AS n, unnest(w) AS token FROM (SELECT query_id AS pattern_id, list_distinct({TOKENS.format('query')}) AS w FROM questions)"}


def matches(spark, d):
    """All messages against all patterns, whoever they are of."""
    texts = a.messages(spark, d).select(F.col("msg_id").alias("fragment_id"), "content")
    return o.pattern_match(texts, _patterns(spark, d)).select("fragment_id", "pattern_id", R6("share"))


def pairs(spark, d):
    return o.pattern_pairs(_patterns(spark, d), 0.2).select("pattern_id", "other_id", R6("share"))


def _relations(spark, d):
    e = a.entities(spark, d)
    return e.select("entity_id", F.when(F.col("entity_id") < 100, F.lit(100) + F.col("entity_id") % 30).otherwise(F.col("entity_id") % 20).alias("related_id"))


def relations(spark, d):
    e = a.entities(spark, d).withColumn("status", F.when(F.col("entity_id") % 9 == 0, "merged").otherwise(F.col("status")))
    return o.relation_health(_relations(spark, d), e, a.links(spark, d), a.now(), 5).select("entity_id", "related_id", "state")


def stale(spark, d):
    return o.stale_vectors(a.vectors(spark, d), a.fragments(spark, d))


def demoted(spark, d):
    f = a.fragments(spark, d)
    src = f.select("fragment_id", F.explode(F.array(F.col("fragment_id") % 97, F.lit(1000) + F.col("fragment_id") % 89)).alias("msg_id"))
    return o.demote_same_source(f, src, f.filter("fragment_id % 50 = 7")).select("fragment_id", R6("emotional_weight"))


def context(spark, d):
    return o.entity_context(_fts(spark, d), a.links(spark, d), a.entities(spark, d)).select("query_id", "entity_id", "name", "n", "rank")


def losses(spark, d):
    x = a.fragments(spark, d).select((F.col("fragment_id") % 3 == 0).alias("correct"), (F.col("fragment_id") % 4 != 1).alias("stored"), (F.col("fragment_id") % 5 != 2).alias("retrieved"))
    return o.loss_attribution(x)


def stable(spark, d):
    m = a.messages(spark, d).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run"), F.col("msg_id").alias("turn_id"))
    return o.stability(m.filter("(turn_id * 7 + run * 13 + (turn_id % 11) * run) % 10 < 7"))


def sampled(spark, d):
    return o.sample(a.fragments(spark, d), 42, 25).select("fragment_id")


def cleanup(spark, d):
    return o.zero_fragment_cleanup(a.entities(spark, d), a.links(spark, d).filter("entity_id % 3 <> 0"), a.now()).select("entity_id", "status")


def applied(spark, d):
    p = a.observations(spark, d).select("owner_id", F.col("obs_id").alias("proposal_id"), F.col("t").alias("created_at"), F.when(F.col("obs_id") % 3 == 0, "applied").otherwise("pending").alias("status"))
    p = p.withColumn("applied_at", F.when(F.col("status") == "applied", F.timestamp_seconds(F.unix_timestamp("created_at") + 86400)))
    return o.auto_apply(p, a.now()).select("owner_id", "proposal_id", "rank")


def confirmed(spark, d):
    log = a.observations(spark, d).select(F.col("obs_id").alias("log_id"), (F.col("owner_id") % 10).alias("target_id"), F.col("t").alias("at"))
    return o.confirm_once(log).select("log_id", "target_id")


Q = {
    "f22_brightness": brightness, "a7_constellation": constellation, "a5_health": health, "a20_flash_groups": flash, "a34_batch_mode": modes, "a37_known_entities": known, "a39_status_candidates": status, "p16_recall_by_date": by_date,
    "p20_link_spot_check": spot, "w5_continuation": continues, "w8_versions": versions, "t4_model_decay": decay, "j20_pattern_match": matches, "j21_pattern_pairs": pairs, "j26_relation_health": relations, "j42_stale_vectors": stale,
    "j35_demote_same_source": demoted, "j37_entity_context": context, "a31_loss_attribution": losses, "a32_stability": stable, "l4_sample": sampled, "t30_zero_fragment_cleanup": cleanup, "w10_auto_apply": applied, "t14_confirm_once": confirmed,
}
S = {
    "f22_brightness": a.sql("fragments", "SELECT fragment_id, round(CASE status WHEN 'cooling' THEN least(raw,0.3) WHEN 'frozen' THEN least(raw,0.12) ELSE raw END,6) AS brightness FROM y",
                            x=f"SELECT *, {AGE.format('created_at')} AS days, CASE WHEN emotional_weight=0 THEN 0.3 ELSE emotional_weight END AS ew FROM fragments",
                            y="SELECT *, least(1.0::DOUBLE, exp(-CASE WHEN ew>=0.8 THEN 0.005 WHEN ew>=0.6 THEN 0.01 WHEN ew>=0.4 THEN 0.02 ELSE 0.04 END*days)+least(0.3::DOUBLE, ln(1+read_count)*0.08)) AS raw FROM x"),
    "a7_constellation": a.sql("fragments links entities", "SELECT entity_id, name, total, cooling, round(0.4+1.2*total/max(total) OVER (),6) AS depth, least(40,total) AS stars, first_star FROM g",
                              w="SELECT l.entity_id, e.name, f.fragment_id, f.status, row_number() OVER (PARTITION BY l.entity_id ORDER BY CASE f.status WHEN 'active' THEN 0 WHEN 'cooling' THEN 1 ELSE 2 END, l.confidence DESC, emotional_weight DESC, f.fragment_id) AS k FROM links l JOIN entities e USING (entity_id) JOIN fragments f USING (fragment_id) WHERE e.status='active'",
                              g="SELECT entity_id, name, count(*) AS total, count(*) FILTER (status='cooling') AS cooling, arg_min(fragment_id, k) AS first_star FROM w GROUP BY ALL"),
    "a5_health": a.sql("fragments links entities", "SELECT (SELECT count(*) FROM entities WHERE status='active') AS active_entities, (SELECT count(*) FROM entities WHERE status='seed') AS seeds, (SELECT count(*) FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM l)) AS entities_without_links, (SELECT count(*) FROM fragments WHERE status='active' AND fragment_id NOT IN (SELECT fragment_id FROM l)) AS unclassified", l="SELECT * FROM links WHERE confidence<0.7"),
    "a20_flash_groups": a.sql("fragments", "SELECT owner_id, strftime(created_at,'%Y-%m-%d') AS day, count(*) FILTER (emotional_weight>=0.8) AS strong, max(emotional_weight) AS top FROM fragments GROUP BY 1,2 HAVING strong>=2 AND top>=0.9"),
    "a34_batch_mode": a.sql("messages", "SELECT batch, arg_max(mode, n*1000000000-first) AS mode, sum(n)::BIGINT AS messages FROM (SELECT chat_id%7 AS batch, role AS mode, count(*) AS n, min(msg_id) AS first FROM messages GROUP BY 1,2) GROUP BY 1"),
    "a37_known_entities": a.sql("fragments", f"SELECT entity, count(*) AS n, epoch(max(created_at))::BIGINT AS last_s FROM fragments WHERE created_at>={DAYS(20)} GROUP BY 1 ORDER BY last_s DESC, n DESC, entity LIMIT 10"),
    "a39_status_candidates": a.sql("fragments", f"SELECT entity, fragment_id, rank, n FROM (SELECT entity, fragment_id, row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, fragment_id DESC) AS rank, count(*) OVER (PARTITION BY entity) AS n FROM fragments WHERE status IN ('active','cooling') AND created_at>={DAYS(10)}) WHERE rank<=15 AND n>=2"),
    "p16_recall_by_date": a.sql("fragments messages", "SELECT kind, id, strftime(day,'%Y-%m-%d') AS day FROM (SELECT 'fragment' AS kind, fragment_id AS id, created_at::DATE AS day, content FROM fragments UNION ALL SELECT 'message', msg_id, ts::DATE, content FROM messages) WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-05' AND contains(content,'the')"),
    "p20_link_spot_check": a.sql("links entities", "SELECT fragment_id, entity_id, name FROM (SELECT * FROM links WHERE confidence<0.75 ORDER BY created_at DESC, fragment_id, entity_id LIMIT 5) JOIN entities USING (entity_id)"),
    "w5_continuation": a.sql("messages", "SELECT msg_id, gap, round(o,6) AS overlap FROM (SELECT msg_id, gap, len(list_intersect(w,b))/least(len(w),len(b)) AS o FROM y WHERE len(w)>0 AND len(b)>0) WHERE gap<=1800 AND o>=0.3",
                             x=f"SELECT msg_id, chat_id, ts, list_distinct({TOKENS.format('content')}) AS w FROM messages", y="SELECT msg_id, w, lag(w) OVER k AS b, (epoch(ts)-epoch(lag(ts) OVER k))::BIGINT AS gap FROM x WINDOW k AS (PARTITION BY chat_id ORDER BY ts, msg_id)"),
    "w8_versions": a.sql("observations", "SELECT owner_id, obs_id, version, version=max(version) OVER p AS active, max(CASE WHEN y<0.5 THEN version END) OVER p AS last_passed FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY obs_id) AS version FROM observations) WINDOW p AS (PARTITION BY owner_id)"),
    "t4_model_decay": a.sql("observations", f"SELECT owner_id, entry_id, CASE WHEN type='current_state' AND CASE WHEN ex IS NOT NULL THEN ex<={a.NOW} ELSE ({a.NOW}-c)/3600>=ttl END THEN 'resolved' WHEN type='active_hypothesis' AND ({a.NOW}-coalesce(le,c))/86400>=14 AND ev<3 THEN 'abandoned' ELSE 'active' END AS status FROM m", m=MODEL),
    "j20_pattern_match": a.sql("messages questions", "SELECT fragment_id, pattern_id, round(share,6) AS share FROM (SELECT msg_id AS fragment_id, pattern_id, count(*)/n AS share FROM tk JOIN pt USING (token) GROUP BY msg_id, pattern_id, n HAVING count(*)/n>0.35) QUALIFY row_number() OVER (PARTITION BY fragment_id ORDER BY share DESC, pattern_id)=1",
                               tk=f"SELECT msg_id, unnest(list_distinct({TOKENS.format('content')})) AS token FROM messages", **PATTERN),
    "j21_pattern_pairs": a.sql("questions", "SELECT x.pattern_id, y.pattern_id AS other_id, round(count(*)/least(x.n,y.n),6) AS share FROM pt x JOIN pt y USING (token) WHERE x.pattern_id<y.pattern_id GROUP BY x.pattern_id, y.pattern_id, x.n, y.n HAVING count(*)/least(x.n,y.n)>=0.2", **PATTERN),
    "j26_relation_health": a.sql("links entities", f"SELECT r.entity_id, r.related_id, CASE WHEN p.entity_id IS NULL OR p.entity_id%9=0 THEN 'dead' WHEN coalesce(h.last>={DAYS(5)}, FALSE) THEN 'alive' ELSE 'stale' END AS state FROM r LEFT JOIN entities p ON p.entity_id=r.related_id LEFT JOIN h ON h.entity_id=r.entity_id AND h.related_id=r.related_id",
                                 r="SELECT entity_id, CASE WHEN entity_id<100 THEN 100+entity_id%30 ELSE entity_id%20 END AS related_id FROM entities", h="SELECT r.entity_id, r.related_id, max(x.created_at) AS last FROM r JOIN links x ON x.entity_id=r.entity_id JOIN links y ON y.entity_id=r.related_id AND y.fragment_id=x.fragment_id GROUP BY 1,2"),
    "j42_stale_vectors": a.sql("vectors fragments", "SELECT fragment_id FROM vectors WHERE fragment_id NOT IN (SELECT fragment_id FROM fragments WHERE status='active')"),
    "j35_demote_same_source": a.sql("fragments", "SELECT fragment_id, round(CASE WHEN fragment_id%50<>7 AND fragment_id IN (SELECT fragment_id FROM s WHERE msg_id IN (SELECT msg_id FROM s WHERE fragment_id%50=7)) THEN greatest(0.1::DOUBLE, emotional_weight/2) ELSE emotional_weight END,6) AS emotional_weight FROM fragments", s="SELECT fragment_id, unnest([fragment_id%97, 1000+fragment_id%89]) AS msg_id FROM fragments"),
    "j37_entity_context": a.sql("fragments questions links entities", "SELECT query_id, entity_id, name, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, entity_id) AS rank FROM (SELECT query_id, entity_id, name, count(*) AS n FROM fts JOIN (SELECT DISTINCT fragment_id, entity_id FROM links) USING (fragment_id) JOIN entities e USING (entity_id) WHERE e.status='active' GROUP BY ALL) QUALIFY rank<=5", **BM25),
    "a31_loss_attribution": a.sql("fragments", "SELECT CASE WHEN fragment_id%3=0 THEN 'none' WHEN fragment_id%4=1 THEN 'extraction' WHEN fragment_id%5=2 THEN 'retrieval' ELSE 'answering' END AS cause, count(*) AS n FROM fragments GROUP BY 1"),
    "a32_stability": a.sql("messages", "SELECT (SELECT count(*) FROM z) AS runs, (SELECT round(avg(n),6) FROM z) AS mean, (SELECT round(stddev_pop(n)/avg(n),6) FROM z) AS cv, (SELECT max(n)-min(n) FROM z) AS spread, (SELECT round(avg(b/(p.n+q.n-b)),6) FROM (SELECT x.run AS i, y.run AS j, count(*) AS b FROM r x JOIN r y USING (turn_id) WHERE x.run<y.run GROUP BY 1,2) JOIN z p ON p.run=i JOIN z q ON q.run=j) AS jaccard",
                           r="SELECT run, msg_id AS turn_id FROM messages, range(5) t(run) WHERE (msg_id*7+run*13+(msg_id%11)*run)%10<7", z="SELECT run, count(DISTINCT turn_id) AS n FROM r GROUP BY 1"),
    "l4_sample": a.sql("fragments", "SELECT fragment_id FROM fragments WHERE read_count=0 ORDER BY md5(fragment_id::VARCHAR||'/42'), fragment_id LIMIT 25"),
    "t30_zero_fragment_cleanup": a.sql("links entities", f"SELECT entity_id, CASE WHEN status='active' AND entity_id NOT IN (SELECT entity_id FROM links WHERE entity_id%3<>0) AND created_at<{DAYS(7)} THEN 'superseded' ELSE status END AS status FROM entities"),
    "w10_auto_apply": a.sql("observations", f"SELECT owner_id, proposal_id, rank FROM (SELECT owner_id, obs_id AS proposal_id, row_number() OVER (PARTITION BY owner_id ORDER BY t, obs_id) AS rank FROM observations WHERE obs_id%3<>0) LEFT JOIN (SELECT owner_id, count(*) AS used FROM observations WHERE obs_id%3=0 AND floor(epoch(t))+86400>={a.NOW}-7*86400 GROUP BY 1) USING (owner_id) WHERE rank<=2-coalesce(used,0)"),
    "t14_confirm_once": a.sql("observations", "SELECT log_id, target_id FROM (SELECT obs_id AS log_id, owner_id%10 AS target_id, floor(epoch(t))-floor(epoch(lag(t) OVER (PARTITION BY owner_id%10 ORDER BY t, obs_id))) AS gap FROM observations) WHERE gap IS NULL OR gap>600"),
}
