"""User-model queries over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..operators import emotion
from ..operators import model as o
from ..operators import recall as r
from ..sources import adapter as a
from .q_linking import NORM
from .q_recall import TOKENS
from .q_tables import DAYS
from .q_upkeep import MODEL, _model

R6 = lambda c: F.round(c, 6).alias(c)


def similar(spark, d):
    q = a.vectors(spark, d).filter("fragment_id % 100 = 0").select(F.col("fragment_id").alias("query_id"), "embedding")
    return o.similar_pairs(r.vector_topk(q, a.vectors(spark, d), 5, 0.0), 0.3).select("a", "b", F.round("similarity", 4).alias("similarity"))


def _entries(spark, d):
    """An owner's entries: its fragments with an id divisible by 100, named by their entity and their first word."""
    f = a.fragments(spark, d).filter("fragment_id % 100 = 0")
    names = F.array_compact(F.array("entity", F.get(t.index_tokens(F.col("content")), F.lit(0))))
    return f.select("owner_id", F.col("fragment_id").alias("entry_id"), "entity", "created_at", "content", names.alias("names"), (F.col("fragment_id") % 300).alias("priority"), "confidence")


ENTRY = {"en": f"SELECT owner_id, fragment_id AS entry_id, created_at, content, fragment_id%300 AS priority, confidence, list_filter([entity, ({TOKENS.format('content')})[1]], lambda x: x<>'') AS names FROM fragments WHERE fragment_id%100=0",
         "et": f"SELECT owner_id, entry_id, created_at, len(w) AS n, unnest(w) AS token FROM (SELECT *, list_distinct({TOKENS.format('content')}) AS w FROM en)",
         "nm": "SELECT owner_id, entry_id, unnest(names) AS name FROM en",
         "fw": f"SELECT *, {TOKENS.format('content')} AS ws FROM fragments"}


def evidence(spark, d):
    return o.match_evidence(a.fragments(spark, d), _entries(spark, d)).select("fragment_id", "entry_id", "score")


def anchors(spark, d):
    return o.anchors(_entries(spark, d), a.fragments(spark, d), 10).select("entry_id", "fragment_id", "shared", "rank")


def _states(spark, d):
    return a.fragments(spark, d).select("owner_id", F.col("fragment_id").alias("entry_id"), "content")


def conflicts(spark, d):
    return o.state_conflicts(_states(spark, d)).select("entry_id", "other_id", R6("overlap"))


def review(spark, d):
    """Fragments of even ids are states, others traits."""
    x = _states(spark, d)
    return o.needs_review(x.filter("floor(entry_id / 50) % 2 = 0"), x.filter("floor(entry_id / 50) % 2 = 1"), least=40)


def independent(spark, d):
    """Fragments of even numbers in their owner's order are new evidence, the others known."""
    f = a.fragments(spark, d).select((F.col("fragment_id") % 50).alias("entry_id"), "fragment_id", F.explode(F.array(F.col("fragment_id") % 30, F.col("fragment_id") % 41 + 100)).alias("msg_id"))
    new = F.floor(F.col("fragment_id") / 50) % 2 == 0
    return o.independence(f.filter(new), f.filter(~new)).select("entry_id", "fragment_id", R6("known_share"), "independent")


def noisy(spark, d):
    """Fragments of odd numbers were written a year or two before now, on their own days."""
    f = a.fragments(spark, d).withColumn("created_at", F.add_months(F.date_add(F.to_date(a.now()), (F.col("fragment_id") % 3).cast("int")), (-12 * (F.col("fragment_id") % 2)).cast("int")).cast("timestamp"))
    return o.noisy_topk(f, a.now(), 5).select("owner_id", "fragment_id", F.round("draw", 4).alias("draw"), "rank")


def proposed(spark, d):
    m = _model(spark, d).withColumn("confidence", F.col("confidence") + 0.4)
    return o.proposals(m, m.filter("entry_id % 5 = 0")).select("entry_id")


def surfaced(spark, d):
    f = a.fragments(spark, d)
    log = f.filter("fragment_id % 12 = 0").select("fragment_id", F.timestamp_seconds(F.lit(a.NOW) - (F.col("fragment_id") % 20) * 86400).alias("at"))
    return o.surfacing(f, log, a.now()).select("owner_id", "fragment_id", F.round("draw", 4).alias("draw"), "rank")


def dominant(spark, d):
    sums = emotion.sums_in_order(a.observations(spark, d).withColumnRenamed("owner_id", "id").filter("y is not null"), ["id", "dim"])
    e = sums.select("id", "dim", s.half_up(F.col("s") / F.col("n"), 2).alias("score"))
    dims = ["view", "click", "purchase", "signup", "logout", "login", "error", "cart", "search"]
    return o.dominant_emotion(e, dims).select("id", "dim", "score")


def drift(spark, d):
    """A probe is a turn's place; the anchors are the turns of one conversation in ten."""
    m = a.messages(spark, d).select((F.col("msg_id") % 1000).alias("probe"), F.col("msg_id").alias("answer_id"), "content", "chat_id")
    return o.drift(m.filter("chat_id % 10 > 0").drop("chat_id"), m.filter("chat_id % 10 = 0").drop("chat_id")).select("probe", "pairs", R6("score"), "passed")


def stored(spark, d):
    m = a.messages(spark, d).select(F.col("chat_id").alias("question"), F.col("msg_id").alias("turn_id"))
    return o.evidence_recall(m.filter("turn_id % 3 <> 0"), m)


def uncertain(spark, d):
    e = a.entities(spark, d).withColumn("relationship_confidence", F.when(F.col("entity_id") % 3 == 0, "low").when(F.col("entity_id") % 3 == 1, "medium").otherwise("high"))
    return o.uncertain_entities(e, a.links(spark, d), a.fragments(spark, d))


def queue(spark, d):
    e = a.entities(spark, d).withColumns({"last_count": (F.col("entity_id") * 13) % 60, "overview_at": F.when(F.col("entity_id") % 4 > 0, F.timestamp_seconds(F.lit(a.NOW) - (F.col("entity_id") % 50) * 86400))})
    return o.overview_queue(e, a.links(spark, d), a.now()).select("entity_id", "reason", "n")


def fresh(spark, d):
    g = a.observations(spark, d).groupBy("owner_id", "dim").agg(F.max("t").alias("last"))
    days = F.floor((F.lit(a.NOW) - F.unix_timestamp("last")) / 86400) * (F.col("owner_id") % 9)
    return g.select("owner_id", "dim", o.freshness(days).alias("freshness"))


def merged(spark, d):
    m = _model(spark, d)
    into = m.groupBy("owner_id").agg(F.min("entry_id").alias("into"))
    sur = m.join(into, "owner_id").filter("entry_id <> into").select("entry_id", "into")
    return o.merge_entries(m, sur, 0.05).select("entry_id", "evidence_count", R6("confidence"), "status")


def pool(spark, d):
    e = a.observations(spark, d).select((F.col("owner_id") % 5).alias("owner_id"), "obs_id", F.col("t").alias("at"))
    return o.working_pool(e, 30).select("owner_id", "obs_id", "pool")


Q = {
    "j17_similar_pairs": similar, "j18_match_evidence": evidence, "j19_anchors": anchors, "j22_state_conflicts": conflicts, "j22_needs_review": review, "l5_noisy_topk": noisy, "j41_independence": independent, "t17_proposals": proposed, "t19_surfacing": surfaced, "a35_dominant_emotion": dominant,
    "a36_drift": drift, "a30_evidence_recall": stored, "a13_uncertain_entities": uncertain, "t22_overview_queue": queue, "f23_freshness": fresh, "t12_merge_entries": merged, "w14_working_pool": pool,
}
FT = lambda distinct: f"SELECT owner_id, fragment_id, created_at, unnest({distinct}({TOKENS.format('content')})) AS token FROM fragments"
BI = "CASE WHEN length({0})>=2 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i::BIGINT, 2))) ELSE [] END"
STATE = {"st": f"SELECT owner_id, entry_id, len(w) AS n, unnest(w) AS token FROM (SELECT owner_id, fragment_id AS entry_id, list_distinct({TOKENS.format('content')}) AS w FROM fragments)"}
U = lambda k: f"((('0x'||substr(md5(fragment_id::VARCHAR||'/1{k}'),1,8))::BIGINT::DOUBLE+1)/(pow(2.0::DOUBLE,32)+1))"
S = {
    "j17_similar_pairs": a.sql("vectors", "SELECT least(q,f) AS a, greatest(q,f) AS b, round(max(sim),4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, f) AS k FROM x WHERE sim>=0) WHERE k<=5 AND q<>f AND sim>=0.3 GROUP BY 1,2", x="SELECT p.fragment_id AS q, v.fragment_id AS f, round(list_cosine_similarity(p.embedding::DOUBLE[], v.embedding::DOUBLE[]),6) AS sim FROM vectors p, vectors v WHERE p.fragment_id%100=0"),
    "j18_match_evidence": a.sql("fragments", """SELECT fragment_id, entry_id, score FROM (SELECT fragment_id, entry_id, round(sum(s),6) AS score FROM (SELECT fragment_id, entry_id, 0.3::DOUBLE*count(*) AS s FROM ft JOIN et USING (owner_id, token) GROUP BY ALL
        UNION ALL SELECT fragment_id, entry_id, (3*contains(entity,name)::INT+2*(contains(lower(entity),lower(name)) OR contains(lower(name),lower(entity)))::INT+2*(contains(content,name) AND list_contains(ws,regexp_extract(lower(name),'[\\p{L}\\p{N}]+')))::INT)::DOUBLE FROM fw JOIN nm USING (owner_id)) GROUP BY 1,2)
        JOIN en USING (entry_id) WHERE score>=3 QUALIFY row_number() OVER (PARTITION BY fragment_id ORDER BY score DESC, priority DESC, confidence DESC, entry_id)=1""".replace("\\\\", "\\"), **ENTRY, ft=FT("")),
    "j19_anchors": a.sql("fragments", "SELECT entry_id, fragment_id, shared, row_number() OVER (PARTITION BY entry_id ORDER BY shared DESC, fragment_id) AS rank FROM (SELECT entry_id, fragment_id, count(*) AS shared FROM et JOIN ft USING (owner_id, token) WHERE abs(epoch(et.created_at)-epoch(ft.created_at))<=864000 GROUP BY ALL HAVING count(*)>=4) QUALIFY rank<=50", **ENTRY, ft=FT("list_distinct")),
    "j22_state_conflicts": a.sql("fragments", "SELECT x.entry_id, y.entry_id AS other_id, round(count(*)/least(x.n,y.n),6) AS overlap FROM st x JOIN st y USING (owner_id, token) WHERE x.entry_id<y.entry_id GROUP BY x.entry_id, y.entry_id, x.n, y.n HAVING count(*)/least(x.n,y.n)>0.5", **STATE),
    "j22_needs_review": a.sql("fragments", "SELECT entry_id, string_agg(DISTINCT why, ',' ORDER BY why) AS why FROM (SELECT unnest([a,b]) AS entry_id, 'state' AS why FROM (SELECT x.entry_id AS a, y.entry_id AS b FROM s0 x JOIN s0 y USING (owner_id, token) WHERE x.entry_id<y.entry_id GROUP BY x.entry_id, y.entry_id, x.n, y.n HAVING count(*)/least(x.n,y.n)>0.5) UNION ALL SELECT x.entry_id, 'trait' FROM s0 x JOIN s1 y USING (owner_id, token) GROUP BY x.entry_id, y.entry_id HAVING count(*)>=40) GROUP BY 1", **STATE,
                              s0="SELECT * FROM st WHERE floor(entry_id/50)%2=0", s1="SELECT * FROM st WHERE floor(entry_id/50)%2=1"),
    "j41_independence": a.sql("fragments", "SELECT entry_id, fragment_id, round(count(o.msg_id)/count(*),6) AS known_share, count(o.msg_id)/count(*)<0.3 AS independent FROM f n LEFT JOIN (SELECT DISTINCT entry_id, msg_id FROM f WHERE floor(fragment_id/50)%2=1) o USING (entry_id, msg_id) WHERE floor(fragment_id/50)%2=0 GROUP BY 1,2", f="SELECT fragment_id%50 AS entry_id, fragment_id, unnest([fragment_id%30, fragment_id%41+100]) AS msg_id FROM fragments"),
    "l5_noisy_topk": a.sql("fragments", "SELECT owner_id, fragment_id, round(draw,4) AS draw, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY draw DESC, fragment_id) AS rank FROM x) WHERE rank<=5",
                           x=f"SELECT owner_id, fragment_id, round(CASE WHEN emotional_weight=0 THEN 0.5 ELSE emotional_weight END+(fragment_id%3=0 AND fragment_id%2=1)::INT+0.15*sqrt(-2*ln({U('a')}))*cos(2*3.141592653589793*{U('b')}),6) AS draw FROM fragments"),
    "t17_proposals": a.sql("observations", "SELECT entry_id FROM m WHERE confidence+0.4>=0.7 AND evidence_count>=3 AND source_diversity>=3 AND entry_id%5<>0", m=MODEL),
    "t19_surfacing": a.sql("fragments", "SELECT owner_id, fragment_id, round(draw,4) AS draw, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY draw DESC, fragment_id) AS rank FROM x) WHERE rank<=2",
                           x=f"SELECT owner_id, fragment_id, round(CASE WHEN emotional_weight=0 THEN 0.5 ELSE emotional_weight END+0.15*sqrt(-2*ln({U('a')}))*cos(2*3.141592653589793*{U('b')}),6) AS draw FROM fragments WHERE injected_count=0 AND created_at<{DAYS(3)} AND NOT (fragment_id%12=0 AND fragment_id%20<=7)"),
    "a35_dominant_emotion": a.sql("observations", "SELECT id, arg_max(dim, s*100-p/1000) AS dim, max(s) AS score FROM (SELECT owner_id AS id, dim, round(avg(y),2) AS s, list_position(['view','click','purchase','signup','logout','login','error','cart','search'], dim) AS p FROM observations GROUP BY 1,2) WHERE s>0.2 AND p>0 GROUP BY 1"),
    "a36_drift": a.sql("messages", "SELECT probe, count(*) AS pairs, round(avg(len(list_intersect(x,y))/greatest(len(list_distinct(list_concat(x,y))),1)),6) AS score, avg(len(list_intersect(x,y))/greatest(len(list_distinct(list_concat(x,y))),1))>=0.2 AS passed FROM (SELECT probe, b AS x FROM m WHERE c%10>0) JOIN (SELECT probe, b AS y FROM m WHERE c%10=0) USING (probe) GROUP BY 1",
                       m=f"SELECT probe, c, {BI.format('n')} AS b FROM (SELECT msg_id%1000 AS probe, chat_id AS c, {NORM.format('content')} AS n FROM messages)"),
    "a30_evidence_recall": a.sql("messages", "SELECT (SELECT round(avg((msg_id%3<>0)::INT),6) FROM messages) AS turns, round(avg(x),6) AS any_share, round(avg(y),6) AS all_share FROM (SELECT chat_id, max((msg_id%3<>0)::INT) AS x, min((msg_id%3<>0)::INT) AS y FROM messages GROUP BY 1)"),
    "a13_uncertain_entities": a.sql("links entities fragments", "SELECT entity_id, CASE entity_id%3 WHEN 0 THEN 'low' ELSE 'medium' END AS relationship_confidence, count(*) AS n FROM links JOIN entities e USING (entity_id) JOIN fragments f USING (fragment_id) WHERE f.status='active' AND entity_id%3<2 GROUP BY 1,2 HAVING count(*)>=10"),
    "t22_overview_queue": a.sql("links entities", "SELECT entity_id, reason, n FROM x WHERE reason IS NOT NULL ORDER BY CASE reason WHEN 'missing' THEN 0 WHEN 'grown' THEN 1 ELSE 2 END, n DESC, entity_id LIMIT 20",
                                x="SELECT entity_id, n, CASE WHEN entity_id%4=0 THEN 'missing' WHEN n-entity_id*13%60>=3 AND n>=1.3*(entity_id*13%60) THEN 'grown' WHEN entity_id%50>30 THEN 'old' END AS reason FROM entities JOIN (SELECT entity_id, count(*) AS n FROM links GROUP BY 1) USING (entity_id)"),
    "f23_freshness": a.sql("observations", f"SELECT owner_id, dim, CASE WHEN d<=7 THEN 1.0 WHEN d<=30 THEN 0.85 WHEN d<=90 THEN 0.6 WHEN d<=180 THEN 0.3 ELSE 0.1 END::DOUBLE AS freshness FROM (SELECT owner_id, dim, floor(({a.NOW}-floor(epoch(last)))/86400)*(owner_id%9) AS d FROM (SELECT owner_id, dim, max(t) AS last FROM observations GROUP BY 1,2))"),
    "t12_merge_entries": a.sql("observations", "SELECT entry_id, evidence_count+coalesce(more,0)::BIGINT AS evidence_count, round(greatest(confidence, coalesce(best, confidence)),6) AS confidence, CASE WHEN entry_id IN (SELECT entry_id FROM sv) THEN 'superseded' ELSE status END AS status FROM m LEFT JOIN (SELECT p AS entry_id, sum(evidence_count) AS more, max(confidence) AS best FROM sv GROUP BY 1) USING (entry_id)",
                               m=MODEL, sv="SELECT x.entry_id, x.evidence_count, x.confidence, y.entry_id AS p FROM m x JOIN m y ON y.owner_id=x.owner_id AND y.entry_id=(SELECT min(z.entry_id) FROM m z WHERE z.owner_id=x.owner_id) WHERE x.entry_id<>y.entry_id AND abs(x.confidence-y.confidence)<=0.05+1e-9"),
    "w14_working_pool": a.sql("observations", "SELECT owner_id, obs_id, least(count(*) OVER (PARTITION BY owner_id ORDER BY s RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW),5) AS pool FROM (SELECT owner_id%5 AS owner_id, obs_id, floor(epoch(t))::BIGINT AS s FROM observations)"),
}
