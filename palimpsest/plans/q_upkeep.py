"""Link and model upkeep over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import upkeep as o
from ..sources import adapter as a
from .q_linking import MENTION, NORM, _terms
from .q_tables import EPISODES, _episodes

R6 = lambda c: F.round(c, 6).alias(c)
HOLDS = "contains(lower(content), term)"


def guards(spark, d):
    """Guards over each question's first word and each message."""
    q = a.messages(spark, d).select("msg_id", "content", F.regexp_extract("content", r"^(\S+)", 1).alias("name"))
    return q.select("msg_id", o.is_time_phrase(F.col("name")).alias("no_name"), o.has_negation(F.col("content")).alias("negates"), o.is_preference_drift(F.col("content")).alias("drifts"), o.has_concrete_detail(F.col("content")).alias("concrete"))


def _aliases(spark, d):
    own = a.entities(spark, d).filter("entity_id < 10").select("entity_id", F.col("name").alias("alias"), F.lit(0).alias("place"))
    return own.unionByName(_terms(spark, d).select((F.col("entity_id") + 200).alias("entity_id"), F.col("term").alias("alias"), F.lit(1).alias("place")))


def resolved(spark, d):
    return o.resolve_keyword(a.fragments(spark, d), _aliases(spark, d), ["src3"]).select("fragment_id", "entity_id", "via")


def auto(spark, d):
    terms = _terms(spark, d).withColumn("term_rank", F.lit(0))
    return o.auto_link(a.fragments(spark, d), terms, a.links(spark, d)).select("entity_id", "fragment_id", "rank", "confidence")


def ambiguous(spark, d):
    n = a.entities(spark, d).select("entity_id", F.col("name").alias("alias"))
    return o.ambiguous_aliases(n)


def tags(spark, d):
    e = a.entities(spark, d)
    other = F.concat(F.lit("src"), ((F.col("entity_id") * 7) % 20).cast("string"))
    rel = e.filter("entity_id < 5").select("entity_id", ((F.col("entity_id") * 7) % 20).alias("related_id"))
    return o.tag_relations(e.withColumn("tags", F.array(other, F.lit("FRANCE"))), rel)


def unlinked(spark, d):
    return o.unlinked_mentions(a.fragments(spark, d), _terms(spark, d), a.links(spark, d)).select("entity_id", "fragment_id", "total", "rank")


def replicated(spark, d):
    f = a.fragments(spark, d).select(F.col("owner_id").alias("memory_id"), "fragment_id", F.col("owner_id").alias("entity_id"))
    return o.replicate_episode(f, a.links(spark, d))


def evidence(spark, d):
    ev = a.fragments(spark, d).select((F.col("fragment_id") % 37).alias("entry_id"), "fragment_id")
    return o.recompute_evidence(ev, a.fragments(spark, d))


def graduates(spark, d):
    return o.graduation(a.links(spark, d), a.entities(spark, d))


def _model(spark, d):
    e = a.observations(spark, d).groupBy("owner_id", "dim").agg(F.min("obs_id").alias("entry_id"), F.count(F.lit(1)).alias("evidence_count"), F.avg("y").alias("mean"))
    return e.select("owner_id", F.col("dim").alias("type"), "entry_id", "evidence_count", F.round("mean", 7).alias("confidence"), (F.col("entry_id") % 7).alias("source_diversity"), F.when(F.col("entry_id") % 6 == 0, "resolved").otherwise("active").alias("status"))


MODEL = "SELECT owner_id, dim AS type, min(obs_id) AS entry_id, count(*) AS evidence_count, round(avg(y),7) AS confidence, min(obs_id)%7 AS source_diversity, CASE WHEN min(obs_id)%6=0 THEN 'resolved' ELSE 'active' END AS status FROM observations GROUP BY owner_id, dim"


def context(spark, d):
    m = _model(spark, d).withColumn("owner_id", F.col("owner_id") % 10)
    return o.model_context(m, {"click": 10, "view": 8}).select("owner_id", "type", "entry_id", "rank")


def tiers(spark, d):
    m = _model(spark, d).withColumn("confidence", F.col("confidence") + 0.3)
    return o.profile_tiers(m).select("entry_id", "tier")


def log(spark, d):
    e = a.observations(spark, d).select((F.col("owner_id") % 5).alias("owner_id"), F.to_date("t").cast("string").alias("day"), F.col("obs_id").alias("id"), F.col("dim").alias("line"))
    return o.daily_log(e, 10)


def corrected(spark, d):
    c = _episodes(spark, d).filter("memory_id % 3 = 0").select(F.lit("memory").alias("target_type"), F.col("memory_id").alias("target_id"))
    return o.record_corrections(_episodes(spark, d), c.unionByName(c)).select("memory_id", R6("weight"))


def closed(spark, d):
    f = a.fragments(spark, d).withColumn("value_tags", F.when(F.col("fragment_id") % 2 == 0, F.array(F.lit("future_hook"))).otherwise(F.array(F.lit("x"), F.lit("future_hook"))))
    return o.close_intentions(f, f.filter("fragment_id % 3 = 0")).select("fragment_id", F.array_join("value_tags", ",").alias("tags"))


def growth(spark, d):
    e = a.entities(spark, d).withColumn("last_count", (F.col("entity_id") * 13) % 60)
    return o.overview_growth(e, a.links(spark, d)).select("entity_id", "n")


def backlog(spark, d):
    """The newest active fragments of more than ten characters without a label."""
    f = a.fragments(spark, d).filter("status = 'active' and quality is null").filter(F.length("content") > 10)
    return f.orderBy(F.desc("created_at"), "fragment_id").limit(20).select("fragment_id")


Q = {
    "p7_guards": guards, "j12_resolve_keyword": resolved, "j9_auto_link": auto, "j10_ambiguous_aliases": ambiguous, "j25_tag_relations": tags, "j28_unlinked_mentions": unlinked, "j39_replicate_episode": replicated, "a22_recompute_evidence": evidence,
    "a17_graduation": graduates, "p21_model_context": context, "a27_profile_tiers": tiers, "w11_daily_log": log, "t13_corrections": corrected, "t15_close_intentions": closed, "a40_overview_growth": growth, "p19_needs_insight": backlog,
}

S = {
    "p7_guards": a.sql("messages", rf"""SELECT msg_id, length(trim(name))<=1 OR regexp_matches(trim(name), '^[0-9]+$|^[{t.NUMERALS}年月日號号時时分點点\s:/.-]+$|^(?:{t.WEEK})[{t.NUMERALS}日天]$|(?:期間|时期|時期|階段|阶段)$') AS no_name, regexp_matches(lower(content), '{o.NEGATION}') AS negates,
        regexp_matches(lower(content), '{o.PAST}') AND regexp_matches(lower(content), '{o.CHANGE}') AS drifts, regexp_matches(content, '[0-9]') OR regexp_matches(content, '{t.KEY}') AS concrete FROM (SELECT *, regexp_extract(content, '^(\S+)', 1) AS name FROM messages)"""),
    "j12_resolve_keyword": a.sql("fragments entities questions", f"SELECT fragment_id, entity_id, 'entity' AS via FROM ex UNION ALL SELECT fragment_id, min(entity_id)+200, 'content' FROM fragments JOIN tm ON {HOLDS} WHERE fragment_id NOT IN (SELECT fragment_id FROM ex) GROUP BY 1",
                                 ex="SELECT fragment_id, min(entity_id) AS entity_id FROM fragments JOIN entities e ON e.name=entity AND entity_id<10 AND e.name<>'src3' GROUP BY 1", **MENTION),
    "j9_auto_link": a.sql("fragments links questions", "SELECT entity_id, fragment_id, rank, 0.4::DOUBLE AS confidence FROM (SELECT entity_id, fragment_id, row_number() OVER (PARTITION BY entity_id ORDER BY fragment_id DESC) AS rank FROM m WHERE entity_id IN (SELECT entity_id FROM m GROUP BY 1 HAVING count(*)<=8)) WHERE rank<=5",
                          **MENTION, m=f"SELECT DISTINCT entity_id, fragment_id FROM fragments JOIN tm ON {HOLDS} WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.fragment_id=fragments.fragment_id AND l.entity_id=tm.entity_id)"),
    "j10_ambiguous_aliases": a.sql("entities", "SELECT DISTINCT unnest([x.entity_id, y.entity_id]) AS entity_id, unnest([x.a, y.a]) AS alias FROM n x JOIN n y ON x.entity_id<>y.entity_id AND contains(y.a, x.a)", n=f"SELECT DISTINCT entity_id, {NORM.format('name')} AS a FROM entities"),
    "j25_tag_relations": a.sql("entities", "SELECT DISTINCT least(e.entity_id, p.entity_id) AS a, greatest(e.entity_id, p.entity_id) AS b FROM (SELECT entity_id, unnest(['src'||(entity_id*7%20), 'FRANCE']) AS tag FROM entities) e JOIN entities p ON p.name=tag AND p.entity_id<>e.entity_id WHERE NOT EXISTS (SELECT 1 FROM entities r WHERE r.entity_id<5 AND least(r.entity_id, r.entity_id*7%20)=least(e.entity_id, p.entity_id) AND greatest(r.entity_id, r.entity_id*7%20)=greatest(e.entity_id, p.entity_id))"),
    "j28_unlinked_mentions": a.sql("fragments links questions", "SELECT entity_id, fragment_id, count(*) OVER (PARTITION BY entity_id) AS total, row_number() OVER (PARTITION BY entity_id ORDER BY fragment_id DESC) AS rank FROM m QUALIFY rank<=15",
                                   **MENTION, m=f"SELECT DISTINCT entity_id, fragment_id FROM fragments JOIN tm ON {HOLDS} WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.fragment_id=fragments.fragment_id AND l.entity_id=tm.entity_id)"),
    "j39_replicate_episode": a.sql("fragments links", "SELECT owner_id AS memory_id, l.entity_id, count(*) AS n FROM fragments JOIN (SELECT DISTINCT fragment_id, entity_id FROM links) l USING (fragment_id) WHERE l.entity_id<>owner_id GROUP BY 1,2 HAVING count(*)>=3"),
    "a22_recompute_evidence": a.sql("fragments", "SELECT fragment_id%37 AS entry_id, count(*) AS evidence_count, greatest(1, count(DISTINCT CASE WHEN status='active' THEN created_at::DATE END)) AS source_diversity FROM fragments GROUP BY 1"),
    "a17_graduation": a.sql("links entities", "SELECT entity_id, count(*) AS n_links, count(DISTINCT links.created_at::DATE) AS days FROM links JOIN entities e USING (entity_id) WHERE e.status='seed' GROUP BY 1 HAVING count(*)>=3"),
    "p21_model_context": a.sql("observations", "SELECT owner_id, type, entry_id, rank FROM (SELECT owner_id%10 AS owner_id, type, entry_id, row_number() OVER (PARTITION BY owner_id%10, type ORDER BY confidence DESC, entry_id) AS rank FROM m WHERE status='active') WHERE rank<=CASE type WHEN 'click' THEN 10 WHEN 'view' THEN 8 ELSE 1073741824 END", m=MODEL),
    "a27_profile_tiers": a.sql("observations", "SELECT entry_id, CASE WHEN source_diversity>=5 AND evidence_count>=30 THEN 'core' WHEN source_diversity>=3 THEN 'high' ELSE 'normal' END AS tier FROM m WHERE status='active' AND confidence+0.3>=0.5", m=MODEL),
    "w11_daily_log": a.sql("observations", "SELECT owner_id, day, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY day DESC) AS rank FROM (SELECT owner_id%5 AS owner_id, strftime(t,'%Y-%m-%d') AS day, arg_max(dim, obs_id) AS line FROM observations GROUP BY 1,2)) WHERE rank<=10"),
    "t13_corrections": a.sql("fragments", "SELECT memory_id, round(CASE WHEN memory_id%3=0 THEN greatest(1.0::DOUBLE, weight*0.3) ELSE weight END,6) AS weight FROM ep", ep=EPISODES),
    "t15_close_intentions": a.sql("fragments", "SELECT fragment_id, CASE WHEN fragment_id%3=0 THEN CASE WHEN fragment_id%2=0 THEN 'fulfilled' ELSE 'x' END WHEN fragment_id%2=0 THEN 'future_hook' ELSE 'x,future_hook' END AS tags FROM fragments"),
    "a40_overview_growth": a.sql("entities links", "SELECT entity_id, n FROM entities JOIN (SELECT entity_id, count(*) AS n FROM links GROUP BY 1) USING (entity_id) WHERE n-entity_id*13%60>=3 AND n>=1.3*(entity_id*13%60)"),
    "p19_needs_insight": a.sql("fragments", "SELECT fragment_id FROM fragments WHERE status='active' AND quality IS NULL AND length(content)>10 ORDER BY created_at DESC, fragment_id LIMIT 20"),
}
