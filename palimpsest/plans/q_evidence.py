"""Queries of the user model under evidence and of status reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as s
from ..operators import emotion
from ..operators import evidence as o
from ..operators import status as st
from ..sources import adapter as a
from .q_emotion import SLOT
from .q_linking import MENTION, _terms
from .q_screening import _pick, _pick_sql
from .q_upkeep import MODEL, _model

R6 = lambda c: F.round(c, 6).alias(c)
TYPES = ["stable_trait", "current_state", "active_hypothesis", "immutable_fact"]


def evidence(spark, d):
    """Every observation is evidence of its owner's entry of its dimension."""
    i = F.col("entry_id")
    m = _model(spark, d).select("owner_id", F.col("type").alias("dim"), "entry_id", _pick(TYPES, i).alias("type"), F.when(i % 3 == 0, "direct_statement").otherwise("inferred").alias("quality"), "confidence", "evidence_count")
    obs = a.observations(spark, d)
    k = F.col("obs_id")
    ev = obs.join(m.select("owner_id", "dim", "entry_id"), ["owner_id", "dim"]).select(
        "entry_id", F.col("t").alias("at"), k.cast("long").alias("fragment_id"), (k % 5 != 0).alias("confirms"), (k % 2 == 0).alias("independent"), (k % 6).cast("long").alias("diversity")
    )
    out = o.apply_evidence(m, ev)
    return out.select("entry_id", "type", "quality", R6("confidence"), "evidence_count", "needs_review", F.col("contradictions").cast("long").alias("contradictions"))


PEN = "CASE WHEN independent THEN 0.12::DOUBLE ELSE 0.05::DOUBLE END"
EVIDENCE = {
    "mo": f"SELECT owner_id, type AS dim, entry_id, {_pick_sql(TYPES, 'entry_id')} AS type, CASE WHEN entry_id%3=0 THEN 'direct_statement' ELSE 'inferred' END AS quality, confidence::DOUBLE AS confidence, evidence_count FROM mm",
    "ev": "SELECT entry_id, obs_id, obs_id%5<>0 AS confirms, obs_id%2=0 AS independent, obs_id%6 AS diversity, row_number() OVER (PARTITION BY entry_id ORDER BY t, obs_id) AS n FROM observations JOIN mo USING (owner_id, dim)",
    "fo": """SELECT entry_id, 0::BIGINT AS n, type, quality, confidence, evidence_count, FALSE AS needs_review, 0::BIGINT AS contradictions FROM mo
        UNION ALL
        SELECT entry_id, n, CASE WHEN up THEN 'stable_trait' ELSE type END, CASE WHEN up THEN 'inferred' ELSE quality END, c2, evidence_count+1, needs_review OR (NOT confirms AND independent AND quality<>'direct_statement' AND confidence>=0.5), contradictions+(NOT confirms)::INT
        FROM (SELECT *, type='active_hypothesis' AND diversity>=3 AND c2>=0.70 AS up FROM (SELECT fo.entry_id, ev.n, type, quality, confidence, evidence_count, needs_review, contradictions, confirms, independent, diversity,
            CASE WHEN confirms THEN least(CASE type WHEN 'stable_trait' THEN CASE WHEN quality='direct_statement' THEN 0.99 ELSE 0.80 END WHEN 'current_state' THEN CASE WHEN quality='direct_statement' THEN 0.99 ELSE 0.75 END WHEN 'active_hypothesis' THEN 0.75 ELSE 0.99 END::DOUBLE,
                confidence + CASE type WHEN 'stable_trait' THEN CASE WHEN independent THEN 0.05 ELSE 0.02 END WHEN 'current_state' THEN CASE WHEN NOT independent THEN 0.04 WHEN quality='direct_statement' THEN 0.15 ELSE 0.08 END
                    WHEN 'active_hypothesis' THEN CASE WHEN independent THEN 0.10 ELSE 0.05 END ELSE 0.01 END::DOUBLE)
            ELSE CASE type WHEN 'stable_trait' THEN greatest(0.10::DOUBLE, confidence-PEN) WHEN 'current_state' THEN greatest(0.05::DOUBLE, confidence-PEN*1.2::DOUBLE) WHEN 'active_hypothesis' THEN greatest(0.05::DOUBLE, confidence-PEN*1.5::DOUBLE) ELSE greatest(0.20::DOUBLE, confidence-PEN*0.5::DOUBLE) END END AS c2
            FROM fo JOIN ev ON ev.entry_id=fo.entry_id AND ev.n=fo.n+1))""".replace("PEN", PEN),
}


def states(spark, d):
    """A user's turns are the companion's statements, others a deep cycle's."""
    m = a.messages(spark, d)
    by = F.when(F.col("sender") == "user", "companion").otherwise("deep_cycle")
    return o.upsert_states(m.select("owner_id", F.col("msg_id").alias("statement_id"), F.col("ts").alias("at"), by.alias("by"), "content", F.when(F.col("msg_id") % 3 > 0, F.lit(40)).alias("ttl")))


def targets(spark, d):
    """Questions are the contradicted episodes, fragments the model."""
    i, j = F.col("query_id"), F.col("fragment_id")
    v = a.questions(spark, d).select((i % 50).alias("owner_id"), i.alias("verdict_id"), F.col("query").alias("content"), F.array(i, i + 1).alias("fragment_ids"))
    m = a.fragments(spark, d).select("owner_id", j.alias("entry_id"), "content", "status", F.array(j, j + 3).alias("fragment_ids"), F.array((F.lit(100) + j % 25).cast("long")).alias("entity_ids"))
    return o.contradiction_targets(v, m, _terms(spark, d)).select("verdict_id", "entry_id", "fragment_id", "why")


IN = lambda text: f"contains(lower({text}), term)"
TARGETS = {
    **MENTION,
    "v": "SELECT query_id AS verdict_id, query_id%50 AS owner_id, query FROM questions",
    "live": "SELECT * FROM fragments WHERE status='active'",
    "sh": "SELECT DISTINCT verdict_id, fragment_id AS entry_id, 'fragment' AS why FROM v JOIN live USING (owner_id) WHERE fragment_id IN (verdict_id, verdict_id+1, verdict_id-3, verdict_id-2)",
    "nm": f"SELECT DISTINCT verdict_id, owner_id, entity_id FROM v JOIN tm ON {IN('query')}",
    "ab": f"SELECT owner_id, fragment_id AS entry_id, 100+fragment_id%25 AS entity_id FROM live UNION SELECT owner_id, fragment_id, entity_id FROM live JOIN tm ON {IN('content')}",
    "hi": "SELECT verdict_id, entry_id, 'entity' AS why FROM nm JOIN ab USING (owner_id, entity_id)",
}


def patterns(spark, d):
    m = _model(spark, d)
    g = a.observations(spark, d).groupBy("owner_id", "dim").agg(F.to_date(F.min("t")).alias("first_seen"), F.to_date(F.max("t")).alias("last_seen"))
    p = m.withColumnRenamed("type", "dim").join(g, ["owner_id", "dim"]).select("owner_id", "dim", F.col("entry_id").alias("pattern_id"), _pick(["active", "dormant", "superseded"], F.col("entry_id")).alias("status"), (F.col("entry_id") % 4).alias("contradiction_count"), "evidence_count", "confidence",
                                                                        F.date_add("first_seen", 5).alias("first_seen"), F.date_add("last_seen", -2).alias("last_seen"))
    k = F.col("obs_id")
    hits = a.observations(spark, d).join(p.select("owner_id", "dim", "pattern_id"), ["owner_id", "dim"]).select("pattern_id", k.alias("fragment_id"), F.to_date("t").alias("day"), (k % 7 == 0).alias("negated"), (k % 3 == 0).alias("drifted"))
    out = o.maintain_patterns(p, hits)
    return out.select("pattern_id", "status", F.col("contradiction_count").cast("long").alias("contradiction_count"), "evidence_count", R6("confidence"), F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


PATTERNS = {
    "p": f"""SELECT m.entry_id AS pattern_id, m.owner_id, m.type AS dim, {_pick_sql(['active', 'dormant', 'superseded'], 'm.entry_id')} AS status, m.entry_id%4 AS cc, m.evidence_count AS ec, m.confidence AS conf, g.f+5 AS fs, g.l-2 AS ls
        FROM mm m JOIN (SELECT owner_id, dim, min(t)::DATE AS f, max(t)::DATE AS l FROM observations GROUP BY 1,2) g ON g.owner_id=m.owner_id AND g.dim=m.type""",
    "h": "SELECT pattern_id, obs_id, t::DATE AS day, CASE WHEN obs_id%7=0 THEN 'contradiction' WHEN obs_id%3=0 THEN 'drift' ELSE 'evidence' END AS kind FROM observations JOIN p USING (owner_id, dim)",
    "g": """SELECT pattern_id, count(*) FILTER (kind='contradiction') AS no, arg_max(kind, epoch(day)*100000000::BIGINT+obs_id) FILTER (kind<>'contradiction') AS last, max(day) AS seen,
        min(day) FILTER (kind='evidence') AS f2, max(day) FILTER (kind='evidence') AS l2, count(DISTINCT obs_id) FILTER (kind='evidence') AS new FROM h GROUP BY 1""",
    "r": "SELECT *, ec+coalesce(new,0) AS ec2, coalesce(new,0)>0 AS has, least(fs,f2) AS b, greatest(ls,l2) AS e FROM p LEFT JOIN g USING (pattern_id)",
}
TAGS = [*o.CATEGORIES, "other"]


def profile(spark, d):
    i = F.col("entry_id")
    m = _model(spark, d).select((F.col("owner_id") % 20).alias("owner_id"), "entry_id", "status", F.array(_pick(TAGS, i), _pick(TAGS, i * 7 + 3)).alias("tags"), "source_diversity", (F.col("confidence") + 0.3).alias("confidence"))
    return o.profile_integration(m, m.filter("entry_id % 9 = 0"))


CAT = "list_filter([" + ",".join(repr(c) for c in o.CATEGORIES) + "], lambda c: list_contains(tags, c))[1]"
PROFILE = {
    "m": f"SELECT owner_id%20 AS owner_id, entry_id, status, [{_pick_sql(TAGS, 'entry_id')}, {_pick_sql(TAGS, '(entry_id*7+3)')}] AS tags, source_diversity AS sd, confidence+0.3 AS c FROM mm",
    "c": f"SELECT *, coalesce({CAT},'other') AS category FROM m WHERE status='active' AND sd>=2 AND c>=0.55 AND entry_id%9<>0",
    "t": "SELECT *, CASE WHEN category='basic' THEN 'locked' WHEN category IN ('personality','communication') THEN 'high' WHEN category IN ('career','social','personal_history','relationship_with_companion','creative_work') THEN 'medium' ELSE 'low' END AS tier FROM c",
}
RELATED = ["媽媽", "老朋友", "", "虛構的人", "網友"]


def seeded(spark, d):
    """Places are monitors of the owners of their numbers, source entities relationships; owners divisible by three have a model."""
    e, i = a.entities(spark, d), F.col("entity_id")
    m = e.filter("category = 'place'").select(
        (i % 50).alias("owner_id"), _pick(["monitor", "hypothesis"], i).alias("kind"), _pick(["verified", "active", "verified"], i).alias("status"), (F.lit(0.5) + i % 5 / F.lit(10.0)).alias("confidence"),
        F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("seen "), F.col("name"))).alias("evaluation"), F.when(i % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("look at "), F.col("name"))).alias("analysis"), F.lit("words").alias("trigger"),
    )
    r = e.filter("category = 'source'").select(
        (i % 50).alias("owner_id"), "name", _pick(RELATED, i).alias("relation"), _pick(["high", "Medium", "low", "0.9", "unsure"], i % 7).alias("confidence"), F.when(i % 11 == 0, "public_figure").alias("entity_type")
    )
    has = _model(spark, d).filter("owner_id % 3 = 0")
    return o.seed_model(m, r, has).select("owner_id", "type", "content", R6("confidence"), "quality", "origin")


SEED = {
    "mo": f"""SELECT entity_id%50 AS owner_id, {_pick_sql(['monitor', 'hypothesis'], 'entity_id')} AS kind, {_pick_sql(['verified', 'active', 'verified'], 'entity_id')} AS status, 0.5::DOUBLE+entity_id%5/10.0::DOUBLE AS confidence,
        CASE WHEN entity_id%4=0 THEN NULL ELSE 'seen '||name END AS e, CASE WHEN entity_id%3=0 THEN NULL ELSE 'look at '||name END AS an FROM entities WHERE category='place'""",
    "o1": """SELECT owner_id, CASE WHEN kind='monitor' THEN 'stable_trait' ELSE 'active_hypothesis' END AS type, CASE WHEN kind='monitor' THEN coalesce(e,an,'words') ELSE coalesce(an,'words') END AS content, confidence, 'inferred' AS quality, 'monitor' AS origin
        FROM mo WHERE (kind='monitor' AND status='verified' AND confidence>=0.7) OR (kind='hypothesis' AND status='active')""",
    "re": f"""SELECT entity_id%50 AS owner_id, name, {_pick_sql(RELATED, 'entity_id')} AS rel, {_pick_sql(['0.85', '0.6', '0.4', '0.9', '0.5'], '(entity_id%7)')}::DOUBLE AS c FROM entities WHERE category='source' AND entity_id%11<>0""",
    "o2": "SELECT owner_id, CASE WHEN c>=0.85 THEN 'immutable_fact' ELSE 'stable_trait' END AS type, name||': '||rel AS content, greatest(0.5::DOUBLE,c) AS confidence, CASE WHEN c>=0.85 THEN 'direct_statement' ELSE 'inferred' END AS quality, 'relation' AS origin FROM re WHERE rel NOT IN ('','虛構的人')",
}


def _edited(spark, d):
    i = F.col("query_id")
    e = a.questions(spark, d).select(i.alias("edit_id"), _pick(["update", "delete", "create"], i).alias("op"), F.when(i % 6 == 5, i + 10000000).otherwise(i * 7 % 400).alias("fragment_id"), F.when(i % 4 > 0, F.col("query")).alias("content"), F.lit(None).cast("double").alias("confidence"))
    f = a.fragments(spark, d).select("fragment_id", "content", "confidence", "status")
    return o.apply_edits(f, e, "fragment_id", ["content", "confidence"])


def edits(spark, d):
    return _edited(spark, d)[0].select("fragment_id", "content", R6("confidence"), "status")


def corrections(spark, d):
    return _edited(spark, d)[1]


EDITS = {
    "e": f"SELECT query_id AS edit_id, {_pick_sql(['update', 'delete', 'create'], 'query_id')} AS op, CASE WHEN query_id%6=5 THEN query_id+10000000 ELSE query_id*7%400 END AS fragment_id, CASE WHEN query_id%4>0 THEN query END AS c FROM questions",
    "l": "SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY fragment_id ORDER BY edit_id DESC)=1",
}
VALUE_TAGS = ["emotional_critical", "future_hook", "noise"]


def pipeline(spark, d):
    i = F.col("fragment_id")
    f = a.fragments(spark, d).select("status", F.array(_pick(VALUE_TAGS, i), _pick(VALUE_TAGS, i * 5 + 1)).alias("value_tags"))
    m = _model(spark, d).select("status", _pick(TYPES, F.col("entry_id")).alias("type"))
    runs = a.messages(spark, d).groupBy("chat_id").agg(F.max(F.unix_timestamp("ts")).alias("processed_until")).withColumn("status", F.when(F.col("chat_id") % 3 == 0, "done").otherwise("failed"))
    return st.pipeline_status(f, a.entities(spark, d), m, runs, VALUE_TAGS)


def baseline(spark, d):
    obs = a.observations(spark, d)
    out = st.baseline_status(emotion.baselines(emotion.with_slot(obs), decimals=False), obs, 3)
    slots = F.array_join(F.transform(F.map_entries("slots"), lambda x: F.concat_ws("=", x["key"], F.floor(x["value"] * 1000 + 0.5).cast("string"))), ",")
    return out.select("owner_id", "dim", s.half_up(F.col("baseline"), 3).alias("baseline"), "samples", slots.alias("slots"), F.round("state", 6).alias("state"), "learning")


KIN = ["爸爸的姐姐", "大學好友", "在小紅書上認識", "Dad", ""]


def kinds(spark, d):
    i = F.col("entity_id")
    e = a.entities(spark, d).select("entity_id", _pick(["person", "pet", "place", "person", "work"], i).alias("category"), _pick(["public_figure", "", "fictional_character", ""], i * 3).alias("entity_type"), _pick(KIN, i * 2).alias("relation"))
    return e.select("entity_id", st.subcategory(F.col("category"), F.col("entity_type"), F.col("relation")).alias("subcategory"), st.galaxy(F.col("category")).alias("galaxy"))


def ids(spark, d):
    """Lists of links as they may be stored: numbers, texts, objects, nulls, and what is no list at all."""
    i = F.col("fragment_id").cast("string")
    text = F.when(F.col("fragment_id") % 7 == 0, F.lit("not json")).when(F.col("fragment_id") % 7 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("["), i, F.lit(',"'), i, F.lit('7",{"id":'), (F.col("fragment_id") % 3).cast("string"), F.lit(',"name":"x"},null,-4,"x",2.5,'), i, F.lit("]"))
    )
    return a.fragments(spark, d).select("fragment_id", F.array_join(st.json_ids(text), ",").alias("ids"), F.size(st.json_list(text)).cast("long").alias("n"))


Q = {
    "t10_apply_evidence": evidence, "t11_upsert_states": states, "j40_contradiction_targets": targets, "t6_maintain_patterns": patterns, "t23_profile_integration": profile, "t31_seed_model": seeded, "t29_apply_edits": edits,
    "t29_corrections": corrections, "a2_pipeline_status": pipeline, "a26_baseline_status": baseline, "f30_subcategory": kinds, "f31_json_ids": ids,
}
S = {
    "t10_apply_evidence": "WITH RECURSIVE " + a.sql("observations", "SELECT entry_id, type, quality, round(confidence,6) AS confidence, evidence_count, needs_review, contradictions FROM fo QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY n DESC)=1", mm=MODEL, **EVIDENCE)[5:],
    "j40_contradiction_targets": a.sql("questions fragments", "SELECT verdict_id, entry_id, verdict_id AS fragment_id, string_agg(DISTINCT why, ',' ORDER BY why) AS why FROM (SELECT * FROM sh UNION ALL SELECT * FROM hi) GROUP BY 1,2", **TARGETS),
    "t6_maintain_patterns": a.sql("observations", """SELECT pattern_id, CASE last WHEN 'evidence' THEN 'active' WHEN 'drift' THEN 'superseded' ELSE status END AS status, cc+coalesce(no,0) AS contradiction_count, ec2 AS evidence_count,
        round(CASE WHEN has THEN least(0.9, 0.15+least(0.4, ec2*0.04)+least(0.25, greatest(1.0, (e-b))/365*0.25)) ELSE conf END,6) AS confidence, (CASE WHEN has THEN b ELSE fs END)::VARCHAR AS first_seen, greatest(ls,seen)::VARCHAR AS last_seen FROM r""", mm=MODEL, **PATTERNS),
    "t23_profile_integration": a.sql("observations", """SELECT entry_id, category, tier, CASE WHEN tier='locked' THEN 'rejected:locked' WHEN sd<CASE tier WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END THEN 'rejected:diversity' WHEN tier='high' THEN
        CASE WHEN EXISTS (FROM m WHERE m.status='active' AND m.owner_id=t.owner_id AND m.entry_id<>t.entry_id AND list_contains(m.tags, t.category)) THEN 'evidence' ELSE 'rejected:nothing_to_refine' END ELSE 'integrated' END AS decision FROM t""", mm=MODEL, **PROFILE),
    "t31_seed_model": a.sql("entities observations", "SELECT owner_id, type, content, round(confidence,6) AS confidence, quality, origin FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) WHERE length(content)>5 AND owner_id NOT IN (SELECT owner_id FROM mm WHERE owner_id%3=0)", mm=MODEL, **SEED),
    "t29_apply_edits": a.sql("questions fragments", "SELECT fragment_id, CASE WHEN op='update' THEN coalesce(c,content) ELSE content END AS content, round(confidence,6) AS confidence, CASE WHEN op='delete' THEN 'deleted' ELSE status END AS status FROM fragments LEFT JOIN l USING (fragment_id) UNION ALL SELECT fragment_id, c, NULL, 'active' FROM l WHERE op='create' AND fragment_id NOT IN (SELECT fragment_id FROM fragments)", **EDITS),
    "t29_corrections": a.sql("questions fragments", "SELECT fragment_id, content AS wrong, 'user_deleted' AS reason FROM fragments JOIN l USING (fragment_id) WHERE op='delete'", **EDITS),
    "a2_pipeline_status": a.sql("fragments entities observations messages", f"""SELECT * FROM (SELECT count(*) AS fragments, {', '.join(f"count(*) FILTER ({_pick_sql(VALUE_TAGS, 'fragment_id')}='{g}' OR {_pick_sql(VALUE_TAGS, '(fragment_id*5+1)')}='{g}') AS {g}" for g in VALUE_TAGS)} FROM fragments WHERE status='active'),
        (SELECT count(*) AS entities, count(*) FILTER (status='seed') AS seeds FROM entities WHERE status IN ('active','seed')), (SELECT count(*) AS model_rows, count(*) FILTER (ty='stable_trait') AS traits, count(*) FILTER (ty='current_state') AS states FROM (SELECT {_pick_sql(TYPES, 'entry_id')} AS ty FROM mm WHERE status='active')),
        (SELECT max(epoch(ts)::BIGINT) AS last_run FROM messages WHERE chat_id%3=0)""", mm=MODEL),
    "a26_baseline_status": a.sql("observations", "SELECT owner_id, dim, round(max(overall),3) AS baseline, sum(n)::BIGINT AS samples, string_agg(slot||'='||(floor((s+8*overall)/(n+8)*1000+0.5)::BIGINT), ',' ORDER BY slot) AS slots, any_value(state) AS state, sum(n)<3 AS learning FROM (SELECT *, (sum(s) OVER w+10*0.2)/(sum(n) OVER w+10) AS overall FROM x WINDOW w AS (PARTITION BY owner_id, dim)) JOIN y USING (owner_id, dim) GROUP BY 1,2",
        x=f"SELECT owner_id, dim, {SLOT} AS slot, count(*) AS n, sum(y) AS s FROM observations GROUP BY ALL", y="SELECT owner_id, dim, round(arg_max(y,t),6) AS state FROM observations GROUP BY 1,2"),
    "f30_subcategory": a.sql("entities", """SELECT entity_id, CASE c WHEN 'pet' THEN 'pet' WHEN 'person' THEN CASE t WHEN 'public_figure' THEN 'celebrity' WHEN 'fictional_character' THEN 'fictional' ELSE CASE r WHEN '爸爸的姐姐' THEN 'family' WHEN '大學好友' THEN 'friend' WHEN '在小紅書上認識' THEN 'online' END END END AS subcategory,
        CASE c WHEN 'person' THEN '社交' WHEN 'pet' THEN '社交' WHEN 'place' THEN '地點' ELSE '創作' END AS galaxy FROM x""",
        x=f"SELECT entity_id, {_pick_sql(['person', 'pet', 'place', 'person', 'work'], 'entity_id')} AS c, {_pick_sql(['public_figure', '', 'fictional_character', ''], '(entity_id*3)')} AS t, {_pick_sql(KIN, '(entity_id*2)')} AS r FROM entities"),
    "f31_json_ids": a.sql("fragments", "SELECT fragment_id, CASE WHEN fragment_id%7<2 THEN '' ELSE array_to_string(list_filter(list_value(CASE WHEN fragment_id>0 THEN fragment_id::VARCHAR END, fragment_id||'7', CASE WHEN fragment_id%3>0 AND fragment_id%3<>fragment_id THEN (fragment_id%3)::VARCHAR END), lambda x: x IS NOT NULL), ',') END AS ids, CASE WHEN fragment_id%7<2 THEN 0 ELSE 8 END::BIGINT AS n FROM fragments"),
}
