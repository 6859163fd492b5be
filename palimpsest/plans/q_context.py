"""Queries of what is put before a model, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import context as o
from ..operators import dates, model, recall, review
from ..operators.tables import settle
from ..sources import adapter as a
from .q_linking import MENTION, NORM, _terms
from .q_model import U
from .q_recall import BM25, HYBRID, INTENT, INTENTS, NAMED, SELF, TOKENS, _fts, _hybrid, _named, index, rank_sql
from .q_screening import _pick, _pick_sql
from .q_tables import DAYS

R4 = lambda c: F.round(c, 4).alias(c)


def _episodes(spark, d):
    """One for each chat: its first turn is the title, its last turn's role the tag."""
    m = a.messages(spark, d).groupBy("chat_id").agg(F.min_by("content", "msg_id").alias("title"), F.max_by("role", "msg_id").alias("tags"))
    i = F.col("chat_id")
    return m.select(i.alias("memory_id"), (i % 50).alias("owner_id"), "title", "tags", F.when(i % 6 == 5, "saga").otherwise("episode").alias("layer"), F.when(i % 4 == 3, "archived").otherwise("permanent").alias("status"))


def everywhere(spark, d):
    return o.search_all(a.questions(spark, d), index(spark, d), _episodes(spark, d), 10).select("query_id", "source", "id", R4("score"), "rank")


EPISODES = {
    "mlive": "SELECT chat_id AS memory_id, chat_id%50 AS owner_id, arg_min(content,msg_id)||' '||arg_max(role,msg_id) AS text FROM messages WHERE chat_id%6<>5 AND chat_id%4<>3 GROUP BY chat_id",
    "mtoks": f"SELECT owner_id, memory_id, {TOKENS.format('text')} AS ws FROM mlive",
    "mst": "SELECT owner_id, count(*) AS n, avg(len(ws)) AS avgdl FROM mtoks GROUP BY owner_id",
    "mtf": "SELECT owner_id, memory_id, token, dl, count(*) AS tf FROM (SELECT owner_id, memory_id, len(ws) AS dl, unnest(ws) AS token FROM mtoks) GROUP BY ALL",
    "midf": "SELECT owner_id, token, avgdl, ln(1+(n-count(*)+0.5)/(count(*)+0.5)) AS idf FROM mtf JOIN mst USING (owner_id) GROUP BY owner_id, token, n, avgdl",
    "mbm": "SELECT query_id, memory_id, round(sum(idf*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl))),6) AS score FROM q JOIN midf USING (owner_id, token) JOIN mtf USING (owner_id, token) GROUP BY ALL",
    "both_": "SELECT query_id, 'fragment' AS source, fragment_id AS id, score FROM (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fragment_id)<=10) UNION ALL SELECT query_id, 'memory', memory_id, score FROM (SELECT * FROM mbm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id)<=10)",
}
PHRASES = ["小明來了 ", "去動物園玩 ", "", "陳小明說 ", "小 明 "]
PEOPLE = [(-1, "陳小明"), (-2, "台北動物園"), (-3, "王大同")]


def classified(spark, d):
    """Names are two words of each question, and three in Chinese; a phrase chosen by the id stands before each text."""
    f = a.fragments(spark, d).select("fragment_id", F.concat(_pick(PHRASES, F.col("fragment_id")), F.col("content")).alias("content"))
    people = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("entity_id"), F.lit(n).alias("name")) for i, n in PEOPLE]))
    names = _terms(spark, d).withColumnRenamed("term", "name").unionByName(a.read(spark, d, "region").limit(1).select(people.alias("p")).select("p.*"))
    return o.classify_light(f, names, a.links(spark, d).filter("confidence < 0.45"))


PARTS = [(i, n[k : k + w]) for i, n in PEOPLE for w in (2, 3) if w == 2 or len(n) >= 5 for k in range(len(n) - w + 1)]
VALUES = lambda rows: ", ".join(f"({i}, '{n}')" for i, n in rows)
CLASSES = {
    **MENTION,
    "fr": f"SELECT fragment_id, {_pick_sql(PHRASES, 'fragment_id')}||content AS c FROM fragments WHERE fragment_id NOT IN (SELECT fragment_id FROM links WHERE confidence<0.45)",
    "hits": f"""SELECT fragment_id, entity_id, 0.55::DOUBLE AS cf FROM fr JOIN tm ON contains(lower(c), term)
        UNION ALL SELECT fragment_id, i, 0.55 FROM fr JOIN (VALUES {VALUES(PEOPLE)}) v(i, n) ON contains(c, n) UNION ALL SELECT fragment_id, i, 0.35 FROM fr JOIN (VALUES {VALUES(PARTS)}) v(i, n) ON contains(c, n)""",
}


def rematched(spark, d):
    """A place's vector is the one of its number; links are those of fragments divisible by forty."""
    v = a.vectors(spark, d)
    e = a.entities(spark, d).filter("category = 'place'").select("entity_id", (F.col("entity_id") - 100).alias("fragment_id")).join(v, "fragment_id").select("entity_id", "embedding")
    return o.semantic_rematch(e, v, a.links(spark, d).filter("fragment_id % 40 = 0")).select("entity_id", "fragment_id", R4("similarity"), "rank")


def lines(spark, d):
    """An owner's relationship line is its first dimension; its traits are its dimensions, of which that one is in the line already."""
    obs = a.observations(spark, d).groupBy("owner_id", "dim").agg(F.min("obs_id").alias("entry_id"), F.count(F.lit(1)).alias("evidence_count"), F.round(F.avg("y"), 7).alias("mean"))
    active = obs.groupBy("owner_id").agg(F.concat(F.min("dim"), F.lit("   often")).alias("line")).withColumn("place", F.lit(0))
    traits = obs.select("owner_id", "entry_id", F.col("dim").alias("content"), (F.col("mean") + 0.55).alias("confidence"), "evidence_count", F.lit("active").alias("status"))
    return o.relationship_lines(active, traits, lines=4, budget=13).select("owner_id", F.col("place").cast("long").alias("place"), "line")


LINES = {
    "ob": "SELECT owner_id, dim, min(obs_id) AS entry_id, count(*) AS ec, round(avg(y),7)+0.55 AS c FROM observations GROUP BY 1,2",
    "ac": "SELECT owner_id, min(dim) AS d FROM ob GROUP BY 1",
    "al": "SELECT owner_id, d||' often' AS line, 0 AS layer, 0 AS r FROM ac UNION ALL SELECT owner_id, dim, 1, row_number() OVER (PARTITION BY owner_id ORDER BY c DESC, ec DESC, entry_id) FROM ob JOIN ac USING (owner_id) WHERE c>=0.7 AND dim<>d",
    "nu": "SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY layer, r)-1 AS place FROM al",
    "bu": "SELECT *, sum(ceil((length(line)+2)/4)+1) OVER (PARTITION BY owner_id ORDER BY place) AS used FROM nu WHERE place<4",
}


def rendered(spark, d):
    """A question's hits; entities divisible by three are people."""
    e = a.entities(spark, d).withColumn("category", F.when(F.col("entity_id") % 3 == 0, "person").otherwise("place"))
    h = _fts(spark, d).select("query_id", F.col("rank").alias("position"), "fragment_id", F.concat(F.lit("#"), F.col("fragment_id").cast("string")).alias("line"))
    return o.render_groups(h, a.links(spark, d), e)


RENDER = {
    "nm": "SELECT fragment_id, string_agg(name, '、' ORDER BY entity_id) AS grp, count(*)=1 AND bool_and(entity_id%3=0) AS person FROM (SELECT DISTINCT fragment_id, entity_id, name FROM links JOIN entities USING (entity_id)) GROUP BY 1",
    "gr": "SELECT query_id, grp, min(rank) AS first, string_agg('#'||fragment_id, chr(10) ORDER BY rank) AS ls, coalesce(bool_or(person),FALSE) AS person FROM fts LEFT JOIN nm USING (fragment_id) GROUP BY 1,2",
    "qq": "SELECT query_id, count(*) AS n, count(grp) AS named FROM gr GROUP BY 1",
    "hd": f"SELECT query_id, (grp IS NULL) AS last, first, grp, person, CASE WHEN n=1 THEN '' WHEN grp IS NOT NULL THEN '【關於 '||grp||'】'||chr(10) WHEN named>0 THEN '{o.OTHERS}'||chr(10) ELSE '' END||ls AS tx FROM gr JOIN qq USING (query_id)",
    "wr": "SELECT query_id, string_agg(tx, chr(10) ORDER BY last, first, grp) AS body, count(*) FILTER (person) AS np, string_agg(grp, '、' ORDER BY last, first, grp) FILTER (person) AS people FROM hd GROUP BY 1",
}


def intuitions(spark, d):
    """User turns are an owner's states, first turns name its entities, others are its patterns."""
    m = a.messages(spark, d)
    w = F.array_join(F.slice(t.index_tokens(F.col("content")), 1, 2), " ")
    i = F.col("msg_id")
    states = m.filter("sender = 'user'").select("owner_id", i.alias("entry_id"), "content", F.col("ts").alias("last_evidence_at"), F.when(i % 3 > 0, F.timestamp_seconds(F.unix_timestamp("ts") + 25)).alias("expires_at"))
    names = m.filter("msg_id % 1000 < 3").select("owner_id", i.alias("entity_id"), w.alias("term")).filter("length(term) >= 2")
    facts = m.select(i.alias("entity_id"), F.concat(F.col("role"), F.lit(" says so")).alias("fact"))
    patterns = m.filter("sender = 'ai'").select("owner_id", i.alias("pattern_id"), "content")
    return o.intuition(m, states, names, facts, patterns, 900, minutes=0.4)


COST = "greatest(ceil(length(c)/4),1)"
INTUITION = {
    "ww": f"SELECT *, {TOKENS.format('content')} AS w FROM messages",
    "s1": "SELECT m.msg_id, 'state' AS kind, s.msg_id AS item_id, s.content AS c, row_number() OVER (PARTITION BY m.msg_id ORDER BY s.ts DESC, s.msg_id) AS rank FROM messages m JOIN messages s USING (owner_id) WHERE s.sender='user' AND (s.msg_id%3=0 OR s.ts+INTERVAL 25 SECOND>m.ts) QUALIFY rank<=8",
    "nn": "SELECT owner_id, msg_id AS entity_id, array_to_string(w[1:2],' ') AS term FROM ww WHERE msg_id%1000<3 AND length(array_to_string(w[1:2],' '))>=2",
    "hh": r"SELECT DISTINCT owner_id, entity_id, ts AS seen FROM ww JOIN nn USING (owner_id) WHERE contains(lower(content), term)",
    "e1": "SELECT msg_id, 'entity' AS kind, entity_id AS item_id, c, row_number() OVER (PARTITION BY msg_id ORDER BY seen DESC, entity_id) AS rank FROM (SELECT m.msg_id, h.entity_id, max(h.seen) AS seen FROM messages m JOIN hh h USING (owner_id) WHERE h.seen<=m.ts AND epoch(m.ts)-epoch(h.seen)<=24 GROUP BY 1,2) JOIN (SELECT msg_id AS entity_id, role||' says so' AS c FROM messages) USING (entity_id) QUALIFY rank<=3",
    "p1": "SELECT x.msg_id, 'pattern' AS kind, y.msg_id AS item_id, y.content AS c, row_number() OVER (PARTITION BY x.msg_id ORDER BY len(list_intersect(x.w, y.w)) DESC, y.msg_id) AS rank FROM ww x JOIN ww y USING (owner_id) WHERE y.sender='ai' AND len(list_intersect(x.w, y.w))>=3 QUALIFY rank<=3",
    "al": f"SELECT *, sum({COST}) OVER (PARTITION BY msg_id ORDER BY o, rank) AS used FROM (SELECT *, 1 AS o FROM s1 UNION ALL SELECT *, 2 FROM e1 UNION ALL SELECT *, 3 FROM p1)",
}


def block(spark, d):
    """Questions are their owners' messages: hard triggers, recall, the hits' entities, what surfaces and what is coming."""
    q, f, i = a.questions(spark, d), a.fragments(spark, d), F.col("fragment_id")
    m = q.select("owner_id", F.col("query_id").alias("msg_id"), F.col("query").alias("content"), a.now().alias("ts"))
    tag = F.array_join(F.slice(t.index_tokens(F.col("content")), 1, 1), " ")
    memories = f.select("owner_id", i.alias("memory_id"), F.array(tag).alias("tags"), F.when(i % 5 == 4, "archived").otherwise("permanent").alias("status"), F.to_date("created_at").alias("valid_from"))
    core = recall.hard_triggers(m, memories).select("msg_id", F.col("memory_id").alias("item_id"), F.col("rank").alias("place"), F.lit(20).alias("cost"))
    boosted = recall.entity_boost(_hybrid(spark, d), _named(spark, d), a.links(spark, d), never=SELF)
    hits = settle(recall.dynamic_k(recall.rank(boosted, f, a.now())))
    found = hits.select(F.col("query_id").alias("msg_id"), F.col("fragment_id").alias("item_id"), F.col("position").alias("place"), F.ceil(F.col("chars") / 4).alias("cost"))
    about = review.entity_context(hits, a.links(spark, d), a.entities(spark, d)).select(F.col("query_id").alias("msg_id"), F.col("entity_id").alias("item_id"), F.col("rank").alias("place"), F.lit(15).alias("cost"))
    out = lambda df, cost: m.select("msg_id", "owner_id").join(df, "owner_id").select("msg_id", F.col("fragment_id").alias("item_id"), F.col("rank").alias("place"), F.lit(cost).alias("cost"))
    surfaced = model.surfacing(f, f.limit(0).select("fragment_id", F.col("created_at").alias("at")), a.now())
    dated = f.withColumns({"content": F.lit(""), "event_at": F.date_format(F.date_add(F.lit("2024-01-20").cast("date"), (i % 60).cast("int")), "yyyy-MM-dd"), "ref": F.lit("2024-02-01").cast("date")})
    coming = dates.upcoming(dated, a.now())
    gates = q.select(F.col("query_id").alias("msg_id"), o.looks_up(t.gate(F.col("query"), F.lit(False), F.lit(False))).alias("look_up"))
    sections = {"core": ("core", core), "recall": ("recall", found), "entities": ("recall", about), "surfacing": ("float", out(surfaced, 30)), "upcoming": ("float", out(coming, 25))}
    return o.memory_block(sections, gates, 600)


GATE = rf"""SELECT query_id AS msg_id FROM (SELECT query_id, query, {INTENT} AS intent, lower(coalesce(query,'')) AS folded, {NORM.format('query')} AS bare, regexp_matches(lower(coalesce(query,'')), '{t._any(t.QUESTIONS)}') AS q FROM questions)
    WHERE regexp_matches(folded, '{t._any(t.CUES)}') OR intent<>'semantic' OR q OR NOT ((NOT regexp_matches(folded, '[?？]') AND (bare='' OR regexp_full_match(bare, '(?:{t._any(sorted(t.SMALLTALK, key=len, reverse=True))})+')))
    OR (length(bare)<=14 AND regexp_matches(regexp_replace(folded, '^[\s\p{{P}}]+', ''), '^(?:{t._any(t.COMMANDS)})')) OR length(bare)<4)"""
BLOCK = {
    **BM25, **INTENTS, **HYBRID, "named": NAMED,
    "boosted": f"SELECT f.query_id, f.fragment_id, intent, by_fts, by_vec, n.fragment_id IS NOT NULL AS by_entity, rrf*CASE WHEN n.fragment_id IS NOT NULL THEN 1.1 ELSE 1.0 END::DOUBLE AS rrf FROM fused f LEFT JOIN (SELECT DISTINCT query_id, fragment_id FROM named JOIN links USING (entity_id) WHERE entity_id NOT IN ({SELF[0]},{SELF[1]})) n ON n.query_id=f.query_id AND n.fragment_id=f.fragment_id",
    **rank_sql("boosted"),
    "co": f"SELECT query_id AS msg_id, fragment_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY length(tag) DESC, created_at::DATE DESC, fragment_id) AS place, 20 AS cost, 0 AS s, 'core' AS part FROM (SELECT query_id, fragment_id, f.created_at, ({TOKENS.format('content')})[1] AS tag, {TOKENS.format('query')} AS qw FROM questions q JOIN fragments f USING (owner_id) WHERE fragment_id%5<>4) WHERE list_contains(qw, tag) QUALIFY place<=3",
    "gt": GATE,
    "re": "SELECT query_id AS msg_id, fragment_id AS item_id, position AS place, ceil(chars/4) AS cost, 1 AS s, 'recall' AS part FROM cut WHERE query_id IN (SELECT msg_id FROM gt)",
    "en": "SELECT query_id AS msg_id, entity_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, entity_id) AS place, 15 AS cost, 2 AS s, 'recall' AS part FROM (SELECT query_id, entity_id, count(*) AS n FROM cut JOIN (SELECT DISTINCT fragment_id, entity_id FROM links) USING (fragment_id) JOIN entities e USING (entity_id) WHERE e.status='active' AND query_id IN (SELECT msg_id FROM gt) GROUP BY ALL) QUALIFY place<=5",
    "dr": f"SELECT owner_id, fragment_id, round(CASE WHEN emotional_weight=0 THEN 0.5 ELSE emotional_weight END+0.15*sqrt(-2*ln({U('a')}))*cos(2*3.141592653589793*{U('b')}),6) AS draw FROM fragments WHERE injected_count=0 AND created_at<{DAYS(3)}",
    "su": "SELECT query_id AS msg_id, fragment_id AS item_id, rank AS place, 30 AS cost, 3 AS s, 'float' AS part FROM questions JOIN (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY draw DESC, fragment_id) AS rank FROM dr QUALIFY rank<=2) USING (owner_id)",
    "up": "SELECT query_id AS msg_id, fragment_id AS item_id, rank AS place, 25 AS cost, 4 AS s, 'float' AS part FROM questions JOIN (SELECT owner_id, fragment_id, row_number() OVER (PARTITION BY owner_id ORDER BY fragment_id%60, fragment_id) AS rank FROM fragments WHERE status='active' AND fragment_id%60 BETWEEN 12 AND 19 QUALIFY rank<=3) USING (owner_id)",
    "un": "SELECT *, sum(cost) OVER (PARTITION BY msg_id, part ORDER BY s, place, item_id) AS used FROM (SELECT * FROM co UNION ALL SELECT * FROM re UNION ALL SELECT * FROM en UNION ALL SELECT * FROM su UNION ALL SELECT * FROM up)",
}
Q = {"j2_search_all": everywhere, "j8_classify_light": classified, "j29_semantic_rematch": rematched, "t18_relationship_lines": lines, "t26_render_groups": rendered, "t28_intuition": intuitions, "t25_memory_block": block}
S = {
    "j2_search_all": a.sql("fragments questions messages", "SELECT query_id, source, id, round(score,4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, id) AS rank FROM both_ QUALIFY rank<=10", **BM25, **EPISODES),
    "j8_classify_light": a.sql("fragments links questions", "SELECT fragment_id, entity_id, max(cf) AS confidence FROM hits GROUP BY 1,2", **CLASSES),
    "j29_semantic_rematch": a.sql("vectors links", "SELECT entity_id, fragment_id, round(sim,4) AS similarity, row_number() OVER (PARTITION BY entity_id ORDER BY sim DESC, fragment_id) AS rank FROM (SELECT p.fragment_id+100 AS entity_id, v.fragment_id, round(list_cosine_similarity(p.embedding::DOUBLE[], v.embedding::DOUBLE[]),6) AS sim FROM vectors p, vectors v WHERE p.fragment_id<25) x WHERE sim>=0.4 AND entity_id NOT IN (SELECT entity_id FROM l GROUP BY 1 HAVING count(*)>=5) AND NOT EXISTS (FROM l WHERE l.entity_id=x.entity_id AND l.fragment_id=x.fragment_id) QUALIFY rank<=8", l="SELECT * FROM links WHERE fragment_id%40=0"),
    "t18_relationship_lines": a.sql("observations", "SELECT owner_id, place, line FROM bu WHERE used<=13", **LINES),
    "t26_render_groups": a.sql("fragments questions links entities", "SELECT query_id, body||CASE WHEN np>=2 THEN chr(10)||chr(10)||'⚠️ 以上記憶涉及不同的人（'||people||'），不要混為一談。' ELSE '' END AS text FROM wr", **BM25, **RENDER),
    "t28_intuition": a.sql("messages", "SELECT msg_id, kind, item_id, rank FROM al WHERE used<=900", **INTUITION),
    "t25_memory_block": a.sql("fragments questions vectors links entities", "SELECT msg_id, ['core','recall','entities','surfacing','upcoming'][s+1] AS section, item_id, row_number() OVER (PARTITION BY msg_id ORDER BY s, place, item_id) AS position, used::BIGINT AS used FROM un WHERE used<=CASE part WHEN 'core' THEN 180 WHEN 'recall' THEN 300 ELSE 120 END", **BLOCK),
}
