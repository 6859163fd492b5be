"""Entity and evidence queries over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import linking as o
from ..sources import adapter as a
from .q_recall import INTENT, TOKENS

NORM = r"regexp_replace(lower(coalesce({0},'')), '[\s\p{{P}}\p{{S}}]+', '', 'g')"


def _entries(spark, d):
    """An entry for each turn: its quote is a piece of that turn, of the one before, or of none."""
    m = a.messages(spark, d)
    piece = F.substring("content", 5, 40)
    quote = F.when(F.col("msg_id") % 5 == 0, F.concat(piece, F.lit("zq"))).when(F.col("msg_id") % 5 == 1, F.lit(None)).when(F.col("msg_id") % 5 == 2, F.substring("content", 1, 200)).otherwise(piece)
    return m.select(F.col("msg_id").alias("entry_id"), F.col("chat_id").alias("batch_id"), F.when(F.col("msg_id") % 2 == 0, "fact").otherwise("state").alias("type"), quote.alias("quote"))


def _verified(spark, d):
    return o.verify_quotes(_entries(spark, d), a.messages(spark, d).withColumnRenamed("chat_id", "batch_id"))


def verify(spark, d):
    return _verified(spark, d).select("entry_id", "type", "source", "reason", F.unix_timestamp("first_at").alias("raised_at"))


VERIFY = {
    "en": f"""SELECT *, {NORM.format('quote')} AS q FROM (SELECT msg_id AS entry_id, chat_id AS batch_id, CASE WHEN msg_id%2=0 THEN 'fact' ELSE 'state' END AS type,
        CASE msg_id%5 WHEN 0 THEN substr(content,5,40)||'zq' WHEN 1 THEN NULL WHEN 2 THEN substr(content,1,200) ELSE substr(content,5,40) END AS quote FROM messages)""",
    "sh": "SELECT *, CASE WHEN quote IS NULL OR length(q)=0 THEN 'missing' WHEN length(q)>60 THEN 'too_long' WHEN length(q)<2 THEN 'too_short' END AS shape FROM en",
    "fd": f"SELECT entry_id, bool_or(sender='user') AS u, min(ts) AS first_at FROM sh JOIN (SELECT chat_id AS batch_id, sender, ts, {NORM.format('content')} AS m FROM messages) USING (batch_id) WHERE shape IS NULL AND contains(m,q) GROUP BY 1",
    "ve": "SELECT entry_id, type, CASE WHEN u THEN 'user' WHEN NOT u THEN 'ai' END AS source, coalesce(shape, CASE WHEN u IS NULL THEN 'not_found' END) AS reason, epoch(first_at)::BIGINT AS raised_at FROM sh LEFT JOIN fd USING (entry_id)",
}


def drops(spark, d):
    return o.drop_counts(_verified(spark, d))


def exact(spark, d):
    return o.exact_duplicates(a.fragments(spark, d))


HASH = {"h": f"SELECT fragment_id, sha256({NORM.format('entity')}||chr(0)||{NORM.format('content')}) AS hash FROM fragments"}


def audit(spark, d):
    """Groups of the same content hash created on the same day."""
    f = a.fragments(spark, d).select(t.content_hash(F.lit(""), F.col("content")).alias("hash"), F.to_date("created_at").cast("string").alias("day"))
    return f.groupBy("hash", "day").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def near(spark, d):
    """Whole documents, with an entity of their language."""
    return o.near_duplicates(a.fragments(spark, d).select("fragment_id", F.col("type").alias("entity"), "content"))


NEAR = {
    "f": f"SELECT fragment_id, type AS entity, {NORM.format('content')} AS n FROM fragments",
    "g": rf"SELECT *, array_to_string(list_sort(regexp_extract_all(n, '{t.KEY}')),'|') AS k, CASE WHEN length(n)>=2 THEN list_distinct(list_transform(range(1, length(n)), lambda i: substr(n, i::BIGINT, 2))) ELSE [] END AS b FROM f WHERE n<>''",
    "p": "SELECT x.fragment_id, y.fragment_id AS other, x.n=y.n AS same, len(x.b) AS na, len(y.b) AS nb, CASE WHEN x.n=y.n THEN len(x.b) ELSE len(list_intersect(x.b, y.b)) END AS i FROM g x JOIN g y ON x.entity=y.entity AND x.k=y.k AND abs(len(x.b)-len(y.b))<=1 AND x.fragment_id<>y.fragment_id",
}


def evidence(spark, d):
    dup = o.exact_duplicates(a.fragments(spark, d)).filter("fragment_id <> first_id").select(F.col("first_id").alias("fragment_id"), (F.col("fragment_id") % 5).alias("source_key"))
    return o.accumulate_evidence(a.fragments(spark, d), dup).select("fragment_id", F.round("confidence", 6).alias("confidence"), "evidence_count")


def _terms(spark, d):
    """Two neighbouring words of each question."""
    q = a.questions(spark, d).select(F.col("query_id").alias("entity_id"), F.regexp_extract("query", r"^\S+ (\S+ \S+)", 1).alias("term"))
    return q.filter("length(term) >= 2")


def mentions(spark, d):
    texts = a.fragments(spark, d).select(F.col("fragment_id").alias("text_id"), "content")
    return o.mention_join(texts, _terms(spark, d))


MENTION = {"tm": r"SELECT query_id AS entity_id, lower(regexp_extract(query, '^\S+ (\S+ \S+)', 1)) AS term FROM questions WHERE length(regexp_extract(query, '^\S+ (\S+ \S+)', 1))>=2"}


def cooccur(spark, d):
    return o.cooccurring(a.links(spark, d), a.entities(spark, d))


def coactive(spark, d):
    return o.coactive(a.links(spark, d), a.entities(spark, d), a.fragments(spark, d), ["place"])


def merges(spark, d):
    return o.merge_candidates(a.entities(spark, d), a.links(spark, d))


def unlinked(spark, d):
    return o.unlinked(a.fragments(spark, d), a.links(spark, d).filter("confidence < 0.7")).select("fragment_id", "entity")


def orphans(spark, d):
    return o.orphans(a.links(spark, d), a.entities(spark, d), ["source"], ["place"])


def _relations(spark, d):
    e = a.entities(spark, d).filter("category = 'source'")
    return e.select("entity_id", (F.lit(100) + F.col("entity_id") % 25).alias("related_id"))


def derived(spark, d):
    return o.derive_links(a.links(spark, d), _relations(spark, d)).select("fragment_id", "entity_id", "via", "confidence")


def lifecycle(spark, d):
    return o.entity_lifecycle(a.entities(spark, d), a.links(spark, d), a.now(), 2, 14).select("entity_id", "status", "new_status", "n")


def merged(spark, d):
    into = a.entities(spark, d).filter("category = 'place' and entity_id % 5 <> 0").select("entity_id", (F.col("entity_id") - F.col("entity_id") % 5).alias("into"))
    return o.apply_merges(a.links(spark, d), into).select("fragment_id", "entity_id", F.round("confidence", 6).alias("confidence"))


def trace(spark, d):
    m = a.messages(spark, d)
    src = m.select((F.col("msg_id") % 97).alias("fragment_id"), "msg_id")
    return o.trace(src, m)


def terms(spark, d):
    return o.mine_terms(a.fragments(spark, d), a.entities(spark, d), r"\p{Lu}\p{Ll}{2,}", 5, 15)


def stop(spark, d):
    return o.stopwords(a.messages(spark, d))


def consolidation(spark, d):
    return o.consolidation_candidates(a.links(spark, d), a.entities(spark, d), a.fragments(spark, d))


def counts(spark, d):
    return a.links(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("fragment_count"))


def intents(spark, d):
    """Gate reason and intent of every user message; a message continues when it shares tokens with the one before."""
    m = a.messages(spark, d).filter("sender = 'user'")
    return m.select("msg_id", t.intent(F.col("content")).alias("intent"), t.gate(F.col("content"), F.lit(False), F.lit(False)).alias("reason"))


Q = {
    "p1_verify_quotes": verify, "p1_drop_counts": drops, "f7_exact_duplicates": exact, "a28_hash_audit": audit, "j15_near_duplicates": near, "a1_accumulate_evidence": evidence, "j7_mention_join": mentions,
    "j23_cooccurring": cooccur, "j24_coactive": coactive, "j27_merge_candidates": merges, "j31_unlinked": unlinked, "j30_orphans": orphans, "j13_derive_links": derived, "t7_entity_lifecycle": lifecycle,
    "t8_apply_merges": merged, "j32_trace": trace, "a15_mine_terms": terms, "a16_stopwords": stop, "a18_consolidation_candidates": consolidation, "a6_refresh_counts": counts, "p4_gate": intents,
}
S = {
    "p1_verify_quotes": a.sql("messages", "SELECT entry_id, type, source, reason, raised_at FROM ve", **VERIFY),
    "p1_drop_counts": a.sql("messages", "SELECT type, reason, count(*) AS n FROM ve WHERE reason IS NOT NULL GROUP BY ALL", **VERIFY),
    "f7_exact_duplicates": a.sql("fragments", "SELECT fragment_id, min(fragment_id) OVER (PARTITION BY hash) AS first_id, count(*) OVER (PARTITION BY hash) AS group_size FROM h QUALIFY group_size>1", **HASH),
    "a28_hash_audit": a.sql("fragments", f"SELECT sha256(chr(0)||{NORM.format('content')}) AS hash, strftime(created_at,'%Y-%m-%d') AS day, count(*) AS n FROM fragments GROUP BY ALL HAVING count(*)>1"),
    "j15_near_duplicates": a.sql("fragments", "SELECT fragment_id, min(other) AS duplicate_of FROM p WHERE same OR (na>0 AND nb>0 AND i>=0.8*(na+nb-i) AND na+nb-2*i<=1) GROUP BY 1", **NEAR),
    "a1_accumulate_evidence": a.sql("fragments", "SELECT fragment_id, round(least(1.0::DOUBLE, confidence+0.05*coalesce(n,0)),6) AS confidence, evidence_count+coalesce(n,0) AS evidence_count FROM fragments LEFT JOIN (SELECT fi AS fragment_id, count(DISTINCT fragment_id%5) AS n FROM (SELECT fragment_id, min(fragment_id) OVER (PARTITION BY hash) AS fi FROM h) WHERE fi<>fragment_id GROUP BY 1) USING (fragment_id)", **HASH),
    "j7_mention_join": a.sql("fragments questions", rf"SELECT DISTINCT fragment_id AS text_id, entity_id, term FROM fragments JOIN tm ON contains(lower(content), term)", **MENTION),
    "j23_cooccurring": a.sql("links entities", "SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS shared FROM lv x JOIN lv y USING (fragment_id) WHERE x.entity_id<y.entity_id GROUP BY ALL HAVING count(*)>=2 ORDER BY shared DESC, a, b LIMIT 30", lv="SELECT DISTINCT fragment_id, entity_id FROM links JOIN entities e USING (entity_id) WHERE e.status='active'"),
    "j24_coactive": a.sql("links entities fragments", "SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS days FROM dy x JOIN dy y USING (day) WHERE x.entity_id<y.entity_id AND NOT EXISTS (SELECT 1 FROM ow p JOIN ow q USING (fragment_id) WHERE p.entity_id=x.entity_id AND q.entity_id=y.entity_id) GROUP BY ALL",
                          ow="SELECT entity_id, fragment_id FROM links JOIN entities e USING (entity_id) WHERE e.category='place'", dy="SELECT DISTINCT entity_id, created_at::DATE AS day FROM ow JOIN fragments USING (fragment_id)"),
    "j27_merge_candidates": a.sql("links entities", "SELECT a, b, string_agg(DISTINCT why, ',' ORDER BY why) AS why FROM c GROUP BY ALL",
                                  g=f"SELECT entity_id, category, len(b) AS n, unnest(b) AS g FROM (SELECT entity_id, category, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i::BIGINT, 2))) AS b FROM (SELECT *, {NORM.format('name')} AS x FROM entities) WHERE length(x)>=2)",
                                  o="SELECT DISTINCT entity_id, fragment_id, e.category FROM links JOIN entities e USING (entity_id)", z="SELECT entity_id, count(*) AS n FROM o GROUP BY 1",
                                  c="""SELECT x.entity_id AS a, y.entity_id AS b, 'name' AS why FROM g x JOIN g y USING (category, g) WHERE x.entity_id<y.entity_id GROUP BY x.entity_id, y.entity_id, x.n, y.n HAVING count(*)>=0.5*least(x.n,y.n)
                                  UNION ALL SELECT p.a, p.b, 'fragments' FROM (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS k FROM o x JOIN o y USING (category, fragment_id) WHERE x.entity_id<y.entity_id GROUP BY ALL) p JOIN z u ON u.entity_id=a JOIN z v ON v.entity_id=b WHERE k>=0.5*least(u.n,v.n)"""),
    "j31_unlinked": a.sql("links fragments", "SELECT fragment_id, entity FROM fragments WHERE fragment_id NOT IN (SELECT fragment_id FROM links WHERE confidence<0.7)"),
    "j30_orphans": a.sql("links entities", "SELECT DISTINCT fragment_id FROM k WHERE category='source' AND fragment_id NOT IN (SELECT fragment_id FROM k WHERE category='place')", k="SELECT fragment_id, e.category FROM links JOIN entities e USING (entity_id)"),
    "j13_derive_links": a.sql("links entities", "SELECT l.fragment_id, r.related_id AS entity_id, min(l.entity_id) AS via, 0.45::DOUBLE AS confidence FROM links l JOIN r USING (entity_id) WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.fragment_id=l.fragment_id AND k.entity_id=r.related_id) GROUP BY 1,2", r="SELECT entity_id, 100+entity_id%25 AS related_id FROM entities WHERE category='source'"),
    "t7_entity_lifecycle": a.sql("links entities", f"SELECT entity_id, status, CASE WHEN status='seed' AND n>=3 THEN 'graduate' WHEN status='seed' AND age>14 THEN 'pruned' WHEN status='active' AND idle>2 THEN 'dormant' WHEN status='dormant' AND idle<=2 THEN 'active' ELSE status END AS new_status, n FROM x",
                                 x=f"SELECT entity_id, status, coalesce(n,0) AS n, ({a.NOW}-epoch(coalesce(last, e.created_at)))/86400 AS idle, ({a.NOW}-epoch(e.created_at))/86400 AS age FROM entities e LEFT JOIN (SELECT entity_id, count(*) AS n, max(created_at) AS last FROM links GROUP BY 1) USING (entity_id)"),
    "t8_apply_merges": a.sql("links", "SELECT fragment_id, CASE WHEN entity_id BETWEEN 100 AND 124 THEN entity_id-entity_id%5 ELSE entity_id END AS entity_id, round(max(confidence),6) AS confidence FROM links GROUP BY 1,2"),
    "j32_trace": a.sql("messages", "SELECT p.msg_id%97 AS fragment_id, q.msg_id, min(abs(q.n-p.n)) AS distance FROM pl p JOIN pl q ON p.chat_id=q.chat_id AND abs(q.n-p.n)<=2 GROUP BY 1,2", pl="SELECT chat_id, msg_id, row_number() OVER (PARTITION BY chat_id ORDER BY ts, msg_id)::INT AS n FROM messages"),
    "a15_mine_terms": a.sql("fragments entities", r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '\p{Lu}\p{Ll}{2,}')) AS term FROM fragments) WHERE term NOT IN (SELECT name FROM entities) GROUP BY 1 HAVING count(*)>=5 ORDER BY n DESC, term LIMIT 15"),
    "a16_stopwords": a.sql("messages", f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({TOKENS.format('content')})) AS token FROM messages) GROUP BY 1 HAVING count(*)>=greatest(10, (SELECT count(*) FROM messages)*0.03) ORDER BY n DESC, token LIMIT 120"),
    "a18_consolidation_candidates": a.sql("links entities fragments", "SELECT entity_id, n_links, fragment_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, fragment_id) AS rank FROM (SELECT DISTINCT entity_id, n_links, fragment_id, f.created_at FROM links JOIN ch USING (entity_id) JOIN fragments f USING (fragment_id) WHERE f.status='active')) WHERE rank<=30",
                                          ch="SELECT entity_id, count(*) AS n_links FROM links JOIN entities e USING (entity_id) WHERE e.status='active' GROUP BY 1 HAVING count(*)>=15 ORDER BY n_links DESC, entity_id LIMIT 5"),
    "p4_gate": a.sql("messages", rf"""SELECT msg_id, intent, CASE WHEN regexp_matches(folded, '{t._any(t.CUES)}') THEN 'cue' WHEN intent<>'semantic' THEN 'intent:'||intent
        WHEN NOT regexp_matches(folded, '[?？]') AND (bare='' OR regexp_full_match(bare, '(?:{t._any(sorted(t.SMALLTALK, key=len, reverse=True))})+')) THEN 'smalltalk'
        WHEN NOT q AND length(bare)<=14 AND regexp_matches(regexp_replace(folded, '^[\s\p{{P}}]+', ''), '^(?:{t._any(t.COMMANDS)})') THEN 'command' WHEN NOT q AND length(bare)<4 THEN 'too_short' WHEN q THEN 'question' ELSE 'default' END AS reason
        FROM (SELECT msg_id, {INTENT} AS intent, lower(coalesce(query,'')) AS folded, {NORM.format('query')} AS bare, regexp_matches(lower(coalesce(query,'')), '{t._any(t.QUESTIONS)}') AS q FROM (SELECT msg_id, content AS query FROM messages WHERE sender='user'))"""),
    "a6_refresh_counts": a.sql("links", "SELECT entity_id, count(*) AS fragment_count FROM links GROUP BY 1"),
}
