"""Retrieval queries over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..operators import recall as r
from ..operators.postings import Postings, fingerprint
from ..operators.tables import scratch, settle
from ..sources import adapter as a

TOKENS = r"regexp_extract_all(lower(coalesce({0},'')), '[\p{{L}}\p{{N}}]+')"
_NUMBER = rf"\d+\s*(?:{t._any(t.UNITS)})"
INTENT = rf"CASE WHEN regexp_matches(coalesce(query,''), '{t._any(t.LONG_TERM)}') THEN 'long_term' WHEN regexp_matches(coalesce(query,''), '{t._any(t.SUMMARY)}') THEN 'summary' WHEN regexp_matches(coalesce(query,''), '{t._any(t.FACT)}|{_NUMBER}') THEN 'fact' ELSE 'semantic' END"

BM25 = {
    "live": "SELECT * FROM fragments WHERE status='active'",
    "q": f"SELECT query_id, owner_id, unnest(list_distinct(list_filter({TOKENS.format('query')}, lambda x: length(x)>=2))) AS token FROM questions",
    "toks": f"SELECT owner_id, fragment_id, {TOKENS.format('content')} AS ws FROM live",
    "st": "SELECT owner_id, count(*) AS n, avg(len(ws)) AS avgdl FROM toks GROUP BY owner_id",
    "tf": "SELECT owner_id, fragment_id, token, dl, count(*) AS tf FROM (SELECT owner_id, fragment_id, len(ws) AS dl, unnest(ws) AS token FROM toks) WHERE (owner_id, token) IN (SELECT (owner_id, token) FROM q) GROUP BY ALL",
    "idf": "SELECT owner_id, token, avgdl, ln(1+(n-count(*)+0.5)/(count(*)+0.5)) AS idf FROM tf JOIN st USING (owner_id) GROUP BY owner_id, token, n, avgdl",
    "bm": "SELECT query_id, fragment_id, round(sum(idf*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl))),6) AS score FROM q JOIN idf USING (owner_id, token) JOIN tf USING (owner_id, token) GROUP BY ALL",
    "fts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fragment_id) AS rank FROM bm) WHERE rank<=16",
}
INTENTS = {"intents": f"SELECT query_id, {INTENT} AS intent FROM questions"}
AGE = f"CASE WHEN {{0}} IS NULL THEN 365.0 ELSE greatest(0.0::DOUBLE, ({a.NOW}-epoch({{0}}))/86400.0::DOUBLE) END"
EW = "CASE WHEN emotional_weight IS NULL OR emotional_weight=0 THEN 0.5 ELSE emotional_weight END"


def rank_sql(source: str) -> dict[str, str]:
    return {
        "c1": f"SELECT c.*, {AGE.format('created_at')} AS days, {EW} AS ew, injected_count, length(content) AS chars FROM {source} c JOIN fragments USING (fragment_id) WHERE rrf>=0.005",
        "c2": "SELECT *, CASE WHEN intent='long_term' THEN days*0.4 ELSE days END AS seen, CASE WHEN ew>=0.8 THEN 0.005 WHEN ew>=0.6 THEN 0.01 WHEN ew>=0.4 THEN 0.02 ELSE 0.04 END AS lam FROM c1",
        "c3": """SELECT *, CASE WHEN seen<=3 THEN 0.7*exp(-lam*seen)+0.3*(0.3+ew*0.7) ELSE 0.3*exp(-lam*seen)+0.7*(0.3+ew*0.7) END
            * CASE WHEN days<=1 THEN 1.3 WHEN days<=3 THEN 1.15 WHEN days<=7 THEN 1.05 ELSE 1.0 END AS tfac FROM c2""",
        "c4": """SELECT *, round(rrf*pow(tfac,0.05)*(0.4+ew*0.6)*CASE WHEN injected_count<=1 THEN 1.0 ELSE 1/(1+log10(injected_count+1)) END,9) AS score,
            CASE WHEN by_fts AND by_vec THEN 'high' WHEN rrf>0.015 OR by_entity THEN 'medium' ELSE 'low' END AS tier,
            CASE WHEN by_fts AND by_vec THEN 'BOTH' WHEN by_entity AND by_fts THEN 'ENTITY+FTS' WHEN by_entity AND by_vec THEN 'ENTITY+VEC' WHEN by_entity THEN 'ENTITY' WHEN by_fts THEN 'FTS' ELSE 'VEC' END AS source FROM c3""",
        "ranked": "SELECT *, CASE WHEN days>=90 OR tier='low' THEN 'associate' WHEN tier='high' AND days<30 AND source='BOTH' THEN 'cite' ELSE 'cautious' END AS permission FROM c4",
        "cut": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fragment_id) AS position FROM (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS best FROM ranked) WHERE rrf>=best*0.5) WHERE position<=8",
        "fit": "SELECT * FROM (SELECT *, sum(ceil(chars/4)) OVER (PARTITION BY query_id ORDER BY position) AS used FROM cut) WHERE used<=4000",
    }


def index(spark: SparkSession, d: str, every: bool = False) -> Postings:
    """The standing index of a folder's active fragments, or of all of them as one owner's; it is made where the shared folder has none of the
    files as they are now."""
    made = Postings(spark, f"{scratch(spark)}/cells-{fingerprint(spark, f'{d}/documents.parquet')}{'-all' if every else ''}")
    if not made.batches():
        f = a.fragments(spark, d)
        made.append(f.withColumn("owner_id", F.lit(0)) if every else f.filter("status = 'active'"), 1)
    return made


def _fts(spark: SparkSession, d: str, k: int = 16) -> DataFrame:
    return index(spark, d).search(a.questions(spark, d), k)


def _intents(spark: SparkSession, d: str) -> DataFrame:
    return a.questions(spark, d).select("query_id", t.intent(F.col("query")).alias("intent"))


def recall(spark: SparkSession, d: str) -> DataFrame:
    """Text-only recall from end to end: tokens, BM25, ranking, permission, dynamic k and budget."""
    fused = r.rrf_fuse({"fts": _fts(spark, d)}, _intents(spark, d))
    ranked = r.rank(fused, a.fragments(spark, d), a.now())
    kept = r.take_within_budget(r.dynamic_k(ranked), ["query_id"], [F.col("position")], F.ceil(F.col("chars") / 4), 4000)
    return kept.select("query_id", "fragment_id", "position", F.round("score", 6).alias("score"), F.round("rrf", 6).alias("relevance"), "tier", "source", "permission")


def bm25(spark, d):
    return _fts(spark, d, 20).select("query_id", "fragment_id", F.round("score", 4).alias("score"), "rank")


def _vector_queries(spark, d):
    return a.vectors(spark, d).filter("fragment_id % 100 = 0").select(F.col("fragment_id").alias("query_id"), "embedding")


def vector_topk(spark, d):
    """Vectors' labels are their tags; vectors with an id divisible by seven are no longer live."""
    v = a.vectors(spark, d)
    tags = v.select("fragment_id", F.col("label").cast("string").alias("tag"))
    own = _vector_queries(spark, d).join(tags, F.col("query_id") == F.col("fragment_id")).select("query_id", "tag")
    return r.vector_search(_vector_queries(spark, d), v, 10, tags, own, v.filter("fragment_id % 7 > 0")).select("query_id", "fragment_id", F.round("similarity", 4).alias("similarity"))


VECTOR = {
    "vq": "SELECT fragment_id AS query_id, embedding::DOUBLE[] AS e, label AS own FROM vectors WHERE fragment_id%100=0",
    "sims": "SELECT query_id, fragment_id, own=label AS tagged, round(list_cosine_similarity(e, embedding::DOUBLE[]),6) AS similarity FROM vq, vectors",
    "near": "SELECT query_id, fragment_id, CASE WHEN tagged THEN least(1.0::DOUBLE, 2*similarity) ELSE similarity END AS similarity FROM (SELECT * FROM sims WHERE similarity>=-1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fragment_id)<=30)",
    "vec": "SELECT * FROM near WHERE similarity>=0.2 AND fragment_id%7>0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fragment_id)<=10",
}


#: The nearest ten without tags.
PLAIN = {**{k: VECTOR[k] for k in ("vq", "sims")}, "vec": "SELECT * FROM sims WHERE similarity>=0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fragment_id)<=10"}


def vector_duplicates(spark, d):
    """The nearest other vector of each query vector, where it is a duplicate (0.82)."""
    near = r.vector_topk(_vector_queries(spark, d), a.vectors(spark, d), 3, 0.0, skip_self=True)
    return near.filter("rank = 1").withColumn("duplicate", F.col("similarity") >= 0.82).select("query_id", "fragment_id", F.round("similarity", 4).alias("similarity"), "duplicate")


#: Vectors less similar than this aren't fused.
FLOOR = 0.22


def _hybrid(spark, d):
    """Text hits of questions and vector hits of the vectors with the questions' ids."""
    vq = a.vectors(spark, d).join(a.questions(spark, d), F.col("fragment_id") == F.col("query_id")).select("query_id", "embedding")
    return r.rrf_fuse({"fts": _fts(spark, d), "vec": r.vector_topk(vq, a.vectors(spark, d), 10, FLOOR)}, _intents(spark, d))


HYBRID = {
    "hq": "SELECT query_id, embedding::DOUBLE[] AS e FROM vectors JOIN questions ON fragment_id=query_id",
    "hs": "SELECT query_id, fragment_id, round(list_cosine_similarity(e, embedding::DOUBLE[]),6) AS similarity FROM hq, vectors",
    "hv": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fragment_id) AS rank FROM hs WHERE similarity>=0.22) WHERE rank<=10",
    "ch": "SELECT query_id, fragment_id, rank, 'fts' AS c FROM fts UNION ALL SELECT query_id, fragment_id, rank, 'vec' FROM hv",
    "fused": """SELECT query_id, fragment_id, intent, sum(CASE WHEN c='fts' THEN CASE intent WHEN 'fact' THEN 1.5 WHEN 'summary' THEN 0.6 WHEN 'long_term' THEN 0.7 ELSE 1.0 END
        ELSE CASE intent WHEN 'fact' THEN 0.5 WHEN 'summary' THEN 1.4 WHEN 'long_term' THEN 1.3 ELSE 1.0 END END::DOUBLE/(60+rank)) AS rrf, bool_or(c='fts') AS by_fts, bool_or(c='vec') AS by_vec
        FROM ch JOIN intents USING (query_id) GROUP BY ALL""",
}
#: The places that stand for the owner and the assistant.
SELF = [103, 117]
#: A question names the place whose number its id gives.
NAMED = "SELECT query_id, 100+query_id%25 AS entity_id FROM questions"


def _named(spark, d):
    return a.questions(spark, d).select("query_id", (F.lit(100) + F.col("query_id") % 25).cast("long").alias("entity_id"))


def rrf(spark, d):
    return _hybrid(spark, d).select("query_id", "fragment_id", F.round("rrf", 6).alias("rrf"), "by_fts", "by_vec")


def hybrid_recall(spark, d):
    """Both channels, entity boost, ranking and cut."""
    boosted = r.entity_boost(_hybrid(spark, d), _named(spark, d), a.links(spark, d), never=SELF)
    out = r.dynamic_k(r.rank(boosted, a.fragments(spark, d), a.now()))
    return out.select("query_id", "fragment_id", "position", F.round("score", 6).alias("score"), "by_entity", "tier", "source", "permission")


def entity_channel(spark, d):
    return r.entity_channel(_named(spark, d), a.links(spark, d), a.fragments(spark, d), 5).select("query_id", "fragment_id", "rank")


def _evidence(spark, d):
    """Documents that hold a question's whole text. What stands between its first and last token, which may be parts of a document's words,
    a document must have: it is looked up in the index by the rarest of those. Questions without any are looked for one by one."""
    q = a.questions(spark, d).select("query_id", "query")
    inner = F.array_distinct(F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0))))
    q = settle(q.withColumn("_t", t.index_tokens(F.col("query"))).select("query_id", "query", inner.alias("inner")))
    blocks = index(spark, d, every=True).blocks()
    asked = r.exploded(q, ["query_id"], F.col("inner"))
    df = blocks.select("token", "n").join(F.broadcast(asked.select("token").distinct()), "token").groupBy("token").agg(F.sum("n").alias("n"))
    # a token that no document has rules its question out
    rarest = settle(asked.join(df, "token", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("k")).filter("k.n > 0").select("query_id", "k.token"))
    # settled, so that the texts aren't shuffled to meet few of them
    near = settle(blocks.select("token", "posts.id").join(F.broadcast(rarest), "token").select("query_id", F.explode("id").alias("fragment_id")).distinct())
    f = a.fragments(spark, d).select("fragment_id", "content")
    met = near.join(f, "fragment_id").join(q.select("query_id", "query"), "query_id")
    bare = q.filter(F.size("inner") == 0).select("query_id", "query")
    if bare.limit(1).count():
        met = met.select("query_id", "query", "fragment_id", "content").unionByName(bare.join(f, F.contains("content", F.col("query"))).select("query_id", "query", "fragment_id", "content"))
    return met.filter(F.contains("content", F.col("query"))).select("query_id", "fragment_id").distinct()


EVIDENCE = {"evidence": "SELECT query_id, fragment_id FROM questions JOIN fragments ON contains(content, query)"}


def metrics(spark, d):
    hits = index(spark, d, every=True).search(a.questions(spark, d).withColumn("owner_id", F.lit(0)), 20)
    return r.retrieval_metrics(hits, _evidence(spark, d))


METRICS = {**BM25, "live": "SELECT * REPLACE (0::BIGINT AS owner_id) FROM fragments", "q": BM25["q"].replace("owner_id", "0::BIGINT AS owner_id"), "f20": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fragment_id) AS rank FROM bm) WHERE rank<=20", **EVIDENCE,
           "per": "SELECT query_id, min(rank) AS first, count(*) AS n, count(*) FILTER (rank<=5) AS i5, count(*) FILTER (rank<=10) AS i10, count(*) FILTER (rank<=20) AS i20 FROM evidence LEFT JOIN f20 USING (query_id, fragment_id) GROUP BY ALL"}


def cited(spark, d):
    """A reply is the assistant's turn; what was injected is the turn before it."""
    m = a.messages(spark, d)
    replies = m.filter("sender = 'ai'").select(F.col("msg_id").alias("reply_id"), F.col("content").alias("reply"))
    injected = m.select((F.col("msg_id") + 1).alias("reply_id"), F.col("msg_id").alias("fragment_id"), "content")
    return r.mark_cited(replies, injected)


CITED = {
    "said": f"SELECT msg_id AS reply_id, unnest(list_distinct({TOKENS.format('content')})) AS token FROM messages WHERE sender='ai'",
    "own": f"SELECT msg_id+1 AS reply_id, msg_id AS fragment_id, len(ws) AS n, unnest(ws) AS token FROM (SELECT msg_id, list_distinct({TOKENS.format('content')}) AS ws FROM messages)",
}


STATUS = ["permanent", "ongoing", "archived", "permanent"]


def triggers(spark, d):
    """Episodes of an owner: one per conversation, tagged with the first two words of its first turn and of its last."""
    m = a.messages(spark, d)
    words = F.array_join(F.slice(t.index_tokens(F.col("content")), 1, 2), " ")
    tagged = m.select("owner_id", "msg_id", words.alias("tag"))
    memories = tagged.groupBy("owner_id").agg(F.array_distinct(F.array(F.min_by("tag", "msg_id"), F.max_by("tag", "msg_id"))).alias("tags"))
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("owner_id") % 4 + 1).cast("int"))
    begun = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("owner_id") % 9).cast("int"))
    memories = memories.select("owner_id", F.col("owner_id").alias("memory_id"), "tags", status.alias("status"), begun.alias("valid_from"))
    return r.hard_triggers(m, memories).select("msg_id", "memory_id", "longest", "rank")


TRIGGERS = {
    "ws": f"SELECT *, {TOKENS.format('content')} AS w FROM messages",
    "tg": "SELECT owner_id, unnest(list_distinct([arg_min(array_to_string(w[1:2],' '), msg_id), arg_max(array_to_string(w[1:2],' '), msg_id)])) AS tag FROM ws GROUP BY owner_id",
    "need": r"SELECT owner_id, tag, len(x) AS n, unnest(x) AS token FROM (SELECT *, list_distinct(regexp_extract_all(lower(tag), '[\p{L}\p{N}]+')) AS x FROM tg)",
    "sd": "SELECT owner_id, msg_id, ts, unnest(list_distinct(w)) AS token FROM ws",
    "full_": "SELECT msg_id, owner_id, tag, n FROM need JOIN sd USING (owner_id, token) WHERE owner_id%4<>2 AND DATE '2024-01-01'+(owner_id%9)::INT<=ts::DATE GROUP BY ALL HAVING count(*)=n",
}

Q = {
    "r1_recall": recall, "j1_bm25": bm25, "j3_vector_topk": vector_topk, "j16_vector_duplicates": vector_duplicates, "j4_rrf_fuse": rrf, "t25_hybrid_recall": hybrid_recall,
    "j6_entity_channel": entity_channel, "a29_retrieval_metrics": metrics, "j38_mark_cited": cited, "j36_hard_triggers": triggers,
}
S = {
    "r1_recall": a.sql("fragments questions", "SELECT query_id, fragment_id, position, round(score,6) AS score, round(rrf,6) AS relevance, tier, source, permission FROM fit", **BM25, **INTENTS,
                       fused="SELECT query_id, fragment_id, intent, CASE intent WHEN 'fact' THEN 1.5 WHEN 'summary' THEN 0.6 WHEN 'long_term' THEN 0.7 ELSE 1.0 END::DOUBLE/(60+rank) AS rrf, TRUE AS by_fts, FALSE AS by_vec, FALSE AS by_entity FROM fts JOIN intents USING (query_id)", **rank_sql("fused")),
    "j1_bm25": a.sql("fragments questions", "SELECT query_id, fragment_id, round(score,4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fragment_id) AS rank FROM bm) WHERE rank<=20", **BM25),
    "j3_vector_topk": a.sql("vectors", "SELECT query_id, fragment_id, round(similarity,4) AS similarity FROM vec", **VECTOR),
    "j16_vector_duplicates": a.sql("vectors", "SELECT query_id, fragment_id, round(similarity,4) AS similarity, similarity>=0.82 AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fragment_id) AS k FROM sims WHERE query_id<>fragment_id AND similarity>=0) WHERE k=1", vq=VECTOR["vq"], sims=VECTOR["sims"]),
    "j4_rrf_fuse": a.sql("fragments questions vectors", "SELECT query_id, fragment_id, round(rrf,6) AS rrf, by_fts, by_vec FROM fused", **BM25, **INTENTS, **HYBRID),
    "t25_hybrid_recall": a.sql("fragments questions vectors links", "SELECT query_id, fragment_id, position, round(score,6) AS score, by_entity, tier, source, permission FROM cut", **BM25, **INTENTS, **HYBRID, named=NAMED,
                               boosted="SELECT f.query_id, f.fragment_id, intent, by_fts, by_vec, n.fragment_id IS NOT NULL AS by_entity, rrf*CASE WHEN n.fragment_id IS NOT NULL THEN 1.1 ELSE 1.0 END::DOUBLE AS rrf FROM fused f LEFT JOIN (SELECT DISTINCT query_id, fragment_id FROM named JOIN links USING (entity_id) WHERE entity_id NOT IN (103,117)) n ON n.query_id=f.query_id AND n.fragment_id=f.fragment_id", **rank_sql("boosted")),
    "j6_entity_channel": a.sql("fragments questions links", "SELECT query_id, fragment_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, fragment_id) AS rank FROM (SELECT DISTINCT query_id, fragment_id, f.created_at FROM named JOIN links USING (entity_id) JOIN fragments f USING (fragment_id) WHERE status='active')) WHERE rank<=5", named=NAMED),
    "a29_retrieval_metrics": a.sql("fragments questions", """SELECT count(*) AS questions, round(avg((coalesce(first,99)<=5)::INT::DOUBLE),6) AS hit_5, round(avg((coalesce(first,99)<=10)::INT::DOUBLE),6) AS hit_10, round(avg((coalesce(first,99)<=20)::INT::DOUBLE),6) AS hit_20,
        round(avg((i5=n)::INT::DOUBLE),6) AS all_5, round(avg((i10=n)::INT::DOUBLE),6) AS all_10, round(avg((i20=n)::INT::DOUBLE),6) AS all_20, round(avg(CASE WHEN first<=20 THEN 1.0::DOUBLE/first ELSE 0.0 END),6) AS mrr FROM per""", **METRICS),
    "j38_mark_cited": a.sql("messages", "SELECT reply_id, fragment_id, count(*) AS shared FROM own JOIN said USING (reply_id, token) GROUP BY reply_id, fragment_id, n HAVING count(*)>=3 AND count(*)>=0.3*n", **CITED),
    "j36_hard_triggers": a.sql("messages", "SELECT msg_id, owner_id AS memory_id, max(length(tag)) AS longest, 1::BIGINT AS rank FROM full_ GROUP BY ALL", **TRIGGERS),
}


def scores(spark, d):
    """Age, decay, recency, importance, novelty and faded weight of every fragment."""
    f = a.fragments(spark, d).withColumn("days", s.age_days(F.col("created_at"), a.now()))
    return f.select(
        "fragment_id", F.round("days", 4).alias("days"), F.round(s.decay(F.col("days"), F.col("emotional_weight")), 6).alias("decay"), s.recency(F.col("days")).alias("recency"),
        F.round(s.importance(F.col("emotional_weight")), 6).alias("importance"), F.round(s.novelty(F.col("injected_count")), 6).alias("novelty"),
    )


Q["f15_time_factors"] = scores
S["f15_time_factors"] = a.sql("fragments", """SELECT fragment_id, round(days,4) AS days, round(CASE WHEN days<=3 THEN 0.7*exp(-lam*days)+0.3*(0.3+ew*0.7) ELSE 0.3*exp(-lam*days)+0.7*(0.3+ew*0.7) END,6) AS decay,
    CASE WHEN days<=1 THEN 1.3 WHEN days<=3 THEN 1.15 WHEN days<=7 THEN 1.05 ELSE 1.0 END::DOUBLE AS recency, round(0.4+ew*0.6,6) AS importance, round(CASE WHEN injected_count<=1 THEN 1.0::DOUBLE ELSE 1/(1+log10(injected_count+1)) END,6) AS novelty FROM f2""",
    f1=f"SELECT *, {AGE.format('created_at')} AS days, {EW} AS ew FROM fragments", f2="SELECT *, CASE WHEN ew>=0.8 THEN 0.005 WHEN ew>=0.6 THEN 0.01 WHEN ew>=0.4 THEN 0.02 ELSE 0.04 END AS lam FROM f1")
