"""Retrieval: full-text and vector top-k, fusion, ranking, cut-offs and metrics. One row per (query, hit)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as s
from ..functions import text as t
from .tables import settle

#: Queries and vectors of a block: what a task compares has a bounded size.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 8192
#: Vectors of a cell about, and pivots at most.
CELL_ROWS, MAX_PIVOTS = 1024, 4096


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, ranked from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= n)


def exploded(df: DataFrame, keep: list[str], tokens: Column, size: str | None = None) -> DataFrame:
    """A row for each token. The tokens are a column of their own and exploded with outer rows, which go again: else a filter on
    their number is inferred and evaluates them once more for every element."""
    rows = df.select(*keep, tokens.alias("_ws"))
    return rows.select(*keep, *([F.size("_ws").alias(size)] if size else []), F.explode_outer("_ws").alias("token")).filter("token is not null")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf)."""
    return exploded(docs, [id_col], t.index_tokens(F.col(text_col))).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, id_col: str = "fragment_id", text_col: str = "content", by: tuple[str, ...] = ("owner_id",)) -> DataFrame:
    """(query_id, id, score, rank): query tokens are OR-ed. Queries meet documents of the same ``by`` columns, whose statistics count
    alone. A semi-join drops postings of other tokens before they are shuffled."""
    by = list(by)
    wanted = exploded(queries, ["query_id", *by], t.query_tokens(F.col("query")))
    names = wanted.select(*by, "token").distinct()
    tokens = t.index_tokens(F.col(text_col))
    sized = docs.select(*by, F.size(tokens).alias("dl"))
    stats = sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    raw = exploded(docs, [id_col, *by], tokens, "dl").join(names, [*by, "token"], "left_semi")
    posts = raw.groupBy(id_col, *by, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = posts.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))
    met = df.join(stats, by) if by else df.join(F.broadcast(stats))  # without keys stats is one row
    idf = met.select(*by, "token", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = wanted.join(idf, [*by, "token"]).join(posts, [*by, "token"]).groupBy("query_id", id_col).agg(F.round(F.sum(part), 6).alias("score"))
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc(id_col)], k)


def _matrix(column) -> np.ndarray:
    """A list column of equally long vectors as unit rows."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _nearest(k: int, floor: float):
    """The k nearest of a block of vectors for each query of a block."""

    def run(queries, vectors):
        import pyarrow as pa

        none = pa.table({"query_id": pa.array([], pa.int64()), "fragment_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not queries.num_rows or not vectors.num_rows:
            return none
        vectors = vectors.sort_by("fragment_id")
        ids, own = queries.column("query_id").to_numpy(), vectors.column("fragment_id").to_numpy()
        sim = np.round(_matrix(queries.column("embedding")) @ _matrix(vectors.column("embedding")).T, 6)
        near = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(sim, near, 1)
        row, col = np.nonzero(best >= floor)
        return pa.table({"query_id": ids[row], "fragment_id": own[near[row, col]], "similarity": best[row, col]})

    return run


def _distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (u**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (u @ pivots.T)
    return np.sqrt(np.maximum(squared, 0))


def _place(pivots: np.ndarray):
    """The nearest pivot of each vector, and how far it is."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            far = _distances(_matrix(batch.column("embedding")), pivots)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell])], ["fragment_id", "embedding", "cell", "radius"])

    return run


def _route(pivots: np.ndarray, size: np.ndarray, least: np.ndarray, most: np.ndarray, need: int, later: bool):
    """The cells that each query meets: first its nearest ones that hold ``need`` vectors; later all others that may hold one within its reach. A
    cell's vectors lie between ``least`` and ``most`` of its pivot, and no nearer to another."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            far = _distances(_matrix(batch.column("embedding")), pivots)
            order = np.argsort(far, axis=1, kind="stable")
            before = np.cumsum(size[order], 1) - size[order]
            met = np.zeros(far.shape, bool)
            np.put_along_axis(met, order, before < need, 1)
            if later:
                bound = np.maximum(np.maximum(far - most, least - far), (far - far.min(1, keepdims=True)) / 2)
                met = ~met & (bound <= batch.column("reach").to_numpy()[:, None])
            met &= size > 0
            row, cell = np.nonzero(met)
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            cells = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("embedding"), cells], ["query_id", "embedding", "cells"])

    return run


def _meet(routes: DataFrame, placed: DataFrame, size: np.ndarray, k: int, floor: float, met: dict | None) -> DataFrame:
    """The k nearest in each block of a cell for the queries that are sent there: queries and vectors of a cell are dealt into blocks, and
    each pair of blocks is a cogroup of bounded size."""
    spark = routes.sparkSession
    routes = settle(routes)
    sent = routes.select("query_id", "embedding", F.explode("cells").alias("cell"))
    asked = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each pivot at most
    if met is not None:
        met["pairs"] = met.get("pairs", 0) + sum(n * int(size[c]) for c, n in asked.items())
    blocks = spark.createDataFrame([(c, -(-n // QUERY_BLOCK), -(-int(size[c]) // VECTOR_BLOCK)) for c, n in asked.items()], "cell int, qbs int, vbs int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = sent.join(F.broadcast(blocks), "cell").select("query_id", "embedding", "cell", own("query_id", "qbs").alias("qb"), every("vbs").alias("vb"))
    right = placed.join(F.broadcast(blocks), "cell").select("fragment_id", "embedding", "cell", own("fragment_id", "vbs").alias("vb"), every("qbs").alias("qb"))
    keys = ("cell", "qb", "vb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k, floor), "query_id long, fragment_id long, similarity double")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, floor: float = 0.2, skip_self: bool = False, met: dict | None = None) -> DataFrame:
    """(query_id, fragment_id, similarity, rank) by exact cosine; queries are (query_id, embedding). Null vectors are left out.

    Vectors lie in the cells of their nearest pivots, CELL_ROWS of them about in each. A query meets its nearest cells first; the k-th
    similarity there is its reach, and it then meets those other cells alone that by the triangle inequality may hold a vector within it. Unit vectors of
    similarity s are sqrt(2 - 2 s) apart. ``met`` gets the number of pairs that were compared, and of all pairs."""
    # an alias, as queries may come from the vectors themselves
    q = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = vectors.filter("embedding is not null").select(F.col("fragment_id").cast("long").alias("fragment_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, need = v.count(), k + skip_self
    wanted = min(MAX_PIVOTS, -(-n // CELL_ROWS))
    # at most MAX_PIVOTS vectors, by a hash of the id
    chosen = v.orderBy(F.xxhash64("fragment_id"), "fragment_id").limit(max(wanted, 1)).select("embedding").toArrow().combine_chunks()
    if not n:
        return q.sparkSession.createDataFrame([], "query_id long, fragment_id long, similarity double, rank long")
    pivots = np.unique(_matrix(chosen.column("embedding")), axis=0)
    placed = v.mapInArrow(_place(pivots), "fragment_id long, embedding array<double>, cell int, radius double")
    size, least, most = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    if len(pivots) > 1:
        placed = settle(placed)
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect():  # a row for each pivot
            size[r.cell], least[r.cell], most[r.cell] = r.n, r.lo, r.hi
    else:
        size[:] = n
    if met is not None:
        met |= {"pairs": 0, "of": n * q.count()}
    schema = "query_id long, embedding array<double>, cells array<int>"
    out = _meet(q.mapInArrow(_route(pivots, size, least, most, need, later=False), schema), placed, size, need, floor, met)
    if len(pivots) > 1:
        out = settle(out)
        last = top_n(out, ["query_id"], [F.desc("similarity"), F.asc("fragment_id")], need).filter(F.col("rank") == need).select("query_id", F.col("similarity").alias("_last"))
        # similarities are rounded to six places; a distance carries the error of a square root
        near = F.greatest(F.lit(float(floor)), F.coalesce("_last", F.lit(float(floor)))) - 2e-6
        reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * near)) + 1e-6
        asking = q.join(last, "query_id", "left").select("query_id", "embedding", reach.alias("reach"))
        out = out.unionByName(_meet(asking.mapInArrow(_route(pivots, size, least, most, need, later=True), schema), placed, size, need, floor, met))
    if skip_self:
        out = out.filter("query_id <> fragment_id")
    return top_n(out, ["query_id"], [F.desc("similarity"), F.asc("fragment_id")], k)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, tags: DataFrame, query_tags: DataFrame, live: DataFrame, floor: float = 0.2) -> DataFrame:
    """``vector_topk`` with tags: of the nearest 3 k (30 at least) those that share a tag with the query count double, 1 at most; then
    the floor, the fragments in ``live`` alone, and the best k. Tags are (fragment_id, tag) and (query_id, tag)."""
    near = vector_topk(queries, vectors, max(3 * k, 30), -1.0).drop("rank")
    shared = near.join(query_tags.select("query_id", "tag").distinct(), "query_id").join(tags.select("fragment_id", "tag").distinct(), ["fragment_id", "tag"]).select("query_id", "fragment_id").distinct().withColumn("_tagged", F.lit(True))
    near = near.join(shared, ["query_id", "fragment_id"], "left")
    near = near.withColumn("similarity", F.when(F.col("_tagged"), F.least(F.lit(1.0), 2 * F.col("similarity"))).otherwise(F.col("similarity"))).drop("_tagged")
    kept = near.filter(F.col("similarity") >= floor).join(live.select("fragment_id"), "fragment_id", "left_semi")
    return top_n(kept, ["query_id"], [F.desc("similarity"), F.asc("fragment_id")], k)


def channel_weight(intent: Column, channel: str) -> Column:
    if channel == "fts":
        return F.when(intent == "fact", 1.5).when(intent == "summary", 0.6).when(intent == "long_term", 0.7).otherwise(1.0)
    return F.when(intent == "fact", 0.5).when(intent == "summary", 1.4).when(intent == "long_term", 1.3).otherwise(1.0)


def rrf_fuse(channels: dict[str, DataFrame], intents: DataFrame, k: int = 60, id_col: str = "fragment_id") -> DataFrame:
    """(query_id, id, rrf, by_fts, by_vec): reciprocal ranks (from 1) weighted by intent, summed over the channels."""
    ranked = [df.select("query_id", id_col, "rank", F.lit(name).alias("channel")) for name, df in channels.items()]
    both = ranked[0]
    for more in ranked[1:]:
        both = both.unionByName(more)
    both = both.join(intents.select("query_id", "intent"), "query_id")
    weight = F.when(F.col("channel") == "fts", channel_weight(F.col("intent"), "fts")).otherwise(channel_weight(F.col("intent"), "vec"))
    return both.groupBy("query_id", id_col, "intent").agg(
        F.sum(weight / (k + F.col("rank"))).alias("rrf"), F.bool_or(F.col("channel") == "fts").alias("by_fts"), F.bool_or(F.col("channel") == "vec").alias("by_vec")
    )


def entity_boost(candidates: DataFrame, query_entities: DataFrame, links: DataFrame, boost: float = 0.1, never: list[int] = ()) -> DataFrame:
    """Candidates already found that are linked to an entity named in the query: ``rrf`` times 1 + boost, ``by_entity`` set. Entities in
    ``never``, the owner's and the assistant's own, don't boost."""
    named = query_entities.filter(~F.col("entity_id").isin(*never)).join(links.select("fragment_id", "entity_id"), "entity_id").select("query_id", "fragment_id").distinct().withColumn("by_entity", F.lit(True))
    out = candidates.join(named, ["query_id", "fragment_id"], "left").withColumn("by_entity", F.coalesce("by_entity", F.lit(False)))
    return out.withColumn("rrf", F.col("rrf") * F.when(F.col("by_entity"), 1 + boost).otherwise(1.0))


def entity_channel(query_entities: DataFrame, links: DataFrame, fragments: DataFrame, n: int) -> DataFrame:
    """The newest n active fragments of the entities named in a query."""
    live = fragments.filter("status = 'active'").select("fragment_id", "created_at")
    found = query_entities.join(links.select("fragment_id", "entity_id"), "entity_id").join(live, "fragment_id").select("query_id", "fragment_id", "created_at").distinct()
    return top_n(found, ["query_id"], [F.desc("created_at"), F.asc("fragment_id")], n)


def rank(candidates: DataFrame, fragments: DataFrame, now: Column, min_relevance: float = 0.005) -> DataFrame:
    """Candidates (query_id, fragment_id, rrf, intent, by_fts, by_vec) with score, tier, source and permission."""
    f = fragments.select("fragment_id", "created_at", "emotional_weight", "injected_count", F.length("content").alias("chars"))
    out = candidates.join(f, "fragment_id").filter(F.col("rrf") >= min_relevance).withColumn("days", s.age_days(F.col("created_at"), now))
    by_entity = F.col("by_entity") if "by_entity" in candidates.columns else F.lit(False)
    similarity = F.coalesce("similarity", F.lit(0.0)) if "similarity" in candidates.columns else F.lit(0.0)
    tier = s.confidence_tier(F.col("by_fts"), F.col("by_vec"), similarity, F.col("rrf"), by_entity)
    source = s.channel(F.col("by_fts"), F.col("by_vec"), by_entity)
    score = s.rank_score(F.col("rrf"), F.col("days"), F.col("emotional_weight"), F.col("injected_count"), F.col("intent"))
    return out.withColumns({"score": F.round(score, 9), "tier": tier, "source": source}).withColumn("permission", s.permission(F.col("days"), F.col("tier"), F.col("source")))


def dynamic_k(hits: DataFrame, cutoff: float = 0.5, k: int = 8, relevance: str = "rrf", score: str = "score", id_col: str = "fragment_id") -> DataFrame:
    """Hits of at least ``cutoff`` of the query's best relevance, at most k, in score order."""
    best = F.max(relevance).over(Window.partitionBy("query_id"))
    kept = hits.withColumn("_best", best).filter(F.col(relevance) >= F.col("_best") * cutoff).drop("_best")
    return top_n(kept, ["query_id"], [F.desc(score), F.asc(id_col)], k, "position")


def take_within_budget(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows in order until the next one doesn't fit; none after it. Costs are positive."""
    running = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", running).filter(F.col("used") <= budget)


def mark_cited(replies: DataFrame, injected: DataFrame, least_shared: int = 3, least_share: float = 0.3) -> DataFrame:
    """(reply_id, fragment_id) of injected fragments whose tokens the reply shares: at least so many and such a share."""
    said = exploded(replies, ["reply_id"], F.array_distinct(t.index_tokens(F.col("reply"))))
    own = exploded(injected, ["reply_id", "fragment_id"], F.array_distinct(t.index_tokens(F.col("content"))), "n")
    shared = own.join(said, ["reply_id", "token"]).groupBy("reply_id", "fragment_id").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
    return shared.filter((F.col("shared") >= least_shared) & (F.col("shared") >= least_share * F.col("n"))).select("reply_id", "fragment_id", "shared")


def retrieval_metrics(hits: DataFrame, evidence: DataFrame, ks: tuple[int, ...] = (5, 10, 20), id_col: str = "fragment_id") -> DataFrame:
    """One row: questions, hit@k (any evidence), all@k, MRR over the largest k. Evidence is (query_id, id); hits have rank from 1."""
    found = evidence.join(hits.select("query_id", id_col, "rank"), ["query_id", id_col], "left")
    most = max(ks)
    per = found.groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in ks])
    hit = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).cast("double")), 6).alias(f"hit_{k}") for k in ks]
    every = [F.round(F.avg((F.col(f"in_{k}") == F.col("n")).cast("int").cast("double")), 6).alias(f"all_{k}") for k in ks]
    mrr = F.round(F.avg(F.when(F.col("first") <= most, 1 / F.col("first")).otherwise(0.0)), 6).alias("mrr")
    return per.agg(F.count(F.lit(1)).alias("questions"), *hit, *every, mrr)


def hard_triggers(messages: DataFrame, memories: DataFrame, most: int = 3) -> DataFrame:
    """(msg_id, memory_id) of permanent and ongoing memories that are valid by the message's day and of which some tag has all its
    tokens in the message; the longest tag first, then the newest. Messages are (owner_id, msg_id, content, ts), memories
    (owner_id, memory_id, tags, status, valid_from)."""
    said = exploded(messages, ["msg_id", "owner_id", "ts"], F.array_distinct(t.index_tokens(F.col("content"))))
    live = memories.filter(F.col("status").isin("permanent", "ongoing"))
    tags = live.select("memory_id", "owner_id", "valid_from", F.explode("tags").alias("tag"))
    tags = tags.withColumn("tokens", F.array_distinct(t.index_tokens(F.col("tag")))).filter(F.size("tokens") > 0)
    needed = tags.select("memory_id", "owner_id", "valid_from", "tag", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= F.to_date("ts"))
    full = said.join(needed, ["owner_id", "token"]).filter(begun).groupBy("msg_id", "memory_id", "valid_from", "tag", "n").agg(F.count(F.lit(1)).alias("got")).filter("got = n")
    best = full.groupBy("msg_id", "memory_id", "valid_from").agg(F.max(F.length("tag")).cast("long").alias("longest"))
    return top_n(best, ["msg_id"], [F.desc("longest"), F.desc("valid_from"), F.asc("memory_id")], most)
