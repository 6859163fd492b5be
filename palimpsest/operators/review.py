"""Reports, review queues, marts and model upkeep. Each takes tables and ``now``, and returns rows or the changed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from .recall import exploded, top_n
from .tables import days_before


def brightness(w: Column, days: Column, reads: Column, lifecycle: Column) -> Column:
    """How bright a fragment is shown: decayed by its weight, raised by reads, capped when cooling or frozen."""
    ew = F.when(w.isNull() | (w == 0), 0.3).otherwise(w)
    rate = F.when(ew >= 0.8, 0.005).when(ew >= 0.6, 0.01).when(ew >= 0.4, 0.02).otherwise(0.04)
    raw = F.least(F.lit(1.0), F.exp(-rate * F.greatest(F.lit(0.0), days)) + F.least(F.lit(0.3), F.log(1 + F.coalesce(reads, F.lit(0))) * 0.08))
    return F.when(lifecycle == "cooling", F.least(raw, F.lit(0.3))).when(lifecycle == "frozen", F.least(raw, F.lit(0.12))).otherwise(raw)


def constellation(fragments: DataFrame, links: DataFrame, entities: DataFrame, stars: int = 40) -> DataFrame:
    """Active entities with their stars (active before cooling before frozen, then link confidence, then weight), depth and totals."""
    order = F.when(F.col("status") == "active", 0).when(F.col("status") == "cooling", 1).otherwise(2)
    live = entities.filter("status = 'active'").select("entity_id", "name")
    own = links.join(live, "entity_id").join(fragments.select("fragment_id", "status", "emotional_weight"), "fragment_id")
    g = own.groupBy("entity_id", "name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "cooling").alias("cooling"))
    depth = 0.4 + 1.2 * F.col("total") / F.col("most")
    most = g.agg(F.max("total").alias("most"))  # one row
    best = top_n(own.select("entity_id", "fragment_id", "confidence", "emotional_weight", order.alias("o")), ["entity_id"], [F.asc("o"), F.desc("confidence"), F.desc("emotional_weight"), F.asc("fragment_id")], stars)
    shown = best.groupBy("entity_id").agg(F.count(F.lit(1)).alias("stars"), F.min_by("fragment_id", "rank").alias("first_star"))
    return g.join(F.broadcast(most)).withColumn("depth", depth).drop("most").join(shown, "entity_id")


def health(fragments: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: active entities, entities without links, unclassified fragments, fragments over a link count of five."""
    e = entities.agg(F.count_if(F.col("status") == "active").alias("active_entities"), F.count_if(F.col("status") == "seed").alias("seeds"))
    none = entities.join(links.select("entity_id").distinct(), "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("entities_without_links"))
    loose = fragments.filter("status = 'active'").join(links.select("fragment_id").distinct(), "fragment_id", "left_anti").agg(F.count(F.lit(1)).alias("unclassified"))
    return e.join(none).join(loose)  # three single rows


def flash_groups(fragments: DataFrame, by: list[str], least: int = 3, high: float = 0.85, peak: float = 0.92) -> DataFrame:
    g = fragments.groupBy(*by).agg(F.count_if(F.col("emotional_weight") >= high).alias("strong"), F.max("emotional_weight").alias("top"))
    return g.filter((F.col("strong") >= least) & (F.col("top") >= peak))


def dominant_mode(messages: DataFrame) -> DataFrame:
    """The most frequent mode of each batch; of equals the one seen first."""
    g = messages.groupBy("batch", "mode").agg(F.count(F.lit(1)).alias("n"), F.min("msg_id").alias("first"))
    return g.groupBy("batch").agg(F.max_by("mode", F.struct("n", -F.col("first"))).alias("mode"), F.sum("n").alias("messages"))


def known_entities(fragments: DataFrame, now: Column, days: int = 90, most: int = 30) -> DataFrame:
    seen = fragments.filter(F.col("created_at") >= days_before(now, days)).groupBy("entity").agg(F.max("created_at").alias("last"), F.count(F.lit(1)).alias("n"))
    return seen.orderBy(F.desc("last"), F.desc("n"), "entity").limit(most)


def status_candidates(fragments: DataFrame, now: Column, days: int = 7, newest: int = 15, least: int = 2) -> DataFrame:
    recent = fragments.filter(F.col("status").isin("active", "cooling") & (F.col("created_at") >= days_before(now, days)))
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    return top_n(recent.withColumn("n", n).filter(F.col("n") >= least), ["entity"], [F.desc("created_at"), F.desc("fragment_id")], newest)


def recall_by_date(fragments: DataFrame, messages: DataFrame, begin: str, end: str, keyword: str | None = None) -> DataFrame:
    """Fragments and messages of a span of days, with an optional keyword."""
    f = fragments.select(F.lit("fragment").alias("kind"), F.col("fragment_id").alias("id"), F.to_date("created_at").alias("day"), "content")
    m = messages.select(F.lit("message").alias("kind"), F.col("msg_id").alias("id"), F.to_date("ts").alias("day"), "content")
    out = f.unionByName(m).filter(F.col("day").between(F.lit(begin).cast("date"), F.lit(end).cast("date")))
    return out if keyword is None else out.filter(F.contains("content", F.lit(keyword)))


def link_spot_check(links: DataFrame, entities: DataFrame, below: float = 0.75, newest: int = 5) -> DataFrame:
    doubtful = links.filter(F.col("confidence") < below).orderBy(F.desc("created_at"), "fragment_id", "entity_id").limit(newest)
    return doubtful.join(entities.select("entity_id", "name"), "entity_id")


def continuation(messages: DataFrame, share: float = 0.3, minutes: float = 30) -> DataFrame:
    """Messages whose tokens overlap those of the one before (over the smaller set) within the time."""
    w = Window.partitionBy("chat_id").orderBy("ts", "msg_id")
    m = messages.withColumn("tokens", F.array_distinct(t.index_tokens(F.col("content"))))
    m = m.withColumns({"before": F.lag("tokens").over(w), "gap": F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))})
    overlap = F.size(F.array_intersect("tokens", "before")) / F.least(F.size("tokens"), F.size("before"))
    return m.filter((F.size("tokens") > 0) & (F.size("before") > 0)).withColumn("overlap", overlap).filter((F.col("gap") <= minutes * 60) & (F.col("overlap") >= share)).drop("tokens", "before")


def versions(df: DataFrame, key: str, at: str, passed: str) -> DataFrame:
    """Version numbers by time, the active (last) one, and the last that passed."""
    w = Window.partitionBy(key).orderBy(at)
    v = df.withColumn("version", F.row_number().over(w).cast("long"))
    whole = Window.partitionBy(key)
    return v.withColumns({"active": F.col("version") == F.max("version").over(whole), "last_passed": F.max(F.when(F.col(passed), F.col("version"))).over(whole)})


def model_decay(model: DataFrame, now: Column, hours: dict[str, float], abandon_days: int = 14, upgrade_evidence: int = 3) -> DataFrame:
    """States end at their expiry or their category's time to live, hypotheses after 14 days with little evidence."""
    ttl = F.create_map(*[F.lit(x) for kv in hours.items() for x in kv])
    age_h = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 3600
    over = F.when(F.col("expires_at").isNotNull(), F.col("expires_at") <= now).otherwise(age_h >= F.try_element_at(ttl, F.col("category")))
    idle = (F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("last_evidence_at", "created_at"))) / 86400
    active = F.col("status") == "active"
    new = F.when(active & (F.col("type") == "current_state") & over, "resolved").when(active & (F.col("type") == "active_hypothesis") & (idle >= abandon_days) & (F.col("evidence_count") < upgrade_evidence), "abandoned")
    return model.withColumn("status", F.coalesce(new, F.col("status")))


def pattern_match(fragments: DataFrame, patterns: DataFrame, share: float = 0.35, by: tuple[str, ...] = ()) -> DataFrame:
    """Each fragment's best pattern by the share of the pattern's tokens that it has, of those that agree in the columns ``by``."""
    p = exploded(patterns, ["pattern_id", *by], F.array_distinct(t.index_tokens(F.col("content"))), "n")
    f = exploded(fragments, ["fragment_id", *by], F.array_distinct(t.index_tokens(F.col("content"))))
    s = f.join(p, [*by, "token"]).groupBy("fragment_id", "pattern_id").agg((F.count(F.lit(1)) / F.first("n")).alias("share")).filter(F.col("share") > share)
    return top_n(s, ["fragment_id"], [F.desc("share"), F.asc("pattern_id")], 1).drop("rank")


def pattern_pairs(patterns: DataFrame, share: float = 0.45, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of patterns whose tokens overlap by that share of the smaller set, of those that agree in the columns ``by``."""
    p = exploded(patterns, ["pattern_id", *by], F.array_distinct(t.index_tokens(F.col("content"))), "n")
    q = p.select(*by, F.col("pattern_id").alias("other_id"), "token", F.col("n").alias("m"))
    g = p.join(q, [*by, "token"]).filter("pattern_id < other_id").groupBy("pattern_id", "other_id").agg((F.count(F.lit(1)) / F.least(F.first("n"), F.first("m"))).alias("share"))
    return g.filter(F.col("share") >= share)


def relation_health(relations: DataFrame, entities: DataFrame, links: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """dead where the peer is gone, stale without a shared fragment in the time, else alive."""
    peer = relations.join(entities.select(F.col("entity_id").alias("related_id"), F.col("status").alias("peer_status")), "related_id", "left")
    own = links.select("entity_id", "fragment_id", "created_at")
    shared = relations.join(own, "entity_id").join(own.select(F.col("entity_id").alias("related_id"), "fragment_id"), ["related_id", "fragment_id"]).groupBy("entity_id", "related_id").agg(F.max("created_at").alias("last_shared"))
    out = peer.join(shared, ["entity_id", "related_id"], "left")
    state = F.when(F.col("peer_status").isNull() | F.col("peer_status").isin("merged", "superseded"), "dead").when(F.coalesce(F.col("last_shared") >= days_before(now, days), F.lit(False)), "alive").otherwise("stale")
    return out.withColumn("state", state)


def stale_vectors(vectors: DataFrame, fragments: DataFrame) -> DataFrame:
    return vectors.select("fragment_id").join(fragments.filter("status = 'active'").select("fragment_id"), "fragment_id", "left_anti")


def demote_same_source(fragments: DataFrame, sources: DataFrame, deleted: DataFrame) -> DataFrame:
    """Fragments that share a source message with a deleted one: half the weight, 0.1 at least."""
    hit = sources.join(deleted.select("fragment_id"), "fragment_id", "left_semi").select("msg_id").distinct()
    near = sources.join(hit, "msg_id", "left_semi").select("fragment_id").distinct().join(deleted.select("fragment_id"), "fragment_id", "left_anti").withColumn("_hit", F.lit(True))
    return fragments.join(near, "fragment_id", "left").withColumn("emotional_weight", F.when(F.col("_hit"), F.greatest(F.lit(0.1), F.col("emotional_weight") / 2)).otherwise(F.col("emotional_weight"))).drop("_hit")


def entity_context(hits: DataFrame, links: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """For each query the entities of its hits, those with most hits first."""
    g = hits.join(links.select("fragment_id", "entity_id").distinct(), "fragment_id").join(entities.filter("status = 'active'").select("entity_id", "name"), "entity_id").groupBy("query_id", "entity_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return top_n(g, ["query_id"], [F.desc("n"), F.asc("entity_id")], most)


def loss_attribution(results: DataFrame) -> DataFrame:
    """Wrong answers by where the evidence was lost: never stored, not retrieved, or not used."""
    cause = F.when(F.col("correct"), "none").when(~F.col("stored"), "extraction").when(~F.col("retrieved"), "retrieval").otherwise("answering")
    return results.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def stability(runs: DataFrame) -> DataFrame:
    """Covered turns (run, turn_id) by run: mean and variation of the counts, mean pairwise Jaccard."""
    size = runs.groupBy("run").agg(F.countDistinct("turn_id").alias("n"))
    pair = runs.distinct().join(runs.distinct().withColumnRenamed("run", "other"), "turn_id").filter("run < other").groupBy("run", "other").agg(F.count(F.lit(1)).alias("both"))
    pair = pair.join(size, "run").join(size.select(F.col("run").alias("other"), F.col("n").alias("m")), "other").withColumn("jaccard", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    return size.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("cv"), (F.max("n") - F.min("n")).alias("spread")).join(pair.agg(F.round(F.avg("jaccard"), 6).alias("jaccard")))


def sample(fragments: DataFrame, seed: int, most: int) -> DataFrame:
    """Never-read fragments in an order drawn from their id and the seed: the same sample each time."""
    return fragments.filter("read_count = 0").orderBy(F.md5(F.concat_ws("/", F.col("fragment_id").cast("string"), F.lit(str(seed)))), "fragment_id").limit(most)


def zero_fragment_cleanup(entities: DataFrame, links: DataFrame, now: Column, days: int = 7) -> DataFrame:
    empty = entities.join(links.select("entity_id").distinct().withColumn("_has", F.lit(True)), "entity_id", "left")
    gone = (F.col("status") == "active") & F.col("_has").isNull() & (F.col("created_at") < days_before(now, days))
    return empty.withColumn("status", F.when(gone, "superseded").otherwise(F.col("status"))).drop("_has")


def auto_apply(proposals: DataFrame, now: Column, limit: int = 2, days: int = 7) -> DataFrame:
    """Pending proposals that may be applied: as many as the owner's limit leaves in the window, oldest first."""
    used = proposals.filter((F.col("status") == "applied") & (F.col("applied_at") >= days_before(now, days))).groupBy("owner_id").agg(F.count(F.lit(1)).alias("used"))
    waiting = proposals.filter("status = 'pending'").join(used, "owner_id", "left")
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy("created_at", "proposal_id"))
    return waiting.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= limit - F.coalesce("used", F.lit(0)))


def confirm_once(log: DataFrame, minutes: float = 10) -> DataFrame:
    """Confirmations of a target but those within the time after the one before."""
    gap = F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(Window.partitionBy("target_id").orderBy("at", "log_id")))
    return log.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") > minutes * 60))
