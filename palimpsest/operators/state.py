"""Expiry and confidence of model entries, routing and voting of links, queues, verdicts and reports. All set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .linking import mention_join
from .recall import exploded, top_n
from .tables import days_before

#: Hours that a state lasts by category and class (else 48), and the caps of direct statements (else 0.85).
TTL_HOURS = {
    "physical": {"hours": 8, "day": 24, "days": 72},
    "emotional": {"hours": 4, "day": 12, "days": 36},
    "situational": {"hours": 12, "day": 24, "days": 72},
    "relational": {"hours": 4, "day": 12, "days": 72},
}
DIRECT_CAPS = {"immutable_fact": 0.99, "stable_trait": 0.85, "current_state": 0.95, "active_hypothesis": 0.75}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def state_expiry(at: Column, category: Column, ttl: Column, stated: Column, default_hours: int = 48, most_days: int = 90) -> Column:
    """When a state ends: the stated time, at most ``most_days`` ahead, else by its category (an unknown one is emotional) and class."""
    flat = {f"{c}:{k}": h for c, row in TTL_HOURS.items() for k, h in row.items()}
    known = F.when(category.isin(list(TTL_HOURS)), category).otherwise("emotional")
    hours = F.coalesce(_lookup(flat, F.concat(known, F.lit(":"), F.coalesce(ttl, F.lit("")))), F.lit(default_hours))
    ahead = lambda seconds: F.timestamp_seconds(F.unix_timestamp(at) + seconds)
    return F.when(stated.isNotNull(), F.least(stated, ahead(F.lit(most_days * 86400)))).otherwise(ahead(hours * 3600))


def initial_confidence(type_: Column, quality: Column, confidence: Column) -> Column:
    """What was stated directly starts 0.15 higher, up to its type's cap; what was inferred starts at 0.70 at most."""
    cap = F.coalesce(_lookup(DIRECT_CAPS, type_), F.lit(0.85))
    return F.when(quality == "direct_statement", F.least(cap, confidence + 0.15)).when(quality == "inferred", F.least(F.lit(0.70), confidence)).otherwise(confidence)


def ascii_like(value: Column, pattern: str) -> Column:
    """LIKE that ignores case among A-Z alone."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.like(low(value), low(F.lit(pattern)))


def exclude_sources(df: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of other sources; a row without a source stays."""
    return df.filter(F.col("source").isNull() | ~F.col("source").isin(sources))


def list_episodes(episodes: DataFrame, status: str | None, month: str | None) -> DataFrame:
    """Episodes of one status and one month (``YYYY-MM``), where given."""
    kept = episodes if status is None else episodes.filter(F.col("status") == status)
    return kept if month is None else kept.filter(F.date_format("created_at", "yyyy-MM") == month)


def route_links(fragments: DataFrame, routing: DataFrame, entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New links of fragments (fragment_id, tags) to the entities that their tags route to, and the names of entities to create.
    routing is (tag, name, confidence); a name routed to twice takes the higher confidence, a link that exists stays as it is."""
    tagged = fragments.select("fragment_id", F.explode_outer(F.array_distinct("tags")).alias("tag")).filter("tag is not null")
    met = tagged.join(routing, "tag").groupBy("fragment_id", "name").agg(F.max("confidence").alias("confidence"))
    known = entities.groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    new = met.join(known, "name").join(links.select("fragment_id", "entity_id"), ["fragment_id", "entity_id"], "left_anti").select("fragment_id", "entity_id", "confidence")
    return new, met.select("name").distinct().join(known, "name", "left_anti")


def vector_hints(neighbours: DataFrame, links: DataFrame, most: int = 3) -> DataFrame:
    """Entities of a fragment's neighbours (query_id, fragment_id, similarity) by votes times the highest similarity."""
    votes = neighbours.join(links.select("fragment_id", "entity_id").distinct(), "fragment_id").groupBy("query_id", "entity_id").agg(F.count(F.lit(1)).alias("votes"), F.max("similarity").alias("nearest"))
    scored = votes.withColumn("score", F.round(F.col("votes") * F.col("nearest"), 6))
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc("entity_id")], most)


def alias_backfill(aliases: DataFrame, fragments: DataFrame, links: DataFrame, shortest: int = 2, longest: int = 4, newest: int = 15) -> DataFrame:
    """Active fragments that hold a short alias of an entity without being linked to it, the newest of each entity."""
    short = aliases.filter(F.length("term").between(shortest, longest)).select("entity_id", "term")
    live = fragments.filter("status = 'active'")
    met = mention_join(live.select(F.col("fragment_id").alias("text_id"), "content"), short).select(F.col("text_id").alias("fragment_id"), "entity_id").distinct()
    return top_n(met.join(links.select("fragment_id", "entity_id"), ["fragment_id", "entity_id"], "left_anti"), ["entity_id"], [F.desc("fragment_id")], newest)


def hit_sources(hits: DataFrame, fragment_messages: DataFrame, messages: DataFrame, first: int = 3, last: int = 15) -> DataFrame:
    """The last messages behind each query's first hits: query_id, fragment_id, msg_id, place (1 is the oldest shown)."""
    top = hits.filter(F.col("rank") <= first).select("query_id", "fragment_id")
    behind = top.join(fragment_messages.select("fragment_id", "msg_id").distinct(), "fragment_id").join(messages.select("msg_id", "ts"), "msg_id")
    shown = top_n(behind, ["query_id", "fragment_id"], [F.desc("ts"), F.desc("msg_id")], last, "_back")
    return top_n(shown, ["query_id", "fragment_id"], [F.desc("_back")], last, "place").select("query_id", "fragment_id", "msg_id", "place")


def observed_span(model: DataFrame, fragments: DataFrame, messages: DataFrame) -> DataFrame:
    """(entry_id, first_at, last_at) over the fragments (entry_id, fragment_id) behind an entry, by their messages' times, else their own."""
    said = messages.groupBy("fragment_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    own = model.join(fragments.select("fragment_id", "created_at"), "fragment_id").join(said, "fragment_id", "left")
    return own.groupBy("entry_id").agg(F.min(F.coalesce("_first", "created_at")).alias("first_at"), F.max(F.coalesce("_last", "created_at")).alias("last_at"))


def queue_proposals(found: DataFrame, known: DataFrame) -> DataFrame:
    """The queue with new pairs (a, b in either order) pending; pairs already queued or decided keep their row."""
    pair = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    return known.select("a", "b", "status").unionByName(pair.join(known, ["a", "b"], "left_anti").withColumn("status", F.lit("pending")))


def decide_proposals(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending pairs take the decision (a, b, accepted) made on them; others stay."""
    made = decisions.groupBy("a", "b").agg(F.min("accepted").alias("accepted"))
    status = F.when((F.col("status") == "pending") & F.col("accepted").isNotNull(), F.when(F.col("accepted"), "approved").otherwise("rejected")).otherwise(F.col("status"))
    return queue.join(made, ["a", "b"], "left").select("a", "b", status.alias("status"))


def apply_episode_verdicts(episodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Distorted episodes keep half their weight, fabricated ones are archived; the worst verdict on an episode counts."""
    worst = verdicts.groupBy("memory_id").agg(F.max(F.when(F.col("verdict") == "fabricated", 2).when(F.col("verdict") == "distorted", 1).otherwise(0)).alias("_worst"))
    bad = F.coalesce("_worst", F.lit(0))
    out = episodes.join(worst, "memory_id", "left").withColumn("weight", F.when(bad == 1, F.col("weight") * 0.5).otherwise(F.col("weight"))).withColumn("status", F.when(bad == 2, "archived").otherwise(F.col("status")))
    return out.select(episodes.columns)


def relation_queue(entities: DataFrame, links: DataFrame, fragments: DataFrame, now: Column, least: int = 5) -> DataFrame:
    """Entities (entity_id, relation, confidence, evaluated_count, evaluated_at) whose relation is to be judged, with the reason: new
    ones with enough fragments and three more than last time; of low or medium confidence, daily with three new fragments; of high
    confidence, after thirty days with five."""
    live = links.select("entity_id", "fragment_id").distinct().join(fragments.filter("status = 'active'").select("fragment_id", "created_at"), "fragment_id")
    e = entities.select("entity_id", "relation", "confidence", "evaluated_count", "evaluated_at")
    fresh = F.coalesce(F.col("created_at") > F.col("evaluated_at"), F.lit(True))
    n = e.join(live, "entity_id").groupBy(*e.columns).agg(F.count(F.lit(1)).alias("n"), F.count_if(fresh).alias("n_new"))
    age = F.unix_timestamp(now) - F.unix_timestamp("evaluated_at")
    last = F.coalesce("evaluated_count", F.lit(0))
    reason = (
        F.when((F.coalesce("relation", F.lit("")) == "") & (F.col("n") >= least) & ((last == 0) | (F.col("n") >= last + 3)), "new")
        .when(F.col("confidence").isin("low", "medium") & F.coalesce(age > 86400, F.lit(True)) & (F.col("n_new") >= 3), "recheck")
        .when((F.col("confidence") == "high") & (age > 30 * 86400) & (F.col("n_new") >= 5), "stale")
    )
    return n.select("entity_id", "n", "n_new", reason.alias("reason")).filter("reason is not null")


def review_queues(model: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """owner_id, entry_id, queue: active hypotheses with enough evidence, and the first traits marked for review."""
    live = model.filter("status = 'active'")
    hypotheses = live.filter((F.col("type") == "active_hypothesis") & (F.col("evidence_count") >= least)).select("owner_id", "entry_id", F.lit("validate").alias("queue"))
    marked = live.filter((F.col("type") == "stable_trait") & F.array_contains("tags", "needs_review"))
    return hypotheses.unionByName(top_n(marked, ["owner_id"], [F.desc("priority"), F.asc("confidence"), F.asc("entry_id")], most).select("owner_id", "entry_id", F.lit("review").alias("queue")))


def trait_checks(model: DataFrame, fragments: DataFrame, now: Column, days: int = 14, most: int = 5, least: int = 2, keep: int = 5) -> DataFrame:
    """(owner_id, entry_id, place, fragment_id, shared, rank): an owner's traits, those of the oldest evidence first, each with the active
    fragments of the last ``days`` that share most tokens with it, ``least`` at least; a trait without any has one row of nulls."""
    traits = top_n(model.filter("status = 'active' and type = 'stable_trait'"), ["owner_id"], [F.asc_nulls_first("last_evidence_at"), F.asc("entry_id")], most, "place")
    recent = fragments.filter((F.col("status") == "active") & (F.col("created_at") >= days_before(now, days)))
    tokens = lambda df, key: exploded(df, ["owner_id", key], F.array_distinct(t.index_tokens(F.col("content"))))
    met = tokens(traits, "entry_id").join(tokens(recent, "fragment_id"), ["owner_id", "token"]).filter("entry_id <> fragment_id")
    shared = met.groupBy("entry_id", "fragment_id").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    best = top_n(shared, ["entry_id"], [F.desc("shared"), F.asc("fragment_id")], keep)
    return traits.select("owner_id", "entry_id", "place").join(best, "entry_id", "left")


def add_judged_links(links: DataFrame, judged: DataFrame, least: float = 0.0, fixed: float | None = None) -> DataFrame:
    """Links and those that were judged (fragment_id, entity_id, confidence) with at least ``least``, with their confidence (0.7 where none
    is stated) or a fixed one (0.6 and 0.55 for rematches); links that are there stay as they are, and of several judgements on one pair
    the surest counts."""
    sure = judged.withColumn("confidence", F.coalesce("confidence", F.lit(0.7))).filter(F.col("confidence") >= least).groupBy("fragment_id", "entity_id").agg(F.max("confidence").alias("confidence"))
    new = sure.join(links.select("fragment_id", "entity_id"), ["fragment_id", "entity_id"], "left_anti")
    worth = F.col("confidence") if fixed is None else F.lit(fixed)
    return links.select("fragment_id", "entity_id", "confidence").unionByName(new.select("fragment_id", "entity_id", worth.alias("confidence")))


def consolidation_report(episodes: DataFrame, members: DataFrame) -> DataFrame:
    """One row: episodes, those with sources, consolidated fragments, and the last run."""
    held = members.groupBy("memory_id").agg(F.count_distinct("fragment_id").alias("_n"))
    return episodes.join(held, "memory_id", "left").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("_n") > 0).alias("with_sources"), F.coalesce(F.sum("_n"), F.lit(0)).alias("consolidated"), F.max("created_at").alias("last_run"))


def browse(entities: DataFrame, links: DataFrame, fragments: DataFrame, keyword: str, newest: int = 5) -> DataFrame:
    """Each entity's fragment count and its newest fragments that hold the keyword (any case of A-Z)."""
    own = links.select("entity_id", "fragment_id").distinct().join(fragments.select("fragment_id", "created_at", "content"), "fragment_id")
    counts = own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_fragments"))
    escaped = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    met = own.filter(ascii_like(F.col("content"), f"%{escaped}%")).select("entity_id", "fragment_id", "created_at")
    shown = top_n(met, ["entity_id"], [F.desc("created_at"), F.desc("fragment_id")], newest)
    return entities.select("entity_id").join(counts, "entity_id").join(shown, "entity_id", "left").select("entity_id", "n_fragments", "fragment_id", "rank")
