"""User model and evidence: matching, anchors, conflicts, independence, proposals, surfacing, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as s
from ..functions import text as t
from . import blocks
from .recall import top_n
from .tables import days_before, settle


def similar_pairs(neighbours: DataFrame, threshold: float) -> DataFrame:
    """Each pair of a batch once, from its nearest neighbours (query_id, fragment_id, similarity)."""
    near = neighbours.filter((F.col("similarity") >= threshold) & (F.col("query_id") != F.col("fragment_id")))
    return near.groupBy(F.least("query_id", "fragment_id").alias("a"), F.greatest("query_id", "fragment_id").alias("b")).agg(F.max("similarity").alias("similarity"))


def match_evidence(fragments: DataFrame, entries: DataFrame, least: float = 3.0) -> DataFrame:
    """Each fragment's best model entry of its owner. For each of the entry's names: 3 if the fragment's entity holds it, 2 if the
    content holds it as words, 2 if name and entity hold one another in lower case; and 0.3 for each of the fragment's tokens that the
    entry has. Equal scores go by priority, then confidence. Entries are (owner_id, entry_id, content, names, priority, confidence). An
    owner's fragments and entries meet in pairs of blocks, each of which gives a fragment's best entry there."""
    said = lambda df, words, *more: df.select("owner_id", *more, F.array_join(words, " ").alias("words"))
    own = fragments.join(entries.select("owner_id").distinct(), "owner_id", "left_semi")
    x = settle(said(own, t.index_tokens(F.col("content")), F.col("fragment_id").cast("long").alias("fragment_id"), "entity", F.lower("entity").alias("low_entity"), F.coalesce("content", F.lit("")).alias("content")))
    name = lambda c: F.struct(c.alias("name"), F.lower(c).alias("low"), F.get(t.index_tokens(c), F.lit(0)).alias("token"))
    names = F.transform(F.filter("names", lambda c: c != ""), name).alias("names")
    y = settle(said(entries, F.array_distinct(t.index_tokens(F.col("content"))), F.col("entry_id").cast("long").alias("entry_id"), F.col("priority").cast("long").alias("priority"), F.col("confidence").cast("double").alias("confidence"), names))
    met = blocks.dealt(x, y, "owner_id", {"left": "fragment_id", "right": "entry_id"}, blocks.MATCH_BLOCK)
    best = met.applyInArrow(blocks.best_match(least), "fragment_id long, entry_id long, priority long, confidence double, score double")
    return top_n(best, ["fragment_id"], [F.desc("score"), F.desc("priority"), F.desc("confidence"), F.asc("entry_id")], 1).select("fragment_id", "entry_id", "score")


def anchors(entries: DataFrame, fragments: DataFrame, days: float, least: int = 4, keep: int = 50) -> DataFrame:
    """Entries with the fragments of their owner that share ``least`` tokens and lie within ``days`` of them, the ``keep`` that share most.
    They meet in pairs of blocks."""
    words = F.array_join(F.array_distinct(t.index_tokens(F.col("content"))), " ").alias("words")
    rows = lambda df, id_col: df.select("owner_id", F.col(id_col).cast("long").alias(id_col), F.unix_timestamp("created_at").alias("at"), words).filter("at is not null")
    own = fragments.join(entries.select("owner_id").distinct(), "owner_id", "left_semi")
    met = blocks.dealt(settle(rows(entries, "entry_id")), settle(rows(own, "fragment_id")), "owner_id", {"left": "entry_id", "right": "fragment_id"}, blocks.MATCH_BLOCK)
    near = met.applyInArrow(blocks.most_shared(days * 86400, least, keep), "entry_id long, fragment_id long, shared long")
    return top_n(near, ["entry_id"], [F.desc("shared"), F.asc("fragment_id")], keep)


def _word_sets(df: DataFrame) -> DataFrame:
    """(owner_id, entry_id, n, set): the distinct tokens, joined by spaces, settled. An owner that is null meets nobody. Texts without tokens go
    afterwards, as a filter on the number evaluates the tokens once more."""
    sets = df.filter("owner_id is not null").select("owner_id", "entry_id", F.array_distinct(t.index_tokens(F.col("content"))).alias("_w"))
    return settle(sets.select("owner_id", F.col("entry_id").cast("long").alias("entry_id"), F.size("_w").alias("n"), F.array_join("_w", " ").alias("set"))).filter("n > 0")


def _conflicts(sets: DataFrame, share: float) -> DataFrame:
    return blocks.dealt_with_itself(sets, "owner_id", "entry_id", blocks.SET_BLOCK).applyInArrow(blocks.overlaps(share), "entry_id long, other_id long, overlap double")


def state_conflicts(states: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs of an owner's states whose tokens overlap by more than the share of the smaller set. An owner's states are dealt into blocks,
    and each pair of blocks is one group of bounded size."""
    return _conflicts(_word_sets(states), share)


def needs_review(states: DataFrame, traits: DataFrame, share: float = 0.5, least: int = 5) -> DataFrame:
    """(entry_id, why) of states that conflict with another state, and of those that share ``least`` tokens with a trait."""
    x, y = _word_sets(states), _word_sets(traits)
    clash = _conflicts(x, share).select(F.explode(F.array("entry_id", "other_id")).alias("entry_id"), F.lit("state").alias("why"))
    near = blocks.dealt(x, y, "owner_id", "entry_id", blocks.SET_BLOCK).applyInArrow(blocks.sharing(least), "entry_id long").select("entry_id", F.lit("trait").alias("why"))
    return clash.unionByName(near).groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why"))


def independence(new: DataFrame, known: DataFrame, most: float = 0.3) -> DataFrame:
    """New evidence (entry_id, fragment_id, msg_id) is independent if less than ``most`` of its messages support the entry already."""
    old = known.select("entry_id", "msg_id").distinct().withColumn("old", F.lit(1))
    g = new.join(old, ["entry_id", "msg_id"], "left").groupBy("entry_id", "fragment_id").agg((F.count("old") / F.count(F.lit(1))).alias("known_share"))
    return g.withColumn("independent", F.col("known_share") < most)


def proposals(traits: DataFrame, proposed: DataFrame, confidence: float = 0.7, evidence: int = 3, days: int = 3) -> DataFrame:
    ok = traits.filter((F.col("confidence") >= confidence) & (F.col("evidence_count") >= evidence) & (F.col("source_diversity") >= days))
    return ok.join(proposed.select("entry_id"), "entry_id", "left_anti")


def draws(now: Column, noise: float = 0.15, seed: int = 1) -> Column:
    """A fragment's weight, one more on an anniversary of its day, and a normal noise that its id and the seed give."""
    u = lambda k: (F.conv(F.substring(F.md5(F.concat_ws("/", F.col("fragment_id").cast("string"), F.lit(f"{seed}{k}"))), 1, 8), 16, 10).cast("double") + 1) / (2.0**32 + 1)
    normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    day = lambda c: F.date_format(c, "MM-dd")
    anniversary = (day(F.col("created_at")) == day(now)) & (F.year("created_at") < F.year(now))
    return F.round(s.weight(F.col("emotional_weight")) + F.coalesce(anniversary, F.lit(False)).cast("int") + noise * normal, 6)


def noisy_topk(fragments: DataFrame, now: Column, most: int, noise: float = 0.15, seed: int = 1) -> DataFrame:
    """An owner's fragments of the greatest draws."""
    return top_n(fragments.withColumn("draw", draws(now, noise, seed)), ["owner_id"], [F.desc("draw"), F.asc("fragment_id")], most)


def surfacing(fragments: DataFrame, log: DataFrame, now: Column, cooldown_days: int = 7, least_age: int = 3, most: int = 2, noise: float = 0.15, seed: int = 1) -> DataFrame:
    """Never injected, old enough, not surfaced of late: the best draws of an owner."""
    recent = log.filter(F.col("at") >= days_before(now, cooldown_days)).select("fragment_id")
    free = fragments.filter((F.coalesce("injected_count", F.lit(0)) == 0) & (F.col("created_at") < days_before(now, least_age))).join(recent, "fragment_id", "left_anti")
    return noisy_topk(free, now, most, noise, seed)


def dominant_emotion(pairs: DataFrame, order: list[str], floor: float = 0.2) -> DataFrame:
    """(id, dim) of the greatest score over the floor; of equals the first in the given order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("dim"))
    over = pairs.filter((F.col("score") > floor) & (place > 0)).withColumn("_p", place)
    return over.groupBy("id").agg(F.max_by("dim", F.struct("score", -F.col("_p"))).alias("dim"), F.max("score").alias("score"))


def drift(answers: DataFrame, anchors_: DataFrame, least: float = 0.2) -> DataFrame:
    """Mean bigram Jaccard of answers and anchors by probe, and whether it passes. Equal texts of a probe are counted; the others meet in
    pairs of blocks."""
    plain = lambda df: df.filter("probe is not null").groupBy(F.col("probe").cast("long").alias("probe"), t.normalise(F.col("content")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    met = blocks.dealt(settle(plain(answers)), settle(plain(anchors_)), "probe", "text", blocks.TEXT_BLOCK, "text").applyInArrow(blocks.jaccard_sums, "probe long, total double, pairs long")
    return met.groupBy("probe").agg((F.sum("total") / F.sum("pairs")).alias("score"), F.sum("pairs").alias("pairs")).withColumn("passed", F.col("score") >= least)


def drift_by_vectors(answers: DataFrame, anchors_: DataFrame, least: float = 0.5) -> DataFrame:
    """``drift`` by the mean cosine of embeddings (probe, embedding)."""
    unit = lambda df, name: df.select("probe", F.transform("embedding", lambda v: v.cast("double")).alias(name))
    both = unit(answers, "x").join(unit(anchors_, "y"), "probe").withColumn("sim", s.cosine(F.col("x"), F.col("y")))
    return both.groupBy("probe").agg(F.avg("sim").alias("score"), F.count(F.lit(1)).alias("pairs")).withColumn("passed", F.col("score") >= least)


def evidence_recall(stored: DataFrame, qa: DataFrame) -> DataFrame:
    """One row: share of evidence turns that are stored, of questions with any and with all of them."""
    e = qa.join(stored.select("turn_id").distinct().withColumn("has", F.lit(1)), "turn_id", "left").withColumn("has", F.coalesce("has", F.lit(0)))
    q = e.groupBy("question").agg(F.max("has").alias("any"), F.min("has").alias("all"))
    return e.agg(F.round(F.avg("has"), 6).alias("turns")).join(q.agg(F.round(F.avg("any"), 6).alias("any_share"), F.round(F.avg("all"), 6).alias("all_share")))  # single rows


def uncertain_entities(entities: DataFrame, links: DataFrame, fragments: DataFrame, least: int = 10) -> DataFrame:
    live = links.join(fragments.filter("status = 'active'").select("fragment_id"), "fragment_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return entities.filter(F.col("relationship_confidence").isin("low", "medium")).join(live, "entity_id").select("entity_id", "relationship_confidence", "n")


def overview_queue(entities: DataFrame, links: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """Entities whose overview is missing, grown past or old, by priority."""
    e = entities.join(links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "entity_id")
    grown = (F.col("n") - F.col("last_count") >= 3) & (F.col("n") >= 1.3 * F.col("last_count"))
    why = F.when(F.col("overview_at").isNull(), "missing").when(grown, "grown").when(F.col("overview_at") < days_before(now, 30), "old")
    order = F.when(F.col("reason") == "missing", 0).when(F.col("reason") == "grown", 1).otherwise(2)
    return e.withColumn("reason", why).filter("reason is not null").orderBy(order, F.desc("n"), "entity_id").limit(most)


def freshness(days: Column) -> Column:
    return F.when(days.isNull(), 0.1).when(days <= 7, 1.0).when(days <= 30, 0.85).when(days <= 90, 0.6).when(days <= 180, 0.3).otherwise(0.1)


def merge_entries(model: DataFrame, survivors: DataFrame, gap: float = 0.2) -> DataFrame:
    """Entries merged into their survivors where confidences are close: summed evidence, the best confidence; losers superseded."""
    s_ = survivors.join(model.select("entry_id", F.col("confidence").alias("own")), "entry_id").join(model.select(F.col("entry_id").alias("into"), F.col("confidence").alias("other")), "into").filter(F.abs(F.col("own") - F.col("other")) <= gap + 1e-9)
    gained = s_.join(model.select("entry_id", "evidence_count"), "entry_id").groupBy(F.col("into").alias("entry_id")).agg(F.sum("evidence_count").alias("more"), F.max("own").alias("best"))
    out = model.join(gained, "entry_id", "left").join(s_.select("entry_id", F.lit(True).alias("lost")), "entry_id", "left")
    return out.withColumns({"evidence_count": F.col("evidence_count") + F.coalesce("more", F.lit(0)), "confidence": F.greatest("confidence", F.coalesce("best", "confidence")), "status": F.when(F.col("lost"), "superseded").otherwise(F.col("status"))}).drop("more", "best", "lost")


def working_pool(injections: DataFrame, minutes: float = 30, size: int = 5) -> DataFrame:
    """For each injection how many of its owner's last ones, itself included, are in the pool: within the time, at most ``size``."""
    w = Window.partitionBy("owner_id").orderBy(F.unix_timestamp("at")).rangeBetween(int(-minutes * 60), 0)
    return injections.withColumn("pool", F.least(F.count(F.lit(1)).over(w), F.lit(size)))
