"""Links, evidence and model upkeep: resolvers, auto-links, recounts, corrections, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from .linking import mention_join
from .recall import top_n

#: A change of mind, in the past and complete; a negation.
PAST, CHANGE = "以前|過去|曾經|原本|本來|used to|no longer", "現在|不再|改成|變成|已經|now|anymore"
NEGATION = "不|沒|無|別|not|never|no longer"


def is_time_phrase(name: Column) -> Column:
    """Names of dates and times, of one character, or of digits alone: none of them names an entity."""
    return F.length(F.trim(name)).between(0, 1) | F.trim(name).rlike(rf"^[0-9]+$|^[{t.NUMERALS}年月日號号時时分點点\s:/.-]+$|^(?:{t.WEEK})[{t.NUMERALS}日天]$|(?:期間|时期|時期|階段|阶段)$") | F.trim(name).isin(t.TIMES)


def is_preference_drift(text: Column) -> Column:
    return F.lower(text).rlike(PAST) & F.lower(text).rlike(CHANGE)


def has_negation(text: Column) -> Column:
    return F.lower(text).rlike(NEGATION)


def has_concrete_detail(text: Column) -> Column:
    return text.rlike(r"[0-9]") | text.rlike(t.KEY)


def resolve_keyword(fragments: DataFrame, aliases: DataFrame, skip: list[str]) -> DataFrame:
    """(fragment_id, entity_id, via): the entity field names it (exact), else the first alias that the content holds."""
    names = aliases.filter(~F.col("alias").isin(skip)).select("entity_id", "alias", "place")
    exact = fragments.join(names.select("entity_id", F.col("alias").alias("entity")), "entity").groupBy("fragment_id").agg(F.min("entity_id").alias("entity_id")).withColumn("via", F.lit("entity"))
    rest = fragments.join(exact.select("fragment_id"), "fragment_id", "left_anti")
    met = mention_join(rest.select(F.col("fragment_id").alias("text_id"), "content"), names.select("entity_id", F.col("alias").alias("term")))
    order = names.select("entity_id", F.lower(t.fold(F.col("alias"))).alias("term"), "place").groupBy("entity_id", "term").agg(F.min("place").alias("place"))
    best = top_n(met.join(order, ["entity_id", "term"]), ["text_id"], [F.asc("place"), F.asc("entity_id")], 1)
    return exact.unionByName(best.select(F.col("text_id").alias("fragment_id"), "entity_id", F.lit("content").alias("via")))


def auto_link(fragments: DataFrame, terms: DataFrame, links: DataFrame, most_hits: int = 8, per_entity: int = 5) -> DataFrame:
    """New links of fragments that mention an entity's term: terms with few enough hits, the name's before aliases', the newest
    fragments first, at most ``per_entity`` for an entity. terms is (entity_id, term, term_rank)."""
    met = mention_join(fragments.select(F.col("fragment_id").alias("text_id"), "content"), terms.select("entity_id", "term"))
    met = met.withColumnRenamed("text_id", "fragment_id").join(links.select("fragment_id", "entity_id"), ["fragment_id", "entity_id"], "left_anti")
    hits = met.groupBy("entity_id", "term").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") <= most_hits)
    ranked = met.join(hits, ["entity_id", "term"]).join(terms.select("entity_id", F.lower(t.fold(F.col("term"))).alias("term"), "term_rank").distinct(), ["entity_id", "term"])
    one = ranked.groupBy("entity_id", "fragment_id").agg(F.min("term_rank").alias("term_rank"))
    return top_n(one, ["entity_id"], [F.asc("term_rank"), F.desc("fragment_id")], per_entity).withColumn("confidence", F.lit(0.4))


def ambiguous_aliases(names: DataFrame) -> DataFrame:
    """Aliases contained in, or containing, a name of another entity. They share a first bigram with it somewhere."""
    n = names.select("entity_id", t.normalise(F.col("alias")).alias("a")).filter(F.length("a") >= 2).distinct()
    first = n.select("entity_id", "a", F.substring("a", 1, 2).alias("g"))
    grams = n.select(F.col("entity_id").alias("other"), F.col("a").alias("b"), t.bigrams(F.col("a")).alias("_g")).select("other", "b", F.explode_outer("_g").alias("g"))
    inside = first.join(grams, "g").filter((F.col("entity_id") != F.col("other")) & F.contains("b", F.col("a")))
    return inside.select("entity_id", F.col("a").alias("alias")).unionByName(inside.select(F.col("other").alias("entity_id"), F.col("b").alias("alias"))).distinct()


def tag_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs of entities where a tag of one names the other, each once, unless they are related already."""
    tags = entities.select("entity_id", F.explode_outer("tags").alias("name")).filter("name is not null")
    found = tags.join(entities.select(F.col("entity_id").alias("other"), "name"), "name").filter("entity_id <> other").select(F.least("entity_id", "other").alias("a"), F.greatest("entity_id", "other").alias("b")).distinct()
    known = relations.select(F.least("entity_id", "related_id").alias("a"), F.greatest("entity_id", "related_id").alias("b"))
    return found.join(known, ["a", "b"], "left_anti")


def unlinked_mentions(fragments: DataFrame, terms: DataFrame, links: DataFrame, newest: int = 15) -> DataFrame:
    """For each entity the newest fragments that mention it without a link, and how many there are."""
    met = mention_join(fragments.select(F.col("fragment_id").alias("text_id"), "content"), terms).select(F.col("text_id").alias("fragment_id"), "entity_id").distinct()
    free = met.join(links.select("fragment_id", "entity_id"), ["fragment_id", "entity_id"], "left_anti").withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("entity_id")))
    return top_n(free, ["entity_id"], [F.desc("fragment_id")], newest)


def replicate_episode(members: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """(memory_id, entity_id) of other entities that ``least`` of an episode's fragments are linked to."""
    g = members.join(links.select("fragment_id", F.col("entity_id").alias("other")).distinct(), "fragment_id").filter("other <> entity_id").groupBy("memory_id", "other").agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") >= least).select("memory_id", F.col("other").alias("entity_id"), "n")


def recompute_evidence(evidence: DataFrame, fragments: DataFrame) -> DataFrame:
    """Evidence (entry_id, fragment_id): its number, and the distinct days of active fragments, one at least."""
    day = fragments.select("fragment_id", F.when(F.col("status") == "active", F.to_date("created_at")).alias("day"))
    return evidence.join(day, "fragment_id", "left").groupBy("entry_id").agg(F.count(F.lit(1)).alias("evidence_count"), F.greatest(F.lit(1), F.countDistinct("day")).alias("source_diversity"))


def graduation(links: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    g = links.join(entities.filter("status = 'seed'").select("entity_id"), "entity_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct(F.to_date("created_at")).alias("days"))
    return g.filter((F.col("n_links") >= least) & (F.col("days") >= 1))


def model_context(model: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Active entries by type, as many as the type's limit, best first; types without a limit give all."""
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("type")), F.lit(1 << 30))
    rank = F.row_number().over(Window.partitionBy("owner_id", "type").orderBy(F.desc("confidence"), "entry_id")).cast("long")
    return model.filter("status = 'active'").withColumn("rank", rank).filter(F.col("rank") <= most)


def profile_tiers(model: DataFrame) -> DataFrame:
    tier = F.when((F.col("source_diversity") >= 5) & (F.col("evidence_count") >= 30), "core").when(F.col("source_diversity") >= 3, "high").otherwise("normal")
    return model.filter("status = 'active' and confidence >= 0.5").withColumn("tier", tier)


def daily_log(lines: DataFrame, keep: int = 10) -> DataFrame:
    """One line a day and owner, the latest; the last ``keep`` days."""
    last = lines.groupBy("owner_id", "day").agg(F.max_by("line", "id").alias("line"))
    return top_n(last, ["owner_id"], [F.desc("day")], keep)


def record_corrections(memories: DataFrame, corrections: DataFrame) -> DataFrame:
    """Memories that were corrected weigh 0.3 of what they did, 1 at least, once for each correction's target."""
    hit = corrections.filter("target_type = 'memory'").select(F.col("target_id").alias("memory_id")).distinct().withColumn("_hit", F.lit(True))
    return memories.join(hit, "memory_id", "left").withColumn("weight", F.when(F.col("_hit"), F.greatest(F.lit(1.0), F.col("weight") * 0.3)).otherwise(F.col("weight"))).drop("_hit")


def close_intentions(fragments: DataFrame, fulfilled: DataFrame) -> DataFrame:
    """``future_hook`` goes from the tags of fulfilled fragments; where none is left they carry ``fulfilled``."""
    left = F.array_remove("value_tags", "future_hook")
    return fragments.join(fulfilled.select("fragment_id").distinct().withColumn("_f", F.lit(True)), "fragment_id", "left").withColumn("value_tags", F.when(F.col("_f"), F.when(F.size(left) == 0, F.array(F.lit("fulfilled"))).otherwise(left)).otherwise(F.col("value_tags"))).drop("_f")


def overview_growth(entities: DataFrame, links: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Entities whose links grew by a share, and a number, since ``last_count``."""
    n = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return entities.join(n, "entity_id").filter((F.col("n") - F.col("last_count") >= least) & (F.col("n") >= (1 + share) * F.col("last_count")))
