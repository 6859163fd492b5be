"""Facts and entities: evidence checks, duplicates, mentions, co-occurrence, candidates, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from .recall import exploded, top_n
from .scans import contained, pair_sums
from .tables import settle


def verify_quotes(entries: DataFrame, messages: DataFrame, longest: int = 60, shortest: int = 2) -> DataFrame:
    """Entries (entry_id, batch_id, type, quote) with source (user before ai), reason (null: kept) and the time of the earliest
    message that holds the quote. Quotes and messages are compared normalised, inside their batch."""
    e = entries.withColumn("_q", t.normalise(F.col("quote")))
    size = F.length("_q")
    e = e.withColumn("_shape", F.when(F.col("quote").isNull() | (size == 0), "missing").when(size > longest, "too_long").when(size < shortest, "too_short"))
    m = messages.select("batch_id", "sender", "ts", t.normalise(F.col("content")).alias("_m"))
    met = e.filter("_shape is null").select("entry_id", "batch_id", "_q").join(m, "batch_id").filter(F.contains("_m", F.col("_q")))
    found = met.groupBy("entry_id").agg(F.bool_or(F.col("sender") == "user").alias("_user"), F.min("ts").alias("first_at"))
    out = e.join(found, "entry_id", "left")
    source = F.when(F.col("_user"), "user").when(~F.col("_user"), "ai")
    return out.withColumns({"source": source, "reason": F.coalesce("_shape", F.when(F.col("_user").isNull(), "not_found"))}).drop("_q", "_shape", "_user")


def drop_counts(verified: DataFrame) -> DataFrame:
    return verified.filter("reason is not null").groupBy("type", "reason").agg(F.count(F.lit(1)).alias("n"))


def exact_duplicates(fragments: DataFrame) -> DataFrame:
    """(fragment_id, first_id, group_size) of fragments whose entity and content are equal when normalised."""
    h = fragments.select("fragment_id", t.content_hash(F.col("entity"), F.col("content")).alias("hash"))
    g = h.groupBy("hash").agg(F.min("fragment_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return h.join(g, "hash").select("fragment_id", "first_id", "group_size")


#: Bigram sets up to this size meet by the set without each of its bigrams, larger ones by halves.
SMALL_SET = 16


def near_duplicates(fragments: DataFrame, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(fragment_id, duplicate_of): for each fragment the smallest other id of one with the same ``by`` columns that says the same: equal
    when normalised, or the same key tokens and bigram sets of which one has a single bigram more (a Jaccard of 0.8, so from 4 on).

    Fragments of one set are one class; classes meet, not their members. Of two sets that differ in one bigram, one half of all bigrams
    (by a bit of the hash) is equal: a class is looked up by the hash of each half and its size. Small sets, whose halves may be empty,
    are looked up by the set without each of its bigrams. The larger set must then hold the bigram that is the difference."""
    keys = [*by, "_k"]
    norm = lambda rows: rows.select("fragment_id", *by, t.normalise(F.col("content")).alias("_n"))
    summed = pair_sums(norm(fragments).select("fragment_id", *by, F.when(F.col("_n") != "", F.xxhash64("_n")).alias("_text"), t.key_tokens(F.col("_n")).alias("_k"), "_n"), SMALL_SET + 1)
    # empty texts go here, as a filter on the normalised text would normalise it twice
    rows = settle(summed.filter("_text is not null").select("fragment_id", *keys, F.when(F.col("_size") == 0, F.col("_text")).otherwise(F.col("_xor")).alias("_all"), "_size", "_h0", "_h1", "_h"))
    of = [*keys, "_all", "_size"]
    # the two smallest ids: a fragment that is the smallest itself is a duplicate of the next
    first = rows.groupBy(*of).agg(F.min("fragment_id").alias("a"), F.first("_h0").alias("_h0"), F.first("_h1").alias("_h1"))
    second = rows.join(first.select("a"), F.col("fragment_id") == F.col("a"), "left_anti").groupBy(*of).agg(F.min("fragment_id").alias("b"))
    classes = settle(first.join(second, [*of], "left"))
    small, large = classes.filter(F.col("_size").between(4, SMALL_SET)), classes.filter(F.col("_size") > SMALL_SET)
    spot = lambda part, h, n: F.struct(F.lit(part).alias("part"), h.alias("hash"), n.alias("n"))
    halves = lambda df, n: df.select(*keys, "a", "_all", F.explode(F.array(spot(0, F.col("_h0"), n), spot(1, F.col("_h1"), n))).alias("_spot"))
    size = F.col("_size")
    less = halves(large, size).unionByName(small.select(*keys, "a", "_all", spot(2, F.col("_all"), size).alias("_spot")))
    lost = classes.filter(size.between(5, SMALL_SET + 1)).join(rows.select(F.col("fragment_id").alias("a"), "_h"), "a")
    lost = lost.select(*keys, "a", "_all", "_size", F.explode("_h").alias("g")).select(*keys, "a", "_all", spot(2, F.col("_all").bitwiseXOR(F.col("g")), size - 1).alias("_spot"))
    more = halves(large, size - 1).unionByName(lost).select(*keys, F.col("a").alias("c"), F.col("_all").alias("_all_c"), "_spot")
    met = settle(less.join(more, [*keys, "_spot"]).select("a", "c", F.col("_all").bitwiseXOR(F.col("_all_c")).alias("g")).distinct())
    # the pairs of larger sets aren't kept: those of the texts that met are taken apart once more
    again = pair_sums(norm(fragments.join(met.select(F.col("c").alias("fragment_id")).distinct(), "fragment_id", "left_semi")).select("fragment_id", "_n"), None)
    near = settle(met.join(again.select(F.col("fragment_id").alias("c"), "_h"), "c").filter(F.array_contains("_h", F.col("g"))).select("a", "c"))
    low = near.unionByName(near.select(F.col("c").alias("a"), F.col("a").alias("c"))).groupBy("a").agg(F.min("c").alias("near"))
    found = classes.join(low, "a", "left")
    out = rows.select("fragment_id", *of).join(found.select(*of, "a", "b", "near"), [*of])
    own = F.when(F.col("fragment_id") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return out.select("fragment_id", F.least(own, "near").alias("duplicate_of")).filter("duplicate_of is not null")


def accumulate_evidence(fragments: DataFrame, hits: DataFrame) -> DataFrame:
    """Fragments with their evidence raised for each duplicate (fragment_id, source_key) of another source."""
    n = hits.groupBy("fragment_id").agg(F.countDistinct("source_key").alias("_n"))
    out = fragments.join(n, "fragment_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    conf = F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)) + 0.05 * F.col("_n"))
    return out.withColumns({"confidence": conf, "evidence_count": F.col("evidence_count") + F.col("_n")}).drop("_n")


def mention_join(texts: DataFrame, terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(text_id, entity_id, term) of terms of two characters or more that stand anywhere in a text, both folded and lower case. Texts are
    (text_id, content), terms (entity_id, term), both with the columns ``by`` that have to agree.

    Texts are read once and shuffled only where they hold a term."""
    low, by = lambda c: F.lower(t.fold(c)), list(by)
    named = settle(terms.select(*by, "entity_id", low(F.col("term")).alias("term")).filter(F.length("term") >= 2).distinct())
    folded = texts.select(*by, "text_id", low(F.coalesce("content", F.lit(""))).alias("_low"))
    return contained(folded, named, by).select("text_id", "entity_id", "term").distinct()


#: Terms of an owner that are looked for one by one in each of its texts.
FEW = 1024


def few_terms(texts: DataFrame, terms: DataFrame, by: list[str], few: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(text_id, entity_id, term) of terms that stand in a text of the same ``by`` columns, where those have at most ``few`` terms; and the
    terms of the others, which are to be met by their runs. Texts are (by, text_id, _low), terms (by, entity_id, term), each once."""
    few = FEW if few is None else few
    sized = settle(terms.join(terms.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by))
    held = sized.filter(F.col("_n") <= few).groupBy(*by).agg(F.collect_list(F.struct("entity_id", "term")).alias("_held"))
    hit = texts.join(held, by).select("text_id", F.filter("_held", lambda h: F.contains(F.col("_low"), h["term"])).alias("_hit"))
    found = hit.select("text_id", F.explode_outer("_hit").alias("_h")).filter("_h is not null").select("text_id", "_h.entity_id", "_h.term")
    return found, sized.filter(F.col("_n") > few).drop("_n")


def mentions_within(texts: DataFrame, terms: DataFrame, by: list[str], few: int | None = None) -> DataFrame:
    """``mention_join`` within the ``by`` columns, without a row for each run of a text where those have few terms."""
    low = lambda c: F.lower(t.fold(c))
    named = terms.select(*by, "entity_id", low(F.col("term")).alias("term")).filter(F.length("term") >= 2).distinct()
    found, rest = few_terms(texts.select(*by, "text_id", low(F.coalesce("content", F.lit(""))).alias("_low")), named, by, few)
    if rest.limit(1).count():
        found = found.unionByName(mention_join(texts.join(rest.select(*by).distinct(), by, "left_semi"), rest, tuple(by)))
    return found.distinct()


def pairs_within(rows: DataFrame, group: str, item: str, most: int = 1024) -> DataFrame:
    """(group, a, b), a < b, of a group's distinct items. A large group's items are dealt into blocks of about ``most``, and each pair of blocks
    meets by itself, so that no task has a whole group's pairs."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_blocks"))
    dealt = rows.select(group, item).join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    sent = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = sent.select(group, item, "_own", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"))
    left = sent.withColumnsRenamed({item: "a", "_own": "_mine"})
    # items of one block meet where it is paired with itself
    met = left.join(sent.withColumnRenamed(item, "b"), [group, "_lo", "_hi"]).filter((F.col("a") < F.col("b")) & ((F.col("_lo") == F.col("_hi")) | (F.col("_mine") != F.col("_own"))))
    return met.select(group, "a", "b")


def cooccurring(links: DataFrame, entities: DataFrame, least: int = 2, most: int = 30, first: int = 256) -> DataFrame:
    """Pairs of active entities by the number of fragments that name both, the ``most`` largest.

    A pair shares no more fragments than either of its entities has. The ``first`` entities with the most fragments are paired before all; what
    the last of their best pairs share is then the least that an entity needs."""
    live = settle(links.join(entities.filter("status = 'active'").select("entity_id"), "entity_id").select("fragment_id", "entity_id").distinct())
    sizes = live.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    counted = lambda rows: pairs_within(rows, "fragment_id", "entity_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least).orderBy(F.desc("shared"), "a", "b").limit(most)
    large = sizes.orderBy(F.desc("n"), "entity_id").limit(first).select("entity_id")
    best = counted(live.join(F.broadcast(large), "entity_id", "left_semi")).collect()  # ``most`` rows
    floor = best[-1].shared if len(best) == most else least
    return counted(live.join(sizes.filter(F.col("n") >= max(floor, least)), "entity_id", "left_semi"))


def coactive(links: DataFrame, entities: DataFrame, fragments: DataFrame, categories: list[str]) -> DataFrame:
    """Pairs of entities of the categories that are active on the same days but share no fragment."""
    own = links.join(entities.filter(F.col("category").isin(categories)).select("entity_id"), "entity_id").select("entity_id", "fragment_id")
    days = own.join(fragments.select("fragment_id", F.to_date("created_at").alias("day")), "fragment_id").select("entity_id", "day").distinct()
    pair = lambda df, on: df.withColumnRenamed("entity_id", "a").join(df.withColumnRenamed("entity_id", "b"), on).filter("a < b")
    counted = pair(days, "day").groupBy("a", "b").agg(F.count(F.lit(1)).alias("days"))
    return counted.join(pair(own.distinct(), "fragment_id").select("a", "b").distinct(), ["a", "b"], "left_anti")


def merge_candidates(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of entities of one category by shared name bigrams (half of the smaller) or shared fragments (half of the fewer)."""
    named = entities.select("entity_id", "category", t.bigrams(t.normalise(F.col("name"))).alias("_b"))
    grams = named.select("entity_id", "category", F.size("_b").alias("n"), F.explode_outer("_b").alias("g")).filter("g is not null")
    ren = lambda df, x: df.select(F.col("entity_id").alias(x), *[F.col(c).alias(f"{c}_{x}") if c in ("n", "name") else c for c in df.columns if c != "entity_id"])
    by_name = ren(grams, "a").join(ren(grams, "b"), ["category", "g"]).filter("a < b").groupBy("a", "b").agg((F.count(F.lit(1)) / F.least(F.first("n_a"), F.first("n_b"))).alias("s"))
    by_name = by_name.filter("s >= 0.5").select("a", "b", F.lit("name").alias("why"))
    own = links.select("entity_id", "fragment_id").distinct().join(entities.select("entity_id", "category"), "entity_id")
    sizes = own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    shared = ren(own, "a").join(ren(own, "b"), ["category", "fragment_id"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    shared = shared.join(ren(sizes, "a"), "a").join(ren(sizes, "b"), "b").filter(F.col("k") >= 0.5 * F.least("n_a", "n_b")).select("a", "b", F.lit("fragments").alias("why"))
    return by_name.unionByName(shared).groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why"))


def unlinked(fragments: DataFrame, links: DataFrame) -> DataFrame:
    return fragments.join(links.select("fragment_id"), "fragment_id", "left_anti")


def orphans(links: DataFrame, entities: DataFrame, of: list[str], without: list[str]) -> DataFrame:
    """Fragments linked to an entity of a category in ``of`` and to none of those in ``without``."""
    kind = links.join(entities.select("entity_id", "category"), "entity_id")
    return kind.filter(F.col("category").isin(of)).select("fragment_id").distinct().join(kind.filter(F.col("category").isin(without)).select("fragment_id"), "fragment_id", "left_anti")


def derive_links(links: DataFrame, relations: DataFrame) -> DataFrame:
    """Links of fragments to the related entities of those that they name, where there is none yet."""
    new = links.join(relations.select("entity_id", "related_id"), "entity_id").select("fragment_id", F.col("related_id").alias("entity_id"), F.col("entity_id").alias("via"))
    new = new.join(links.select("fragment_id", "entity_id"), ["fragment_id", "entity_id"], "left_anti")
    return new.groupBy("fragment_id", "entity_id").agg(F.min("via").alias("via")).withColumn("confidence", F.lit(0.45))


def entity_lifecycle(entities: DataFrame, links: DataFrame, now: Column, dormant_days: int = 30, seed_days: int = 14) -> DataFrame:
    """New status: seeds with 3 links can graduate, old ones without are pruned; active ones sleep after 30 days without a new
    link, dormant ones wake at one."""
    g = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
    e = entities.join(g, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    idle = (F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("last", "created_at"))) / 86400
    age = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 86400
    new = (
        F.when((F.col("status") == "seed") & (F.col("n") >= 3), "graduate")
        .when((F.col("status") == "seed") & (age > seed_days), "pruned")
        .when((F.col("status") == "active") & (idle > dormant_days), "dormant")
        .when((F.col("status") == "dormant") & (idle <= dormant_days), "active")
    )
    return e.withColumn("new_status", F.coalesce(new, F.col("status")))


def apply_merges(links: DataFrame, survivors: DataFrame) -> DataFrame:
    """Links re-pointed to the survivors (entity_id, into); the best confidence of links that then coincide stays."""
    moved = links.join(survivors, "entity_id", "left").withColumn("entity_id", F.coalesce("into", "entity_id"))
    return moved.groupBy("fragment_id", "entity_id").agg(F.max("confidence").alias("confidence"), F.min("created_at").alias("created_at"))


def trace(fragment_messages: DataFrame, messages: DataFrame, around: int = 2) -> DataFrame:
    """Each fragment's source messages with those ``around`` them in the chat: (fragment_id, msg_id, distance)."""
    w = Window.partitionBy("chat_id").orderBy("ts", "msg_id")
    placed = messages.select("chat_id", "msg_id", F.row_number().over(w).alias("n"))
    src = fragment_messages.join(placed, "msg_id").select("fragment_id", "chat_id", "n", F.explode(F.sequence(F.lit(-around), F.lit(around))).alias("distance"))
    near = src.withColumn("n", F.col("n") + F.col("distance")).join(placed, ["chat_id", "n"])
    return near.groupBy("fragment_id", "msg_id").agg(F.min(F.abs("distance")).alias("distance"))


def mine_terms(fragments: DataFrame, known: DataFrame, pattern: str, least: int, most: int) -> DataFrame:
    """The most frequent matches of a pattern that no entity is named by."""
    rows = fragments.select(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("_w")).select(F.explode_outer("_w").alias("term")).filter("term is not null")
    new = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).join(known.select(F.col("name").alias("term")), "term", "left_anti")
    return new.orderBy(F.desc("n"), "term").limit(most)


def stopwords(messages: DataFrame, least: int = 10, share: float = 0.03, most: int = 120) -> DataFrame:
    """Tokens that more than a share of all messages have, most frequent first."""
    total = messages.agg(F.count(F.lit(1)).alias("total"))
    df = exploded(messages, ["msg_id"], F.array_distinct(t.index_tokens(F.col("content")))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return df.join(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(least), F.col("total") * share)).orderBy(F.desc("n"), "token").limit(most).select("token", "n")  # total is one row


def consolidation_candidates(links: DataFrame, entities: DataFrame, fragments: DataFrame, least: int = 15, top: int = 5, newest: int = 30) -> DataFrame:
    """The entities with most links, and the newest active fragments of each."""
    live = entities.filter("status = 'active'").select("entity_id")
    counts = links.join(live, "entity_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_links")).filter(F.col("n_links") >= least)
    chosen = counts.orderBy(F.desc("n_links"), "entity_id").limit(top)
    own = links.join(chosen, "entity_id").join(fragments.filter("status = 'active'").select("fragment_id", F.col("created_at").alias("at")), "fragment_id").select("entity_id", "n_links", "fragment_id", "at").distinct()
    return top_n(own, ["entity_id"], [F.desc("at"), F.asc("fragment_id")], newest).drop("at")
