"""The user model under evidence: bumps and penalties, current states, patterns, profile rules, seeds and a user's own edits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from .linking import mention_join

#: Fixed values. What confirming evidence adds by type: independent and stated, independent, other; and the caps, stated and not.
CONFIRM = {
    "stable_trait": (0.05, 0.05, 0.02, 0.99, 0.80),
    "current_state": (0.15, 0.08, 0.04, 0.99, 0.75),
    "active_hypothesis": (0.10, 0.10, 0.05, 0.75, 0.75),
    "immutable_fact": (0.01, 0.01, 0.01, 0.99, 0.99),
}
#: Fixed values. Share of the penalty (0.12 independent, 0.05 other) and floor of contradicting evidence.
CONTRADICT = {"stable_trait": (1.0, 0.10), "current_state": (1.2, 0.05), "active_hypothesis": (1.5, 0.05), "immutable_fact": (0.5, 0.20)}
#: Fixed values. Stability of profile categories: least diversity, and whether a candidate may be new.
TIERS = {
    "locked": (["basic"], None, False),
    "high": (["personality", "communication"], 5, False),
    "medium": (["career", "social", "personal_history", "relationship_with_companion", "creative_work"], 3, True),
    "low": (["preference", "lifestyle", "health", "finance"], 1, True),
}
#: In this order the first of an entry's tags is its category.
CATEGORIES = "basic personality career social preference lifestyle health creative_work personal_history relationship_with_companion finance communication".split()


def _by_type(kind: Column, table: dict, pick) -> Column:
    out = F.lit(float(pick(table["immutable_fact"])))
    for name, row in table.items():
        out = F.when(kind == name, float(pick(row))).otherwise(out)
    return out


def apply_evidence(model: DataFrame, evidence: DataFrame) -> DataFrame:
    """Model entries (entry_id, type, quality, confidence, evidence_count) after a batch of evidence (entry_id, at, fragment_id,
    confirms, independent, diversity), one by one in time. Contradictions of inferred entries ask for review; a hypothesis that
    reaches 0.70 with a diversity of 3 becomes a trait. An entry's evidence of the batch is one array."""
    one = F.struct("at", "fragment_id", "confirms", "independent", "diversity")
    held = evidence.groupBy("entry_id").agg(F.array_sort(F.collect_list(one)).alias("_ev"))

    def step(acc: Column, e: Column) -> Column:
        kind, stated, c = acc["type"], acc["quality"] == "direct_statement", acc["confidence"]
        bump = F.when(e["independent"] & stated, _by_type(kind, CONFIRM, lambda r: r[0])).when(e["independent"], _by_type(kind, CONFIRM, lambda r: r[1])).otherwise(_by_type(kind, CONFIRM, lambda r: r[2]))
        cap = F.when(stated, _by_type(kind, CONFIRM, lambda r: r[3])).otherwise(_by_type(kind, CONFIRM, lambda r: r[4]))
        penalty = F.when(e["independent"], 0.12).otherwise(0.05) * _by_type(kind, CONTRADICT, lambda r: r[0])
        new = F.when(e["confirms"], F.least(cap, c + bump)).otherwise(F.greatest(_by_type(kind, CONTRADICT, lambda r: r[1]), c - penalty))
        up = (kind == "active_hypothesis") & (e["diversity"] >= 3) & (new >= 0.70)
        review = acc["needs_review"] | (~e["confirms"] & e["independent"] & ~stated & (c >= 0.5))
        return F.struct(
            F.when(up, "stable_trait").otherwise(kind).alias("type"), F.when(up, "inferred").otherwise(acc["quality"]).alias("quality"), new.alias("confidence"),
            (acc["evidence_count"] + 1).alias("evidence_count"), review.alias("needs_review"), (acc["contradictions"] + F.when(e["confirms"], 0).otherwise(1)).alias("contradictions"),
        )

    start = F.struct(F.col("type"), F.col("quality"), F.col("confidence").cast("double").alias("confidence"), F.col("evidence_count").cast("long").alias("evidence_count"), F.lit(False).alias("needs_review"), F.lit(0).alias("contradictions"))
    out = model.join(held, "entry_id", "left").withColumn("_s", F.aggregate(F.coalesce("_ev", F.array().cast(f"array<{_EVIDENCE}>")), start, step))
    names = ("type", "quality", "confidence", "evidence_count", "needs_review", "contradictions")
    return out.withColumns({n: F.col(f"_s.{n}") for n in names}).drop("_s", "_ev")


_EVIDENCE = "struct<at:timestamp,fragment_id:bigint,confirms:boolean,independent:boolean,diversity:bigint>"


class Book:
    """An owner's active states, and what a new statement does to them. Times are seconds, tokens in order.

    More than 0.8 of the statement's tokens in a state extend it; more than half replace it; a companion's statement within half an
    hour of its last is merged into that one where they share enough; a deep cycle's is skipped where a companion wrote that day."""

    def __init__(self, states: list[dict] | None = None) -> None:
        self.states = states or []

    def expire(self, now: float) -> None:
        self.states = [x for x in self.states if x["until"] is None or x["until"] > now]

    def best(self, tokens: list[str]) -> tuple[dict | None, float]:
        found, share = None, 0.0
        for state in reversed(self.states):  # the newest first
            own = set(state["tokens"])
            part = sum(w in own for w in tokens) / len(tokens) if tokens else 0.0
            if part > share:
                found, share = state, part
        return found, share

    def add(self, id_: int, at: float, by: str, tokens: list[str], words: list[str], ttl: float | None) -> tuple[str, int, int | None]:
        """(action, id of the state, id of the state that it replaces)."""
        until = None if ttl is None else at + ttl
        found, share = self.best(tokens)
        recent = next((x for x in reversed(self.states) if x["by"] == "companion" and at - x["at"] < 1800), None) if by == "companion" and share < 0.8 else None
        same = recent is not None and (share > 0.15 or len(set(words) & set(recent["words"])) >= 2)
        target = recent if same else found if share > 0.8 else None
        if target is not None:
            target.update(tokens=tokens, words=words, until=target["until"] if until is None else until)
            return "updated", target["id"], None
        if found is not None and share > 0.5:
            self.states.remove(found)
        today = next((x for x in reversed(self.states) if x["by"] == "companion" and x["at"] // 86400 == at // 86400), None)
        if by == "deep_cycle" and today is not None and share < 0.4:
            return "skipped", today["id"], None
        self.states.append({"id": id_, "at": at, "by": by, "tokens": tokens, "words": words, "until": until})
        return "created", id_, found["id"] if found is not None and share > 0.5 else None


ACTIONS = "owner_id long, statement_id long, action string, state_id long, replaces long"


def statements(df: DataFrame) -> DataFrame:
    """(owner_id, statement_id, at, by, ttl, tokens, words) of (owner_id, statement_id, at, by, content, ttl in seconds)."""
    words = F.filter(F.array_distinct(F.split(F.coalesce("content", F.lit("")), r"[\s\p{P}]+")), lambda w: F.length(w) >= 2)
    return df.select("owner_id", "statement_id", F.unix_timestamp("at").cast("double").alias("at"), "by", F.col("ttl").cast("double").alias("ttl"), t.index_tokens(F.col("content")).alias("tokens"), words.alias("words"))


def fold_statements(rows: Iterator[dict], book: Book) -> Iterator[tuple]:
    for r in rows:
        book.expire(r["at"])
        yield (r["owner_id"], r["statement_id"], *book.add(r["statement_id"], r["at"], r["by"], r["tokens"], r["words"], r["ttl"]))


def _replay(batches):
    import pyarrow as pa

    owner, book = object(), Book()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["owner_id"] != owner:
                owner, book = r["owner_id"], Book()
            out += fold_statements(iter([r]), book)
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["owner_id", "statement_id", "action", "state_id", "replaces"])


def upsert_states(df: DataFrame) -> DataFrame:
    """What each statement does to its owner's current states, in time. Rows of an owner pass one after another and only the active
    states are held."""
    rows = statements(df.filter("owner_id is not null"))
    return rows.repartition("owner_id").sortWithinPartitions("owner_id", "at", "statement_id").mapInArrow(_replay, ACTIONS)


def contradiction_targets(verdicts: DataFrame, model: DataFrame, names: DataFrame) -> DataFrame:
    """(verdict_id, entry_id, fragment_id, why): active entries that a contradicted episode touches, by a source fragment that both have
    or by an entity named in it, however many there are; evidence comes from the verdict's first fragment. Verdicts are (owner_id,
    verdict_id, content, fragment_ids), model rows (owner_id, entry_id, content, status, fragment_ids, entity_ids), names (entity_id, term)."""
    live = model.filter("status = 'active'")
    first = verdicts.select("verdict_id", F.get("fragment_ids", F.lit(0)).alias("fragment_id"))
    mine = verdicts.select("owner_id", "verdict_id", F.explode(F.array_distinct("fragment_ids")).alias("f"))
    theirs = live.select("owner_id", "entry_id", F.explode(F.array_distinct("fragment_ids")).alias("f"))
    shared = mine.join(theirs, ["owner_id", "f"]).select("verdict_id", "entry_id").distinct().withColumn("why", F.lit("fragment"))
    named = mention_join(verdicts.select(F.col("verdict_id").alias("text_id"), "content"), names).select(F.col("text_id").alias("verdict_id"), "entity_id").distinct()
    named = named.join(verdicts.select("verdict_id", "owner_id"), "verdict_id")
    said = mention_join(live.select(F.col("entry_id").alias("text_id"), "content"), names).select(F.col("text_id").alias("entry_id"), "entity_id")
    about = live.select("entry_id", F.explode(F.array_distinct("entity_ids")).alias("entity_id")).unionByName(said).distinct().join(live.select("entry_id", "owner_id"), "entry_id")
    hit = named.join(about, ["owner_id", "entity_id"]).select("verdict_id", "entry_id").withColumn("why", F.lit("entity"))
    both = shared.unionByName(hit).groupBy("verdict_id", "entry_id").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why"))
    return both.join(first, "verdict_id").filter("fragment_id is not null")


def maintain_patterns(patterns: DataFrame, matches: DataFrame) -> DataFrame:
    """Patterns after their matches (pattern_id, fragment_id, day, negated, drifted): a negated one counts as a contradiction, one that
    has drifted supersedes the pattern, any other is evidence and makes it active; the last of those two says which."""
    kind = F.when(F.col("negated"), "contradiction").when(F.col("drifted"), "drift").otherwise("evidence")
    m = matches.select("pattern_id", "fragment_id", "day", kind.alias("kind"))
    own = F.struct("day", "fragment_id")
    g = m.groupBy("pattern_id").agg(
        F.count_if(F.col("kind") == "contradiction").alias("_no"),
        F.max_by("kind", F.when(F.col("kind") != "contradiction", own)).alias("_last"),
        F.max("day").alias("_seen"),
        F.min(F.when(F.col("kind") == "evidence", F.col("day"))).alias("_first"),
        F.max(F.when(F.col("kind") == "evidence", F.col("day"))).alias("_until"),
        F.countDistinct(F.when(F.col("kind") == "evidence", F.col("fragment_id"))).alias("_new"),
    )
    out = patterns.join(g, "pattern_id", "left")
    count = F.col("evidence_count") + F.coalesce("_new", F.lit(0))
    begin, end = F.least("first_seen", "_first"), F.greatest("last_seen", "_until")
    has = F.coalesce(F.col("_new") > 0, F.lit(False))
    status = F.when(F.col("_last") == "evidence", "active").when(F.col("_last") == "drift", "superseded").otherwise(F.col("status"))
    return out.withColumns(
        {
            "contradiction_count": F.col("contradiction_count") + F.coalesce("_no", F.lit(0)),
            "confidence": F.when(has, s.pattern_confidence(count, F.datediff(end, begin))).otherwise(F.col("confidence")),
            "evidence_count": count,
            "first_seen": F.when(has, begin).otherwise(F.col("first_seen")),
            "last_seen": F.greatest("last_seen", "_seen"),
            "status": F.when(F.col("_last").isNull(), F.col("status")).otherwise(status),
        }
    ).drop("_no", "_last", "_seen", "_first", "_until", "_new")


def profile_integration(model: DataFrame, integrated: DataFrame) -> DataFrame:
    """(entry_id, category, tier, decision) of the active candidates with a diversity of 2 and a confidence of 0.55 that aren't
    ``integrated`` yet: rejected (locked category, too little diversity, nothing to refine), evidence (refines what a stable category
    has) or integrated. Model rows are (owner_id, entry_id, status, tags, source_diversity, confidence)."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    category = F.coalesce(F.get(F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.array_contains(tags, c)), F.lit(0)), F.lit("other"))
    tier, least, free = F.lit("low"), F.lit(1), F.lit(True)
    for name, (categories, diversity, create) in TIERS.items():
        of = F.col("category").isin(*categories)
        tier, least, free = F.when(of, name).otherwise(tier), F.when(of, F.lit(diversity)).otherwise(least), F.when(of, F.lit(create)).otherwise(free)
    active = model.filter("status = 'active'")
    may = active.filter("source_diversity >= 2 and confidence >= 0.55").join(integrated.select("entry_id"), "entry_id", "left_anti")
    may = may.withColumn("category", category).withColumns({"tier": tier, "_least": least.cast("int"), "_free": free})
    filled = active.select("owner_id", F.explode(F.array_distinct(tags)).alias("category")).groupBy("owner_id", "category").agg(F.count(F.lit(1)).alias("_n"))
    out = may.join(filled, ["owner_id", "category"], "left")
    others = F.coalesce("_n", F.lit(0)) - F.array_contains(tags, F.col("category")).cast("int")
    decision = (
        F.when(F.col("tier") == "locked", "rejected:locked")
        .when(F.col("source_diversity") < F.col("_least"), "rejected:diversity")
        .when(~F.col("_free") & (others > 0), "evidence")
        .when(~F.col("_free"), "rejected:nothing_to_refine")
        .otherwise("integrated")
    )
    return out.select("entry_id", "category", "tier", decision.alias("decision"))


def seed_model(monitors: DataFrame, relations: DataFrame, model: DataFrame) -> DataFrame:
    """(owner_id, type, content, confidence, quality, origin) for owners whose model is empty: verified monitors (0.7) become traits,
    active hypotheses stay such, stated relationships become facts and others traits. Public and fictional figures are left out."""
    text = F.coalesce(F.nullif("evaluation", F.lit("")), F.nullif("analysis", F.lit("")), F.col("trigger"))
    trait = (F.col("kind") == "monitor") & (F.col("status") == "verified") & (F.col("confidence") >= 0.7)
    guess = (F.col("kind") == "hypothesis") & (F.col("status") == "active")
    content = F.when(trait, text).when(guess, F.coalesce(F.nullif("analysis", F.lit("")), F.col("trigger")))
    own = monitors.filter(trait | guess).select(
        "owner_id", F.when(trait, "stable_trait").otherwise("active_hypothesis").alias("type"), content.alias("content"), "confidence", F.lit("inferred").alias("quality"), F.lit("monitor").alias("origin")
    ).filter(F.length("content") > 5)
    level = F.lower("confidence")
    sure = F.when(level == "high", 0.85).when(level == "medium", 0.6).when(level == "low", 0.4).otherwise(F.coalesce(F.try_to_number("confidence", F.lit("9.99")).cast("double"), F.lit(0.5)))
    real = ~F.coalesce(F.col("entity_type"), F.lit("")).isin("fictional", "public_figure") & ~F.col("relation").rlike("虛構|文學角色|作品中的人物|並無實際人際|而非現實人物|虚构|文学角色|并无实际人际|而非现实人物|欣赏其.*作品|欣賞其.*作品")
    known = relations.filter((F.coalesce("relation", F.lit("")) != "") & real).withColumn("_c", sure).select(
        "owner_id", F.when(F.col("_c") >= 0.85, "immutable_fact").otherwise("stable_trait").alias("type"), F.concat("name", F.lit(": "), "relation").alias("content"), F.greatest(F.lit(0.5), "_c").alias("confidence"),
        F.when(F.col("_c") >= 0.85, "direct_statement").otherwise("inferred").alias("quality"), F.lit("relation").alias("origin"),
    )
    return own.unionByName(known).withColumn("content", F.substring("content", 1, 200)).join(model.select("owner_id").distinct(), "owner_id", "left_anti")


def apply_edits(target: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table after a user's edits, corrections). Edits are (edit_id, op, key, columns): of several to one row the last counts; a
    null column of an update keeps the old value; updates and deletes of rows that aren't there do nothing, nor does creating one that
    is. A deletion leaves the row with status deleted and logs a correction with what it said."""
    last = edits.groupBy(key).agg(F.max_by(F.struct("op", *columns), "edit_id").alias("_e"))
    both = target.join(last, key, "left")
    op = F.col("_e.op")
    changed = both.withColumns({c: F.when(op == "update", F.coalesce(F.col(f"_e.{c}"), F.col(c))).otherwise(F.col(c)) for c in columns})
    changed = changed.withColumn("status", F.when(op == "delete", "deleted").otherwise(F.col("status"))).drop("_e")
    new = last.filter("_e.op = 'create'").join(target.select(key), key, "left_anti").select(key, *[F.col(f"_e.{c}").alias(c) for c in columns], F.lit("active").alias("status"))
    gone = both.filter((op == "delete") & (F.col("status") != "deleted")).select(key, F.col("content").alias("wrong"), F.lit("user_deleted").alias("reason"))
    return changed.unionByName(new, True), gone
