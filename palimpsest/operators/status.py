"""Status reports, entity subcategories and helpers for columns that hold JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a relationship and the subcategory that they make, the first that fits.
RELATIONS = [
    ("family", "母親 父親 媽媽 爸爸 女兒 兒子 家人 親戚 家屬 母亲 父亲 妈妈 女儿 儿子 亲戚 家属".split()),
    ("friend", "朋友 好友 閨蜜 死黨 夥伴 闺蜜 死党 伙伴".split()),
    ("online", "網友 線上 群友 小紅書.*認識 网友 线上 小红书.*认识".split()),
]
#: The galaxy of each category.
GALAXIES = {
    "社交": ["person", "pet", "organization"],
    "地點": ["place"],
    "事件": ["event"],
    "創作": ["project", "work", "term"],
    "愛好": ["hobby", "consumed", "object", "music_aggregate", "book_aggregate", "movie_aggregate"],
}


def subcategory(category: Column, entity_type: Column, relation: Column) -> Column:
    """Pets are pets; people by their type, then by words of their relationship to the user; null where nothing says."""
    text = F.lower(F.coalesce(relation, F.lit("")))
    by_word = F.lit(None).cast("string")
    for name, words in reversed(RELATIONS):
        by_word = F.when(text.rlike("|".join(words)), name).otherwise(by_word)
    person = F.when(entity_type == "public_figure", "celebrity").when(entity_type == "fictional_character", "fictional").otherwise(by_word)
    return F.when(category == "pet", "pet").when(category == "person", person)


def galaxy(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, categories in GALAXIES.items():
        out = F.when(category.isin(*categories), name).otherwise(out)
    return out


def json_list(text: Column) -> Column:
    """The elements of a JSON array as strings, objects as JSON; an empty array for anything else."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_ids(text: Column) -> Column:
    """Distinct positive whole numbers of a JSON array of numbers, their texts, and objects with an id; others are left out."""
    inner = F.transform(json_list(text), lambda x: F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.id")).otherwise(F.trim(x)))
    whole = F.transform(inner, lambda x: F.when(x.rlike(r"^\d{1,15}(\.0+)?$"), x.cast("double").cast("long")))
    return F.array_distinct(F.filter(whole, lambda x: x > 0))


def pipeline_status(fragments: DataFrame, entities: DataFrame, model: DataFrame, runs: DataFrame, tags: list[str]) -> DataFrame:
    """One row: active fragments, those with each value tag, entities and seeds, model rows, traits and states, and the end of the last
    finished run."""
    f = fragments.filter("status = 'active'").agg(F.count(F.lit(1)).alias("fragments"), *[F.count_if(F.array_contains("value_tags", g)).alias(g) for g in tags])
    e = entities.filter("status in ('active', 'seed')").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("status") == "seed").alias("seeds"))
    m = model.filter("status = 'active'").agg(F.count(F.lit(1)).alias("model_rows"), F.count_if(F.col("type") == "stable_trait").alias("traits"), F.count_if(F.col("type") == "current_state").alias("states"))
    r = runs.filter("status = 'done'").agg(F.max("processed_until").alias("last_run"))
    return f.join(e).join(m).join(r)  # one row each


def baseline_status(baselines: DataFrame, last: DataFrame, least: int) -> DataFrame:
    """For each owner and dimension: the overall level, the level of each slot as a map, samples, whether it still learns, and the last
    observation (owner_id, dim, y, t)."""
    slots = F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "mu"))))
    b = baselines.groupBy("owner_id", "dim").agg(F.max("overall").alias("baseline"), F.sum("n").alias("samples"), slots.alias("slots"))
    newest = last.groupBy("owner_id", "dim").agg(F.max_by("y", "t").alias("state"), F.max("t").alias("state_at"))
    return b.join(newest, ["owner_id", "dim"], "left").withColumn("learning", F.col("samples") < least)
