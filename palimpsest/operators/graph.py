"""Connected components and what is built on them: clusters, sagas, merge survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import settle


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach. Each round takes the neighbours' smallest label and then the
    label's own label, so chains shorten by half."""
    both = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    now = settle(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = settle(now.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("low"), "component"))
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("next"))
        new = settle(low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("next", "low")).alias("component"), F.col("component").alias("before")))
        changed = not new.filter("component < before").isEmpty()
        now = new.select("id", "component")
        if not changed:
            return now


def clusters(nodes: DataFrame, pairs: DataFrame, cap: int = 20) -> DataFrame:
    """Components of two or more, the newest ``cap`` members of each (largest ids first)."""
    c = components(nodes, pairs)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("id"))).cast("long")
    return c.join(size, "component").withColumn("rank", rank).filter(F.col("rank") <= cap)


def build_episodes(members: DataFrame, significance: str = "significance", least: int = 3) -> DataFrame:
    """Episodes of clusters (cluster, fragment_id, emotional_weight, significance): weight is
    min(10, round(0.7 significance + 0.3 (5 + 3 mean weight)))."""
    g = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.avg("emotional_weight").alias("mean"), F.max(significance).alias("sig"), F.min("fragment_id").alias("first"))
    weight = F.least(F.lit(10.0), F.round(0.7 * F.col("sig") + 0.3 * (5 + 3 * F.col("mean"))))
    return g.filter((F.col("members") >= least) & (F.col("sig") >= 4)).withColumn("weight", weight)


def upsert_sagas(sagas: DataFrame) -> DataFrame:
    """Sagas of the same normalised title become one with all members: (title, members) to (title_key, members, n)."""
    from ..functions import text as t

    flat = sagas.select(t.normalise(F.col("title")).alias("title_key"), F.explode("members").alias("member")).distinct()
    return flat.groupBy("title_key").agg(F.array_sort(F.collect_list("member")).alias("members"), F.count(F.lit(1)).alias("n"))
