"""Memory tables derived from the given tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import sound_unions

#: 2024-01-01 00:00:00 and 2024-02-01 00:00:00 UTC, in seconds: the start of all derived times, and "now".
START, NOW = 1704067200, 1706745600


def now():
    return F.timestamp_seconds(F.lit(NOW))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("owner_id"),
        F.col("conv_id").alias("chat_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"),
        F.when(F.col("role") == "user", "user").otherwise("ai").alias("sender"),
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 10).alias("ts"),
        "role",
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    created = F.timestamp_seconds(F.lit(START) + (i % 30) * 86400)
    status = F.when(i % 5 == 2, "cooling").when(i % 5 == 3, "frozen").otherwise("active")
    return d.select(
        i.alias("fragment_id"), (i % 50).alias("owner_id"), F.col("source").alias("entity"), F.col("lang").alias("type"), F.col("text").alias("content"), "source",
        ((i % 10) / F.lit(10.0)).alias("emotional_weight"), created.alias("created_at"), F.timestamp_seconds(F.lit(START) + (i % 30) * 86400 + (i % 7) * 43200).alias("lifecycle_updated_at"),
        (i % 7).alias("read_count"), (i % 4).alias("cited_count"), (i % 6).alias("injected_count"), status.alias("status"), (F.lit(0.5) + (i % 5) / F.lit(10.0)).alias("confidence"),
        (F.lit(1) + i % 3).alias("evidence_count"), "quality", "toxic",
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = read(spark, sf_dir, "nation"), read(spark, sf_dir, "documents")
    key = F.col("n_nationkey").cast("long")
    status = F.when(key % 4 == 2, "seed").when(key % 4 == 3, "dormant").otherwise("active")
    places = n.select((key + 100).alias("entity_id"), F.col("n_name").alias("name"), F.lit("place").alias("category"), status.alias("status"))
    number = F.substring("source", 4, 9).cast("long")
    sources = d.select("source").distinct().filter(F.col("source").startswith("src")).select(number.alias("entity_id"), F.col("source").alias("name"), F.lit("source").alias("category"), F.lit("active").alias("status"))
    return places.unionByName(sources).withColumn("created_at", F.timestamp_seconds(F.lit(START) + (F.col("entity_id") % 20) * 86400))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    i = F.col("doc_id")
    own = d.filter(F.col("source").startswith("src")).select(i.alias("fragment_id"), F.substring("source", 4, 9).cast("long").alias("entity_id"), (F.lit(0.5) + (i % 5) / F.lit(10.0)).alias("confidence"))
    more = d.filter(i % 3 == 0).select(i.alias("fragment_id"), (F.lit(100) + i % 25).cast("long").alias("entity_id"), F.lit(0.4).alias("confidence"))
    return own.unionByName(more).withColumn("created_at", F.timestamp_seconds(F.lit(START) + (F.col("fragment_id") % 30 + 1) * 86400))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fragment_id"), "embedding", "label")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("obs_id"), F.col("user_id").alias("owner_id"), F.col("event_type").alias("dim"), F.least(F.lit(1.0), F.col("value") / 150).alias("y"), F.col("ts").cast("timestamp").alias("t"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 50).alias("owner_id"), F.col("text").alias("query"))


SQL = {
    "messages": f"""SELECT conv_id AS owner_id, conv_id AS chat_id, conv_id*1000+turn AS msg_id, CASE WHEN role='user' THEN 'user' ELSE 'ai' END AS sender,
        text AS content, make_timestamp(({START}+conv_id*3600+turn*10)*1000000) AS ts, role FROM conversations""",
    "fragments": f"""SELECT d.doc_id AS fragment_id, d.doc_id%50 AS owner_id, source AS entity, lang AS type, text AS content, source, (d.doc_id%10)/10.0::DOUBLE AS emotional_weight,
        make_timestamp(({START}+(d.doc_id%30)*86400)*1000000) AS created_at, make_timestamp(({START}+(d.doc_id%30)*86400+(d.doc_id%7)*43200)*1000000) AS lifecycle_updated_at,
        d.doc_id%7 AS read_count, d.doc_id%4 AS cited_count, d.doc_id%6 AS injected_count, CASE d.doc_id%5 WHEN 2 THEN 'cooling' WHEN 3 THEN 'frozen' ELSE 'active' END AS status,
        0.5::DOUBLE+(d.doc_id%5)/10.0::DOUBLE AS confidence, 1+d.doc_id%3 AS evidence_count, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "entities": f"""SELECT *, make_timestamp(({START}+(entity_id%20)*86400)*1000000) AS created_at FROM (
        SELECT n_nationkey::BIGINT+100 AS entity_id, n_name AS name, 'place' AS category, CASE n_nationkey%4 WHEN 2 THEN 'seed' WHEN 3 THEN 'dormant' ELSE 'active' END AS status FROM nation
        UNION ALL SELECT DISTINCT substr(source,4,9)::BIGINT, source, 'source', 'active' FROM documents WHERE source LIKE 'src%')""",
    "links": f"""SELECT *, make_timestamp(({START}+(fragment_id%30+1)*86400)*1000000) AS created_at FROM (
        SELECT doc_id AS fragment_id, substr(source,4,9)::BIGINT AS entity_id, 0.5::DOUBLE+(doc_id%5)/10.0::DOUBLE AS confidence FROM documents WHERE source LIKE 'src%'
        UNION ALL SELECT doc_id, 100+doc_id%25, 0.4::DOUBLE FROM documents WHERE doc_id%3=0)""",
    "vectors": "SELECT vec_id AS fragment_id, embedding, label FROM embeddings",
    "observations": "SELECT event_id AS obs_id, user_id AS owner_id, event_type AS dim, least(1.0::DOUBLE, value/150) AS y, ts::TIMESTAMP AS t FROM events",
    "questions": "SELECT item_id AS query_id, item_id%50 AS owner_id, text AS query FROM benchmark",
}


def sql(tables: str, body: str, **ctes: str) -> str:
    """WITH the named derived tables and further common table expressions, the body."""
    parts = [f"{t} AS ({SQL[t]})" for t in tables.split()] + [f"{name} AS ({text})" for name, text in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
