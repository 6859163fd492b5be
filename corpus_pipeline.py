"""A corpus pipeline: documents are classified, deduplicated exactly and nearly, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the rows that they keep with the
columns of documents. The two dedup stages and decontamination tell rows apart by a key that they write with their input, as a doc_id may be
null or repeated; the key's name is none that the input has. Of columns whose names differ in case alone, which no table can hold, the one
of the documents' own name stays, else the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, exact_dedup, jaccard, packing, quality
from palimpsest.llm.common import materialize, table


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` without columns that only case tells from another."""
    names = docs.columns
    if len({n.lower() for n in names}) == len(names):
        return docs
    first = {}
    for i, n in enumerate(names):
        if n.lower() not in first or n in COLUMNS and names[first[n.lower()]] not in COLUMNS:
            first[n.lower()] = i
    # by place, as names don't tell them apart
    placed = docs.toDF(*[f"_{i}" for i in range(len(names))])
    return placed.select(*[F.col(f"_{i}").alias(names[i]) for i in sorted(first.values())])


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {n.lower() for n in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, written so that it stays the same; and the key's name."""
    key = _fresh(docs, "_row")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id())), key


def _as_ids(rows: DataFrame, key: str) -> DataFrame:
    """The texts with the rows' keys for ids."""
    return rows.select(F.col(key).alias("doc_id"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labels of the documents that it may learn from."""
    docs = _plain(docs)
    texts, name = docs.select("doc_id", F.col("text").cast("string").alias("text")), _fresh(docs, "_quality")
    model = quality.fit(texts, table(spark, sf_dir, "labels"), "quality", quality.remainder("doc_id", 3) != 1)
    return quality.score(docs, model, docs.columns, name).filter(F.col(name) >= 0.5).drop(name)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id."""
    docs = _plain(docs)
    rows, key = _keyed(docs)
    # the operator breaks ties by doc_id; the rows' keys come back with its result
    ids = rows.select("doc_id", "text", F.col(key).alias("row_key"))
    kept = exact_dedup.dedup(ids, keys=("row_key",)).filter("kept").select(F.col("row_key").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of all that links of similarity 0.8 or more connect. A null doc_id loses every tie."""
    docs = _plain(docs)
    rows, key = _keyed(docs)
    groups = materialize(jaccard.join(_as_ids(rows, key)).select(F.col("doc_id").alias("row_key"), "group_id"))
    own = rows.select(F.col(key).alias("row_key"), "doc_id").join(groups, "row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"]
    kept = own.groupBy("group_id").agg(first.alias(key)).select(key)
    return rows.join(kept, key, "left_semi").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    docs = _plain(docs)
    rows, key = _keyed(docs)
    found = decontaminate.decontaminate(_as_ids(rows, key), table(spark, sf_dir, "benchmark"))
    bad = materialize(found.filter("contaminated").select(F.col("doc_id").alias(key)))
    return rows.join(bad, key, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces with their bins."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    last = STAGES[-1][1]
    docs = reduce(lambda d, stage: materialize(stage[1](spark, d, sf_dir)), STAGES[:-1], table(spark, sf_dir, "documents"))
    return last(spark, docs, sf_dir)


#: The classifier and the join by chosen paths can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None
