"""What several operators of this subpackage share: scratch tables, skew-safe joins, ranks, fixed-size bit filters."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, *types: tuple[str, str]) -> DataFrame:
    """Only the named columns, cast; a column that is missing is null. Of columns that differ in case alone, the one of the exact name
    is taken."""
    names, wanted = df.columns, {c for c, _ in types}
    if len({n.lower() for n in names}) < len(names):
        # columns are told apart by place, as names don't do it
        df = df.toDF(*[n if n in wanted and n not in names[:i] else f"_{i}" for i, n in enumerate(names)])
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets a temporary one; on a
    cluster it has to be set."""
    # Spark 4.1 may group a union of inputs dealt by the same key without dealing it anew, though their partitions were merged differently
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clear() -> None:
    for spark, path in _SCRATCH:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # the session has ended already
            return
    _SCRATCH.clear()


atexit.register(_clear)


def lean(step):
    """``step`` of mapInArrow whose task gives its free memory back at its end: a Python worker outlives its tasks, and others wait
    beside it."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def words_lower(text: Column) -> Column:
    """Lower-cased text whose ASCII letters are those of the original's A-Z and a-z alone.

    ``lower`` also maps the Kelvin sign and the dotted capital I to ASCII letters; these two become private-use characters first.
    """
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001")))


#: Words of the lower-cased text: ASCII digits and letters and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A key with at least this share of the rows is hot; there are at most as many hot keys as its inverse.
HOT_SHARE = 1 / 1000


def join_by_key(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` join ``groups`` on ``key``; ``groups`` has one row per key, with the number of rows in column ``size``.

    Keys with at least HOT_SHARE of all rows, a thousand at most, are broadcast; the others meet in a shuffle join.
    Both inputs are read twice and should be materialised.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) >= max(2.0, total * HOT_SHARE))
    names = hot.select(F.col(key).alias("_hot"))
    cold_rows = rows.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left_anti")
    cold = cold_rows.join(groups.filter(F.col(size) < max(2.0, total * HOT_SHARE)), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key).select(cold.columns))


def bits(keys: DataFrame, key: str, log2_bits: int) -> bytes:
    """A fixed-size two-probe bit filter of the 64-bit keys: 2**log2_bits bits, whatever the number of keys."""
    mask = (1 << log2_bits) - 1
    probes = keys.select(F.explode(F.array(F.col(key).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 64 - log2_bits))).alias("b"))
    words = probes.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    import numpy as np

    out = np.zeros(1 << (log2_bits - 6), np.int64)
    for at in words.toLocalIterator():
        out[at.w] = at.v
    return out.tobytes()


def in_bits(filter_words, hashes, log2_bits: int):
    """Which of the uint64 hashes may be in the filter made by ``bits`` (numpy, inside tasks)."""
    import numpy as np

    low, high = hashes & np.uint64((1 << log2_bits) - 1), hashes >> np.uint64(64 - log2_bits)
    one, six = np.uint64(63), np.uint64(6)
    test = lambda b: (filter_words[(b >> six).astype(np.int64)] >> (b & one)) & np.uint64(1)
    return (test(low) & test(high)).astype(bool)


def ranks(rows: DataFrame, key: Column, salt: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within ``key``, counted in salted parts so that no task holds all rows of a hot key.

    ``salt`` is an int that depends on the row alone. One row per (key, salt) is summed in between.
    """
    parted = rows.withColumn("_key", key).withColumn("_salt", salt)
    within = Window.partitionBy("_key", "_salt")
    before = Window.partitionBy("_key").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("_key", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(F.col("_key").alias("_k"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = parted.withColumn("_in", F.row_number().over(within.orderBy(*order)))
    joined = ranked.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_key", "_salt", "_in", "_k", "_s", "_start")


def keep_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (one column, doc_id, each id once), one row per id."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])


