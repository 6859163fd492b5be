"""Exact dedup: a persistent digest index, bucketed and sorted by digest; new data is anti-joined to it and appended.

Texts are equal when identical after white space is deleted. Of equal texts the row with the longest original text stays,
then the smallest doc_id. Null texts count as empty, and all empty texts are equal. A null doc_id loses every tie. Exactly one row
of a group stays, whatever ids its rows have: of rows alike in all of this, any one. Extra columns are ignored.

The index is a few tables, its parts, each with the digests of one batch; every bucket of a part is one sorted file. A batch is
brought to the index's buckets and merged with each part, which is neither shuffled nor sorted. Parts that have become too many are
merged into one. The tables lie in spark.sql.warehouse.dir, which all executors have to share.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, materialize, with_columns

#: Parts of an index before they are merged into one.
PARTS = 8
_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, the named keys (longs), n_chars of the original text, digest (SHA-256 of the text without white space)."""
    text = F.coalesce("text", F.lit(""))
    return with_columns(docs, ("doc_id", "long"), *[(k, "long") for k in keys], ("text", "string")).select(
        "doc_id", *keys, F.length(text).cast("long").alias("n_chars"), F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)).alias("digest")
    )


def groups(prints: DataFrame) -> DataFrame:
    """One row per digest: keep_id, keep_chars, keep_row, group_size. Summed on the map side, so a hot digest shuffles one row per
    task. ``prints`` has a key of each row in ``row``."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), "row"))
    return prints.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_chars"), F.col("best.row").alias("keep_row"), "group_size"
    )


class DigestIndex:
    """Digests with the number of rows (group_size) over all batches and each batch's own candidate to stay (keep_id, keep_chars, keep_row).

    A part is a table whose name has the numbers of the batches in it, the first and the last, and a batch's own name; a part that
    lies within another's numbers was merged into that one and no longer counts, so that a merge takes effect at once, whether or not the old parts
    are gone. ``buckets``: of a new index; by default as many as the session has shuffle partitions, so that no join wants more of them.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None) -> None:
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = self.parts()
        if parts:
            about = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {parts[0]}").collect()}
            self.buckets = int(about["Num Buckets"])

    def _numbers(self, part: str) -> tuple[int, int]:
        return tuple(int(x) for x in part.rpartition("_part_")[2].split("_")[:2])

    def _tables(self) -> list[str]:
        home, _, last = self.name.rpartition(".")
        names = self.spark.sql(f"SHOW TABLES {f'IN {home} ' if home else ''}LIKE '{last}_part_*'").collect()
        return sorted((f"{home}.{r.tableName}" if home else r.tableName for r in names), key=lambda n: (*self._numbers(n), n))

    def parts(self) -> list[str]:
        """Names of the tables that make the index, oldest first."""
        every = self._tables()
        wider = lambda a, b: a[0] <= b[0] and b[1] <= a[1] and a != b
        return [p for p in every if not any(wider(self._numbers(q), self._numbers(p)) for q in every)]

    def exists(self) -> bool:
        return bool(self.parts())

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(p).withColumn("part", F.lit(i)) for i, p in enumerate(self.parts())])

    def table(self) -> DataFrame:
        """All digests, one row each, with what was kept first."""
        first = F.min(F.struct("part", "keep_id", "keep_chars", "keep_row")).alias("first")
        return self._all().groupBy("digest").agg(first, F.sum("group_size").alias("group_size")).select("digest", "first.keep_id", "first.keep_chars", "first.keep_row", "group_size")

    def best(self) -> DataFrame:
        """All digests, one row each, with the best candidate of all batches."""
        best = F.min(F.struct((-F.col("keep_chars")).alias("n"), F.col("keep_id").isNull().alias("none"), "keep_id", "keep_row")).alias("best")
        return self._all().groupBy("digest").agg(best, F.sum("group_size").alias("group_size")).select(
            "digest", "best.keep_id", (-F.col("best.n")).alias("keep_chars"), "best.keep_row", "group_size"
        )

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Spark takes the order of one-file buckets for granted only where it is told to."""
        before = self.spark.conf.get(_ORDER, "false")
        self.spark.conf.set(_ORDER, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_ORDER, before)

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The digests of ``batch`` that no part has: merge anti-joins."""
        out = self._bucketed(batch)
        for part in self.parts():
            out = out.hint("merge").join(self.spark.table(part).select("digest"), "digest", "left_anti")
        return out

    def _bucketed(self, batch: DataFrame) -> DataFrame:
        same = self.buckets == int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return batch if same else batch.repartition(self.buckets, "digest")

    def _known(self, batch: DataFrame) -> DataFrame:
        """(digest, keep_id, keep_chars, before) of the digests of ``batch`` that some part has."""
        met = [self._bucketed(batch).hint("merge").join(self.spark.table(p), "digest").withColumn("part", F.lit(i)) for i, p in enumerate(self.parts())]
        first = F.min(F.struct("part", "keep_id", "keep_chars")).alias("first")
        found = reduce(DataFrame.unionByName, met).groupBy("digest").agg(first, F.sum("group_size").alias("before"))
        return found.select("digest", "first.keep_id", "first.keep_chars", "before")

    def append(self, prints: DataFrame, batch: str | None = None) -> DataFrame:
        """Add a batch; return an entry for each of its digests: keep_id, keep_row (null: an earlier batch's row stays), group_size
        over all batches, size in this one. What was kept earlier stays. A batch of a name that the index has takes that one's place,
        as long as it wasn't merged."""
        mark = hashlib.md5((batch or uuid.uuid4().hex).encode()).hexdigest()[:16]
        for part in [p for p in self._tables() if p.rpartition("_part_")[2].split("_")[2] == mark]:
            if part not in self.parts():
                raise ValueError(f"the batch {batch} is merged already")
            self.spark.sql(f"DROP TABLE {part}")
        new = materialize(groups(prints))
        if not self.exists():
            self._write(new, mark)
            return new.withColumn("size", F.col("group_size"))
        with self._in_order():
            entries = materialize(self.unknown(new)).withColumn("size", F.col("group_size"))
            again = new.join(entries.select("digest"), "digest", "left_anti").select("digest", F.col("group_size").alias("size"))
            known = self._known(materialize(again)).join(again, "digest")
            known = known.withColumns({"keep_row": F.lit(None).cast("long"), "group_size": F.col("before") + F.col("size")}).drop("before")
            entries = materialize(entries.unionByName(known))
        self._write(new, mark)
        if len(self.parts()) > PARTS:
            self.compact()
        return entries

    def _write(self, entries: DataFrame, mark: str, numbers: tuple[int, int] | None = None) -> str:
        after = max((self._numbers(p)[1] for p in self._tables()), default=-1) + 1
        first, last = numbers or (after, after)
        # a name of its own for each attempt: what a failed one left behind isn't in the way
        name = f"{self.name}_part_{first}_{last}_{mark}_{uuid.uuid4().hex[:8]}"
        # one task and so one file for each bucket
        whole = entries.select("digest", "keep_id", "keep_chars", "keep_row", "group_size").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        whole.write.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
        return name

    def compact(self) -> None:
        """Merge all parts into one."""
        old = self.parts()
        if len(old) > 1:
            self._write(self.table(), "merged", (self._numbers(old[0])[0], self._numbers(old[-1])[1]))
        for part in [p for p in self._tables() if p not in self.parts()]:
            self.spark.sql(f"DROP TABLE {part}")

    def drop(self) -> None:
        for part in self._tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {part}")


def dedup(docs: DataFrame, index: DigestIndex | None = None, keys: tuple[str, ...] = (), batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the named keys (longs), keep_id, group_size, kept, text_sha256, by the index after
    ``docs`` was added to it.

    Without ``index`` one is made, the rows are added to it in two batches, the better candidate of the two stays, and the index is dropped
    again. With an index that has earlier batches, rows whose text it knows are not kept and name the earlier document, and group_size
    counts all batches; a batch that is added again under its name ``batch`` gives the same rows again.
    """
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, *keys).withColumn("row", F.monotonically_increasing_id()))
    if index is not None:
        entries = index.append(prints, batch)
    else:
        own = DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
        try:
            for half in range(2):
                own.append(prints.filter(F.pmod(F.xxhash64("row"), F.lit(2)) == half), f"half {half}")
            entries = materialize(own.best().withColumn("size", F.col("group_size")))
        finally:
            own.drop()
    out = join_by_key(prints, entries, "digest", "size")
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
    return out.select("doc_id", *keys, "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))
