"""A standing full-text index: postings in blocks with score bounds, grown and shrunk by batches, searched for the best k by BM25.

Documents of an owner are dealt into cells of about CELL documents of similar length. A row of ``blocks`` holds one token's postings in one
cell, with their number, highest frequency and shortest document, from which the best score that they can give follows whatever the
statistics are by then. As all of a document's postings lie in its cell, the sum of a query's bounds in a cell is a bound for its documents: a
search scores the few cells of the highest bounds first, and then those alone that may still beat the k-th score found.

Every change is a batch of a number of its own, higher than those before. Its blocks and removals are written first and its statistics
last, which is what commits it: a batch that failed half-way isn't seen, and a batch written again takes its own place. Blocks are bucketed
by owner and cell, as documents are dealt when they are gathered and cells when they are scored: no posting is shuffled for either.

Rows of null owners or ids are left out. Removed documents are handed in with their texts, as their tokens' counts go down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from .recall import exploded, top_n
from .tables import settle

#: Documents of a cell, about; length classes for each doubling.
CELL, CLASSES = 64, 4
#: Scores are rounded to six places: less than this apart, two may be equal.
ROUNDING = 1e-6
#: Characters of a task's documents, about, where their words are counted.
TASK_CHARS = 1 << 24

BLOCK = "owner_id long, token string, cell string, n int, max_tf int, min_dl int, posts array<struct<id:bigint,tf:int,dl:int>>, batch long"
COMMIT = "owner_id long, n long, dl long, removes boolean, replaces array<bigint>, batch long"


class Postings:
    """The index in the folder ``path``, which all executors share. It is made with the first batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        known = [int(s.getPath().getName().rpartition("_")[2]) for s in _listed(spark, self.path) if s.getPath().getName().startswith("blocks_")]
        self.buckets = known[0] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"postings_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({BLOCK}) USING parquet OPTIONS (path '{self.path}/blocks_{self.buckets}') "
            f"PARTITIONED BY (batch) CLUSTERED BY (owner_id, cell) SORTED BY (owner_id, cell) INTO {self.buckets} BUCKETS"
        )

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """The statistics of all batches that count: an owner's documents and tokens, added or taken away."""
        rows = self._read("commits", COMMIT)
        replaced = rows.select(F.explode("replaces").alias("batch"))
        return rows.join(replaced, "batch", "left_anti")

    def batches(self) -> list[int]:
        """The numbers of the batches that count. They are merged by ``compact``."""
        return sorted(r.batch for r in self.commits().select("batch").distinct().collect())

    def blocks(self) -> DataFrame:
        batches = self.batches()
        if batches:  # those of other sessions too
            self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS {' '.join(f'PARTITION (batch = {b})' for b in batches)}")
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).filter(F.col("batch").isin(*batches))

    def _write(self, blocks: DataFrame, stats: Callable[[], DataFrame], batch: int, removes: bool = False, replaces: list[int] = ()) -> None:
        """The blocks of a batch, and then what commits it; ``stats`` may read the blocks that were written."""
        self._put(blocks, batch)
        some = stats().select(F.col("owner_id").cast("long").alias("owner_id"), F.col("n").cast("long").alias("n"), F.col("dl").cast("long").alias("dl"))
        # a batch without documents counts as well
        none = self.spark.createDataFrame([(None, 0, 0)], "owner_id long, n long, dl long")
        done = some.unionByName(none).withColumns({"removes": F.lit(removes), "replaces": F.lit(list(replaces)).cast("array<bigint>")})
        done.write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        self.spark.catalog.refreshTable(self.table)

    def _written(self, batches: list[int]) -> DataFrame:
        """The blocks of some batches, by folder, whether they are committed or not."""
        root = f"{self.path}/blocks_{self.buckets}"
        parts = [p for b in batches if _listed(self.spark, p := f"{root}/batch={b}")]
        return self.spark.read.schema(BLOCK).option("basePath", root).parquet(*parts) if parts else self.spark.createDataFrame([], BLOCK)

    def _dealt(self, blocks: DataFrame) -> DataFrame:
        """Each bucket is a task, and so one file."""
        return blocks.repartition(self.buckets, "owner_id", "cell")

    def _put(self, blocks: DataFrame, batch: int) -> None:
        """A batch's blocks, in place of those that it may have. They come dealt by the buckets' columns, so that a task writes one file."""
        dealt = blocks.select("owner_id", "token", "cell", "n", "max_tf", "min_dl", "posts")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {int(batch)}) SELECT * FROM {{dealt}}", dealt=dealt)

    def _rows(self, docs: DataFrame, id_col: str, text_col: str, by: str, batch: int) -> DataFrame:
        """(owner_id, id, text, cell) of documents. The cells' numbers are settled, so that the texts aren't shuffled to meet few of them."""
        size = F.floor(F.log2(F.length(F.coalesce(text_col, F.lit(""))) + F.lit(1.0)) * CLASSES).cast("int")
        rows = docs.filter(F.col(by).isNotNull() & F.col(id_col).isNotNull())
        rows = rows.select(F.col(by).cast("long").alias("owner_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"), size.alias("_size"))
        slots = settle(rows.groupBy("owner_id", "_size").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("_slots")))
        slot = F.pmod(F.xxhash64("id"), F.col("_slots"))
        return rows.join(slots, ["owner_id", "_size"]).select("owner_id", "id", F.concat_ws("/", F.lit(batch), "_size", slot).alias("cell"), "_text")

    def append(self, docs: DataFrame, batch: int, id_col: str = "fragment_id", text_col: str = "content", by: str = "owner_id") -> None:
        """Add documents, of ids that the index doesn't hold or that an earlier batch has removed. A cell's documents go to one task, as
        texts, where their words are counted and gathered: no row for each word of a document is shuffled."""
        rows = self._rows(docs, id_col, text_col, by, batch)
        chars = docs.agg(F.sum(F.length(text_col)).alias("n")).first().n or 0
        tasks = self.buckets * -(-max(self.spark.sparkContext.defaultParallelism, chars // TASK_CHARS) // self.buckets)  # a task has one bucket's cells
        dealt = rows.repartition(tasks, "owner_id", "cell").select("owner_id", "cell", "id", F.array_join(t.index_tokens(F.col("_text")), " ").alias("words"))
        found = dealt.groupBy("owner_id", "cell").applyInArrow(_gathered, BLOCK.rpartition(", ")[0])
        n = rows.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))
        dl = lambda: self._written([batch]).groupBy("owner_id").agg(F.sum(F.aggregate("posts.tf", F.lit(0).cast("long"), lambda x, y: x + y)).alias("dl"))
        self._write(found, lambda: n.join(dl(), "owner_id", "left").withColumn("dl", F.coalesce("dl", F.lit(0))), batch)

    def remove(self, docs: DataFrame, batch: int, id_col: str = "fragment_id", text_col: str = "content", by: str = "owner_id") -> None:
        """Take documents of earlier batches away: their ids no longer count, nor do their tokens in the statistics."""
        rows = self._rows(docs, id_col, text_col, by, batch).withColumn("_ws", t.index_tokens(F.col("_text")))
        tokens = exploded(rows, ["owner_id", "id"], F.array_distinct("_ws"))
        less = tokens.groupBy("owner_id", "token").agg((-F.count(F.lit(1))).cast("int").alias("n"))
        nothing = {"max_tf": F.lit(0), "min_dl": F.lit(1), "posts": F.array().cast("array<struct<id:bigint,tf:int,dl:int>>")}
        stats = rows.groupBy("owner_id").agg((-F.count(F.lit(1))).alias("n"), (-F.sum(F.size("_ws"))).alias("dl"))
        rows.select("owner_id", "id").write.mode("overwrite").parquet(f"{self.path}/gone/batch={batch}")
        self._write(self._dealt(less.withColumn("cell", F.lit(f"{batch}/gone")).withColumns(nothing)), lambda: stats, batch, removes=True)

    def gone(self) -> DataFrame | None:
        """(id, until): ids and the batch that removed them last; None where nothing was removed."""
        removing = [r.batch for r in self.commits().filter("removes").select("batch").distinct().collect()]
        if not removing:
            return None
        return self._read("gone", "owner_id long, id long, batch long").filter(F.col("batch").isin(*removing)).groupBy("id").agg(F.max("batch").alias("until"))

    def _live(self, posts: DataFrame) -> DataFrame:
        """Postings (id, batch and more) without removed ones."""
        gone = self.gone()
        return posts if gone is None else posts.join(gone, "id", "left").filter(F.col("until").isNull() | (F.col("until") < F.col("batch"))).drop("until")

    def compact(self, batch: int) -> None:
        """All batches as one, of the number ``batch``: removed postings go, cells stay. The old batches count until this one is committed,
        and not from then on."""
        # by folder, as a table that is written to may not be read
        old = self.batches()
        blocks = self._written(old)
        posts = self._live(blocks.select("owner_id", "token", "cell", "batch", F.explode("posts").alias("p")).select("*", F.col("p.id").alias("id")))
        merged = posts.groupBy("owner_id", "token", "cell").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.max("p.tf").alias("max_tf"), F.min("p.dl").alias("min_dl"), F.sort_array(F.collect_list("p")).alias("posts")
        )
        stats = self.commits().groupBy("owner_id").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).filter("owner_id is not null")
        stats = settle(stats)
        self._write(self._dealt(merged), lambda: stats, batch, replaces=old)

    def _weights(self, wanted: DataFrame, met: DataFrame) -> DataFrame:
        """(query_id, owner_id, token, idf, avgdl) of query tokens; ``met`` are the blocks of their tokens."""
        df = met.groupBy("owner_id", "token").agg(F.sum("n").alias("df")).filter("df > 0")
        stats = self.commits().groupBy("owner_id").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).filter("n > 0")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return wanted.join(df.join(stats, "owner_id").select("owner_id", "token", idf.alias("idf"), (F.col("dl") / F.col("n")).alias("avgdl")), ["owner_id", "token"])

    def bounds(self, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
        """The query tokens with their weights; and (query_id, owner_id, cell, bound, docs): what a cell's documents can score at most,
        and how many at least hold a token."""
        wanted = settle(exploded(queries.withColumn("owner_id", F.col("owner_id").cast("long")), ["query_id", "owner_id"], t.query_tokens(F.col("query"))))
        tokens = wanted.select("owner_id", "token").distinct()
        met = settle(self.blocks().select("owner_id", "token", "cell", "n", "max_tf", "min_dl").join(tokens, ["owner_id", "token"]))
        weights = settle(self._weights(wanted, met))
        most = F.col("idf") * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_dl") / F.col("avgdl")))
        cells = weights.join(met.filter("max_tf > 0"), ["owner_id", "token"]).groupBy("query_id", "owner_id", "cell").agg(F.sum(most).alias("bound"), F.max("n").alias("docs"))
        return weights, settle(cells)

    def _scores(self, weights: DataFrame, cells: DataFrame, k1: float, b: float) -> DataFrame:
        """(query_id, id, score) of all documents in some cells. As a cell has all of its documents' postings, it is scored by itself."""
        asked = cells.select("query_id", "cell").join(weights, "query_id")
        blocks = self.blocks().filter("max_tf > 0").select("owner_id", "cell", "token", "batch", "posts").join(weights.select("owner_id", "token").distinct(), ["owner_id", "token"], "left_semi")
        blocks = blocks.join(cells.select("owner_id", "cell").distinct(), ["owner_id", "cell"], "left_semi")
        if self.gone() is not None:
            posts = self._live(blocks.select("owner_id", "cell", "token", "batch", F.explode("posts").alias("p")).select("*", F.col("p.id").alias("id")))
            blocks = posts.groupBy("owner_id", "cell", "token").agg(F.collect_list("p").alias("posts"))
        met = blocks.select("owner_id", "cell", "token", "posts").groupBy("owner_id", "cell").cogroup(asked.select("owner_id", "cell", "query_id", "token", "idf", "avgdl").groupBy("owner_id", "cell"))
        kind = weights.schema["query_id"].dataType.simpleString()
        return met.applyInArrow(_scored(k1, b), f"query_id {kind}, id long, score double").withColumn("score", F.round("score", 6))

    def first_cells(self, cells: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The cells of each query's highest bounds that hold some 2 k documents, and the others."""
        before = F.sum("docs").over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1))
        dealt = settle(cells.withColumn("_first", F.coalesce(before, F.lit(0)) < 2 * k))
        return dealt.filter("_first").drop("_first"), dealt.filter("not _first").drop("_first")

    def search(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, id_col: str = "fragment_id") -> DataFrame:
        """(query_id, id, score, rank) of the best k documents of the query's owner; queries are (query_id, owner_id, query), their tokens OR-ed."""
        weights, cells = self.bounds(queries, k1, b)
        first, others = self.first_cells(cells, k)
        found = settle(self._scores(weights, first, k1, b))
        others = self.worth(others, found, k)
        best = top_n(found.unionByName(self._scores(weights, others, k1, b)), ["query_id"], [F.desc("score"), F.asc("id")], k)
        return best.select("query_id", F.col("id").alias(id_col), "score", "rank")

    @staticmethod
    def worth(cells: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """Cells that may hold a document as good as the k-th of those found."""
        floor = top_n(found, ["query_id"], [F.desc("score"), F.asc("id")], k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_floor"))
        return cells.join(floor, "query_id", "left").filter(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor") - ROUNDING)).drop("_floor")


def _gathered(key, docs):
    """The blocks of a cell's documents (id, words); words are joined by spaces."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.split_pattern(docs.column("words").combine_chunks(), " ")
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    token, some = flat.indices.to_numpy().astype(np.int64), pc.not_equal(words.flatten(), "").to_numpy(zero_copy_only=False)
    size[pc.equal(docs.column("words").combine_chunks(), "").to_numpy(zero_copy_only=False)] = 0
    # rows of one id and length are one document
    of, doc = np.unique(np.stack([docs.column("id").to_numpy(), size]), axis=1, return_inverse=True)
    pair, tf = np.unique(token[some] * docs.num_rows + np.repeat(doc.reshape(-1), size), return_counts=True)
    token, doc = pair // docs.num_rows, pair % docs.num_rows
    first = np.flatnonzero(np.diff(token, prepend=-1))
    ends, dl = np.append(first, len(token)), of[1][doc]
    least = np.minimum.reduceat(dl, first) if len(first) else dl
    most = np.maximum.reduceat(tf, first) if len(first) else tf
    posts = pa.StructArray.from_arrays([pa.array(of[0][doc], pa.int64()), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())], ["id", "tf", "dl"])
    owner, cell = (k.as_py() for k in key)
    return pa.table({
        "owner_id": pa.array([owner] * len(first), pa.int64()), "token": flat.dictionary.take(pa.array(token[first])), "cell": pa.array([cell] * len(first), pa.string()),
        "n": pa.array(np.diff(ends), pa.int32()), "max_tf": pa.array(most, pa.int32()), "min_dl": pa.array(least, pa.int32()), "posts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), posts),
    })


def _scored(k1: float, b: float):
    """The scores of a cell's documents for the queries that ask for it, from its blocks (token, posts) and their tokens (query_id, token, idf,
    avgdl)."""

    def run(blocks, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        posts = blocks.column("posts").combine_chunks()
        held = pc.index_in(asked.column("token"), value_set=blocks.column("token").combine_chunks())
        has = held.is_valid()
        held, asked = held.filter(has).to_numpy(), asked.filter(has)
        size = pc.list_value_length(posts).to_numpy(zero_copy_only=False)
        id_, tf, dl = (posts.flatten().field(c).to_numpy() for c in ("id", "tf", "dl"))
        n = size[held]
        at = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[held] - (np.cumsum(n) - n), n)
        idf, avgdl = (np.repeat(asked.column(c).to_numpy(), n) for c in ("idf", "avgdl"))
        part = idf * tf[at] * (k1 + 1) / (tf[at] + k1 * (1 - b + b * dl[at] / avgdl))
        queries = asked.column("query_id").combine_chunks().dictionary_encode()
        ids, doc = np.unique(id_, return_inverse=True)
        pair = np.repeat(queries.indices.to_numpy().astype(np.int64), n) * len(ids) + doc[at]
        found, place = np.unique(pair, return_inverse=True)
        score = np.bincount(place, part, len(found))
        query = queries.dictionary.take(pa.array(found // max(len(ids), 1)))
        return pa.table({"query_id": query, "id": pa.array(ids[found % max(len(ids), 1)], pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def _listed(spark: SparkSession, path: str) -> list:
    """What lies in a folder, or the file itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return list(fs.listStatus(where)) if fs.exists(where) else []


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for the files in a folder as they are now."""
    files = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in _listed(spark, path))
    return hashlib.md5("\n".join(files).encode()).hexdigest()
