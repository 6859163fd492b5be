"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of 13 consecutive words; an item of fewer words, but not none, is one window. A window is a set
of placed shingles of five words, all of which must stand in the document, so one necessary token is prefix enough: the window's
rarest shingle, by its document frequency over all documents. Documents and windows meet on that shingle in an equi-join, which is
salted where even the rarest one is hot; the shingle's place bounds where the window would begin and must leave room for its length;
there the containment of all the window's shingles, at their places, is verified. Items of fewer than five words use shingles of their own length.

Documents are read once: a fixed-size bit filter of the benchmark's shingles says which of a document's are worth keeping.
Null and empty texts have no words; every row of the documents gives one row, whatever its id; items without words have no
windows; items that repeat an id count as one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, bits, in_bits, lean, materialize, with_columns
from .wordhash import SHINGLE, chunks, shingles, words

WINDOW = 13
#: Parts that the documents with a hot prefix are dealt into; the windows of that prefix are repeated for each.
SALTS = 16
#: Size of the bit filter, which alone is sent to every task: 2 MB.
LOG2_BITS = 24


def _item_shingles(batches):
    import pyarrow as pa

    for batch in batches:
        ids, counts, lists = batch.column("item_id").to_pylist(), [], []
        for row, end, data, offsets in chunks(batch.column("text")):
            hashes, bounds = words(data, offsets)
            for i in range(end - row):
                own = hashes[bounds[i] : bounds[i + 1]]
                k = min(SHINGLE, len(own))
                counts.append(len(own))
                lists.append(shingles(own, np.array([0, len(own)]), k)[0].view(np.int64) if k else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(counts, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "n", "shingles"])


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, k (words of a shingle), length (words), shingles of every window of every item."""
    items = with_columns(benchmark, ("item_id", "string"), ("text", "string")).mapInArrow(_item_shingles, "item_id string, n int, shingles array<long>").filter("n > 0")
    length, k = F.least("n", F.lit(WINDOW)), F.least("n", F.lit(SHINGLE))
    per_window = length - k + 1
    spread = items.select("item_id", k.alias("k"), length.alias("length"), "shingles", F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("at"), per_window.alias("m"))
    return spread.select("item_id", "k", "length", F.slice("shingles", F.col("at") + 1, F.col("m")).alias("shingles"))


def _document_hits(filter_bytes, sizes: list[int]):
    """For each document: its words, and places and hashes of the shingles that the filter passes, for each shingle size."""

    def run(batches):
        import pyarrow as pa

        table = np.frombuffer(filter_bytes.value, np.uint64)
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for row, end, data, offsets in chunks(batch.column("text")):
                hashes, bounds = words(data, offsets)
                found = []
                for k in sizes:
                    tokens, at, _ = shingles(hashes, bounds, k)
                    ok = in_bits(table, tokens, LOG2_BITS)
                    found.append((np.full(ok.sum(), k, np.int32), at[ok], tokens[ok].view(np.int64)))
                ks, at, tokens = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((at, ks, np.searchsorted(bounds, at, "right")))
                ks, at, tokens = ks[order], at[order], tokens[order]
                owner = np.searchsorted(bounds, at, "right") - 1
                cut = np.searchsorted(owner, np.arange(end - row + 1))
                place = (at - bounds[owner]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (ks, place, tokens)]
                out.append(pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(np.diff(bounds)), *lists], ["doc_id", "n_words", "k", "place", "token"]))
            yield from out

    return run


def match(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents as uid, doc_id, n_words; hits as uid, item_id, start, length of every occurring window)."""
    spark = docs.sparkSession
    wins = materialize(windows(benchmark).distinct())
    sizes = sorted(r.k for r in wins.select("k").distinct().collect()) or [SHINGLE]
    tokens = wins.select(F.explode("shingles").alias("token")).distinct()
    held = spark.sparkContext.broadcast(bits(tokens, "token", LOG2_BITS))
    found = with_columns(docs, ("doc_id", "long"), ("text", "string")).mapInArrow(lean(_document_hits(held, sizes)), "doc_id long, n_words long, k array<int>, place array<int>, token array<long>")
    files = materialize(found.withColumn("uid", F.monotonically_increasing_id()))

    hit = files.filter(F.size("token") > 0)
    frequency = materialize(hit.select(F.explode(F.array_distinct("token")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    # the prefix: each window's rarest shingle; a window with a shingle that no document has can't occur
    placed = wins.select("item_id", "k", "length", "shingles", F.posexplode("shingles").alias("offset", "token")).join(frequency, "token", "left")
    keys = ["item_id", "k", "length", "shingles"]
    prefix = (
        placed.groupBy(*keys)
        .agg(F.min(F.struct("df", "token", "offset")).alias("rarest"), F.bool_and(F.col("df").isNotNull()).alias("possible"))
        .filter("possible")
        .select(*keys, F.col("rarest.token").alias("prefix"), F.col("rarest.offset").alias("offset"))
    )
    # a row for each shingle of a document, with its place among the document's shingles; documents with a hot one are dealt over salts
    spots = hit.select("uid", "n_words", F.posexplode(F.arrays_zip("k", "place", "token")).alias("i", "s")).select("uid", "n_words", "i", "s.*")
    total = frequency.agg(F.sum("df")).first()[0] or 0
    hot = F.broadcast(materialize(frequency.filter(F.col("df") >= max(float(SALTS), total * HOT_SHARE)).select("token", F.lit(True).alias("hot"))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("uid"), F.lit(SALTS))).otherwise(0).alias("salt")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spots = spots.join(hot, "token", "left").select("uid", "n_words", "i", F.col("k").alias("own_k"), "place", F.col("token").alias("prefix"), salt.cast("int").alias("salt"))
    prefix = prefix.join(hot.withColumnRenamed("token", "prefix"), "prefix", "left").select(*keys, "prefix", "offset", F.explode(salts).alias("salt"))
    begin = F.col("place") - F.col("offset")
    fits = (F.col("own_k") == F.col("k")) & (begin >= 0) & (begin + F.col("length") <= F.col("n_words")) & (F.col("i") >= F.col("offset"))
    candidates = spots.join(prefix, ["prefix", "salt"]).filter(fits).select("uid", "item_id", "length", "shingles", begin.alias("start"), (F.col("i") - F.col("offset")).alias("from"))
    # the window's shingles must follow one another from there, place by place; each document's own lie in its one row
    m, at = F.size("shingles"), F.col("from")
    placed = (F.slice("token", at + 1, m) == F.col("shingles")) & (F.get("place", at + m - 1) - F.get("place", at) == m - 1)
    verified = candidates.join(hit.select("uid", "place", "token"), "uid").filter((at + m <= F.size("token")) & placed)
    return files.select("uid", "doc_id", "n_words"), verified.select("uid", "item_id", "start", "length")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted), contaminated: a document is when 5 % of its words, and one, are hit."""
    files, hits = match(docs, benchmark)
    # a window that several items have is one stretch of the document
    stretches = F.collect_set(F.struct("start", "length"))
    words = F.flatten(F.transform(stretches, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    by_file = hits.groupBy("uid").agg(F.size(F.array_distinct(words)).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return files.join(by_file, "uid", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated")
    )


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
