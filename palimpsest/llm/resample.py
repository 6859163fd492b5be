"""Importance resampling towards a target distribution: hashed word runs weigh the documents, and a parallel sort by regular sampling ranks them.

Features are all runs of one to three words of a text; each falls into a bucket, the crc32 of its bytes modulo BUCKETS. A bucket gains by
being commoner in the target than in the documents. Gains are an array of BUCKETS numbers, so a document's weight is a sum of array cells. A
hash of the id gives each document's noise (Gumbel), so the highest sums of weight and noise are a draw without replacement.

Ranks come from sorting by regular sampling: every partition is sorted by itself and gives every n-th of its rows; regular places among
these samples split the order into segments of about equal size; rows go to their segments, are sorted there, and a prefix sum of the
segments' sizes makes places in segments ranks. Segments that begin behind the last drawn rank are not sorted at all.

The driver sees the counts of BUCKETS buckets, one size for each segment and about OVERSAMPLE samples for each. There are as many segments as
spark.sql.shuffle.partitions says.

Null texts have no words, weight 0 and are never drawn; a null doc_id is hashed as an empty one and loses ties; repeated rows are rows of their own,
which a row number tells apart. Empty documents give no rows; an empty target gives gains all the same. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, with_columns
from .wordhash import _IS_WORD, chunks

BUCKETS = 10_000
RUN = 3
#: Words that a document needs to be drawn.
LEAST_WORDS = 20
#: Samples for each segment.
OVERSAMPLE = 32
#: Bytes of a word that are hashed side by side with other words'; a longer one is hashed alone.
_SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@cache
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """The crc32 of single bytes, and of n zero bytes behind a register: for n below 64 and for powers of two, four tables of a byte each."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (one & np.uint32(1)))
    byte = np.arange(256, dtype=np.uint32)
    none = np.stack([byte << np.uint32(8 * i) for i in range(4)])
    forward = lambda x: one[x & np.uint32(255)] ^ (x >> np.uint32(8))
    small = [none]
    for _ in range(63):
        small.append(forward(small[-1]))
    twice = lambda t: np.stack([_apply(t, x) for x in t])
    powers = [twice(small[32])]  # of 64
    for _ in range(24):
        powers.append(twice(powers[-1]))
    return one, np.stack(small + powers)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & np.uint32(255)] ^ table[1][(x >> np.uint32(8)) & np.uint32(255)] ^ table[2][(x >> np.uint32(16)) & np.uint32(255)] ^ table[3][x >> np.uint32(24)]


def _shift(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc registers after n zero bytes more."""
    _, tables = _steps()
    few = n & 63
    byte = lambda i: (x >> np.uint32(8 * i)) & np.uint32(255)
    out = tables[few, 0, byte(0)] ^ tables[few, 1, byte(1)] ^ tables[few, 2, byte(2)] ^ tables[few, 3, byte(3)]
    left, power = n >> 6, 64
    while left.any():
        rows = np.flatnonzero(left & 1)
        out[rows] = _apply(tables[power], out[rows])
        left, power = left >> 1, power + 1
    return out


def word_crcs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 and length in bytes of all words in order, and each row's (and one past the last) first word."""
    inside = _IS_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    begins = edge == 1
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows] = inside[rows]  # a word ends with its row
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), bounds
    lengths = np.add.reduceat(inside, starts, dtype=np.int64)
    low, one = _LOWER[data], _steps()[0]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(lengths <= _SHORT)
    short = short[np.argsort(-lengths[short], kind="stable")]
    size, at = lengths[short], starts[short]
    register = crc[short]
    for j in range(int(size.max(initial=0))):
        n = np.searchsorted(-size, -j)  # those longer than j come first
        c = register[:n]
        register[:n] = one[(c ^ low[at[:n] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc[short] = register ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _SHORT):
        crc[i] = zlib.crc32(low[starts[i] : starts[i] + lengths[i]].tobytes())
    return crc, lengths, bounds


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For runs of 1 to RUN words: (bucket of the run that begins at a word, whether it ends in the same row); and row bounds."""
    crc, lengths, bounds = word_crcs(data, offsets)
    spaced = _shift(np.full(len(crc), zlib.crc32(b" "), np.uint32), lengths) ^ crc  # of a space and the word
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(crc))
    out, run = [], crc
    for n in range(1, RUN + 1):
        if n > 1:
            end = np.minimum(np.arange(len(crc)) + n - 1, len(crc) - 1)
            run = _shift(run, lengths[end] + 1) ^ spaced[end]
        out.append(((run % np.uint32(BUCKETS)).astype(np.int64), left >= n))
    return out, bounds


def _counted(batches):
    """What a partition's texts have in each bucket."""
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for *_, data, offsets in chunks(batch.column("text")):
            for bucket, whole in buckets(data, offsets)[0]:
                total += np.bincount(bucket[whole], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket."""
    counts = texts.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():  # BUCKETS rows at most
        out[row.bucket] = row.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's smoothed ratio of shares, rounded down."""
    all_docs, all_target = float(docs.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * all_docs / ((s + 1) * all_target))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sums, words = [], []
            for *_, data, offsets in chunks(batch.column("text")):
                found, bounds = buckets(data, offsets)
                each = sum((gain[bucket] * whole for bucket, whole in found), np.zeros(bounds[-1], np.int64))
                sums.append(np.diff(np.concatenate(([0], np.cumsum(each)))[bounds]))
                words.append(np.diff(bounds))
            n = np.concatenate(words) if words else np.zeros(0, np.int64)
            features = sum(np.maximum(n - k, 0) for k in range(RUN))
            weight = np.concatenate(sums) if sums else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    texts, other = (with_columns(d, ("doc_id", "long"), ("text", "string")) for d in (docs, target))
    weighed = texts.mapInArrow(_weigher(gains(bucket_counts(texts), bucket_counts(other))), "doc_id long, n_words long, n_features long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    chance = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(chance))))


def _order() -> list[Column]:
    """The order of ranks: highest score, smallest id (null last), then the row's number."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def _keys(batch) -> list[np.ndarray]:
    """Columns of the order, all ascending, the first one last (as lexsort has it)."""
    ids = batch.column("doc_id")
    ids = ids.fill_null(np.iinfo(np.int64).max) if ids.null_count else ids
    return [batch.column("row").to_numpy(), ids.to_numpy(), -batch.column("score").to_numpy()]


def _sampler(stride: int):
    def run(batches):
        """Every stride-th row of a sorted partition, from the middle of the first stride on."""
        seen = stride - stride // 2 - 1
        for batch in batches:
            at = np.arange(stride - 1 - seen % stride, len(batch), stride)
            seen += len(batch)
            yield batch.take(at)

    return run


def _segmenter(splitters: list[np.ndarray]):
    def run(batches):
        """The number of splitters that a row isn't before."""
        import pyarrow as pa

        for batch in batches:
            n, both = len(splitters[0]), [np.concatenate(pair) for pair in zip(splitters, _keys(batch), strict=True)]
            # a splitter is a row itself, and stands before it
            order = np.lexsort((np.arange(len(both[0])) >= n, *both))
            passed = np.empty(len(order), np.int64)
            passed[order] = np.cumsum(order < n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passed[n:], pa.int32())], [*batch.schema.names, "segment"])

    return run


def sort_ranks(rows: DataFrame, drawn: int, n: int) -> DataFrame:
    """The first ``drawn`` of n ``rows`` (score, doc_id, row and more) in their order have their rank from 1, the others null. ``rows`` are read three times."""
    import pyarrow as pa

    spark, schema = rows.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    segments = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    stride = max(1, n // (segments * OVERSAMPLE))
    keys = rows.select("score", "doc_id", "row")
    runs = keys.sortWithinPartitions(*_order()).mapInArrow(_sampler(stride), keys.schema)
    samples = runs.toArrow().combine_chunks()
    columns = _keys(samples.to_batches()[0] if len(samples) else pa.RecordBatch.from_pylist([], samples.schema))
    order = np.lexsort(columns)
    places = order[len(order) * np.arange(1, segments) // segments] if len(order) else order
    dealt = rows.mapInArrow(_segmenter([c[places] for c in columns]), f"{schema}, segment int")
    sizes = {r.segment: r.n for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each segment
    starts, total = [], 0
    for segment in range(segments):
        if total < drawn:
            starts.append((segment, total))
        total += sizes.get(segment, 0)
    none = F.lit(None).cast("long").alias("rank")
    known = F.broadcast(spark.createDataFrame(starts, "_segment int, _start long"))
    inside = dealt.filter(F.col("segment") < len(starts)).join(known, F.col("segment") == F.col("_segment"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("segment").orderBy(*_order()))
    ranked = inside.select(*rows.columns, F.when(place <= drawn, place).alias("rank"))
    return ranked.unionByName(dealt.filter(F.col("segment") >= len(starts)).select(*rows.columns, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: ``percent`` of those with ``least_words`` words are drawn and ranked."""
    weighed = materialize(weigh(docs, target, seed).withColumn("row", F.monotonically_increasing_id()))
    fit = weighed.filter(F.col("n_words") >= least_words)
    n = fit.count()
    ranked = sort_ranks(fit, percent * n // 100, n)
    rest = weighed.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
