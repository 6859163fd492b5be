"""Best-fit packing into sequences of several permitted lengths.

Documents become pieces of at most the largest capacity. Pieces are placed longest first, each into the open bin with the least
room that holds it. Where none does, a bin is opened at the capacity that costs least for what it can be expected to hold:
its cost, linear and quadratic in its length, over the piece and the shorter pieces still to come that fit beside it. At the end
every bin shrinks to the smallest permitted length that holds its contents.

Pieces of one length are alike, so the plan is made for the histogram of lengths, which has at most as many entries as the
largest capacity has tokens; it says which ranks of each length go to which bins. Pieces get their rank in their length by
salted counts and find their bin by a search in the plan. Null and empty texts have one piece of one token, the separator.
Every row gives its pieces; rows that repeat a doc_id are packed each; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranks, with_columns

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Length at which the quadratic part of a sequence's cost equals the linear one.
QUADRATIC_FROM = 16384
SALTS = 64


def tokens(text: Column) -> Column:
    """Estimated tokens: four UTF-8 bytes each, and one separator."""
    return (F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4) + 1).cast("long")


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / QUADRATIC_FROM)


def plan(histogram: dict[int, int], capacities=CAPACITIES) -> tuple[np.ndarray, np.ndarray]:
    """Segments (length, first rank, number, first bin, offset) and for each range of bins (first bin, end, final capacity)."""
    sizes = sorted(capacities)
    rooms: list[int] = []  # rooms that open bins have, sorted
    open_bins: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room to ranges of bins with their capacity
    segments, bins = [], 0
    lengths = sorted(histogram)
    mass = np.concatenate(([0], np.cumsum([n * histogram[n] for n in lengths])))

    def put(room: int, low: int, high: int, capacity: int) -> None:
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append((low, high, capacity))

    for length in reversed(lengths):
        done, count = 0, histogram[length]
        while done < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                low, high, capacity = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            else:

                def price(capacity: int) -> float:
                    room = capacity - length
                    fitting = mass[bisect_left(lengths, min(room, length - 1) + 1)] / (count - done) + (length * (room // length) if count - done > 1 else 0)
                    return cost(capacity) / (length + min(room, fitting))

                capacity = min((c for c in sizes if c >= length), key=price)
                low, high, room = bins, bins + max(1, (count - done) // (capacity // length)), capacity
                bins = high
            # a bin that takes one piece of this length is then the fullest that holds it, so it takes as many as fit
            each = min(room // length, count - done)
            full = min(high - low, (count - done) // each)
            for layer in range(each):
                segments.append((length, done, full, low, capacity - room + layer * length))
                done += full
            put(room - each * length, low, low + full, capacity)
            if low + full < high:
                put(room, low + full, high, capacity)
    final = sorted((low, high, sizes[bisect_left(sizes, capacity - room)]) for room, ranges in open_bins.items() for low, high, capacity in ranges)
    return np.array(segments, np.int64).reshape(-1, 5), np.array(final, np.int64).reshape(-1, 3)


def _place(shared):
    def run(batches):
        import pyarrow as pa

        segments, final, keys = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = segments[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
            bins = row[:, 3] + rank - row[:, 1]
            capacity = final[np.searchsorted(final[:, 0], bins, "right") - 1, 2]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length")], pa.array(bins), pa.array(capacity), pa.array(row[:, 4])],
                ["doc_id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset"],
            )

    return run


def pack(docs: DataFrame, capacities=CAPACITIES, length: Column | None = None) -> DataFrame:
    """doc_id, piece, start (token of the document), length, bin_id, bin_capacity, bin_offset (token of the bin)."""
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    spark, most = docs.sparkSession, max(capacities)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("whole")) if length is not None else with_columns(
        docs, ("doc_id", "long"), ("text", "string")
    ).select("doc_id", tokens(F.col("text")).alias("whole"))
    cut = sized.select("doc_id", "whole", F.monotonically_increasing_id().alias("uid"), F.explode(F.sequence(F.lit(0), F.floor((F.col("whole") - 1) / most))).alias("piece"))
    pieces = materialize(cut.select("doc_id", "uid", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("whole") - F.col("piece") * most, F.lit(most)).alias("length")))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``most`` entries
    segments, final = plan(histogram, capacities)
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    segments = segments[order]
    held = spark.sparkContext.broadcast((segments, final, segments[:, 0] * (1 << 44) + segments[:, 1]))
    ranked = ranks(pieces, F.col("length"), F.pmod(F.xxhash64("uid", "piece"), F.lit(SALTS)).cast("int"), [F.col("uid"), F.col("piece")])
    out = ranked.select("doc_id", "piece", "start", "length", F.col("rank").cast("long").alias("rank"))
    return out.mapInArrow(_place(held), "doc_id long, piece long, start long, length long, bin_id long, bin_capacity long, bin_offset long")
