"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at several points of a ring. A row belongs to the first shard clockwise of its own point; where that shard
is full, the row goes on clockwise to the next one that is not. With load factor 1 the shards' quotas add up to the number of
rows, so counts are at most one apart; with a larger one fewer rows move on.

A row's point comes from its doc_id, or from its text where doc_id is null, so equal rows stand together. The ring is cut into
cells, a fixed number. Only the number of rows in each cell reaches the driver, which walks the ring once and says which ranks
of a cell go to which shard; rows find their shard by an equi-join on the cell and their rank in it. Nulls: a null text counts
as empty; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranks, with_columns

#: Cells of the ring: what the driver sees is a count for each, 4096 at most.
LOG2_CELLS = 12
VIRTUAL_NODES = 64
SALTS = 4


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, log2_cells: int = LOG2_CELLS) -> list[int]:
    """For each cell the shard that stands at it or next clockwise. A shard's points don't depend on how many others there are."""
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for node in range(virtual_nodes):
            point = int.from_bytes(hashlib.sha256(f"{shard}/{node}".encode()).digest()[:8], "big") >> (64 - log2_cells)
            at.setdefault(point, shard)
    points = sorted(at)
    return [at[points[bisect_left(points, cell) % len(points)]] for cell in range(1 << log2_cells)]


def allot(counts: dict[int, int], owners: list[int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): the walk over the ring, cell by cell. Rows past a full shard move on."""
    left, used, out, cells = list(quotas), [0] * len(quotas), [], len(owners)
    for cell in sorted(counts):
        done, at = 0, cell
        while done < counts[cell]:
            while not left[owners[at % cells]]:
                at += 1
            shard = owners[at % cells]
            take = min(left[shard], counts[cell] - done)
            out.append((cell, done, done + take, shard, used[shard]))
            left[shard], used[shard], done = left[shard] - take, used[shard] + take, done + take
    return out


def quotas(n_rows: int, n_shards: int, load_factor: float) -> list[int]:
    if load_factor <= 1:
        return [n_rows // n_shards + (shard < n_rows % n_shards) for shard in range(n_shards)]
    return [ceil(load_factor * n_rows / n_shards)] * n_shards


def shard(docs: DataFrame, n_shards: int = 16, load_factor: float = 1.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, home (the shard without bounds), shard, slot (from 0 without gaps in each shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    slim = with_columns(docs, ("doc_id", "long"), ("text", "string")).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    point = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text_crc32", "size"))
    slim = materialize(slim.withColumn("point", point).withColumn("cell", F.shiftrightunsigned("point", 64 - LOG2_CELLS).cast("int")))
    counts = {r.cell: r["count"] for r in slim.groupBy("cell").count().collect()}
    owners = ring(n_shards, virtual_nodes)
    plan = allot(counts, owners, quotas(sum(counts.values()), n_shards, load_factor))
    # one row per cell and one more each time a shard fills up: at most the number of cells and shards together
    segments = spark.createDataFrame(plan, "p_cell int, first long, end long, shard int, first_slot long").withColumn("home", F.element_at(F.array(*map(F.lit, owners)), F.col("p_cell") + 1))
    ranked = ranks(slim, F.col("cell"), F.pmod(F.xxhash64("point", "text_crc32", "size"), F.lit(SALTS)).cast("int"), [F.col("point"), F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    placed = ranked.join(F.broadcast(segments), (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select("doc_id", "size", "text_crc32", "home", "shard", (F.col("first_slot") + F.col("rank") - F.col("first")).cast("long").alias("slot"))
