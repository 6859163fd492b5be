"""Passes over the bytes of texts: terms that stand anywhere in them, and sums over their pairs of characters. Tasks work on a batch's
Arrow buffers piece by piece; what they find is joined and grouped by Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of a term that are looked for (of a longer one the first, and the rest is compared), and of its beginnings that are tried before.
LONGEST, BEGINNINGS = 64, (4, 8, 16, 32, 64)
#: The filter of terms has 2**LOG2_BITS bits, however many they are. Bytes of a piece of text that is hashed, and for which results are given.
LOG2_BITS, PIECE, SLAB = 24, 1 << 16, 1 << 22
#: Bytes of the texts whose pairs are sorted together, and the most rows of them.
SORTED = 1 << 20
_BASE, _MIX, _SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """A column's bytes and where each row begins and ends in them."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _sums(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums of the bytes times powers, whose differences are hashes of all windows once divided by the power of the place."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])


def _slots(hashes: np.ndarray, n) -> np.ndarray:
    """A hash's bit in the filter; windows of another length have another."""
    return ((hashes ^ (np.asarray(n, np.uint64) * np.uint64(_SALT))) * np.uint64(_MIX)) >> np.uint64(64 - LOG2_BITS)


def _second(hashes: np.ndarray, n) -> np.ndarray:
    return _slots(~hashes, np.asarray(n, np.uint64) + np.uint64(LONGEST))


def _marks(batches):
    """The filter's words that the terms set: a bit for each of a term's beginnings and two for the whole."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = _buffers(batch.column(0))
        up, down = _powers(len(data))
        sums, at, n = _sums(data, up), offsets[:-1], np.diff(offsets)
        h = lambda part, size: (sums[at[part] + size] - sums[at[part]]) * down[at[part]]  # noqa: B023, E731
        own = np.arange(len(at))
        first = [_slots(h(part, b), b) for b in BEGINNINGS for part in (own[n >= b],)]
        bits = np.unique(np.concatenate([*first, _slots(h(own, n), n), _second(h(own, n), n)])) if len(data) else np.zeros(0, np.uint64)
        words, start = np.unique(bits >> np.uint64(6), return_index=True)
        values = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), start) if len(start) else words
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(values.view(np.int64))], ["word", "bits"])


def _places(data: np.ndarray, sizes: list[int], table: np.ndarray, coarse: np.ndarray, up: np.ndarray, down: np.ndarray, most: int):
    """(size, places) of the windows among the first ``most`` places that may be terms. ``coarse`` says which 256 bits have any set."""
    sums = _sums(data, up)
    in_table = lambda s: (table[(s >> np.uint64(6)).view(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
    begun = None
    for first in sorted({n for n in sizes if n < BEGINNINGS[0]} | {b for b in BEGINNINGS if b <= max(sizes, default=0)}):
        if begun is None or first <= BEGINNINGS[0]:  # at all places
            m = min(most, len(data) - first + 1)
            if m <= 0:
                return
            slots = _slots((sums[first : first + m] - sums[:m]) * down[:m], first)
            begun = np.flatnonzero(coarse[(slots >> np.uint64(8)).view(np.int64)])
            begun = begun[in_table(slots[begun])]
        else:  # where the shorter beginning was found
            begun = begun[: np.searchsorted(begun, len(data) - first, "right")]
            begun = begun[in_table(_slots((sums[begun + first] - sums[begun]) * down[begun], first))]
        for n in sizes:
            if first <= n < 2 * first and (n == first or first in BEGINNINGS):
                at = begun[: np.searchsorted(begun, len(data) - n, "right")]
                h = (sums[at + n] - sums[at]) * down[at]
                at = at[in_table(_slots(h, n)) & in_table(_second(h, n))]
                if len(at):
                    yield n, at


def _finder(sizes: list[int], words: np.ndarray, bits: np.ndarray, keep: list[str]):
    """For each text the distinct windows that may be terms."""

    def find(batches):
        import pyarrow as pa

        table = np.zeros(1 << (LOG2_BITS - 6), np.uint64)
        table[words] = bits
        coarse = table.reshape(-1, 4).any(axis=1)
        up, down = _powers(PIECE + LONGEST)
        for batch in batches:
            data, offsets = _buffers(batch.column("_low"))
            kept = batch.select(keep)
            end = int(offsets[-1])
            for slab in range(int(offsets[0]), end, SLAB):
                hits: dict[int, list[np.ndarray]] = {}
                for lo in range(slab, min(slab + SLAB, end), PIECE):
                    for n, at in _places(data[lo : min(lo + PIECE + LONGEST - 1, end)], sizes, table, coarse, up, down, PIECE):
                        hits.setdefault(n, []).append(at + lo)
                for n, parts in hits.items():
                    at = np.concatenate(parts)
                    row = np.searchsorted(offsets, at, "right") - 1
                    inside = at + n <= offsets[row + 1]
                    at, row = at[inside], row[inside]
                    window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, n)[at])
                    token = pa.Array.from_buffers(pa.binary(n), len(at), [None, pa.py_buffer(window)])
                    found = pa.table({"row": row, "token": token.cast(pa.binary())}).group_by(["row", "token"], use_threads=False).aggregate([]).combine_chunks()
                    for part in found.to_batches():
                        yield pa.RecordBatch.from_arrays([*kept.take(part.column("row")).columns, part.column("token")], [*keep, "_token"])

    return find


def contained(texts: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """The terms that stand anywhere in a text with the same ``by`` columns, repeated where both are. Texts are (by, text_id, _low), terms
    (by, entity_id, term), none of them empty; they are compared as they are. Terms are read several times.

    Texts are read once: at each of their bytes a filter of fixed size says whether a term may begin and end here. Windows that pass are
    joined with the terms. Of terms longer than ``LONGEST`` bytes that is the beginning, so their texts are met once more."""
    keys = terms.withColumn("_token", F.substring(F.col("term").cast("binary"), 1, LONGEST))
    sizes = sorted(r.n for r in keys.select(F.least(F.octet_length("term"), F.lit(LONGEST + 1)).alias("n")).distinct().collect())
    words = keys.select("_token").mapInArrow(_marks, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words, bits = words.column("word").to_numpy(), words.column("bits").to_numpy().view(np.uint64)
    keep = [*by, "text_id"]
    schema = StructType([*[texts.schema[c] for c in keep], StructField("_token", BinaryType())])
    said = texts.mapInArrow(_finder(sorted({min(n, LONGEST) for n in sizes}), words, bits, keep), schema)
    met = said.join(keys, [*by, "_token"]).drop("_token")
    if not sizes or sizes[-1] <= LONGEST:
        return met
    long = F.octet_length("term") > LONGEST
    rest = met.filter(long).join(texts, keep).filter(F.contains("_low", F.col("term"))).select(met.columns)
    return met.filter(~long).unionByName(rest)


def _summed(small: int | None, keep: list[str]):
    """Sums over the distinct pairs of each text, and the pairs' hashes where they are at most ``small`` (None: always)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = _buffers(batch.column("_n"))
            lo = 0
            while lo < batch.num_rows:
                hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SORTED, "right")) - 1), lo + SORTED)
                size, sums, hashes = _pairs(data, offsets[lo : hi + 1])
                held = size if small is None else np.where(size <= small, size, 0)
                ends = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[np.repeat(held == size, size)].view(np.int64)))
                out = [*batch.select(keep).slice(lo, hi - lo).columns, pa.array(size), *[pa.array(s.view(np.int64)) for s in sums], own]
                yield pa.RecordBatch.from_arrays(out, [*keep, "_size", "_xor", "_h0", "_h1", "_h"])
                lo = hi

    return run


def _pairs(data: np.ndarray, offsets: np.ndarray):
    """For each text its number of distinct pairs of characters, their hashes' sums (exclusive or): of all, and of those whose bit 7 is not
    set or set; and the hashes, text by text."""
    part = data[offsets[0] : offsets[-1]]
    first = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets - offsets[0]]  # the characters before each text
    chars = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inside = row[1:] == row[:-1]
    code = (row[:-1].astype(np.uint64) << np.uint64(42) | chars[:-1] << np.uint64(21) | chars[1:])[inside]
    code.sort()
    code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
    row = (code >> np.uint64(42)).astype(np.int64)
    size = np.bincount(row, minlength=len(offsets) - 1)
    h = code & np.uint64((1 << 42) - 1)
    for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h + np.uint64(_BASE) ^ h >> np.uint64(shift)) * np.uint64(mix)
    h ^= h >> np.uint64(31)
    odd = h >> np.uint64(7) & np.uint64(1) == 1
    some, sums = np.flatnonzero(size), np.zeros((3, len(size)), np.uint64)
    if len(some):
        start = (np.cumsum(size) - size)[some]
        for i, x in enumerate((h, np.where(odd, np.uint64(0), h), np.where(odd, h, np.uint64(0)))):
            sums[i, some] = np.bitwise_xor.reduceat(x, start)
    return size, sums, h


def pair_sums(rows: DataFrame, small: int | None) -> DataFrame:
    """Rows with a normalised text ``_n``, which is not null, get in its place _size, the number of its distinct pairs of characters, sums
    over the pairs' hashes (_xor, of all; _h0 and _h1, of two halves), and the hashes _h themselves where they are at most ``small``, else none."""
    keep = [c for c in rows.columns if c != "_n"]
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "_size long, _xor long, _h0 long, _h1 long, _h array<bigint>"])
    return rows.mapInArrow(_summed(small, keep), schema)
