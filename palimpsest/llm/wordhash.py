"""64-bit hashes of the words of whole texts, for a batch of rows at once (numpy; runs inside tasks).

Words are runs of ASCII digits and letters and of anything outside ASCII; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled together. A longer text is handled alone and whole.
CHUNK = 1 << 20
#: Words of a shingle.
SHINGLE = 5

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[0x41:0x5B] += 32
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), _BASE))))


_POWERS = _powers(64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as bytes and row offsets; a null row is an empty text."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets in them), about CHUNK bytes at a time, whole rows."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _letters(data: np.ndarray, offsets: np.ndarray):
    """Row bounds in words; each word's first letter and length among all letters; each letter's value at its place, and the place."""
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows] = inside[rows]  # a word ends with its row
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return bounds, starts, starts, np.zeros(0, np.uint64), starts
    first = np.flatnonzero(begins[inside])
    letters = _VALUE[data[inside]]
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = _POWERS if lengths.max() <= len(_POWERS) else _powers(int(lengths.max()))
    return bounds, first, lengths, letters * powers[place], place


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order, and for each row (and one past the last) the index of its first word."""
    bounds, first, _, values, _ = _letters(data, offsets)
    return mix(np.add.reduceat(values, first)) if len(first) else np.zeros(0, np.uint64), bounds


def words_and_stems(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds, and a line of word hashes followed by one line for each stem size: hashes of words' first bytes, 0 for
    words that aren't longer."""
    bounds, first, lengths, values, place = _letters(data, offsets)
    out = np.zeros((1 + len(sizes), len(first)), np.uint64)
    if len(first):
        out[0] = mix(np.add.reduceat(values, first))
        for line, size in enumerate(sizes, 1):
            stem = mix(np.add.reduceat(np.where(place < size, values, np.uint64(0)), first) + np.uint64(size))
            out[line] = np.where(lengths > size, stem, np.uint64(0))
    return bounds, out


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k words in a row, the index of each one's first word, and row bounds. Fewer than k words give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    joined = np.zeros(n, np.uint64)
    for i in range(k):
        joined = joined * _STEP + hashes[i : i + n]
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + k <= ends)
    return mix(joined[at]), at, np.searchsorted(at, bounds)


def all_words(hashes: np.ndarray) -> np.uint64:
    """One hash for a text of fewer than SHINGLE words, so that short texts have one shingle too."""
    h = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for x in hashes:
            h = h * _STEP + x
    return mix(np.array([h], np.uint64))[0]
