"""Conversation structure repair: the cheapest edits that bring a conversation's roles into order, by tables of blocks (Four Russians).

A repaired conversation is empty, or an optional system turn and then user and assistant turns by turns, ending with an assistant's.
Keeping a row costs 0, a new role 3, deleting it 4, inserting an empty turn 3; a truncated row that stays costs 3 more, blank and
repeated rows have to go. Of equally cheap edits those whose initials (D, I, K, R), in order, are ASCII-least are taken.

What is still to pay after a row is a vector of four costs, one for each state of the order so far (nothing, system, user, assistant).
Less its minimum it is one of a few dozen vectors, so the step over a block of BLOCK rows is looked up: ``tables`` holds, for every block
of symbols and every vector behind it, the vector before it and what was taken off. Blocks are looked up from the last to the first;
then each is expanded backward from the vector behind it, and edits are chosen forward, the least initial among those that lie on a cheapest way.

Conversations may be longer than a task can hold. Rows are sorted by range and cut into chunks of 2**LOG2_CHUNK rows at most. A chunk is summed
up as its costs from each state to each other, chunks of a conversation are composed in a streamed scan of those sixteen numbers, and
every chunk is then expanded by itself. Equal rows are counted before anything else, so a row that is repeated any number of times is one.

Rows of a conversation are taken by turn, null turns first, ties by role and text. Null roles and texts count as one space; a null conv_id
is a conversation of its own. Empty tables give no rows; extra columns are ignored; texts are whole. A text's hash (MD5) stands for
it where repeats are looked for.
"""

from __future__ import annotations

import hashlib
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns

#: Rows of a block that is looked up at once, and of a chunk at most (as a power of two).
BLOCK, LOG2_CHUNK = 4, 12
KEEP, RENAME, DELETE, INSERT, CUT = 0, 3, 4, 3, 3

#: States of the order so far, and what a kept turn of each initial leads to. A new turn can only be the one that is due.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DUE = [USER, USER, ASSISTANT, USER]
LEGAL_PAIRS = {"su", "ua", "au"}

#: Characters that leave a text blank, and those that end a whole one.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"

#: A row's kind. Its code is 3 * (place of its initial in INITIALS, 3 for others) + kind.
FINE, TRUNCATED, GONE = range(3)
#: Symbols: 2 * initial + kind for rows that may stay, one for those that have to go, one for no row at all.
_GONE, _NONE = 8, 9
_FAR = 1 << 20


class Tables(NamedTuple):
    """vectors; step, fee by (symbol, vector); block_step, block_fee by (block, vector); edits and state by (symbol, vector, state)."""

    vectors: np.ndarray
    step: np.ndarray
    fee: np.ndarray
    block_step: np.ndarray
    block_fee: np.ndarray
    edits: np.ndarray
    state: np.ndarray
    texts: list[tuple[str, str]]


def _before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Costs before a row, of those after it."""
    if symbol == _NONE:
        return list(after)
    costs = [DELETE + v for v in after]
    if symbol != _GONE:
        penalty, initial = CUT * (symbol & 1), INITIALS[symbol >> 1 : (symbol >> 1) + 1]
        for state in range(4):
            ways = [RENAME + penalty + after[DUE[state]]]
            if state in KEPT.get(initial, {}):
                ways.append(KEEP + penalty + after[KEPT[initial][state]])
            costs[state] = min(costs[state], *ways)
    return _inserted(costs)


def _inserted(costs: list[int]) -> list[int]:
    for _ in range(2):
        costs = [min(c, INSERT + costs[DUE[state]]) for state, c in enumerate(costs)]
    return costs


def _norm(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c < _FAR else _FAR for c in costs), min(least, _FAR)


def _choose(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, str, int]:
    """Edits up to and with a row, the roles that they give (* for the row's own, - for none), and the state behind it."""
    before, edits, roles = _before(symbol, after), "", ""
    while symbol != _NONE and before[state] < _FAR:
        left, due = before[state], DUE[state]
        penalty, initial = CUT * (symbol & 1), INITIALS[symbol >> 1 : (symbol >> 1) + 1]
        if DELETE + after[state] == left:
            return edits + "D", roles + "-", state
        if INSERT + before[due] == left:
            edits, roles, state = edits + "I", roles + "ua"[due - USER], due
        elif state in KEPT.get(initial, {}) and KEEP + penalty + after[KEPT[initial][state]] == left:
            return edits + "K", roles + "*", KEPT[initial][state]
        else:
            return edits + "R", roles + "ua"[due - USER], due
    return "", "", state


#: Costs at the end: nothing and an assistant's turn may be last.
END = tuple(_inserted([0, _FAR, _FAR, 0]))
#: What is inserted at the end, by state.
ENDING = [("", ""), ("II", "ua"), ("I", "a"), ("", "")]


@cache
def tables() -> Tables:
    """All vectors that any rows can lead to, from the end or from one state alone, and the tables over them."""
    exits = [tuple(0 if i == state else _FAR for i in range(4)) for state in range(4)]
    vectors = [_norm(list(END))[0], *[_norm(_inserted(list(v)))[0] for v in exits]]
    number, step, fee = {v: i for i, v in reversed(list(enumerate(vectors)))}, [], []
    at = 0
    while at < len(vectors):
        rows = [_norm(_before(symbol, vectors[at])) for symbol in range(10)]
        for v, _ in rows:
            if v not in number:
                number[v] = len(vectors)
                vectors.append(v)
        step.append([number[v] for v, _ in rows])
        fee.append([f for _, f in rows])
        at += 1
    one, cost = np.array(step, np.int16).T.copy(), np.array(fee, np.int32).T.copy()
    blocks = np.arange(10**BLOCK)
    now, taken = np.tile(np.arange(len(vectors), dtype=np.int16), (len(blocks), 1)), np.zeros((len(blocks), len(vectors)), np.int32)
    for place in range(BLOCK):  # the last row of a block is its last digit
        symbol = (blocks // 10**place % 10)[:, None]
        taken += cost[symbol, now]
        now = one[symbol, now]
    texts: dict[tuple[str, str], int] = {}
    chosen = [[[_choose(symbol, v, state) for state in range(4)] for v in vectors] for symbol in range(10)]
    edits = np.array([[[texts.setdefault(c[:2], len(texts)) for c in row] for row in rows] for rows in chosen], np.int16)
    return Tables(np.array(vectors), one, cost, now, np.minimum(taken, _FAR), edits, np.array([[[c[2] for c in row] for row in rows] for rows in chosen], np.int8), list(texts))


def _symbols(codes: np.ndarray) -> np.ndarray:
    initial, kind = np.divmod(codes, 3)
    return np.where(kind == GONE, _GONE, 2 * initial + kind)


def _blocks(symbols: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of chunks laid out as whole blocks, no rows in front: (symbols by block, block bounds of chunks, each row's place)."""
    n = np.diff(cut)
    size = -(-n // BLOCK)
    bounds = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(len(symbols)) + np.repeat(bounds[1:] * BLOCK - cut[1:], n)
    laid = np.full(bounds[-1] * BLOCK, _NONE)
    laid[place] = symbols
    return laid.reshape(-1, BLOCK), bounds, place


def pull(laid: np.ndarray, bounds: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Look up the blocks of all chunks from last to first. ``vector`` has a line of vectors behind each chunk; returned are those before
    it, what they cost, and the vectors behind each block."""
    t, codes = tables(), laid @ 10 ** np.arange(BLOCK - 1, -1, -1)
    vector, cost = vector.copy(), np.zeros(vector.shape, np.int64)
    behind = np.zeros((len(laid), vector.shape[1]), np.int16)
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    for k in range(int(size.max(initial=0))):
        own = order[: np.searchsorted(-size[order], -k)]
        block = bounds[own + 1] - 1 - k
        behind[block] = vector[own]
        code = codes[block][:, None]
        cost[own] += t.block_fee[code, vector[own]]
        vector[own] = t.block_step[code, vector[own]]
    return vector, cost, behind


def expand(codes: np.ndarray, cut: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's symbol and the vector behind it; ``vector`` is behind each chunk."""
    t, symbols = tables(), _symbols(codes)
    laid, bounds, place = _blocks(symbols, cut)
    now = pull(laid, bounds, vector[:, None])[2][:, 0]
    behind = np.zeros(laid.shape, np.int16)
    for j in range(BLOCK - 1, -1, -1):
        behind[:, j] = now
        now = t.step[laid[:, j], now]
    return symbols, behind.ravel()[place]


def walk(symbols: np.ndarray, behind: np.ndarray, cut: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before each row and after each chunk, of a line of states before each chunk."""
    t, state = tables(), state.copy()
    before = np.zeros((len(symbols), state.shape[1]), np.int8)
    size = np.diff(cut)
    order = np.argsort(-size, kind="stable")
    for k in range(int(size.max(initial=0))):
        own = order[: np.searchsorted(-size[order], -k)]
        row = cut[own] + k
        before[row] = state[own]
        state[own] = t.state[symbols[row][:, None], behind[row][:, None], state[own]]
    return before, state


def _chunks(batch):
    """Codes and bounds of the chunks in a batch."""
    rows = batch.column("rows")
    cut = rows.offsets.to_numpy()
    return rows.flatten().field("code").to_numpy(zero_copy_only=False).astype(np.int64), (cut - cut[0]).astype(np.int64)


def _lists(values: np.ndarray, kind):
    import pyarrow as pa

    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), kind), values.shape[1]).cast(pa.list_(kind))


def _summed(batches):
    """What a chunk costs from each state to each other, and its first and last initials."""
    import pyarrow as pa

    t = tables()
    for batch in batches:
        codes, cut = _chunks(batch)
        laid, bounds, _ = _blocks(_symbols(codes), cut)
        vector, cost, _ = pull(laid, bounds, np.tile(np.arange(1, 5, dtype=np.int16), (len(batch), 1)))
        costs = np.minimum(t.vectors[vector].transpose(0, 2, 1) + cost[:, None, :], _FAR).reshape(len(batch), 16)
        ends = [pa.array(codes[at] // 3, pa.int32()) for at in (cut[:-1], cut[1:] - 1)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), _lists(costs, pa.int32()), *ends], ["conv_id", "chunk", "costs", "first", "last"])


def _composed(batches):
    """From a conversation's last chunk to its first: the vector behind each."""
    import pyarrow as pa

    number = {tuple(v): i for i, v in reversed(list(enumerate(tables().vectors.tolist())))}
    own, costs = object(), list(END)
    for batch in batches:
        vectors, lasts = [], []
        for conv, matrix in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            lasts.append(conv != own)
            if conv != own:
                own, costs = conv, list(END)
            vectors.append(number[_norm(costs)[0]])
            costs = list(_norm([min(matrix[4 * p + q] + costs[q] for q in range(4)) for p in range(4)])[0])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(vectors, pa.int32()), pa.array(lasts)], ["conv_id", "chunk", "vector", "is_last"])


def _exits(batches):
    """The state behind a chunk for each one before it."""
    import pyarrow as pa

    for batch in batches:
        codes, cut = _chunks(batch)
        symbols, behind = expand(codes, cut, batch.column("vector").to_numpy().astype(np.int16))
        exits = walk(symbols, behind, cut, np.tile(np.arange(4), (len(batch), 1)))[1]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "chunk", "vector", "is_last")], _lists(exits, pa.int32()), batch.column("last")], ["conv_id", "chunk", "vector", "is_last", "exits", "last"])


def _entered(batches):
    """From a conversation's first chunk to its last: the state before each, and the initial before it (4 for none)."""
    import pyarrow as pa

    own, state, initial = object(), NOTHING, 4
    for batch in batches:
        states, initials = [], []
        for conv, exits, last in zip(batch.column("conv_id").to_pylist(), batch.column("exits").to_pylist(), batch.column("last").to_pylist(), strict=True):
            if conv != own:
                own, state, initial = conv, NOTHING, 4
            states.append(state)
            initials.append(initial)
            state, initial = exits[state], last
        kept = [batch.column(c) for c in ("conv_id", "chunk", "vector", "is_last")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(states, pa.int32()), pa.array(initials, pa.int32())], ["conv_id", "chunk", "vector", "is_last", "state", "initial"])


def _edited(batches):
    """Each row's edits, the roles they give, the inserts behind the last row, and whether it may follow the row before it."""
    import pyarrow as pa

    t = tables()
    legal = np.array([["sua-"[a : a + 1] + "sua-"[b] in LEGAL_PAIRS for b in range(4)] for a in range(5)])
    edits, roles = (np.array([pair[i] for pair in t.texts], object) for i in range(2))
    for batch in batches:
        codes, cut = _chunks(batch)
        symbols, behind = expand(codes, cut, batch.column("vector").to_numpy().astype(np.int16))
        before, after = walk(symbols, behind, cut, batch.column("state").to_numpy().astype(np.int64)[:, None])
        chosen = t.edits[symbols, behind, before[:, 0]]
        initial = codes // 3
        previous = np.concatenate(([4], initial[:-1]))[: len(codes)]
        previous[cut[:-1]] = batch.column("initial").to_numpy()
        last = np.full(len(codes), NOTHING)
        last[cut[1:] - 1] = np.where(batch.column("is_last").to_numpy(zero_copy_only=False), after[:, 0], NOTHING)
        ending = [np.array([e[i] for e in ENDING], object)[last] for i in range(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rows").flatten().field("at"), *[pa.array(x, pa.string()) for x in (edits[chosen], roles[chosen], *ending)], pa.array(legal[previous, initial])],
            ["at", "edits", "roles", "ending", "ending_roles", "follows"],
        )


def _scan(df: DataFrame, order: Column, step, schema: str) -> DataFrame:
    """A conversation's chunks in one order, streamed through ``step``; each is a few numbers."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(step, schema)


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the second table's keys go."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = one if on is None else on & one
    return a.join(other, on, how).drop(*[f"_{k}" for k in keys])


def faults(turns: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with ``copies`` and ``fault``: what the first of the copies is, blank, duplicate, truncated or
    nothing. Further copies are duplicates, or blank."""
    rows = with_columns(turns, ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))
    counted = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(counted.withColumn("digest", F.md5("text")))
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    seen = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # most texts stand once in a conversation, so few rows meet anything
    rows = _same(rows, seen, ("conv_id", "role", "digest"), "left")
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    again = F.coalesce(F.col("earliest") != place, F.lit(False))
    fault = F.when(last == "", "blank").when(again, "duplicate").when(~last.isin(*STOPS), "truncated").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def repair(turns: DataFrame) -> DataFrame:
    """One row for each distinct row of the conversations, in the order of ``at``: conv_id, at, turn, role, text, copies, fault;
    ``edits`` up to and with it and the roles that they give (``roles``, aligned: u, a, * for its own, - for none), all
    further copies deleted; ``ending`` and ``ending_roles``, inserted behind a conversation's last row; ``follows``: may stand behind the row before."""
    marked = materialize(faults(turns))
    order = ("conv_id", "turn", "role")
    # the first characters deal rows of one turn to several tasks; within a task whole texts decide
    dealt = marked.withColumn("_head", F.substring("text", 1, 100)).repartitionByRange(*order, "_head").sortWithinPartitions(*order, "text")
    rows = materialize(dealt.drop("_head").withColumn("at", F.monotonically_increasing_id()))
    initial = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in INITIALS]), F.substring("role", 1, 1)) - 1, F.lit(-1))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(FINE)
    code = 3 * F.when(initial < 0, len(INITIALS)).otherwise(initial) + kind
    chunk = F.shiftright("at", LOG2_CHUNK)
    listed = F.sort_array(F.collect_list(F.struct("at", code.cast("int").alias("code"))))
    chunks = materialize(rows.groupBy("conv_id", chunk.alias("chunk")).agg(listed.alias("rows")))
    key = "conv_id long, chunk long, "
    summed = materialize(chunks.mapInArrow(_summed, key + "costs array<int>, first int, last int"))
    vectors = materialize(_scan(summed.select("conv_id", "chunk", "costs"), F.desc("chunk"), _composed, key + "vector int, is_last boolean"))
    marks = _same(vectors, summed.select("conv_id", "chunk", "last"), ("conv_id", "chunk"))
    exits = _same(chunks, marks, ("conv_id", "chunk")).mapInArrow(_exits, key + "vector int, is_last boolean, exits array<int>, last int")
    entered = materialize(_scan(exits, F.asc("chunk"), _entered, key + "vector int, is_last boolean, state int, initial int"))
    edited = _same(chunks, entered, ("conv_id", "chunk")).mapInArrow(_edited, "at long, edits string, roles string, ending string, ending_roles string, follows boolean")
    return rows.join(materialize(edited), "at")


def turns_of(edits: Column, roles: Column, role: Column, text: Column) -> Column:
    """The turns (role, text) that a row's edits leave or insert."""
    given = F.split(roles, "")
    made = F.transform(
        F.split(edits, ""),
        lambda e, i: F.when(e == "", None).otherwise(
            F.struct(
                F.when(given[i] == "*", role).when(given[i] == "u", "user").when(given[i] == "a", "assistant").alias("role"),
                F.when(e == "I", "").otherwise(text).alias("text"),
            )
        ),
    )
    return F.filter(made, lambda t: t.isNotNull() & t["role"].isNotNull())


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, at, place (turns of one ``at`` in order), role, text."""
    both = F.concat(turns_of(F.col("edits"), F.col("roles"), F.col("role"), F.col("text")), turns_of(F.col("ending"), F.col("ending_roles"), F.col("role"), F.col("text")))
    return repaired.select("conv_id", "at", F.posexplode(both).alias("place", "t")).select("conv_id", "at", "place", "t.role", "t.text")


def _hashed(batches):
    """A conversation's edits and the hash of its repaired turns, row by row."""
    import pyarrow as pa

    own, out = object(), None

    def done():
        return (own, "".join(out[0]), out[1].hexdigest())

    for batch in batches:
        ready = []
        for conv, edits, piece in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edits", "piece")], strict=True):
            if conv != own:
                if out is not None:
                    ready.append(done())
                own, out = conv, ([], hashlib.sha256(), False)
            out[0].append(edits)
            if piece is not None:
                out[1].update(("\n" if out[2] else "").encode() + piece.encode())
                out = (*out[:2], True)
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*ready, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "audit", "repaired_sha256"])
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(), (pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "audit", "repaired_sha256"])


def digest(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each conv_id of ``ids``: counts of faults, cost, the edits' initials and the repaired conversation's hash.

    A hash has to read its input in order, so a conversation's rows pass one task, one at a time; nothing of them is held but the initials."""
    n, fault = F.col("copies"), F.col("fault")
    made = F.length(F.translate(F.concat("edits", "ending"), "KD", ""))
    gone = F.length(F.translate("edits", "IKR", ""))
    cost = F.sum(INSERT * made + DELETE * (gone + n - 1) + F.when((fault == "truncated") & (gone == 0), CUT).otherwise(0))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = repaired.groupBy("conv_id").agg(
        gaps.alias("gaps"),
        F.sum(F.when(fault == "blank", n).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "blank", 0).when(fault == "duplicate", n).otherwise(n - 1)).alias("duplicate"),
        F.count_if(fault == "truncated").alias("truncated"),
        (F.sum(n) - 1 - F.sum(F.col("follows").cast("long"))).alias("illegal"),
        cost.alias("cost"),
    )
    turns = F.concat(turns_of(F.col("edits"), F.col("roles"), F.col("role"), F.col("text")), turns_of(F.col("ending"), F.col("ending_roles"), F.col("role"), F.col("text")))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    rows = repaired.select("conv_id", "at", F.concat("edits", F.repeat(F.lit("D"), (n - 1).cast("int")), "ending").alias("edits"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("piece"))
    audits = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    every = with_columns(ids, ("conv_id", "long")).distinct()
    out = _same(_same(every, counts, ("conv_id",), "left"), audits, ("conv_id",), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, the same ones each time, by the remainder of crc32(conv_id:turn) by 20: 0 drops a row, 1 empties its text, 2 takes
    its full stops, 3 repeats it, 4 gives it to the user. Nulls are one space, but for the ids and turns that are returned."""
    rows = with_columns(conversations, ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    role, text, hit = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("_hit")
    copies = F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))
    return (
        rows.withColumn("_hit", F.crc32(key.cast("binary")) % 20)
        .filter("_hit != 0")
        .select(
            "conv_id",
            "turn",
            F.when(hit == 4, "user").otherwise(role).alias("role"),
            F.when(hit == 1, "").when(hit == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
            F.explode(copies).alias("_copy"),
        )
        .drop("_copy")
    )
