"""Structured Streaming: message streams, sessions, windows and the online baseline."""

from __future__ import annotations

import json
import math
import uuid
from collections import namedtuple
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from ..operators.emotion import RUN, Baseline
from ..operators.evidence import ACTIONS, Book
from ..operators.tables import scratch


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/stream-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str, files: int = 64) -> DataFrame:
    """A table, a Parquet file or a folder of them, as a stream of at most ``files`` files a batch: what a batch brings for one key, and
    so what a stateful fold has to order, is bounded by them."""
    path = f"{sf_dir}/{name}.parquet"
    static = spark.read.parquet(path)
    single = static.inputFiles()[0].endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(path)


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there and return every batch's rows with ``batch_id``. State and results are in the shared folder."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers and lists need it
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    spark.createDataFrame([], schema).write.parquet(f"{folder}/out/none")

    def put(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/{batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key of an update stream."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in rest])


def unique_messages(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages once each, by chat and id, with late rows within the delay; later ones are left to a batch repair."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["chat_id", "msg_id"])


def silence_sessions(messages: DataFrame, gap: str = "20 minutes") -> DataFrame:
    """Runs of messages of a chat with less than the gap between them; the same on a batch or a stream."""
    s = messages.groupBy("chat_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("chat_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_counts(events: DataFrame, key: str, at: str = "ts", every: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by tumbling, or sliding, windows."""
    g = events.groupBy(F.window(at, every, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), key, "n")


def fold(stream: DataFrame, keys: list[str], order: list[str], make, step, schema: str) -> DataFrame:
    """A fold over each key's rows in time, with its state between batches: ``make(state or None)`` gives an object with ``state()``,
    ``step(object, key, row)`` rows of the result. Only the columns used are held while a batch's rows of a key are put in order."""
    names = [part.split()[0] for part in schema.split(",")]
    Row = namedtuple("Row", [c for c in stream.columns if c not in keys])  # noqa: N806

    def run(key, batches, state):
        import pandas as pd

        own = make(json.loads(state.get[0]) if state.exists else None)
        frames = list(batches)
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        place = np.lexsort([rows[c].to_numpy() for c in reversed(order)])  # a frame sorted by several columns takes longer than the fold of a small key
        out = [(*key, *line) for r in map(Row._make, zip(*[rows[c].to_numpy()[place].tolist() for c in Row._fields], strict=True)) for line in step(own, r)]
        state.update((json.dumps(own.state()),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def online_baseline(stream: DataFrame) -> DataFrame:
    """Each observation's z against its owner's baseline so far; the state lives between batches. Input: owner_id, dim, obs_id, y,
    slot, hours."""
    return fold(stream, ["owner_id", "dim"], ["hours", "obs_id"], Baseline, lambda own, r: [(r.obs_id, *own.step(r.y, r.hours, r.slot))], RUN)


class Timed(StatefulProcessor):
    """Rows of a key in time, over state that is a list of rows, with one timer of the event time at the next moment when something is due.

    ``make(rows)`` gives an object with ``rows()``, ``next()`` (seconds, or None) and ``due(now)``, rows of the result that are due by
    then; ``step(object, row)`` gives those of a row, once all that was due before it is out. Rows of one batch are put in order; a
    batch's rows come after those of earlier batches, or after the watermark."""

    #: Rows of a frame, read or returned.
    FRAME = 10000

    def __init__(self, make, state: str, step, order: list[str], schema: str, rows) -> None:
        """``rows`` is the Arrow schema of the columns that are used."""
        self.make, self.schema, self.step, self.order, self.rows = make, state, step, order, rows
        self.columns = [part.split()[0] for part in schema.split(", ")]

    def init(self, handle) -> None:
        self.handle, self.kept = handle, handle.getListState("kept", self.schema)

    def _end(self, key, own, out):
        rows, due = own.rows(), own.next()
        self.kept.put(rows) if rows else self.kept.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(math.ceil(due * 1000))
        if out:
            yield self._frame(key, out)

    def _frame(self, key, out):
        import pandas as pd

        return pd.DataFrame([(*key, *line) for line in out], columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows, timerValues):
        """A batch's rows of the key are held as Arrow columns, which take a few bytes each, and are frames and objects but a few at a time."""
        import pyarrow as pa

        own, out = self.make(list(self.kept.get())), []
        held = pa.concat_tables([pa.Table.from_pandas(frame[self.rows.names], self.rows, preserve_index=False) for frame in rows])
        for part in held.sort_by([(c, "ascending") for c in self.order]).to_batches(self.FRAME):
            for r in part.to_pandas().itertuples(index=False):
                out += own.due(float(r.at))
                out += self.step(own, r)
            if len(out) >= self.FRAME:
                yield self._frame(key, out)
                out = []
        yield from self._end(key, own, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        own = self.make(list(self.kept.get()))
        yield from self._end(key, own, own.due(expiredTimerInfo.getExpiryTimeInMs() / 1000))

    def close(self) -> None:
        pass


def timed(stream: DataFrame, key: str, delay: str, make, state: str, step, order: list[str], schema: str) -> DataFrame:
    """``Timed`` over a stream with ``at`` in seconds; timers fire when the watermark, ``delay`` behind the latest row of any key, has passed them. Rows that are no later than the watermark are
    dropped, so that a delay of nothing suits a single batch alone."""
    used = to_arrow_schema(stream.drop(key).schema)
    rows = stream.withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(Timed(make, state, step, order, schema, used), schema, "append", "eventTime")


class Pending:
    """A chat's messages that wait for extraction, and when they go: at 100; at 30 where the last that went is four hours old or none
    went yet; after twenty minutes' silence with a word of strong emotion, or at 60. They go in batches of 60."""

    FORCE, STALE, STALE_SECONDS, SILENT, SILENCE_SECONDS, BATCH = 100, 30, 4 * 3600, 60, 20 * 60, 60

    def __init__(self, rows: list[tuple] = ()) -> None:
        """Rows are (at, id, strong); the last message that went is kept as one without an id."""
        self.went = next((at for at, id_, _ in rows if id_ is None), None)
        self.waiting = [tuple(r) for r in rows if r[1] is not None]

    def rows(self) -> list[tuple]:
        return [*([] if self.went is None else [(self.went, None, None)]), *self.waiting]

    def _stale(self) -> float | None:
        """Since when enough messages are too old."""
        if len(self.waiting) < self.STALE:
            return None
        return self.waiting[-1][0] if self.went is None else max(self.went + self.STALE_SECONDS, self.waiting[-1][0])

    def _silent(self) -> float | None:
        some = self.waiting and (len(self.waiting) >= self.SILENT or any(strong for *_, strong in self.waiting))
        return self.waiting[-1][0] + self.SILENCE_SECONDS if some else None

    def next(self) -> float | None:
        return min((x for x in (self._stale(), self._silent()) if x is not None), default=None)

    def due(self, now: float) -> list[tuple]:
        """(reason, first message, last message, number) of the batches that are due."""
        when, stale = self.next(), self._stale()
        if len(self.waiting) >= self.FORCE:
            why = "force"
        elif when is None or when > now:
            return []
        else:
            why = "stale" if stale is not None and stale <= when else "emotion" if any(strong for *_, strong in self.waiting) else "silence"
        ids, self.went, self.waiting = [r[1] for r in self.waiting], self.waiting[-1][0], []
        return [(why, part[0], part[-1], len(part)) for part in (ids[i : i + self.BATCH] for i in range(0, len(ids), self.BATCH))]

    def arrive(self, at: float, id_: int, strong: bool) -> list[tuple]:
        self.waiting.append((at, id_, strong))
        return self.due(at)


BATCHES = "chat_id long, reason string, first_id long, last_id long, n long"


def extraction_batches(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The batches of messages (chat_id, msg_id, at in seconds, strong) that are due for extraction. A chat that falls silent needs no further
    message: its timer fires when the watermark has passed."""
    step = lambda own, r: own.arrive(float(r.at), int(r.msg_id), bool(r.strong))
    return timed(stream, "chat_id", delay, Pending, "at double, id long, strong boolean", step, ["at", "msg_id"], BATCHES)


class Recent:
    """Items and when they were last put, each for half an hour, at most ``size`` of them. What is older goes with the next row or by
    the timer."""

    SECONDS = 1800

    def __init__(self, rows: list[tuple] = (), size: int | None = None) -> None:
        self.items, self.size = [tuple(r) for r in rows], size

    def rows(self) -> list[tuple]:
        return self.items

    def next(self) -> float | None:
        """Just after the last item's half hour."""
        return self.items[-1][0] + self.SECONDS + 0.001 if self.items else None

    def due(self, now: float) -> list[tuple]:
        self.items = [x for x in self.items if now - x[0] <= self.SECONDS]
        return []

    def put(self, at: float, item: int) -> int:
        self.due(at)
        self.items = [*[x for x in self.items if x[1] != item], (at, item)]
        self.items = self.items[-self.size :] if self.size else self.items
        return len(self.items)

    def known(self) -> list[int]:
        return sorted(item for _, item in self.items)


def working_pool(stream: DataFrame, size: int = 5, delay: str = "10 minutes") -> DataFrame:
    """For each injection (owner_id, obs_id, at in seconds) how many items the owner's pool then holds."""
    step = lambda own, r: [(int(r.obs_id), own.put(float(r.at), int(r.obs_id)))]
    return timed(stream, "owner_id", delay, partial(Recent, size=size), "at double, item long", step, ["at", "obs_id"], "owner_id long, obs_id long, pool long")


def entity_cache(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """For each message (owner_id, msg_id, at in seconds, entity_ids) the entities that are still known from the last half hour, as a list; those
    that it names itself are known from then on."""

    def step(own, r):
        known = own.known()
        for entity in [] if r.entity_ids is None else r.entity_ids:
            own.put(float(r.at), int(entity))
        return [(int(r.msg_id), known)]

    return timed(stream, "owner_id", delay, Recent, "at double, item long", step, ["at", "msg_id"], "owner_id long, msg_id long, known array<long>")


class Current(Book):
    """An owner's current states; one whose time has come ends by itself."""

    FIELDS = ("id", "at", "by", "until", "tokens", "words")
    SCHEMA = "id long, at double, by string, until double, tokens array<string>, words array<string>"

    def __init__(self, rows: list[tuple] = ()) -> None:
        super().__init__([dict(zip(self.FIELDS, [list(x) if k in ("tokens", "words") else x for k, x in zip(self.FIELDS, r, strict=True)], strict=True)) for r in rows])

    def rows(self) -> list[tuple]:
        return [tuple(x[k] for k in self.FIELDS) for x in self.states]

    def next(self) -> float | None:
        return min((x["until"] for x in self.states if x["until"] is not None), default=None)

    def due(self, now: float) -> list[tuple]:
        ended = [x["id"] for x in self.states if x["until"] is not None and x["until"] <= now]
        self.expire(now)
        return [(None, "expired", id_, None) for id_ in ended]


def current_states(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """What each statement does to its owner's current states, and the states' ends (action ``expired``, no statement). Input as of
    ``evidence.statements``."""

    def step(own, r):
        ttl = None if r.ttl is None or r.ttl != r.ttl else float(r.ttl)
        return [(int(r.statement_id), *own.add(int(r.statement_id), float(r.at), r.by, list(r.tokens), list(r.words), ttl))]

    return timed(stream, "owner_id", delay, Current, Current.SCHEMA, step, ["at", "statement_id"], ACTIONS)


class Idle:
    """When an owner last wrote, and when something last surfaced: after six hours without a message, once in seven days."""

    GAP, COOLDOWN = 6 * 3600, 7 * 86400

    def __init__(self, state: dict | None = None) -> None:
        self.last, self.fired = (state or {}).get("times", (None, None))

    def state(self) -> dict:
        return {"times": (self.last, self.fired)}

    def write(self, at: float) -> bool:
        idle = self.last is not None and at - self.last >= self.GAP and (self.fired is None or at - self.fired >= self.COOLDOWN)
        self.last, self.fired = at, at if idle else self.fired
        return idle


def idle_triggers(stream: DataFrame) -> DataFrame:
    """The messages (owner_id, msg_id, at in seconds) after which something may surface by itself."""
    return fold(stream, ["owner_id"], ["at", "msg_id"], Idle, lambda own, r: [(int(r.msg_id), float(r.at))] if own.write(float(r.at)) else [], "owner_id long, msg_id long, at double")
