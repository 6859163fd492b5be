"""Table maintenance: upserts, life cycle, usage, windows over messages. All set-based; ``now`` is always given."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], mode: str = "merge") -> DataFrame:
    """merge: rows of ``updates`` replace those of the same key; ignore: only new keys are added."""
    if mode == "ignore":
        return target.unionByName(updates.join(target.select(keys), keys, "left_anti"))
    return target.join(updates.select(keys), keys, "left_anti").unionByName(updates)


def days_before(now: Column, n: float) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now) - F.lit(int(n * 86400)))


def fragment_gc(df: DataFrame, now: Column, cooling: int = 14, frozen: int = 30, tombstone: int = 90) -> DataFrame:
    """active, cooling, frozen, tombstone: in this order within one run; a row that moved carries ``now`` and waits there."""
    quiet = (F.coalesce("cited_count", F.lit(0)) == 0) & (F.col("last_accessed_at").isNull() | (F.col("last_accessed_at") < days_before(now, cooling)))
    touched = (F.coalesce("cited_count", F.lit(0)) > 0) | F.coalesce(F.col("last_accessed_at") > F.col("lifecycle_updated_at"), F.lit(False))
    steps = [
        ("active", "cooling", quiet & (F.col("created_at") < days_before(now, cooling))),
        ("cooling", "active", touched),
        ("cooling", "frozen", F.col("lifecycle_updated_at") < days_before(now, frozen)),
        ("frozen", "tombstone", F.col("lifecycle_updated_at") < days_before(now, tombstone)),
    ]

    def step(rows: DataFrame, rule: tuple[str, str, Column]) -> DataFrame:
        moved = F.coalesce((F.col("status") == rule[0]) & rule[2], F.lit(False))
        out = {"status": F.when(moved, rule[1]).otherwise(F.col("status")), "lifecycle_updated_at": F.when(moved, now).otherwise(F.col("lifecycle_updated_at"))}
        if rule[1] == "tombstone":
            out["content"] = F.when(moved, "[expired]").otherwise(F.col("content"))
        return rows.withColumns(out)

    return reduce(step, steps, df)


def episode_decay(df: DataFrame, now: Column, mature_months: int = 6, archive_months: int = 12) -> DataFrame:
    """permanent to mature at half the weight (1 at least), mature to archived; flash episodes take twice as long."""
    flash = F.when(F.coalesce(F.col("consolidation_type") == "flash", F.lit(False)), 2).otherwise(1)
    limit = lambda months: F.timestamp_seconds(F.unix_timestamp(now) - flash * months * 30 * 86400)
    old = lambda c, m: F.col(c).isNull() | (F.col(c) < limit(m))
    matured = (F.col("status") == "permanent") & old("last_accessed_at", mature_months) & old("updated_at", mature_months)
    first = df.withColumns({"status": F.when(matured, "mature").otherwise(F.col("status")), "weight": F.when(matured, F.greatest(F.lit(1.0), F.col("weight") / 2)).otherwise(F.col("weight")), "updated_at": F.when(matured, now).otherwise(F.col("updated_at"))})
    gone = F.coalesce((F.col("status") == "mature") & (F.col("updated_at") < limit(archive_months)), F.lit(False))
    return first.withColumns({"status": F.when(gone, "archived").otherwise(F.col("status")), "updated_at": F.when(gone, now).otherwise(F.col("updated_at"))})


def episode_weight(created: Column, accessed: Column, now: Column) -> Column:
    """5, plus 2 or 1 for an access within 7 or 30 days, less 0.5 for each full 30 days; cut to 2..8 and truncated."""
    bonus = F.when(accessed > days_before(now, 7), 2).when(accessed > days_before(now, 30), 1).otherwise(0)
    months = F.floor((F.unix_timestamp(now) - F.coalesce(F.unix_timestamp(created), F.unix_timestamp(now))) / (30 * 86400))
    raw = 5 + bonus - months * 0.5
    return F.when(raw < 2, 2).when(raw > 8, 8).otherwise(raw.cast("int"))


def cap_states(model: DataFrame, most: int = 12) -> DataFrame:
    """Active states beyond ``most`` for an owner are resolved: the oldest first, the companion's own last."""
    active = (F.col("type") == "current_state") & (F.col("status") == "active")
    over = Window.partitionBy("owner_id", active)
    order = over.orderBy((F.col("created_by") == "chat_companion").cast("int"), "created_at", "entry_id")
    excess = active & (F.row_number().over(order) <= F.count(F.lit(1)).over(over) - most)
    return model.withColumn("status", F.when(excess, "resolved").otherwise(F.col("status")))


def pattern_states(patterns: DataFrame, now: Column) -> DataFrame:
    """dormant after 30 days unseen, active again when seen, archived after 180 at a confidence under 0.40."""
    days = (F.unix_timestamp(now) - F.unix_timestamp("last_seen")) / 86400
    new = F.when((days > 180) & (F.col("confidence") < 0.4) & F.col("status").isin("active", "dormant"), "archived").when((F.col("status") == "active") & (days > 30), "dormant").when((F.col("status") == "dormant") & (days <= 30), "active")
    return patterns.withColumn("status", F.coalesce(new, F.col("status")))


def usage(fragments: DataFrame, events: DataFrame) -> DataFrame:
    """Counters of fragments plus those of an event log (fragment_id, kind: injected, cited or read, at)."""
    sums = events.groupBy("fragment_id").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("injected", "cited", "read")], F.max("at").alias("_at"))
    out = fragments.join(sums, "fragment_id", "left")
    more = {f"{k}_count": F.coalesce(f"{k}_count", F.lit(0)) + F.coalesce(f"_{k}", F.lit(0)) for k in ("injected", "cited", "read")}
    return out.withColumns(more).withColumn("last_accessed_at", F.greatest("last_accessed_at", "_at")).drop("_injected", "_cited", "_read", "_at")


def make_batches(messages: DataFrame, size: int = 60, context: int = 10) -> DataFrame:
    """Messages of a chat in batches of ``size`` by (ts, msg_id); a message is also context of the next batch if among the last
    ``context`` before it. Columns batch, place (0-based) and is_context."""
    w = Window.partitionBy("chat_id").orderBy("ts", "msg_id")
    n = F.row_number().over(w) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy("chat_id"))
    rows = messages.withColumn("_n", n).withColumn("_total", total)
    own = F.floor(F.col("_n") / size)
    spots = F.when((F.col("_n") % size >= size - context) & ((own + 1) * size < F.col("_total")), F.array(own, own + 1)).otherwise(F.array(own))
    out = rows.withColumn("_own", own).withColumn("batch", F.explode(spots))
    return out.withColumns({"place": F.col("_n") - F.col("batch") * size, "is_context": F.col("batch") > F.col("_own")}).drop("_n", "_total", "_own")


def fill_timestamps(messages: DataFrame, now: Column) -> DataFrame:
    """A missing ts is taken from the next message that has one (else ``now``), a second earlier for each message between."""
    after = Window.partitionBy("chat_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    ahead = F.first(F.when(F.col("ts").isNotNull(), F.struct("pos", "ts")), ignorenulls=True).over(after)
    last = F.max("pos").over(Window.partitionBy("chat_id"))
    base = F.coalesce(F.unix_timestamp(ahead["ts"]), F.unix_timestamp(now))
    return messages.withColumn("ts", F.coalesce("ts", F.timestamp_seconds(base - (F.coalesce(ahead["pos"], last + 1) - F.col("pos")))))


def idle_gaps(messages: DataFrame, hours: float = 6) -> DataFrame:
    """Messages of an owner that come at least so long after the one before."""
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("owner_id").orderBy("ts", "msg_id")))
    return messages.withColumn("gap_s", gap).filter(F.col("gap_s") >= hours * 3600)


def context_window(messages: DataFrame, n: int = 2) -> DataFrame:
    """The ids of the n messages before and after each."""
    near = F.collect_list("msg_id").over(Window.partitionBy("chat_id").orderBy("ts", "msg_id").rowsBetween(-n, n))
    return messages.withColumn("around", near)


def list_page(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """One page, rows ranked from 1. Ranking follows a range sort; only the page's rows meet in one task."""
    cut = df.orderBy(*order).limit(page * limit).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return cut.filter(F.col("position") > (page - 1) * limit)


def fragment_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("emotional_weight"), 2).alias("mean_weight"))


def months(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def summaries_due(messages: DataFrame, summaries: DataFrame, interval: int = 50) -> DataFrame:
    """Chats with at least ``interval`` assistant messages since their last summary, and the next round's number."""
    last = summaries.groupBy("chat_id").agg(F.max("end_message_id").alias("last_id"), F.max("round_end").alias("last_round"))
    since = messages.join(last, "chat_id", "left").filter((F.col("sender") == "ai") & (F.col("msg_id") > F.coalesce("last_id", F.lit(-1))))
    return since.groupBy("chat_id").agg(F.count(F.lit(1)).alias("waiting"), (F.coalesce(F.max("last_round"), F.lit(0)) + 1).alias("round")).filter(F.col("waiting") >= interval)


def evidence_thinning(ids: Column, n: int = 50) -> Column:
    """Half the oldest and half the newest of a sorted array."""
    half = n // 2
    return F.when(F.size(ids) <= n, ids).otherwise(F.concat(F.slice(ids, 1, half), F.slice(ids, -(n - half), n - half)))


def sound_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of inputs that are dealt by the same key as dealt by it, even where adaptive execution has merged their partitions
    differently; a grouping by that key then splits its groups. Such unions are dealt anew with this switch."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local master gets a temporary one; on a cluster
    it has to be set, as executors don't see one another's disks."""
    sound_unions(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_SETTLED: list[tuple[SparkSession, str]] = []


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which goes with ``clear`` or when Python ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SETTLED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear() -> None:
    """Remove all settled tables: results that still read them are no longer to be used."""
    while _SETTLED:
        spark, path = _SETTLED.pop()
        if spark.sparkContext._jsc is None:  # the session has ended already
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
