"""Change logs of maintenance: what a run changed, row by row. A log replays its run on the table before it, and takes it back.

A log row has the run, the rule, the action (insert, update, delete), the names of the columns that changed, and the whole row before
and after. Keys identify a row; null keys are equal to one another. Both tables have the same columns, none of them a map.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _on(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def diff(old: DataFrame, new: DataFrame, keys: list[str], rule: str, run_id: str) -> DataFrame:
    """The log of a change from ``old`` to ``new``; columns that only one of them has are left out."""
    columns = [c for c in old.columns if c in new.columns]
    whole = lambda df, name: df.select(*keys, F.struct(*columns).alias(name))
    both = whole(old, "before").alias("o").join(whole(new, "after").alias("n"), _on("o", "n", keys), "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in columns]))
    action = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    rows = both.select(F.lit(run_id).alias("run_id"), F.lit(rule).alias("rule"), action.alias("action"), changed.alias("changed"), "before", "after")
    return rows.filter((F.col("action") != "update") | (F.size("changed") > 0))


def _put(df: DataFrame, log: DataFrame, keys: list[str], gone: str, come: str) -> DataFrame:
    """``df`` without the rows of the keys in the log, and with those on its other side."""
    columns = [c for c in df.columns if c in log.schema[come].dataType.names]
    touched = log.select(*[F.coalesce(F.col(f"{gone}.{k}"), F.col(f"{come}.{k}")).alias(k) for k in keys])
    kept = df.select(columns).alias("d").join(touched.alias("k"), _on("d", "k", keys), "left_anti")
    return kept.unionByName(log.filter(F.col(come).isNotNull()).select(*[F.col(f"{come}.{c}").alias(c) for c in columns]))


def replay(old: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the run. On a table that has the changes already it changes nothing."""
    return _put(old, log, keys, "before", "after")


def undo(new: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The table before the run."""
    return _put(new, log, keys, "after", "before")


class ChangeLog:
    """The logs of a table's runs in a folder that all executors share, a folder for each run."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _folder(self, run_id: str) -> str:
        return f"{self.path}/{run_id}"

    def has(self, run_id: str) -> bool:
        """Whether the run's log is whole: a job's end marks it."""
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self._folder(run_id)}/_SUCCESS")
        return bool(mark.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(mark))

    def log(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(run_id))

    def run(self, old: DataFrame, step: Callable[[DataFrame], DataFrame], rule: str, run_id: str) -> DataFrame:
        """The table after ``step``, once its changes are logged. A run that is logged isn't made again: its log is replayed, on the table
        before or after it, so that a run that failed between its log and its table ends as it would have."""
        if not self.has(run_id):
            diff(old, step(old), self.keys, rule, run_id).write.mode("overwrite").parquet(self._folder(run_id))
        return replay(old, self.log(run_id), self.keys)
