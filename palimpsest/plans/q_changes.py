"""Change logs of the life cycle's rules over the derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, linking, model, state, tables
from ..sources import adapter as a
from . import q_linking, q_model, q_state, q_tables
from .q_model import MODEL
from .q_tables import DECAY, EPISODES, GC, PATTERNS


def _survivors(spark, d):
    e = a.entities(spark, d)
    return e.filter("category = 'place' and entity_id % 5 <> 0").select("entity_id", (F.col("entity_id") - F.col("entity_id") % 5).alias("into"))


def _entries(spark, d):
    m = q_model._model(spark, d)
    sur = m.join(m.groupBy("owner_id").agg(F.min("entry_id").alias("into")), "owner_id").filter("entry_id <> into").select("entry_id", "into")
    return lambda df: model.merge_entries(df, sur, 0.05)


def _verdicts(spark, d):
    v = q_tables._episodes(spark, d).select("memory_id", q_state.pick(["distorted", "accurate", "fabricated"], F.col("memory_id")).alias("verdict"))
    return lambda df: state.apply_episode_verdicts(df, v)


#: Rule: its table, its step, its keys.
RULES = {
    "t1": (q_tables._accessed, lambda s, d: lambda df: tables.fragment_gc(df, a.now(), 14, 20, 25), ["fragment_id"]),
    "t2": (q_tables._episodes, lambda s, d: lambda df: tables.episode_decay(df, a.now()), ["memory_id"]),
    "t5": (q_tables._pattern_rows, lambda s, d: lambda df: tables.pattern_states(df, a.now()), ["pattern_id"]),
    "t7": (a.entities, lambda s, d: lambda df: linking.entity_lifecycle(df, a.links(s, d), a.now(), 2, 14).drop("status").withColumnRenamed("new_status", "status"), ["entity_id"]),
    "t8": (a.links, lambda s, d: lambda df: linking.apply_merges(df, _survivors(s, d)), ["fragment_id", "entity_id"]),
    "t12": (q_model._model, _entries, ["entry_id"]),
    "t24": (q_tables._episodes, _verdicts, ["memory_id"]),
}


def _logged(rule: str):
    def query(spark, d):
        read, step, keys = RULES[rule]
        old = read(spark, d)
        log = changes.diff(old, step(spark, d)(old), keys, rule, "r1")
        key = [F.coalesce(F.col(f"before.{k}"), F.col(f"after.{k}")).alias(k) for k in keys]
        return log.select("rule", *key, "action", F.array_join(F.array_sort("changed"), ",").alias("changed"))

    return query


def _diff(rule: str, keys: str, old: str, new: str, columns: str) -> str:
    """Rows of two tables that differ, by key."""
    first, names = keys.split(",")[0], columns.split()
    gone = ",".join(sorted([*names, *keys.split(",")]))
    each = ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in sorted(names))
    return f"""SELECT '{rule}' AS rule, {keys}, CASE WHEN o.{first} IS NULL THEN 'insert' WHEN n.{first} IS NULL THEN 'delete' ELSE 'update' END AS action,
        CASE WHEN o.{first} IS NULL OR n.{first} IS NULL THEN '{gone}' ELSE array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',') END AS changed
        FROM ({old}) o FULL JOIN ({new}) n USING ({keys}) WHERE o.{first} IS NULL OR n.{first} IS NULL OR {' OR '.join(f'o.{c} IS DISTINCT FROM n.{c}' for c in names)}"""


Q = {f"{rule}_change_log": _logged(rule) for rule in RULES}
S = {
    "t1_change_log": a.sql("fragments", _diff("t1", "fragment_id", "FROM acc", "FROM s4", "content lifecycle_updated_at status"), **GC),
    "t2_change_log": a.sql("fragments", _diff("t2", "memory_id", "FROM ep", f"SELECT memory_id, weight, CASE WHEN g THEN 'archived' ELSE status END AS status, CASE WHEN g THEN {q_tables.T} ELSE updated_at END AS updated_at FROM e3", "status updated_at weight"), **DECAY),
    "t5_change_log": a.sql("observations", _diff("t5", "pattern_id", "SELECT pid AS pattern_id, status FROM p", f"SELECT pattern_id, status FROM ({q_tables.PATTERN_STATES})", "status"), **PATTERNS),
    "t7_change_log": f"SELECT 't7' AS rule, entity_id, 'update' AS action, 'status' AS changed FROM ({q_linking.S['t7_entity_lifecycle']}) WHERE status<>new_status",
    "t8_change_log": a.sql("links", _diff("t8", "fragment_id,entity_id", "FROM links", "SELECT fragment_id, CASE WHEN entity_id BETWEEN 100 AND 124 THEN entity_id-entity_id%5 ELSE entity_id END AS entity_id, max(confidence) AS confidence, min(created_at) AS created_at FROM links GROUP BY 1,2", "confidence created_at")),
    "t12_change_log": a.sql("observations", _diff("t12", "entry_id", "SELECT entry_id, evidence_count, round(confidence,6) AS confidence, status FROM m", f"FROM ({q_model.S['t12_merge_entries']})", "confidence evidence_count status"), m=MODEL),
    "t24_change_log": a.sql("fragments", _diff("t24", "memory_id", "FROM ep", "SELECT memory_id, CASE WHEN memory_id%3=0 THEN weight*0.5 ELSE weight END AS weight, CASE WHEN memory_id%3=2 THEN 'archived' ELSE status END AS status FROM ep", "status weight"), ep=EPISODES),
}
