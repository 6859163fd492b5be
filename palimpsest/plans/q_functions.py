"""Queries in SQL over the session's own functions, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import script
from ..functions import sql as f
from ..sources import adapter as a
from .q_recall import TOKENS
from .q_screening import _pick, _pick_sql


def scalar(spark, d):
    f.register(spark)
    return spark.sql(
        """SELECT fragment_id, cast(size(mem_tokens(content)) AS BIGINT) AS n_tokens, array_join(slice(mem_tokens(content), 1, 3), ' ') AS head, mem_match(content, slice(mem_tokens(content), 2, 2)) AS own,
           mem_match(content, array('zq')) AS other, mem_like(content, '%THE%') AS has_the, cast(mem_len(content) AS BIGINT) AS chars FROM {fragments}""",
        fragments=a.fragments(spark, d),
    )


def table(spark, d):
    """The objects of replies that were written around JSON: the texts stand between them."""
    f.register(spark)
    m, i = a.messages(spark, d), F.col("msg_id").cast("string")
    first = F.when(F.col("msg_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"id":'), i, F.lit("}")))
    rest = F.concat(F.lit(' [{"id":'), (F.col("msg_id") + 1).cast("string"), F.lit(',"x":{"id":0}}] {'))
    replies = m.select("msg_id", F.concat(F.lit("see {"), first, F.lit(" "), F.translate("content", "{", " "), rest).alias("reply"))
    return spark.sql("SELECT r.msg_id, o.place, get_json_object(o.object, '$.id') AS id FROM {replies} r, LATERAL mem_objects(r.reply) o", replies=replies)


#: Phrases in simplified script or with a second traditional form, and what they become.
SIMPLIFIED = ["头发长了后来发现", "皇后在后面", "妈妈说这里有个图书馆", "髮型與發展", "没有变化的字"]
FOLDED = ["頭發長了後來發現", "皇後在後面", "媽媽說這里有個圖書館", "發型與發展", "沒有變化的字"]


def folded(spark, d):
    m = a.messages(spark, d)
    return m.select("msg_id", script.fold(spark, F.concat(_pick(SIMPLIFIED, F.col("msg_id")), F.col("content"))).alias("text"))


Q = {"f1_fold_all": folded, "x1_sql_functions": scalar, "x3_json_objects": table}
S = {
    "f1_fold_all": a.sql("messages", f"SELECT msg_id, {_pick_sql(FOLDED, 'msg_id')}||content AS text FROM messages"),
    "x1_sql_functions": a.sql("fragments", "SELECT fragment_id, len(w) AS n_tokens, array_to_string(w[1:3], ' ') AS head, TRUE AS own, list_contains(w, 'zq') AS other, contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') AS has_the, length(content) AS chars FROM w",
                              w=f"SELECT *, {TOKENS.format('content')} AS w FROM fragments"),
    "x3_json_objects": a.sql("messages", "SELECT msg_id, 0 AS place, (CASE WHEN msg_id%3=0 THEN msg_id+1 ELSE msg_id END)::VARCHAR AS id FROM messages UNION ALL SELECT msg_id, 1, (msg_id+1)::VARCHAR FROM messages WHERE msg_id%3<>0"),
}
