"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, jaccard, langid, licenses, packing, pii, quality, repair, resample, sharding, toolcalls, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest_columns(licenses.scan(table(spark, sf_dir, "documents")))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toolcalls.format_chat(table(spark, sf_dir, "conversations"), every_turn=True)
    return out.withColumn("errors", F.array_join("errors", "; "))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(table(spark, sf_dir, "documents")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest_columns(found)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repair.digest(repair.repair(repair.damage(given)), given)


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_tool_calls": op2_tool_calls,
    "op3_pii": op3_pii,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_repair": op11_repair,
    "op12_langid": op12_langid,
    "op13_resample": op13_resample,
}

#: Words as the contract takes them.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _list(values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


_TEMPLATES = ", ".join(
    f"('{label}', {base}, {_list(words)}, {_list(phrase)}, {at})" for _, label, base, words, phrase, at in licenses.all_templates(licenses.TEMPLATES + licenses.NOTICES)
)

def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, by bytes. Its table follows from the polynomial."""
    steps = list(range(256))
    for _ in range(8):
        steps = [(c >> 1) ^ (0xEDB88320 * (c & 1)) for c in steps]
    code = f"list_transform(range(0, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, ({steps}::BIGINT[])[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"


_STOPS = "('.', '!', '?')"

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
t(label, base, tw, pw, pos) AS (VALUES {_TEMPLATES}),
c AS (SELECT * FROM d JOIN t ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(pw, ' ') || ' ')),
p AS (SELECT doc_id, label, base, w, tw, pos, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(pw)] = pw)) AS spot FROM c),
h AS (SELECT DISTINCT doc_id, label, base, spot, round(len(list_filter(range(0, len(tw)), lambda k: spot - pos + k >= 0 AND w[spot - pos + k + 1] = tw[k + 1])) / len(tw), 6) AS score FROM p),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(spot) FILTER (base) AS first_word, max(spot) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl,
      string_agg(DISTINCT label, ',' ORDER BY label) AS ls, max(score) AS score FROM h WHERE score >= {licenses.COVER} GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl, '') AS base_labels, coalesce(ls, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN g USING (doc_id)
""",
    "op4_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
k AS (SELECT doc_id, sh, md5(array_to_string(list_sort(sh), '|')) AS key FROM s),
c AS (SELECT key, min(doc_id) AS class_id, count(*) AS n_copies, list_distinct(any_value(sh)) AS st FROM k GROUP BY key),
x AS (SELECT class_id, len(st) AS n, unnest(st) AS g FROM c),
e AS (SELECT a.class_id AS a, b.class_id AS b FROM x a JOIN x b USING (g) WHERE a.class_id < b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT class_id AS id, class_id AS spot FROM c UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r.spot),
g AS (SELECT id AS class_id, min(spot) AS group_id FROM r GROUP BY id),
l AS (SELECT a AS class_id, count(*) AS n_links FROM b GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, group_id, n_copies FROM k JOIN c USING (key) JOIN g USING (class_id) LEFT JOIN l USING (class_id)
""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS.format("text")} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[spot:spot + least(len(w), 13) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS spot FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT m FROM q),
p AS (SELECT doc_id, m, spot, array_to_string(w[spot:spot + m - 1], ' ') AS win FROM (SELECT d.*, m, unnest(range(1, len(w) - m + 2)) AS spot FROM d, n WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, spot, m FROM p JOIN q USING (m, win)),
v AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + m)) AS x FROM (SELECT DISTINCT doc_id, spot, m FROM h)) GROUP BY doc_id),
o AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN v USING (doc_id) LEFT JOIN o USING (doc_id)
""",
    "op10_exact_dedup": r"""
WITH p AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS d FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY d) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, d AS text_sha256
FROM p WINDOW w AS (PARTITION BY d ORDER BY n DESC, doc_id)
""",
    "op11_repair": rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {_crc32("key")} % 20 AS hit FROM k),
m AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, (VALUES (0), (1)) c(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
o AS (SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS bare, row_number() OVER w AS i, coalesce(lag(left(role, 1)) OVER w || left(role, 1) IN ('su', 'ua', 'au'), true) AS legal FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN {_STOPS} THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (NOT legal) AS illegal FROM f GROUP BY conv_id),
g(a, b, made, said) AS (VALUES (0, 0, '', ''), (0, 2, 'I', 'user:'), (0, 3, 'II', E'user:\nassistant:'), (1, 1, '', ''), (1, 2, 'I', 'user:'), (1, 3, 'II', E'user:\nassistant:'), (2, 2, '', ''), (2, 3, 'I', 'assistant:'), (3, 3, '', ''), (3, 2, 'I', 'user:')),
e(letter, initial, b, c) AS (VALUES ('D', NULL, 0, 0), ('D', NULL, 1, 1), ('D', NULL, 2, 2), ('D', NULL, 3, 3), ('R', NULL, 0, 2), ('R', NULL, 1, 2), ('R', NULL, 2, 3), ('R', NULL, 3, 2), ('K', 's', 0, 1), ('K', 'u', 0, 2), ('K', 'u', 1, 2), ('K', 'u', 3, 2), ('K', 'a', 2, 3)),
x AS (SELECT f.conv_id, f.i, g.a, e.c, 3 * length(made) + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END AS cost, made || letter AS edits,
      list_filter([said, CASE letter WHEN 'K' THEN role || ':' || text WHEN 'R' THEN CASE c WHEN 2 THEN 'user:' ELSE 'assistant:' END || text ELSE '' END], lambda p: p <> '') AS lines
      FROM f, g JOIN e USING (b) WHERE (letter <> 'K' OR e.initial = f.initial) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))),
r AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM n UNION ALL
      SELECT r.conv_id, r.i + 1, x.c, min({{'cost': r.best.cost + x.cost, 'audit': r.best.audit || x.edits, 'lines': r.best.lines || x.lines}}) FROM r JOIN x ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = r.i + 1 AND x.a = r.state GROUP BY r.conv_id, r.i, x.c),
z AS (SELECT r.conv_id, min({{'cost': best.cost + 3 * length(made), 'audit': best.audit || made, 'lines': best.lines || list_filter([said], lambda p: p <> '')}}) AS best
      FROM r JOIN n ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.n JOIN g ON g.a = r.state AND (g.b = 3 OR g.b = 0) GROUP BY r.conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, E'\n'), '')) AS repaired_sha256
FROM c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id
""",
    "op13_resample": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT {_WORDS.format("text")} AS w FROM benchmark),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM d),
q AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM i),
n AS (SELECT run, {_crc32("run")} % 10000 AS bucket FROM (SELECT run FROM g UNION SELECT run FROM q)),
p AS (SELECT doc_id, bucket, count(*) AS k FROM g JOIN n USING (run) GROUP BY doc_id, bucket),
s AS (SELECT bucket, sum(k) AS s FROM p GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM q JOIN n USING (run) GROUP BY bucket),
a AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(k * gain)::BIGINT AS weight FROM p JOIN a USING (bucket) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(d.w) AS n_words, len(d.w) + greatest(len(d.w) - 1, 0) + greatest(len(d.w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS drawn FROM c)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM r
""",
}
