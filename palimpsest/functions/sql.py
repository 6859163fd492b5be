"""The column functions that SQL users need, as temporary SQL functions of a session, and a table function over JSON in texts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import text as t

_FOLDED = f"lower(translate(coalesce(value, ''), '{t.SIMPLIFIED}', '{t.TRADITIONAL}'))"
_TOKENS = (
    rf"if(coalesce(value, '') rlike '[{t.CJK}]', flatten(transform(regexp_extract_all({_FOLDED}, r'[{t.CJK}]+|[\p{{L}}\p{{N}}&&[^{t.CJK}]]+', 0), "
    rf"r -> if(r rlike r'^[{t.CJK}]{{2,}}$', transform(sequence(1, length(r) - 1), i -> substring(r, i, 2)), array(r)))), "
    r"regexp_extract_all(lower(coalesce(value, '')), r'[\p{L}\p{N}]+', 0))"
)
#: Name, parameters, result and body: what ``text.index_tokens``, ``text.normalise`` without full-width forms, ``state.ascii_like`` and a length are.
FUNCTIONS = [
    ("mem_tokens", "value STRING", "ARRAY<STRING>", _TOKENS),
    ("mem_match", "value STRING, words ARRAY<STRING>", "BOOLEAN", "forall(array(mem_tokens(value)), own -> forall(words, w -> array_contains(own, w)))"),
    ("mem_like", "value STRING, pattern STRING", "BOOLEAN", "translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE translate(pattern, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
    ("mem_len", "value STRING", "INT", "length(coalesce(value, ''))"),
]


def objects(text: str | None) -> list[str]:
    """The outermost JSON objects that stand in a text, as they are written."""
    import json

    out, at, decoder = [], 0, json.JSONDecoder()
    while text and (at := text.find("{", at)) >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at += 1
            continue
        out.append(text[at:end])
        at = end
    return out


@udtf(returnType="place: int, object: string")
class JsonObjects:
    """``SELECT * FROM rows, LATERAL mem_objects(text)``: a row for each JSON object in a text."""

    def eval(self, text: str):
        yield from enumerate(objects(text))


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("mem_objects", JsonObjects)
