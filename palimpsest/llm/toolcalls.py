"""Tool-call linking for chat formatting.

Calls and results are two tables that meet by conversation and identifier in a hash join: one call per identifier (the first of its
conversation; later ones are duplicates), one result per call (the first; later ones are duplicates), results without a
call are orphans, calls without a result are unanswered. Calls are ordered topologically: a call stands after those that it
depends on. Where all dependencies point backwards, the order of turns is such an order already; only conversations with a
forward dependency are levelled, round by round, and calls on a cycle are marked. Arguments are validated against the tool's
JSON schema, and each call becomes one line of canonical JSON: sorted keys, no white space, no escaped letters.

Null text, unreadable JSON (numbers beyond doubles and lone surrogates included), unreadable schemas, unknown tools and dependencies
that the conversation lacks have an error each and drop no row. Turns of plain chats that are neither call nor result have rows of
status ``system_turn`` or ``other_turn`` where they are asked for. A null conversation or identifier links to nothing. No
conversation is gathered into one task. Extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache
from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranks, with_columns

#: Turns that are ranked together; a longer conversation is ranked in several tasks.
BLOCK = 256
#: Level of calls on a cycle where rows are ordered: after all others.
LAST = 1 << 40

CALLS = "conv_id long, call_id string, turn long, idx int, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"

REPLY_SCHEMA = json.dumps(
    {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1}, "system": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
)


def from_chat(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain chats: a user's turn calls the tool ``reply`` and depends on the user's turn before it; the
    assistant's turn is the result of the turn it follows. An assistant's text of the form {"tool_calls": [...]} makes those calls
    instead, and a turn of role tool with {"tool_call_id": ...} is a result."""
    rows = with_columns(messages, ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))
    at = lambda shift: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + shift).cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    own = rows.filter("role = 'user'").select(
        "conv_id", F.when(whole, at(0)).alias("call_id"), "turn", F.lit(0).alias("idx"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn"))).alias("arguments"), F.when(F.col("turn") >= 2, F.array(at(-2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    earlier = own.select(F.col("call_id").alias("there")).filter("there is not null").distinct()
    # first turns depend on nothing: they stay out of the join, where their null key would be a hot one
    none = F.array().cast("array<string>")
    later = own.filter("size(depends_on) > 0").withColumn("wanted", F.get("depends_on", F.lit(0)))
    later = later.join(earlier, F.col("wanted") == F.col("there"), "left").withColumn("depends_on", F.when(F.col("there").isNotNull(), F.col("depends_on")).otherwise(none))
    own = own.filter("size(depends_on) = 0").unionByName(later.drop("wanted", "there"))

    form = "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>, tool_call_id string, content string"
    parsed = rows.filter(F.col("role").isin("assistant", "tool")).withColumn("json", F.when(F.ltrim("text").startswith("{"), F.from_json("text", form)))
    stated = parsed.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("json.tool_calls").alias("idx", "c")).select(
        "conv_id", F.col("c.id").alias("call_id"), "turn", "idx", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on")
    )
    answers = parsed.filter("role = 'assistant' and (json.tool_calls is null or size(json.tool_calls) = 0)").select("conv_id", F.when(whole, at(-1)).alias("call_id"), "turn", F.col("text").alias("content"))
    returned = parsed.filter("role = 'tool'").select("conv_id", F.col("json.tool_call_id").alias("call_id"), "turn", F.coalesce("json.content", "text").alias("content"))
    return own.unionByName(stated), answers.unionByName(returned)


def others(messages: DataFrame) -> DataFrame:
    """The turns that ``from_chat`` makes neither call nor result: of role system, of another one or of none (in ``name``)."""
    rows = with_columns(messages, ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))
    rows = rows.filter("coalesce(role not in ('user', 'assistant', 'tool'), true)")
    status = F.when(F.col("role") == "system", "system_turn").otherwise("other_turn")
    return rows.select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("content"), status.alias("status"))


_KEY = ["conv_id", "call_id"]


def _first_of(df: DataFrame, order: list[str]) -> DataFrame:
    """The uid of the first row of each identifier: one row a task and key is shuffled, so a hot identifier is no burden."""
    named = df.filter("conv_id is not null and call_id is not null")
    return named.groupBy(*_KEY).agg(F.min(F.struct(*order, "uid")).alias("m")).select(*_KEY, F.col("m.uid").alias("first_uid"))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every call and every result that isn't linked, with a status: linked, unanswered, duplicate_call, orphan_result, duplicate_result."""
    c = materialize(calls.withColumn("uid", F.monotonically_increasing_id()))
    r = materialize(results.withColumn("uid", F.monotonically_increasing_id()))
    first_call = _first_of(c, ["turn", "idx"])
    first_result = _first_of(r, ["turn"])
    firsts = c.join(first_call.select(F.col("first_uid").alias("uid")), "uid", "left_semi")
    answer = r.join(first_result.select(F.col("first_uid").alias("uid")), "uid", "left_semi").select(*_KEY, F.col("content"), F.col("turn").alias("result_turn"), F.lit(True).alias("answered"))
    linked = firsts.hint("shuffle_hash").join(answer, _KEY, "left").withColumn("status", F.when(F.col("answered"), "linked").otherwise("unanswered")).drop("answered")
    repeated = c.join(firsts.select("uid"), "uid", "left_anti").withColumn("status", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unanswered").otherwise("duplicate_call"))
    known = first_call.select(*_KEY)
    orphans = r.join(known, _KEY, "left_anti").withColumn("status", F.lit("orphan_result"))
    late = r.join(known, _KEY, "left_semi").join(first_result.select(F.col("first_uid").alias("uid")), "uid", "left_anti").withColumn("status", F.lit("duplicate_result"))
    rest = orphans.unionByName(late).withColumn("result_turn", F.col("turn"))
    return linked.unionByName(repeated, True).unionByName(rest, True).drop("uid")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, level) of the calls (conv_id, uid) in conversations where a call depends on a later one; level is null on a cycle. Edges
    are (conv_id, uid, at, dep, dep_at): a call, what it depends on and both places."""
    odd = edges.filter("dep_at >= at").select("conv_id").distinct()
    edges = materialize(edges.join(odd, "conv_id", "left_semi").select("uid", "dep"))
    waiting = materialize(calls.join(odd, "conv_id", "left_semi").select("uid"))
    edges, chains = _contract(edges)
    waiting = materialize(waiting.join(chains, "uid", "left_anti"))
    done = waiting.limit(0).withColumn("level", F.lit(0).cast("long"))
    while True:
        known = edges.join(done.select(F.col("uid").alias("dep"), F.col("level").alias("under")), "dep", "left")
        known = known.groupBy("uid").agg(F.max(F.col("under") + F.col("hops")).alias("level"), F.bool_or(F.col("under").isNull()).alias("blocked"))
        state = materialize(waiting.join(known, "uid", "left"))
        ready = state.filter("not coalesce(blocked, false)").select("uid", F.coalesce("level", F.lit(0)).cast("long").alias("level"))
        if ready.isEmpty():
            break
        done = materialize(done.unionByName(ready))
        waiting = state.filter("blocked").select("uid")
    ends = done.select(F.col("uid").alias("dep"), F.col("level").alias("under"))
    hung = chains.join(ends, "dep", "left").select("uid", (F.col("under") + F.col("hops")).alias("level"))
    return done.unionByName(hung).unionByName(waiting.withColumn("level", F.lit(None).cast("long")))


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of calls with one dependency each, by doubling: (uid, dep, hops) of the calls with several, and of those with one,
    where dep is the end of the chain, a call with several or none. Chains that never end keep a dep that is no such call."""
    many = edges.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep"))
    chains = materialize(many.filter("n = 1").select("uid", "dep", F.lit(1).cast("long").alias("hops")))
    for _ in range(chains.count().bit_length()):
        then = chains.select(F.col("uid").alias("dep"), F.col("dep").alias("next"), F.col("hops").alias("more"))
        met = materialize(chains.join(then, "dep", "left"))
        if met.filter("next is not null").isEmpty():
            break
        chains = met.select("uid", F.coalesce("next", "dep").alias("dep"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
    rest = edges.join(many.filter("n > 1").select("uid"), "uid", "left_semi")
    ends = chains.select(F.col("uid").alias("dep"), F.col("dep").alias("end"), "hops")
    rest = rest.join(ends, "dep", "left").select("uid", F.coalesce("end", "dep").alias("dep"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"))
    return materialize(rest), materialize(chains)


def order(linked: DataFrame) -> DataFrame:
    """``linked`` with ``position``, from 0 in each conversation in a topological order, status cycle where there is none, and
    ``missing``: what a call depends on and its conversation lacks."""
    rows = materialize(linked.withColumn("uid", F.monotonically_increasing_id()))
    is_call = F.col("status").isin("linked", "unanswered")
    calls = rows.filter(is_call & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    spots = calls.select("conv_id", F.col("call_id").alias("name_of"), F.col("uid").alias("dep"), F.struct("turn", "idx").alias("dep_at"))
    edges = calls.select("conv_id", "uid", F.struct("turn", "idx").alias("at"), F.explode(F.array_compact(F.array_distinct("depends_on"))).alias("name_of"))
    edges = materialize(edges.join(spots, ["conv_id", "name_of"], "left"))
    missing = edges.filter("dep is null").groupBy("uid").agg(F.array_sort(F.collect_set("name_of")).alias("missing"))
    level = levels(calls.select("conv_id", "uid"), edges.filter("dep is not null")).withColumn("levelled", F.lit(True))
    placed = rows.join(level, "uid", "left").join(missing, "uid", "left")
    cycle = F.coalesce(F.col("levelled") & F.col("level").isNull(), F.lit(False))
    placed = placed.withColumn("status", F.when(cycle, "cycle").otherwise(F.col("status"))).withColumn("level", F.when(cycle, LAST).otherwise(F.coalesce("level", F.lit(0))).cast("long"))
    salt = (F.col("level") * (1 << 20) + F.least(F.floor(F.coalesce("turn", F.lit(0)) / BLOCK), F.lit((1 << 20) - 1))).cast("long")
    return ranks(placed, F.col("conv_id"), salt, [F.col(c) for c in ("turn", "idx", "status", "call_id", "content")], "position").drop("level", "levelled", "uid")


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _fits(value, kind) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or (isinstance(value, float) and (kind == "number" or value.is_integer()))
        return whole and not isinstance(value, bool)
    return kind not in _KINDS or isinstance(value, _KINDS[kind])


def check(value, schema, path: str = "$") -> list[str]:
    """What is wrong with a value, by the common keywords of JSON schema. A type may be a list of types."""
    if not isinstance(schema, dict):
        return [f"{path}: not allowed"] if schema is False else []
    kind = schema.get("type")
    if kind is not None and not any(_fits(value, k) for k in (kind if isinstance(kind, list) else [kind])):
        return [f"{path}: not {' or '.join(kind) if isinstance(kind, list) else kind}"]
    number = isinstance(value, int | float) and not isinstance(value, bool)
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if number:
        out += [f"{path}: below minimum"] * ("minimum" in schema and value < schema["minimum"]) + [f"{path}: above maximum"] * ("maximum" in schema and value > schema["maximum"])
    if isinstance(value, str | list):
        name = "Length" if isinstance(value, str) else "Items"
        out += [f"{path}: too short"] * (len(value) < schema.get(f"min{name}", 0)) + [f"{path}: too long"] * (len(value) > schema.get(f"max{name}", len(value)))
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        out += [e for i, v in enumerate(value) for e in check(v, schema["items"], f"{path}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: required" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += check(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: not allowed")
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(text: str) -> float:
    if not isfinite(number := float(text)):
        raise ValueError(text)
    return number


def _no_constant(text: str):
    raise ValueError(text)


@lru_cache(maxsize=256)
def _schema(text: str):
    """The parsed schema; one that isn't JSON raises."""
    return json.loads(text)


def _line(row: dict) -> tuple[list[str] | None, str]:
    """Errors (null for a result or a turn), and the canonical line."""
    if row["status"] in ("orphan_result", "duplicate_result"):
        return None, canonical({"content": row["content"], "id": row["call_id"], "status": row["status"], "type": "result"})
    if row["status"] in ("system_turn", "other_turn"):
        return None, canonical({"content": row["content"], "role": row["name"], "status": row["status"], "type": "turn"})
    made = {"arguments": None, "content": row["content"], "depends_on": row["depends_on"], "id": row["call_id"], "name": row["name"], "status": row["status"], "type": "call"}
    absent = [f"$.depends_on: {name} missing" for name in row["missing"] or []]
    try:
        arguments = json.loads(row["arguments"], parse_constant=_no_constant, parse_float=_finite)
        line = canonical(made | {"arguments": arguments})
        line.encode()  # a lone surrogate isn't text
    except (TypeError, ValueError, RecursionError):
        return ["$: not JSON", *absent], canonical(made | {"arguments": row["arguments"]})
    if row["schema"] is None:
        return ["$: unknown tool", *absent], line
    try:
        return [*check(arguments, _schema(row["schema"])), *absent], line
    except (TypeError, ValueError, RecursionError, AttributeError):
        return ["$: schema not readable", *absent], line


def _lines(batches):
    import pyarrow as pa

    for batch in batches:
        out = [_line(r) for r in batch.select(["call_id", "name", "arguments", "depends_on", "content", "status", "schema", "missing"]).to_pylist()]
        made = [pa.array([e for e, _ in out], pa.list_(pa.string())), pa.array([j for _, j in out], pa.string())]
        keep = ["conv_id", "call_id", "turn", "position", "status"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], [*keep, "errors", "json"])


def serialise(ordered: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, position, status, errors, json of every call and of every result that isn't linked."""
    tools = schemas.groupBy(F.col("name").alias("tool")).agg(F.min("schema").alias("schema"))
    rows = ordered.join(tools, F.col("name") == F.col("tool"), "left").select(
        "conv_id", "call_id", "turn", F.col("position").cast("long").alias("position"), "status", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), "content", "schema", "missing"
    )
    return rows.mapInArrow(_lines, "conv_id long, call_id string, turn long, position long, status string, errors array<string>, json string")


def format_chat(messages: DataFrame, schemas: DataFrame | None = None, every_turn: bool = False) -> DataFrame:
    """``serialise`` of plain chats; with ``every_turn`` also a row for each turn that is neither call nor result."""
    spark = messages.sparkSession
    own = spark.createDataFrame([("reply", REPLY_SCHEMA)], "name string, schema string")
    linked = link(*from_chat(messages))
    if every_turn:
        linked = linked.unionByName(others(messages), True)
    return serialise(order(linked), own if schemas is None else own.unionByName(schemas))
