"""Chat logs, webhook events, benchmark dialogues, raw model replies; whole-store export and import."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..operators.tables import upsert

#: Who counts as the user.
USERS = ["user", "human", "我", "me"]
_FIELDS = "content string, text string, message string, msg string, sender string, role string, timestamp string, time string, post_type string, raw_message string, user_id string, self_id string"


def sender(name: Column, users: list[str] | None = None) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(users or USERS), "user").otherwise("ai")


def plain_text(content: Column) -> Column:
    """A content field as text: a string as it is; a list's strings and text parts on lines of their own, without reminders."""
    parts = F.from_json(content, "array<string>")
    part = lambda p: F.when(p.startswith("{"), F.when(F.get_json_object(p, "$.type") == "text", F.get_json_object(p, "$.text"))).otherwise(p)
    joined = F.array_join(F.filter(F.transform(parts, part), lambda p: p.isNotNull()), "\n")
    listed = F.ltrim(content).startswith("[") & parts.isNotNull()
    return F.trim(F.regexp_replace(F.when(listed, joined).otherwise(content), r"(?s)<system_reminder>.*?</system_reminder>", ""))


def normalise_ingest(df: DataFrame, column: str = "value", zone: str = "UTC") -> DataFrame:
    """Webhook events, simple or OneBot, to sender, content and ts; events without content go."""
    o = F.from_json(column, _FIELDS)
    bot = o["post_type"] == "message"
    content = F.when(bot, F.coalesce(F.nullif(o["raw_message"], F.lit("")), o["message"])).otherwise(F.coalesce(o["content"], o["text"], o["message"], o["msg"]))
    who = F.when(bot, F.when(o["user_id"] == o["self_id"], "ai").otherwise("user")).otherwise(sender(F.coalesce(o["sender"], o["role"])))
    out = df.withColumns({"sender": who, "content": plain_text(content), "ts": t.to_utc(F.coalesce(o["timestamp"], o["time"]), zone)})
    return out.filter("content is not null and content <> ''")


def parse_line(df: DataFrame, column: str = "value", users: list[str] | None = None, zone: str = "UTC") -> DataFrame:
    """``Name: text`` lines with an optional [time] or ISO time before them. A line without a name is the user's."""
    line = F.trim(column)
    boxed, dated = r"^\[([^\]]+)\]\s*(.*)$", r"^(\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}(?::\d{2})?)\s+(.*)$"
    rest = F.when(line.rlike(boxed), F.regexp_extract(line, boxed, 2)).when(line.rlike(dated), F.regexp_extract(line, dated, 2)).otherwise(line)
    when = F.when(line.rlike(boxed), F.regexp_extract(line, boxed, 1)).when(line.rlike(dated), F.regexp_extract(line, dated, 1))
    named = rest.rlike("^[^:：]+[:：]")
    content = F.when(named, F.trim(F.regexp_replace(rest, "^[^:：]+[:：]", ""))).otherwise(rest)
    who = F.when(named, sender(F.regexp_extract(rest, "^([^:：]+)[:：]", 1), users)).otherwise("user")
    return df.withColumns({"sender": who, "content": content, "ts": t.to_utc(when, zone)}).filter((line != "") & (F.col("content") != ""))


def read_chat(spark: SparkSession, path: str, fmt: str = "auto", users: list[str] | None = None, zone: str = "UTC") -> DataFrame:
    """file, pos, sender, content, ts of chat logs. ``auto`` takes each file as a JSON array if it begins like one, as JSON lines
    if any line is an object, else as text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value").filter("trim(value) <> ''")
    if fmt == "auto":
        head = lines.groupBy("file").agg(F.min_by(F.ltrim("value"), "pos").alias("_first"), F.bool_or(F.from_json("value", _FIELDS).isNotNull() & F.ltrim("value").startswith("{")).alias("_json"))
        lines = lines.join(head, "file").withColumn("fmt", F.when(F.col("_first").rlike(r"^\[\s*($|[{\[\"\]])"), "json").when(F.col("_json"), "jsonl").otherwise("txt")).drop("_first", "_json")
    else:
        lines = lines.withColumn("fmt", F.lit(fmt))
    rows = normalise_ingest(lines.filter("fmt = 'jsonl'"), zone=zone).unionByName(parse_line(lines.filter("fmt = 'txt'"), users=users, zone=zone))
    arrays = [r.file for r in lines.filter("fmt = 'json'").select("file").distinct().collect()]  # names of files alone
    if arrays:
        whole = spark.read.text(arrays, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<string>").alias("items"))
        each = whole.select("file", F.posexplode("items").alias("pos", "value")).select("file", F.col("pos").cast("long").alias("pos"), "value", F.lit("json").alias("fmt"))
        rows = rows.unionByName(normalise_ingest(each, zone=zone))
    return rows.select("file", "pos", "sender", "content", "ts")


def prompt_text(messages: DataFrame, longest: int = 500) -> DataFrame:
    """Messages but images, cut and without control characters, as payload."""
    kept = messages.filter(F.coalesce("message_type", F.lit("text")) != "image") if "message_type" in messages.columns else messages
    return kept.withColumn("payload", F.regexp_replace(F.substring("content", 1, longest), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))


def read_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, qa) of benchmark dialogues, JSON lines of {conv_id, conversation: {session_N: [...], session_N_date_time}, qa}."""
    raw = spark.read.text(path).select(F.get_json_object("value", "$.conv_id").alias("conv_id"), F.from_json(F.get_json_object("value", "$.conversation"), "map<string,string>").alias("c"), F.get_json_object("value", "$.qa").alias("qa"))
    entries = raw.select("conv_id", "c", F.explode("c").alias("k", "v")).filter(F.col("k").rlike("^session_[0-9]+$"))
    turn = "array<struct<dia_id:string,speaker:string,text:string>>"
    when = F.element_at("c", F.concat("k", F.lit("_date_time")))
    english = F.try_to_timestamp(F.upper(F.regexp_replace(when, " on ", " ")), F.lit("h:mm a d MMMM, yyyy"))
    english = F.coalesce(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(when, " on ", " "), "(?i)([ap])m", "$1M"), F.lit("h:mm a d MMMM, yyyy")), english)
    taipei = F.to_utc_timestamp(F.try_to_timestamp(when, F.lit("yyyy-MM-dd HH:mm")), "Asia/Taipei")
    turns = entries.select("conv_id", F.regexp_extract("k", "([0-9]+)$", 1).cast("int").alias("session"), F.coalesce(taipei, english).alias("ts"), F.posexplode(F.from_json("v", turn)).alias("turn_seq", "x"))
    turns = turns.select("conv_id", "session", "turn_seq", "x.*", "ts")
    q = raw.select("conv_id", F.posexplode(F.from_json("qa", "array<struct<question:string,answer:string,category:int,evidence:string>>")).alias("qi", "q")).select("conv_id", "qi", "q.*")
    ids = q.select("conv_id", "qi", F.regexp_extract_all("evidence", F.lit(r"D\d+:\d+"), F.lit(0)).alias("_ids")).select("conv_id", "qi", F.explode_outer("_ids").alias("dia_id")).filter("dia_id is not null")
    known = ids.join(turns.select("conv_id", "dia_id").distinct(), ["conv_id", "dia_id"], "left_semi").groupBy("conv_id", "qi").agg(F.array_sort(F.collect_set("dia_id")).alias("evidence"))
    return turns, q.drop("evidence").join(known, ["conv_id", "qi"], "left")


def shift_timeline(turns: DataFrame, now: Column, mode: str = "shift") -> DataFrame:
    """Each conversation moved so that its last turn is a day before ``now``; ``fresh`` puts all turns there."""
    last = F.max("ts").over(Window.partitionBy("conv_id"))
    end = F.unix_timestamp(now) - 86400
    return turns.withColumn("ts", F.timestamp_seconds(end if mode == "fresh" else F.unix_timestamp("ts") - F.unix_timestamp(last) + end))


def salvage(reply: str | None) -> tuple[list[str], bool]:
    """The complete objects in the first list of a reply that is cut off or has prose around it, and whether it was cut."""
    text, out, decoder = reply or "", [], json.JSONDecoder()
    at = text.find("[") + 1
    if not at:
        return [], True
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text):
            return out, True
        if text[at] == "]":
            return out, False
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return out, True
        out.append(json.dumps(value, ensure_ascii=False))


def _salvaged(batches):
    for pdf in batches:
        found = [salvage(r) for r in pdf.reply]
        yield pdf[["reply_id"]].assign(items=[f[0] for f in found], truncated=[f[1] for f in found])


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, status) of raw replies (reply_id, reply): whole JSON natively, only the rest through the scanner."""
    whole = replies.withColumn("items", F.from_json(F.get_json_object("reply", "$.entries"), "array<string>"))
    good = whole.filter("items is not null").select("reply_id", "items", F.lit(False).alias("truncated"), F.lit(False).alias("salvaged"))
    bad = whole.filter("items is null").select("reply_id", "reply").mapInPandas(_salvaged, f"reply_id {dict(replies.dtypes)['reply_id']}, items array<string>, truncated boolean").withColumn("salvaged", F.lit(True))
    both = good.unionByName(bad.select(good.columns))
    entries = both.select("reply_id", F.posexplode("items").alias("pos", "entry"))
    return entries, both.select("reply_id", F.size("items").alias("n"), "truncated", "salvaged")


def export_store(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as lines {"table", "row"}, one folder each."""
    for name, df in tables.items():
        df.select(F.to_json(F.struct(F.lit(name).alias("table"), F.struct("*").alias("row"))).alias("value")).write.mode("overwrite").text(f"{path}/table={name}")


def import_store(lines: DataFrame, target: DataFrame, table: str, keys: list[str], mode: str = "ignore") -> DataFrame:
    """The target with the exported rows of ``table``: new keys only (ignore) or replacing (merge). Other tables are skipped."""
    own = lines.filter(F.get_json_object("value", "$.table") == table)
    rows = own.select(F.from_json(F.get_json_object("value", "$.row"), target.schema).alias("r")).select("r.*").dropDuplicates(keys)
    return upsert(target, rows, keys, mode)
