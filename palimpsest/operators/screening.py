"""Screening: what of the new entries, fragments, messages and monitors is worth a further step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .linking import few_terms
from .recall import exploded, top_n
from .tables import days_before, settle

#: Words of feelings, and words of the assistant's own small talk.
FEELINGS = (
    "委屈 難過 傷心 悲傷 沮喪 失落 低落 焦慮 緊張 不安 擔心 害怕 恐懼 恐慌 生氣 憤怒 煩躁 煩悶 崩潰 壓抑 隱忍 疲憊 疲倦 很累 好累 累了 倦怠 孤單 孤獨 寂寞 "
    "無助 無力 挫折 自責 愧疚 內疚 羞愧 尷尬 失望 絕望 痛苦 難受 不開心 不快樂 開心 快樂 高興 興奮 期待 滿足 放鬆 安心 感動 感激 自豪 驕傲 依賴 信任 在意 情緒 心情 心事 低潮 脆弱 逞強 強撐"
).split()
CHAT = (
    "提醒 建議 推薦 承諾 答應 保證 會避開 會幫 幫你 之後會 下次會 記得 別忘 謝謝 感謝 不客氣 稱讚 誇獎 誇讚 歡迎 加油 祝 晚安 早安 交通方便 應該要 需要帶"
).split()
#: Signs of strong emotion.
STRONG = "崩潰 崩了 受不了 好難 好累 撐不住 哭了 哭 氣死 害怕 後悔 對不起 我決定 我不想再 我突然 沒想到".split()
#: Signs of lasting facts and of passing ones, in both scripts where they differ.
LASTING = (
    "出生於 畢業於 就讀於 家裡有 家人 老家 家鄉 媽媽 爸爸 妹妹 弟弟 姐姐 哥哥 大學 專業 職業 公司 生日 身高 體重 血型 星座 MBTI 屬相 住在 搬到 "
    "出生于 毕业于 就读于 家里有 家乡 妈妈 大学 专业 职业 体重 属相"
).split()
PASSING = "今天 現在 最近 這週 這個月 正在 準備 现在 这周 这个月 准备".split()


def ai_chitchat(type_: Column, content: Column, assistant: str, user_names: list[str], kinds: tuple[str, ...] = ("observation", "state", "reflection")) -> Column:
    """Whether an entry that the assistant's words support is to be dropped: of another kind, without a feeling, with small talk, or
    about the assistant and not the user. Null content is dropped."""
    folded = t.normalise(content)
    plain = lambda words: [w.lower().replace(" ", "") for w in words]
    about_self = F.contains(folded, F.lit(assistant.lower()))
    rest = F.replace(folded, F.lit(assistant.lower()), F.lit(""))
    names_user = rest.rlike(t._any(plain(user_names)))
    keep = type_.isin(*kinds) & folded.rlike(t._any(FEELINGS)) & ~folded.rlike(t._any(CHAT)) & (~about_self | names_user)
    return ~F.coalesce(keep, F.lit(False))


def fact_candidates(fragments: DataFrame, facts: DataFrame, names: list[str], now: Column, days: int = 7, most: int = 100, overlap: float = 0.7) -> DataFrame:
    """An owner's newest active fragments that name the user, state something lasting and nothing passing, and whose characters
    aren't mostly those of a known fact. Facts are (owner_id, fact)."""
    new = top_n(fragments.filter((F.col("status") == "active") & (F.col("created_at") > days_before(now, days))), ["owner_id"], [F.desc("created_at"), F.asc("fragment_id")], most).drop("rank")
    text = F.coalesce("content", F.lit(""))
    lasting = text.rlike(t._any(LASTING) + r"|\d{4}年")
    may = new.filter(text.rlike(t._any(names)) & lasting & ~text.rlike(t._any(PASSING)))
    # characters of the fragment that the fact lacks are those which stay when the fact's are taken out
    low = may.select("owner_id", "fragment_id", F.lower(text).alias("_c")).join(facts.select("owner_id", F.lower("fact").alias("_f")), "owner_id")
    known = low.filter(1 - F.length(F.expr("translate(_c, _f, '')")) / F.greatest(F.length("_c"), F.lit(1)) > overlap)
    return may.join(known.select("fragment_id"), "fragment_id", "left_anti")


def emotion_signal(messages: DataFrame, words: list[str] = STRONG) -> DataFrame:
    """(batch_id, signal): whether some message of the batch has one of the words."""
    return messages.groupBy("batch_id").agg(F.coalesce(F.bool_or(F.coalesce("content", F.lit("")).rlike(t._any(words))), F.lit(False)).alias("signal"))


def _by_keys(texts: DataFrame, probes: DataFrame) -> DataFrame:
    """(entry_id, context_id) where a probe of the owner stands in the text: probes have one to three characters, or start with three."""
    keys = exploded(texts, ["owner_id", "context_id"], F.array_distinct(F.concat(*(t.grams(F.col("text"), n) for n in (1, 2, 3))))).withColumnRenamed("token", "key")
    met = keys.join(probes.withColumn("key", F.substring("probe", 1, 3)), ["owner_id", "key"])
    short = met.filter(F.length("probe") <= 3).select("entry_id", "context_id")
    long = met.filter(F.length("probe") > 3).join(texts.drop("owner_id"), "context_id").filter(F.contains("text", F.col("probe"))).select("entry_id", "context_id")
    return short.unionByName(long)


def triggered(entries: DataFrame, contexts: DataFrame, stopwords: DataFrame, least: int = 5, few: int | None = None) -> DataFrame:
    """(entry_id, context_id, why) of an owner's entries: a tag stands in the context, or three characters of a longer one do, none of
    them stopwords (why: tag); or the context repeats ``least`` tokens of the entry (why: words).

    An owner's probes are looked for in its contexts one by one where they are few. Else contexts and probes meet on the first one to
    three characters of what is looked for."""
    entries, stopwords = settle(entries.select("owner_id", "entry_id", "tags", "content")), settle(stopwords.select("token"))
    tags = entries.select("owner_id", "entry_id", F.explode("tags").alias("tag"))
    tags = tags.select("owner_id", "entry_id", t.fold(F.col("tag")).alias("tag")).filter(F.length("tag") > 0).join(stopwords.select(t.fold(F.col("token")).alias("tag")), "tag", "left_anti")
    pieces = F.when(F.length("tag") >= 4, F.transform(F.sequence(F.lit(1), F.length("tag") - 2), lambda i: F.substring("tag", i, 3))).otherwise(F.array().cast("array<string>"))
    parts = tags.select("owner_id", "entry_id", F.explode(pieces).alias("probe")).join(stopwords.select(t.fold(F.col("token")).alias("probe")), "probe", "left_anti")
    probes = tags.select("owner_id", "entry_id", F.col("tag").alias("probe")).unionByName(parts).distinct()
    texts = contexts.select("owner_id", "context_id", t.fold(F.coalesce("content", F.lit(""))).alias("text"))
    found, rest = few_terms(texts.select("owner_id", F.col("context_id").alias("text_id"), F.col("text").alias("_low")), probes.withColumnsRenamed({"entry_id": "entity_id", "probe": "term"}), ["owner_id"], few)
    by_tag = found.select(F.col("entity_id").alias("entry_id"), F.col("text_id").alias("context_id"))
    if rest.limit(1).count():
        by_tag = by_tag.unionByName(_by_keys(texts.join(rest.select("owner_id").distinct(), "owner_id", "left_semi"), rest.withColumnsRenamed({"entity_id": "entry_id", "term": "probe"})))
    by_tag = by_tag.distinct().withColumn("why", F.lit("tag"))
    own = exploded(entries, ["owner_id", "entry_id"], F.array_distinct(t.index_tokens(F.col("content"))))
    said = exploded(contexts, ["owner_id", "context_id"], t.index_tokens(F.col("content")))
    by_words = own.join(said, ["owner_id", "token"]).groupBy("entry_id", "context_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    both = by_tag.unionByName(by_words.select("entry_id", "context_id", F.lit("words").alias("why")))
    return both.groupBy("entry_id", "context_id").agg(F.min("why").alias("why"))


def audit_candidates(episodes: DataFrame, messages: DataFrame, most: int = 3, sources: int = 5, chars: int = 150) -> DataFrame:
    """An owner's newest standard episodes without an audit, with their first source messages in order; those without sources or
    without text are skipped for that reason."""
    open_ = episodes.filter((F.col("kind") == "standard") & (F.coalesce("audit_status", F.lit("")) == ""))
    chosen = top_n(open_, ["owner_id"], [F.desc("created_at"), F.asc("memory_id")], most).drop("rank")
    ids = chosen.select("memory_id", F.posexplode(F.slice(F.coalesce("source_msg_ids", F.array().cast("array<long>")), 1, sources)).alias("place", "msg_id"))
    line = F.concat(F.lit("["), F.col("sender"), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    said = ids.join(messages.select("msg_id", "sender", "content"), "msg_id").groupBy("memory_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"),
        F.bool_or(F.trim(F.coalesce("content", F.lit(""))) != "").alias("has_text"),
    )
    n = F.size(F.coalesce("source_msg_ids", F.array().cast("array<long>")))
    out = chosen.join(said, "memory_id", "left")
    status = F.when(n == 0, "skipped_no_sources").when(~F.coalesce("has_text", F.lit(False)), "skipped_empty_msgs").otherwise("audit")
    return out.withColumn("audit_status", status).select("owner_id", "memory_id", "audit_status", "lines")


def match_triggers(monitors: DataFrame, new: DataFrame, links: DataFrame, fragments: DataFrame, corrections: DataFrame, now: Column) -> DataFrame:
    """(monitor_id, kind) of the monitors that fire: a keyword stands in a new fragment, their entity has a new fragment, their
    interval has passed, or a metric (entity_frag_count, correction_count) has reached its value.

    Monitors are (owner_id, monitor_id, kind, keywords, entity_id, interval_hours, last_at, metric, value)."""
    m = monitors
    # an owner's monitors have few keywords: each new fragment meets them as one array
    words = m.filter("kind = 'keyword'").select("owner_id", "monitor_id", F.filter(F.transform("keywords", lambda k: F.lower(k)), lambda k: k != "").alias("words"))
    held = words.groupBy("owner_id").agg(F.collect_list(F.struct("monitor_id", "words")).alias("held"))
    texts = new.select("owner_id", F.lower(F.coalesce("content", F.lit(""))).alias("low")).join(held, "owner_id")
    hit = F.filter("held", lambda h: F.exists(h["words"], lambda w: F.contains(F.col("low"), w)))
    by_word = texts.select(hit.alias("hit")).select(F.explode_outer("hit").alias("h")).filter("h is not null").select("h.monitor_id")
    own = m.filter("kind = 'entity'").select("owner_id", "monitor_id", "entity_id")
    by_entity = own.join(links.join(new.select("owner_id", "fragment_id"), "fragment_id").select("owner_id", "entity_id"), ["owner_id", "entity_id"], "left_semi").select("monitor_id")
    hours = (F.unix_timestamp(now) - F.unix_timestamp("last_at")) / 3600
    by_time = m.filter("kind = 'schedule' and interval_hours > 0").filter(F.col("last_at").isNull() | (hours >= F.col("interval_hours"))).select("monitor_id")
    limits = m.filter("kind = 'threshold'")
    counts = links.join(fragments.filter("status = 'active'").select("owner_id", "fragment_id"), "fragment_id").groupBy("owner_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    many = limits.filter("metric = 'entity_frag_count'").join(counts, ["owner_id", "entity_id"]).filter(F.col("n") >= F.coalesce("value", F.lit(10))).select("monitor_id")
    wrong = corrections.filter("status = 'active'").groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))
    often = limits.filter("metric = 'correction_count'").join(wrong, "owner_id").filter(F.col("n") >= F.coalesce("value", F.lit(5))).select("monitor_id")
    fired = by_word.unionByName(by_entity).unionByName(by_time).unionByName(many).unionByName(often).distinct()
    return m.select("monitor_id", "kind").join(fired, "monitor_id", "left_semi")
