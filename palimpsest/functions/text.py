"""Column functions over text: folding, tokens, hashes, intent and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Simplified characters and their traditional forms (a subset; ``fold`` takes any table).
SIMPLIFIED = "们个这来时会对说没过还点里后发开关学动画书车东见长门问间马鸟鱼岁电话谁两万与为从让给图国亲爱妈号级线觉记认识请谢钟银钱难欢头热听写读买卖边远进选运"
TRADITIONAL = "們個這來時會對說沒過還點裡後發開關學動畫書車東見長門問間馬鳥魚歲電話誰兩萬與為從讓給圖國親愛媽號級線覺記認識請謝鐘銀錢難歡頭熱聽寫讀買賣邊遠進選運"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "

CJK = r"㐀-䶿一-鿿぀-ヿ豈-﫿"
#: Words that make a question of one kind, and the stop characters of query tokens.
LONG_TERM = "之前 以前 上次 那次 曾經 長期 一直 還記得 主線 脈絡 曾经 长期 还记得 主线 脉络".split()
SUMMARY = "最近 這段時間 這陣子 近來 進展 總結 回顧 我們聊了什麼 这段时间 这阵子 近来 进展 总结 回顾 我们聊了什么".split()
FACT = "多少 哪裡 什麼時候 誰 有沒有 電話 地址 日期 幾點 哪個 多少錢 為什麼 怎麼 什麼 哪里 什么时候 谁 电话 几点 哪个 多少钱 为什么 怎么 什么".split()
UNITS = "元 塊 萬 億 % 歲 年 月 日 號 點 分鐘 小時 天 個 块 万 亿 岁 号 点 分钟 小时 个".split()
CUES = "上次 之前 以前 那次 那個 那件 那天 還記得 記得 記不記得 曾經 當時 那時 前陣子 上回 你說過 我說過 提過".split()
QUESTIONS = "？ ? 嗎 呢 什麼 甚麼 哪 誰 幾 多少 何時 怎麼 怎樣 為什麼 為何 是不是 有沒有 能不能 可不可以".split()
SMALLTALK = "好 好的 好啊 好喔 好吧 嗯 嗯嗯 哦 喔 噢 哈 哈哈 呵呵 嘿嘿 對 對啊 是 是的 是啊 行 可以 ok okay thanks hi hello bye".split()
COMMANDS = "幫我 請幫 請你 麻煩 打開 開啟 關閉 關掉 播放 暫停 設定 設置 提醒我 叫我 切換 搜尋 查一下".split()
STOP_CHARACTERS = "的了在是我你他她它們和與或但而也都就把被讓給從到對為以及等這那有沒不很太更最会會说說来來里裡过過着著吗嗎喔哪么麼什"
WEEK = "星期|禮拜|礼拜|周|週"
NUMERALS = "0-9零〇一二兩两三四五六七八九十百千萬万"
TIMES = "今天 明天 昨天 前天 後天 后天 今晚 昨晚 明晚 上午 下午 中午 早上 晚上 凌晨 傍晚 清晨 半夜 上週 下週 上周 下周 上個月 下個月 上个月 下个月 今年 去年 明年 週末 周末".split()
KEY = f"(?:{WEEK})[{NUMERALS}日天]|[{NUMERALS}]+|" + "|".join(TIMES)


def _any(words: list[str]) -> str:
    return "|".join("".join("\\" + c if c in r".?*+()[]{}|\^$" else c for c in w) for w in words)


def fold(text: Column, simplified: str = SIMPLIFIED, traditional: str = TRADITIONAL) -> Column:
    """Script folding, one character for one. Texts that hold none of the characters of the fixed table are left as they are, as a look-up
    for each character takes longer. A class's characters are tried one by one, so only for those that lie within its range."""
    folded = F.translate(text, simplified, traditional)
    return F.when(text.rlike(f"[{min(simplified)}-{max(simplified)}&&[{simplified}]]"), folded).otherwise(text) if simplified == SIMPLIFIED else folded


def normalise(text: Column) -> Column:
    """For comparison: full-width forms to ASCII, folded, lower case, without space, punctuation and symbols. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    half = F.when(text.rlike("[！-～　]"), F.translate(text, _FULL, _HALF)).otherwise(text)
    return F.regexp_replace(F.lower(fold(half)), r"[\s\p{P}\p{S}]+", "")


def index_tokens(text: Column) -> Column:
    """CJK runs as overlapping pairs (a single character stays), other runs of letters and digits as lower-case words; order and
    multiplicity are kept. Texts without CJK characters, which folding leaves as they are, are cut into words in one go."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(F.lower(fold(text)), F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{CJK}]{{2,}}$"), pairs(r)).otherwise(F.array(r))))
    return F.when(text.rlike(f"[{CJK}]"), cut).otherwise(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def query_tokens(text: Column, most: int = 64, shortest: int = 2) -> Column:
    """Distinct index tokens but those of stop characters alone and too short words, at most ``most``."""
    keep = lambda t: ~t.rlike(f"^[{STOP_CHARACTERS}]+$") & (t.rlike(f"^[{CJK}]") | (F.length(t) >= shortest))
    return F.slice(F.filter(F.array_distinct(index_tokens(text)), keep), 1, most)


def grams(text: Column, n: int) -> Column:
    """Runs of n neighbouring characters, in order. The characters are taken apart once: a substring counts from the text's start."""
    c = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    if n == 1:
        return c
    ends = F.slice(c, n, F.greatest(F.size(c) - (n - 1), F.lit(0)))
    return F.zip_with(F.slice(grams(text, n - 1), 1, F.size(ends)), ends, lambda x, y: F.concat(x, y))


def runs(text: Column, n: int) -> Column:
    """All runs of n neighbouring characters, in no order: those that begin at each remainder of n are matched in one go."""
    return F.concat(*[F.regexp_extract_all(F.substring(text, i + 1, 1 << 30), F.lit("(?s)" + "." * n), F.lit(0)) for i in range(n)])


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of a normalised text."""
    return F.when(F.length(text) >= 2, F.array_distinct(grams(text, 2))).otherwise(F.array().cast("array<string>"))


def key_tokens(text: Column) -> Column:
    """Numbers, weekdays and time words, sorted and joined: texts that differ here state different facts."""
    # only digits and CJK characters begin one; others are passed over without trying all words
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(f"(?=[0-9〇-鿿])(?:{KEY})"), F.lit(0))), "|")


def content_hash(entity: Column, content: Column) -> Column:
    return F.sha2(F.concat(normalise(entity), F.lit("\0"), normalise(content)), 256)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Keyed hash, lower-case hex, from two plain ones."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def intent(text: Column) -> Column:
    """long_term, summary, fact or semantic, in this order."""
    t = F.trim(F.coalesce(text, F.lit("")))
    number = rf"\d+\s*(?:{_any(UNITS)})"
    return F.when(t.rlike(_any(LONG_TERM)), "long_term").when(t.rlike(_any(SUMMARY)), "summary").when(t.rlike(f"{_any(FACT)}|{number}"), "fact").otherwise("semantic")


def gate(text: Column, names_entity: Column, continues: Column, min_chars: int = 4, command_chars: int = 14) -> Column:
    """Why a message is looked up or not; looked up for entity, cue, intent:*, question and default."""
    folded, bare, kind = F.lower(fold(F.coalesce(text, F.lit("")))), normalise(text), intent(text)
    question = folded.rlike(_any(QUESTIONS))
    small = (bare == "") | bare.rlike(f"^(?:{_any(sorted(SMALLTALK, key=len, reverse=True))})+$")
    command = F.regexp_replace(folded, r"^[\s\p{P}]+", "").rlike(f"^(?:{_any(COMMANDS)})")
    return (
        F.when(names_entity, "entity")
        .when(folded.rlike(_any(CUES)), "cue")
        .when(kind != "semantic", F.concat(F.lit("intent:"), kind))
        .when(~folded.rlike("[?？]") & small, "smalltalk")
        .when(~question & (F.length(bare) <= command_chars) & command, "command")
        .when(~question & (F.length(bare) < min_chars), "too_short")
        .when(continues, "continuation")
        .when(question, "question")
        .otherwise("default")
    )


def change_ratio(old: Column, new: Column) -> Column:
    """Edit distance of the normalised texts over the longer one's length."""
    a, b = normalise(old), normalise(new)
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def mention_weight(name: Column) -> Column:
    """How much a name says: 1 for each CJK character, one half for each other letter or digit."""
    cjk = F.length(F.regexp_replace(name, f"[^{CJK}]", ""))
    return cjk + (F.length(F.regexp_replace(name, r"[^\p{L}\p{N}]", "")) - cjk) / 2


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def to_utc(value: Column, zone: str = "UTC") -> Column:
    """Epoch seconds or milliseconds, zoned or unzoned text, as a timestamp; null where it is none of them."""
    t = F.trim(value)
    number = F.when(t.rlike(r"^\d{1,15}$"), t.cast("double"))
    zoned = t.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]")
    plain = F.try_to_timestamp(F.regexp_replace(t, "T", " "))
    return (
        F.when(number > 1e12, F.timestamp_millis(number.cast("long")))
        .when(number.isNotNull(), F.timestamp_seconds(number.cast("long")))
        .when(zoned, F.try_to_timestamp(t))
        .otherwise(F.to_utc_timestamp(plain, zone))
    )


def day_slot(hour: Column) -> Column:
    """Time of day by the hours 5, 11, 17 and 23."""
    return F.when(hour.between(5, 10), "morning").when(hour.between(11, 16), "afternoon").when(hour.between(17, 22), "evening").otherwise("night")
