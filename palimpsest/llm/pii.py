"""Personal data by bootstrapped contextual extraction.

Four base kinds are found by pattern: email, ip, card, phone. They are the seeds. Each stands in a lexical pattern (the two words
before it, digits folded); every other identifier-like token, one that has digits, is an instance that may stand in the same
patterns. Rounds go over the pattern-instance graph: a pattern is scored by its known instances (support), by their share of those whose
nature is known (precision), and by their share of all (so that words that anything follows admit nothing); patterns that pass are
admitted, their instances become known, and support further patterns. The rounds end when one adds no instance. Known not to be personal are
numbers of a card's length that fail its check, and tokens that stand in many places. What admitted patterns discover gets kind ``id``.

Identifiers have six characters or more, however many, and don't overlap base spans, which are blanked before they are looked for. A
context's two words lie within CONTEXT characters. All work on a text is in proportion to it; a round reads the graph's edges, a row for each
pattern and distinct instance.

Null and empty texts have no spans; every row of the input gives one row; extra columns are ignored. Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns

#: Base patterns. Where the contract's pattern has a plain quantifier that can't give back anything useful, it is possessive
#: here, and a match begins only at the start of a run or where the last match ended: same matches, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "id"]
#: An instance: a token of 6 characters or more with a digit in it.
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
CONTEXT = 128
#: What admits a pattern: known instances, their share of the known and the negative ones, and of all.
MIN_SUPPORT, MIN_PRECISION, MIN_SHARE = 5, 0.8, 0.2
#: A token in so many places, and in this share of the documents, is no identifier of a person.
COMMON_PLACES, COMMON_SHARE = 50, 0.001
#: Matches that are summed together; sums of blocks are summed in turn, so that no long array is built up item by item.
BLOCK = 128

_SPAN = "array<struct<kind:int,start:int,end:int,hit:string>>"


def _cut(rows: DataFrame, text: str, pattern: str, may: Column) -> DataFrame:
    """The matches in ``_h`` and the pieces around them in ``_g``. Both are columns of their own, as a lambda evaluates whatever else it
    names once for every element."""
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_h", F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    return rows.withColumn("_g", F.when(F.size("_h") > 0, F.split(text, pattern, -1)).otherwise(none))


def _scan(lengths: Column) -> Column:
    """The sum of the lengths before each, and of all."""
    grow = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), grow)


def _with_spans(rows: DataFrame, text: str, pattern: str, kind: int, keep, may: Column, name: str) -> DataFrame:
    """A column of all matches that ``keep`` passes with their places, in code points, and the text before each: the pieces between
    matches say where each one starts."""
    rows = _cut(rows, text, pattern, may)
    rows = rows.withColumn("_n", F.zip_with(F.slice("_g", F.lit(1), F.size("_h")), "_h", lambda g, h: F.length(g) + F.length(h)))
    count = F.greatest(F.ceil(F.size("_n") / BLOCK), F.lit(1)).cast("int")
    rows = rows.withColumn("_b", F.transform(F.sequence(F.lit(0), count - 1), lambda b: _scan(F.slice("_n", b * BLOCK + 1, F.lit(BLOCK)))))
    rows = rows.withColumn("_f", _scan(F.transform("_b", lambda x: x["at"]))["out"])
    rows = rows.withColumn("_e", F.flatten(F.zip_with("_b", "_f", lambda x, first: F.transform(x["out"], lambda at: at + first))))
    # the two words before a match may be the matches before it
    piece = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    tail = lambda i: F.right(F.concat(piece("_h", i - 2), piece("_g", i - 1), piece("_h", i - 1), piece("_g", i)), F.lit(CONTEXT))

    def span(hit: Column, i: Column) -> Column:
        start = F.get("_e", i) + F.length(F.get("_g", i))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"), tail(i).alias("before"))

    found = F.filter(F.transform("_h", span), lambda s: F.coalesce(keep(s["hit"]), F.lit(False)))
    return rows.withColumn(name, found).drop("_h", "_g", "_n", "_b", "_f", "_e")


def _blanked(rows: DataFrame, text: str, pattern: str, keep, may: Column) -> DataFrame:
    """``rows`` whose text has a blank for each character of the matches that ``keep`` passes."""
    rows = _cut(rows, text, pattern, may)
    out = F.transform("_h", lambda h: F.when(F.coalesce(keep(h), F.lit(False)), F.repeat(F.lit(" "), F.length(h))).otherwise(h))
    pieces = F.concat(F.zip_with(F.slice("_g", F.lit(1), F.size("_h")), out, lambda g, h: F.concat(g, h)), F.slice("_g", F.size("_h") + 1, F.lit(1)))
    return rows.withColumn(text, F.when(F.size("_h") > 0, F.array_join(pieces, "")).otherwise(F.col(text))).drop("_h", "_g")


def _luhn(hit: Column) -> Column:
    digits = F.reverse(F.regexp_replace(hit, "[ -]", ""))
    n = F.length(digits)

    def add(total: Column, at: Column) -> Column:
        d = F.substr(digits, at, F.lit(1)).cast("int") * F.when(at % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), add) % 10 == 0)


_KEEP = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)(\.|$)){4}$"),
    "card": _luhn,
    "phone": lambda hit: F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15),
}
#: What a text must have for a match: a cheap test before the pattern runs.
_NEEDS = {"email": "@", "phone": "+"}


def _may(text: str, name: str) -> Column:
    return F.contains(text, F.lit(_NEEDS[name])) if name in _NEEDS else F.col(text).rlike("[0-9]")


def _context(before: Column) -> Column:
    """The two words before a place, lower case, digits folded: the pattern that the place stands in."""
    return F.regexp_replace(F.lower(F.regexp_extract(before, r"(\S+[^\S\n]+\S+)[^\S\n]*$", 1)), "[0-9]+", "0")


def find(docs: DataFrame) -> DataFrame:
    """The input's rows as doc_id, uid, base (array of kind, start, end, hit) and spans, which has the method's too."""
    rows = with_columns(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        rows = _with_spans(rows, "text", pattern, kind, _KEEP[name], _may("text", name), f"_{name}")
    rows = rows.withColumn("base", F.concat(*[f"_{name}" for name in PATTERNS])).withColumn("_text", F.col("text"))
    for name, pattern in PATTERNS.items():
        rows = _blanked(rows, "_text", pattern, _KEEP[name], F.size(f"_{name}") > 0)
    rows = _with_spans(rows, "_text", TOKEN, len(PATTERNS), lambda hit: F.lit(True), F.col("_text").rlike("[0-9]"), "tokens")
    place = lambda s, *more: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "hit")], *more)
    placed = F.transform(F.concat("base", "tokens"), lambda s: place(s, _context(s["before"]).alias("context")))
    found = materialize(rows.select("doc_id", "uid", F.transform("base", lambda s: place(s)).alias("base"), placed.alias("placed")))

    seen = found.select("uid", F.explode("placed").alias("s")).select("uid", "s.*").filter(F.col("context") != "")
    known = graph(seen, found.count())
    new = (
        seen.filter(F.col("kind") == len(PATTERNS))
        .join(known, ["context", "hit"], "left_semi")
        .groupBy("uid")
        .agg(F.collect_set(F.struct("kind", "start", "end", "hit")).alias("more"))
        .withColumnRenamed("uid", "new_uid")
    )
    added = F.concat("base", F.coalesce(F.array_sort("more"), F.array().cast(_SPAN)))
    return found.join(new, F.col("uid") == F.col("new_uid"), "left").select("doc_id", "uid", "base", added.alias("spans"))


def graph(seen: DataFrame, documents: int) -> DataFrame:
    """(context, hit) to be trusted, of all places (kind, hit, context)."""
    edges = materialize(seen.groupBy("context", "hit").agg(F.max(F.col("kind") < len(PATTERNS)).alias("known"), F.count(F.lit(1)).alias("n")))
    unseen = edges.filter(~F.col("known"))
    common = unseen.groupBy("hit").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(COMMON_PLACES, COMMON_SHARE * documents)).select("hit", F.lit(True).alias("_common"))
    number = F.col("hit").rlike("^[0-9-]+$") & F.length(F.replace("hit", F.lit("-"), F.lit(""))).between(13, 19)
    marked = edges.join(common, "hit", "left").select("context", "hit", "known", (~F.col("known") & (number | F.col("_common").isNotNull())).alias("negative"))
    return bootstrap(marked)


def bootstrap(edges: DataFrame) -> DataFrame:
    """(context, hit) of the instances that admitted patterns hold, from distinct (context, hit, known, negative)."""
    edges, trusted = materialize(edges), None
    while True:
        support, against = F.count_if("known"), F.count_if("negative")
        scores = edges.groupBy("context").agg(support.alias("pos"), against.alias("neg"), F.count(F.lit(1)).alias("n"))
        good = (F.col("pos") >= MIN_SUPPORT) & (F.col("pos") >= MIN_PRECISION * (F.col("pos") + F.col("neg"))) & (F.col("pos") >= MIN_SHARE * F.col("n"))
        trusted = materialize(scores.filter(good).select("context"))
        added = materialize(edges.join(trusted, "context", "left_semi").filter("not known and not negative").select("hit").distinct().withColumn("_new", F.lit(True)))
        if added.isEmpty():
            # what was known keeps its place where its pattern is trusted; a pattern's negative instances don't count
            return edges.join(trusted, "context", "left_semi").filter("known").select("context", "hit")
        edges = materialize(edges.join(added, "hit", "left").select("context", "hit", (F.col("known") | F.col("_new").isNotNull()).alias("known"), "negative"))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts by base kind, the base spans' SHA-256 and all spans as text."""
    label = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    line = lambda c: F.array_join(F.transform(c, label), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)], F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


