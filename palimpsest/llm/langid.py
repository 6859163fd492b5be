"""Language identification in two steps: the family first, then one-versus-one linear support vector machines among the family's languages.

A text's features are its words and the runs of three bytes of its letters, lower-cased, hashed to PLACES places each; digits, signs and
layout count as gaps. A family is told by naive Bayes over the counts of all learned texts; its languages are told apart by a linear machine for each
pair, on features of length one, fitted by dual coordinate descent. Each machine has a vote; ties of votes go to the larger sum of margins,
then to the first name. A language that is in none of FAMILIES is a family of its own.

Counts for the families cover every text that may be learned from. Machines are fitted on at most PER_LANGUAGE texts of each language,
chosen by a hash of the id, in one task for each pair. Texts are scored where they lie.

Null texts and those without a letter are ``und`` of score 0, and aren't learned from; so is everything where nothing could be learned. lang, source
and doc_id are no inputs of a prediction. Every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, with_columns
from .quality import remainder
from .wordhash import chunks, mix, words

#: Places that words are hashed to, and as many that runs of three bytes are.
PLACES = 1 << 12
#: Texts that a machine is fitted on, at most, of each of its two languages.
PER_LANGUAGE = 400
#: Texts whose features are held together.
ROWS = 256
#: Passes over a pair's texts, and the price of a margin below one.
PASSES, PRICE = 20, 10.0
UNKNOWN = "und"

#: Families of languages (fixed values: ISO 639-1 codes).
FAMILIES = {
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "indo-aryan": "bn gu hi mr ne or pa sa si ur",
    "iranian": "fa ku ps tg",
    "romance": "an ast ca es fr gl it la oc pt rm ro",
    "semitic": "am ar he mt",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu se",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_GAP = np.full(256, 0x20, np.uint8)
_GAP[0x61:0x7B] = range(0x61, 0x7B)
_GAP[0x41:0x5B] = range(0x61, 0x7B)
_GAP[0x80:] = range(0x80, 0x100)


def family(lang: str) -> str:
    """The family of a language; a tag counts by its first part."""
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Place and row of each feature of some rows."""
    hashes, bounds = words(data, offsets)
    yield (hashes >> np.uint64(44)).astype(np.int64) % PLACES, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    letters = _GAP[data].astype(np.uint64)
    if len(letters) >= 3:
        runs = mix((letters[:-2] << np.uint64(16)) | (letters[1:-1] << np.uint64(8)) | letters[2:])
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        gap = letters == 0x20
        whole = (row[:-2] == row[2:]) & ~(gap[1:-1] & (gap[:-2] | gap[2:]))  # how wide a gap is tells nothing
        yield PLACES + (runs[whole] >> np.uint64(44)).astype(np.int64) % PLACES, row[:-2][whole]


def features(column):
    """(first row, end row, counts by row and place) of ROWS texts at most at a time."""
    for first, end, data, offsets in chunks(column):
        for lo in range(0, end - first, ROWS):
            hi = min(lo + ROWS, end - first)
            cut = offsets[lo : hi + 1]
            flat = [row * 2 * PLACES + place for place, row in _pieces(data[cut[0] : cut[-1]], cut - cut[0])]
            counts = np.bincount(np.concatenate(flat), minlength=(hi - lo) * 2 * PLACES)
            yield first + lo, first + hi, counts.reshape(hi - lo, 2 * PLACES).astype(np.float32)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Features of the machines: square roots of the counts, of length one by text."""
    roots = np.sqrt(counts)
    return roots / np.maximum(np.sqrt(counts.sum(1, keepdims=True)), 1)


def _counted(langs: list[str]):
    """What a partition's texts of each family have at each place."""

    def run(batches):
        import pyarrow as pa

        families = sorted({family(x) for x in langs})
        number = {x: families.index(family(x)) for x in langs}
        total, texts = np.zeros((len(families), 2 * PLACES), np.int64), np.zeros(len(families), np.int64)
        for batch in batches:
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            texts += np.bincount(own, minlength=len(families))
            for lo, hi, counts in features(batch.column("text")):
                for f in np.unique(own[lo:hi]):
                    total[f] += counts[own[lo:hi] == f].sum(0).astype(np.int64)
        f, place = np.nonzero(total)
        some = np.flatnonzero(texts)
        cells = [np.concatenate(x) for x in ((f, some), (place, np.full(len(some), -1)), (total[f, place], texts[some]))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["family", "place", "n"])

    return run


def _listed(batches):
    """The features of a text as places and counts."""
    import pyarrow as pa

    for batch in batches:
        for lo, hi, counts in features(batch.column("text")):
            row, place = np.nonzero(counts)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (place.astype(np.int32), counts[row, place])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("lang", "key")], *lists], ["lang", "key", "places", "counts"])


def descend(x: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine (the last one alone, for a constant) on rows x of signs y: coordinate descent on the dual of the squared hinge loss."""
    rng, x = np.random.default_rng(seed), np.column_stack([x, np.ones(len(x), x.dtype)])
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    diagonal = (x.astype(np.float64) ** 2).sum(1) + 0.5 / PRICE
    for _ in range(PASSES):
        for i in rng.permutation(len(y)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / PRICE
            new = max(alpha[i] - slope / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _fit_pair(rows):
    """A pair's machine; its two languages' texts are at most 2 * PER_LANGUAGE."""
    import pandas as pd

    rows = rows.sort_values(["lang", "key"], ignore_index=True)  # the same machine whatever order the rows come in
    counts = np.zeros((len(rows), 2 * PLACES), np.float32)
    for i, (places, n) in enumerate(zip(rows.places, rows.counts, strict=True)):
        counts[i, places] = n
    w = descend(scaled(counts), np.where(rows.lang == rows.a, 1.0, -1.0))
    return pd.DataFrame({"a": [rows.a[0]], "b": [rows.b[0]], "w": [w.tolist()]})


class Model:
    """langs, the families' names, log probabilities of places, prior logs, and a machine for each pair (a, b) of a family, a before b."""

    def __init__(self, langs: list[str], families: list[str], logs: np.ndarray, prior: np.ndarray, machines: dict[tuple[str, str], np.ndarray]) -> None:
        self.langs, self.families, self.logs, self.prior = langs, families, logs, prior
        self.members = [sorted(x for x in langs if family(x) == f) for f in families]
        self.pairs = [list(combinations(m, 2)) for m in self.members]
        self.weights = [np.stack([machines[p] for p in pairs]).astype(np.float32) if pairs else None for pairs in self.pairs]

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores: the family's probability by the mean of its machines' for the language."""
        n = np.maximum(counts.sum(1), 1)
        # tokens of a text aren't independent: beyond some hundred its length adds no certainty
        logs = (counts @ self.logs.T) * np.minimum(1, 200 / n)[:, None] + self.prior
        logs -= logs.max(1, keepdims=True)
        share = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
        own = share.argmax(1)
        lang, score, x = np.empty(len(counts), object), share[np.arange(len(counts)), own].astype(np.float64), None
        for f in np.unique(own):
            rows, members = np.flatnonzero(own == f), self.members[f]
            if len(members) == 1:
                lang[rows] = members[0]
                continue
            x = scaled(counts) if x is None else x
            w = self.weights[f]
            margin = x[rows] @ w[:, :-1].T + w[:, -1]
            sure = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
            votes, sums, means = (np.zeros((len(rows), len(members))) for _ in range(3))
            for k, (a, b) in enumerate(self.pairs[f]):
                i, j = members.index(a), members.index(b)
                for at, sign in ((i, 1), (j, -1)):
                    votes[:, at] += sign * margin[:, k] >= 0 if sign > 0 else margin[:, k] < 0
                    sums[:, at] += sign * margin[:, k]
                    means[:, at] += (sure[:, k] if sign > 0 else 1 - sure[:, k]) / (len(members) - 1)
            best = np.array([max(range(len(members)), key=lambda m, r=r: (votes[r, m], sums[r, m], -m)) for r in range(len(rows))])
            lang[rows] = np.array(members, object)[best]
            score[rows] *= means[np.arange(len(rows)), best]
        return lang, np.clip(score, 0, 1)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn_from: Column) -> Model | None:
    """A model of the texts with a language and a letter that ``learn_from`` admits; None where there are none."""
    known = with_columns(docs, ("doc_id", "long"), ("text", "string"), ("lang", "string")).filter(learn_from & F.col("lang").isNotNull() & has_letter(F.col("text")))
    per = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not per:
        return None
    langs = sorted(per)
    families = sorted({family(x) for x in langs})
    counted = known.select("lang", "text").mapInArrow(_counted(langs), "family long, place long, n long").groupBy("family", "place").agg(F.sum("n").alias("n"))
    counts, texts = np.zeros((len(families), 2 * PLACES)), np.zeros(len(families))
    for r in counted.collect():  # families x places at most
        if r.place < 0:
            texts[r.family] = r.n
        else:
            counts[r.family, r.place] = r.n
    half = counts.reshape(len(families), 2, PLACES) + 0.5
    logs = np.log(half / half.sum(2, keepdims=True)).reshape(len(families), 2 * PLACES).astype(np.float32)
    pairs = [p for f in families for p in combinations([x for x in langs if family(x) == f], 2)]
    machines: dict[tuple[str, str], np.ndarray] = {}
    if pairs:
        spark = docs.sparkSession
        pair_rows = F.broadcast(spark.createDataFrame([(a, b, x) for a, b in pairs for x in (a, b)], "a string, b string, lang string"))
        fitted = _chosen(known, per).mapInArrow(_listed, "lang string, key long, places array<int>, counts array<float>")
        # a text's features are made once, then meet the pairs of its language
        rows = materialize(fitted).join(pair_rows, "lang")
        for r in rows.groupBy("a", "b").applyInPandas(_fit_pair, "a string, b string, w array<double>").collect():  # a row for each pair
            machines[r.a, r.b] = np.array(r.w)
    return Model(langs, families, logs, np.log(texts / texts.sum()), machines)


def _chosen(known: DataFrame, per: dict[str, int]) -> DataFrame:
    """At most PER_LANGUAGE texts of each language: those of the smallest hashes of their ids. A hash below a share of its range is asked for
    first, so that few rows are ranked."""
    hashed = known.select("lang", "text", F.xxhash64("doc_id").alias("key"))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, (2 * PER_LANGUAGE + 50) / n))) for x, n in per.items()])
    near = hashed.filter((F.col("key").cast("double") / 2.0**64 + 0.5) <= share)
    # equal ids with their texts are ranked by the texts' hashes
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", F.xxhash64("text")))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= PER_LANGUAGE).select("lang", "key", "text")


def _predictor(shared):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs, scores = [], []
            for _, _, counts in features(batch.column("text")):
                lang, score = shared.value.predict(counts)
                langs.extend(lang.tolist())
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("known"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "known", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    texts = with_columns(docs, ("doc_id", "long"), ("text", "string")).withColumn("known", has_letter(F.col("text")))
    if model is None:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = texts.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, known boolean, lang_pred string, score double")
    return out.select("doc_id", F.when(F.col("known"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("known"), F.col("score")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned without the ids of remainder 1 modulo 3."""
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    found = predict(docs, fit(docs, remainder("doc_id", 3) != 1))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
