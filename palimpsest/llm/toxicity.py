"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

A lexicon is learned first: the words and stems (first bytes of longer words) that stand out most in the labelled toxic
documents. Features of a text are lexicon densities, the distance of lexicon words from second-person words, capitals, punctuation and obfuscation rates
(letters and digits or signs mixed in a word, lexicon words that appear only when look-alike characters are read as letters).
Trees are fitted on four fifths of the sample, the calibration on the rest.

At most SAMPLE labelled documents are learned from, chosen by a hash of the id; scores cover all documents. Labels are read for
the ids that ``learn_from`` admits alone, and are no input of a score; nor are lang, source or doc_id. Null texts count as
empty; empty texts have no words and get the score of their zero features. Without labels of both kinds the score is the share
of ones, smoothed. Every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns
from .quality import remainder, sample
from .wordhash import chunks, words, words_and_stems

SAMPLE = 8000
#: Sizes of stems, in bytes.
STEMS = (4, 5, 6, 7, 8)
#: Words and stems of the lexicon, and least number of labelled documents that a word must be in.
LEXICON, LEAST_SEEN = 256, 8
#: A lexicon word is in toxic documents at least so many times as often, by share, as in others.
LEAST_LIFT = 4.0
TREES, LEVELS, BINS, RATE, SHRINK = 60, 3, 32, 0.2, 1.0
FAR = 50

#: Second-person words of the four languages of the corpus.
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine deinen ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tus ti".split()
#: Characters that are read as letters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = [
    "hits", "density", "weight_density", "best_weight", "distinct_hits", "disguised_hits", "nearest_you", "hits_near_you", "you_density",
    "capitals", "bangs", "punctuation", "mixed_words", "n_words",
]

_LOOK = np.arange(256, dtype=np.uint8)
for _a, _b in LOOK_ALIKE.items():
    _LOOK[ord(_a)] = ord(_b)
_CODES = np.arange(256)
_UPPER, _DIGIT = (_CODES >= 0x41) & (_CODES < 0x5B), (_CODES >= 0x30) & (_CODES < 0x3A)
_ASCII_LETTER = _UPPER | ((_CODES >= 0x61) & (_CODES < 0x7B))
_PUNCTUATION = (_CODES > 0x20) & (_CODES < 0x7F) & ~_ASCII_LETTER & ~_DIGIT


def _hash_list(items: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(items).encode(), np.uint8)
    return np.sort(words(data, np.array([0, len(data)]))[0])


def _in(sorted_keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are keys, and where in the keys those are. A small table turns away most of the others."""
    table = np.zeros(1 << 16, bool)
    table[(sorted_keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_keys, hashes[maybe]), max(len(sorted_keys) - 1, 0))
    same = sorted_keys[at] == hashes[maybe] if len(sorted_keys) else np.zeros(len(maybe), bool)
    hit = np.zeros(len(hashes), bool)
    hit[maybe[same]] = True
    return hit, at[same]


def _marks(keys: np.ndarray, weights: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of the words that are lexicon words or have a lexicon stem, their greatest weight, and that key's index."""
    best, which = np.zeros(lines.shape[1]), np.full(lines.shape[1], -1)
    for line in lines:
        hit, at = _in(keys, line)
        places = np.flatnonzero(hit)
        more = weights[at] > best[places]
        best[places[more]], which[places[more]] = weights[at][more], at[more]
    places = np.flatnonzero(which >= 0)
    return places, best[places], which[places]


def features(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; ``keys`` are the lexicon's word hashes, sorted, with their weights."""
    n = len(offsets) - 1
    bounds, lines = words_and_stems(data, offsets, STEMS)
    hashes = lines[0]
    n_words, size = np.diff(bounds), np.maximum(np.diff(offsets), 1)
    some = np.maximum(n_words, 1)
    owner = np.repeat(np.arange(n), n_words)
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    places, weight, at = _marks(keys, weights, lines)
    rows = owner[places]
    hits = np.bincount(rows, minlength=n)
    best = np.zeros(n)
    np.maximum.at(best, rows, weight)
    different = np.unique(rows * (len(keys) + 1) + at) // (len(keys) + 1)
    you = np.flatnonzero(_in(_YOU, hashes)[0])
    gap = np.full(len(places), FAR)
    if len(you) and len(places):
        after = np.searchsorted(you, places)
        for side in (np.minimum(after, len(you) - 1), np.maximum(after - 1, 0)):
            same = owner[you[side]] == rows
            gap = np.where(same, np.minimum(gap, np.abs(you[side] - places)), gap)
    nearest = np.full(n, FAR)
    np.minimum.at(nearest, rows, gap)
    read, read_bounds = words(_LOOK[data], offsets)
    read_hits = np.bincount(np.repeat(np.arange(n), np.diff(read_bounds))[_in(keys, read)[0]], minlength=n)
    letter, digit = _ASCII_LETTER[data], _DIGIT[data]
    mixed = np.zeros(len(data), bool)
    mixed[1:] = (letter[1:] & (digit | _PUNCTUATION[data])[:-1]) if len(data) else False
    mixed[:-2] &= letter[2:] if len(data) > 2 else False
    return np.column_stack(
        [
            hits, hits / some, np.bincount(rows, weight, n) / some, best, np.bincount(different, minlength=n), np.maximum(read_hits - hits, 0), nearest,
            np.bincount(rows[gap <= 5], minlength=n), np.bincount(owner[you], minlength=n) / some, per(_UPPER[data]) / np.maximum(per(letter), 1),
            per(data == 0x21) / size, per(_PUNCTUATION[data]) / size, per(mixed) / some, np.log1p(n_words),
        ]
    )


_YOU = _hash_list(SECOND_PERSON)


def _distinct_words(batches):
    """Each labelled text's distinct words and stems, hashed, with its label."""
    import pyarrow as pa

    for batch in batches:
        label = batch.column("label").to_numpy()
        for row, end, data, offsets in chunks(batch.column("text")):
            bounds, lines = words_and_stems(data, offsets, STEMS)
            own = [np.unique(lines[:, a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(label[row:end]), pa.array(own, pa.list_(pa.int64()))], ["label", "words"])


def lexicon(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that mark toxic texts, and their weights (log of the lift). At most LEXICON words."""
    seen = labelled.select("label", "text").mapInArrow(_distinct_words, "label int, words array<long>")
    totals = labelled.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not totals[0] or not totals[1]:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = seen.select("label", F.explode("words").alias("word")).filter("word <> 0").groupBy("word").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c"))
    lift = ((F.col("t") + 0.5) / (totals[0] + 1)) / ((F.col("c") + 0.5) / (totals[1] + 1))
    # the words that tell most: the excess of toxic documents over what their number in others leads to expect
    excess = F.col("t") - F.col("c") * totals[0] / totals[1]
    best = counts.withColumn("lift", lift).filter((F.col("t") >= LEAST_SEEN) & (F.col("lift") >= LEAST_LIFT)).orderBy(excess.desc(), "word").limit(LEXICON).collect()
    best = sorted((np.int64(r.word).view(np.uint64), float(np.log(r.lift))) for r in best)
    return np.array([b[0] for b in best], np.uint64), np.array([b[1] for b in best])


class Trees:
    """Complete trees of LEVELS levels: a feature and a threshold for each inner node, a value for each leaf."""

    def __init__(self, prior: float) -> None:
        self.prior, self.trees, self.steps, self.values = prior, [], np.array([-np.inf]), np.array([prior])

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for feature, threshold, value in self.trees:
            out += value[_leaf(x, feature, threshold)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: between two steps of the isotonic fit along the line."""
        return np.clip(np.interp(self.margin(x), self.steps, self.values), 0, 1)


def _leaf(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(LEVELS):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
    return node - (2**LEVELS - 1)


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    margin = np.full(len(y), model.prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(2**LEVELS - 1, np.int64), np.full(2**LEVELS - 1, np.inf), np.zeros(len(y), np.int64)
        for level in range(LEVELS):
            first, width = 2**level - 1, 2**level
            local, best = node - first, np.full(width, 1e-9)
            cut = np.full(width, BINS)
            for f in range(x.shape[1]):
                gs = np.bincount(local * BINS + binned[:, f], g, width * BINS).reshape(width, BINS)
                hs = np.bincount(local * BINS + binned[:, f], h, width * BINS).reshape(width, BINS)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best):
                    if at[k] < len(edges[f]):
                        best[k], cut[k] = gain[k, at[k]], at[k]
                        feature[first + k], threshold[first + k] = f, edges[f][at[k]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[local])
        leaf = node - (2**LEVELS - 1)
        value = RATE * np.bincount(leaf, g, 2**LEVELS) / (np.bincount(leaf, h, 2**LEVELS) + SHRINK)
        model.trees.append((feature, threshold, value))
        margin += value[leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing shares there, each block smoothed by one half of either label."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, number, least and greatest margin
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([t, 1, m, m])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    value = np.maximum.accumulate([(b[0] + 0.5) / (b[1] + 1) for b in blocks])
    steps = np.array([e for b in blocks for e in (b[2], b[3])])
    return steps, np.repeat(value, 2)


def fit(docs: DataFrame, labels: DataFrame, column: str, learn_from: Column):
    """(lexicon keys, weights, model), or the smoothed share of ones where there aren't both labels."""
    chosen = sample(labels, column, learn_from, SAMPLE)
    labelled = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    keys, weights = lexicon(labelled)
    rows = labelled.select("doc_id", "text", "label").mapInArrow(_rows(keys, weights), "doc_id long, label int, x array<double>").orderBy("doc_id").limit(2 * SAMPLE).toArrow().to_pandas()
    y = rows.label.to_numpy(np.float64)
    if len(set(y)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    x = np.stack(rows.x.to_list())
    rest = np.array([hash((int(d), 11)) % 5 == 0 for d in rows.doc_id])
    if len(set(y[~rest])) < 2 or len(set(y[rest])) < 2:
        rest = np.ones(len(y), bool)
    model = boost(x if rest.all() else x[~rest], y if rest.all() else y[~rest])
    model.steps, model.values = isotonic(model.margin(x[rest]), y[rest])
    return keys, weights, model


def _rows(keys, weights):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                x = features(data, offsets, keys, weights)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, end - row) for c in ("doc_id", "label")] + [pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    return run


def _scorer(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                score = np.full(end - row, model) if isinstance(model, float) else model[2].score(features(data, offsets, model[0], model[1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: toxicity of each text, learned without the ids of remainder 0 modulo 5."""
    texts = with_columns(docs, ("doc_id", "long"), ("text", "string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, labels, "toxic", remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    scored = texts.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
