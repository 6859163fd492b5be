"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of whole texts.

A text's features are its distinct words, hashed to WORDS places, and statistics of its structure, each as a place of its
quantile, with the length as metadata. Every place i has a weight w_i and a vector v_i of RANK numbers; the score adds all pairwise products
<v_i, v_j> x_i x_j in time linear in the features: half of the square of the sum less the sum of the squares, by factor.

The model is fitted on at most SAMPLE labelled documents, chosen by a hash of the id; everything else covers all documents.
Labels are read for the ids that ``learn_from`` admits alone, and are no input of a score; nor are lang, source or doc_id.
Null texts count as empty, and empty texts are scored by their statistics. Without labels of both kinds the score is the share
of ones, smoothed. Every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, with_columns
from .wordhash import chunks, shingles, words

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6000
WORDS = 1 << 12
RANK = 8
QUANTILES = 12
EPOCHS = 12
BATCH = 256
RATE = 0.03
DECAY = 1e-4

_KINDS = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "line": [0x0A],
    "stop": [0x2E, 0x2C],
    "bang": [0x21],
    "bar": [0x7C],
    "symbol": [*range(0x22, 0x2C), 0x2D, 0x2F, *range(0x3A, 0x41), *range(0x5B, 0x61), 0x7B, 0x7D, 0x7E],
    "wide": range(0x80, 0x100),
}
_MASKS = np.zeros((len(_KINDS), 256), bool)
for _i, _codes in enumerate(_KINDS.values()):
    _MASKS[_i, list(_codes)] = True
STATISTICS = [*_KINDS, "upper_of_letters", "word_length", "distinct_words", "distinct_triples", "n_bytes"]


def statistics(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    size, n_words = np.diff(offsets), np.diff(bounds)
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    counts = np.stack([per(m[data]) for m in _MASKS], 1).astype(np.float64)
    upper, lower = counts[:, 0], counts[:, 1]
    some = np.maximum(n_words, 1)
    triples, _, cut = shingles(hashes, bounds, 3)
    rest = [
        upper / np.maximum(upper + lower, 1),
        counts[:, [0, 1, 2, 8]].sum(1) / some,
        _distinct(hashes, bounds) / some,
        _distinct(triples, cut) / np.maximum(np.diff(cut), 1),
        np.log1p(size),
    ]
    return np.column_stack([counts / np.maximum(size, 1)[:, None], *rest])


def _distinct(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct tokens in each row."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((tokens, owner))
    t, o = tokens[order], owner[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(bounds) - 1)


def _hashed(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row bounds): the distinct places of each row's words."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int64)
    both = np.unique(owner * WORDS + (hashes >> np.uint64(40)).astype(np.int64) % WORDS)
    return both % WORDS, np.searchsorted(both // WORDS, np.arange(len(bounds)))


def _features(batches):
    """doc_id, statistics and hashed words of each text."""
    import pyarrow as pa

    for batch in batches:
        for row, end, data, offsets in chunks(batch.column("text")):
            hashes, bounds = words(data, offsets)
            stats, (place, cut) = statistics(data, offsets, hashes, bounds), _hashed(hashes, bounds)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(list(stats), pa.list_(pa.float64())), lists], ["doc_id", "statistics", "places"])


class Machine:
    """Quantile edges of the statistics, w0, w, v."""

    def __init__(self, edges: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.edges, self.w0, self.w, self.v = edges, w0, w, v

    def inputs(self, stats: np.ndarray, place: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, value, row bounds) with the statistics' places behind the words', which share a weight of one by text."""
        n, k = stats.shape
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(k)], 1)
        own = WORDS + np.arange(k) * (QUANTILES + 1) + bins
        at = np.insert(place, np.repeat(cut[1:], k), own.ravel())
        value = np.insert(np.repeat(1 / np.sqrt(np.maximum(np.diff(cut), 1)), np.diff(cut)), np.repeat(cut[1:], k), 1.0)
        return at, value, cut + k * np.arange(n + 1)

    def margin(self, at: np.ndarray, value: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The margins, and the sums by factor. No row is without features."""
        x = self.v[at] * value[:, None]
        total = np.add.reduceat(x, cut[:-1])
        pairs = 0.5 * (total**2 - np.add.reduceat(x**2, cut[:-1])).sum(1)
        return self.w0 + np.add.reduceat(self.w[at] * value, cut[:-1]) + pairs, total


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def train(stats: np.ndarray, places: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    edges = np.quantile(stats, np.linspace(0, 1, QUANTILES + 2)[1:-1], axis=0).T
    size = WORDS + stats.shape[1] * (QUANTILES + 1)
    model = Machine(edges, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    params = [np.array([model.w0]), model.w, model.v]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            cut = np.concatenate(([0], np.cumsum([len(places[i]) for i in rows])))
            at, value, cut = model.inputs(stats[rows], np.concatenate([places[i] for i in rows]), cut)
            margin, total = model.margin(at, value, cut)
            error = np.repeat(_sigmoid(margin) - labels[rows], np.diff(cut)) / len(rows)
            wide = np.repeat(total, np.diff(cut), 0)
            dv = (error * value)[:, None] * (wide - model.v[at] * value[:, None])
            grads = [
                np.array([error[cut[:-1]].sum()]),
                np.bincount(at, error * value, size) + DECAY * model.w,
                np.stack([np.bincount(at, dv[:, f], size) for f in range(RANK)], 1) + DECAY * model.v,
            ]
            step += 1
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            model.w0 = float(params[0][0])
    return model


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def sample(labels: DataFrame, column: str, learn_from: Column, bound: int = SAMPLE) -> DataFrame:
    """At most ``bound`` labelled ids (doc_id, label), the same ones each time."""
    known = with_columns(labels, ("doc_id", "long"), (column, "int")).filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learn_from)
    return known.groupBy("doc_id").agg(F.max(column).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame, column: str, learn_from: Column) -> Machine | float:
    """A machine, or the smoothed share of ones where there aren't both labels."""
    chosen = sample(labels, column, learn_from)
    texts = with_columns(docs, ("doc_id", "long"), ("text", "string")).join(F.broadcast(chosen), "doc_id")
    featured = texts.select("doc_id", "text").mapInArrow(lean(_features), "doc_id long, statistics array<double>, places array<int>")
    rows = featured.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").limit(2 * SAMPLE).toArrow().to_pandas()
    y = rows.label.to_numpy(np.float64)
    if len(set(y)) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    return train(np.stack(rows.statistics.to_list()), [np.asarray(p, np.int64) for p in rows.places], y)


def _scorer(shared, others: list[str], name: str):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            scores = []
            for row, end, data, offsets in chunks(batch.column("text")):
                if isinstance(model, float):
                    scores.append(np.full(end - row, model))
                    continue
                hashes, bounds = words(data, offsets)
                at = model.inputs(statistics(data, offsets, hashes, bounds), *_hashed(hashes, bounds))
                scores.append(_sigmoid(model.margin(*at)[0]))
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], score], [*others, name])

    return run


def score(docs: DataFrame, model: Machine | float, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row, and its score as ``name``. ``docs`` needs a column text."""
    columns = docs.select(*[F.col(f"`{c}`") for c in keep])
    out = T.StructType([*columns.schema.fields, T.StructField(name, T.DoubleType())])
    inputs = columns if "text" in keep else docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text"))
    return inputs.mapInArrow(lean(_scorer(docs.sparkSession.sparkContext.broadcast(model), keep, name)), out)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: quality of each text, learned without the ids of remainder 1 modulo 3."""
    texts = with_columns(docs, ("doc_id", "long"), ("text", "string"))
    model = fit(texts, labels, "quality", remainder("doc_id", 3) != 1)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score(texts, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
