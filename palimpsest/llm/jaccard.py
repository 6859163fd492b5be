"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; two are linked when their Jaccard similarity is at least LAMBDA. Texts with equal bags of
shingles form a class, and only classes meet. A class is seen through SIGNATURE minwise tokens, of which two classes share each
with their similarity as chance. A run starts with all classes in one bucket and splits it by a path of PATH sampled tokens: only
classes that share all of them stay together. A bucket that is still too large picks two more positions, puts a class into the
bucket of each token it has there, and so on; small buckets, the leaves, are brute-forced. Further splits lose a pair with a
chance below the fixed point of q = (1 - LAMBDA + LAMBDA q)^2 at any depth, and as many runs are made as the target recall asks
for. A bucket whose split would keep more than 1 / SHRINK of it in one part holds near copies; it isn't split but stuck.

Stuck buckets are settled by pivots. A pivot is the set of the shingles that most of PIVOT_OF members have; every member is
compared with it exactly. Jaccard distance is a metric, so two members whose distances to one pivot add up to at most 1 - LAMBDA
are linked: such links are counted from the histogram of distances and never looked at one by one. Only pairs that this doesn't
decide are brute-forced: the bucket is dealt into blocks, the ones near the pivot apart from the others, and pairs of blocks
become leaves, but no pair of blocks of which both are near. The choice of pivots has no effect on the result, only on the work.

In a leaf, pairs whose signatures agree too little, first by one bit of each token, are dismissed, the others are verified exactly
on whole shingle sets. A pair that meets in several buckets counts in the smallest of them alone, so pairs are never gathered: a
leaf gives each class its number of links and the root of its part, and connected components of those roots make the groups.

Texts of fewer than five words, but not none, have one shingle. Null and empty texts make one class without links. Every row
gives one row; a null doc_id is never a class's id unless it has no other. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits, in_bits, join_by_key, lean, materialize, with_columns
from .wordhash import all_words, chunks, mix, shingles, words

LAMBDA = 0.8
TARGET_RECALL = 0.9999
SIGNATURE = 128
#: Tokens that the first split of a run takes at once.
PATH = 3
#: Classes in a leaf.
LEAF = 512
#: Splits of a bucket before it is dealt into blocks; each level has its own positions of the signature.
DEPTH = 9
#: The largest part of a split must have at most this share of the bucket (its inverse), or the bucket is stuck.
SHRINK = 4
#: Members of a stuck bucket, those of the smallest hashes, whose shingles make its pivot.
PIVOT_OF = 64
#: Rows of two longs, 3 MB, that may be broadcast after they have been counted.
FEW = 200_000
#: Bytes of pivots that may be broadcast after they have been summed.
HELD = 32 << 20
#: Steps of the distance to a pivot, which is rounded up to them.
STEPS = 1000
#: Bits of the filter that says which documents' shingle sets are wanted: 8 MB for any number of them.
LOG2_BITS = 26

_R = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64))
_XOR, _ODD = (_R >> np.uint64(32)).astype(np.uint32), _R.astype(np.uint32) | np.uint32(1)


def runs(target: float = TARGET_RECALL, similarity: float = LAMBDA) -> int:
    """Runs until a pair of that similarity is found with that chance, wherever its buckets have to be split further."""
    lost = 0.0
    for _ in range(1000):
        lost = (1 - similarity + similarity * lost) ** 2
    found = min(similarity**PATH * (1 - lost), 1 - 1e-12)
    return max(1, ceil(log(1 - target) / log(1 - found)))


def _sets(data, offsets):
    """Shingles of each row with their bounds; rows of fewer words than a shingle, but not none, get one."""
    hashes, bounds = words(data, offsets)
    tokens, _, cut = shingles(hashes, bounds)
    short = np.flatnonzero((np.diff(cut) == 0) & (np.diff(bounds) > 0))
    if len(short):
        extra = np.array([all_words(hashes[bounds[i] : bounds[i + 1]]) for i in short], np.uint64)
        tokens = np.insert(tokens, cut[short], extra)
        cut = cut + np.concatenate(([0], np.cumsum(np.isin(np.arange(len(cut) - 1), short))))
    return tokens, cut


def _digests(tokens, cut):
    """16 bytes a row that say which bag of shingles it has."""
    full = np.flatnonzero(np.diff(cut))
    out = np.zeros((len(cut) - 1, 2), np.uint64)
    if len(full):
        out[full, 0] = np.add.reduceat(mix(tokens + _R[0]), cut[full])
        out[full, 1] = np.add.reduceat(mix(tokens ^ _R[1]), cut[full])
    return out, full


def _fixed(array, width):
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(width), len(array), [None, pa.py_buffer(np.ascontiguousarray(array))]).cast(pa.binary())


def _signatures(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("doc_id")
        for row, end, data, offsets in chunks(batch.column("text")):
            tokens, cut = _sets(data, offsets)
            digest, full = _digests(tokens, cut)
            signature = np.zeros((end - row, SIGNATURE), np.uint32)
            if len(full):
                x, at = (tokens >> np.uint64(32)).astype(np.uint32), cut[full]
                for j in range(SIGNATURE):
                    signature[full, j] = np.minimum.reduceat((x ^ _XOR[j]) * _ODD[j], at)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, end - row), _fixed(digest, 16), pa.array(np.diff(cut).astype(np.int64)), _fixed(signature, 4 * SIGNATURE)], ["doc_id", "digest", "n", "signature"]
            )


def _token(signature: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(signature[np.arange(len(signature)), at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32)))


def _roots(n_runs: int):
    """Rows of (node, signature) to one row for each run: the bucket of the run's first path."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, nodes = batch.num_rows, batch.column("node")
            signature = _matrix(batch.column("signature"), n)
            for r in range(n_runs):
                bucket = np.full(n, r, np.uint64)
                for i in range(PATH):
                    bucket = mix(bucket + _token(signature, np.full(n, (r * PATH + i) % SIGNATURE)))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), nodes], ["bucket", "node"])

    return run


def _split(depth: int, n_runs: int):
    """Rows of (bucket, node, signature) to the two buckets of the tokens that the bucket picks at its depth: (parent, bucket, node)."""
    base = min(n_runs * PATH, SIGNATURE // 2)
    width = (SIGNATURE - base) // DEPTH

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            signature = _matrix(batch.column("signature"), batch.num_rows)
            keys = batch.column("bucket").to_numpy().view(np.uint64)
            h = mix(keys)
            first = h % np.uint64(width)
            second = (first + np.uint64(1) + (h >> np.uint64(20)) % np.uint64(width - 1)) % np.uint64(width)
            for pick in (first, second):
                at = (pick + np.uint64(base + (depth - 1) * width)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("bucket"), pa.array(mix(keys + _token(signature, at)).view(np.int64)), batch.column("node")], ["parent", "bucket", "node"]
                )

    return run


def _matrix(column, n):
    """A binary column of signatures as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(n, SIGNATURE) if n else np.zeros((0, SIGNATURE), np.uint32)


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are few, so that all the classes' signatures needn't be shuffled to meet them."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def leaves(classes: DataFrame, n_runs: int) -> tuple[DataFrame, DataFrame | None]:
    """Of all runs, (bucket, node) of the buckets of 2 to LEAF classes, and (bucket, node, size) of the stuck ones, if any."""
    rows, small, stuck = classes.select("node", "signature").mapInArrow(_roots(n_runs), "bucket long, node long"), [], []
    for depth in range(1, DEPTH + 2):
        rows = materialize(rows)
        sizes = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        placed = materialize(join_by_key(rows, sizes, "bucket", "size"))
        small.append(placed.filter(F.col("size") <= LEAF).select("bucket", "node"))
        large = placed.filter(F.col("size") > LEAF)
        if large.isEmpty():
            break
        if depth > DEPTH:
            stuck.append(large)
            break
        parts = classes.select("node", "signature").join(_small(large.select("bucket", "node")), "node")
        parts = materialize(parts.mapInArrow(_split(depth, n_runs), "parent long, bucket long, node long"))
        widest = parts.groupBy("parent", "bucket").count().groupBy("parent").agg(F.max("count").alias("most"))
        known = sizes.filter(F.col("size") > LEAF).join(widest, F.col("bucket") == F.col("parent"))
        known = materialize(known.select("bucket", "size", (F.col("most") * SHRINK > F.col("size")).alias("keeps")))
        stuck.append(join_by_key(large.select("bucket", "node"), known.filter("keeps").select("bucket", "size"), "bucket", "size"))
        split = known.filter("not keeps").select(F.col("bucket").alias("parent"), (F.col("size") * 2).alias("size"))
        rows = join_by_key(parts, split, "parent", "size").select("bucket", "node")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(small).distinct(), materialize(union(stuck).select("bucket", "node", "size").distinct()) if stuck else None


def _consensus(group):
    """The shingles that most of a bucket's PIVOT_OF rows or fewer have, and a name for that set."""
    import pyarrow as pa

    sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("tokens")]
    tokens, count = np.unique(np.concatenate(sets), return_counts=True)
    tokens = tokens[2 * count > len(sets)]
    name = np.add.reduce(mix(tokens + _R[2])).view(np.int64)
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "pivot": pa.array([name], pa.int64()), "held": pa.array([tokens.tobytes()], pa.binary())})


def _distances(batches):
    """Each class's Jaccard distance to a pivot, in STEPS, rounded up."""
    import pyarrow as pa

    for batch in batches:
        far = []
        for mine, held in zip(batch.column("tokens"), batch.column("held"), strict=True):
            a, b = np.frombuffer(mine.as_py(), np.uint64), np.frombuffer(held.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            union = len(a) + len(b) - both
            far.append(-(-STEPS * (union - both) // union))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot"), pa.array(far, pa.int32())], ["node", "pivot", "far"])


#: Classes whose steps to one pivot add up to at most this are linked.
SURE = round((1 - LAMBDA) * STEPS)


def settle(sets: DataFrame, stuck: DataFrame) -> tuple[DataFrame, int]:
    """(node, pivot, far) of the members of stuck buckets that are near enough to a pivot to be linked through it, by the pivot with
    most such members where there are several; and the number of buckets, which no number of pivots exceeds."""
    one_of = F.pmod(F.xxhash64("node", F.lit(PIVOT_OF)), F.lit(PIVOT_OF)).alias("part")
    chosen = stuck.groupBy("bucket", one_of).agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("node"))
    pivots = chosen.select("bucket", "node").join(sets, "node").groupBy("bucket").applyInArrow(_consensus, "bucket long, pivot long, held binary")
    pivots = materialize(pivots)
    n_buckets, size = pivots.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("held")), F.lit(0))).first()
    pairs = stuck.select("bucket", "node").join(_few(pivots.select("bucket", "pivot"), n_buckets), "bucket").select("node", "pivot").distinct()
    held = pivots.groupBy("pivot").agg(F.first("held").alias("held"))
    if size <= HELD:
        met = sets.join(pairs, "node").join(F.broadcast(held), "pivot")
    else:
        pairs = materialize(pairs)
        held = materialize(held.join(pairs.groupBy("pivot").count(), "pivot"))
        met = join_by_key(materialize(pairs.join(sets, "node")), held, "pivot", "count")
    near = materialize(met.mapInArrow(lean(_distances), "node long, pivot long, far int").filter(F.col("far") <= SURE))
    fans = near.groupBy("pivot").agg(F.count_if(F.col("far") <= SURE // 2).alias("fans"))
    best = near.join(_few(fans, n_buckets), "pivot").groupBy("node").agg(F.max(F.struct("fans", "pivot", "far")).alias("best"))
    return materialize(best.select("node", F.col("best.pivot").alias("pivot"), F.col("best.far").alias("far"))), n_buckets


def _few(rows: DataFrame, at_most: int) -> DataFrame:
    """``rows``, to be broadcast if they are known to be few."""
    return F.broadcast(rows) if at_most <= FEW else rows


def sure_links(near: DataFrame, n_pivots: int) -> tuple[DataFrame, DataFrame]:
    """(node, sure): how many links a class has through its pivot; (node, root): links that connect all of those."""
    levels = near.groupBy("pivot", "far").agg(F.count(F.lit(1)).alias("size"))
    others = levels.select("pivot", F.col("far").alias("their"), F.col("size").alias("n"))
    # at most SURE + 1 levels of a pivot meet
    reach = levels.join(_few(others, n_pivots * (SURE + 1)), "pivot").filter(F.col("far") + F.col("their") <= SURE).groupBy("pivot", "far").agg(F.sum("n").alias("sure"))
    sure = F.col("sure") - (2 * F.col("far") <= SURE).cast("int")
    counted = near.join(_few(reach, n_pivots * (SURE + 1)), ["pivot", "far"]).select("node", sure.alias("sure"))
    low = near.groupBy("pivot").agg(F.min("far").alias("low"))
    held = near.join(_few(low, n_pivots), "pivot").filter(F.col("far") + F.col("low") <= SURE).select("pivot", "node")
    root = held.groupBy("pivot").agg(F.min("node").alias("root"))
    return counted, held.join(_few(root, n_pivots), "pivot").select("node", "root")


def blocks(stuck: DataFrame, near: DataFrame, n_buckets: int) -> DataFrame:
    """(leaf, bucket, node, side) of stuck buckets: pairs of blocks. Classes that are all linked to one another through the bucket's
    main pivot have blocks of their own, which meet only the others'. A pair counts where its sides differ or both are 2."""
    close = F.when(F.col("far") <= SURE // 2, F.col("pivot"))
    rows = materialize(stuck.join(near, "node", "left").select("bucket", "node", "size", close.alias("close")))
    main = rows.filter("close is not null").groupBy("bucket", "close").count().groupBy("bucket").agg(F.max(F.struct("count", "close")).alias("m"))
    sizes = rows.groupBy("bucket").agg(F.first("size").alias("size")).join(main, "bucket", "left")
    half = F.lit(LEAF // 2)
    inner = F.coalesce("m.count", F.lit(0))
    sizes = sizes.select("bucket", F.col("m.close").alias("main"), F.ceil(inner / half).cast("int").alias("k_near"), F.ceil((F.col("size") - inner) / half).cast("int").alias("k_far"))
    rows = rows.drop("size").join(_few(sizes, n_buckets), "bucket").withColumn("is_near", F.coalesce(F.col("close") == F.col("main"), F.lit(False)))
    upto = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>"))
    own = lambda k: F.pmod(F.xxhash64("node"), F.greatest(F.col(k), F.lit(1))).cast("int").alias("own")
    near_rows = rows.filter("is_near").select("bucket", "node", own("k_near"), F.explode(upto("k_far")).alias("other"))
    far_rows = rows.filter("not is_near")
    leaf = lambda kind, a, b: F.xxhash64("bucket", F.lit(kind), a, b).alias("leaf")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = near_rows.select(leaf("near", F.col("own"), F.col("other")), "bucket", "node", F.lit(0).alias("side"))
    crossed = far_rows.select("bucket", "node", own("k_far"), F.explode(upto("k_near")).alias("other"))
    among = far_rows.select("bucket", "node", own("k_far"), F.explode(upto("k_far")).alias("other"))
    dealt = dealt.unionByName(crossed.select(leaf("near", F.col("other"), F.col("own")), "bucket", "node", F.lit(1).alias("side")))
    return dealt.unionByName(among.select(leaf("far", F.least("own", "other"), F.greatest("own", "other")), "bucket", "node", side.alias("side")))


def _by_leaf(batches):
    """The sorted rows of a partition again, cut so that no leaf is split; a few thousand rows at a time."""
    import pyarrow as pa

    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        leaf = held.column("leaf").to_numpy()
        cut = int(np.searchsorted(leaf, leaf[-1])) if len(leaf) else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _candidates(batches):
    """For each class in a leaf: the later ones there whose signatures agree well enough and that it meets in no smaller bucket."""
    import pyarrow as pa

    for part in _by_leaf(batches):
        leaf, node = part.column("leaf").to_numpy(), part.column("node").to_numpy()
        bucket, side = part.column("bucket").to_numpy(), part.column("side").to_numpy()
        signature, lists = _matrix(part.column("signature"), len(leaf)), part.column("buckets").to_pylist()
        bit = _sketch(signature)
        edges = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True])))
        pairs = [_close(edges, np.packbits(bit, axis=1).view(np.uint64))]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > SMALL:
                sign = bit[lo:hi].astype(np.float32) * 2 - 1
                a, b = np.nonzero(np.triu(sign @ sign.T >= 2 * NEED_BITS - SIGNATURE, 1))
                pairs.append((a + lo, b + lo))
        later, met = [[] for _ in leaf], np.zeros(len(leaf), bool)
        for a, b in pairs:
            across = (side[a] != side[b]) | (side[a] == 2)
            a, b = a[across], b[across]
            near = np.concatenate([np.zeros(0, bool), *[(signature[a[i : i + 4096]] == signature[b[i : i + 4096]]).sum(1) >= NEED for i in range(0, len(a), 4096)]])
            a, b = a[near], b[near]
            first = _first_meeting(bucket, lists, a, b)
            for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
                met[x] = met[y] = True
                low, high = (x, y) if node[x] < node[y] else (y, x)
                later[low].append(int(node[high]))
        keep = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), pa.array(node[keep]), pa.array([later[i] for i in keep], pa.list_(pa.int64()))], ["leaf", "node", "partners"])


def _sketch(signature: np.ndarray) -> np.ndarray:
    """One bit of each token, mixed with its position: a token's own lowest bit would agree in all positions or in none."""
    at = np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(32)
    return (mix(signature.astype(np.uint64) + at) >> np.uint64(63)).astype(np.uint8)


def _least(share: float) -> int:
    return ceil((share - 5 * sqrt(share * (1 - share) / SIGNATURE)) * SIGNATURE)


#: Tokens, and bits of them, that must agree: five deviations under what a pair of similarity LAMBDA is expected to have. Four
#: would dismiss more than 1e-4 of the pairs at exactly LAMBDA.
NEED, NEED_BITS = _least(LAMBDA), _least((1 + LAMBDA) / 2)
#: Leaves up to this size are compared all together, row by row; larger ones by a product of matrices each.
SMALL = 32


def _close(edges: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same small leaf whose bits agree well enough."""
    size = np.diff(edges)
    ends = np.repeat(np.where(size <= SMALL, edges[1:], 0), size)
    spot, gap, found = np.arange(len(ends)), 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(spot):
        gap += 1
        spot = spot[spot + gap < ends[spot]]
        agree = SIGNATURE - np.bitwise_count(sketch[spot] ^ sketch[spot + gap]).sum(1, dtype=np.int64)
        near = spot[agree >= NEED_BITS]
        found.append((near, near + gap))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _first_meeting(bucket: np.ndarray, lists: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share no bucket smaller than the one at hand, where they therefore count."""
    rows = np.unique(np.concatenate((a, b)))
    if not len(rows):
        return np.zeros(0, bool)
    before = [np.array([x for x in lists[i] if x < bucket[i]], np.int64).view(np.uint64) for i in rows]
    return np.array(_overlaps(before, list(zip(np.searchsorted(rows, a).tolist(), np.searchsorted(rows, b).tolist(), strict=True)))) == 0


def _wanted_sets(filter_bytes):
    """digest and sorted distinct shingles of the documents whose key is in the filter."""

    def run(batches):
        import pyarrow as pa

        table = np.frombuffer(filter_bytes.value, np.uint64)
        for batch in batches:
            wanted = in_bits(table, batch.column("key").to_numpy().view(np.uint64), LOG2_BITS)
            batch = batch.filter(pa.array(wanted))
            for _, _, data, offsets in chunks(batch.column("text")):
                tokens, cut = _sets(data, offsets)
                digest, _ = _digests(tokens, cut)
                sets = [np.unique(tokens[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([_fixed(digest, 16), pa.array(sets, pa.binary())], ["digest", "tokens"])

    return run


def _overlaps(sets: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[int]:
    """Sizes of the intersections. Many pairs of the same sets: by a product of 0/1 matrices, a slice of the tokens at a time."""
    if len(pairs) < 4 * len(sets) or len(sets) > 2 * LEAF:
        known = [frozenset(x.tolist()) for x in sets]
        return [len(known[a] & known[b]) for a, b in pairs]
    total, owner = sum(map(len, sets)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, slices, out = np.concatenate(sets), max(1, total // 500_000), np.zeros((len(sets), len(sets)), np.float32)
    for part in range(slices):
        at = np.flatnonzero(tokens % np.uint64(slices) == part) if slices > 1 else np.arange(total)
        _, column, count = np.unique(tokens[at], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        place = np.full(len(count), -1)
        place[shared] = np.arange(len(shared))
        column, rows = place[column], owner[at]
        for lo in range(0, len(shared), 4096):
            ok = (column >= lo) & (column < lo + 4096)
            m = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
            m[rows[ok], column[ok] - lo] = 1
            out += m @ m.T
    return [int(out[a, b]) for a, b in pairs]


def _verify(batches):
    """For each class in a leaf: how many links it has there, but for those through a pivot, and the smallest class of its part."""
    import pyarrow as pa

    for part in _by_leaf(batches):
        leaf, node, partners = part.column("leaf").to_numpy(), part.column("node").to_numpy(), part.column("partners").to_pylist()
        tokens, pivot, far = part.column("tokens"), part.column("pivot").to_numpy(), part.column("far").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True])))
        out_node, out_root, out_links = [], [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            names = node[lo:hi]
            at = {int(x): i for i, x in enumerate(names)}
            pairs = [(i, at[q]) for i in range(hi - lo) for q in partners[lo + i] if q in at]
            pairs = [(i, j) for i, j in pairs if pivot[lo + i] != pivot[lo + j] or far[lo + i] + far[lo + j] > SURE]
            if not pairs:
                continue
            sets = [np.frombuffer(tokens[int(k)].as_py(), np.uint64) for k in range(lo, hi)]
            links, root = [0] * len(names), list(range(len(names)))
            for (a, b), both in zip(pairs, _overlaps(sets, pairs), strict=True):
                if both >= LAMBDA * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    ra, rb = _find(root, a), _find(root, b)
                    if ra != rb:
                        low, high = (ra, rb) if names[ra] < names[rb] else (rb, ra)
                        root[high] = low
            for i, n in enumerate(links):
                if n:
                    out_node.append(int(names[i]))
                    out_root.append(int(names[_find(root, i)]))
                    out_links.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_node, out_root, out_links)], ["node", "root", "links"])


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label is the smallest node of the component, for every node that isn't it. Alternating large and small stars.

    The star of a large component's root is a hot key of these joins; its other side has one row for each key, so that adaptive
    execution splits it."""
    pair = lambda x, y: [F.col(x).alias("u"), F.col(y).alias("v")]
    now = materialize(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seal = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = seal(now)
    while last[0]:
        both = now.unionByName(now.select(*pair("v", "u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(*pair("v", "m")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        now = materialize(joined.filter("v <> m").select(*pair("v", "m")).unionByName(joined.select(*pair("u", "m"))).distinct())
        seen, last = last, seal(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the classes in ``wanted`` (node, class_id, digest), from one read of the texts."""
    held = texts.sparkSession.sparkContext.broadcast(bits(wanted.select(F.xxhash64("class_id").alias("key")).distinct(), "key", LOG2_BITS))
    sets = texts.withColumn("key", F.xxhash64("doc_id")).mapInArrow(lean(_wanted_sets(held)), "digest binary, tokens binary")
    return sets.join(wanted.select("digest", "node"), "digest").groupBy("node").agg(F.first("tokens").alias("tokens"))


def join(docs: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id (smallest doc_id of equal bags), n_links (other classes it is linked to), group_id (smallest doc_id of
    all that links connect), n_copies (documents of the class)."""
    texts = with_columns(docs, ("doc_id", "long"), ("text", "string"))
    files = materialize(texts.mapInArrow(lean(_signatures), "doc_id long, digest binary, n long, signature binary"))
    classes = files.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    names = classes.select("node", "class_id", "digest")

    small, stuck = leaves(classes.filter("n > 0"), runs(target_recall))
    small = materialize(small)
    buckets = small if stuck is None else small.unionByName(stuck.select("bucket", "node"))

    def compare(placed: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """The candidates in leaves; ``of``: the few classes that are placed, so that the others' signatures stay where they are."""
        only = (lambda df: df) if of is None else (lambda df: df.join(of, "node", "left_semi"))
        lists = only(buckets).groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
        members = placed.join(lists, "node").join(only(classes.select("node", "signature")), "node").repartition("leaf").sortWithinPartitions("leaf", "node")
        return materialize(members.mapInArrow(lean(_candidates), "leaf long, node long, partners array<long>"))

    candidates = compare(small.select(F.col("bucket").alias("leaf"), "bucket", "node", F.lit(2).alias("side")))
    wanted = candidates.select("node") if stuck is None else candidates.select("node").unionByName(stuck.select("node"))
    sets = materialize(_sets_of(texts, materialize(names.join(wanted.distinct(), "node", "left_semi"))))
    # a class without a pivot is its own, so that no other one shares it
    placed, sure = sets.select("node", "tokens", F.col("node").alias("pivot"), F.lit(SURE).alias("far")), None
    if stuck is not None:
        nodes = _small(materialize(stuck.select("node").distinct()))
        near, n_buckets = settle(materialize(sets.join(nodes, "node", "left_semi")), stuck)
        candidates = candidates.unionByName(compare(materialize(blocks(stuck, near, n_buckets)), nodes))
        placed = sets.join(_small(near), "node", "left").select("node", "tokens", F.coalesce("pivot", "node").alias("pivot"), F.coalesce("far", F.lit(SURE)).alias("far"))
        sure = sure_links(near, n_buckets)
    met = candidates.join(placed, "node").repartition("leaf").sortWithinPartitions("leaf", "node")
    verified = materialize(met.mapInArrow(lean(_verify), "node long, root long, links long"))

    counts, edges = verified.select("node", "links"), verified.select("node", "root")
    if sure is not None:
        counts = counts.unionByName(sure[0].select("node", F.col("sure").alias("links")))
        edges = edges.unionByName(sure[1])
    links = counts.groupBy("node").agg(F.sum("links").alias("n_links"))
    labels = components(edges, "node", "root")
    about = classes.drop("signature").join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    info = about.join(about.groupBy("label").agg(F.min("class_id").alias("group_id")), "label")
    info = materialize(info.select("digest", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group_id", "n_copies"))
    return join_by_key(files.select("doc_id", "digest"), info, "digest", "n_copies").select("doc_id", "class_id", "n_links", "group_id", "n_copies")
