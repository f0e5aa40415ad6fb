"""MinHash near-dedup by an LSH forest (operator 9).

Texts are sets of 5-word shingles.  Equal sets are one class, whose smallest id
stands for it.  A class has a sketch of SKETCH MinHash values, one byte each; an
order is a permutation of those places, and the classes sorted by their permuted
sketches are one tree of the forest.  Classes with a long common prefix in some
order are neighbours there, and likely similar.

Adaptive depth: a region is a run of an order with a common prefix of MIN_DEPTH.
A region of over LEAF classes is split by longer prefixes until its parts have at
most LEAF, so that crowded regions ask for deeper agreement and sparse ones for
less.  A run of equal sketches is linked as a chain.  What a split parts stays in
touch: neighbours at a cut are a pair, and rows that leave a crowd meet its core.
Pairs whose sketches are far from the threshold are left out, and so are those
that a second sketch puts there: the least hash in each of BINS ranges, four bits
each, which for a text of fewer shingles than ranges is nearly its whole set.

Two passes: the first confirms, on the full shingle sets, a forest of the
likeliest pairs of each leaf in FIRST_ORDERS orders.  The second confirms, in all
orders, every likely pair of a leaf, or of a crowd's rows with its core, whose
ends are still in two components.

Recall: a pair at the threshold t = 0.85 is in one leaf of an order with
probability t ** depth.  At MIN_DEPTH over ORDERS orders it is missed with a
probability of 4e-7.  In a crowd depth grows with the logarithm of its size over
the share of places in which its rows differ, so most of its pairs share no leaf;
its rows are then connected through its core and the neighbours at cuts, and a
pair that neither these nor other links connect is missed.

Plan: orders are range-partitioned on (order, permuted sketch, id), so a region
that holds a third of all rows is spread over tasks; a boundary between tasks can
part two neighbours in one order, but not in the others, and the parts of a region
of over REGION_ROWS overlap.  Texts are shuffled once, by id,
to those that are in a candidate pair.  Links become components by alternating
large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_counts import hot_join

WORDS = 5
PERCENT = 85
SKETCH = 128
ORDERS = 20
#: Orders of the first pass; what they leave apart, the second looks for in all.
FIRST_ORDERS = 6
MIN_DEPTH = 4
LEAF = 32
#: Standard deviations under the threshold at which an estimate makes a pair no candidate.
DEVIATIONS = 4
#: Ranges of the second sketch, and the values that tell the least hashes of a range apart; 0 is an empty range.
BINS = 256
VALUES = 15
#: Rows that are held against a core at once.
BLOCK = 2048
#: Rows of one region that are looked at together.
REGION_ROWS = 200_000
SLICE_BYTES = 4 << 20
#: A node with more links than this, and a thousandth of all, is a hub.
HUB = 10_000
#: Bytes of both sketches.
ROW = SKETCH + BINS // 2
_P = np.uint64(0x100000001B3)
_A = (np.frombuffer(b"".join(hashlib.sha256(b"a%d" % k).digest() for k in range(SKETCH // 4)), "<u8") | np.uint64(1)).copy()
_B = np.frombuffer(b"".join(hashlib.sha256(b"b%d" % k).digest() for k in range(SKETCH // 4)), "<u8").copy()
PERMUTATIONS = np.stack([np.random.default_rng(1000 + k).permutation(SKETCH) for k in range(ORDERS)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A-Z are lower-cased, words are runs of what isn't U+0020 or U+0009 to U+000D.
    With fewer words than a shingle has, the whole sequence is the only one.
    """
    out: list[np.ndarray] = []
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        out += _sets(texts[at:upto], words)
        at = upto
    return out


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.large_string())
    index = coded.indices.to_numpy()
    spots = np.frombuffer(vocabulary.buffers()[1], np.int64)[vocabulary.offset : vocabulary.offset + len(vocabulary) + 1]
    data = np.frombuffer(vocabulary.buffers()[2] or b"", np.uint8)[spots[0] : spots[-1]].astype(np.uint64) + np.uint64(1)
    spots = spots - spots[0]
    lengths = np.diff(spots)
    power = _P ** (np.arange(len(data), dtype=np.uint64) - np.repeat(spots[:-1], lengths).astype(np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * power, dtype=np.uint64)])
    hashes = _mix(sums[spots[1:]] - sums[spots[:-1]] + lengths.astype(np.uint64))
    real = (lengths > 0)[index]  # a separator at either end of a text gives an empty word
    flat = hashes[index][real]
    counts = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
    n = len(flat) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n] if n > 0 else rolled
    rolled = _mix(rolled)
    sets = []
    for a, b in itertools.pairwise(counts.tolist()):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in flat[a:b]:
                h = _mix(np.array([h]) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketches(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """One row of SKETCH bytes for each set; an empty set has zeros."""
    out = np.zeros((len(sets), SKETCH), np.uint8)
    at = 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) <= block):
            total += len(sets[upto])
            upto += 1
        rows = [k for k in range(at, upto) if len(sets[k])]
        if rows:
            flat = np.concatenate([sets[k] for k in rows])
            starts = np.cumsum([0] + [len(sets[k]) for k in rows[:-1]])
            for j in range(SKETCH):
                least = np.minimum.reduceat(((flat * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), starts)
                out[rows, j] = least & np.uint32(255)
        at = upto
    return out


def bin_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS half bytes for each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full(len(sets) * BINS, np.uint64(2**64 - 1))
    if sizes.sum():
        h = _mix(np.concatenate(sets) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        np.minimum.at(least, np.repeat(np.arange(len(sets)), sizes) * BINS + (h >> np.uint64(56)).astype(np.int64), h & np.uint64(2**56 - 1))
    value = np.where(least == np.uint64(2**64 - 1), np.uint64(0), least % np.uint64(VALUES) + np.uint64(1)).astype(np.uint8).reshape(len(sets), BINS)
    return value[:, ::2] | value[:, 1::2] << 4


def _fingerprints(words: int):
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text"), words)
            rows = np.concatenate([sketches(sets), bin_sketches(sets)], axis=1)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.record_batch([b.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "n", "digest", "sketch"])

    return run


def _likely(sketch: np.ndarray, sizes: np.ndarray, x, y, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of equal places of rows x and y, which broadcast, and which of the pairs are likely."""
    t = percent / 100
    same = (sketch[x, :SKETCH] == sketch[y, :SKETCH]).mean(axis=-1)
    small, large = np.minimum(sizes[x], sizes[y]).astype(np.int64), np.maximum(sizes[x], sizes[y]).astype(np.int64)
    return same, (same >= t - DEVIATIONS * np.sqrt(t * (1 - t) / SKETCH)) & (100 * small >= percent * large)


def likely_by_bins(sketch: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of rows x and y their second sketches, if there are such, leave likely.

    Of the union's N shingles the U that are least in their ranges are drawn without
    replacement, which is what the variance allows for; so does it for values that
    are equal by chance.
    """
    out, t = np.ones(len(x), bool), percent / 100
    for at in range(0, len(x) if sketch.shape[1] > SKETCH else 0, BLOCK):
        i, j = x[at : at + BLOCK], y[at : at + BLOCK]
        a, b = sketch[i, SKETCH:], sketch[j, SKETCH:]
        seen, equal = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for part in (15, 240):
            p, q = a & part, b & part
            seen += ((p | q) != 0).sum(axis=1)
            equal += ((p == q) & (p != 0)).sum(axis=1)
        u = np.maximum(seen, 1)
        n = (sizes[i].astype(np.int64) + sizes[j]) / (1 + t)
        deviation = np.sqrt((t * (1 - t) * np.clip(1 - u / n, 0, 1) + (1 - t) / (VALUES - 1)) / u)
        share = (equal / u - 1 / VALUES) / (1 - 1 / VALUES)
        out[at : at + BLOCK] = share >= t - DEVIATIONS * deviation
    return out


def leaf_pairs(sketch: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, forest: bool = True) -> list[tuple[int, int]]:
    """Likely pairs among a leaf's rows: a forest of the likeliest ones, or all."""
    rows = np.arange(len(sketch))
    same, likely = _likely(sketch, sizes, rows[:, None], rows[None, :], percent)
    a, b = np.nonzero(np.triu(likely, 1))
    keep = likely_by_bins(sketch, sizes, a, b, percent)
    a, b = a[keep], b[keep]
    if not forest:
        return list(zip(a.tolist(), b.tolist(), strict=True))
    top = list(range(len(sketch)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for k in np.argsort(-same[a, b], kind="stable"):
        x, y = find(a[k]), find(b[k])
        if x != y:
            out.append((int(a[k]), int(b[k])))
            top[x] = y
    return out


def _core_pairs(sketch: np.ndarray, sizes: np.ndarray, rows: np.ndarray, core: np.ndarray, percent: int, forest: bool):
    """Likely pairs of rows with core: the likeliest of each row, or all."""
    for at in range(0, len(rows), BLOCK):
        block = rows[at : at + BLOCK]
        same, likely = _likely(sketch, sizes, block[:, None], core[None, :], percent)
        a, b = np.nonzero(likely)
        likely[a, b] = likely_by_bins(sketch, sizes, block[a], core[b], percent)
        if forest:
            best = np.where(likely, same, 0).argmax(axis=1)
            likely &= np.arange(len(core)) == best[:, None]
        a, b = np.nonzero(likely)
        yield from zip(block[a].tolist(), core[b].tolist(), strict=True)


def _region_pairs(sketch: np.ndarray, sizes: np.ndarray, percent: int, forest: bool = True):
    """Pairs of row numbers of one region, whose rows are sorted and permuted.

    Of a crowded part the largest branch is followed down to its core, a leaf or a
    run of equal sketches: a text that the others are copies of is likely in it, as
    it has what most of them have at each place.  All other rows meet the core, the
    two rows at a cut meet each other, and each branch is looked at in the same way.
    """
    differ = sketch[:-1, :SKETCH] != sketch[1:, :SKETCH]
    common_prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), SKETCH)
    todo = [(0, len(sketch))]
    while todo:
        lo, hi = start, end = todo.pop()
        at_cuts = []
        while hi - lo > LEAF and (least := int(common_prefix[lo : hi - 1].min())) < SKETCH:
            cuts = [lo, *(np.flatnonzero(common_prefix[lo : hi - 1] == least) + lo + 1).tolist(), hi]
            at_cuts += cuts[1:-1]
            largest = int(np.argmax(np.diff(cuts)))
            todo += [(x, y) for k, (x, y) in enumerate(itertools.pairwise(cuts)) if k != largest and y - x > 1]
            lo, hi = cuts[largest], cuts[largest + 1]
        if hi - lo > LEAF:  # all equal: one of them stands for the core
            yield from itertools.pairwise(range(lo, hi))
            core = np.array([lo])
        else:
            core = np.arange(lo, hi)
            for a, b in leaf_pairs(sketch[lo:hi], sizes[lo:hi], percent, forest):
                yield lo + a, lo + b
        if at_cuts:
            cut = np.array(at_cuts)
            cut = cut[_likely(sketch, sizes, cut - 1, cut, percent)[1] & likely_by_bins(sketch, sizes, cut - 1, cut, percent)]
            yield from zip((cut - 1).tolist(), cut.tolist(), strict=True)
            yield from _core_pairs(sketch, sizes, np.concatenate([np.arange(start, lo), np.arange(hi, end)]), core, percent, forest)


def _orders(orders: int, width: int):
    """The orders' rows, with the first width bytes of both sketches."""

    def run(batches):
        for b in batches:
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, ROW)
            for k in range(orders):
                rows = np.concatenate([sketch[:, PERMUTATIONS[k]], sketch[:, SKETCH:width]], axis=1)
                permuted = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)])
                yield pa.record_batch([pa.array(np.full(len(sketch), k, np.int32)), permuted.cast(pa.binary()), b.column("key"), b.column("n").cast(pa.int32()), b.column("component")], names=["tree", "permuted", "key", "n", "component"])

    return run


def _candidates(percent: int, forest: bool = True, region_rows: int = REGION_ROWS):
    """Likely pairs of keys: a forest of the likeliest in each leaf, or all whose components differ."""

    def pairs_of(sketch, keys, sizes, named):
        for a, b in _region_pairs(sketch, sizes, percent, forest):
            if forest or named[a] != named[b]:
                yield min(keys[a], keys[b]), max(keys[a], keys[b])

    def run(batches):
        held = None  # the rows of the last region so far
        for b in itertools.chain(batches, [None]):
            if b is not None:
                if not b.num_rows:
                    continue
                new = (b.column("tree").to_numpy(), np.frombuffer(b"".join(b.column("permuted").to_pylist()), np.uint8).reshape(b.num_rows, -1), b.column("key").to_numpy(), b.column("n").to_numpy(), b.column("component").to_numpy(zero_copy_only=False))
                held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            if held is None:
                break
            tree, sketch, keys, sizes, named = held
            parts = (tree[1:] != tree[:-1]) | (sketch[1:, :MIN_DEPTH] != sketch[:-1, :MIN_DEPTH]).any(axis=1)
            cuts = np.concatenate([[0], np.flatnonzero(parts) + 1, [len(tree)]])
            crowded = cuts[-1] - cuts[-2] >= region_rows
            last = len(cuts) - 1 if b is None or crowded else len(cuts) - 2
            found = []
            for k in np.flatnonzero(np.diff(cuts[: last + 1]) > 1):
                lo, hi = cuts[k], cuts[k + 1]
                found += pairs_of(sketch[lo:hi], keys[lo:hi], sizes[lo:hi], named[lo:hi])
            rest = max(cuts[-1] - LEAF, cuts[-2]) if crowded and b is not None else cuts[last]  # a region's parts overlap
            held = tuple(x[rest:] for x in held) if rest < cuts[-1] else None
            found = set(found)
            yield pa.record_batch([pa.array([int(p[i]) for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _set_rows(words: int):
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text"), words)
            yield pa.record_batch([b.column("key"), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())], names=["key", "members"])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """A scratch table; its shuffle files, which can be over twice the input, are gone when the next step begins."""
    return common.written(df, name, tidy=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, n (shingles), digest of the shingle set, sketch; written to the shared folder."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return _written(rows.mapInArrow(_fingerprints(words), "key long, n long, digest binary, sketch binary"), "fingerprints")


def _pairs(classes: DataFrame, percent: int, forest: bool) -> DataFrame:
    orders = _orders(FIRST_ORDERS, SKETCH) if forest else _orders(ORDERS, ROW)
    trees = classes.mapInArrow(orders, "tree int, permuted binary, key long, n int, component long")
    sorted_ = trees.repartitionByRange("tree", "permuted", "key").sortWithinPartitions("tree", "permuted", "key")
    return sorted_.mapInArrow(_candidates(percent, forest), "a long, b long").distinct()


def _confirmed(docs: DataFrame, pairs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    active = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(active.hint("shuffle_hash"), "key", "left_semi")
    # a key that comes twice stands for its smallest set
    sets = _written(texts.mapInArrow(_set_rows(words), "key long, members binary").groupBy("key").agg(F.min("members").alias("members")), "sets")
    x, y = sets.select(F.col("key").alias("a"), F.col("members").alias("x")), sets.select(F.col("key").alias("b"), F.col("members").alias("y"))
    out = _written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "links")
    common.drop(sets)
    return out


def links(docs: DataFrame, prints: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) between class representatives that connect what confirmed links connect."""
    classes = prints.where("n > 0 and key is not null").groupBy("digest").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = _written(classes.select("key", "n", "sketch"), "classes")
    first = _written(_pairs(classes.withColumn("component", F.col("key")), percent, True), "candidates")
    common.release(docs.sparkSession)
    named = _written(components(_confirmed(docs, first, key, text, words, percent)), "components")
    common.release(docs.sparkSession)
    # what is still apart: all likely pairs, but for those that were looked at
    apart = classes.join(named.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "sketch", F.coalesce("component", "key").alias("component"))
    rest = _written(_pairs(apart, percent, False).join(first, ["a", "b"], "left_anti"), "candidates")
    common.drop(classes)
    common.release(docs.sparkSession)
    edges = named.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return edges if rest.isEmpty() else edges.unionByName(_confirmed(docs, rest, key, text, words, percent))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for every node of edges (a, b).

    Alternates large-star and small-star steps until nothing changes, which takes
    about log(nodes) rounds; each round is a table in the shared folder, and the one
    before it is deleted.  A hub's edges are joined with its least neighbour by
    broadcast, so that a star of a third of all nodes is no task's alone.
    """
    now = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    state = None
    while True:
        found = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == state or not found[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        state = found
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, 2 * found[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        joined = _to_least(large, found[0])
        new = _written(joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "stars")
        common.drop(now)
        now = new


def _to_least(edges: DataFrame, n_rows: int) -> DataFrame:
    """edges (a, b) with m, the least of a and all its b."""
    each = _written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    least = each.select("a", F.least("a", "m").alias("m"))
    if (each.agg(F.max("n")).first()[0] or 0) <= HUB:
        return edges.join(least, "a")
    return hot_join(edges, least, each.select("a", F.when(F.col("n") > HUB, F.col("n")).otherwise(0).alias("n")), "a", n_rows)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (smallest key reachable over links), kept.

    Links join sets with 100 * intersection >= percent * union.  A null, empty or
    white text has the empty set, which is linked with nothing; a row without a key
    is linked with nothing, has no component and is kept.  Rows with equal keys
    count as one document and each give a row.  Other columns are not looked at.
    """
    prints = fingerprints(docs, key, text, words)
    labels = components(links(docs, prints, key, text, words, percent))
    real = prints.where("n > 0 and key is not null")
    groups = _written(real.groupBy("digest").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies")), "groups")
    n_rows = groups.agg(F.sum("copies")).first()[0] or 0
    named = groups.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    rows = hot_join(real.select("key", "n", "digest"), named, groups.select("digest", F.col("copies").alias("n")), "digest", n_rows)
    alone = prints.where("not (n > 0 and key is not null)").select("key", "n", "digest", F.col("key").alias("component_id"))
    rows = rows.unionByName(alone)
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with the columns of docs."""
    gone = _written(near_duplicates(docs, key, text, words, percent).where("not kept").select(key).distinct(), "gone")
    common.release(docs.sparkSession)
    return docs.join(gone.hint("shuffle_hash"), key, "left_anti").select(docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id
      join n na on na.doc_id = x.doc_id join n nb on nb.doc_id = y.doc_id
      group by x.doc_id, y.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r as (select doc_id as node, doc_id as reached from w union select r.node, e.b from r join e on e.a = r.reached)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(r.reached) as component_id, min(r.reached) = w.doc_id as kept
from w join r on r.node = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id, n.n
"""
