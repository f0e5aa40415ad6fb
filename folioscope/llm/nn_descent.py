"""Approximate nearest neighbours by NN-descent (operator 8).

The graph: every distinct vector keeps its DEGREE best neighbours.  It starts
from random-projection leaves, and each round joins every node's neighbours, and
REVERSE more nodes that have it as theirs, picked by hash, with each other: what are neighbours of a
common node are scored, and whoever beats a node's worst neighbour takes its
place.  Rounds end when few places change, or after ROUNDS.

The search: greedy, with a beam of BEAM nodes for each query, which is a row of
the table and starts from its own node.  A step expands the best EXPAND nodes of
each beam that aren't expanded yet, all queries at once: their neighbour lists,
which hold ids alone, are joined, and only the vectors of nodes that the query
hasn't met are fetched and scored.  It ends when no beam has a node to expand.  The
whole beam is scored anew, in double precision, on the original vectors.

Graph and beams use vectors in single precision, all scaled by one power of two
so that no product overflows.  Equal vectors are one node;
of its rows only the smallest k + 1 ids can be in a result, and those are kept.
Sets that grow with the data are always rows of a join: no list of reverse
neighbours or copies is gathered beyond its fixed size.  A node that is in many
lists or beams (with vectors of unequal lengths, the longest is everyone's
neighbour) is joined by broadcast, so that no task has all of its rows.  Graphs,
lists and beams that are over are deleted.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .token_counts import hot_join

DEGREE = 28
REVERSE = 16
TREES = 8
LEAF = 1024
ROUNDS = 4
#: Rounds end when fewer than this share of all places changed.
CHANGED = 0.02
BEAM = 160
EXPAND = 80
FLUSH = 400_000
GRAPH = "id long, nbr binary, score binary"


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    if not len(rows):
        return pa.array([], pa.binary())
    n = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _ragged(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _bytes(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (id, neighbour, score) of graph rows."""
    counts = np.array([len(x) // 8 for x in b.column("nbr").to_pylist()], np.int64)
    return np.repeat(b.column("id").to_numpy(), counts), _bytes(b.column("nbr"), np.int64), _bytes(b.column("score"), np.float32)


def best(ids: np.ndarray, nbrs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct neighbours of each id, by score, ties to the smaller one; sorted by id."""
    order = np.lexsort((nbrs, ids))
    ids, nbrs, scores = ids[order], nbrs[order], scores[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (nbrs[1:] != nbrs[:-1])
    ids, nbrs, scores = ids[fresh], nbrs[fresh], scores[fresh]
    order = np.lexsort((nbrs, -scores, ids))
    ids, nbrs, scores = ids[order], nbrs[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    keep = rank < k
    return ids[keep], nbrs[keep], scores[keep]


def _graph_rows(ids: np.ndarray, nbrs: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    nodes, counts = np.unique(ids, return_counts=True)
    return pa.record_batch([pa.array(nodes, pa.int64()), _ragged(nbrs.astype(np.int64), counts), _ragged(scores.astype(np.float32), counts)], names=["id", "nbr", "score"])


def _grouped(batches, columns):
    """Batches' columns, cut so that no group of equal values in the first column is parted."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if not b.num_rows:
                continue
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            keys = held.column(columns[0]).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if keys[0] <= keys[-1] else len(keys)
            if not cut or len(keys) < 2000:
                continue
            yield held.slice(0, cut)
            held = held.slice(cut)
        elif held is not None:
            yield held


def _merge(k: int):
    def run(batches):
        for b in _grouped(batches, ["id"]):
            yield _graph_rows(*best(*_lists(b), k))

    return run


def merge(rows: DataFrame, k: int) -> DataFrame:
    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(_merge(k), GRAPH)


def _codes(scale: float, field: str):
    def run(batches):
        for b in batches:
            flat = b.column(field).flatten().to_numpy().astype(np.float64)
            rows = (flat * scale).astype(np.float32).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), np.float32)
            yield pa.record_batch([b.column("id"), _binary(rows)], names=["id", "code"])

    return run


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return _bytes(column, np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def _leaves(trees: int, bits: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column("code"))
            for t in range(trees):
                planes = np.random.default_rng(t).normal(size=(x.shape[1], max(bits, 1))).astype(np.float32)
                leaf = ((x @ planes > 0) @ (1 << np.arange(max(bits, 1)))) if bits else np.zeros(len(x), np.int64)
                yield pa.record_batch([pa.array(t * (1 << bits) + leaf.astype(np.int64), pa.int64()), b.column("id"), b.column("code")], names=["leaf", "id", "code"])

    return run


def _within_leaves(k: int):
    def run(batches):
        for b in _grouped(batches, ["leaf"]):
            leaves, ids, x = b.column("leaf").to_numpy(), b.column("id").to_numpy(), _vectors(b.column("code"))
            cuts = np.concatenate([[0], np.flatnonzero(leaves[1:] != leaves[:-1]) + 1, [len(leaves)]])
            for lo, hi in itertools.pairwise(cuts.tolist()):
                parts = -(-(hi - lo) // LEAF)
                for at, to in itertools.pairwise(np.linspace(lo, hi, parts + 1).astype(int).tolist()):  # a crowded leaf in parts
                    n = to - at
                    if n < 2:
                        continue
                    s = x[at:to] @ x[at:to].T
                    np.fill_diagonal(s, -np.inf)
                    m = min(k, n - 1)
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    yield _graph_rows(*best(np.repeat(ids[at:to], m), ids[at:to][top].ravel(), np.take_along_axis(s, top, 1).ravel(), k))

    return run


def _local_join(k: int):
    """Scores each centre's members with each other; rows are (centre, id, worst, code)."""

    def run(batches):
        out = [[], [], []]
        size = 0
        for b in _grouped(batches, ["centre"]):
            centres, ids, worst, x = b.column("centre").to_numpy(), b.column("id").to_numpy(), b.column("worst").to_numpy(), _vectors(b.column("code"))
            cuts = np.concatenate([[0], np.flatnonzero(centres[1:] != centres[:-1]) + 1, [len(centres)]])
            for lo, hi in itertools.pairwise(cuts.tolist()):
                s = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(s, -np.inf)
                a, c = np.nonzero(s > worst[lo:hi, None])
                out[0].append(ids[lo + a])
                out[1].append(ids[lo + c])
                out[2].append(s[a, c])
                size += len(a)
            if size >= FLUSH:
                yield _graph_rows(*best(*map(np.concatenate, out), k))
                out, size = [[], [], []], 0
        if size:
            yield _graph_rows(*best(*map(np.concatenate, out), k))

    return run


def _explode(graph: DataFrame, name: str) -> DataFrame:
    """(id, nbr, score) rows of a graph."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array(x) for x in _lists(b)], names=["id", "nbr", "score"])

    return graph.mapInArrow(run, "id long, nbr long, score float").select(F.col("id").alias(name), F.col("nbr"), "score")


def _members(graph: DataFrame, reverse: int, seed: int | None = None) -> DataFrame:
    """(centre, id): each node's neighbours, and at most reverse nodes that have it as theirs and aren't its neighbours.

    Of those the nearest, or with a seed such as a hash picks, as those are what a
    node's own neighbours know least of.
    """
    edges = _explode(graph, "centre")
    back = edges.select(F.col("nbr").alias("centre"), F.col("centre").alias("nbr"), "score").join(edges.select("centre", "nbr"), ["centre", "nbr"], "left_anti")
    order = [F.desc("score")] if seed is None else [F.xxhash64("centre", "nbr", F.lit(seed))]
    w = W.partitionBy("centre").orderBy(*order, "nbr")
    back = back.withColumn("r", F.row_number().over(w)).where(F.col("r") <= reverse)
    return common.written(edges.select("centre", F.col("nbr").alias("id")).unionByName(back.select("centre", F.col("nbr").alias("id"))), "members")


def _spread_join(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Written rows joined with right, which has one row for each key, however many rows a key has."""
    return hot_join(rows, right, rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, rows.count())


def build_graph(codes: DataFrame, n: int, degree: int = DEGREE, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph (id, nbr, score) of codes (id, code), which has n rows."""
    spark = codes.sparkSession
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    leaves = codes.mapInArrow(_leaves(TREES, bits), "leaf long, id long, code binary")
    leaves = leaves.repartitionByRange("leaf", F.xxhash64("id")).sortWithinPartitions("leaf", F.xxhash64("id"))
    graph = common.written(merge(leaves.mapInArrow(_within_leaves(degree), GRAPH), degree), "graph")

    def worst(batches):
        for b in batches:
            full = [np.frombuffer(x, np.float32) for x in b.column("score").to_pylist()]
            yield pa.record_batch([b.column("id"), pa.array([float(x[-1]) if len(x) >= degree else float("-inf") for x in full], pa.float64())], names=["id", "worst"])

    for k in range(rounds):
        state = codes.join(graph.mapInArrow(worst, "id long, worst double"), "id", "left").select("id", "code", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
        members = _members(graph, reverse, k)
        rows = _spread_join(members, state, "id").select("centre", "id", "worst", "code")
        joined = rows.repartition("centre").sortWithinPartitions("centre").mapInArrow(_local_join(degree), GRAPH)
        new = common.written(merge(graph.unionByName(joined), degree), "graph")
        changed = _explode(new, "id").join(_explode(graph, "id").select("id", "nbr"), ["id", "nbr"], "left_anti").count()
        common.drop(graph)
        common.drop(members)
        graph = new
        common.release(spark)
        if changed < CHANGED * degree * n:
            break
    return graph


def _packed(batches):
    """Rows (centre, id) as lists of ids."""
    for b in _grouped(batches, ["centre"]):
        centres, counts = np.unique(b.column("centre").to_numpy(), return_counts=True)
        yield pa.record_batch([pa.array(centres, pa.int64()), _ragged(b.column("id").to_numpy(), counts)], names=["id", "nbr"])


STATE = "q long, code binary, beam binary, scores binary, done binary, seen binary, next array<long>"


def _ids(value) -> np.ndarray:
    return np.frombuffer(value or b"", np.int64)


def _unseen(batches):
    """Rows are (q, seen, nbr), one of a query with seen and any with nbr; gives (q, nbr) of the neighbours that aren't seen."""
    for b in _grouped(batches, ["q"]):
        qs, seen, nbrs = (b.column(c).to_pylist() for c in ("q", "seen", "nbr"))
        out = []
        for q, rows in itertools.groupby(range(b.num_rows), key=qs.__getitem__):
            rows = list(rows)
            new = np.unique(np.concatenate([_ids(nbrs[k]) for k in rows]))
            out.append((q, np.setdiff1d(new, np.concatenate([_ids(seen[k]) for k in rows]), assume_unique=True)))
        yield pa.record_batch([pa.array(np.repeat(np.array([q for q, _ in out], np.int64), [len(x) for _, x in out])), pa.array(np.concatenate([x for _, x in out]) if out else [], pa.int64())], names=["q", "nbr"])


def _step(beam: int, expand: int):
    """Merges a query's state with the nodes that it met: rows are (q, code, beam, scores, done, seen) or (q, nbr, vector)."""

    def run(batches):
        kind = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())]
        for b in _grouped(batches, ["q"]):
            cols = {c: b.column(c).to_pylist() for c in ("q", "code", "beam", "scores", "done", "seen", "nbr", "vector")}
            out = []
            for q, rows in itertools.groupby(range(b.num_rows), key=cols["q"].__getitem__):
                rows = list(rows)
                own = next(k for k in rows if cols["code"][k] is not None)
                met = [k for k in rows if cols["nbr"][k] is not None]
                code = np.frombuffer(cols["code"][own], np.float32)
                new = np.array([cols["nbr"][k] for k in met], np.int64)
                score = np.frombuffer(b"".join(cols["vector"][k] for k in met), np.float32).reshape(len(new), len(code)) @ code
                ids, scores = np.concatenate([_ids(cols["beam"][own]), new]), np.concatenate([np.frombuffer(cols["scores"][own], np.float32), score])
                done = np.concatenate([np.frombuffer(cols["done"][own], np.int8), np.zeros(len(new), np.int8)])
                seen = np.concatenate([_ids(cols["seen"][own]), new])
                order = np.lexsort((ids, -scores))[:beam]
                ids, scores, done = ids[order], scores[order], done[order]
                todo = np.flatnonzero(done == 0)[:expand]
                done[todo] = 1
                out.append((q, cols["code"][own], ids.tobytes(), scores.tobytes(), done.tobytes(), seen.tobytes(), ids[todo].tolist()))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kind, strict=True)], names=["q", "code", "beam", "scores", "done", "seen", "next"])

    return run


def search(queries: DataFrame, graph: DataFrame, codes: DataFrame, beam: int = BEAM, expand: int = EXPAND, reverse: int = REVERSE) -> DataFrame:
    """Greedy search: for each of queries (q, code), which are nodes, the beam that it ends with, as (q, id) rows."""
    spark = queries.sparkSession
    members = _members(graph, reverse)
    lists = common.written(members.repartition("centre").sortWithinPartitions("centre").mapInArrow(_packed, "id long, nbr binary"), "lists")
    common.drop(members)
    none = F.lit(b"")
    vectors = codes.select(F.col("id").alias("nbr"), F.col("code").alias("vector"))
    state = queries.select("q", "code", none.alias("beam"), none.alias("scores"), none.alias("done"), none.alias("seen"))
    met, old = common.written(queries.select("q", F.col("q").alias("nbr")), "met"), None
    while True:
        blank = [F.lit(None).cast("binary").alias(c) for c in ("code", "beam", "scores", "done", "seen")]
        rows = state.select("q", "code", "beam", "scores", "done", "seen", F.lit(None).cast("long").alias("nbr"), F.lit(None).cast("binary").alias("vector"))
        rows = rows.unionByName(_spread_join(met, vectors, "nbr").select("q", *blank, "nbr", "vector"))
        state = common.written(rows.repartition("q").sortWithinPartitions("q").mapInArrow(_step(beam, expand), STATE), "beams")
        for t in (met, old) if old is not None else (met,):
            common.drop(t)
        old = state
        common.release(spark)
        if state.where(F.size("next") > 0).isEmpty():
            break
        todo = common.written(state.select("q", F.explode("next").alias("id")), "todo")
        near = _spread_join(todo, lists, "id").where("nbr is not null").select("q", F.lit(None).cast("binary").alias("seen"), "nbr")
        known = state.where(F.size("next") > 0).select("q", "seen", F.lit(None).cast("binary").alias("nbr"))
        met = common.written(known.unionByName(near).repartition("q").sortWithinPartitions("q").mapInArrow(_unseen, "q long, nbr long"), "met")
        common.drop(todo)

    def final(batches):
        for b in batches:
            beams = [_ids(x) for x in b.column("beam").to_pylist()]
            yield pa.record_batch([pa.array(np.repeat(b.column("q").to_numpy(), [len(x) for x in beams]), pa.int64()), pa.array(np.concatenate(beams) if beams else [], pa.int64())], names=["q", "id"])

    return state.select("q", "beam").mapInArrow(final, "q long, id long")


def _exact(batches):
    for b in batches:
        x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1)) for c in ("x", "y"))
        yield pa.record_batch([b.column("q"), b.column("id"), pa.array((x * y).sum(axis=1), pa.float64())], names=["q", "id", "score"])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v, digest) of the vectors that take part: of the most common length, all components finite, not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (sizes["d"] if sizes else 0))
    plain = F.transform(v, lambda x: x + 0)  # so that 0.0 and -0.0 are equal
    return rows.withColumn("digest", F.md5(plain.cast("string")))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """The k nearest rows, by inner product, of each row whose key is divisible by every: query_id, rank, vec_id, score.

    Null, empty or zero vectors, such with null or non-finite components, and those
    of another length than most take no part.  Ties go to the smaller key; equal
    vectors under different keys are different rows, and a query is not its own
    neighbour.  Repeated rows with one key count once.  Other columns are not looked at.
    """
    rows = common.written(usable(vectors, key, vector).dropDuplicates(["vec_id"]), "vectors")
    w = W.partitionBy("digest").orderBy("vec_id")
    copies = rows.select("digest", "vec_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    kept = copies.groupBy("digest").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asked"))
    nodes = common.written(kept.join(counts, "digest").join(rows.select(F.col("vec_id").alias("id"), "v"), "id"), "nodes")
    found = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top")).first()
    scale = 2.0 ** -int(np.frexp(found["top"])[1]) if found["top"] else 1.0
    codes = common.written(nodes.select("id", "v").mapInArrow(_codes(scale, "v"), "id long, code binary"), "codes")
    graph = build_graph(codes, found["n"], degree)
    asked = nodes.where("asked = 1").select("id")
    queries = codes.join(asked, "id", "left_semi").select(F.col("id").alias("q"), "code")
    ends = common.written(search(queries, graph, codes, beam), "ends")
    x, y = nodes.select(F.col("id").alias("q"), F.col("v").alias("x")), nodes.select("id", F.col("v").alias("y"))
    scored = _spread_join(ends, y, "id").join(x, "q").select("q", "id", "x", "y").mapInArrow(_exact, "q long, id long, score double")
    each = scored.join(nodes.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("vec_id"))
    best_ = each.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = best_.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    lists = lists.join(nodes.select(F.col("id").alias("q"), "digest"), "q").select("digest", "top")
    asking = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "digest")
    out = hot_join(asking, lists, nodes.select("digest", "n"), "digest", found["rows"] or 0).where("top is not null")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    return nearest(common.table(spark, sf_dir, "embeddings"))
