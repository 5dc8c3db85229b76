"""Approximate nearest neighbours by stable projections and a chi-square stopping test.

Largest inner products become nearest points: a vector x gets one more component,
sqrt(M^2 - |x|^2) with M the greatest norm, a query q is scaled to norm M and gets a zero;
then |x - q|^2 = 2 M^2 - 2 x.q. Points are projected to `dims` dimensions with Gaussian (2-stable)
weights, and a kd-tree over the projections is walked outwards from the query, leaf by leaf in
the order of their boxes' distances. Each leaf's vectors are verified with true inner products.
A squared projected distance over the squared true distance follows a chi-square law with `dims`
degrees of freedom, so the walk stops when a point as near as the worst one kept would, with
probability `sure`, have been projected nearer than the boxes that are left.

Vectors of each length are a space of their own. They are dealt by hash to shards of about
`shard_bytes`; a shard's tree is built once and written with its vectors as one row of an index table.
Queries go to every shard of their space, as a stream past its tree: a task holds one shard and a batch of
queries. Each shard keeps k results of a query, and these are merged. Every vector is indexed.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows
with null ids. Ties go to the smaller id. Of repeated rows each is a candidate, but none for a query
of the same id; equal rows are counted before they are dealt, so that they don't gather in a shard. An id
asks once: of its vectors the shortest, then the least, is the query. With fewer than k candidates all are
returned. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._cluster import Scratch, partitions

DIMS, LEAF, SURE = 6, 256, 0.8
SHARD_BYTES, BATCH = 8 << 20, 512


def chi2_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    if dims % 2:
        raise ValueError("dims must be even")
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term = total = np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


class Tree:
    """kd-tree with leaves of one size: points in leaf order, and each leaf's box."""

    def __init__(self, points: np.ndarray, leaf: int):
        order = np.arange(len(points))
        leaves: list[np.ndarray] = []
        stack = [order]
        while stack:
            own = stack.pop()
            if len(own) <= leaf:
                leaves.append(own)
                continue
            axis = int(np.ptp(points[own], axis=0).argmax())
            half = len(own) // 2
            cut = np.argpartition(points[own, axis], half)
            stack += [own[cut[half:]], own[cut[:half]]]
        self.leaves = leaves
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])
        width = max(map(len, leaves))
        self.members = np.full((len(leaves), width), -1)
        for i, x in enumerate(leaves):
            self.members[i, : len(x)] = x

    def box_distance(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from each query to each leaf's box."""
        out = np.zeros((len(q), len(self.leaves)))
        for j in range(q.shape[1]):
            x = q[:, j : j + 1]
            gap = np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0)
            out += gap * gap
        return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added in their order."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for j in range(x.shape[-1]):
        out = out + q[..., j] * x[..., j]
    return out


class Shard:
    """Distinct vectors of a shard under a tree, with the ids of each in order and how often each comes."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, most: float, dims: int, leaf: int, seed: int = 7):
        self.most, self.dims = most, dims
        self.x, which = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        self.ids, self.copies, self.first = ids[order], copies[order], np.searchsorted(which.ravel()[order], np.arange(len(self.x) + 1))
        extra = np.sqrt(np.maximum(most * most - exact(self.x, self.x), 0))
        self.weights = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, dims))
        self.tree = Tree(np.hstack([self.x, extra[:, None]]) @ self.weights, leaf)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, id, inner product) of up to k results a query."""
        norm = np.sqrt(exact(q, q))
        away = self.tree.box_distance((q * (self.most / norm)[:, None]) @ self.weights[:-1])
        order = np.argsort(away, axis=1, kind="stable")
        width, keep = self.tree.members.shape[1], k + 8  # a few more than k: products are rounded until the end
        best = np.full((len(q), keep), -np.inf)
        who = np.full((len(q), keep), -1)
        left = np.arange(len(q))
        for step in range(order.shape[1]):
            leaf = order[left, step]
            if step:
                # squared distance of the worst one kept, in the space where norms are M
                worst = 2 * self.most * (self.most - best[left, :k].min(1) / norm[left])
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(worst > 0, away[left, leaf] / worst, np.where(np.isinf(worst), 0, np.inf))
                go = chi2_cdf(ratio, self.dims) < sure
                left, leaf = left[go], leaf[go]
                if not len(left):
                    break
            found = np.full((len(left), width), -np.inf)
            by = np.argsort(leaf, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                rows = self.tree.leaves[leaf[own[0]]]
                found[own, : len(rows)] = q[left[own]] @ self.x[rows].T
            better = np.flatnonzero(found.max(1) > best[left].min(1))
            if not len(better):
                continue
            at = left[better]
            score = np.hstack([best[at], found[better]])
            row = np.hstack([who[at], self.tree.members[leaf[better]]])
            first = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            score = np.take_along_axis(score, first, 1)
            down = np.argsort(-score, axis=1, kind="stable")
            best[at] = np.take_along_axis(score, down, 1)
            who[at] = np.take_along_axis(np.take_along_axis(row, first, 1), down, 1)
        out = []
        for i in range(len(q)):
            rows = who[i][who[i] >= 0]
            score = exact(q[i], self.x[rows])
            own = [slice(self.first[r], min(self.first[r] + k + 1, self.first[r + 1])) for r in rows]
            n = [x.stop - x.start for x in own]
            score, ids, copies = np.repeat(score, n), *(np.concatenate([y[x] for x in own]) if own else np.zeros(0, np.int64) for y in (self.ids, self.copies))
            other = np.repeat(np.flatnonzero(ids != query_ids[i]), copies[ids != query_ids[i]])
            score, ids = score[other], ids[other]
            take = np.lexsort((ids, -score))[:k]
            out.append((np.full(len(take), i), ids[take], score[take]))
        return tuple(np.concatenate(x) for x in zip(*out))


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of double) and n (its length) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    return rows.withColumn("n", F.size("v"))


def _arrays(ids: pa.ChunkedArray | pa.Array, v: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = pa.chunked_array([c.flatten() for c in v.chunks] if isinstance(v, pa.ChunkedArray) else [v.flatten()], pa.float64()).to_numpy()
    return ids.to_numpy(), flat.reshape(len(ids), -1)


def _index(dims: int, leaf: int):
    def run(key, rows):
        ids, x = _arrays(rows.column("id"), rows.column("v"))
        shard = Shard(ids, rows.column("copies").to_numpy(), x, rows.column("most")[0].as_py(), dims, leaf)
        return pa.table({"n": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(shard)], pa.binary())})

    return run


def _search(k: int, sure: float):
    """Trees and queries in the order of shards, a tree before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            trees = batch.column("tree")
            cuts = [0, *np.flatnonzero(trees.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and trees[a].is_valid:
                    shard = pickle.loads(trees[a].as_py())
                    a += 1
                for lo in range(a, b, BATCH):
                    part = batch.slice(lo, min(BATCH, b - lo))
                    ids, q = _arrays(part.column("id"), part.column("v"))
                    at, found, score = shard.search(ids, q, k, sure)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", query_every: int = 20, dims: int = DIMS, leaf: int = LEAF, sure: float = SURE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query (ids divisible by query_every)."""
    spark = ship(vectors.sparkSession)
    scratch, tasks = Scratch(spark, "nearest"), partitions(spark)
    rows = usable(vectors, vec_id, vector)
    # more copies of a row than k can't all be among the k nearest
    stored = scratch.save(rows.groupBy("n", "id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies")), "rows")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    spaces = stored.groupBy("n").agg(F.count("*").alias("rows"), (F.max(norm) * (1 + 1e-12)).alias("most"))
    # a row for each length of vectors
    spaces = spaces.select("n", "most", F.ceil(F.col("rows") * F.col("n") * 8 / shard_bytes).cast("int").alias("shards"), F.least(F.lit(tasks), F.greatest(F.lit(1), F.floor(F.col("rows") / query_every / BATCH))).cast("int").alias("parts"))
    spaces = spaces.withColumn("parts", F.least("parts", F.ceil(F.lit(tasks) / F.col("shards")).cast("int")))
    dealt = stored.join(spaces, "n").withColumn("shard", F.pmod(F.hash("id"), F.col("shards")).cast("int"))
    trees = scratch.save(dealt.groupBy("n", "shard").applyInArrow(_index(dims, leaf), "n int, shard int, tree binary"), "trees")
    asked = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min(F.struct("n", "v")).alias("q")).select("id", "q.n", "q.v")
    # every shard of a space that has rows gets all its queries: the stated query set against all rows
    asked = asked.join(spaces, "n").join(trees.select(F.col("n").alias("m"), F.col("shard").alias("at")), F.col("n") == F.col("m")).select("n", F.col("at").alias("shard"), F.pmod(F.hash("id", F.lit(1)), F.col("parts")).alias("part"), "id", "v", F.lit(None).cast("binary").alias("tree"))
    spread = trees.join(spaces, "n").select("n", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), "tree")
    met = asked.unionByName(spread).repartition(tasks, "n", "shard", "part").sortWithinPartitions("n", "shard", "part", F.col("tree").isNull())
    found = met.select("id", "v", "tree").mapInArrow(_search(k, sure), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
