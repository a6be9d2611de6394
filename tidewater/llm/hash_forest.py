"""Approximate nearest neighbours by inner product: a hash-prefix forest in blocks.

Each tree gives every vector a long bit string, one bit a hyperplane. A block of the index holds, per tree, the
sorted array of its strings. A query descends every tree to its longest matching prefix by binary search; all trees
then ascend together, one bit at a time, until the ranges under the query's prefixes hold enough candidates between
them. Their union is scored exactly, in double precision.

Rows fall into blocks by a hash of their id, so a third of them being one vector changes nothing; index blocks and
query blocks have a bounded number of rows, and every query block meets every index block in one task. Per block
only the nearest k of a query leave the task. The hyperplanes are fitted on a bounded sample: random directions, those
of one tree at right angles, scaled by the root of the sample's covariance, through its mean. Every valid row is indexed.

Embeddings without cluster structure leave no short prefix that separates near from far: the share of a block that
is visited has to be large for a recall of 0.9, and the work is queries times rows times that share. ``visit`` counts
the ranges of all trees together, so rows in several of them count several times; trees ascend together by one bit,
which doubles the ranges, until it is reached. Since every pair of blocks costs far more to score than to send (32,768
rows of 64 dimensions are 16 MB, scored against as many queries), blocks are sent to each other as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32
RESULT = "query_id long, vec_id long, score double"


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def fit_planes(sample: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(planes of trees x dim x BITS, offset of dim) from a sample of vectors."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((sample - mean).T).reshape(sample.shape[1], -1))
    root = (vectors * np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
    dim = sample.shape[1]
    turned = lambda: np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-BITS // dim))], axis=1)[:, :BITS]
    return np.stack([root @ turned() for _ in range(trees)]), mean


def _codes(x: np.ndarray, plane: np.ndarray, offset: np.ndarray) -> np.ndarray:
    bits = (x - offset) @ plane > 0
    return (bits.astype(np.uint64) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Forest:
    """The sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, planes: np.ndarray, offset: np.ndarray):
        self.ids, self.x, self.planes, self.offset = ids, x, planes, offset
        self.order, self.codes = [], []
        for plane in planes:
            codes = _codes(x, plane, offset)
            order = np.argsort(codes, kind="stable")
            self.order.append(order)
            self.codes.append(codes[order])

    def _ranges(self, queries: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the range of rows that share the first ``level`` bits."""
        low, high = [], []
        span = np.uint64(BITS - level)
        for codes, own in zip(self.codes, queries, strict=True):
            first = (own >> span) << span
            low.append(np.searchsorted(codes, first, side="left"))
            high.append(np.searchsorted(codes, first + (np.uint64(1) << span) - np.uint64(1), side="right"))
        return np.stack(low), np.stack(high)

    def candidates(self, q: np.ndarray, enough: float, least: int):
        """Per query, the rows found by ascending all trees together until their ranges hold ``enough`` rows."""
        own = np.stack([_codes(q, plane, self.offset) for plane in self.planes])
        open_ = np.arange(len(q))
        lows, highs = np.zeros(own.shape, dtype=np.int64), np.zeros(own.shape, dtype=np.int64)
        for level in range(BITS, -1, -1):
            low, high = self._ranges(own[:, open_], level)
            lows[:, open_], highs[:, open_] = low, high
            open_ = open_[(high - low).sum(axis=0) < enough]
            if not len(open_):
                break
        for i in range(len(q)):
            seen = np.zeros(len(self.ids), dtype=bool)
            for order, low, high in zip(self.order, lows[:, i].tolist(), highs[:, i].tolist(), strict=True):
                seen[order[low:high]] = True
            found = np.flatnonzero(seen)
            yield found if len(found) > least else np.arange(len(self.ids))


def _search(planes: np.ndarray, offset: np.ndarray, k: int, visit: float):
    def of(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x = index["vec_id"].to_numpy(), np.stack(index["embedding"]).astype(np.float64)
        forest = Forest(ids, x, planes, offset)
        own, q = queries["vec_id"].to_numpy(), np.stack(queries["embedding"]).astype(np.float64)
        out = []
        for i, rows in enumerate(forest.candidates(q, visit * len(ids), k)):
            rows = rows[ids[rows] != own[i]]
            score = (x[rows] * q[i]).sum(axis=1)
            if len(rows) > k:
                kth = np.partition(score, len(rows) - k)[len(rows) - k]
                rows, score = rows[score >= kth], score[score >= kth]
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), own[i]), ids[rows[best]], score[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return of


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    trees: int = 72,
    visit: float = 0.9,
    block_rows: int = 32_768,
    query_rows: int = 32_768,
    least_blocks: int = 16,
    sample_rows: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, or all candidates if fewer.

    vectors and queries have vec_id and embedding. A row whose vector is null, zero or holds a null or non-finite
    component takes no part, nor does one of another length than most have, or without id. Ids name rows: a
    candidate with the query's id is its own, an id that occurs again counts once with its best score. Ties go to
    the smaller id. Without valid rows there is no result. Other columns are not read.
    """
    spark = vectors.sparkSession
    valid = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    index = valid(vectors)
    lengths = index.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, asked = (df.where(F.size("embedding") == lengths["dim"]) for df in (index, valid(queries)))
    taken = index.select(F.xxhash64("vec_id", F.lit(seed)).alias("h"), "embedding").orderBy("h").limit(sample_rows)
    sample = np.array([r[0] for r in taken.select("embedding").collect()])
    if len(sample) < 2:
        sample = np.concatenate([sample, -sample])
    planes, offset = fit_planes(sample, trees, seed)
    blocks = max(least_blocks, -(-lengths["count"] // block_rows))
    chunks = max(1, -(-asked.count() // query_rows))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("chunk", all_of(chunks))
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("block", all_of(blocks))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(_search(planes, offset, k, visit), RESULT)
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
