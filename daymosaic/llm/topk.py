"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, then 4, then 16 segments, each described by its mean and deviation. For two vectors the sum over
segments of length * (mean * mean + deviation * deviation) is never below their inner product (Cauchy-Schwarz on the centred
parts), so it bounds their distance from below. Bounds run coarse to fine against each query's k-th best score so far; exact
scores are computed for what survives. Queries are cut into blocks and vectors into shards, and block i meets shard j in task
(i, j), so neither the driver nor a task ever holds all of either.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.llm.base import ORACLE, batch, materialise, query, table
from daymosaic.llm.hard_negatives import HIGH, LEAST, LOW, MOST, dealt

#: Queries of a block, and vectors whose bounds are taken at a time.
BLOCK, ROWS = 4096, 1024
LEVELS = (1, 4, 16)
FIELDS = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter vectors ending in zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that a plain product of two rows is the bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    cols = [f(x[:, p], axis=1) * math.sqrt(len(p)) for p in parts if len(p) for f in (np.mean, np.std)]
    return np.stack(cols, axis=1) if cols else np.zeros((len(x), 1))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.s, self.v = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.n = n

    def add(self, q, s, v) -> None:
        q, s, v = (np.concatenate(x) for x in ((self.q, q), (self.s, s), (self.v, v)))
        order = np.lexsort((v, ~s, q))  # ~ turns the order without overflow
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.s, self.v = q[keep], s[keep], v[keep]
        full = rank == self.k - 1
        # a float just below the score, as a large one may be rounded up
        self.floor[q[full]] = np.maximum(self.floor[q[full]], np.nextafter(s[full].astype(np.float64), -np.inf))


def survivors(qs: list[np.ndarray], x: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) whose bounds reach the floor at every level."""
    qi = ci = None
    for level, q in zip(LEVELS, qs):
        c = statistics(x, level)
        slack = 1e-9 * (np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]) + 1e-6
        if qi is None or len(qi) > 0.05 * len(q) * len(c):  # dense is cheaper
            dense = q @ c.T >= (floor - slack)[:, None]
            if qi is not None:
                before = np.zeros_like(dense)
                before[qi, ci] = True
                dense &= before
            qi, ci = np.nonzero(dense)
        else:
            ok = np.einsum("ij,ij->i", q[qi], c[ci]) >= floor[qi] - slack
            qi, ci = qi[ok], ci[ok]
    return qi, ci


def whole(q: np.ndarray, x: np.ndarray) -> int:
    """The score in Python's whole numbers; beyond a long's range it counts as its end."""
    return min(HIGH, max(LOW, sum(a * b for a, b in zip(q.tolist(), x.tolist()))))


def exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs; float64 holds them exactly below 2**53, else integers are used."""
    q, x = np.asarray(q, dtype=np.int64), np.asarray(x, dtype=np.int64)
    f, g = q.astype(np.float64), x.astype(np.float64)
    if np.abs(f).max(initial=0) * np.abs(g).max(initial=0) * max(1, q.shape[1]) >= 2.0 ** 53:
        return np.array([whole(q[i], x[j]) for i, j in zip(qi, ci)], dtype=np.int64)
    if len(qi) > 0.05 * len(q) * len(x):
        return (f @ g.T)[qi, ci].astype(np.int64)
    return np.einsum("ij,ij->i", f[qi], g[ci]).astype(np.int64)


def search_rows(best: Best, ids: np.ndarray, q: np.ndarray, v: np.ndarray, x: np.ndarray) -> None:
    """Bring the rows x (ids v) to the best of the queries q (ids).

    Bounds are taken in floats. A component so large that a sum of products may pass 2**53 makes its row or query large, and
    pairs with a large one are scored at once, without bounds.
    """
    limit = (2.0 ** 53 / max(1, q.shape[1])) ** 0.5
    large_q, large_x = ((np.abs(m.astype(np.float64)) > limit).any(axis=1) for m in (q, x))
    small = np.flatnonzero(~large_q)
    qs = [statistics(q[small].astype(np.float64), n) for n in LEVELS]
    for at in range(0, len(v), ROWS):
        vx, xx, large = v[at:at + ROWS], x[at:at + ROWS], large_x[at:at + ROWS]
        some = np.flatnonzero(~large)
        qi, ci = survivors(qs, xx[some].astype(np.float64), best.floor[small]) if len(some) and len(small) else (some[:0], some[:0])
        pairs = [(small[qi], some[ci]), *((np.repeat(a, len(b)), np.tile(b, len(a))) for a, b in (
            (np.flatnonzero(large_q), np.arange(len(vx))), (small, np.flatnonzero(large))))]
        for qi, ci in pairs:
            other = ids[qi] != vx[ci]
            qi, ci = qi[other], ci[other]
            if len(qi):
                s = exact(q, xx, qi, ci)
                good = s >= best.floor[qi]
                best.add(qi[good], s[good], vx[ci[good]])


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of the vectors whose components are all finite numbers, within the range of a long."""
    x = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad).select(
        "vec_id", F.transform("vec", lambda c: F.floor(c * scale).cast("bigint")).alias("vec"))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row where ``queries`` (over ``vec_id``) holds.

    Rows with a null id, a null vector, or null or non-finite components take no part. Ties go to the smaller id;
    repeated rows each count, but never a row with the query's own id; of a query's repeated rows the least vector asks.
    Shorter vectors count as ending in zeros. Components and scores beyond a long's range count as its ends.
    """
    x = materialise(quantised(vectors, id_col, vec_col, scale).withColumn("at", F.monotonically_increasing_id()), "vectors")
    asked = materialise(x.filter(queries).groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    n, width = x.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = width or 0
    shards, blocks = max(1, -(-n // max(LEAST, min(MOST, n // 64)))), max(1, -(-asked.count() // BLOCK))

    def search(t):
        part = [t.filter(pc.equal(t.column("asks"), asks)).combine_chunks() for asks in (True, False)]
        ids, v = (p.column("vec_id").to_numpy() for p in part)
        best = Best(len(ids), k, np.full(len(ids), -np.inf))
        if len(ids) and len(v):
            q, x = (matrix(p.column("vec").chunk(0), width) for p in part)
            search_rows(best, ids, q, v, x)
        return pa.Table.from_batches([batch(FIELDS, ids[best.q], best.v, best.s)])

    out = dealt(x, asked, shards, blocks).groupBy("block", "shard").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE["op9_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


@query("op9_topk_search")
def op9(spark, d) -> DataFrame:
    return top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)
