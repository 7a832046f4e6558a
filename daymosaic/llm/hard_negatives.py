"""Hard negatives by vertical scans over columns (branch and bound on decomposed vectors).

Rows are cut into shards and anchors into blocks, and block i meets shard j in task (i, j). A task holds its shard column by
column, in order of the labels. An anchor reads the columns in descending order of its own components' magnitude. After a few
columns, a row's score lies between its partial sum and what the remaining columns can add, from the shard's minima and maxima
in them; rows that cannot reach the anchor's best rows, or its windows of scores, leave the candidates. The few that remain are
read to the last column, so their scores are exact.

A first pass finds each anchor's positives among the rows of its label. A second finds, for each positive, the best rows of
other labels in the window of scores below the positive's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.llm.base import ORACLE, batch, materialise, query, table

#: Anchors of a block. Rows of a shard: a 64th of all, but neither fewer nor more than these.
BLOCK, LEAST, MOST = 16_384, 4_096, 65_536
#: Columns read between two looks at the bounds.
STEP = 8
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label and vec, floor(scale * x), of the rows that take part. Components beyond a long's range count as its ends."""
    x = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                       F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad).select(
        "vec_id", "label", F.transform("vec", lambda c: F.floor(c * scale).cast("bigint")).alias("vec"))


def columns_of(column: pa.Array, width: int) -> np.ndarray:
    """(width, rows) of whole numbers; shorter vectors end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return np.ascontiguousarray(out.T)


class Shard:
    """Rows in order of label and id, column by column."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.whole = ids[order], labels[order], x[:, order]
        self.x = self.whole.astype(np.float64)
        #: With components up to this every sum of products is a whole number below 2**53, so floats hold it exactly.
        self.limit = int((2 ** 53 / max(1, len(x))) ** 0.5)
        large = (np.abs(self.x) > self.limit).any(axis=0)
        self.small, self.large = np.flatnonzero(~large), np.flatnonzero(large)

    def exact(self, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores in Python's whole numbers; beyond a long's range they count as its ends."""
        own = a.tolist()
        return np.array([min(HIGH, max(LOW, sum(p * q for p, q in zip(own, self.whole[:, j].tolist())))) for j in at],
                        dtype=np.int64)

    def scan(self, a: np.ndarray, at: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Positions out of ``at`` that stay under ``keep(low, high)``, a mask from bounds on their scores, and exact scores."""
        slow = at if (np.abs(a.astype(np.float64)) > self.limit).any() else np.intersect1d(at, self.large, assume_unique=True)
        at = np.setdiff1d(at, slow, assume_unique=True)
        order, a64 = np.argsort(-np.abs(a), kind="stable"), a.astype(np.float64)
        score = np.zeros(len(at))
        if len(at):
            whole = len(at) == at[-1] - at[0] + 1
            x = self.x[:, at[0]:at[-1] + 1] if whole else self.x[:, at]
            ends = a64[:, None] * np.stack([x.min(axis=1), x.max(axis=1)], axis=1)
            left = np.cumsum(np.sort(ends, axis=1)[order][::-1], axis=0)[::-1]  # least and most from a column on
            for i in range(0, len(order), STEP):
                dims = order[i:i + STEP]
                score = score + a64[dims] @ x[dims]
                low, high = left[i + STEP] if i + STEP < len(order) else (0.0, 0.0)
                alive = keep(score + low, score + high)
                if 2 * np.count_nonzero(alive) < len(alive) or i + STEP >= len(order):
                    at, score, x = at[alive], score[alive], x[:, alive]
                if not len(at):
                    break
        return np.concatenate([at, slow]), np.concatenate([score.astype(np.int64), self.exact(a, slow)])

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[at], ~score))[:k]  # ~ turns the order without overflow
        return at[order], score[order]

    def positives(self, anchor: int, label: int, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = (np.searchsorted(self.labels, label, side) for side in ("left", "right"))
        at = np.arange(lo, hi)
        at = at[self.ids[at] != anchor]

        def keep(low, high):
            return high >= np.partition(low, -k)[-k] if len(low) > k else np.ones(len(low), dtype=bool)
        return self.best(*self.scan(a, at, keep), k)

    def negatives(self, anchor: int, label: int, a: np.ndarray, windows: list[tuple[int, int]], k: int):
        """For each window of scores its k best rows of other labels."""
        lo, hi = (np.searchsorted(self.labels, label, side) for side in ("left", "right"))
        at = np.concatenate([np.arange(lo), np.arange(hi, len(self.ids))])
        at = at[self.ids[at] != anchor]
        open_ = sorted({w for w in windows if w[0] <= w[1]})

        def keep(low, high):
            alive = np.zeros(len(low), dtype=bool)
            for least, most in open_:
                meets = (high >= least) & (low <= most)
                inside = low[(low >= least) & (high <= most)]
                if len(inside) > k:  # k rows are in the window for certain
                    meets &= high >= np.partition(inside, -k)[-k]
                alive |= meets
            return alive
        at, score = self.scan(a, at, keep) if open_ else (at[:0], np.empty(0, dtype=np.int64))
        for least, most in windows:
            fits = (score >= least) & (score <= most)
            yield self.best(at[fits], score[fits], k)


def dealt(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Rows and anchors with the (block, shard) tasks that they meet in."""
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int")).drop("at").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return rows.withColumn("asks", F.lit(False)).unionByName(anchors.withColumn("asks", F.lit(True)), allowMissingColumns=True)


def halves(t: pa.Table, width: int) -> tuple[Shard, Iterator[tuple[int, int, np.ndarray, list]]]:
    """The shard of a task and its anchors (id, label, vector, positive scores)."""
    t = t.combine_chunks()
    part = {asks: t.filter(pc.equal(t.column("asks"), asks)).combine_chunks() for asks in (False, True)}

    def column(asks, name):
        c = part[asks].column(name)
        return c.chunk(0) if c.num_chunks else pa.array([], c.type)
    ids, labels, x = ({a: f(a) for a in (False, True)} for f in (
        lambda a: column(a, "vec_id").to_numpy(), lambda a: column(a, "label").to_numpy(),
        lambda a: columns_of(column(a, "vec"), width)))
    scores = column(True, "scores").to_pylist() if "scores" in t.column_names else [None] * len(ids[True])
    return Shard(ids[False], labels[False], x[False]), zip(ids[True].tolist(), labels[True].tolist(), x[True].T, scores)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
                   scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``anchors`` (over ``vec_id``,
    ``label``) holds.

    A positive is one of the anchor's first ``positives`` other rows of its label; its negatives are the first ``negatives`` rows
    of other labels with least * positive_score <= 100 * negative_score <= most * positive_score. Scores are whole inner products
    and exact, beyond a long's range its ends; higher ones come first, ties by smaller id.

    Rows with a null id or label, a null vector, or null or non-finite components take no part. Repeated rows each count, but
    never one with the anchor's id; of an anchor's repeated rows the least label, then the least vector, asks. Shorter vectors end
    in zeros. An anchor without positives, or a positive without negatives, gives no row; an empty table none at all. Other
    columns are not read.
    """
    x = quantised(vectors, scale, id_col, vec_col, label_col)
    # numbered and stored once, so that rows that repeat an id are spread too
    x = materialise(x.withColumn("at", F.monotonically_increasing_id()), "vectors")
    asked = x.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec")
    asked = materialise(asked, "anchors")
    n, width = x.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = width or 0
    shards, blocks = max(1, -(-n // max(LEAST, min(MOST, n // 64)))), max(1, -(-asked.count() // BLOCK))
    first = [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]

    def find_positives(t: pa.Table) -> pa.Table:
        shard, asks = halves(t, width)
        out = []
        for i, label, a, _ in asks:
            at, score = shard.positives(i, label, a, positives)
            out += zip([i] * len(at), shard.ids[at].tolist(), score.tolist())
        return pa.Table.from_batches([batch(first, *map(list, zip(*out))) if out else batch(first)])

    found = dealt(x, asked, shards, blocks).groupBy("block", "shard").applyInArrow(
        find_positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    w = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= positives)
    found = materialise(found, "positives")
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asked = asked.join(lists.select("vec_id", F.col("p.positive_score").alias("scores")), "vec_id")
    second = [("anchor_id", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]

    def find_negatives(t: pa.Table) -> pa.Table:
        shard, asks = halves(t, width)
        out = []
        for i, label, a, scores in asks:
            windows = [(-(-least * p // 100), most * p // 100) for p in scores]
            for place, (at, score) in enumerate(shard.negatives(i, label, a, windows, negatives), 1):
                out += zip([i] * len(at), [place] * len(at), shard.ids[at].tolist(), score.tolist())
        return pa.Table.from_batches([batch(second, *map(list, zip(*out))) if out else batch(second)])

    hard = dealt(x, asked, shards, blocks).groupBy("block", "shard").applyInArrow(
        find_negatives, "anchor_id bigint, place int, negative_id bigint, negative_score bigint")
    w = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives)
    return hard.join(found, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


@query("op13_hard_negatives")
def op13(spark, d) -> DataFrame:
    x = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(x.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
