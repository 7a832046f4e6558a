"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints are majority bits over the hashes of word shingles. Distinct fingerprints are routed down a vantage-point tree
whose nodes come from a bounded sample: inside if the distance to the vantage point is at most the node's radius, else
outside. By the triangle inequality a pair within ``bits`` that a node separates has its inside member within ``bits - 1``
of the border, so only such members also go outside, and every close pair meets in one shard. A shard goes on dividing
itself the same way until blocks are small enough to compare in full. Shards report stars, not pairs; stars are joined to
components by label propagation over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import batch, id_bytes, materialise, query, slices, table

#: Fingerprints that the tree is built from, and the fingerprints that a shard should have.
SAMPLE, SHARD = 16_384, 4_096
#: Fingerprints that one task compares. Larger shards, as of a crowded region, are dealt out as pairs of blocks.
TASK = 262_144
#: Blocks of this many are compared in full.
BLOCK = 512


def fingerprint(words: list[bytes], size: int) -> int:
    """Bits set in over half of the shingles' hashes; zero without words."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = (b" ".join(words[i:i + size]) for i in range(n)) if size != 3 or n == 1 else (
        a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:]))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(s, 42) for s in shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 8192):
        ones += bit_counts(hashes[i:i + 8192])
    return int(over_half(ones, n))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """(..., 64) counts of each bit over the last axis of hashes."""
    octets = hashes.astype("<u8")[..., None].view(np.uint8)
    return np.unpackbits(octets, axis=-1, bitorder="little").sum(axis=-2, dtype=np.int64)


def over_half(ones: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints with the bits that are set in over half of n hashes."""
    return np.packbits(2 * ones > n, axis=-1, bitorder="little").view("<u8")[..., 0]


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint as a signed long, for every row. A-Z are lower-cased; a null text has no words."""
    def run(batches):
        for b in slices(batches):
            fps = [fingerprint(t.lower().split(), size) for t in b.column("text").to_pylist()]
            yield batch([("doc_id", pa.int64()), ("fp", pa.int64())], b.column("doc_id"),
                        pa.array(np.array(fps, dtype=np.uint64).view(np.int64)))
    return id_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def distance(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def border(d: np.ndarray, bits: int) -> tuple[int, float]:
    """The radius that divides with least work: the larger side after copies, as a share of all."""
    n = np.bincount(d, minlength=66).cumsum()
    best = (65, 1.0)
    for r in range(int(d.min()), int(d.max())):
        inside = n[r]
        outside = n[-1] - n[max(r - bits, -1)] if r - bits >= 0 else n[-1]
        if (share := max(inside, outside) / n[-1]) < best[1]:
            best = (r, share)
    return best


def build_tree(sample: np.ndarray, bits: int, leaf: float) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside). Negative children are leaves, -1 - number."""
    nodes, leaves = [], 0

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        v, r, share = (0, 0, 1.0) if len(x) <= leaf else vantage(x, bits)
        if share > 0.9:
            leaves += 1
            return -leaves
        d, at = distance(x, np.uint64(v)), len(nodes)
        nodes.append((int(v), r, 0, 0))
        kids = grow(x[d <= r]), grow(x[d > r - bits])
        nodes[at] = (int(v), r, *kids)
        return at

    return nodes if grow(np.unique(sample)) >= 0 else []


def vantage(x: np.ndarray, bits: int) -> tuple[int, int, float]:
    """Of a few points spread over the values, the one that divides best."""
    picks = x[np.linspace(0, len(x) - 1, num=min(8, len(x))).astype(int)]
    tries = [(*border(distance(x[:: max(1, len(x) // 4096)], v), bits), v) for v in picks]
    r, share, v = min(tries, key=lambda t: t[1])
    return int(v), r, share


def route(x: np.ndarray, nodes: list[tuple[int, int, int, int]], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in x that belong there); a position may be in several."""
    stack = [(0 if nodes else -1, np.arange(len(x)))]
    while stack:
        at, idx = stack.pop()
        if not len(idx):
            continue
        if at < 0:
            yield -1 - at, idx
            continue
        v, r, inside, outside = nodes[at]
        d = distance(x[idx], np.uint64(v))
        stack += [(inside, idx[d <= r]), (outside, idx[d > r - bits])]


class Union:
    """Union-find over positions; the least position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.roots()
            x, y = up[a], up[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low < high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(self.up, high, low)


def blocks(x: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Positions to compare in full, dividing by vantage points first; every pair within ``bits`` is in one of them."""
    stack = [np.arange(len(x))]
    while stack:
        idx = stack.pop()
        v, r, share = (0, 0, 1.0) if len(idx) <= BLOCK else vantage(x[idx], bits)
        if share > 0.9:
            yield idx
            continue
        d = distance(x[idx], np.uint64(v))
        stack += [idx[d <= r], idx[d > r - bits]]


def link(x: np.ndarray, bits: int, union: Union) -> None:
    """Join all pairs of distinct fingerprints x within ``bits``."""
    for idx in blocks(x, bits):
        for i in range(0, len(idx), BLOCK):
            rows = idx[i:i + BLOCK]
            for j in range(i, len(idx), 8 * BLOCK):
                cols = idx[j:j + 8 * BLOCK]
                a, b = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[cols][None, :]) <= bits)
                union.join(rows[a], cols[b])


def dealt(placed: DataFrame, task: int) -> DataFrame:
    """Rows with ``t``, the task (i, j) of their shard: a crowded shard is cut into k blocks by hash, and blocks i and j meet
    in task (i, j), so each row has k copies."""
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / F.lit(task))).cast("int")
    sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select("shard", k.alias("k"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), "k").cast("int")
    return placed.join(sizes, "shard").withColumn("own", own).select(*placed.columns, F.explode(F.transform(
        F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))).alias("t"))


def stars(distinct: DataFrame, bits: int, layers: int = 1, shard: int = SHARD) -> DataFrame:
    """(fp, hub) for each fingerprint and each shard where it has others within reach; hubs may differ by shard.

    With several ``layers`` only fingerprints of one ``layer`` (0 to layers - 1) meet; all are routed down the same tree.
    """
    n = distinct.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = drawn.limit(2 * SAMPLE).toArrow().column("fp").to_numpy().view(np.uint64)
    nodes = build_tree(np.sort(sample), bits, max(8.0, shard * layers * len(sample) / max(1, n)))

    def send(batches):
        for b in batches:
            x, layer = b.column("fp").to_numpy(), b.column("layer").to_numpy()
            for leaf, idx in route(x.view(np.uint64), nodes, bits):
                yield batch([("shard", pa.int64()), ("fp", pa.int64())], pa.array(leaf * layers + layer[idx]), pa.array(x[idx]))

    layer = (F.col("layer") if layers > 1 else F.lit(0)).cast("bigint").alias("layer")
    placed = materialise(distinct.select("fp", layer).mapInArrow(send, "shard bigint, fp bigint"), "shards")
    tasks = dealt(placed, TASK)

    def compare(key, t):
        x = np.sort(t.column("fp").to_numpy())
        union = Union(len(x))
        link(x.view(np.uint64), bits, union)
        root = union.roots()
        size = np.bincount(root, minlength=len(x))[root]
        return pa.table({"fp": x[size > 1], "hub": x[root[size > 1]]})

    return tasks.groupBy("shard", "t.i", "t.j").applyInArrow(compare, "fp bigint, hub bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph of (a, b) edges: labels fall to the least neighbour's, then to their label's label.

    Each round is stored in the shared folder before labels are handed on, so that no join runs twice and the round in which
    no label falls ends there.
    """
    edges = materialise(edges.filter("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        new = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("low"))
        new = materialise(new, "lows")
        if not new.filter("low < root").limit(1).count():
            return labels
        # a root's own label may have fallen: hand the fall on to all that carry the root
        falls = new.groupBy("root").agg(F.min("low").alias("fall")).withColumnRenamed("root", "old")
        labels = materialise(new.join(falls, new.root == falls.old).select("node", F.least("low", "fall").alias("root")), "labels")


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) for every row.

    Null texts are empty and share the zero fingerprint; a null id is kept, never the smallest where another is present.
    Repeated rows are members of one component. Other columns are not read.
    """
    docs_fp = materialise(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = materialise(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(stars(distinct, bits).select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    reps = distinct.join(found, distinct.fp == found.node, "left").select(
        F.col("fp").alias("key"), "first", F.coalesce("root", "fp").alias("root"))
    least = reps.groupBy("root").agg(F.min("first").alias("component_id"))
    # as many rows as fingerprints that are linked; the others keep their own first id
    ids = reps.join(least, "root").select("key", "component_id")
    return docs_fp.join(ids, docs_fp.fp == ids.key).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without those of which a smaller id is in reach; all columns as they were.

    ``found`` holds doc_id and component_id. Rows with a null id are kept. Rows that share an id are one document and
    leave one row.
    """
    found = materialise(found.select("doc_id", "component_id"), "components")
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    left = docs.join(gone, docs[id_col].cast("bigint") == gone.gone, "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        some = left.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        left = some.unionByName(left.filter(F.col(id_col).isNull()))
    return left


@query("op4_simhash_dedup")
def op4(spark, d) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"))
