"""Near copies by similarity: candidates by SimHash on vantage-point trees, a decision by exact Jaccard similarity.

One fingerprint of a whole text does not reach a bar of 0.8: there two fingerprints differ in 15 % of their bits, and with a
radius that wide no border separates a tree's sides any more. So a text has LAYERS fingerprints, each the SimHash (majority bits) of a
small sample of its word shingles. Sample j holds the shingles that are least by ``sample_size`` hashes of number j, and the least by
a hash is the same for two sets with a probability equal to their Jaccard similarity, whatever their sizes. Equal samples have
equal fingerprints. At 0.8 a sample has four shingles, so a pair there has an equal sample among 24 but for three in a million; at
0.85 but for one in a hundred million. Each layer's fingerprints go down a vantage-point tree, where those within RADIUS bits meet
(``simhash.stars``); fingerprints joined there are one key.

A pair that shares a key is linked if the Jaccard similarity of the two sets of word shingles reaches the bar, counted on
64-bit hashes of all their shingles. Texts are first compared with the first node of each key; then, in each key whose
texts are not all in one component yet, every pair from two components is compared, so a pair is never left
out because the first node is unlike. Equal texts are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.llm import simhash as S
from daymosaic.llm.base import batch, id_bytes, materialise, slices
from daymosaic.llm.language_id import join_hot
from daymosaic.llm.substrings import FILTER_BITS, bit_filter, has

#: Samples of a text, and the probability of an equal one that a pair at the bar must have.
LAYERS, MEET = 24, 0.99999
#: Differing bits up to which fingerprints meet, and the fingerprints of a layer that a shard of its tree should have.
RADIUS, SHARD = 1, 65_536
#: Shingles that are hashed at a time, and shingles of the texts that one task compares.
CHUNK, HELD = 1 << 12, 1 << 22


def remix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of the same shingles."""
    h = (h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of the word shingles; a text under ``size`` words is one, a text without words none."""
    n = max(1, len(words) - size + 1) if words else 0
    return np.array(list({xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(n)}), dtype=np.uint64)


def sample_size(similarity: float) -> int:
    """The most shingles in a sample with which a pair at the bar has an equal one among LAYERS with probability MEET."""
    sizes = [n for n in range(1, 9) if 1 - (1 - similarity ** n) ** LAYERS >= MEET]
    if not sizes:
        raise ValueError(f"{LAYERS} samples do not meet pairs at a similarity of {similarity}")
    return max(sizes)


def sample_fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each of LAYERS samples of a set of hashes; none for an empty set."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    k = np.arange(1, LAYERS * size + 1, dtype=np.uint64)[:, None]
    mask, by = remix(k, 0), remix(k, 1) | np.uint64(1)
    least = np.full(LAYERS * size, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(h), CHUNK):
        np.minimum(least, ((h[None, i:i + CHUNK] ^ mask) * by).min(axis=1), out=least)
    # a least value has few high bits, so it is hashed again; the number of its hash keeps layers apart
    sample = remix(least ^ mask[:, 0], 2).reshape(LAYERS, size)
    return S.over_half(S.bit_counts(sample), size).view(np.int64)


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def sketches(docs: DataFrame, size: int, sample: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (hash of the words) and fps, the fingerprints of its samples."""
    fields = [("doc_id", pa.int64()), ("node", pa.int64()), ("fps", pa.list_(pa.int64()))]

    def run(batches):
        for b in slices(batches):
            words = [t.lower().split() for t in b.column("text").to_pylist()]
            node = np.array([node_of(w) for w in words], dtype=np.uint64).view(np.int64)
            yield batch(fields, b.column("doc_id"), pa.array(node), [sample_fingerprints(shingles(w, size), sample) for w in words])
    return id_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, node bigint, fps array<bigint>")


def key_members(sketched: DataFrame) -> DataFrame:
    """key, node, first: the nodes whose fingerprints of one layer meet in its tree, and the first of them.

    A key is the least of the fingerprints that are joined; most are alone but for their equals.
    """
    nodes = sketched.groupBy("node").agg(F.min("fps").alias("fps"))
    held = nodes.select("node", F.posexplode("fps").alias("layer", "fp"))
    distinct = materialise(held.groupBy("layer", "fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    joined = S.components(S.stars(distinct, RADIUS, LAYERS, SHARD).select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    joined = joined.select(F.col("node").alias("fp"), "root")
    keyed = distinct.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("key"), "first", "n")
    key = Window.partitionBy("key")
    many = keyed.withColumns({"first": F.min("first").over(key), "n": F.sum("n").over(key)}).filter("n > 1").select("fp", "key", "first")
    own = nodes.select("node", F.explode(F.array_distinct("fps")).alias("fp"))
    return own.join(many, "fp").select("key", "node", "first").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """node and set (hashes of its shingles), one row for each of ``nodes``."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes, "node", nodes.count(), FILTER_BITS))

    def run(batches):
        bitmap, bits = sent.value
        for b in slices(batches):
            words = [t.lower().split() for t in b.column("text").to_pylist()]
            node = np.array([node_of(w) for w in words], dtype=np.uint64)
            at = np.flatnonzero(has(bitmap, bits, node))
            at = at[np.unique(node[at], return_index=True)[1]]
            yield batch([("node", pa.int64()), ("set", pa.list_(pa.int64()))], pa.array(node[at].view(np.int64)),
                        [shingles(words[i], size).view(np.int64) for i in at])
    found = id_bytes(docs, id_col, text_col).mapInArrow(run, "node bigint, set array<bigint>")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def first_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): nodes with the first node of one of their keys, as far as they are similar."""
    pairs = members.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    a, b = (sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    near = both / (F.size("sa") + F.size("sb") - both) >= similarity
    return pairs.join(a, "a").join(b, "b").filter(near).select("a", "b")


def links(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of similar pairs, enough to join all that are linked.

    ``group`` holds what is joined already. With two sides only pairs from one side to the other are compared.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    union = S.Union(len(sets))
    least = {int(g): i for i, g in reversed(list(enumerate(group)))}
    union.join(np.array([least[int(g)] for g in group]), np.arange(len(sets)))
    up, two = union.roots(), len(np.unique(side)) > 1
    mark = np.zeros(int(token.max()) + 1, dtype=bool)
    out = [], []
    for i in range(len(sets)):
        other = (up != up[i]) & (np.minimum(sizes, sizes[i]) / np.maximum(sizes, sizes[i]) >= similarity)
        other &= side != side[i] if two else True
        other[:i + 1] = False
        at = np.flatnonzero(other)
        if not len(at):
            continue
        own = token[begin[i]:begin[i + 1]]
        mark[own] = True
        if len(at) * 8 < len(sets):
            both = np.array([np.count_nonzero(mark[token[begin[j]:begin[j + 1]]]) for j in at])
        else:
            both = np.add.reduceat(mark[token], begin[:-1], dtype=np.int64)[at]
        mark[own] = False
        at = at[both / (sizes[i] + sizes[at] - both) >= similarity]
        if len(at):
            union.join(np.full(len(at), i), at)
            up = union.roots()
            out[0].append(np.full(len(at), i))
            out[1].append(at)
    none = [np.empty(0, dtype=np.int64)]
    return np.concatenate(out[0] or none), np.concatenate(out[1] or none)


def other_links(members: DataFrame, sets: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """(a, b): different components so far, by their roots, of similar nodes that share a key.

    A key's texts go to one task, or those of a crowded key are cut into k blocks, and blocks i and j meet in task (i, j).
    """
    rooted = members.join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "rooted")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    rows = rooted.join(open_, "key").join(sets.select("node", F.size("set").alias("n")), "node")
    rows = materialise(rows, "open")
    k = F.greatest(F.lit(1), F.ceil(F.sum("n") * 2 / F.lit(HELD))).cast("int")
    rows = rows.join(rows.groupBy("key").agg(k.alias("k")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), "k").cast("int"))
    rows = rows.select("key", "node", "root", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))).alias("t")).join(sets, "node")

    def compare(key, t):
        t = t.sort_by("node")
        root = t.column("root").to_numpy()
        held = t.column("set").combine_chunks()
        ends = held.offsets.to_numpy()
        flat = held.values.to_numpy()
        a, b = links([flat[x:y] for x, y in zip(ends, ends[1:])], root, t.column("own").to_numpy(), similarity)
        return pa.table({"a": root[b], "b": root[a]})

    return rows.select("key", "node", "root", "own", "t.i", "t.j", "set").groupBy("key", "i", "j").applyInArrow(
        compare, "a bigint, b bigint")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest id reachable over texts of at least ``similarity``, for every row.

    Similarity is the Jaccard similarity of the sets of ``size``-word shingles. Null texts are empty, and equal to each
    other alone; a null id is never the smallest where another is present; other columns are not read.
    """
    all_ = materialise(sketches(docs, size, sample_size(similarity), id_col, text_col), "sketches")
    members = materialise(key_members(all_), "members")
    sets = materialise(shingle_sets(docs, materialise(members.select("node").distinct(), "candidates"), size, id_col, text_col), "sets")
    linked = materialise(first_links(members, sets, similarity), "first-links")
    found = S.components(linked)
    # components are joined by their roots, so that those of one piece already are not walked through again
    wider = S.components(other_links(members, sets, found, similarity)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = all_.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(wider, "root", "left").select("doc_id", F.coalesce("top", "root").alias("group"))
    rooted = materialise(rooted, "groups")
    least = materialise(rooted.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
    # a text of its own is its own component; the others are joined, large groups apart
    alone, many = least.filter("size = 1").select(F.col("component_id").alias("doc_id"), "component_id"), least.filter("size > 1")
    joined = join_hot(rooted, many.select("group", "component_id"), many.select("group", "size"), ["group"])
    return joined.select("doc_id", "component_id").unionAll(alone)
