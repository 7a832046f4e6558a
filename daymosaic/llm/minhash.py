"""Near-duplicates by bottom-k sketches.

One hash function over a text's word shingles; the sketch retains the KEPT least hashes of the set. Texts with the same words are
one node. Of two sets at the bar, the KEPT least hashes of the union are shared ones each with at least that probability,
so two sketches have ``least_overlap`` values in common but with a probability under TAIL; sets that are retained whole have
their share of them for certain.

1. Inverted lists. Retained values are counted over all nodes, and a node goes only into the lists of its rarest ones: all but
   ``least_overlap`` - 1. Two sketches with that overlap still meet in a list, and a node most of whose values nobody else
   retains goes into none, however many share a passage of it.
2. In every list the node whose values are most common is the hub. Hub and members are compared: first the estimate from the
   sketch of the union, then, if that does not rule the pair out, the exact similarity of the full sets.
3. Lists whose members are not all in one component yet, of equal lists one, are searched for other pairs: members of
   which no estimate reaches another component go, and the others' full sets are compared from component to component.

Components are joined by label propagation over tables; no stage holds all pairs of a group.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import LOWER, UPPER, batch, id_bytes, materialise, query, slices, table
from daymosaic.llm.language_id import join_hot
from daymosaic.llm.similar import links, remix
from daymosaic.llm.simhash import components
from daymosaic.llm.substrings import FILTER_BITS, OTHER, Hasher, bit_filter, has, words_hashed

#: Hashes that a sketch retains, and the probability with which a pair at the bar may overlap less than it must.
KEPT, TAIL = 64, 1e-12
#: Members of a list's block, shingles of the sets that one task compares, and sets that meet a hub at once.
BLOCK, HELD, MET = 4_096, 1 << 22, 512
NONE = -(1 << 63)


def least_overlap(kept: int, percent: int) -> int:
    """What a binomial draw of ``kept`` at ``percent`` stays below with a probability of at most TAIL."""
    p, below = percent / 100, 0.0
    for c in range(kept + 1):
        below += comb(kept, c) * p ** c * (1 - p) ** (kept - c)
        if below > TAIL:
            return max(1, c)
    return kept


def shingle_hashes(h: np.ndarray, size: int, hasher: Hasher) -> np.ndarray:
    """The distinct hashes of the shingles, least first, as numbers of 63 bits; of a text under ``size`` words one, else none."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    lo = np.arange(max(1, len(h) - size + 1))
    hi = np.minimum(lo + size, len(h))
    runs = hasher.runs(hasher.sums(h), lo, hi) + (hi - lo).astype(np.uint64) * OTHER
    return np.unique(remix(runs, 0) >> np.uint64(1)).view(np.int64)


def texts_hashed(docs: DataFrame, size: int):
    """For each batch its ids (NONE for null), and for each text (node, tag, hashes); a tag tells a node's documents apart."""
    def run(batches):
        hasher = Hasher()
        for b in slices(batches):
            ids = [NONE if i is None else i for i in b.column("doc_id").to_pylist()]
            out = []
            for i, h in zip(ids, words_hashed([t.lower() for t in b.column("text").to_pylist()])):
                node = hasher.runs(hasher.sums(h[:, 1]), np.array([0]), np.array([len(h)])) + np.uint64(len(h)) * OTHER
                tag = remix(node ^ remix(np.array([i], dtype=np.int64).view(np.uint64), 1), 2)
                out.append((int(node.view(np.int64)[0]), int(tag.view(np.int64)[0]), shingle_hashes(h[:, 0], size, hasher)))
            yield b, out
    return run


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, node (hash of the words), tag, n (shingles) and kept (the least hashes)."""
    hashed = texts_hashed(docs, size)
    fields = [("doc_id", pa.int64()), ("node", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("kept", pa.list_(pa.int64()))]

    def run(batches):
        for b, out in hashed(batches):
            yield batch(fields, b.column("doc_id"), [x[0] for x in out], [x[1] for x in out], [len(x[2]) for x in out],
                        [x[2][:KEPT] for x in out])
    return docs.mapInArrow(run, "doc_id bigint, node bigint, tag bigint, n bigint, kept array<bigint>")


def full_sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """node, all (hashes): from one document of each wanted node; a few more sets come along, as the tags pass through a bitmap."""
    hashed = texts_hashed(docs, size)
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "tag", wanted.count(), FILTER_BITS))

    def run(batches):
        bitmap, bits = sent.value
        for _, out in hashed(batches):
            pick = has(bitmap, bits, np.array([x[1] for x in out], dtype=np.int64).view(np.uint64))
            out = [x for x, p in zip(out, pick) if p]
            yield batch([("node", pa.int64()), ("all", pa.list_(pa.int64()))], [x[0] for x in out], [x[2] for x in out])
    return docs.mapInArrow(run, "node bigint, all array<bigint>")


def least_shared(n: Column, percent: int) -> Column:
    return F.least(F.ceil(n * percent / 100), F.lit(least_overlap(KEPT, percent)))


def near_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def inverted_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """value, node, n, weight: each node in the lists of its rarest values. ``weight`` grows with how common its values are."""
    counts = materialise(nodes.select(F.explode("kept").alias("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("size")).filter("size > 1"), "values")
    sent = nodes.sparkSession.sparkContext.broadcast(bit_filter(counts, "value", counts.count(), FILTER_BITS))

    def run(batches):
        bitmap, bits = sent.value
        for b in batches:
            kept = b.column("kept")
            flat, ends = kept.flatten().to_numpy(), kept.offsets.to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            ok = has(bitmap, bits, flat.view(np.uint64))
            yield batch([("value", pa.int64()), ("node", pa.int64()), ("n", pa.int64())], pa.array(flat[ok]),
                        *(pa.array(b.column(c).to_numpy()[row[ok]]) for c in ("node", "n")))
    shared = nodes.select("node", "n", "kept").mapInArrow(run, "value bigint, node bigint, n bigint")
    # values without a second node are not in the table, so a list ends where nobody else can be met
    shared = join_hot(shared, counts, counts, ["value"])
    own = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("size", "value"))).alias("v"))
    first = F.size("v") - least_shared(F.col("n"), percent) + 1
    own = own.withColumn("first", first.cast("int")).filter("first > 0")
    weight = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x["size"])
    return own.select("node", "n", weight.alias("weight"), F.explode(F.slice("v", 1, F.col("first"))).alias("x")).select(
        F.col("x.value").alias("value"), "node", "n", "weight")


def hubs(postings: DataFrame) -> DataFrame:
    """value, size, hub, hub_n, one row for equal lists."""
    lists = postings.groupBy("value").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", "node", "n")).alias("h"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    lists = lists.filter("size > 1").groupBy("size", "x", "y", "h").agg(F.min("value").alias("value"))
    return lists.select("value", "size", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))


def may_be_near(a: str, b: str, percent: int) -> Column:
    """Whether the sketch of the union leaves the pair of sketches possible."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, KEPT)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return both >= least_shared(F.size(union), percent)


def hub_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(hub, node) that the sketches leave possible."""
    pairs = members.filter(F.col("node") != F.col("hub")).filter(near_size(F.col("n"), F.col("hub_n"), percent)).select(
        "hub", "node").distinct()
    pairs = materialise(pairs.join(nodes.select("node", "kept"), "node"), "pairs")
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    hub_kept = nodes.select(F.col("node").alias("hub"), F.col("kept").alias("hub_kept"))
    return join_hot(pairs, hub_kept, sizes, ["hub"]).filter(may_be_near("kept", "hub_kept", percent)).select("hub", "node")


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose full sets reach the bar. A hub's set travels once to each block of its members."""
    spread = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("blocks"))
    rows = join_hot(pairs, spread, pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("size")), ["hub"]).select(
        "hub", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node")
    rows = rows.unionByName(rows.select("hub", "block").distinct().withColumn("node", F.col("hub")))

    def compare(batches):
        key = hub = None
        for b in batches:
            found, all_ = [], b.column("all")
            flat, ends = all_.flatten().to_numpy(), all_.offsets.to_numpy()
            ends = ends - ends[0]
            for i, (h, block, node, _) in enumerate(zip(*(b.column(c).to_pylist() for c in ("hub", "block", "node", "first")))):
                own = flat[ends[i]:ends[i + 1]]
                if (h, block) != key:
                    key, hub = (h, block), own.copy()  # the hub comes first
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if node != h and 100 * both >= percent * (len(hub) + len(own) - both):
                    found.append((node, h))
            yield batch([("a", pa.int64()), ("b", pa.int64())], *map(list, zip(*found))) if found else batch(
                [("a", pa.int64()), ("b", pa.int64())])

    rows = rows.join(sets, "node").withColumn("first", F.col("node") != F.col("hub"))
    dealt = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "first")
    return dealt.select("hub", "block", "node", "first", "all").mapInArrow(compare, "a bigint, b bigint")


def blocks_met(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of a list in its tasks (i, j): of k blocks, i and j meet in task (i, j). ``blocks`` holds value, k, size."""
    rows = join_hot(rows, blocks.select("value", "k"), blocks.select("value", "size"), ["value"])
    own = F.pmod(F.xxhash64("node", F.lit(1)), "k").cast("int")
    return rows.withColumn("own", own).withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))))


def live_members(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """value, node: members with an estimate that reaches a member of another component."""
    sizes = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    met = blocks_met(rows, materialise(sizes, "sizes")).join(nodes.select("node", "kept"), "node")
    q = least_overlap(KEPT, percent)

    def compare(key, t):
        t = t.combine_chunks()
        kept, n, root = t.column("kept").chunk(0), t.column("n").to_numpy(), t.column("root").to_numpy()
        node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
        ends, two = kept.offsets.to_numpy(), key[1].as_py() != key[2].as_py()
        flat = kept.flatten().to_numpy()
        token = np.unique(flat, return_inverse=True)[1]
        begin, mark = (ends - ends[0])[:-1], np.zeros(len(flat) + 1, dtype=bool)
        must, live = np.minimum(-(-n * percent // 100), q), np.zeros(len(n), dtype=bool)
        for i in range(len(n)):
            other = (root != root[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
            other &= own != own[i] if two else True
            if live[i] and not (other & ~live).any() or not other.any():
                continue
            at = token[begin[i]:begin[i] + min(n[i], KEPT)]
            mark[at] = True
            near = other & (np.add.reduceat(mark[token], begin, dtype=np.int64) >= np.maximum(must, must[i]))
            mark[at] = False
            live |= near
            live[i] |= near.any()
        return pa.table({"value": np.full(int(live.sum()), key[0].as_py(), dtype=np.int64), "node": node[live]})

    return met.select("value", "t.i", "t.j", "node", "n", "root", "own", "kept").groupBy("value", "i", "j").applyInArrow(
        compare, "value bigint, node bigint").distinct()


def other_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): similar members of a list in different components, enough to join all that are linked."""
    k = F.greatest(F.lit(1), F.ceil(F.sum("n") * 2 / F.lit(HELD))).cast("int")
    sizes = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size"), k.alias("k"))
    met = blocks_met(rows, materialise(sizes, "sizes")).join(sets, "node")

    def compare(key, t):
        t = t.sort_by([("weight", "descending"), ("node", "ascending")]).combine_chunks()
        node, held = t.column("node").to_numpy(), t.column("all").chunk(0)
        first = np.sort(np.unique(node, return_index=True)[1])
        ends, flat = held.offsets.to_numpy(), held.flatten().to_numpy()
        ends = ends - ends[0]
        a, b = links([flat[ends[i]:ends[i + 1]] for i in first], t.column("root").to_numpy()[first],
                     t.column("own").to_numpy()[first], percent / 100)
        return pa.table({"a": node[first[b]], "b": node[first[a]]})

    return met.select("value", "t.i", "t.j", "node", "root", "own", "weight", "all").groupBy("value", "i", "j").applyInArrow(
        compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept for every row.

    Texts are linked if 100 * intersection >= percent * union of their sets of distinct ``size``-word shingles; A-Z are
    lower-cased. A text of fewer words is one shingle; null and empty texts have none and are linked with nothing, so each is kept
    under its own id. Repeated rows are linked like any equal texts. A null id is never the smallest where another is
    present, and its row is kept only if no other is. Shingles and equal texts are told apart by 64-bit hashes. Other columns are
    not read; an empty table gives no rows.
    """
    texts = id_bytes(docs, id_col, text_col)
    all_ = materialise(sketches(texts, size), "sketches")
    nodes = all_.filter("n > 0").groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(NONE)).alias("id"), "tag")).alias("x"), F.min("doc_id").alias("first"),
        F.first("n").alias("n"), F.first("kept").alias("kept"), F.count(F.lit(1)).alias("size"))
    nodes = materialise(nodes.select("node", "x.tag", "first", "n", "kept", "size"), "nodes")
    postings = materialise(inverted_lists(nodes, percent), "postings")
    lists = materialise(hubs(postings), "lists")
    members = materialise(join_hot(postings, lists.select("value", "hub", "hub_n"), lists.select("value", "size"), ["value"]), "members")
    pairs = materialise(hub_pairs(members, nodes, percent), "candidates")
    wanted = nodes.select("node", "tag").join(members.select("node").distinct(), "node", "left_semi")
    sets = materialise(full_sets(texts, size, materialise(wanted.select("tag"), "wanted")), "sets")
    linked = materialise(hub_links(pairs, sets, percent), "links")
    joined = components(linked)
    rows = members.join(joined, "node", "left").select("value", "node", "n", "weight", F.coalesce("root", "node").alias("root"))
    rows = materialise(rows, "rooted")
    open_ = rows.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    open_ = materialise(open_.filter("low < high").select("value", "size"), "open")
    rows = materialise(join_hot(rows, open_.select("value"), open_, ["value"]), "rows")
    live = materialise(live_members(rows, nodes, percent), "live")
    more = other_links(rows.join(live, ["value", "node"]), sets, percent)
    found = components(linked.unionAll(more))
    rooted = materialise(nodes.join(found, "node", "left").select(
        "node", "first", "size", F.coalesce("root", "node").alias("group")), "groups")
    least = rooted.groupBy("group").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    least = materialise(least, "least")
    ids = join_hot(rooted.select("node", "group"), least.select("group", "component_id"), least.select("group", "size"), ["group"])
    out = join_hot(all_.filter("n > 0").select("doc_id", "node", "n"), ids.select("node", "component_id"),
                   nodes.select("node", "size"), ["node"]).select("doc_id", "n", "component_id")
    out = out.unionAll(all_.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


@query("op12_minhash_dedup", SQL)
def op12(spark, d) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"))
