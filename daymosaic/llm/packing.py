"""Best-fit packing of token pieces into sequences by bin completion.

Pieces of one length are interchangeable, so packing works on the histogram of lengths, which has at most ``capacity`` rows
for any number of documents. Branch and bound on it: the largest remaining piece is completed by fillings that no other
filling dominates, least waste first; a branch ends when its waste exceeds what beating the incumbent allows. The first
incumbent is best-fit decreasing. A filling is used for as many sequences at once as the counts allow, so the plan has a few
thousand steps and not one for each sequence. Every document then finds its place from its rank within its length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.llm.base import batch, id_text, materialise, query, slices, table

CAPACITY = 2048
END = 0
#: Branch-and-bound nodes tried after the first descent; more effort, never other rows.
NODES = 400
#: Steps of the search for fillings at one node, and at all nodes. Where they run out, the first filling found serves.
STEPS, ALL_STEPS = 1000, 300_000
RUN = re.compile(r"\S{1000}|\s{200}")

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces that cannot share with long ones."""
    lengths = np.array(sorted(hist), dtype=np.int64)
    n = np.array([hist[x] for x in lengths], dtype=object)
    best = -(-int((lengths * n).sum()) // capacity) if len(lengths) else 0
    half = lengths > capacity // 2
    for k in {int(x) for x in lengths[lengths <= capacity // 2]} | {0}:
        big = lengths > capacity - k
        mid = half & ~big
        low = (lengths >= k) & ~half
        rest = int((lengths * n)[low].sum()) - (capacity * int(n[mid].sum()) - int((lengths * n)[mid].sum()))
        best = max(best, int(n[big].sum()) + int(n[mid].sum()) + max(0, -(-rest // capacity)))
    return best


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over classes of equal sequences."""
    room: dict[int, list[tuple[Filling, int]]] = {capacity: []}
    for l in sorted(hist, reverse=True):
        left = hist[l]
        while left:
            r = min((x for x, g in room.items() if x >= l and g), default=capacity)
            filling, m = room[r].pop() if room[r] else ((), left)
            k = min(r // l, left)
            full = min(m, left // k)
            if m > full and filling:
                room[r].append((filling, m - full))
            room.setdefault(r - k * l, []).append((filling + ((l, k),), full))
            left -= full * k
    return [(f, m) for g in room.values() for f, m in g if f]


def suffixes(lengths: list[int], counts: dict[int, int], r: int) -> list[int]:
    """Bit s of entry i: some pieces among lengths[i:] sum to s, at most r."""
    mask, out = (1 << (r + 1)) - 1, [1]
    for l in reversed(lengths):
        bits, n, step = out[-1], min(counts[l], r // l), 1
        while n:
            step = min(step, n)
            bits |= (bits << (l * step)) & mask
            n -= step
            step *= 2
        out.append(bits)
    return out[::-1]


def dominated(filling: list[tuple[int, int]], counts: dict[int, int], waste: int) -> bool:
    """Whether a larger unused piece could replace one of the filling, or one piece two of equal sum."""
    used = dict(filling)
    free = {l for l, n in counts.items() if n > used.get(l, 0)}
    if any(l <= waste for l in free):
        return True
    if waste and any(x + d in free for x in used for d in range(1, waste + 1)):
        return True
    xs = [x for x, k in filling for _ in range(min(k, 2))]
    return any(a + b in free for i, a in enumerate(xs) for b in xs[i + 1:])


def fillings(counts: dict[int, int], r: int, slack: int, left_over: list[int]) -> Iterator[tuple[Filling, int]]:
    """Undominated fillings of room r with their waste, which is at most ``slack``; the least waste first.

    ``left_over`` holds the steps that are left for all nodes.
    """
    if counts.get(r):
        yield ((r, 1),), 0
        return  # one piece that fills the room dominates every other filling
    have = np.zeros(r + 1, dtype=bool)
    lengths = sorted((l for l, n in counts.items() if n and l <= r), reverse=True)
    have[lengths] = True
    pairs = np.nonzero(have & have[::-1])[0]
    seen = set()
    for b in pairs[pairs * 2 <= r]:  # the most even split last: long pieces are placed first
        a = r - int(b)
        if a != b or counts[a] > 1:
            f = ((a, 1), (int(b), 1)) if a != b else ((a, 2),)
            seen.add(f)
            yield f, 0
    reach, steps, spare = suffixes(lengths, counts, r), STEPS, None
    for waste in range(min(slack, r) + 1):
        if not reach[0] >> (r - waste) & 1:
            continue
        stack = [(0, r - waste, ())]
        while stack:
            i, left, chosen = stack.pop()
            steps -= 1
            left_over[0] -= 1
            if steps < 0 or left_over[0] < 0 and steps < STEPS - 50:
                if spare and not seen:
                    yield spare
                return
            if not left:
                if chosen not in seen:
                    if dominated(list(chosen), counts, waste):
                        spare = spare or (chosen, waste)
                    else:
                        seen.add(chosen)
                        yield chosen, waste
                continue
            if i == len(lengths) or not reach[i] >> left & 1:
                continue
            l = lengths[i]
            top = min(counts[l], left // l)
            stack += [(i + 1, left - k * l, chosen + (((l, k),) if k else ())) for k in range(top + 1)]


def complete(hist: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """(filling, how many sequences) for all pieces of a histogram: the fewest sequences found."""
    left_over = [ALL_STEPS]
    hist = {l: n for l, n in hist.items() if n}
    best = best_fit(hist, capacity)
    upper, lower = sum(m for _, m in best), lower_bound(hist, capacity)
    total = sum(l * n for l, n in hist.items())
    if upper == lower:
        return best

    def expand(counts, spent):
        """Ways to fill the next sequences: (fillings, counts after, waste after)."""
        l = max(counts)
        if sum(x * n for x, n in counts.items()) <= capacity:
            yield tuple(sorted(counts.items(), reverse=True)), 1, {}, spent  # the last one; its room is not waste
            return
        slack = (upper - 1) * capacity - total - spent
        rest = dict(counts)
        rest[l] -= 1
        if not rest[l]:
            del rest[l]
        for f, waste in fillings(rest, capacity - l, max(0, min(slack, capacity)), left_over):
            whole = Counter(dict(f))
            whole[l] += 1
            m = min(counts[x] // k for x, k in whole.items())
            if waste:
                m = min(m, max(1, slack // waste))
            after = {x: n - m * whole[x] for x, n in counts.items() if n > m * whole[x]}
            yield tuple(sorted(whole.items(), reverse=True)), m, after, spent + m * waste

    path: list[tuple[Filling, int]] = []
    stack = [expand(hist, 0)]
    fails, ended = 0, False
    while stack and upper > lower and fails <= nodes and (left_over[0] > 0 or not ended):
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                path.pop()
            fails += 1
            continue
        filling, m, after, spent = step
        if spent > (upper - 1) * capacity - total:
            fails += 1
            continue
        path.append((filling, m))
        if after:
            stack.append(expand(after, spent))
            continue
        if (n := sum(k for _, k in path)) < upper:
            best, upper = list(path), n
        path.pop()
        fails, ended = fails + 1, True
    return best


def intervals(plan: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of it, offset): pieces of a length take consecutive ranks of each row."""
    rank, seq, out = Counter(), 0, []
    for filling, m in plan:
        at = 0
        for l, k in filling:
            for _ in range(k):
                out.append((l, rank[l], seq, at))
                rank[l] += m
                at += l
        seq += m
    return np.array(out, dtype=np.int64).reshape(-1, 4)


class Encoder:
    """Ids of whole texts as little-endian bytes.

    ``path`` is read by tokenizers. Where ``ranks`` and ``pattern`` give the same vocabulary for tiktoken, which is three
    times as quick, ordinary texts go there; texts that hold a special token's string or a very long run stay with tokenizers.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as lines:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("quick", pat_str=pattern, mergeable_ranks=table_, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.quick and not RUN.search(text) and not any(s in text for s in self.special):
            return array("I", self.quick(text)).tobytes()
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]


def pieces(docs: DataFrame, tokenizer: tuple[str, ...], capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and if asked their ids.

    ``part`` and ``nth`` number the pieces of one length within the task that made them. A null text is empty and has the
    end id alone; null ids and repeated rows are kept as they come; other columns are not read.
    """
    def run(batches):
        encoder, seen, part = Encoder(*tokenizer), Counter(), TaskContext.get().partitionId()
        fields = PIECE + [("ids", pa.list_(pa.int32()))] * with_ids
        for b in slices(batches, 256):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), map(encoder.encode, b.column("text").to_pylist())):
                ids += END.to_bytes(4, "little")
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = min(n, capacity) if at or n <= capacity or n % capacity == 0 else n % capacity
                    cut = ids[4 * at:4 * (at + size)]
                    rows.append((doc, k, at, size, zlib.crc32(cut), part, seen[size])
                                + ((np.frombuffer(cut, dtype="<i4"),) if with_ids else ()))
                    seen[size] += 1
                    at, k = at + size, k + 1
            yield batch(fields, *map(list, zip(*rows))) if rows else batch(fields)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    return id_text(docs, id_col, text_col).mapInArrow(run, kinds + ", ids array<int>" * with_ids)


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to stored ``pieces``.

    The driver sees one row for each length. Ranks are a prefix sum over the tasks' counts, so no length, however
    frequent, is gathered in one task.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table_ = spark.sparkContext.broadcast(intervals(complete(hist, capacity, nodes)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    rest = [c for c in cut.columns if c not in ("part", "nth")]

    def run(batches):
        rows = table_.value
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        starts = {int(l): (int(i), int(j)) for l, i, j in zip(*_runs(rows[:, 0]))}
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for l in np.unique(length):
                i, j = starts[int(l)]
                at = length == l
                k = i + np.searchsorted(rows[i:j, 1], rank[at], side="right") - 1
                seq[at], off[at] = rows[k, 2] + rank[at] - rows[k, 1], rows[k, 3]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(seq), pa.array(off)],
                                             names=[*rest, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.select(rest).dtypes)
    return ranked.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def _runs(sorted_values: np.ndarray):
    values, first = np.unique(sorted_values, return_index=True)
    return values, first, np.append(first[1:], len(sorted_values))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids from packed pieces that carry theirs; at most ``capacity`` pieces meet."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def best_fit_pack(docs: DataFrame, tokenizer: tuple[str, ...] | None = None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """Cut and pack whole documents; the pieces are stored once in the shared folder.

    ``tokenizer`` holds the arguments of ``Encoder``."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                     public_tokenizers.PATTERN)
    return pack(materialise(pieces(docs, tokenizer, capacity, **columns), "pieces"), capacity)


@query("op6_best_fit_packing")
def op6(spark, d) -> DataFrame:
    return best_fit_pack(table(spark, d, "documents"))
