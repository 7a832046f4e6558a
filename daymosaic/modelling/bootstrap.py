"""Paired bootstrap with replicates as vectors.

A replicate gives each row a Poisson(1) weight drawn from a hash of (seed, row key, replicate), the same for all models and
groups, so there is no random state, a lost task redraws the same weights, and resampling agrees with drawing as many rows with
replacement up to Monte-Carlo error.

Rows are never multiplied by the replicates. Each row is sent once for each model and group it is in, to a block of scores that
lie together, and a block draws its rows' weights for all replicates, as many at a time as fit. Blocks report vectors of sums;
running sums over the blocks give each block its offsets; and a block with its offsets reports its share of every replicate's
average precision. So what is shuffled is the rows, whatever the number of replicates, and some vectors for each block.

A crowded score, one that many rows tie on, is a block of its own. Its sums are all that average precision needs, so its rows draw
once; and where all groups have many rows on it, the sums of the groups are added up for the pooled one, which draws none.

Such rows need not lie together by score. Where a task gets enough rows of each score, rows are dealt out once for all models, draw once
for all of them, and add the same weights to a sum of each model; the sums of the tasks are then added up by score.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.operators.running import logit_position, percentiles, running_totals
from daymosaic.session import materialise

POOLED = "POOLED"
#: Rows of a block, replicates whose weights are drawn at a time, and replicates that travel in one vector.
BLOCK, AT_ONCE, VECTOR = 16_384, 128, 512
#: Rows on one score, for each group that has it, from which on the score is a block of its own; rows that draw at a time.
CROWD, SLICE = 64, 2_048
#: Rows of a task that draws for all models, least and most; tasks to aim at between the two; rows of one score in each such task.
SHARE, TASKS, SPREAD = (1 << 17, 1 << 21), 32, 16
#: Weights that a byte can add up.
DEEP = 16

GOLDEN, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def poisson_edges(bits: int = 32) -> list[int]:
    """The draws of ``bits`` bits from which on the weight is over 0, 1, 2 and so on."""
    edges, term, total, k = [], 0.36787944117144233, 0.0, 0
    while True:
        total, k = total + term, k + 1
        edge = int(total * 2 ** bits)
        if edge >= 2 ** bits or (edges and edge <= edges[-1]):
            return edges
        edges.append(edge)
        term /= k


EDGES = np.array(poisson_edges(), dtype=np.uint32)
#: Edges that all draws are compared with; one draw in 1,600 is over the last of them.
COMMON = 6
LANES = np.uint64(0x00FF00FF00FF00FF)


class Room:
    """Arrays that draws are made in, used again and again: fresh ones cost as much as the draws."""

    def __init__(self, size: int = 0):
        self.x, self.high, self.over = np.empty(size, np.uint64), np.empty(size, np.uint64), np.empty(2 * size, bool)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if size > len(self.x):
            self.__init__(size)
        return self.x[:size], self.high[:size], self.over[:2 * size]


def draw(hashes: np.ndarray, steps: np.ndarray, out: np.ndarray, room: Room) -> None:
    """Write the weights of each row's pairs of replicates, a multiple of four pairs in all, to the bytes of ``out``.

    One 64-bit hash of the row and a pair of replicates gives both their draws.
    """
    x, high, over = room.of(len(hashes) * len(steps))
    np.add(steps, hashes[:, None], out=x.reshape(len(hashes), -1))
    for shift, mix in ((30, MIX_A), (27, MIX_B), (31, None)):
        np.right_shift(x, np.uint64(shift), out=high)
        np.bitwise_xor(x, high, out=x)
        if mix is not None:
            np.multiply(x, mix, out=x)
    u, w = x.astype("<u8", copy=False).view("<u4"), out.reshape(-1)
    np.greater_equal(u, EDGES[0], out=w.view(bool))
    for edge in EDGES[1:COMMON]:
        np.greater_equal(u, edge, out=over)
        np.add(w, over.view(np.uint8), out=w)
    # the few draws over the last of these edges are looked up among the others, with the seven beside them
    at = np.flatnonzero(over.view(np.uint64) != 0)
    w.reshape(-1, 8)[at] += np.searchsorted(EDGES[COMMON:], u.reshape(-1, 8)[at], side="right").astype(np.uint8)


def steps_of(first: int, pairs: int) -> np.ndarray:
    return np.arange(first // 2 + 1, first // 2 + 1 + pairs, dtype=np.uint64) * GOLDEN


def weights(hashes: np.ndarray, first: int, last: int, room: Room | None = None) -> np.ndarray:
    """(rows, replicates) weights of the replicates first to last - 1; replicate 0 weighs every row once."""
    steps = steps_of(first, -(-((last + 1) // 2 - first // 2) // 4) * 4)
    w = np.empty((len(hashes), 2 * len(steps)), dtype=np.uint8)
    draw(hashes.astype(np.uint64, copy=False), steps, w, room or Room())
    if first == 0:
        w[:, 0] = 1
    return w if w.shape[1] == last - first else np.ascontiguousarray(w[:, first % 2:first % 2 + last - first])


def lane_sums(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(segments, bytes) sums of the bytes of each column of words from each start to the next, in 16 bits."""
    sums = np.empty((len(starts), words.shape[1] * 8), dtype=np.uint16)
    sums[:, ::2] = np.add.reduceat(words & LANES, starts, axis=0).view("<u2")
    sums[:, 1::2] = np.add.reduceat((words >> np.uint64(8)) & LANES, starts, axis=0).view("<u2")
    return sums


def segment_sums(hashes: np.ndarray, starts: np.ndarray, first: int, last: int, room: Room | None = None) -> np.ndarray:
    """(segments, replicates) sums of the weights of the rows from each start to the next.

    Bytes are added as 16-bit lanes of 64-bit words; SLICE rows of the largest weight stay below 2**16.
    """
    out, room = np.zeros((len(starts), last - first), dtype=np.int32), room or Room()
    for i in range(0, len(hashes), SLICE):
        w = weights(hashes[i:i + SLICE], first, last, room)
        words = np.pad(w, ((0, 0), (0, -w.shape[1] % 8))).view("<u8") if w.shape[1] % 8 else w.view("<u8")
        a, b = np.searchsorted(starts, i, side="right") - 1, np.searchsorted(starts, i + len(w))
        out[a:b] += lane_sums(words, np.maximum(starts[a:b] - i, 0))[:, :last - first]
    return out


class Gather:
    """How the weights of a block of rows are summed up by a label: ``deep`` rows of a label are added in bytes, then in 16 bits.

    Rows are gathered so that those to be added lie ``deep`` halves apart; where a label has too few, a row of zeros takes the place.
    """

    def __init__(self, labels: np.ndarray, zeros: int):
        """Rows with a label below 0 are left out; the row at ``zeros`` has no weight."""
        order = np.argsort(labels, kind="stable")
        order = order[np.searchsorted(labels[order], 0):]
        self.labels, n = np.unique(labels[order], return_counts=True)
        self.deep = 1
        while len(n) and self.deep < DEEP and len(order) >= 1.5 * self.deep * len(n):
            self.deep *= 2
        sets = -(-n // self.deep)
        at = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        self.sets = int(sets.sum())
        rows = np.full((self.deep, self.sets), zeros, dtype=np.intp)
        rows[at % self.deep, np.repeat(np.cumsum(sets) - sets, n) + at // self.deep] = order
        self.rows = rows.reshape(-1)
        # 16 bits hold 256 sums of DEEP weights
        most = 256
        cuts = -(-sets // most)
        first = np.repeat(np.cumsum(sets) - sets, cuts)
        self.starts = first + most * (np.arange(len(first)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        self.again = np.cumsum(cuts) - cuts if len(first) > len(n) else None

    def sums(self, words: np.ndarray, room: np.ndarray) -> np.ndarray:
        """(labels, replicates) sums of the weights in ``words``, eight replicates each."""
        found = room[:len(self.rows)]
        np.take(words, self.rows, axis=0, out=found, mode="clip")
        deep = self.deep // 2
        while deep:
            half = deep * self.sets
            np.add(found[:half], found[half:2 * half], out=found[:half])
            deep //= 2
        sums = lane_sums(found[:self.sets], self.starts)
        return sums if self.again is None else np.add.reduceat(sums.astype(np.int32), self.again, axis=0)


def spans(replicates: int, size: int) -> Iterator[tuple[int, int]]:
    """Cuts of the replicates 0 (the point estimate) to ``replicates``."""
    for i in range(0, replicates + 1, size):
        yield i, min(i + size, replicates + 1)


VECTORS = ["pos", "neg", "tp", "fp"]
DEAL = ["_group", "model", "run", "block", "part", "pooled_run", "pooled_block"]
SUMS = ("`_group` string, model string, run bigint, block double, part int, pooled_run bigint, pooled_block double, chunk int, tie boolean, "
        + ", ".join(f"{v} array<int>" for v in VECTORS))


def _each(paired: DataFrame, group: str, row_key: Sequence[str], models: Mapping[str, tuple[str, str]], y: str, seed: int) -> DataFrame:
    """_own, y, h, model, pred, score: a row for each model."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(p).cast("int").alias("pred"), F.col(s).cast("double").alias("score"))
                               for m, (p, s) in models.items()])).alias("m")
    return paired.select(F.col(group).cast("string").alias("_own"), F.col(y).cast("int").alias("y"),
                         F.xxhash64(F.lit(seed), *[F.col(c) for c in row_key]).alias("h"), each).select("_own", "m.*", "y", "h")


def _long(paired: DataFrame, group: str, row_key: Sequence[str], models: Mapping[str, tuple[str, str]], y: str, seed: int) -> DataFrame:
    """_group, model, score, pred, y, h: a row for each model, in its own group and in the pooled one."""
    both = F.explode(F.array(F.col("_own"), F.lit(POOLED))).alias("_group")
    return _each(paired, group, row_key, models, y, seed).select(both, "model", "pred", "score", "y", "h")


def _counts(each: DataFrame) -> DataFrame:
    """Rows and judged ones by _group, model and score; the pooled ones are summed up from the groups'."""
    own = each.groupBy("_own", "model", "score").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("judged"))
    both = own.select(F.explode(F.array(F.col("_own"), F.lit(POOLED))).alias("_group"), "model", "score", "n", "judged")
    return both.groupBy("_group", "model", "score").agg(F.sum("n").alias("n"), F.sum("judged").alias("judged"))


def _plan(counts: DataFrame) -> DataFrame:
    """Scores with their block, which rises as the score falls, and the parts of a block of one crowded score.

    Blocks are in the order of (run, block): a run ends with a crowded score (``tie``). Where all groups share in a crowded score, its
    block in the pooled group is in pooled_run and pooled_block. A row without a truth counts inside its block alone, so with
    such rows, and with rows of no group, only scores that fill a block are crowded.
    """
    by = ["_group", "model"]
    score = Window.partitionBy("model", "score")
    pooled = lambda c: F.max(F.when(F.col("_group") == POOLED, F.col(c))).over(score)
    counts = materialise(counts.withColumn("crowd", pooled("n") >= F.lit(CROWD) * (F.count(F.lit(1)).over(score) - 1)), "score-counts")
    whole = counts.agg((F.min((F.col("n") == F.col("judged")) & F.col("_group").isNotNull())).alias("whole"))
    counts = counts.crossJoin(F.broadcast(whole)).withColumn("shared", F.col("whole") & F.col("crowd"))
    counts = counts.withColumn("tie", (F.col("shared") | (F.col("n") > BLOCK)).cast("bigint"))
    run = running_totals(counts, by, F.col("score").desc(), logit_position(F.col("score"), descending=True), ["n", "tie"])
    before, tie = F.col("cum_n") - F.col("n"), F.col("tie") == 1
    plan = run.select(*by, "score", "n", "shared", tie.alias("tie"), (F.col("cum_tie") - F.col("tie")).alias("run"),
                      F.when(tie, before + 0.5).otherwise(F.floor(before / BLOCK) * BLOCK).cast("double").alias("block"),
                      F.when(tie, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int").alias("parts"))
    return plan.withColumns({f"pooled_{c}": F.when(F.col("shared"), pooled(c)) for c in ("run", "block")}).drop("shared")


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    rows = rows.join(plan.drop("n"), ["_group", "model", "score"])
    return rows.withColumn("part", F.pmod(F.xxhash64("h", F.lit(7)), "parts").cast("int")).drop("parts")


def _planned(rows: DataFrame) -> DataFrame:
    """Rows with their block and their part of it (see ``_plan``)."""
    return _placed(rows, _plan(rows.groupBy("_group", "model", "score").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("judged"))))


def _cells(plan: DataFrame, models: Sequence[str]) -> tuple[DataFrame, DataFrame, int, int]:
    """Crowded scores of a group whose rows can draw for all models at once, with a number for each (``cell``); the groups' places;
    the rows of a task; and the tasks.

    Rows are dealt to tasks in an order of groups, so that small groups share a task and a large one spreads over several. A score
    is a cell where SPREAD of its rows come to each task of its group.
    """
    shared = plan.filter(F.col("pooled_block").isNotNull() & (F.col("_group") != POOLED))
    groups = materialise(plan.join(shared.select("_group").distinct(), "_group").groupBy("_group").agg(
        F.ceil(F.sum("n") / len(models)).cast("bigint").alias("rows"), F.lit(1).cast("bigint").alias("one")), "group-rows")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    share = min(max(total // TASKS, SHARE[0]), SHARE[1])
    spot = F.xxhash64("_group")
    run = running_totals(groups, [], spot, spot / F.lit(2.0 ** 64) + 0.5, ["rows", "one"])
    start, last = F.col("cum_rows") - F.col("rows"), F.col("cum_rows") - 1
    tasks = F.floor(last / F.lit(share)) - F.floor(start / F.lit(share)) + 1
    places = materialise(run.select("_group", "rows", start.alias("start"), tasks.alias("tasks"), (F.col("cum_one") - 1).alias("number")),
                         "group-places")
    model = F.lit(0)
    for i, m in enumerate(models):
        model = F.when(F.col("model") == m, i).otherwise(model)
    cells = shared.join(places, "_group").filter(F.col("n") >= F.lit(SPREAD) * F.col("tasks")).select(
        "_group", "model", "score", ((F.col("number") * len(models) + model) * F.lit(2 ** 32) + F.col("run")).alias("cell"),
        "run", "block", "pooled_run", "pooled_block")
    return materialise(cells, "cells"), places.select("_group", "rows", "start"), share, -(-total // share)


def _dealt(paired: DataFrame, group: str, row_key: Sequence[str], models: Mapping[str, tuple[str, str]], y: str, seed: int,
           cells: DataFrame, places: DataFrame, share: int) -> DataFrame:
    """task, h, label_0, label_1 and so on: rows once, with the sum that they count in for each model, or -1."""
    held = [(F.col(p).cast("int").alias(f"pred_{i}"), F.col(s).cast("double").alias(f"score_{i}")) for i, (p, s) in enumerate(models.values())]
    rows = paired.select(F.col(group).cast("string").alias("_group"), F.col(y).cast("int").alias("y"),
                         F.xxhash64(F.lit(seed), *[F.col(c) for c in row_key]).alias("h"), *[c for pair in held for c in pair])
    rows = rows.join(places, "_group")
    for i, m in enumerate(models):
        of = cells.filter(F.col("model") == m).select("_group", F.col("score").alias(f"score_{i}"), F.col("cell").alias(f"cell_{i}"))
        rows = rows.join(of, ["_group", f"score_{i}"], "left")
    said = lambda i: F.when(F.col(f"pred_{i}") == 1, 0).otherwise(1)
    kind = lambda i: F.when(F.col("y") == 1, said(i)).when(F.col("y") == 0, said(i) + 2).otherwise(4)
    place = F.col("start") + F.pmod(F.xxhash64("h", F.lit(7)), "rows")
    labels = [F.coalesce(F.col(f"cell_{i}") * 8 + kind(i), F.lit(-1)).alias(f"label_{i}") for i in range(len(models))]
    some = F.coalesce(*[F.col(f"cell_{i}") for i in range(len(models))]).isNotNull()
    return rows.filter(some).select(F.floor(place / F.lit(share)).cast("int").alias("task"), "h", *labels)


def _together(replicates: int, models: int):
    """Rows that draw once and add their weights to a sum for each model; a sum travels as the planes of its bytes."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        h, keys, labels = t.column("h").to_numpy().view(np.uint64), [], []
        for i in range(models):
            own, at = np.unique(t.column(f"label_{i}").to_numpy(), return_inverse=True)
            none = int(own[0] < 0)
            before = sum(map(len, keys))
            labels.append(np.where(at >= none, at - none + before, -1).astype(np.int32))
            keys.append(own[none:])
        del t, held
        order = np.argsort(labels[max(range(models), key=lambda i: len(keys[i]))], kind="stable")
        h, labels, keys = h[order], [x[order] for x in labels], np.concatenate(keys)
        blocks = [(h[i:i + BLOCK], [Gather(x[i:i + BLOCK], min(BLOCK, len(h) - i)) for x in labels]) for i in range(0, len(h), BLOCK)]
        room, most = Room(), max(len(g.rows) for _, gathers in blocks for g in gathers)
        for chunk, (a, b) in enumerate(spans(replicates, VECTOR)):
            out = np.empty((len(keys), b - a), dtype=np.int32)
            for i in range(a, b, AT_ONCE):
                # pairs begin at an even replicate, words hold eight
                first, last = i - i % 2, min(i + AT_ONCE, b)
                width = -(-(last - first) // 8) * 8
                w, n = np.empty((min(BLOCK, len(h)) + 1, width), dtype=np.uint8), np.zeros((len(keys), width), dtype=np.int32)
                steps, found = steps_of(first, width // 2), np.empty((most, width // 8), dtype=np.uint64)
                for rows, gathers in blocks:
                    for k in range(0, len(rows), SLICE):
                        draw(rows[k:k + SLICE], steps, w[k:min(k + SLICE, len(rows))], room)
                    if first == 0:
                        w[:, 0] = 1
                    w[len(rows)] = 0
                    for g in gathers:
                        if len(g.labels):
                            n[g.labels] += g.sums(w.view(np.uint64), found)
                out[:, i - a:last - a] = n[:, i - first:last - first]
            planes = max(1, -(-int(out.max()).bit_length() // 8))
            flat = np.ascontiguousarray(out.astype("<i4", copy=False).view(np.uint8).reshape(*out.shape, 4)[:, :, :planes].transpose(0, 2, 1))
            size = planes * (b - a)
            for i in range(0, len(keys), 4_096):
                some = keys[i:i + 4_096]
                ends = np.arange(len(some) + 1, dtype=np.int32) * size
                data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(flat[i:i + 4_096])])
                yield pa.RecordBatch.from_arrays([pa.array(some >> 3), pa.array((some & 7).astype(np.int32)),
                                                  pa.array(np.full(len(some), chunk, dtype=np.int32)), data], names=["cell", "kind", "chunk", "sums"])
    return run


ADDED = "cell bigint, chunk int, " + ", ".join(f"{v} array<int>" for v in VECTORS)


def _added(replicates: int):
    """The sums of a cell from all tasks, which follow each other."""
    def run(batches):
        key = total = None
        names, kinds = ["cell", "chunk", *VECTORS], [pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 4]

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

        def vectors():
            tp, missed, fp, others = total[:4]
            return (*key, tp + missed, fp + others, tp, fp)
        out = []
        for b in batches:
            plain = zip(*(b.column(c).to_pylist() for c in ("cell", "kind", "chunk")))
            for (cell, kind, chunk), sums in zip(plain, b.column("sums")):
                if (cell, chunk) != key:
                    if key is not None:
                        out.append(vectors())
                    width = min(VECTOR, replicates + 1 - chunk * VECTOR)
                    key, total = (cell, chunk), np.zeros((5, width), dtype=np.int32)
                    if len(out) >= 512:
                        yield table(out)
                        out = []
                for i, plane in enumerate(np.frombuffer(sums.as_buffer(), dtype=np.uint8).reshape(-1, total.shape[1])):
                    total[kind] += plane.astype(np.int32) << (8 * i)
        if key is not None:
            yield table([*out, vectors()])
    return run


def _sums(replicates: int):
    def run(key, t):
        y, said, h = (t.column(c).to_numpy() for c in ("y", "pred", "h"))
        kind = np.where(y == 1, 0, np.where(y == 0, 2, 4)) + (said != 1)
        order = np.argsort(kind, kind="stable")[:np.count_nonzero(kind < 4)]
        kinds, starts = np.unique(kind[order], return_index=True)
        h, tie, out, room = h[order].view(np.uint64), t.column("tie")[0].as_py(), [], Room()
        step = AT_ONCE * max(1, SLICE // max(1, len(h)))
        for chunk, (a, b) in enumerate(spans(replicates, VECTOR)):
            n = np.zeros((4, b - a), dtype=np.int32)
            for i in range(a, b, step):
                n[kinds, i - a:i - a + step] = segment_sums(h, starts, i, min(i + step, b), room)
            tp, missed, fp, _ = n
            out.append([*(k.as_py() for k in key), chunk, tie, tp + missed, n[2] + n[3], tp, fp])
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.bool_(),
                 *[pa.list_(pa.int32())] * 4]
        return pa.table({n: pa.array(list(c), k) for n, k, c in zip([*DEAL, "chunk", "tie", *VECTORS], kinds, zip(*out))})
    return run


OFFSETS = ("`_group` string, model string, chunk int, run bigint, block double, cum_pos array<double>, cum_neg array<double>, "
           "pos array<double>, gain array<double>, f1 array<double>")


def _offsets(sums: DataFrame) -> DataFrame:
    """For each block but crowded scores what its replicates sum up to before it, and for each group and model a last row (block
    NULL) with the sums of positives, the gain of the crowded scores, and F1."""
    def run(batches):
        key = at = tie = vec = total = None
        names = ["_group", "model", "chunk", "run", "block", "cum_pos", "cum_neg", "pos", "gain", "f1"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 5]

        def close_block():
            before = total["pos"], total["neg"]
            for v in VECTORS:
                total[v] = total[v] + vec[v]
            if not tie:
                return [(*key, *at, *before, None, None, None)]
            share = total["pos"] + total["neg"]
            total["gain"] = total["gain"] + np.divide(vec["pos"] * total["pos"], share, out=np.zeros_like(share), where=share > 0)
            return []

        def last_row():
            twice = 2 * total["tp"]
            below = twice + total["fp"] + (total["pos"] - total["tp"])
            f1 = np.divide(twice, below, out=np.zeros_like(below), where=below > 0)
            return [(*key, None, None, None, None, total["pos"], total["gain"], f1)]

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)
        for b in batches:
            flat = {v: (b.column(v).offsets.to_numpy(), b.column(v).values.to_numpy()) for v in VECTORS}
            plain = (b.column(c).to_pylist() for c in ("_group", "model", "chunk", "run", "block", "tie"))
            for i, (g, m, c, r, block, tied) in enumerate(zip(*plain)):
                new = {v: x[ends[i]:ends[i + 1]].astype(np.float64) for v, (ends, x) in flat.items()}
                out = []
                if key is not None and ((g, m, c), (r, block)) != (key, at):
                    out += close_block()
                    vec = None
                if (g, m, c) != key:
                    if key is not None:
                        out += last_row()
                    key, total = (g, m, c), {v: np.zeros(len(new["pos"])) for v in (*VECTORS, "gain")}
                vec = {v: vec[v] + new[v] for v in VECTORS} if vec else new
                at, tie = (r, block), tied
                if out:
                    yield table(out)
        if key is not None:
            yield table(close_block() + last_row())

    by = ["_group", "model", "chunk"]
    shared = sums.filter(F.col("pooled_block").isNotNull()).withColumns(
        {"_group": F.lit(POOLED), "run": F.col("pooled_run"), "block": F.col("pooled_block")})
    vectors = sums.unionByName(shared).drop("pooled_run", "pooled_block")
    return vectors.repartition(*by).sortWithinPartitions(*by, "run", "block", "part").mapInArrow(run, OFFSETS)


GAINS = "`_group` string, model string, chunk int, gain array<double>"


def _gains(replicates: int):
    def run(key, rows, offsets):
        offsets = offsets.sort_by("chunk")
        before = {c: np.concatenate([np.array(x) for x in offsets.column(c).to_pylist()]) for c in ("cum_pos", "cum_neg")}
        score, y, h = (rows.column(c).to_numpy() for c in ("score", "y", "h"))
        order = np.lexsort((y == 1, -score))  # the positives of a score come last
        score, hit, h = score[order], (y == 1)[order], h[order].view(np.uint64)
        # a segment is the positives of one score, or all other rows between two of them
        starts = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1]) | (hit[1:] & (score[1:] != score[:-1]))))
        hit = hit[starts]
        gain, room = np.zeros(replicates + 1), Room()
        for a, b in spans(replicates, AT_ONCE) if hit.any() else ():
            n = segment_sums(h, starts, a, b, room)
            both = np.cumsum(n, axis=0)[hit] + (before["cum_pos"] + before["cum_neg"])[a:b]
            own = n[hit]
            pos = np.cumsum(own, axis=0) + before["cum_pos"][a:b]
            gain[a:b] = np.divide(own * pos, both, out=np.zeros(both.shape), where=both > 0).sum(axis=0)
        cuts = list(spans(replicates, VECTOR))
        g, m = key[0].as_py(), key[1].as_py()
        return pa.table({"_group": [g] * len(cuts), "model": [m] * len(cuts), "chunk": pa.array(range(len(cuts)), pa.int32()),
                         "gain": [gain[a:b] for a, b in cuts]})
    return run


def replicate_metrics(paired: DataFrame, group: str, row_key: Sequence[str], models: Mapping[str, tuple[str, str]], replicates: int,
                      seed: int, y: str = "y_true") -> DataFrame:
    """_group, model, replicate, f1, average_precision for every group and for all rows together (POOLED).

    ``models`` names the prediction and the score column of each model. Replicate 0 is the point estimate. Average
    precision is NULL in a replicate without positives.
    """
    by = ["_group", "model", "run", "block"]
    plan = materialise(_plan(_counts(_each(paired, group, row_key, models, y, seed))), "score-plan")
    cells, places, share, tasks = _cells(plan, list(models))
    # few bytes, but long work on each: an explicit count keeps the tasks apart
    many = 4 * int(paired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, rows = [], None
    if not cells.isEmpty():
        dealt = _dealt(paired, group, row_key, models, y, seed, cells, places, share)
        sent = dealt.repartitionById(tasks, "task").drop("task").mapInArrow(_together(replicates, len(models)),
                                                                            "cell bigint, kind int, chunk int, sums binary")
        added = sent.repartition(many, "cell", "chunk").sortWithinPartitions("cell", "chunk").mapInArrow(_added(replicates), ADDED)
        parts.append(added.join(cells, "cell").select(*by, F.lit(0).alias("part"), "pooled_run", "pooled_block", "chunk",
                                                      F.lit(True).alias("tie"), *VECTORS))
    # the scores that draw by themselves; shared ones of the pooled group never do
    drawn = (F.col("_group") != POOLED) | F.col("pooled_block").isNull()
    apart = plan.filter(drawn).join(cells, ["_group", "model", "score"], "left_anti")
    if not parts or not apart.isEmpty():
        rows = materialise(_placed(_long(paired, group, row_key, models, y, seed), apart), "bootstrap-rows")
        parts.append(rows.repartition(many, *DEAL).groupBy(*DEAL).applyInArrow(_sums(replicates), SUMS))
    sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sums = materialise(sums, "bootstrap-sums")
    offsets = materialise(_offsets(sums), "bootstrap-offsets")
    ends = offsets.filter(F.col("block").isNull())
    gains = ends.select("_group", "model", "chunk", "gain")
    if rows is not None:
        gains = rows.filter(~F.col("tie")).groupBy(*by).cogroup(offsets.filter(F.col("block").isNotNull()).groupBy(*by)).applyInArrow(
            _gains(replicates), GAINS).unionByName(gains)
    each = gains.select("_group", "model", "chunk", F.posexplode("gain").alias("i", "gain")).groupBy("_group", "model", "chunk", "i").agg(
        F.sum("gain").alias("gain"))
    ends = ends.select("_group", "model", "chunk", F.posexplode(F.arrays_zip("pos", "f1")).alias("i", "x")).select(
        "_group", "model", "chunk", "i", "x.pos", "x.f1")
    ap = F.when(F.col("pos") > 0, F.col("gain") / F.col("pos"))
    return each.join(ends, ["_group", "model", "chunk", "i"]).select(
        "_group", "model", (F.col("chunk") * VECTOR + F.col("i")).alias("replicate"), "f1", ap.alias("average_precision"))


def paired_bootstrap(paired: DataFrame, group: str, row_key: Sequence[str], models: Mapping[str, tuple[str, str]],
                     comparisons: Sequence[tuple[str, str]], replicates: int = 10_000, seed: int = 11, alpha: float = 0.05,
                     y: str = "y_true") -> DataFrame:
    """Percentile intervals of candidate minus reference, for F1 and average precision, by group and over all rows.

    Columns: the group (POOLED for all rows), reference, candidate, metric, both point estimates, difference, ci_lower,
    ci_upper, valid_replicates, rows, positives. All comparisons share the draws.
    """
    each = materialise(replicate_metrics(paired, group, row_key, models, replicates, seed, y), "bootstrap-metrics")
    pick = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c)))
    pairs = F.array(*[F.struct(F.lit(a).alias("reference"), F.lit(b).alias("candidate"), F.lit(c).alias("metric"),
                               pick(c, a).alias("reference_point"), pick(c, b).alias("candidate_point"))
                      for a, b in comparisons for c in ("f1", "average_precision")])
    wide = each.groupBy("_group", "replicate").agg(pairs.alias("p"))
    deltas = wide.select("_group", "replicate", F.explode("p").alias("p")).select("_group", "replicate", "p.*").withColumn(
        "delta", F.col("candidate_point") - F.col("reference_point"))
    deltas = materialise(deltas, "bootstrap-deltas")
    key = ["_group", "reference", "candidate", "metric"]
    drawn = deltas.filter((F.col("replicate") > 0) & F.col("delta").isNotNull())
    ci = percentiles(drawn, key, "delta", [alpha / 2, 1 - alpha / 2], prefix="q")
    low, high = [c for c in ci.columns if c not in key]
    valid = drawn.groupBy(*key).agg(F.count(F.lit(1)).alias("valid_replicates"))
    rows = paired.groupBy(F.col(group).cast("string").alias("_own")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(y).cast("bigint")).alias("positives"))
    rows = rows.select(F.explode(F.array(F.col("_own"), F.lit(POOLED))).alias("_group"), "rows", "positives").groupBy("_group").agg(
        F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))
    out = deltas.filter("replicate = 0").join(ci, key).join(valid, key).join(rows, "_group")
    return out.select(F.col("_group").alias(group), *key[1:], "reference_point", "candidate_point", F.col("delta").alias("difference"),
                      F.col(low).alias("ci_lower"), F.col(high).alias("ci_upper"), "valid_replicates", "rows", "positives")
