"""Hidden Markov language model: Baum-Welch counts aggregated across partitions, exact likelihood by scaled forward recursion.

States emit one of the most frequent words, the end, or a class of words; a word of a class then has its add-one share of the
class, with one share for words never seen. So a text's probability is the chain's, times those shares. Words beyond the most
frequent ones that still occur LEAST times are dealt to hashed classes, so each of them counts towards its states; one more class
holds the rare and unseen words. The chain's tables have a fixed size and are broadcast, with a bitmap that says which words have a
hashed class; counts of words in classes stay a table and are joined.

Training sequences are texts cut into segments, and every round reads all of them. Scoring runs over whole texts, however long.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import batch, id_bytes, materialise, query, slices, table
from daymosaic.llm.substrings import FILTER_BITS, bit_filter, has

#: Words with their own emission; hashed classes of other words; states; words of a training segment.
SYMBOLS, HASHED, STATES, SEGMENT = 131_072, 131_072, 8, 128
#: Rounds over the training texts. Segments that the start values are drawn from (a bound for these alone).
ROUNDS, STARTS = 3, 4_000
#: Distinct words that a task counts before it sends them, and words in classes whose symbols it remembers.
HELD, KNOWN = 500_000, 300_000
#: Rarer training words share one class.
LEAST = 5


@dataclass
class Model:
    """Symbol 0 is the end, 1 to m words, m + 1 the class of rare words, and the hashed classes follow if there are any."""

    words: list[bytes]
    counts: np.ndarray      # training counts of symbols 0 to m
    total: int              # N, training tokens
    distinct: int           # V, distinct training tokens
    hashed: tuple[np.ndarray, int] | None = None  # bitmap of the words that have a hashed class, and its bits
    classes: np.ndarray = None  # (training tokens, distinct words) of the classes
    start: np.ndarray = None
    later: np.ndarray = None
    move: np.ndarray = None
    emit: np.ndarray = None  # symbols x states

    @property
    def other(self) -> int:
        return len(self.words) + 1

    @property
    def symbols(self) -> int:
        return self.other + 1 + (HASHED if self.hashed else 0)

    def corpus(self) -> np.ndarray:
        """Add-one shares of the symbols; each class has one unit for words never seen."""
        n = np.concatenate([self.counts, self.classes[:, 0] + 1]).astype(np.float64)
        return n / n.sum()

    def class_of(self, hashes: np.ndarray) -> np.ndarray:
        """The class of words without an emission of their own, 0 for the rare ones, from their hashes."""
        if self.hashed is None:
            return np.zeros(len(hashes), dtype=np.int32)
        return np.where(has(*self.hashed, hashes), 1 + (hashes >> np.uint64(40)) % np.uint64(HASHED), 0).astype(np.int32)

    def codes(self, text: bytes, code: dict[bytes, int]) -> np.ndarray:
        """The text's symbols. ``code`` grows by the words met, and is emptied before it grows too large."""
        words = text.lower().split()
        new = set(words).difference(code)
        if new:
            if len(code) > len(self.words) + KNOWN:
                code.clear()
                code.update((w, i + 1) for i, w in enumerate(self.words))
                new = set(words).difference(code)
            new = list(new)
            at = self.class_of(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in new), dtype=np.uint64, count=len(new)))
            code.update(zip(new, (self.other + at).tolist()))
        return np.array([*map(code.__getitem__, words), 0], dtype=np.int32)


def training(texts: DataFrame) -> DataFrame:
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return texts.withColumn("held_out", rest == 2)


def word_counts(texts: DataFrame) -> DataFrame:
    def run(batches):
        n = Counter()
        fields = [("word", pa.binary()), ("n", pa.int64())]
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                n.update(t.lower().split())
            if len(n) > HELD:
                yield batch(fields, list(n), list(n.values()))
                n = Counter()
        yield batch(fields, list(n), list(n.values()))
    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def segments(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, lengths, is first) of the segments of texts, longest first."""
    cut = [(c[i:i + SEGMENT], i == 0) for c in codes for i in range(0, len(c), SEGMENT)]
    cut.sort(key=lambda x: -len(x[0]))
    lengths = np.array([len(c) for c, _ in cut])
    out = np.zeros((len(cut), SEGMENT), dtype=np.int32)
    for row, (c, _) in zip(out, cut):
        row[:len(c)] = c
    return out, lengths, np.array([f for _, f in cut])


class Counts:
    """Expected counts of one task."""

    def __init__(self, k: int, symbols: int):
        self.start, self.later = np.zeros(k), np.zeros(k)
        self.move, self.emit, self.log = np.zeros((k, k)), np.zeros((symbols, k)), 0.0

    def add(self, m: Model, codes: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> None:
        """One pass forward and back over a block of segments."""
        active = [int((lengths > t).sum()) for t in range(lengths[0])] if len(lengths) else []
        emit, move = m.emit.astype(np.float32), m.move.astype(np.float32)
        alphas, scales, es = [], [], []
        for t, n in enumerate(active):
            e = emit[codes[:n, t]]
            a = (np.where(first[:, None], m.start, m.later).astype(np.float32) if t == 0 else alphas[-1][:n] @ move) * e
            c = a.sum(axis=1, keepdims=True)
            alphas.append(a / c)
            scales.append(c)
            es.append(e)
            self.log += float(np.log(c.astype(np.float64)).sum())
        beta = np.zeros((0, len(m.start)), dtype=np.float32)
        gammas: list[np.ndarray] = [None] * len(active)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), beta.shape[1]), dtype=np.float32)])
            gammas[t] = alphas[t] * beta
            if t:
                w = es[t] * beta / scales[t]
                self.move += move * (alphas[t - 1][:n].T @ w)
                beta = w @ move.T
        if active:
            self.start += gammas[0][first].sum(axis=0)
            self.later += gammas[0][~first].sum(axis=0)
            flat = np.concatenate([codes[:n, t] for t, n in enumerate(active)])
            g = np.concatenate(gammas)
            seen, where = np.unique(flat, return_inverse=True)
            for k in range(g.shape[1]):
                self.emit[seen, k] += np.bincount(where, weights=g[:, k], minlength=len(seen))

    def rows(self) -> pa.RecordBatch:
        """Symbol counts by symbol; below zero the tables: moves, start, later, log."""
        k = len(self.start)
        seen = np.flatnonzero(self.emit.any(axis=1))
        extra = [*self.move, self.start, self.later, np.full(k, self.log)]
        keys = np.concatenate([seen, -1 - np.arange(len(extra))])
        values = np.concatenate([self.emit[seen], np.array(extra)])
        # a task's own sums in single precision, as the forward and backward passes are; they are added up in double
        return batch([("symbol", pa.int64())] + [(f"c{i}", pa.float32()) for i in range(k)], pa.array(keys),
                     *(pa.array(values[:, i].astype(np.float32)) for i in range(k)))


def baum_welch(encoded: DataFrame, m: Model) -> float:
    """One round over the partitions; updates the model and returns the training texts' log likelihood by segments."""
    k = len(m.start)
    sent = encoded.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        m = sent.value
        counts = Counts(k, m.symbols)
        for b in slices(batches, 512):
            cut, lengths, first = segments([np.frombuffer(t, dtype="<i4") for t in b.column("text").to_pylist()])
            for i in range(0, len(cut), 1024):
                counts.add(m, cut[i:i + 1024], lengths[i:i + 1024], first[i:i + 1024])
        yield counts.rows()

    kinds = "symbol bigint, " + ", ".join(f"c{i} float" for i in range(k))
    got = encoded.select("text").mapInArrow(run, kinds).groupBy("symbol").agg(
        *(F.sum(F.col(f"c{i}").cast("double")).alias(f"c{i}") for i in range(k))).toArrow()
    sent.unpersist()
    keys = got.column("symbol").to_numpy()
    values = np.stack([got.column(f"c{i}").to_numpy() for i in range(k)], axis=1)
    extra = np.zeros((k + 3, k))
    extra[-1 - keys[keys < 0]] = values[keys < 0]
    emit = np.zeros((m.symbols, k))
    emit[keys[keys >= 0]] = values[keys >= 0]
    # the corpus distribution weighs as many words as the state has distinct ones (Witten-Bell)
    emit += (1 + (emit >= 0.5).sum(axis=0)) * m.corpus()[:, None]
    m.emit = emit / emit.sum(axis=0)
    m.move = (extra[:k] + 1) / (extra[:k] + 1).sum(axis=1, keepdims=True)
    m.start, m.later = ((x + 1) / (x + 1).sum() for x in extra[k:k + 2])
    return float(extra[k + 2][0])


def begin(m: Model, rows: list[np.ndarray], states: int) -> None:
    """Start values: clusters of some segments by their frequent words, so that states differ from the first round on."""
    rows = rows or [np.zeros(1, dtype=np.int32)]
    top = min(512, m.other)
    x = np.sqrt(np.array([np.bincount(r[r <= top], minlength=top + 1)[1:] for r in rows], dtype=np.float64))
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    centres = [x[0]]
    for _ in range(states - 1):
        centres.append(x[int(np.max(x @ np.array(centres).T, axis=1).argmin())])
    centres = np.array(centres)
    for _ in range(10):
        own = (x @ centres.T).argmax(axis=1)
        for k in range(states):
            if (own == k).any():
                centres[k] = x[own == k].mean(axis=0)
                centres[k] /= max(1e-9, np.linalg.norm(centres[k]))
    emit = 2000.0 * np.repeat(m.corpus()[:, None], states, axis=1)
    for r, k in zip(rows, own):
        np.add.at(emit[:, k], r, 1)
    m.emit = emit / emit.sum(axis=0)
    m.start = m.later = np.full(states, 1 / states)
    m.move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)


def vocabulary(texts: DataFrame, counts: DataFrame, symbols: int) -> Model:
    """The symbols: words, classes and their training counts."""
    ends = texts.count()
    total, distinct, enough = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") >= LEAST)).first()
    top = counts.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(symbols).toArrow()
    m = Model(top.column("word").to_pylist(), np.concatenate([[ends], top.column("n").to_numpy()]).astype(np.int64),
              total + ends, distinct + (ends > 0))
    if enough > len(m.words):
        m.hashed = bit_filter(counts.filter(F.col("n") >= LEAST).select(F.xxhash64("word").alias("h")), "h", enough, FILTER_BITS)
    sent = counts.sparkSession.sparkContext.broadcast((m, set(m.words)))

    def sums(batches):
        m, own = sent.value
        n = np.zeros((m.symbols - m.other, 2), dtype=np.int64)
        for b in batches:
            words, c = b.column("word").to_pylist(), b.column("n").to_numpy()
            rest = np.array([i for i, w in enumerate(words) if w not in own], dtype=np.int64)
            at = m.class_of(np.fromiter((xxhash.xxh64_intdigest(words[i], 42) for i in rest), dtype=np.uint64, count=len(rest)))
            np.add.at(n, (at, 0), c[rest])
            np.add.at(n, (at, 1), 1)
        at = np.flatnonzero(n[:, 1])
        yield batch([("class", pa.int64()), ("n", pa.int64()), ("v", pa.int64())], pa.array(at), pa.array(n[at, 0]), pa.array(n[at, 1]))

    got = counts.mapInArrow(sums, "class bigint, n bigint, v bigint").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    m.classes = np.zeros((m.symbols - m.other, 2), dtype=np.int64)
    m.classes[got.column("class").to_numpy()] = np.stack([got.column("n").to_numpy(), got.column("v").to_numpy()], axis=1)
    return m


def encoded(texts: DataFrame, m: Model) -> DataFrame:
    """The texts as symbols."""
    sent = texts.sparkSession.sparkContext.broadcast(m)

    def encode(batches):
        m = sent.value
        code = {w: i + 1 for i, w in enumerate(m.words)}
        for b in slices(batches):
            yield batch([("text", pa.binary())], [m.codes(t, code).tobytes() for t in b.column("text").to_pylist()])
    return texts.select("text").mapInArrow(encode, "text binary")


def train(texts: DataFrame, counts: DataFrame, symbols: int, states: int) -> Model:
    """Fit on ``texts`` (id, text bytes) whose word counts are stored in ``counts``.

    The start values come from one segment each of the texts whose symbols hash lowest, so they do not depend on the layout of
    the files.
    """
    m = vocabulary(texts, counts, symbols)
    codes = materialise(encoded(texts, m), "segments")
    size = 4 * SEGMENT
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.ceil(F.length("text") / size)) * size
    drawn = codes.select(F.xxhash64("text").alias("h"), F.substring("text", place + 1, F.lit(size)).alias("text"))
    begin(m, [np.frombuffer(r["text"], dtype="<i4") for r in drawn.orderBy("h", "text").limit(STARTS).collect()], states)
    for _ in range(ROUNDS):
        baum_welch(codes, m)
    return m


def forward(m: Model, codes: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole sequence of symbols, all texts of a block step by step."""
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    lengths = np.array([len(codes[i]) for i in order])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([codes[i] for i in order])
    out = np.zeros(len(codes))
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    a = None
    for t, n in enumerate(active):
        a = (m.start[None, :] if t == 0 else a[:n] @ m.move) * m.emit[flat[begins[:n] + t]]
        c = a.sum(axis=1)
        a /= c[:, None]
        out[:n] += np.log(c)
    back = np.empty(len(codes))
    back[order] = out
    return back


def score(docs: DataFrame, symbols: int = SYMBOLS, states: int = STATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for every row.

    Trains on the rows that are not held out. A null text is empty and has the end alone; a null id counts as an empty string
    for the split; repeated rows are trained on and scored each. Without training rows both scores are 0. Words of
    the classes are joined on their 64-bit hash. ``symbols`` words have an emission of their own.
    """
    spark = docs.sparkSession
    texts = training(id_bytes(docs, id_col, text_col))
    known = texts.filter(~F.col("held_out")).select("doc_id", "text")
    counts = materialise(word_counts(known), "words")
    m = train(known, counts, symbols, states)
    sent = spark.sparkContext.broadcast(m)
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
              ("base", pa.float64()), ("chain", pa.float64()), ("shares", pa.float64()),
              ("others", pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.int32())])))]

    def run(batches):
        m, at = sent.value, TaskContext.get().partitionId() << 36
        code = {w: i + 1 for i, w in enumerate(m.words)}
        logs = np.append(np.log10(m.counts + 1.0), np.zeros(len(m.classes)))
        seen = np.append(m.counts > 0, np.zeros(len(m.classes), dtype=bool))
        shares = np.append(np.zeros(m.other), np.log10(m.classes.sum(axis=1) + 1.0))
        for b in slices(batches, 4096):
            rows, codes = [], []
            for doc, text, held in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))):
                c = m.codes(text, code)
                where = np.flatnonzero(c >= m.other)
                words = text.lower().split() if len(where) else ()
                tf = Counter(words[i] for i in where.tolist())
                others = [{"h": h if h < 1 << 63 else h - (1 << 64), "tf": n}
                          for h, n in ((xxhash.xxh64_intdigest(w, 42), n) for w, n in tf.items())]
                codes.append(c)
                rows.append((at, doc, held, len(c), int(seen[c].sum()), float(logs[c].sum()), float(shares[c].sum()), others))
                at += 1
            if rows:
                *cols, shared, others = map(list, zip(*rows))
                yield batch(fields, *cols, pa.array(forward(m, codes)), shared, others)

    first = materialise(texts.mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, chain double, "
             "shares double, others array<struct<h: bigint, tf: int>>"), "scores")
    rest = counts.filter(F.col("n") <= int(m.counts[1:].min())) if len(m.words) else counts
    rest = rest.select(F.xxhash64("word").alias("key"), "n")
    pairs = first.select("row", F.inline("others"))
    joined = pairs.join(rest, pairs.h == rest.key).groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("tf").alias("also")).withColumnRenamed("row", "r")
    all_ = math.log10(m.total + m.distinct + 1)
    logs, also = F.coalesce("logs", F.lit(0.0)), F.coalesce("also", F.lit(0))
    none = m.total == 0
    return first.join(joined, F.col("row") == F.col("r"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + also).alias("n_known"),
        F.lit(m.total).cast("bigint").alias("train_tokens"),
        F.lit(0.0).alias("base_score") if none else (F.col("base") + logs - F.col("n_tokens") * all_).alias("base_score"),
        F.lit(0.0).alias("score") if none else (F.col("chain") / math.log(10) + logs - F.col("shares")).alias("score"))


@query("op5_hmm_scores")
def op5(spark, d) -> DataFrame:
    return score(table(spark, d, "documents"))
