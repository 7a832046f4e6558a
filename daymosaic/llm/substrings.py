"""Substring dedup by seed and extend over winnowed anchors.

Of every ``window`` consecutive words one short run is the anchor, the one with the least hash (the rightmost of equals), so
equal windows have equal anchors at the same place. Documents meet on anchors that occur more than once. An occurrence brings
the hashes of all windows that its anchor stands for, which reach to both sides of it; among the occurrences of an anchor, in
document order, a window is a repeat if it was there before. Touching repeats join to the maximal ones, and their words go.

Occurrences that repeat within a task are settled there, so an anchor that many rows share sends one row from each task.
Anchors with over a ten-thousandth of all occurrences are dealt out by window instead of by anchor.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import batch, id_bytes, materialise, query, slices, table

WINDOW, ANCHOR = 20, 8
#: Bits of the filter of repeated anchors, at most; a fuller filter lets more rows pass, none is lost.
FILTER_BITS = 28
#: Occurrences that a task holds before it sends them.
HELD = 200_000
#: An anchor is hot with more than this share of all occurrences, so there are fewer hot ones than its inverse.
HOT = 1e-4

BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ROW = [("key", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("whole", pa.int64()),
       ("windows", pa.binary())]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of runs of words, from two independent hashes of each word, modulo 2**64."""

    def __init__(self):
        self.n = 0
        self.grow(1 << 15)

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = n
            self.up, self.down = powers(BASE, n), powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n)

    def sums(self, h: np.ndarray) -> np.ndarray:
        self.grow(len(h) + 1)
        out = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * self.up[:len(h)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (sums[hi] - sums[lo]) * self.down[lo]


def words_hashed(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text an array (words, 2) of hashes."""
    split = [t.split() for t in texts]
    code: dict[bytes, int] = {}
    codes = [[code.setdefault(w, len(code)) for w in s] for s in split]
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, code)), dtype="<u8").reshape(-1, 2)
    for c in codes:
        yield h[np.array(c, dtype=np.int64)]


def anchors(h: np.ndarray, hasher: Hasher, window: int, size: int):
    """(anchor hash, first window, end of windows) of each run of windows with one anchor."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    sums = hasher.sums(h[:, 0])
    lo = np.arange(len(h) - size + 1)
    grams = hasher.runs(sums, lo, lo + size)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - size + 1)
    at = np.arange(n) + (window - size) - view[:, ::-1].argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return grams[at[first]], first, np.append(first[1:], n)


def anchor_counts(texts: DataFrame, window: int, size: int) -> DataFrame:
    def run(batches):
        hasher = Hasher()
        for b in slices(batches):
            found = [anchors(h, hasher, window, size)[0] for h in words_hashed(b.column("text").to_pylist())]
            yield batch([("anchor", pa.int64())], pa.array(np.concatenate(found).view(np.int64)))
    return texts.mapInArrow(run, "anchor bigint").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def bit_filter(values: DataFrame, column: str, n: int, most: int) -> tuple[np.ndarray, int]:
    """A bitmap over the low bits of a hash; at most 2**most bits reach the driver, whatever n is."""
    bits = min(most, max(12, math.ceil(math.log2(16 * max(1, n)))))
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = values.select(low.alias("b")).groupBy(F.shiftright("b", 5).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("w")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[rows.column("at").to_numpy()] = rows.column("w").to_numpy().astype(np.uint32)
    return out, bits


def has(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64((1 << bits) - 1)
    return (bitmap[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


class Held:
    """Occurrences of one task by (key, whole): the first stays, later ones are settled as repeats."""

    def __init__(self):
        self.first: dict[tuple[int, int], tuple[int, int, int, bytes]] = {}
        self.done: list[tuple[int, int, int]] = []

    def add(self, key: int, whole: int, doc: int, lo: int, n: int, windows: bytes) -> None:
        old = self.first.get((key, whole))
        if old is None:
            self.first[key, whole] = (doc, lo, n, windows)
        elif (doc, lo) < old[:2]:
            self.done.append(old[:3])
            self.first[key, whole] = (doc, lo, n, windows)
        elif (doc, lo) > old[:2]:
            self.done.append((doc, lo, n))

    def rows(self) -> pa.RecordBatch:
        """Settled runs of windows, joined where they touch, have no windows and a key of their document."""
        out = [(k, d, lo, n, w, ws) for (k, w), (d, lo, n, ws) in self.first.items()]
        joined: list[list[int]] = []
        for d, lo, n in sorted(self.done):
            if joined and joined[-1][0] == d and lo <= joined[-1][1] + joined[-1][2]:
                joined[-1][2] = max(joined[-1][2], lo + n - joined[-1][1])
            else:
                joined.append([d, lo, n])
        out += [(d, d, lo, n, 0, b"") for d, lo, n in joined]
        self.first, self.done = {}, []
        return batch(ROW, *map(list, zip(*out))) if out else batch(ROW)


def occurrences(texts: DataFrame, window: int, size: int, bitmap, bits: int, hot) -> DataFrame:
    """Rows of repeated anchors with the hashes of their windows, and settled repeats."""
    sent = texts.sparkSession.sparkContext.broadcast((bitmap, bits, np.sort(hot)))

    def run(batches):
        bitmap, bits, hot = sent.value
        hasher, held = Hasher(), Held()
        for b in slices(batches):
            docs = b.column("doc_id").to_pylist()
            for doc, h in zip(docs, words_hashed(b.column("text").to_pylist())):
                anchor, lo, hi = anchors(h, hasher, window, size)
                keep = has(bitmap, bits, anchor)
                if not keep.any():
                    continue
                anchor, lo, hi = anchor[keep], lo[keep], hi[keep]
                sums = hasher.sums(h[:, 1])
                p = np.arange(len(h) - window + 1)
                w = hasher.runs(sums, p, p + window)
                whole = hasher.runs(sums, lo, hi + window - 1) + (hi - lo).astype(np.uint64) * OTHER
                is_hot = np.isin(anchor, hot)
                for a, i, j, c, many in zip(anchor.view(np.int64).tolist(), lo.tolist(), hi.tolist(),
                                            whole.view(np.int64).tolist(), is_hot.tolist()):
                    if many:
                        own = (w[i:j] * BASE ^ np.uint64(a & (1 << 64) - 1)).view(np.int64).tolist()
                        for q, key in enumerate(own):
                            held.add(key, 0, doc, i + q, 1, w[i + q:i + q + 1].tobytes())
                    else:
                        held.add(a, c, doc, i, j - i, w[i:j].tobytes())
                if len(held.first) + len(held.done) > HELD:
                    yield held.rows()
        yield held.rows()

    return texts.mapInArrow(run, "key bigint, doc_id bigint, lo int, n int, whole bigint, windows binary")


def repeats(rows: DataFrame) -> DataFrame:
    """doc_id, lo, hi: words lo to hi - 1 are covered by windows that also start earlier. ``hi`` counts windows yet."""
    out = [("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())]

    def run(batches):
        key, seen, wholes = None, {}, {}
        for b in batches:
            found = []
            cols = [b.column(c).to_pylist() for c in ("key", "doc_id", "lo", "n", "whole", "windows")]
            for k, doc, lo, n, whole, windows in zip(*cols):
                if not windows:
                    found.append((doc, lo, n))
                    continue
                if k != key:
                    key, seen, wholes = k, {}, {}
                if whole and wholes.setdefault(whole, (doc, lo)) != (doc, lo):
                    found.append((doc, lo, n))
                    continue
                start = None
                for q, w in enumerate(np.frombuffer(windows, dtype="<i8").tolist()):
                    if seen.setdefault(w, (doc, lo + q)) != (doc, lo + q):
                        start = q if start is None else start
                    elif start is not None:
                        found.append((doc, lo + start, q - start))
                        start = None
                if start is not None:
                    found.append((doc, lo + start, n - start))
            yield batch(out, *map(list, zip(*found))) if found else batch(out)

    sorted_ = rows.repartition("key").sortWithinPartitions("key", "doc_id", "lo")
    return sorted_.mapInArrow(run, "doc_id bigint, lo int, n int")


def dedup(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text",
          with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row, and if asked the kept text (words joined by one space).

    A null text has no words. Rows with a null id are kept whole and make nothing else a repeat. Rows that share an id count
    as one document: a place removed in one is removed in all, and equal places are no repeats of each other.
    Other columns are not read.
    """
    texts = id_bytes(docs, id_col, text_col)
    known = texts.filter("doc_id is not null")
    counts = materialise(anchor_counts(known, window, size), "anchors")
    n, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = counts.filter(F.col("n") > max(1000, HOT * total)).toArrow().column("anchor").to_numpy().view(np.uint64)
    bitmap, bits = bit_filter(counts, "anchor", n, FILTER_BITS)
    gone = repeats(occurrences(known, window, size, bitmap, bits, hot))
    gone = gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("lo", "n")).alias("gone"))
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("text", pa.string())] * with_text

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc, text, runs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "gone"))):
                words = text.split()
                away = bytearray(len(words))
                for r in runs or ():
                    hi = min(len(words), r["lo"] + r["n"] + window - 1)
                    away[r["lo"]:hi] = b"\1" * max(0, hi - r["lo"])
                kept = b" ".join(w for w, x in zip(words, away) if not x) if runs else b" ".join(words)
                rows.append((doc, len(words), sum(away), hashlib.sha256(kept).hexdigest())
                            + ((kept.decode("utf-8", "replace"),) if with_text else ()))
            yield batch(fields, *map(list, zip(*rows))) if rows else batch(fields)

    kinds = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * with_text
    return texts.join(gone, texts.doc_id == gone.id, "left").select("doc_id", "text", "gone").mapInArrow(run, kinds)


@query("op7_substring_dedup")
def op7(spark, d) -> DataFrame:
    return dedup(table(spark, d, "documents"))
