"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of the test items are counted over all documents. An item's rare seeds are those not more frequent than twice the
median of its own n-grams, so at least half of them serve whatever the item's own spread. A document that holds a rare seed is a
candidate for the item at that place; it is aligned there, word by word, if the place has enough of the item's words to reach the
threshold at all. The alignment's score over that of a perfect copy decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import batch, id_text, materialise, query, slices, table

SIZE, THRESHOLD = 3, 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items sent to every task at once; more are searched in further passes over the documents.
BLOCK = 20_000
WORD = re.compile(r"[^\W_]+")
HIT = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()),
       ("seeds", pa.int32())]


class Items:
    """Words of the items as codes, and their n-grams as sorted keys with (item, place) lists."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size, self.vocabulary, self.ids, self.words = size, {}, [], []
        for i, text in items:
            ws = WORD.findall(text.lower())
            if len(ws) >= size:
                self.ids.append(i)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]))
        places = defaultdict(list)
        for k, ws in enumerate(self.words):
            for at, g in enumerate(self.grams(ws).tolist()):
                places[g].append((k, at))
        self.keys = np.array(sorted(places), dtype=np.int64)
        self.places = [places[g] for g in self.keys.tolist()]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Keys of the n-grams; those with a word of no item are -1. Keys of large vocabularies
        wrap; that can only add a candidate, which is aligned like any other."""
        n = len(codes) - self.size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        out, ok = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        base = len(self.vocabulary) + 1
        with np.errstate(over="ignore"):
            for j in range(self.size):
                out = out * base + codes[j:n + j]
                ok &= codes[j:n + j] > 0
        out[~ok] = -1
        return out

    def codes(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the document, indices of the keys there)."""
        g = self.grams(codes)
        at = np.flatnonzero(g >= 0)
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        hit = self.keys[k] == g[at]
        return at[hit], k[hit]


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local score with linear gaps, and the first and last-plus-one word of it in ``doc``."""
    def best(a, b):
        row, top, end, last = np.zeros(len(b) + 1, dtype=np.int64), 0, 0, 0
        steps = np.arange(len(b) + 1) * -GAP
        for i, w in enumerate(a):
            new = np.zeros_like(row)
            new[1:] = np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] + GAP)
            row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
            j = int(row.argmax())
            if row[j] > top:
                top, end, last = int(row[j]), j, i + 1
        return top, end, last
    score, end, last = best(item, doc)
    _, back, _ = best(item[:last][::-1], doc[:end][::-1])
    return score, end - back, end


def rare_keys(items: Items, counts: np.ndarray) -> np.ndarray:
    """Which keys are a rare seed of which item: a set of (key, item) as key * items + item."""
    by_item = defaultdict(list)
    for key, places in enumerate(items.places):
        for k, _ in places:
            by_item[k].append(key)
    out = set()
    for k, keys in by_item.items():
        bound = 2 * np.median(counts[keys]) + 1
        out |= {key * len(items.ids) + k for key in keys if counts[key] <= bound}
    return np.array(sorted(out), dtype=np.int64)


def candidates(items: Items, rare: set[int], codes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """item -> (from, to, seeds) stretches of the document, each as long as an edited copy may be; overlapping ones joined."""
    at, keys = items.found(codes)
    by_item = defaultdict(list)
    for j, key in zip(at.tolist(), keys.tolist()):
        for k, i in items.places[key]:
            if key * len(items.ids) + k in rare:
                by_item[k].append(j - i)
    out = {}
    for k, starts in by_item.items():
        n, pad, runs = len(items.words[k]), len(items.words[k]) // 2 + 1, []
        for s in sorted(starts):
            a, b = max(0, s - pad), min(len(codes), s + n + pad)
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], b, runs[-1][2] + 1)
            else:
                runs.append((a, b, 1))
        out[k] = runs
    return out


def search(text: str, items: Items, rare: set[int], threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item id, score, start, end, seeds) of the best place of each item that reaches the threshold; places in characters."""
    low = text.lower()
    words = WORD.findall(low)
    codes = items.codes(words)
    out = []
    for k, runs in candidates(items, rare, codes).items():
        item, best = items.words[k], None
        for a, b, n in runs:
            # words of the item present here bound the matches, and so the score
            if np.isin(item, codes[a:b]).mean() >= threshold:
                score, s, e = align(item, codes[a:b])
                score /= MATCH * len(item)
                if score >= threshold and (best is None or score > best[0]):
                    best = (score, a + s, a + e, n)
        if best:
            out.append((k, best))
    if not out:
        return []
    # lower-casing may lengthen a text; places then refer to the lower-cased text's nearest original character
    spans = [m.span() for m in WORD.finditer(low)]
    scale = (lambda x: x) if len(low) == len(text) else (lambda x: min(x, len(text)))
    return [(items.ids[k], s, scale(spans[a][0]), scale(spans[b - 1][1]), n) for k, (s, a, b, n) in out]


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score in (0, 1], start and end in characters, seeds: a row for each document and item it copies.

    Null texts are empty. Items that are null or have fewer words than a seed hold no evidence and match nothing. Null ids
    and repeated rows give rows like others; equal scores take the first place. Other columns are not read.
    """
    tests = materialise(benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("text"))
                        .filter("text is not null"), "items")
    blocks = max(1, -(-tests.count() // BLOCK))
    texts, parts = id_text(docs, id_col, text_col), []
    for i in range(blocks):
        here = tests.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).toArrow()
        parts.append(_block(texts, list(zip(here.column("id").to_pylist(), here.column("text").to_pylist())), size, threshold))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _block(texts: DataFrame, rows: list[tuple[int, str]], size: int, threshold: float) -> DataFrame:
    sc = texts.sparkSession.sparkContext
    items = Items(rows, size)
    sent = sc.broadcast(items)

    def count(batches):
        n, items = Counter(), sent.value
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                n.update(set(items.found(items.codes(WORD.findall(text.lower())))[1].tolist()))
        yield batch([("key", pa.int64()), ("n", pa.int64())], list(n), list(n.values()))

    found = texts.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(items.keys), dtype=np.int64)
    counts[found.column("key").to_numpy()] = found.column("n").to_numpy()
    seeds = sc.broadcast(rare_keys(items, counts))

    def run(batches):
        items, rare = sent.value, set(seeds.value.tolist())
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                out += [(doc, *hit) for hit in search(text, items, rare, threshold)]
            yield batch(HIT, *map(list, zip(*out))) if out else batch(HIT)

    return texts.mapInArrow(run, "doc_id bigint, item_id bigint, score double, start bigint, end bigint, seeds int")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a copy of an item, all their columns as they were. Rows with a null id are kept."""
    hit = materialise(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("hit")).distinct(), "hits")
    return docs.join(hit, docs[options.get("id_col", "doc_id")].cast("bigint") == hit.hit, "left_anti")


@query("op3_decontamination")
def op3(spark, d) -> DataFrame:
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))
