"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector for all ordered cuts. Features are words and their first four to six
letters, so inflected forms share evidence; those that tell the grades apart most are kept. Outputs are the grade
probabilities and the expected severity, the sum of P(grade > k).

Labels say only toxic or not, so graded examples are made from them: 0 is not toxic; toxic texts are graded 1 to ``grades`` - 1 by
quantiles of how much of the vocabulary that only toxic texts hold is in them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.llm.base import batch, id_text, query, slices, table

#: Labelled texts that the fit reads, at most, the first by a hash of their id. All texts are scored.
SAMPLE = 12_000
FEATURES, GRADES = 1000, 4
WORD = re.compile(r"[^\W\d_]+")
LENGTHS = (4, 5, 6)


def features(text: str) -> Counter:
    """=word and ^prefix with the number of their occurrences."""
    out = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        out["=" + w] += n
        for k in LENGTHS:
            if len(w) > k:
                out["^" + w[:k]] += n
    return out


@dataclass
class Ordinal:
    names: list[str]
    weights: np.ndarray
    cuts: np.ndarray

    def matrix(self, rows: list[dict[str, int]]) -> np.ndarray:
        at = {n: i for i, n in enumerate(self.names)}
        x = np.zeros((len(rows), len(at)), dtype=np.float32)
        for r, fs in zip(x, rows):
            for f, n in fs.items():
                if (i := at.get(f)) is not None:
                    r[i] = np.log1p(n)
        return x

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - (x @ self.weights)[:, None], -60, 60)))


def association(rows: list[dict[str, int]], positive: np.ndarray, least: int = 5) -> list[tuple[float, str]]:
    """Features by their log-likelihood ratio with a two-way label over texts, largest first."""
    a, n = Counter(), Counter()
    for fs, y in zip(rows, positive):
        n.update(fs.keys())
        if y:
            a.update(fs.keys())
    p, total = int(positive.sum()), len(rows)
    out = []
    for f, both in n.items():
        if both < least:
            continue
        cells = np.array([[a[f], both - a[f]], [p - a[f], total - p - both + a[f]]], dtype=float)
        expected = cells.sum(axis=1, keepdims=True) * cells.sum(axis=0, keepdims=True) / total
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * np.nansum(np.where(cells > 0, cells * np.log(cells / expected), 0))
        out.append((float(g), f))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def severity(rows: list[dict[str, int]], toxic: np.ndarray, grades: int, strong: float = 25.0) -> np.ndarray:
    """Grades from two-way labels (see above)."""
    if not toxic.any() or toxic.all():
        return toxic.astype(int)
    clean = Counter(f for fs, y in zip(rows, toxic) if not y for f in fs)
    marks = {f for g, f in association(rows, toxic) if g > strong and not clean[f]}
    amount = np.array([sum(np.log1p(n) for f, n in fs.items() if f in marks) for fs in rows])
    cuts = np.quantile(amount[toxic], np.arange(1, grades - 1) / (grades - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, amount, side="left"), 0)


def fit(rows: list[dict[str, int]], grade: np.ndarray, grades: int, n_features: int = FEATURES, ridge: float = 1e-4,
        rounds: int = 400) -> Ordinal:
    """Proportional-odds fit by gradient steps (Adam) on the mean log likelihood with a ridge."""
    names = [f for g, f in association(rows, grade > 0)[:n_features] if g > 8]
    m = Ordinal(names, np.zeros(len(names)), np.zeros(grades - 1))
    below = np.array([(np.sum(grade <= k) + 1) / (len(grade) + 2) for k in range(grades - 1)])
    m.cuts = np.log(below / (1 - below)) + np.arange(grades - 1) * 1e-3
    x = m.matrix(rows)
    # cuts stay ordered: the first and the logs of the steps are what moves
    theta = np.concatenate([m.weights, m.cuts[:1], np.log(np.maximum(np.diff(m.cuts), 1e-3))])
    first, second, f = np.zeros_like(theta), np.zeros_like(theta), len(names)
    rank = np.arange(len(grade))
    for t in range(1, rounds + 1):
        w, cuts = theta[:f], theta[f] + np.concatenate([[0], np.cumsum(np.exp(theta[f + 1:]))])
        z = np.concatenate([np.full((len(x), 1), -60.0), np.clip(cuts[None, :] - (x @ w)[:, None], -60, 60),
                            np.full((len(x), 1), 60.0)], axis=1)
        s = 1 / (1 + np.exp(-z))
        hi, lo = s[rank, grade + 1], s[rank, grade]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dcut = np.array([(dhi[grade == k].sum() - dlo[grade == k + 1].sum()) for k in range(grades - 1)]) / len(x)
        dw = -(x.T @ (dhi - dlo)) / len(x) - ridge * w
        steps = np.exp(theta[f + 1:])
        grad = np.concatenate([dw, [dcut.sum()], [dcut[k + 1:].sum() * steps[k] for k in range(grades - 2)]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta = theta + 0.05 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    m.weights = theta[:f]
    m.cuts = theta[f] + np.concatenate([[0], np.cumsum(np.exp(theta[f + 1:]))])
    return m


def train(docs: DataFrame, labels: DataFrame, grades: int = GRADES, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Ordinal | None:
    """Fit in one task on at most ``sample`` labelled texts; None without any. Null labels and texts are no examples.

    A document labelled twice counts as toxic if either says so.
    """
    marked = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.filter(F.col(text_col).isNotNull())
    texts = id_text(texts, id_col, text_col)
    chosen = texts.join(F.broadcast(marked), texts.doc_id == marked.id).select("toxic", "text")  # bounded by ``sample``

    def run(t):
        rows = [features(x) for x in t.column("text").to_pylist()]
        toxic = t.column("toxic").to_numpy() > 0
        m = fit(rows, severity(rows, toxic, grades), grades)
        names = m.names + [None] * len(m.cuts)
        return pa.table({"name": pa.array(names, pa.string()), "value": np.concatenate([m.weights, m.cuts])})

    got = chosen.withColumn("whole", F.lit("sample")).groupBy("whole").applyInArrow(run, "name string, value double").collect()
    if not got:
        return None
    return Ordinal([r["name"] for r in got if r["name"]], np.array([r["value"] for r in got if r["name"]]),
                   np.array(sorted(r["value"] for r in got if not r["name"])))


FIELDS = [("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_()),
          ("probabilities", pa.list_(pa.float64()))]


def predict(docs: DataFrame, model: Ordinal | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest, the lower of equals), toxic, probabilities by grade, for every row.

    A null text is empty; null ids and repeated rows are kept; without a model all outputs are null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        at = {n: i for i, n in enumerate(m.names)} if m else {}
        heads = {n[1:5] for n in at}
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            if m is None:
                none = [None] * len(texts)
                yield batch(FIELDS, b.column("doc_id"), none, none, none, none)
                continue
            rows = []
            for text in texts:
                found: dict[str, int] = {}
                for w in WORD.findall(text.lower()):
                    if w[:4] in heads:
                        for f in ("=" + w, *("^" + w[:k] for k in LENGTHS if len(w) > k)):
                            if f in at:
                                found[f] = found.get(f, 0) + 1
                rows.append(found)
            above = m.above(m.matrix(rows).astype(np.float64))
            p = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield batch(FIELDS, b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)),
                        pa.array(above[:, 0] >= threshold), list(p))

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, expected_severity double, grade int, toxic boolean, probabilities array<double>")


@query("op1_toxicity")
def op1(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return predict(docs, train(docs, table(spark, d, "labels")))
