import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from daymosaic.llm import language_model as L


def plain(rows):
    """The base model of the contract."""
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n,
             sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


@pytest.mark.parametrize("symbols", [L.SYMBOLS, 50])
def test_base_equals_the_contract_and_the_model_beats_it(spark, monkeypatch, symbols):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("lang", "row").withColumnRenamed("source", "h")
    got = sorted(map(tuple, L.score(df, symbols=symbols).collect()))
    for g, w in zip(got, sorted(plain(rows)), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held) * (0.97 if symbols > 50 else 0.99)


def small(k=3, symbols=4, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = L.Model([b"a", b"b"][:symbols - 2], np.array([5, 4, 3]), 20, 6, None, np.array([[8, 3]]))
    m.start, m.later, m.move = norm(rng.random(k)), norm(rng.random(k)), norm(rng.random((k, k)))
    m.emit = norm(rng.random((k, symbols))).T
    return m


def test_forward_equals_all_paths():
    m = small()
    codes = [np.array(c) for c in ([0], [1, 2, 3, 0], [2, 2, 1, 3, 1, 0], [3, 0])]
    for c, got in zip(codes, L.forward(m, codes)):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(c)):
            p = m.start[path[0]] * m.emit[c[0], path[0]]
            for x, y, o in zip(path, path[1:], c[1:]):
                p *= m.move[x, y] * m.emit[o, y]
            total += p
        assert math.isclose(got, math.log(total), rel_tol=1e-9)


def test_expected_counts_equal_all_paths():
    m = small(2)
    c = np.array([1, 2, 3, 1, 0])
    counts = L.Counts(2, 4)
    counts.add(m, c[None, :], np.array([5]), np.array([True]))
    move, emit, total = np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for path in itertools.product(range(2), repeat=5):
        p = m.start[path[0]] * m.emit[c[0], path[0]]
        for x, y, o in zip(path, path[1:], c[1:]):
            p *= m.move[x, y] * m.emit[o, y]
        total += p
        for x, y in zip(path, path[1:]):
            move[x, y] += p
        for x, o in zip(path, c):
            emit[o, x] += p
    assert np.allclose(counts.move, move / total, rtol=1e-4) and np.allclose(counts.emit, emit / total, rtol=1e-4)
    assert math.isclose(counts.log, math.log(total), rel_tol=1e-5)


def test_rounds_raise_the_likelihood(spark):
    texts = L.id_bytes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    counts = L.materialise(L.word_counts(texts), "words")
    m = L.train(texts, counts, 1000, 4)
    assert m.hashed is not None and m.classes[1:, 1].sum() > 0  # words beyond the first 1000
    codes = L.materialise(L.encoded(texts, m), "codes")
    a = L.baum_welch(codes, m)
    b = L.baum_welch(codes, m)
    assert b > a and np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)


@pytest.mark.parametrize("symbols", [L.SYMBOLS, 300])
def test_scores_do_not_depend_on_the_layout(spark, symbols):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, two = ({r["doc_id"]: r["score"] for r in L.score(x, symbols=symbols).collect()} for x in (df, df.repartition(7, "text")))
    assert max(abs(one[i] - two[i]) for i in one) < 0.01


def test_shares_of_all_words_sum_to_one(spark):
    """Every symbol's probability is spread over its words, with one share of each class for words never seen."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = L.id_bytes(df)
    counts = L.materialise(L.word_counts(texts), "words")
    m = L.vocabulary(texts, counts, 200)
    code = {w: i + 1 for i, w in enumerate(m.words)}
    total = np.zeros(m.symbols - m.other)
    for r in counts.collect():
        c = m.codes(r["word"], code)[0]
        assert c != 0
        if c >= m.other:
            total[c - m.other] += r["n"] + 1
        else:
            assert m.words[c - 1] == r["word"] and m.counts[c] == r["n"]
    assert (total == m.classes.sum(axis=1)).all()
    assert m.classes[:, 0].sum() + m.counts.sum() == m.total


def test_nulls_long_texts_and_empty_table(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (2, ""), (3, "A b c " * 20000), (4, "x " * 130), (5, "İ q")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = sorted(map(tuple, L.score(df).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(plain(rows), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) and math.isfinite(g[6]) and g[6] < 0 for g, w in zip(got, want))
    assert L.score(df.limit(0)).count() == 0
