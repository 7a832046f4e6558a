import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymosaic.llm import topk as T


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in ok}.items():
        if q % 20:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out |= {(q, r + 1, i, -m) for r, (m, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("dim", [1, 7, 64])
def test_equals_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.normal(size=dim)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 500)] + [(501, None), (502, [None] * dim), (503, [float("nan")] * dim),
                                                         (504, [float("inf")] * dim), (None, rows[1][1]), (520, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {tuple(r) for r in T.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert {g for g in got if g[0] != 520} == {b for b in brute([r for r in rows if r[1] != []] + [(520, [0.0] * dim)], 20)
                                              if b[0] != 520}


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)],
                               "vec_id long, embedding array<double>")
    one = {tuple(r) for r in T.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()}
    monkeypatch.setattr(T, "BLOCK", 4)
    assert {tuple(r) for r in T.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()} == one and len(one) == 100


def test_large_components_stay_exact():
    x = np.array([[2.0 ** 30, 1.0]])
    assert T.exact(x, x, np.array([0]), np.array([0]))[0] == 2 ** 60 + 1


def test_huge_components_and_repeated_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-5.0, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 3.0]), (3, [1e300, -1e300]), (4, [0.5, 0.5]),
            (4, [0.5, 0.5]), (20, [1e300, 1e300]), (40, [1e9, 1e9]), (41, [1e9, 9e8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ok = [(i, [min(high, max(low, math.floor(64 * x))) for x in v]) for i, v in rows]
    want = set()
    for q in (0, 20, 40):
        a = min(v for i, v in ok if i == q)
        s = sorted((-min(high, max(low, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q)[:20]
        want |= {(q, r + 1, i, -m) for r, (m, i) in enumerate(s)}
    assert {tuple(r) for r in T.top_k(df, F.col("vec_id") % 20 == 0).collect()} == want


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in T.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert T.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
