import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymosaic.llm import hard_negatives as H

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def floors(v, scale=256):
    return [min(HIGH, max(LOW, math.floor(x * scale))) for x in v]


def brute(rows, asks, positives=5, negatives=5):
    ok = [(i, lab, floors(v)) for i, v, lab in rows if i is not None and lab is not None and v is not None
          and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, a in {r[0]: r for r in sorted(ok, key=lambda r: r[1:], reverse=True)}.values():
        if not asks(i):
            continue
        s = [(-min(HIGH, max(LOW, sum(x * y for x, y in zip(a, b)))), j, m) for j, m, b in ok if j != i]
        for p, j, _ in sorted(x for x in s if x[2] == lab)[:positives]:
            hard = sorted(x for x in s if x[2] != lab and 80 * -p <= 100 * -x[0] <= 100 * -p)[:negatives]
            out += [(i, j, r, k, -p, -q) for r, (q, k, _) in enumerate(hard, 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect()))


@pytest.mark.parametrize("dim,shard,block", [(1, 4096, 16384), (7, 40, 5), (64, 100, 16384), (3, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, dim, shard, block):
    monkeypatch.setattr(H, "LEAST", shard)
    monkeypatch.setattr(H, "MOST", shard)
    monkeypatch.setattr(H, "BLOCK", block)
    rng = np.random.default_rng(dim)
    n = 60 if shard == 1 else 300
    rows = [(i, [float(x) for x in rng.normal(size=dim) + 0.3], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(i, rows[5][1], i % 3) for i in range(n, n + 100)] + [(900, None, 1), (901, [None] * dim, 1), (902, [float("nan")] * dim, 2),
             (903, [float("inf")] * dim, 2), (910, rows[3][1], None), (None, rows[1][1], 1), (920, [], 1), (930, [-1.0], 2)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, rank string, score double")
    df = df.repartition(5)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    found = got(df)
    assert found == brute(rows, lambda i: i % 10 == 0) and found


def test_repeated_ids_and_huge_components(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [5.0, 1.0], 0), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1e300, 0.0], 1),
            (3, [-1e300, 3.0], 2), (4, [1e300, -1e300], 2), (5, [0.9, 0.9], 0), (5, [0.9, 0.9], 0), (10, [1e9, 1e9], 1), (6, [1e9, 9e8], 2),
            (20, [1e300, 1e300], 3), (7, [1.0, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(df) == brute(rows, lambda i: i % 10 == 0)


def test_empty_and_lonely(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert got(spark.createDataFrame([], schema)) == []
    assert got(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], schema)) == []
    negative = spark.createDataFrame([(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)], schema)
    assert got(negative) == []


def test_query_on_the_table_equals_brute_force(spark):
    from daymosaic.llm.suite import QUERIES
    d = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    found = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, d).collect()))
    assert found == brute(rows, lambda i: i % 100 == 0) and found
