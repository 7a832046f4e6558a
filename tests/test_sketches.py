import datetime as dt

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from daymosaic.operators import sketches as K
from daymosaic.operators.running import percentiles


def made(spark, n=6000):
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=n // 2), r.exponential(size=n // 2) * 100])
    return spark.createDataFrame([("ab"[i % 2], dt.date(2024, 1, 1 + i % 28), float(x) if i % 50 else None) for i, x in enumerate(v)],
                                 "k string, date date, v double")


def test_windows_from_days_keep_the_rank_error(spark):
    df, points = made(spark).cache(), [0.1, 0.5, 0.9]
    for k in (64, 800):
        days = K.day_sketches(df, ["k"], "v", k)
        ends = [dt.date(2024, 1, 14), dt.date(2024, 1, 28)]
        got = K.quantiles(K.trailing(days, ["k"], ends, [7, 28], k), points).collect()
        assert len(got) == 8
        for g in got:
            own = df.filter((F.col("k") == g["k"]) & F.col("v").isNotNull() & (F.col("date") <= g["ending"])
                            & (F.datediff(F.lit(g["ending"]), "date") < g["days"]))
            v = np.array([r["v"] for r in own.select("v").collect()])
            assert g["n"] == len(v)
            for p in points:
                q = g[f"p{round(p * 100):02d}"]
                assert (v < q).mean() - K.rank_error(k) <= p <= (v <= q).mean() + K.rank_error(k)


def test_close_to_exact_percentiles_and_merges_over_keys(spark):
    df = made(spark).cache()
    days = K.day_sketches(df, ["k"], "v")
    whole = K.quantiles(K.merged(days.select("sketch").withColumn("all", F.lit(1)), ["all"]), [0.5]).first()
    exact = percentiles(df.withColumn("all", F.lit(1)), ["all"], "v", [0.5 - K.rank_error(), 0.5, 0.5 + K.rank_error()]).first()
    assert whole["n"] == 5880 and exact[1] <= whole["p50"] <= exact[3]


def test_small_windows_are_exact_and_empty_ones_have_no_row(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), float(i)) for i in range(101)] + [("b", dt.date(2024, 1, 1), None)],
                               "k string, date date, v double")
    days = K.day_sketches(df, ["k"], "v")
    got = K.quantiles(K.trailing(days, ["k"], [dt.date(2024, 1, 1), dt.date(2025, 1, 1)], [1]), [0.0, 0.5, 1.0])
    assert rows(got) == [("a", dt.date(2024, 1, 1), 1, 101, 0.0, 50.0, 100.0)]
