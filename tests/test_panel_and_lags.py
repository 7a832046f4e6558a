"""Panels, lags, season gaps, fills, row means (fixtures of the trap ledger)."""

import datetime as dt

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daymosaic.functions import features as X
from daymosaic.functions.calendar import day_of_season, in_season, season_dates
from daymosaic.operators import lags as L
from daymosaic.operators import panel as P
from daymosaic.operators import quality as Q
from daymosaic.operators.joins import join_one_to_one

D = dt.date
KEYS = ["region", "entity"]


def frame(spark, data, ddl="region string, entity string, date date, n bigint"):
    return spark.createDataFrame(data, ddl)


def test_row_lag_crosses_the_season_and_day_lag_does_not(spark):
    p = frame(spark, [("r", "e", D(2023, 11, 30), 9), ("r", "e", D(2024, 10, 1), 1), ("r", "e", D(2024, 10, 2), 2)])
    by_row = L.lag_rows(p, KEYS, {"n": "n"}, (1,))
    by_day = L.lag_days(p, KEYS, {"n": "n"}, (1,))
    assert rows(by_row, "date", "n_lag_1d")[1] == (D(2024, 10, 1), 9)
    assert rows(by_day, "date", "n_lag_1d") == [
        (D(2023, 11, 30), None), (D(2024, 10, 1), None), (D(2024, 10, 2), 1)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(days=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), unique=True, min_size=1, max_size=40))
def test_window_lags_equal_join_lags(spark, days):
    p = frame(spark, [("r", f"e{e}", D(2024, 1, 1) + dt.timedelta(d), e * 100 + d) for e, d in days])
    a = L.lag_days(p, KEYS, {"n": "n"}, (1, 3, 14))
    b = L.lag_days_by_join(p, KEYS, {"n": "n"}, (1, 3, 14))
    assert rows(a, *b.columns) == rows(b)
    lead = L.lead_days(p, KEYS, ["n"], (2,))
    want = {(f"e{e}", d): e * 100 + d for e, d in days}
    for r in lead.collect():
        assert r["n_t_plus_2d"] == want.get((r["entity"], (r["date"] - D(2024, 1, 1)).days + 2))


def test_skeleton_is_entities_times_dates_and_conserves(spark):
    ents = frame(spark, [("r", "a"), ("r", "b"), ("s", "a"), ("r", "a")], "region string, entity string")
    obs = frame(spark, [("r", "a", D(2023, 10, 1), 3), ("s", "a", D(2024, 11, 30), 4)]).withColumnRenamed("n", "event_count")
    p = P.zero_fill(P.skeleton(ents, KEYS, season_dates([2023, 2024])), obs, [*KEYS, "date"], ["event_count"])
    assert p.count() == 3 * 122
    assert p.agg(F.sum("event_count")).first()[0] == 7
    assert rows(Q.complete_panel(p, KEYS), "passed") == [(True,), (True,)]


def test_fill_policy_is_explicit(spark):
    obs = frame(spark, [("r", "a", D(2023, 10, 1), 3)]).select(
        *KEYS, "date", F.col("n").alias("event_count"), F.lit(1.5).alias("measure_mean"))
    skel = frame(spark, [("r", "a", D(2023, 10, 1)), ("r", "a", D(2023, 10, 2))], "region string, entity string, date date")
    strict = P.zero_fill(skel, obs, [*KEYS, "date"], ["event_count"])
    loose = P.zero_fill(skel, obs, [*KEYS, "date"], ["event_count", "measure_mean"])
    assert rows(strict, "event_count", "measure_mean") == [(0, None), (3, 1.5)]
    assert rows(loose, "event_count", "measure_mean") == [(0, 0.0), (3, 1.5)]
    assert rows(Q.null_only_when(strict, ["measure_mean"], F.col("event_count") == 0), "passed") == [(True,)]


def test_row_mean_policies(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    out = df.select(X.row_mean(["a", "b", "c"], True).alias("skip"), X.row_mean(["a", "b", "c"], False).alias("strict"))
    assert rows(out) == [(2.0, None), (None, None)]


def test_slope_is_least_squares_over_positions(spark):
    import numpy as np
    y = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([tuple(y), (2.0,) * 5], "a double, b double, c double, d double, e double")
    five, three = [r for r in df.select(X.slope(list("abcde")), X.slope(list("abc"))).collect()][0]
    assert five == pytest.approx(np.polyfit(range(5), y, 1)[0])
    assert three == pytest.approx(np.polyfit(range(3), y[:3], 1)[0])
    assert tuple(df.select(X.slope(list("abcde"))).collect()[1]) == (0.0,)


def test_day_of_season_goes_below_one_before_october(spark):
    df = spark.createDataFrame([(D(2024, 9, 29),), (D(2024, 10, 1),), (D(2024, 11, 30),)], "d date")
    assert rows(df.select("d", day_of_season("d"))) == [(D(2024, 9, 29), -1), (D(2024, 10, 1), 1), (D(2024, 11, 30), 61)]
    assert rows(df.select("d", in_season("d"), in_season("d", [2023]))) == [
        (D(2024, 9, 29), False, False), (D(2024, 10, 1), True, False), (D(2024, 11, 30), True, False)]


def test_missing_dates_and_readiness(spark):
    p = frame(spark, [("r", "e", D(2024, 1, d), 1) for d in range(1, 21) if d not in (4, 5, 11)])
    assert rows(P.missing_dates(p, KEYS), "date") == [(D(2024, 1, 4),), (D(2024, 1, 5),), (D(2024, 1, 11),)]
    r = P.continuous_history(p, KEYS).first()
    assert (r["days_present"], r["gap_days"], r["ready"]) == (17, 3, False)


def test_rolling_mean_needs_a_full_window(spark):
    p = frame(spark, [("r", "e", D(2024, 1, d), d) for d in range(1, 6)])
    out = L.rolling_mean_prev(p, KEYS, "n", {"m": 3})
    assert [r["m"] for r in out.orderBy("date").collect()] == [None, None, None, 2.0, 3.0]


def test_join_one_to_one_refuses_repeated_keys(spark):
    a = frame(spark, [("r", "e", D(2024, 1, 1), 1)])
    b = frame(spark, [("r", "e", D(2024, 1, 1), 1)] * 2).withColumnRenamed("n", "m")
    assert join_one_to_one(a, b.limit(1), [*KEYS, "date"]).count() == 1
    with pytest.raises(Exception, match="not unique"):
        join_one_to_one(a, b, [*KEYS, "date"]).collect()


def test_lag_audit_finds_positional_lags(spark):
    p = frame(spark, [("r", "e", D(2023, 11, 30), 9), ("r", "e", D(2024, 10, 1), 1)])
    good = Q.lag_aligned(L.lag_days(p, KEYS, {"n": "n"}, (1,)), p, KEYS, {"n": "n"}, (1,))
    bad = Q.lag_aligned(L.lag_rows(p, KEYS, {"n": "n"}, (1,)), p, KEYS, {"n": "n"}, (1,))
    assert rows(good, "passed", "detail") == [(True, "0")]
    assert rows(bad, "passed", "detail") == [(False, "1")]
    with pytest.raises(Q.CheckFailed, match="n_lag_1d"):
        Q.enforce(bad)


def test_lags_share_one_shuffle(spark):
    """All lags and leads of a panel come out of a single exchange."""
    p = spark.range(100).select(F.lit("r").alias("region"), (F.col("id") % 5).cast("string").alias("entity"),
                                F.date_add(F.lit(D(2024, 1, 1)), (F.col("id") / 5).cast("int")).alias("date"),
                                F.col("id").alias("n"))
    f = L.lags_and_leads(p, KEYS, {"n": "n"}, lead_cols=["n"])
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
