"""Ranking metrics, percentiles, thresholds and calibration against brute force."""

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daymosaic.functions import numeric as N
from daymosaic.operators import metrics as M
from daymosaic.operators.running import log_position, logit_position, percentiles, running_totals

DDL = "g string, score double, y int"
slow = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
scores = st.one_of(st.sampled_from([0.0, 0.25, 0.5, 1.0]), st.floats(0, 1), st.floats(0, 1e-9),
                   st.floats(1 - 1e-9, 1))


def auc(s, y):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def ap(s, y):
    total = sum(y)
    if not total:
        return None
    out = 0.0
    for t in sorted(set(s), reverse=True):
        got = sum(b for a, b in zip(s, y) if a == t)
        out += got / total * sum(b for a, b in zip(s, y) if a >= t) / sum(a >= t for a in s)
    return out


@slow
@given(st.lists(st.tuples(st.sampled_from("ab"), scores, st.integers(0, 1)), min_size=1, max_size=60))
def test_auc_is_mann_whitney_and_ap_is_the_step_sum(spark, data):
    got = {r["g"]: r for r in M.rank_metrics(spark.createDataFrame(data, DDL), ["g"], "score", "y").collect()}
    for g in {d[0] for d in data}:
        s, y = [d[1] for d in data if d[0] == g], [d[2] for d in data if d[0] == g]
        for name, want in (("roc_auc", auc(s, y)), ("average_precision", ap(s, y))):
            assert got[g][name] == (want if want is None else pytest.approx(want, abs=1e-12))


@slow
@given(st.lists(st.one_of(st.floats(-1e12, 1e12), st.integers(-3, 3).map(float)), min_size=1, max_size=60))
def test_percentiles_interpolate_like_numpy(spark, xs):
    df = spark.createDataFrame([("g", x) for x in xs], "g string, x double")
    r = percentiles(df, ["g"], "x", [0.0, 0.1, 0.5, 0.9, 1.0]).first()
    want = np.percentile(xs, [0, 10, 50, 90, 100])
    assert [r[c] for c in ("p00", "p10", "p50", "p90", "p100")] == pytest.approx(list(want), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("position", [logit_position, log_position])
def test_running_totals_over_crowded_values(spark, position):
    """Values crowded at both ends, as from a well-separated model."""
    n = 3000
    df = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") % 2 == 0, (F.col("id") + 1) * 1e-12)
                               .otherwise(1 - (F.col("id") + 1) * 1e-12).alias("x"), F.lit(1).alias("w"))
    out = running_totals(df, ["g"], F.col("x"), position(F.col("x")), ["w"])
    got = [r["cum_w"] for r in out.orderBy("x").select("cum_w").collect()]
    assert got == list(range(1, n + 1))


def test_positions_rise_with_the_value(spark):
    xs = sorted([0.0, 1e-300, 1e-20, 1e-9, 0.1, 0.5, 0.9, 1 - 1e-9, 1.0])
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    p = [r[0] for r in df.orderBy("x").select(logit_position(F.col("x"))).collect()]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1


@pytest.mark.parametrize("mode", ["grid", "grid_and_scores", "scores"])
def test_threshold_modes_take_the_lowest_best(spark, mode):
    data = [("a", 0.2, 0), ("a", 0.4, 1), ("a", 0.4, 0), ("a", 0.7, 1), ("a", 0.9, 0), ("b", 0.3, 0), ("b", 0.6, 0)]
    got = {r["g"]: r for r in M.pick_threshold(spark.createDataFrame(data, DDL), ["g"], "score", "y", mode).collect()}
    if mode == "grid":
        cand = list(np.linspace(0.01, 0.99, 199))
    elif mode == "scores":
        cand = [0.0, 1.0] + [d[1] for d in data]
    else:
        cand = list(np.linspace(0.01, 0.99, 197)) + [0.5] + [d[1] for d in data]
    for g in "ab":
        s = np.array([d[1] for d in data if d[0] == g])
        y = np.array([d[2] for d in data if d[0] == g])
        own = cand if mode == "grid" else [c for c in cand if c in s or c in (0.0, 1.0, 0.5) or mode == "grid_and_scores"]
        def f1(t):
            tp, fp, fn = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum(), ((s < t) & (y == 1)).sum()
            return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        best = max(f1(t) for t in own)
        assert got[g]["f1"] == pytest.approx(best)
        if mode != "grid_and_scores":
            own = own if mode == "grid" else sorted(set(own) & (set(s) | {0.0, 1.0}))
            assert got[g]["threshold"] == pytest.approx(min(t for t in own if f1(t) == best))


def test_bin_edges_by_closed_side(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.5, 0.7, 1.0)], "p double")
    left = [r[0] for r in df.select(N.equal_width_bin("p", 10, "left")).collect()]
    right = [r[0] for r in df.select(N.equal_width_bin("p", 10, "right")).collect()]
    edges = [k / 10 for k in range(11)]
    for p, a, b in zip((0.0, 0.1, 0.3, 0.5, 0.7, 1.0), left, right):
        assert a == max(k for k in range(10) if p >= edges[k])
        assert b == max([0] + [k for k in range(10) if p > edges[k]])


def test_empty_denominators(spark):
    df = spark.createDataFrame([("a", 0, 0)], "g string, y_true int, y_pred int")
    r = M.class_metrics(M.confusion(df, ["g"])).first()
    assert (r["precision"], r["recall"], r["f1"], r["fn_rate"], r["fp_rate"]) == (0.0, 0.0, 0.0, None, 0.0)


def test_ece_and_scores(spark):
    data = [("a", 0.05, 0), ("a", 0.95, 1), ("a", 1.0, 0), ("a", 0.45, 1)]
    df = spark.createDataFrame(data, DDL)
    s, y = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    want = sum(abs(y[k].mean() - s[k].mean()) * k.mean() for k in [
        (s >= b / 10) & ((s < (b + 1) / 10) | (b == 9)) for b in range(10)] if k.any())
    assert M.ece(df, ["g"], "score", "y").first()["ece"] == pytest.approx(want)
    assert M.prob_scores(df, ["g"], "score", "y").first()["brier"] == pytest.approx(((s - y) ** 2).mean())


def test_grouping_sets_expand_counts_not_rows(spark):
    """The grouping-set expansion sits above the first aggregation."""
    df = spark.range(1000).select((F.col("id") % 3).alias("h"), (F.col("id") % 2).alias("r"),
                                  (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") % 5 % 2).cast("int").alias("y_pred"))
    out = M.grouped_metrics(df, ["h", "r"], [["h"], ["h", "r"], []])
    assert rows(out.groupBy("analysis").agg(F.sum("total"))) == [("", 1000), ("h", 1000), ("h|r", 1000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = N.poisson_one(N.hash_uniform(F.lit(7), "id"))
    r = spark.range(20000).select(w.alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert r[0] == pytest.approx(1.0, abs=0.03) and r[1] == pytest.approx(1.0, abs=0.05)


@pytest.mark.parametrize("make", [lambda i: 1.7e9 + i, lambda i: 0.5 + i * 1e-9, lambda i: 1e5 + i / 1000])
def test_values_of_one_magnitude_are_spread(spark, make):
    from daymosaic.operators import running as R
    xs = [make(i) for i in range(40_000)]
    df = spark.createDataFrame([(x, 1) for x in xs], "x double, n long")
    pos = R.log_position(F.col("x"))
    slot = F.least(F.floor(pos * F.lit(float(R.SLOTS))).cast("bigint"), F.lit(R.SLOTS - 1))
    cut = R._cut_again(df.withColumn("_slot", slot).withColumn("_pos", pos), [])
    assert cut.groupBy("_slot", "_sub").count().agg(F.max("count")).first()[0] <= 2 * R.CROWDED
    got = R.percentiles(df, [], "x", [0.25, 0.5]).first()
    assert got["p25"] == pytest.approx(make(9999.75), rel=1e-12) and got["p50"] == pytest.approx(make(19999.5), rel=1e-12)


def test_rows_do_not_move_to_meet_a_small_aggregate(spark):
    """Row weights and per-key rates: broadcast after a count, whatever the session's threshold says."""
    from daymosaic.modelling.prepare import class_weight
    from daymosaic.operators import joins as J
    df = spark.range(2000).select((F.col("id") % 3).alias("region"), (F.col("id") % 2).cast("int").alias("y"))
    rates = df.groupBy("region").agg(F.avg("y").alias("rate"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (M.balance_weights(df, "region"), J.value_map(df, rates, ["region"], "rate", 0.0, "v"),
                    class_weight(df, "y", "balanced")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_repeated_key_fails_and_null_keys_do_not(spark):
    from daymosaic.operators import joins as J
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    good = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, w string")
    assert rows(J.lookup(facts, good, ["k"]), "v", "w") == [("a", "x"), ("b", None), ("c", None)]
    bad = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    for make in (lambda: J.lookup(facts, bad, ["k"]), lambda: J.join_one_to_one(facts, bad, ["k"]),
                 lambda: J.align_models(bad, bad, ["k"], ["w"], ("_a", "_b"))):
        with pytest.raises(Exception, match="key is not unique"):
            make().collect()


def test_population_deviation_scales(spark):
    from pyspark.ml.functions import vector_to_array
    from daymosaic.modelling.prepare import encoder
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 6)], "x double")
    got = [r[0] for r in encoder(["x"], [], scale=True).fit(df).transform(df).select(vector_to_array("features")[0]).collect()]
    x = np.array([1.0, 2, 3, 6])
    assert np.allclose(got, (x - x.mean()) / x.std())
