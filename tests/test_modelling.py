"""Preparation, learners, locks, calibration, bootstrap."""

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from daymosaic.modelling import evaluate as EV
from daymosaic.modelling import learners as LN
from daymosaic.modelling import prepare as PR


@pytest.fixture(scope="module")
def data(spark):
    """y depends on a and on the category; b is noise."""
    r = np.random.default_rng(1)
    a, b, c = r.normal(size=800), r.normal(size=800), r.integers(0, 3, 800)
    y = (a + (c == 2) + r.normal(scale=0.5, size=800) > 0.5).astype(int)
    return spark.createDataFrame([(i, float(x), float(z), "xyz"[k], int(t)) for i, (x, z, k, t) in
                                  enumerate(zip(a, b, c, y))], "id long, a double, b double, c string, y int").cache()


def test_imputer_uses_exact_medians_and_modes(spark):
    df = spark.createDataFrame([(1.0, "u", None), (2.0, "v", None), (None, "v", None), (10.0, None, None)],
                               "a double, c string, e double")
    imp = PR.fit_imputer(df, ["a", "e"], ["c"])
    assert imp.values == {"a": 2.0, "e": 0.0, "c": "v"}
    assert rows(imp.transform(df)) == [(1.0, "u", 0.0), (10.0, "v", 0.0), (2.0, "v", 0.0), (2.0, "v", 0.0)]


def test_unseen_categories_are_all_zeros(spark):
    train = spark.createDataFrame([("u",), ("v",)], "c string")
    test = spark.createDataFrame([("u",), ("w",)], "c string")
    m = PR.encoder([], ["c"]).fit(train)
    assert [r[0] for r in m.transform(test).select(vector_to_array("features")).collect()] == [[1.0, 0.0], [0.0, 0.0]]


@pytest.mark.parametrize("kind", ["forest", "boosted", "logistic"])
def test_learners_rank_far_above_chance(data, kind):
    train, test = data.filter("id % 2 = 0"), data.filter("id % 2 = 1")
    learner = {"forest": lambda: LN.forest("y", 20, 5), "boosted": lambda: LN.boosted("y", 10, 3),
               "logistic": lambda: LN.logistic("y", train.count())}[kind]()
    m = LN.fit(train, ["a", "b"], ["c"], learner, scale=kind == "logistic")
    p = m.score(test).withColumn("y_pred", (F.col("score") >= 0.5).cast("int")).withColumn("k", F.lit(1))
    r = EV.full_metrics(p, ["k"], "score", "y", "y_pred").first()
    assert r["roc_auc"] > 0.85 and r["f1"] > 0.7
    assert rows(EV.score_checks(p, "score")) == [(400, 0, 0)]
    if kind == "forest":
        top = LN.feature_importance(m, train).first()
        assert top["feature"] == "a"


def test_routed_model_scores_every_row_once(data):
    split = F.col("a") > 0
    m = LN.fit_routed(data, split, lambda t: LN.fit(t, ["a", "b"], ["c"], LN.forest("y", 5, 3)))
    assert rows(m.score(data).groupBy().agg(F.count("score"), F.count_distinct("id"))) == [(800, 800)]


def test_platt_improves_a_distorted_score(data):
    scored = data.withColumn("k", F.lit(1)).withColumn("score", F.when(F.col("y") == 1, 0.55).otherwise(0.5)
                                                       + (F.col("id") % 10) / 100.0)
    c = LN.fit_platt(scored, "score", "y").transform(scored, "score")
    from daymosaic.operators.metrics import prob_scores
    raw, cal = (prob_scores(c, ["k"], s, "y").first()["brier"] for s in ("score", "calibrated"))
    assert cal < raw


def test_threshold_lock_detects_change(spark, data, tmp_path):
    v = data.withColumn("score", 1 / (1 + F.exp(-F.col("a"))))
    path = str(tmp_path / "locks")
    t = EV.lock_threshold(v, path, "m", "score", "y")
    assert EV.locked_threshold(spark, path, "m", expected=t) == t
    with pytest.raises(EV.LockChanged):
        EV.locked_threshold(spark, path, "m", expected=t + 0.01)


def test_class_weights_balance(data):
    w = PR.class_weight(data, "y", "balanced").groupBy("y").agg(F.sum("class_weight").alias("w"))
    assert [r["w"] for r in w.collect()] == pytest.approx([400.0, 400.0])


def test_wide_categories_are_hashed_and_unseen_values_defined(spark):
    """A million values: no vocabulary is made, so the model's size does not depend on them."""
    wide = spark.range(1_000_000).select(F.concat(F.lit("e"), "id").alias("c"), (F.rand(3) * 2 - 1).alias("a")).withColumn(
        "y", (F.col("a") > 0).cast("int"))
    m = LN.fit(wide, ["a"], ["c"], LN.logistic("y", 1_000_000).setMaxIter(5), scale=True)
    kinds = [type(s).__name__ for s in m.model.stages]
    assert "HashingTF" in kinds and not any("Indexer" in k for k in kinds)
    assert len(m.model.stages[-1].coefficients) == 1 + PR.HASHED
    probe = spark.createDataFrame([("e5", 0.9), ("never seen", -0.9), (None, 0.9)], "c string, a double")
    p = [r["score"] for r in m.score(probe).collect()]
    assert p[0] > 0.6 and p[1] < 0.4 and p[2] > 0.6
    assert PR.split_by_width(wide.limit(50), ["c"], 50) == (["c"], []) and PR.split_by_width(wide, []) == ([], [])


def test_arms_run_together_as_one_after_the_other(spark, data, tmp_path):
    day = data.withColumn("date", F.make_date(F.lit(2020) + F.col("id") % 4, F.lit(10), F.lit(1)))
    arms = {"a": lambda t, y: LN.fit(t, ["a"], [], LN.logistic(y, 400), scale=True),
            "ac": lambda t, y: LN.fit(t, ["a"], ["c"], LN.logistic(y, 400), scale=True)}
    years = {"train": [2020, 2021], "val": 2022, "test": 2023}

    def run(at_once):
        return EV.run_arms(day, arms, [1, 2], lambda h: F.when(F.col("id") % 7 >= h, F.col("y")), lambda x: PR.temporal_split(x, years),
                           ["id"], str(tmp_path / f"locks{at_once}"), at_once=at_once)
    assert rows(run(4)) == rows(run(1)) and run(4).select("arm", "horizon").distinct().count() == 4

    def broken(t, y):
        raise RuntimeError("this arm fails")
    with pytest.raises(RuntimeError, match="this arm fails"):
        EV.run_arms(day, arms | {"broken": broken}, [1], lambda h: F.col("y"), lambda x: PR.temporal_split(x, years), ["id"],
                    str(tmp_path / "broken"))
