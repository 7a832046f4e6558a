"""Models stored and loaded again."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymosaic.modelling import learners as LN
from daymosaic.modelling import store as ST


@pytest.fixture(scope="module")
def train(spark):
    r = np.random.default_rng(2)
    rows = [(dt.date(2024, 10, 1 + i % 20), float(x) if i % 9 else None, "xyz"[i % 3], int(x + (i % 3) > 1)) for i, x in
            enumerate(r.normal(size=300))]
    return spark.createDataFrame(rows, "date date, a double, c string, y int").cache()


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_loaded_model_scores_as_the_fitted_one(spark, train, tmp_path, kind):
    learner = {"logistic": lambda: LN.logistic("y", 300), "forest": lambda: LN.forest("y", 5, 4), "boosted": lambda: LN.boosted("y", 3, 3)}[kind]()
    fitted = LN.fit(train, ["a"], ["c"], learner, scale=kind == "logistic")
    folder = str(tmp_path / "models")
    record = ST.save_model(fitted, train, folder, "m", 3, ["a", "c"], "y", 0.4)
    assert (record["version"], record["train_rows"], record["first_date"]) == (3, 300, dt.date(2024, 10, 1))
    stored = ST.load_model(spark, folder, "m", columns=["a", "c"])
    probe = spark.createDataFrame([(None, "x"), (0.3, "unseen"), (1.0, None), (-2.0, "z")], "a double, c string")
    both = fitted.score(stored.score(probe), "again").collect()
    assert [r["risk_probability"] for r in both] == [r["again"] for r in both] and len(both) == 4


def test_versions_and_mismatches(spark, train, tmp_path):
    folder = str(tmp_path / "models")
    with pytest.raises(ST.ModelMismatch, match="no stored version"):
        ST.load_model(spark, folder, "m")
    fitted = LN.fit(train, ["a"], ["c"], LN.logistic("y", 300), scale=True)
    for v, t in ((1, 0.4), (2, 0.6)):
        ST.save_model(fitted, train, folder, "m", v, ["a", "c"], "y", t)
    assert ST.load_model(spark, folder, "m").record["threshold"] == 0.6
    assert ST.load_model(spark, folder, "m", version=1).record["threshold"] == 0.4
    for wrong in (["c", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(ST.ModelMismatch, match="trained on"):
            ST.load_model(spark, folder, "m", columns=wrong)
    stored = ST.load_model(spark, folder, "m")
    with pytest.raises(ST.ModelMismatch, match="a is missing"):
        stored.score(train.drop("a"))
    with pytest.raises(ST.ModelMismatch, match="a is int"):
        stored.score(train.withColumn("a", F.lit(1)))
    with pytest.raises(ST.ModelMismatch, match="stored already"):
        ST.save_model(fitted, train, folder, "m", 2, ["a", "c"], "y", 0.4)
    with pytest.raises(ST.ModelMismatch, match="threshold"):
        ST.save_model(fitted, train, folder, "m", 4, ["a", "c"], "y", 1.5)
