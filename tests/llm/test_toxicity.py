import numpy as np
from pyspark.sql import functions as F

from daymosaic.llm import toxicity as T

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    m = T.train(docs, labels.filter(~fold))
    rows = T.predict(docs, m).join(labels.filter(fold).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    truth = np.array([r["truth"] for r in rows]) > 0
    said = np.array([r["toxic"] for r in rows])
    assert truth.sum() > 50
    assert (said & truth).sum() / truth.sum() > 0.85 and (said & ~truth).sum() / (~truth).sum() < 0.01
    severity = np.array([r["expected_severity"] for r in rows])
    assert severity[truth].mean() > 1 > 0.2 > severity[~truth].mean()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and len(r["probabilities"]) == 4 for r in rows)


def test_cuts_are_ordered_and_grades_follow_the_evidence():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 600)
    rows = [{f"=bad{rng.integers(5)}": int(1 + 3 ** g), "=the": 3} if g else {"=the": 3, "=good": 1} for g in grade]
    m = T.fit(rows, grade, 4)
    assert (np.diff(m.cuts) > 0).all()
    expected = m.above(m.matrix(rows).astype(float)).sum(axis=1)
    means = [expected[grade == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2


def test_likelihood_gradient_reaches_a_maximum():
    grade = np.array([0] * 30 + [1] * 20 + [2] * 10)
    rows = [{"=x": 1}] * 60
    m = T.fit(rows, grade, 3)  # without telling features the cuts are the empirical ones
    assert m.names == [] and np.allclose(1 / (1 + np.exp(-m.cuts)), [0.5, 50 / 60], atol=0.02)


def test_nulls_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "x", 0.0), (1, None, 0.0), (2, "y " * 100000, 0.0), (2, "y", 0.0)],
                                 "doc_id long, text string, grade double")
    none = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    m = T.train(docs, none)
    assert m is None and [r["toxic"] for r in T.predict(docs, m).collect()] == [None] * 4
    some = spark.createDataFrame([(2, 1), (2, 0)], "doc_id long, toxic int")
    rows = T.predict(docs, T.train(docs, some)).collect()
    assert len(rows) == 4 and all(r["expected_severity"] is not None for r in rows)
    assert T.predict(docs.limit(0), m).count() == 0
