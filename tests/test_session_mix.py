"""Queries share one session: a stream step must not keep a fitted model from scoring."""

from pyspark.sql import functions as F

from daymosaic.modelling import learners as LN
from daymosaic.streaming import ingest as ST


def test_logistic_model_scores_after_the_late_row_step(spark, tmp_path):
    late = ST.LateRows(str(tmp_path / "late"))
    for i in range(2):
        late(spark.sql(f"SELECT {i} AS id, TIMESTAMP '2026-10-0{i + 1} 12:00:00' AS ts"), i)
    assert late.batches(spark).count() == 2
    df = spark.range(200).select((F.rand(3) * 2 - 1).alias("a")).withColumn("y", (F.col("a") > 0).cast("int"))
    m = LN.fit(df, ["a"], [], LN.logistic("y", 200), scale=True)
    assert m.score(spark.createDataFrame([(0.9,)], "a double")).first()["score"] > 0.5
