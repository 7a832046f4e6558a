"""Late rows in quarantine, keyed state and the join of two streams."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from daymosaic.streaming import ingest as ST
from daymosaic.streaming import state as SS

SCHEMA = "event_id long, ts timestamp, region string, entity string"


def deliver(spark, tmp_path, i, events):
    path = tmp_path / "in" / str(i)
    spark.createDataFrame([(k, dt.datetime(2026, 10, 1, 12) + dt.timedelta(days=d), "r", e) for k, (d, e) in enumerate(events)],
                          SCHEMA).coalesce(1).write.parquet(str(path))
    return ST.event_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], SCHEMA).schema)


def test_late_rows_are_kept_apart_and_counted(spark, tmp_path):
    late = ST.LateRows(str(tmp_path / "late"))
    for i, events in enumerate([[(10, "e"), (11, "e")], [(9, "e"), (4, "e"), (8, "f"), (20, "e")], [(9, "e"), (18, "e"), (17, "e")]]):
        ST.run_batches(deliver(spark, tmp_path, i, events), "late", late, checkpoint=late.checkpoint_path)
    assert rows(late.batches(spark), "batch_id", "rows", "late") == [(0, 2, 0), (1, 4, 2), (2, 3, 2)]
    day = F.datediff(F.to_date("ts"), F.lit(dt.date(2026, 10, 1)))
    assert rows(late.refused(spark).select("batch_id", day.alias("d"))) == [(1, 4), (1, 8), (2, 17), (2, 9)]
    assert late.accepted(spark).count() == 5
    late(spark.read.parquet(str(tmp_path / "in" / "2")), 2)  # a replayed batch overwrites its own rows, judged by the same line
    assert rows(late.batches(spark), "batch_id", "rows", "late") == [(0, 2, 0), (1, 4, 2), (2, 3, 2)] and late.refused(spark).count() == 4


def history(spark, events):
    """The features of a batch recompute."""
    from daymosaic.operators import lags as L
    from daymosaic.plans.live import HISTORY_FEATURES
    df = spark.createDataFrame([(dt.date(2026, 10, 1) + dt.timedelta(days=d), "r", e) for d, e in events], "date date, region string, entity string")
    by = ["region", "entity"]
    c = df.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("event_count"))
    span = c.groupBy(*by).agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    f = L.lag_days(span.join(c, [*by, "date"], "left").fillna({"event_count": 0}), by, {"event_count": "event"}, (1, 3, 7))
    return L.rolling_mean_prev(f, by, "event_count", HISTORY_FEATURES)


def test_keyed_state_equals_a_batch_recompute(spark, tmp_path):
    """Late events within the watermark, an earlier first day, a long silence after which the ring was trimmed, a restart for each."""
    batches = [[(10, "e"), (11, "e"), (11, "e"), (11, "f")], [(12, "e"), (10, "e"), (10, "f"), (12, "f")], [(13, "e"), (11, "f")],
               [(40, "e")], [(41, "e"), (42, "e"), (41, "e")], [(43, "f")]]
    keep = SS.KeepNewest(str(tmp_path / "keep"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for i, events in enumerate(batches):
            s = SS.rolling_features(deliver(spark, tmp_path, i, events))
            q = ST.run_batches(s, "keyed", keep, "update", keep.checkpoint_path)
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    want = history(spark, [e for b in batches for e in b])
    cols = ["region", "entity", "date", "event_count", "event_lag_1d", "event_lag_3d", "event_lag_7d", "event_mean_3d", "event_mean_7d"]
    assert rows(keep.rows(spark), *cols) == rows(want, *cols)
    assert state <= 2 * (17 + 1 + 20)  # rings, spans and timers of two entities


def test_streams_join_and_close(spark, tmp_path):
    t = lambda d: dt.datetime(2026, 10, 1) + dt.timedelta(days=d)
    p_schema, c_schema = "prediction_time timestamp, region string, entity string, risk_label string", (
        "count_time timestamp, region string, entity string, event_count long")
    parts = [([(t(1), "r", "e", "x"), (t(2), "r", "e", "x"), (t(2), "r", "f", "x")], [(t(1), "r", "e", 3)]),
             ([(t(6), "r", "e", "x")], [(t(2), "r", "f", 1), (t(6), "q", "e", 9)]),  # a count comes late, another region's is no match
             ([(t(12), "r", "e", "x")], [(t(12), "r", "e", 5), (t(13), "r", "e", 6)])]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, (p, c) in enumerate(parts):
        for name, data, schema in (("p", p, p_schema), ("c", c, c_schema)):
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / name / str(i)))
        two = [ST.event_stream(spark, str(tmp_path / n / "*"), spark.createDataFrame([], s).schema) for n, s in (("p", p_schema), ("c", c_schema))]
        ST.run_to_table(SS.join_counts(*two), "joined", path=out, checkpoint=state)
    got = rows(spark.read.parquet(out).select(F.dayofmonth("prediction_time").alias("d"), "entity", "event_count"))
    assert got == [(13, "e", 5), (2, "e", 3), (3, "e", None), (3, "f", 1), (7, "e", None)]


