"""Payloads, windows, sinks, history, tracker, streams."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from daymosaic.operators import history as H
from daymosaic.operators import quality as Q
from daymosaic.operators.cleaning import MissingColumns, dedup_events
from daymosaic.operators.joins import upsert
from daymosaic.plans import api
from daymosaic.sources import events as SE
from daymosaic.sources import side as SS
from daymosaic.sources import sinks as SK
from daymosaic.sources import windows as SW
from daymosaic.streaming import ingest as ST
from daymosaic.streaming import live as SL

D = dt.date


def test_bodies_are_classified_and_parsed(spark, tmp_path):
    for name, text in {"good": "lat,lon,n\n1.5,2,3\n,9,x\n", "error": "Invalid MAP_KEY.", "empty": " \n\n",
                       "short": "lat,lon\n1,2\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    bodies = SE.read_bodies(spark, str(tmp_path)).withColumn("source", F.regexp_extract("source", r"(\w+)\.csv", 1))
    need = ["lat", "lon", "n"]
    assert rows(SE.rejected_bodies(bodies, need)) == [("empty", "empty"), ("error", "error"), ("short", "missing_columns")]
    assert rows(SE.parse_event_payloads(bodies, "n int,lat double,lon double", need)) == [
        ("good", 3, 1.5, 2.0), ("good", None, None, 9.0)]


def test_no_payload_line_is_lost(spark):
    body = 'lat,n,note\n1,2,"a,b"\n1,2\n"3",4,"say ""x"""\n5,6,7,8\n'
    b = spark.createDataFrame([("s", body)], "source string, body string")
    assert rows(SE.parse_event_payloads(b, "lat double,note string", ["lat"])) == [("s", 1.0, "a,b"), ("s", 3.0, 'say "x"')]
    assert rows(SE.rejected_lines(b, ["lat"])) == [("s", "bad_line", "1,2"), ("s", "bad_line", "5,6,7,8")]


def test_a_text_value_is_null_and_no_reject(spark):
    doc = '{"properties":{"parameter":{"T":{"20240101":"x","20240102":1.5},"R":{"20240101":3,"20240102":4}}}}'
    b = spark.createDataFrame([("s", doc)], "source string, body string")
    assert rows(SS.parse_parameter_maps(b, ["T", "R"]), "T", "R") == [(1.5, 4.0), (None, 3.0)]


def test_parameter_maps_need_equal_dates(spark):
    ok = '{"properties":{"parameter":{"T":{"20240101":1.0,"20240102":-999},"R":{"20240101":3,"20240102":4}}}}'
    bad = '{"properties":{"parameter":{"T":{"20240101":1.0},"R":{"20240103":3}}}}'
    b = spark.createDataFrame([("ok", ok), ("bad", bad), ("junk", "{")], "source string, body string")
    assert rows(SS.parse_parameter_maps(b, ["T", "R"])) == [
        ("ok", D(2024, 1, 1), 1.0, 3.0), ("ok", D(2024, 1, 2), None, 4.0)]
    assert rows(SS.map_rejects(b, ["T", "R"])) == [("bad",), ("junk",)]


def test_parallel_arrays_need_three_full_days(spark):
    doc = lambda t, v: '{"daily":{"time":%s,"a":%s}}' % (t, v)
    days = '["2024-01-01","2024-01-02","2024-01-03"]'
    b = spark.createDataFrame([("ok", doc(days, "[1,2,3]")), ("null", doc(days, "[1,null,3]")),
                               ("short", doc('["2024-01-01"]', "[1]"))], "source string, body string")
    assert rows(SS.parse_parallel_arrays(b, {"a": "A"}), "date", "A") == [
        (D(2024, 1, 1), 1.0), (D(2024, 1, 2), 2.0), (D(2024, 1, 3), 3.0)]
    assert rows(SS.array_rejects(b, {"a": "A"})) == [("null",), ("short",)]


def test_windows_are_clipped_and_failures_listed(spark):
    w = SW.seasonal_windows(spark.createDataFrame([(2024,)], "year int"))
    got = rows(w, "window_start", "window_end")
    assert len(got) == 13 and got[0] == (D(2024, 10, 1), D(2024, 10, 5)) and got[-1] == (D(2024, 11, 30), D(2024, 11, 30))
    m = w.select(F.lit("s").alias("source"), "year", F.col("window_start").alias("requested_start"),
                 F.col("window_end").alias("requested_end"),
                 F.when(F.col("window_start") == D(2024, 11, 30), "FAILED").otherwise("SUCCESS").alias("status"))
    s = SW.window_coverage(m).first()
    assert (s["requested_windows"], s["failed_windows"], s["missing_dates"]) == (13, 1, "2024-11-30")
    assert SW.coverage_complete(SW.window_coverage(m), 13).first()["complete"] is False


def test_source_spans(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source string")
    avail = spark.createDataFrame([("a", D(2020, 1, 1), D(2026, 1, 1)), ("b", D(2024, 1, 1), D(2026, 1, 1)),
                                   ("c", D(2020, 1, 1), D(2026, 1, 1)), ("c", D(2020, 1, 1), D(2026, 1, 1))],
                                  "source string, min_date date, max_date date")
    got = rows(SW.source_span_check(wanted, avail, D(2023, 10, 1), D(2025, 11, 30)), "source", "status")
    assert got == [("a", "OK"), ("b", "INSUFFICIENT_DATE_RANGE"), ("c", "SOURCE_MISSING_OR_AMBIGUOUS"),
                   ("d", "SOURCE_MISSING_OR_AMBIGUOUS")]


def test_publish_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    SK.publish(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)already exists"):
        SK.publish(df, str(tmp_path / "t"))
    with pytest.raises(MissingColumns, match="nope"):
        SE.read_pruned(spark, str(tmp_path / "t"), ["id", "nope"])


def test_dedup_prefers_and_keeps_one(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("j", 2, "only")], "k string, v int, note string")
    assert rows(dedup_events(df, ["k"], [-F.col("v")]), "k", "note") == [("j", "only"), ("k", "new")]


PRED = "prediction_date date, region string, entity string, risk_probability double, risk_label string"


def predictions(spark):
    day = D(2026, 11, 1)
    return spark.createDataFrame([(day, "r", "a", 0.9, "Elevated"), (day, "r", "b", 0.1, "Normal"),
                                  (day, "r", "c", 0.9, "Elevated"), (day, "r", "d", 0.2, "Normal")], PRED)


def test_tracker_leaves_days_without_rows_pending(spark):
    actual = spark.createDataFrame([(D(2026, 11, 1), "r", "b", 1), (D(2026, 11, 1), "r", "c", 2), (D(2026, 11, 1), "r", "d", 3)],
                                   "date date, region string, entity string, event_count long")
    t = H.verify_predictions(predictions(spark), actual)
    assert rows(t, "entity", "verification_status", "error_type") == [
        ("a", "Pending", "Pending"), ("b", "Correct", "True Negative"), ("c", "Incorrect", "False Positive"),
        ("d", "Incorrect", "False Negative")]
    s = H.tracker_summary(t).first()
    assert (s["total"], s["pending"], s["verified"], s["verified_accuracy"]) == (4, 1, 3, 0.3333)
    seen = spark.createDataFrame([(D(2026, 11, 1), "r", "a")], "date date, region string, entity string")
    z = H.verify_predictions(predictions(spark), actual, observed=seen)
    assert rows(z.filter("entity = 'a'"), "actual_count", "error_type") == [(0, "False Positive")]
    none = H.tracker_summary(t.filter("verification_status = 'Pending'")).first()
    assert none["verified_accuracy"] is None


def test_summary_breaks_ties_by_name(spark):
    s = H.dashboard_summary(predictions(spark)).first()
    assert (s["elevated_count"], s["normal_count"], s["highest_risk_entity"]) == (2, 2, "a")


def test_upsert_and_validation(spark):
    p = predictions(spark)
    new = p.filter("entity = 'a'").withColumn("risk_probability", F.lit(0.3)).withColumn("note", F.lit("x"))
    out = upsert(p, new, H.KEYS)
    assert rows(out, "entity", "risk_probability", "note")[0] == ("a", 0.3, "x") and out.count() == 4
    bad = {r["name"] for r in Q.failed(api.validate(p.unionByName(p.limit(1)), 2025)).collect()}
    assert bad == {"other_years", "unique_key"}
    with pytest.raises(api.NoPredictions):
        api.found(api.predictions_on(p, D(2020, 1, 1)))


def feed(spark, tmp_path, batches):
    """One file per batch, oldest file first."""
    import os
    schema = "event_id long, ts timestamp, region string, entity string"
    for i, b in enumerate(batches):
        path = tmp_path / f"b{i}"
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return ST.event_stream(spark, str(tmp_path / "b*"), spark.createDataFrame([], schema).schema, files_per_trigger=1)


def ev(i, day, entity="e"):
    return (i, dt.datetime(2026, 10, day, 12), "r", entity)


def test_duplicates_and_late_rows(spark, tmp_path):
    batches = [[ev(1, 10), ev(2, 10)], [ev(2, 10), ev(3, 9)], [ev(4, 4), ev(5, 9)], [ev(6, 20)], [ev(7, 21)]]
    stream = feed(spark, tmp_path, batches)
    path, _ = ST.run_to_table(ST.ingest(stream, ["event_id"]), "dedup")
    assert rows(spark.read.parquet(path), "event_id") == [(i,) for i in (1, 2, 3, 5, 6, 7)]
    path, q = ST.run_to_table(ST.daily_counts(stream, ["entity"]), "counts")
    got = rows(spark.read.parquet(path), "date", "event_count")
    assert (D(2026, 10, 4), 1) not in got and (D(2026, 10, 10), 3) in got and (D(2026, 10, 9), 2) in got
    assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) == 1


def test_rolling_features_equal_a_batch_recompute(spark, tmp_path):
    """Sparse days, a late event, an event before the first day, a long silence."""
    batches = [[ev(1, 10), ev(2, 11), ev(3, 10, "f")], [ev(4, 28), ev(5, 10)], [ev(6, 2), ev(7, 20)], [ev(8, 29, "f")]]
    rolling = SL.RollingFeatures(str(tmp_path / "state"))
    ST.run_batches(feed(spark, tmp_path, batches), "rolling", rolling)
    got = {(r["entity"], r["date"].day): r for r in rolling.features(spark).collect()}
    counts = {}
    for b in batches:
        for _, ts, _, e in b:
            counts[e, ts.day] = counts.get((e, ts.day), 0) + 1
    for e in "ef":
        days = [d for x, d in counts if x == e]
        for d in range(min(days), max(days) + 1):
            r = got.pop((e, d))
            at = lambda k: counts.get((e, k), 0) if k >= min(days) else None
            assert (r["event_count"], r["event_lag_1d"], r["event_lag_3d"], r["event_lag_7d"]) == (
                at(d), at(d - 1), at(d - 3), at(d - 7))
            week = [at(d - k) for k in range(1, 8)]
            assert r["event_mean_7d"] == (None if None in week else pytest.approx(sum(week) / 7))
    assert not got


def test_rolling_state_goes_on_after_a_restart(spark, tmp_path):
    """One run per delivery on one checkpoint, with compaction, equals a run over all; a replayed batch changes nothing."""
    batches = [[ev(1, 10), ev(2, 11), ev(3, 10, "f")], [ev(4, 28), ev(5, 10)], [ev(6, 2), ev(7, 20)], [ev(8, 29, "f")], [ev(9, 11)]]
    whole = SL.RollingFeatures(str(tmp_path / "whole"))
    ST.run_batches(feed(spark, tmp_path, batches), "rolling", whole)
    schema = "event_id long, ts timestamp, region string, entity string"
    parts = SL.RollingFeatures(str(tmp_path / "parts"), compact_every=2)
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, schema)
        df.write.parquet(str(tmp_path / "later" / str(i)))
        ST.run_batches(ST.event_stream(spark, str(tmp_path / "later/*"), df.schema), "rolling", parts,
                       checkpoint=parts.checkpoint_path)
    assert rows(parts.features(spark)) == rows(whole.features(spark))
    last = spark.createDataFrame(batches[-1], schema)
    parts(last, parts.counts(spark).agg(F.max("batch_id")).first()[0])
    assert rows(parts.features(spark)) == rows(whole.features(spark))


def test_a_day_in_two_batches_stays_verified(spark, tmp_path):
    history = spark.createDataFrame([(D(2026, 10, 5), "r", e, 0.9, "Elevated") for e in "abc"],
                                    "prediction_date date, region string, entity string, risk_probability double, risk_label string")
    history.write.parquet(str(tmp_path / "history"))
    verify = SL.VerifyStream(str(tmp_path / "history"), str(tmp_path / "tracker"))
    assert {r["verification_status"] for r in verify.tracker(spark).collect()} == {"Pending"}
    for i, e in enumerate("ab"):
        df = spark.createDataFrame([(D(2026, 10, 5), "r", e, 5)], "date date, region string, entity string, event_count bigint")
        df.write.parquet(str(tmp_path / "actuals" / str(i)))
        ST.run_batches(ST.event_stream(spark, str(tmp_path / "actuals/*"), df.schema), "verify", verify,
                       checkpoint=str(tmp_path / "verify-state"))
    assert rows(verify.tracker(spark), "entity", "verification_status") == [("a", "Correct"), ("b", "Correct"), ("c", "Pending")]


def test_table_stream_goes_on_after_a_restart(spark, tmp_path):
    for i, b in enumerate([[ev(1, 10), ev(2, 10)], [ev(2, 10), ev(3, 11)]]):
        df = spark.createDataFrame(b, "event_id long, ts timestamp, region string, entity string")
        df.write.parquet(str(tmp_path / "in" / str(i)))
        ST.run_to_table(ST.ingest(ST.event_stream(spark, str(tmp_path / "in/*"), df.schema), ["event_id"]), "x",
                        path=str(tmp_path / "out"), checkpoint=str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "event_id") == [(1,), (2,), (3,)]


def test_a_year_filter_prunes_directories(spark, tmp_path):
    df = spark.createDataFrame([(1999, 1), (2000, 2), (2000, 3)], "year int, n int")
    path = SK.write_table(df, str(tmp_path / "t"), ["year"])
    one = spark.read.parquet(path).filter("year = 1999")
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
    assert rows(one) == [(1, 1999)]
