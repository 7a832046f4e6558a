"""Streams over the events table, drained to tables in the shared folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymosaic.functions.text import risk_label
from daymosaic.session import run_folder
from daymosaic.streaming import ingest as ST
from daymosaic.streaming import live as SL
from daymosaic.streaming import state as SS
from daymosaic.suite.base import query, table


def keyed(df):
    return df.withColumns({"region": F.concat(F.lit("R"), ((F.col("user_id") % 45) % 2).cast("string")),
                           "entity": F.concat(F.lit("E"), (F.col("user_id") % 45).cast("string"))})


def stream(spark, d):
    schema = table(spark, d, "events").schema
    return ST.event_stream(spark, d, schema, name_filter="events.parquet")


KEYED = """(SELECT *, 'R' || (user_id % 45) % 2 AS region, 'E' || user_id % 45 AS entity,
  CAST(ts AS DATE) AS date FROM events)"""


@query("ingest_stream", "SELECT event_id, ts, user_id, value FROM events")
def ingest_stream(spark, d):
    """Every event delivered twice; the copies are dropped within the watermark."""
    twice = stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    path, _ = ST.run_to_table(ST.ingest(twice, ["event_id"]).drop("copy"), "ingested")
    return spark.read.parquet(path).select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "value")


@query("daily_counts_stream", f"""SELECT date, region, entity, count(*) AS event_count FROM {KEYED} k
  GROUP BY ALL HAVING date + 1 <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def daily_counts_stream(spark, d):
    """Append mode: the days whose end the watermark has passed."""
    path, _ = ST.run_to_table(ST.daily_counts(keyed(stream(spark, d)), ["region", "entity"]), "daily")
    return spark.read.parquet(path)


CUTS = (dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 20))


def deliveries(spark, d):
    """The events' folder and its three deliveries in order of arrival: newest days, the days before, the oldest."""
    e = table(spark, d, "events")
    new, old = F.lit(CUTS[0]), F.lit(CUTS[1])
    parts = [e.filter(F.col("ts") >= new), e.filter((F.col("ts") >= old) & (F.col("ts") < new)), e.filter(F.col("ts") < old)]
    return run_folder(spark, "deliveries"), e.schema, parts


FILES = 4


def delivered(spark, d, drain):
    """Write each delivery and drain it with a query that stops and is started again for the next one."""
    path, schema, parts = deliveries(spark, d)
    for i, part in enumerate(parts):
        part.write.parquet(f"{path}/{i}")
        drain(ST.event_stream(spark, path + "/*", schema))


@query("late_data_watermark", """SELECT date, user_id, count(*) AS event_count
  FROM (SELECT *, CAST(ts AS DATE) AS date FROM events) WHERE ts >= TIMESTAMP '2024-01-20'
    OR date + 1 > (SELECT max(ts) FROM events) - INTERVAL 2 DAY
  GROUP BY ALL HAVING date + 1 <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def late_data_watermark(spark, d):
    """One delivery a batch. A watermark takes effect one batch after it was reached, so the third delivery comes too late
    and its closed days are refused."""
    path, schema, parts = deliveries(spark, d)
    for i, part in enumerate(parts):
        part.repartition(FILES).write.parquet(f"{path}/{i}")
    files = ST.event_stream(spark, path + "/*", schema, files_per_trigger=FILES)
    out, _ = ST.run_to_table(ST.daily_counts(files, ["user_id"]), "late")
    return spark.read.parquet(out)


def judged(spark, d):
    """Three deliveries, the newest days first, judged by the days that were closed when each came."""
    late = ST.LateRows(run_folder(spark, "late-rows"))
    delivered(spark, d, lambda s: ST.run_batches(s, "late-rows", late, checkpoint=late.checkpoint_path))
    return late


OPEN = f"(ts >= TIMESTAMP '{CUTS[0]}' OR date + 1 > (SELECT max(ts) FROM events) - INTERVAL 2 DAY)"


@query("late_data_stream", f"""SELECT date, user_id, count(*) FILTER (WHERE {OPEN}) AS event_count,
    count(*) FILTER (WHERE NOT {OPEN}) AS dropped FROM (SELECT *, CAST(ts AS DATE) AS date FROM events) GROUP BY ALL""")
def late_data_stream(spark, d):
    """Accepted and refused rows by day and user; late rows go to quarantine and are counted."""
    late = judged(spark, d)
    by = [F.to_date("ts").alias("date"), "user_id"]
    kept = late.accepted(spark).groupBy(*by).agg(F.count(F.lit(1)).alias("event_count"))
    gone = late.refused(spark).groupBy(*by).agg(F.count(F.lit(1)).alias("dropped"))
    return kept.join(gone, ["date", "user_id"], "full").fillna(0, ["event_count", "dropped"])


@query("late_batches", f"""WITH b AS (SELECT CASE WHEN ts >= TIMESTAMP '{CUTS[0]}' THEN 0 WHEN ts >= TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END
    AS batch_id, ts, {OPEN} AS accepted FROM (SELECT *, CAST(ts AS DATE) AS date FROM events))
  SELECT batch_id, count(*) AS rows, count(*) FILTER (WHERE NOT accepted) AS late, CAST(max(ts) AS DATE) AS newest
  FROM b GROUP BY batch_id""")
def late_batches(spark, d):
    """The records that the batches left."""
    return judged(spark, d).batches(spark).withColumn("newest", F.to_date("newest"))


def rolled(spark, d):
    rolling = SL.RollingFeatures(run_folder(spark, "rolling"))
    delivered(spark, d, lambda s: ST.run_batches(keyed(s), "rolling", rolling, checkpoint=rolling.checkpoint_path))
    return rolling


ROLLED = f"""WITH c AS (SELECT region, entity, date, count(*) AS event_count FROM {KEYED} k GROUP BY ALL),
  b AS (SELECT region, entity, min(date) AS a, max(date) AS z FROM c GROUP BY ALL),
  s AS (SELECT region, entity, CAST(g AS DATE) AS date FROM b, generate_series(a, z, INTERVAL 1 DAY) t(g)),
  p AS (SELECT s.*, coalesce(event_count, 0) AS event_count FROM s LEFT JOIN c ON c.region = s.region
    AND c.entity = s.entity AND c.date = s.date)
  SELECT *, lag(event_count, 1) OVER w AS event_lag_1d, lag(event_count, 3) OVER w AS event_lag_3d,
    lag(event_count, 7) OVER w AS event_lag_7d,
    CASE WHEN count(*) OVER w3 = 3 THEN avg(event_count) OVER w3 END AS event_mean_3d,
    CASE WHEN count(*) OVER w7 = 7 THEN avg(event_count) OVER w7 END AS event_mean_7d FROM p
  WINDOW w AS (PARTITION BY region, entity ORDER BY date),
    w3 AS (PARTITION BY region, entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    w7 AS (PARTITION BY region, entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


@query("rolling_state_stream", ROLLED)
def rolling_state_stream(spark, d):
    """Older events arrive in later batches and correct the lags of later days."""
    return rolled(spark, d).features(spark)


@query("rolling_keyed_state", ROLLED)
def rolling_keyed_state(spark, d):
    """The same rows from keyed state: four deliveries in order of time, the query stopped and started again for each."""
    e = keyed(table(spark, d, "events"))
    source, keep = run_folder(spark, "ordered"), SS.KeepNewest(run_folder(spark, "keyed-state"))
    low, high = e.agg(F.unix_timestamp(F.min("ts").cast("timestamp")), F.unix_timestamp(F.max("ts").cast("timestamp"))).first()
    part = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - low) * 4 / F.lit(high - low + 1))
    for i in range(4):
        e.filter(part == i).write.parquet(f"{source}/{i}")
        files = ST.event_stream(spark, source + "/*", e.schema)
        ST.run_batches(SS.rolling_features(files), "keyed-state", keep, "update", keep.checkpoint_path)
    return keep.rows(spark)


def score(df):
    p = (F.col("event_count") % 10).cast("double") / F.lit(10.0)
    return df.withColumn("risk_probability", p).withColumn("risk_label", risk_label("risk_probability", 0.5))


def scored_history(spark, d):
    """Features streamed from disk, scored, upserted."""
    rolling = rolled(spark, d)
    source = run_folder(spark, "feature-files")
    rolling.features(spark).write.parquet(source)
    f = ST.event_stream(spark, source, spark.read.parquet(source).schema)
    path = run_folder(spark, "history")
    ST.run_batches(f, "score", SL.ScoreStream(path, score))
    return path


DAILY = f"""c AS (SELECT region, entity, date, count(*) AS event_count FROM {KEYED} k GROUP BY ALL),
  b AS (SELECT region, entity, min(date) AS a, max(date) AS z FROM c GROUP BY ALL),
  s AS (SELECT region, entity, CAST(g AS DATE) AS date FROM b, generate_series(a, z, INTERVAL 1 DAY) t(g)),
  h AS (SELECT s.date + 1 AS prediction_date, s.region, s.entity,
    (coalesce(event_count, 0) % 10)::DOUBLE / 10::DOUBLE AS risk_probability,
    CASE WHEN coalesce(event_count, 0) % 10 >= 5 THEN 'Elevated' ELSE 'Normal' END AS risk_label
    FROM s LEFT JOIN c ON c.region = s.region AND c.entity = s.entity AND c.date = s.date)"""


@query("score_stream", f"WITH {DAILY} SELECT * FROM h")
def score_stream(spark, d):
    return spark.read.parquet(scored_history(spark, d)).select(
        F.col("prediction_date").cast("date").alias("prediction_date"), "region", "entity",
        "risk_probability", "risk_label")


@query("verify_stream", f"""WITH {DAILY}, v AS (SELECT h.*, c.event_count AS actual_count FROM h LEFT JOIN c
    ON c.region = h.region AND c.entity = h.entity AND c.date = h.prediction_date)
  SELECT *, CASE WHEN actual_count > 2 THEN 'Elevated' WHEN actual_count IS NOT NULL THEN 'Normal' END AS actual_risk,
    CASE WHEN actual_count IS NULL THEN 'Pending' WHEN (actual_count > 2) = (risk_label = 'Elevated') THEN 'Correct'
      ELSE 'Incorrect' END AS verification_status,
    CASE WHEN actual_count IS NULL THEN 'Pending' WHEN actual_count > 2 AND risk_label = 'Elevated' THEN 'True Positive'
      WHEN actual_count <= 2 AND risk_label = 'Normal' THEN 'True Negative' WHEN risk_label = 'Elevated'
      THEN 'False Positive' ELSE 'False Negative' END AS error_type FROM v""")
def verify_stream(spark, d):
    """Counts arrive as a stream, a day spread over several batches, with a stop in the middle; predictions past the
    last day stay Pending."""
    history = scored_history(spark, d)
    source = run_folder(spark, "actual-files")
    counts = keyed(table(spark, d, "events")).groupBy(F.to_date("ts").alias("date"), "region", "entity").agg(
        F.count(F.lit(1)).alias("event_count"))
    verify, state = SL.VerifyStream(history, run_folder(spark, "tracker")), run_folder(spark, "verify-state")
    for half in (0, 1):
        counts.filter(F.pmod(F.xxhash64("entity"), F.lit(2)) == half).repartition(2, "entity").write.parquet(f"{source}/{half}")
        actuals = ST.event_stream(spark, source + "/*", counts.schema, files_per_trigger=1)
        ST.run_batches(actuals, "verify", verify, checkpoint=state)
    return verify.tracker(spark)


JOINED = f"""{DAILY}, j AS (SELECT h.prediction_date, h.region, h.entity, h.risk_label, c.event_count AS actual_count
    FROM h LEFT JOIN c ON c.region = h.region AND c.entity = h.entity AND c.date = h.prediction_date),
  l AS (SELECT least(max(prediction_date), (SELECT max(date) FROM c)) - 2 AS line FROM h)"""


@query("verify_join_stream", f"""WITH {JOINED} SELECT *, CASE WHEN actual_count IS NULL THEN 'Pending'
    WHEN (actual_count > 2) = (risk_label = 'Elevated') THEN 'Correct' ELSE 'Incorrect' END AS verification_status
  FROM j, l WHERE actual_count IS NOT NULL OR prediction_date + 1 <= line""".replace("SELECT *, CASE", "SELECT j.*, CASE"))
def verify_join_stream(spark, d):
    """Predictions and daily counts as two streams in day order, counts a day late, with a stop after each of three
    deliveries. A prediction without a count is Pending once both streams are past its day."""
    history = spark.read.parquet(scored_history(spark, d)).select(
        F.col("prediction_date").cast("timestamp").alias("prediction_time"), "region", "entity", "risk_label")
    counts = keyed(table(spark, d, "events")).groupBy(F.to_date("ts").cast("timestamp").alias("count_time"), "region", "entity").agg(
        F.count(F.lit(1)).alias("event_count"))
    source, out, state = (run_folder(spark, x) for x in ("two-streams", "verified", "verified-state"))
    low, high = history.agg(F.min("prediction_time"), F.max("prediction_time")).first()
    cuts = [low + (high - low) * i / 3 for i in range(1, 3)] + [high + dt.timedelta(days=1)]
    since = low - dt.timedelta(days=2)
    for i, cut in enumerate(cuts):
        mine = F.col("prediction_time")
        history.filter((mine >= F.lit(since)) & (mine < F.lit(cut))).write.parquet(f"{source}/predictions/{i}")
        its = F.date_add(F.to_date("count_time"), 1 if i < 2 else 0).cast("timestamp")  # a day late, but for the last ones
        before = F.date_add(F.to_date("count_time"), 1).cast("timestamp")
        counts.filter(((before >= F.lit(since)) if i else F.lit(True)) & (its < F.lit(cut))).write.parquet(f"{source}/counts/{i}")
        since = cut
        two = [ST.event_stream(spark, f"{source}/{x}/*", f.schema) for x, f in (("predictions", history), ("counts", counts))]
        ST.run_to_table(SS.join_counts(*two), "verified", path=out, checkpoint=state)
    status = F.when(F.col("actual_count").isNull(), "Pending").when(
        (F.col("actual_count") > 2) == (F.col("risk_label") == "Elevated"), "Correct").otherwise("Incorrect")
    return spark.read.parquet(out).select(
        F.to_date("prediction_time").alias("prediction_date"), "region", "entity", "risk_label",
        F.col("event_count").alias("actual_count")).withColumn("verification_status", status)
