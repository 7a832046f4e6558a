"""Skeletons, fills, lookups, reconciliation, upserts, priors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymosaic.functions.calendar import day_of_season, season_dates
from daymosaic.operators import joins as J
from daymosaic.operators import panel as P
from daymosaic.suite.base import (DAY_KEYS, KEYS, ROW_KEYS, YEARS, entities, events, observed, years,
                                  panel, query, scored, side, table)
from daymosaic.suite.base import define


@query("calendar_skeleton", "SELECT region, entity, date FROM skel")
def calendar_skeleton(spark, d):
    return P.skeleton(entities(spark, d), KEYS, season_dates(years(spark, d)))


@query("zero_fill_all", "SELECT * FROM panel")
def zero_fill_all(spark, d):
    return panel(spark, d)


define("panel_nulls", """SELECT k.region, k.entity, k.date, coalesce(event_count, 0) AS event_count,
  coalesce(measure_sum, 0.0) AS measure_sum, measure_mean, measure_max,
  coalesce(high_count, 0) AS high_count FROM skel k LEFT JOIN obs o
  ON k.region = o.region AND k.entity = o.entity AND k.date = o.date""", "skel", "obs")


@query("zero_fill_counts_only", "SELECT * FROM panel_nulls")
def zero_fill_counts_only(spark, d):
    skel = P.skeleton(entities(spark, d), KEYS, season_dates(years(spark, d)))
    obs = observed(spark, d).select(*DAY_KEYS, "event_count", "measure_sum", "measure_mean",
                                    "measure_max", "high_count")
    return P.zero_fill(skel, obs, DAY_KEYS, ["event_count", "measure_sum", "high_count"])


@query("join_one_to_one", """SELECT p.region, p.entity, p.date, event_count, side_value, side_count
  FROM panel p JOIN side s ON p.region = s.region AND p.entity = s.entity AND p.date = s.date""")
def join_one_to_one(spark, d):
    return J.join_one_to_one(panel(spark, d).select(*DAY_KEYS, "event_count"),
                             side(spark, d).select(*DAY_KEYS, "side_value", "side_count"), DAY_KEYS)


@query("lookup_many_to_one", """SELECT p_brand, p_type, count(*) AS n, count(p_partkey) AS matched
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def lookup_many_to_one(spark, d):
    dim = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand",
                                         "p_type", F.lit(1).alias("found"))
    j = J.lookup(table(spark, d, "lineitem").select("l_partkey"), dim, ["l_partkey"])
    return j.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"),
                                              F.count("found").alias("matched"))


@query("lookup_report", """SELECT count(*) AS rows, count(quality) AS matched,
  count(*) FILTER (WHERE quality IS NULL) AS unmatched
  FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id""")
def lookup_report(spark, d):
    j = J.lookup(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"),
                 ["doc_id"])
    return J.lookup_report(j, "quality")


define("sitew", """SELECT s_suppkey AS cell, entity, region, CASE WHEN side = 0 THEN w ELSE 1 - w END
    AS area_weight FROM (SELECT s_suppkey, s_nationkey, (1 + s_suppkey % 8) / 16.0::DOUBLE AS w
    FROM supplier), (VALUES (0), (1)) t(side), ent
  WHERE n_nationkey = (s_nationkey + side * 5) % 25""", "ent")


def site_weights(spark, d):
    """Each supplier's site overlaps two entities with complementary weights."""
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("cell"), "s_nationkey",
        ((1 + F.col("s_suppkey") % 8) / F.lit(16.0)).alias("w"))
    two = s.select("cell", F.explode(F.array(
        F.struct(F.col("s_nationkey").alias("n_nationkey"), F.col("w").alias("area_weight")),
        F.struct(((F.col("s_nationkey") + 5) % 25).alias("n_nationkey"),
                 (1 - F.col("w")).alias("area_weight")))).alias("p")).select("cell", "p.*")
    return two.join(entities(spark, d), "n_nationkey").select("cell", *KEYS, "area_weight")


@query("weighted_split", """WITH c AS (SELECT l_suppkey AS cell, date, count(*) AS n FROM ev GROUP BY ALL)
  SELECT w.region, w.entity, c.date, sum(n * area_weight) AS event_count_weighted
  FROM c JOIN sitew w ON c.cell = w.cell GROUP BY ALL""")
def weighted_split(spark, d):
    counts = events(spark, d).groupBy(F.col("l_suppkey").alias("cell"), "date").agg(
        F.count(F.lit(1)).alias("event_count"))
    return P.weighted_split(counts, site_weights(spark, d), "cell", DAY_KEYS)


@query("seasonal_prior", """WITH h AS (SELECT *, date - make_date(year(date), 10, 1) + 1 AS dos FROM obs),
  pr AS (SELECT region, entity, dos, avg(event_count) AS prior FROM h WHERE year(date) < (SELECT max(year(l_shipdate)) FROM lineitem)
    GROUP BY ALL),
  l AS (SELECT *, date - make_date(year(date), 10, 1) + 1 AS dos FROM skel WHERE year(date) = (SELECT max(year(l_shipdate)) FROM lineitem))
  SELECT l.region, l.entity, l.date, coalesce(o.event_count::DOUBLE, pr.prior) AS event_count,
    o.event_count IS NULL AND pr.prior IS NOT NULL AS filled_event_count
  FROM l LEFT JOIN obs o ON l.region = o.region AND l.entity = o.entity AND l.date = o.date
  LEFT JOIN pr ON l.region = pr.region AND l.entity = pr.entity AND l.dos = pr.dos""")
def seasonal_prior(spark, d):
    """The newest season, its empty days filled from the seasons before."""
    newest = max(years(spark, d))
    o = observed(spark, d).select(*DAY_KEYS, "event_count")
    skel = P.skeleton(entities(spark, d), KEYS, season_dates([newest]))
    live = skel.join(o, DAY_KEYS, "left").withColumn("day_of_season", day_of_season("date"))
    hist = o.filter(F.year("date") < newest).withColumn("day_of_season", day_of_season("date"))
    return J.seasonal_prior(live, hist, [*KEYS, "day_of_season"], ["event_count"]).select(
        *DAY_KEYS, "event_count", "filled_event_count")


@query("align_models", """SELECT region, horizon, count(*) AS n,
  sum(y_pred)::BIGINT AS positive_a, sum(y_pred_b)::BIGINT AS positive_b,
  count(*) FILTER (WHERE y_pred <> y_pred_b) AS differ FROM scored GROUP BY ALL""")
def align_models(spark, d):
    s = scored(spark, d)
    keys = [*ROW_KEYS, "horizon"]
    a = s.select(*keys, "region", F.col("score").alias("p"), F.col("y_pred").alias("pred"))
    b = s.select(*keys, F.col("score_b").alias("p"), F.col("y_pred_b").alias("pred"))
    j = J.align_models(a, b, keys, ["p", "pred"], ("_a", "_b"), shared=["region"])
    return j.groupBy("region", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred_a").alias("positive_a"),
        F.sum("pred_b").alias("positive_b"),
        F.count_if(F.col("pred_a") != F.col("pred_b")).alias("differ"))


@query("upsert", """SELECT region, entity, date, event_count, NULL::VARCHAR AS note FROM obs
    WHERE year(date) < 2001 AND NOT (year(date) = 2000 AND month(date) = 11)
  UNION ALL SELECT region, entity, date, event_count + 100, 'revised' FROM panel
    WHERE date >= DATE '2000-11-01'""")
def upsert(spark, d):
    hist = observed(spark, d).filter(F.year("date") < 2001).select(*DAY_KEYS, "event_count")
    new = panel(spark, d).filter(F.col("date") >= F.lit(dt.date(2000, 11, 1))).select(
        *DAY_KEYS, (F.col("event_count") + 100).alias("event_count"),
        F.lit("revised").alias("note"))
    return J.upsert(hist, new, DAY_KEYS)


@query("semi_filter", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def semi_filter(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    line = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("k"))
    return J.semi_filter(o, line, ["k"]).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


@query("anti_report", """SELECT DISTINCT o_orderkey AS k FROM orders WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_report(spark, d):
    return J.anti_report(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")),
                         table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("reconcile", """SELECT count(*) FILTER (WHERE o.date IS NOT NULL AND s.date IS NOT NULL) AS both,
  count(*) FILTER (WHERE s.date IS NULL) AS left_only,
  count(*) FILTER (WHERE o.date IS NULL) AS right_only,
  max(abs(o.event_count - s.side_count)) AS max_abs_difference
  FROM obs o FULL JOIN (SELECT * FROM side_obs) s
  ON o.region = s.region AND o.entity = s.entity AND o.date = s.date""")
def reconcile(spark, d):
    s = side(spark, d).filter("side_count > 0").withColumnRenamed("side_count", "event_count")
    return J.reconcile(observed(spark, d), s, DAY_KEYS, "event_count")


@query("value_map_rate", """WITH r AS (SELECT entity, avg(y_true) AS rate FROM scored WHERE year(date) = 1995
    AND region <> 'ASIA' GROUP BY entity),
  g AS (SELECT avg(y_true) AS rate FROM scored WHERE year(date) = 1995)
  SELECT s.region, s.entity, count(*) AS n, coalesce(max(r.rate), (SELECT rate FROM g)) AS rate
  FROM scored s LEFT JOIN r ON s.entity = r.entity WHERE year(date) > 1995 GROUP BY s.region, s.entity""")
def value_map_rate(spark, d):
    s = scored(spark, d)
    train = s.filter(F.year("date") == 1995)
    rates = train.filter(F.col("region") != "ASIA").groupBy("entity").agg(
        F.avg("y_true").alias("rate"))
    everywhere = train.agg(F.avg("y_true")).scalar()
    out = J.value_map(s.filter(F.year("date") > 1995), rates, ["entity"], "rate", everywhere, "rate")
    return out.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("rate"))


@query("phase_column", """SELECT CASE WHEN month(date) = 10 THEN 'Early season'
  WHEN month(date) = 11 AND day(date) <= 15 THEN 'Middle season'
  WHEN month(date) = 11 THEN 'Late season' ELSE 'Other' END AS phase, count(*) AS n
  FROM ev GROUP BY 1""")
def phase_column(spark, d):
    return events(spark, d).groupBy(J.phase_column("date", J.PHASES_WHOLE_OCTOBER, "Other")
                                    .alias("phase")).agg(F.count(F.lit(1)).alias("n"))


RANGES = [(p["name"], dt.date(y, *p["start"]), dt.date(y, *p["end"]))
          for y in YEARS for p in J.PHASES_BOUNDED]


@query("phase_join", f"""SELECT r.phase, year(e.date)::INTEGER AS year, count(*) AS n FROM ev e
  LEFT JOIN (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in RANGES)})
  r(phase, a, b) ON e.date BETWEEN r.a AND r.b GROUP BY ALL""")
def phase_join(spark, d):
    ranges = spark.createDataFrame(RANGES, "phase string, start_date date, end_date date")
    return J.phase_join(events(spark, d), ranges).groupBy(
        "phase", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
