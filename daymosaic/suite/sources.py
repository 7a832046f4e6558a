"""Readers, payload parsers, windows and writers over exports of the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daymosaic.functions.calendar import AUTUMN
from daymosaic.session import run_folder
from daymosaic.sources import events as SE
from daymosaic.sources import polygons as PG
from daymosaic.sources import side as SS
from daymosaic.sources import sinks as SK
from daymosaic.sources import windows as SW
from daymosaic.suite.base import DAY_KEYS, KEYS, define, observed, panel, query, table

EVENT_DDL = "event_id bigint, ts string, user_id bigint, event_type string, value double"


def events_csv(spark, d):
    """The events table as CSV files in the shared folder."""
    path = run_folder(spark, "events-csv")
    e = table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "user_id", "event_type", "value")
    SK.write_table(e, path, fmt="csv")
    return path


@query("read_events_csv", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, user_id, event_type, value
  FROM events""")
def read_events_csv(spark, d):
    return SE.read_events(spark, events_csv(spark, d), EVENT_DDL)


@query("read_pruned", "SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def read_pruned(spark, d):
    df = SE.read_pruned(spark, f"{d}/lineitem.parquet", ["l_suppkey", "l_quantity"])
    return df.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"))


@query("read_many", """SELECT horizon, count(*) AS n, sum(quantity) AS quantity FROM (
  SELECT l_linenumber AS horizon, l_quantity AS quantity FROM lineitem) GROUP BY horizon""")
def read_many(spark, d):
    """One folder per horizon, read together; the horizon comes from the file path."""
    path = run_folder(spark, "by-horizon")
    line = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("horizon"), F.col("l_quantity").alias("quantity"))
    SK.write_table(line, path, ["horizon"], fmt="csv")
    df = SE.read_many(spark, [path], "quantity double, horizon int")
    return df.filter(F.col("source_file").endswith(".csv")).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("scan_large", """SELECT l_returnflag, p_brand, count(*) AS n, sum(l_quantity) AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def scan_large(spark, d):
    """Read, join, write partitioned, read back: the chunked append without chunks."""
    path = run_folder(spark, "joined")
    line = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    SK.write_table(line.join(part, line.l_partkey == part.p_partkey)
                   .select("l_returnflag", "p_brand", "l_quantity"), path, ["l_returnflag"])
    return spark.read.parquet(path).groupBy("l_returnflag", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


REQUIRED = ("event_id", "ts", "user_id", "value")


def bodies(spark, d):
    """One downloaded body per event: good, error text, empty, a column short, or with a quoted comma and a broken line."""
    e = table(spark, d, "events")
    head = "value,event_id,user_id,ts"
    line = F.concat_ws(",", F.col("value").cast("string"), F.col("event_id").cast("string"),
                       F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    body = (F.when(F.col("event_type") == "error", "Error: quota exceeded\n")
            .when(F.col("event_type") == "view", "  \n")
            .when(F.col("user_id") % 10 == 0, F.concat(F.lit("value,event_id\n"), F.lit("1,2\n")))
            .when(F.col("user_id") % 10 == 1, F.concat(F.lit(head + "\n"), line, F.lit('\n"1,5",2,3,2024-01-01\n7,8\n')))
            .otherwise(F.concat(F.lit(head + "\n"), line, F.lit("\n"))))
    return e.select(F.col("event_id").cast("string").alias("source"), body.alias("body"))


@query("parse_event_payloads", """SELECT CAST(event_id AS VARCHAR) AS source, event_id,
  CAST(ts AS DATE) AS ts, user_id, value FROM events
  WHERE event_type NOT IN ('error', 'view') AND user_id % 10 <> 0
  UNION ALL SELECT CAST(event_id AS VARCHAR), 2, DATE '2024-01-01', 3, NULL FROM events
  WHERE event_type NOT IN ('error', 'view') AND user_id % 10 = 1""")
def parse_event_payloads(spark, d):
    return SE.parse_event_payloads(bodies(spark, d), "event_id bigint,ts date,user_id bigint,value double",
                                   REQUIRED)


@query("rejected_payloads", """SELECT CAST(event_id AS VARCHAR) AS source, CASE event_type
  WHEN 'error' THEN 'error' WHEN 'view' THEN 'empty' ELSE CASE WHEN user_id % 10 = 1 THEN 'bad_line'
    ELSE 'missing_columns' END END AS status, CASE WHEN event_type NOT IN ('error', 'view') AND user_id % 10 = 1
    THEN '7,8' END AS line FROM events WHERE event_type IN ('error', 'view') OR user_id % 10 IN (0, 1)""")
def rejected_payloads(spark, d):
    b = bodies(spark, d)
    return SE.rejected_bodies(b, REQUIRED).withColumn("line", F.lit(None).cast("string")).unionByName(
        SE.rejected_lines(b, REQUIRED))


def map_bodies(spark, d):
    """Per order a parameter -> date -> value document; some lack a date, some hold -999 or a text."""
    o = table(spark, d, "orders")
    key = lambda k: F.date_format(F.date_add("o_orderdate", k), "yyyyMMdd")
    price = F.when(F.col("o_orderkey") % 7 == 0, -999.0).otherwise(F.col("o_totalprice"))
    text = lambda c: c.cast("string")
    first = F.create_map(key(0), F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(text(price)),
                         key(1), text(F.col("o_custkey").cast("double")))
    short = F.create_map(key(0), F.lit("1.0"))
    full = F.create_map(key(0), F.lit("1.0"), key(1), F.lit("2.0"))
    second = F.when(F.col("o_orderkey") % 10 == 0, short).otherwise(full)
    doc = F.to_json(F.struct(F.struct(F.create_map(
        F.lit("T2M"), first, F.lit("RH2M"), second).alias("parameter")).alias("properties")))
    return o.select(F.col("o_orderkey").cast("string").alias("source"), doc.alias("body"))


@query("parse_parameter_maps", """SELECT CAST(o_orderkey AS VARCHAR) AS source,
    CAST(o_orderdate AS DATE) + k AS date,
    CASE WHEN k = 1 THEN o_custkey::DOUBLE WHEN o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS "T2M",
    (1 + k)::DOUBLE AS "RH2M" FROM orders, (VALUES (0), (1)) t(k) WHERE o_orderkey % 10 <> 0""")
def parse_parameter_maps(spark, d):
    return SS.parse_parameter_maps(map_bodies(spark, d), ["T2M", "RH2M"])


@query("parameter_map_rejects", """SELECT CAST(o_orderkey AS VARCHAR) AS source FROM orders
  WHERE o_orderkey % 10 = 0""")
def parameter_map_rejects(spark, d):
    return SS.map_rejects(map_bodies(spark, d), ["T2M", "RH2M"])


FIELDS = {"temperature_2m_mean": "T2M", "wind_speed_10m_mean": "WS2M"}


def array_bodies(spark, d):
    """Per order three parallel daily values; some documents are short or hold a NULL."""
    o = table(spark, d, "orders")
    days = F.transform(F.sequence(F.lit(0), F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(2)),
                       lambda i: F.date_format(F.date_add("o_orderdate", i), "yyyy-MM-dd"))
    wind = F.array(F.lit(1.0), F.when(F.col("o_orderkey") % 13 != 0, 2.0), F.lit(4.0))
    temp = F.array(*[F.col("o_totalprice") * k for k in (1.0, 0.5, 0.25)])
    doc = F.to_json(F.struct(F.struct(days.alias("time"), temp.alias("temperature_2m_mean"),
                                      wind.alias("wind_speed_10m_mean")).alias("daily")))
    return o.select(F.col("o_orderkey").cast("string").alias("source"), doc.alias("body"))


@query("parse_parallel_arrays", """SELECT CAST(o_orderkey AS VARCHAR) AS source,
    CAST(o_orderdate AS DATE) + k AS date, o_totalprice * t AS "T2M", w * 0.748::DOUBLE AS "WS2M"
  FROM orders, (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE), (1, 0.5::DOUBLE, 2.0::DOUBLE),
    (2, 0.25::DOUBLE, 4.0::DOUBLE)) v(k, t, w)
  WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def parse_parallel_arrays(spark, d):
    from daymosaic.operators.cleaning import WIND_10M_TO_2M, scale
    rows = SS.parse_parallel_arrays(array_bodies(spark, d), FIELDS)
    return scale(rows, {"WS2M": WIND_10M_TO_2M})


@query("parallel_array_rejects", """SELECT CAST(o_orderkey AS VARCHAR) AS source FROM orders
  WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def parallel_array_rejects(spark, d):
    return SS.array_rejects(array_bodies(spark, d), FIELDS)


@query("read_polygons", """SELECT region, entity, 'C' || n_nationkey AS code, count(DISTINCT ring_no) AS rings,
  count(*) + count(DISTINCT ring_no) AS points FROM polyedge GROUP BY ALL""")
def read_polygons(spark, d):
    """Nation shapes written as GeoJSON files and read back with discovered columns."""
    from daymosaic.suite.spatial import polygons
    coords = F.to_json(F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    feature = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'),
        F.to_json(F.struct(F.col("region").alias("STATE_UT"), F.col("entity").alias("DISTRICT"),
                           F.col("code").alias("DIST_LGD"))),
        F.lit(',"geometry":{"type":"Polygon","coordinates":'), coords, F.lit("}}]}"))
    path = run_folder(spark, "geojson")
    shapes = polygons(spark, d).repartition(25, "entity").select(feature.alias("value"))
    shapes.write.option("maxRecordsPerFile", 1).text(path)
    p = PG.read_polygons(spark, path)
    return p.select("region", "entity", "code", F.size("rings").cast("bigint").alias("rings"),
                    F.aggregate("rings", F.lit(0).cast("bigint"), lambda a, r: a + F.size(r)).alias("points"))


define("yearwin", """SELECT year, s AS window_start, least(s + 4, make_date(year, 11, 30)) AS window_end
  FROM (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) y,
    (SELECT k * 5 AS off FROM range(13) r(k)) o, LATERAL (SELECT make_date(year, 10, 1) + off::INTEGER AS s)
  WHERE s <= make_date(year, 11, 30)""")


def years_of(spark, d):
    return table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()


@query("seasonal_windows", "SELECT year::INTEGER AS year, window_start, window_end FROM yearwin")
def seasonal_windows(spark, d):
    return SW.seasonal_windows(years_of(spark, d), 5, AUTUMN)


def manifest(spark, d):
    """Windows x return flags; a window fails for a flag when too few rows came back."""
    w = SW.seasonal_windows(years_of(spark, d))
    days = w.select("year", "window_start", "window_end",
                    F.explode(F.sequence("window_start", "window_end")).alias("day"))
    line = table(spark, d, "lineitem").groupBy(
        F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("source")).agg(
        F.count(F.lit(1)).alias("rows"))
    got = days.join(line, "day").groupBy("source", "window_start").agg(F.sum("rows").alias("rows"))
    sources = w.withColumn("source", F.explode(F.array(*[F.lit(s) for s in ("A", "N", "R")])))
    m = sources.join(got, ["source", "window_start"], "left")
    return m.select("source", "year", F.col("window_start").alias("requested_start"),
                    F.col("window_end").alias("requested_end"),
                    F.when(F.coalesce("rows", F.lit(0)) >= 35, SW.SUCCESS).otherwise("FAILED").alias("status"))


define("winman", """SELECT s.source, w.year, w.window_start AS requested_start, w.window_end AS requested_end,
  CASE WHEN (SELECT count(*) FROM lineitem l WHERE l.l_returnflag = s.source AND CAST(l.l_shipdate AS DATE)
    BETWEEN w.window_start AND w.window_end) >= 35 THEN 'SUCCESS' ELSE 'FAILED' END AS status
  FROM yearwin w, (VALUES ('A'), ('N'), ('R')) s(source)""", "yearwin")


@query("window_coverage", """WITH f AS (SELECT source, year, string_agg(DISTINCT strftime(g, '%Y-%m-%d'), ';'
    ORDER BY strftime(g, '%Y-%m-%d')) AS missing_dates FROM winman,
    generate_series(requested_start, requested_end, INTERVAL 1 DAY) t(g) WHERE status <> 'SUCCESS'
    GROUP BY ALL)
  SELECT m.source, m.year::INTEGER AS year, count(*) AS requested_windows,
    count(*) FILTER (WHERE status = 'SUCCESS') AS returned_windows,
    count(*) FILTER (WHERE status <> 'SUCCESS') AS failed_windows, coalesce(max(missing_dates), '')
      AS missing_dates
  FROM winman m LEFT JOIN f ON f.source = m.source AND f.year = m.year GROUP BY m.source, m.year""")
def window_coverage(spark, d):
    return SW.window_coverage(manifest(spark, d))


@query("coverage_complete", """SELECT count(*)::BIGINT AS requested,
  count(*) FILTER (WHERE status <> 'SUCCESS') AS failed,
  count(*) = 273 AND count(*) FILTER (WHERE status <> 'SUCCESS') = 0 AS complete FROM winman""")
def coverage_complete(spark, d):
    return SW.coverage_complete(SW.window_coverage(manifest(spark, d)), 273)


@query("source_span_check", """WITH a AS (SELECT o_orderpriority AS source, min(o_orderdate)::DATE AS lo,
    max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1)
  SELECT s.source, DATE '1995-01-05' AS study_start, DATE '2001-07-28' AS study_end,
    lo AS available_min_date, hi AS available_max_date,
    coalesce(lo <= DATE '1995-01-05' AND hi >= DATE '2001-07-28', false) AS covers_full_period,
    CASE WHEN lo IS NULL THEN 'SOURCE_MISSING_OR_AMBIGUOUS' WHEN lo <= DATE '1995-01-05'
      AND hi >= DATE '2001-07-28' THEN 'OK' ELSE 'INSUFFICIENT_DATE_RANGE' END AS status
  FROM (SELECT source FROM a UNION ALL SELECT '6-NONE') s LEFT JOIN a ON a.source = s.source""")
def source_span_check(spark, d):
    avail = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(
        F.to_date(F.min("o_orderdate")).alias("min_date"), F.to_date(F.max("o_orderdate")).alias("max_date"))
    wanted = avail.select("source").unionByName(spark.range(1).select(F.lit("6-NONE").alias("source")))
    return SW.source_span_check(wanted, avail, dt.date(1995, 1, 5), dt.date(2001, 7, 28))


@query("write_partitioned", """SELECT year(date)::INTEGER AS year, region, entity, date, event_count FROM panel""")
def write_partitioned(spark, d):
    """Panel on disk by year, read back whole; a test shows that a filter on the year prunes directories."""
    path = run_folder(spark, "panel")
    p = panel(spark, d).select(*DAY_KEYS, "event_count", F.year("date").alias("year"))
    SK.write_table(p, path, ["year"], sort_by=["region", "entity", "date"])
    return spark.read.parquet(path)


@query("publish_once", "SELECT region, entity, date, event_count FROM obs")
def publish_once(spark, d):
    path = run_folder(spark, "published")
    return spark.read.parquet(SK.publish(observed(spark, d).select(*DAY_KEYS, "event_count"), path))


@query("replace_partitions", """SELECT year(date)::INTEGER AS year, region, entity, date,
  event_count + CASE WHEN year(date) = 2000 THEN 1000 ELSE 0 END AS event_count FROM obs""")
def replace_partitions(spark, d):
    path = run_folder(spark, "history")
    o = observed(spark, d).select(*DAY_KEYS, "event_count", F.year("date").alias("year"))
    SK.write_table(o, path, ["year"])
    SK.replace_partitions(o.filter("year = 2000").withColumn("event_count", F.col("event_count") + 1000),
                          path, ["year"])
    return spark.read.parquet(path)


@query("run_record", """SELECT 'manifest' AS kind, 'events' AS name, CAST(count(*) AS VARCHAR) AS value
  FROM ev GROUP BY ALL""")
def run_record(spark, d):
    from daymosaic.suite.base import events
    path = run_folder(spark, "record")
    n = events(spark, d).count()
    SK.write_run_record(SK.run_record(spark, "manifest", {"events": n}), path)
    return SK.read_run_record(spark, path).select("kind", F.explode("values").alias("name", "value"))
