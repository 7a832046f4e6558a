"""Parsing, filtering, validating and de-duplicating driver rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymosaic.functions import text
from daymosaic.functions.calendar import horizon_days, in_season
from daymosaic.operators import cleaning as C
from daymosaic.suite.base import DAY_KEYS, KEYS, events, years, panel, query, scored, table

# text dates, one form per event type, so that some rows do not parse
RAW_DATE = """CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END"""


def raw_events(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("raw_date", F.when(F.col("event_type") == "error", "n/a")
                        .otherwise(F.date_format("ts", "yyyy-MM-dd")))


@query("parse_date", f"""SELECT date, count(*) AS n FROM (SELECT TRY_CAST({RAW_DATE} AS DATE) AS date
  FROM events) WHERE date IS NOT NULL GROUP BY date""")
def parse_date(spark, d):
    return C.parse_date(raw_events(spark, d), "raw_date").groupBy("date").agg(
        F.count(F.lit(1)).alias("n"))


@query("parse_date_keep_bad", f"""SELECT date, count(*) AS n FROM (SELECT TRY_CAST({RAW_DATE} AS DATE)
  AS date FROM events) GROUP BY date""")
def parse_date_keep_bad(spark, d):
    return C.parse_date(raw_events(spark, d), "raw_date", keep_bad=True).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"))


RAW_NUMBER = """CASE WHEN event_type = 'error' THEN 'bad' WHEN event_type = 'view' THEN '-999'
  ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END"""


def raw_numbers(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", F.when(F.col("event_type") == "error", "bad")
                    .when(F.col("event_type") == "view", "-999")
                    .otherwise(F.floor("value").cast("string")).alias("reading"))


@query("parse_number", f"""SELECT event_id, TRY_CAST({RAW_NUMBER} AS DOUBLE) AS reading FROM events""")
def parse_number(spark, d):
    return C.parse_numbers(raw_numbers(spark, d), ["reading"]).select("event_id", "reading")


@query("sentinel_to_null", f"""SELECT event_id, CASE WHEN TRY_CAST({RAW_NUMBER} AS DOUBLE) > -900
  THEN TRY_CAST({RAW_NUMBER} AS DOUBLE) END AS reading FROM events""")
def sentinel_to_null(spark, d):
    return C.parse_numbers(raw_numbers(spark, d), ["reading"], floor=-900).select(
        "event_id", "reading")


@query("drop_null", f"""SELECT event_type, count(*) AS n FROM events
  WHERE TRY_CAST({RAW_NUMBER} AS DOUBLE) IS NOT NULL GROUP BY event_type""")
def drop_null(spark, d):
    e = C.drop_null(C.parse_numbers(raw_numbers(spark, d), ["reading"]), ["reading"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("in_season", """SELECT year(l_shipdate)::INTEGER AS year, count(*) AS n FROM lineitem
  WHERE month(l_shipdate) IN (10, 11) GROUP BY ALL""")
def in_season_(spark, d):
    line = table(spark, d, "lineitem").filter(in_season(F.to_date("l_shipdate"), years(spark, d)))
    return line.groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("date_between", """SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_shipdate
  BETWEEN TIMESTAMP '1997-10-01' AND TIMESTAMP '1998-11-30' GROUP BY l_linestatus""")
def date_between(spark, d):
    import datetime as dt
    line = table(spark, d, "lineitem").filter(F.col("l_shipdate").between(
        dt.datetime(1997, 10, 1), dt.datetime(1998, 11, 30)))
    return line.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("norm_key", """SELECT upper(trim('  ' || r_name || ' ')) AS region_key,
  upper(trim(r_name)) || '|' || lower(trim(n_name)) AS entity_key, n_nationkey
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def norm_key(spark, d):
    from daymosaic.suite.base import entities
    e = entities(spark, d).withColumn("region", F.concat(F.lit("  "), "region", F.lit(" ")))
    return C.norm_keys(e, ["region"]).select(
        F.col("region").alias("region_key"),
        text.composite_key(text.norm_upper("region"), text.norm_lower("entity")).alias("entity_key"),
        "n_nationkey")


@query("alias_value", """SELECT CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted'
  ELSE l_returnflag END AS flag, count(*) AS n FROM lineitem GROUP BY 1""")
def alias_value(spark, d):
    line = table(spark, d, "lineitem")
    flag = text.alias_value("l_returnflag", {"R": "returned", "A": "accepted"})
    return line.groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("range_check", """SELECT rule, checked, violations, violations = 0 AS passed FROM (
  SELECT 'discount in [0, 0.05]' AS rule, count(*) AS checked,
    count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05::DOUBLE)) AS violations FROM lineitem
  UNION ALL SELECT 'quantity not negative', count(*), count(*) FILTER (WHERE l_quantity < 0)
    FROM lineitem
  UNION ALL SELECT 'price finite', count(*), 0 FROM lineitem)""")
def range_check(spark, d):
    return C.range_check(table(spark, d, "lineitem"), {
        "discount in [0, 0.05]": F.col("l_discount").between(0.0, 0.05),
        "quantity not negative": F.col("l_quantity") >= 0,
        "price finite": C.finite("l_extendedprice")})


@query("flags", """SELECT region, entity, count(*) FILTER (WHERE confidence = 'R') AS high,
  count(*) FILTER (WHERE daynight = 'O') AS day, count(*) FILTER (WHERE daynight = 'F') AS night
  FROM ev GROUP BY region, entity""")
def flags(spark, d):
    f = C.flags(events(spark, d), "confidence", "daynight", ("R",), ("O",), ("F",))
    return f.groupBy(*KEYS).agg(*[F.sum(F.col(f"is_{c}").cast("int")).alias(c)
                                  for c in ("high", "day", "night")])


@query("event_id", """SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_partkey, l_suppkey,
  l_linenumber, l_shipdate, l_extendedprice)) AS ids FROM lineitem""")
def event_id(spark, d):
    from daymosaic.suite.base import ROW_KEYS
    e = table(spark, d, "lineitem").select(C.event_id(*ROW_KEYS).alias("event_id"))
    per = e.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"))


@query("dedup_events", """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey,
    l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_events(spark, d):
    line = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    newest_first = -F.unix_timestamp("l_shipdate")
    return C.dedup_events(line, ["l_orderkey"], prefer=[
        newest_first, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
        F.col("l_quantity")]).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query("dedup_report", """SELECT count(*) AS rows_before, count(DISTINCT (l_orderkey, l_linenumber))
  AS rows_after, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed FROM lineitem""")
def dedup_report(spark, d):
    return C.dedup_report(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("scale_units", """SELECT event_id, value * 0.748::DOUBLE AS value FROM events""")
def scale_units(spark, d):
    return C.scale(table(spark, d, "events"), {"value": C.WIND_10M_TO_2M}).select(
        "event_id", "value")


@query("horizon_parse", """SELECT CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) AS horizon,
  count(*) AS n FROM (SELECT '+' || horizon || 'd' AS label FROM scored) GROUP BY 1""")
def horizon_parse(spark, d):
    s = scored(spark, d).select(F.concat(F.lit("+"), F.col("horizon").cast("string"),
                                         F.lit("d")).alias("label"))
    return s.groupBy(horizon_days("label").alias("horizon")).agg(F.count(F.lit(1)).alias("n"))


@query("search_text", """SELECT region, entity, count(*) AS n FROM ev
  WHERE lower(entity) LIKE '%nation_1%' OR lower(region) LIKE '%nation_1%' GROUP BY ALL""")
def search_text(spark, d):
    return C.search(events(spark, d), "Nation_1", ["entity", "region"]).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"))


@query("to_records", """SELECT region, entity, strftime(date, '%Y-%m-%d') AS date,
  CASE WHEN event_count = 0 THEN NULL ELSE measure_sum / event_count END AS mean FROM panel""")
def to_records(spark, d):
    p = panel(spark, d).select(*DAY_KEYS, F.when(F.col("event_count") == 0, F.lit(float("nan")))
                               .otherwise(F.try_divide("measure_sum", "event_count")).alias("mean"))
    return C.to_records(p)


@query("select_features", """SELECT region, entity, date, event_count, measure_sum, high_count
  FROM panel""")
def select_features(spark, d):
    from daymosaic.operators.lags import lead_days
    f = lead_days(panel(spark, d).select(*DAY_KEYS, "event_count", "measure_sum", "high_count"),
                  KEYS, ["event_count"])
    return f.select(*DAY_KEYS, *C.select_features(f, DAY_KEYS))


@query("string_functions", """SELECT s_suppkey, lower(trim(s_name)) AS name,
  replace(s_name, 'Supplier#', 'S-') AS code, substring(s_name, 10, 4) AS part FROM supplier""")
def string_functions(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", text.norm_lower("s_name").alias("name"),
                    F.replace("s_name", F.lit("Supplier#"), F.lit("S-")).alias("code"),
                    F.substring("s_name", 10, 4).alias("part"))
