"""Driver tables in the engine's roles, once for Spark and once as SQL.

events    lineitem with its supplier's nation (entity) and region; the measure
          is the quantity, the year-round multi-season point events
panel     events of October and November on the full calendar, zero-filled
side      a second daily series per entity from orders ("weather")
scored    one scored row per lineitem: score, truth, baseline, horizon
places    lineitem with an arithmetic longitude and latitude; polygons are
          derived from nation (a 5 x 5 layout of concave shapes, some with
          a hole)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymosaic.functions import text
from daymosaic.functions.calendar import in_season, season_dates
from daymosaic.operators import panel as P
from daymosaic.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

YEARS = tuple(range(1995, 2002))  # only where a report's columns must be known beforehand
KEYS = ["region", "entity"]
DAY_KEYS = ["region", "entity", "date"]
ROW_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
            "l_extendedprice"]


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is written against the prelude below."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entities(spark, d) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("region"), F.col("n_name").alias("entity"))


def events(spark, d) -> DataFrame:
    line, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return (line.join(s, line.l_suppkey == s.s_suppkey)
            .join(entities(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
            .select("region", "entity", F.col("l_shipdate").cast("date").alias("date"),
                    F.col("l_quantity").alias("measure"),
                    (F.lit(300.0) + F.col("l_partkey") % 60).alias("bright_a"),
                    (F.lit(280.0) + F.col("l_linenumber")).alias("bright_b"),
                    F.col("l_returnflag").alias("confidence"),
                    F.col("l_linestatus").alias("daynight"),
                    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_shipdate", "l_extendedprice"))


def years(spark, d) -> tuple[int, ...]:
    """The seasons from the table's first to its last date."""
    y = F.year("l_shipdate")
    first, last = table(spark, d, "lineitem").agg(F.min(y), F.max(y)).first()
    return tuple(range(first, last + 1)) if first is not None else ()


def season_events(spark, d) -> DataFrame:
    """Season rows only; the date ranges reach the Parquet scan."""
    return events(spark, d).filter(in_season(F.col("l_shipdate").cast("date"), years(spark, d)))


def observed(spark, d) -> DataFrame:
    return P.event_metrics(season_events(spark, d), DAY_KEYS,
                           high=F.col("confidence") == "R", day=F.col("daynight") == "O",
                           night=F.col("daynight") == "F")


def panel(spark, d) -> DataFrame:
    """Zero-filled, every metric (the first fill policy)."""
    skel = P.skeleton(entities(spark, d), KEYS, season_dates(years(spark, d)))
    return P.zero_fill(skel, observed(spark, d), DAY_KEYS,
                       P.COUNT_METRICS + P.SUM_METRICS + P.MEAN_METRICS)


def shared_panel(spark, d, *metrics: str) -> DataFrame:
    """The panel written once to the shared folder, for jobs that read it several
    times: the events behind it are then scanned once."""
    p = panel(spark, d)
    return materialise(p.select(*DAY_KEYS, *metrics) if metrics else p, "panel")


def side(spark, d) -> DataFrame:
    """Daily order series per entity on the panel calendar."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    daily = (o.filter(in_season(F.col("o_orderdate").cast("date"), years(spark, d)))
             .join(c, o.o_custkey == c.c_custkey)
             .join(entities(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy("region", "entity", F.col("o_orderdate").cast("date").alias("date"))
             .agg(F.round(F.sum("o_totalprice"), 2).alias("side_value"),
                  F.count(F.lit(1)).alias("side_count"),
                  F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("side_high")))
    skel = P.skeleton(entities(spark, d), KEYS, season_dates(years(spark, d)))
    return P.zero_fill(skel, daily, DAY_KEYS, ["side_value", "side_count", "side_high"])


def scored(spark, d) -> DataFrame:
    """One scored row per lineitem; every value is exact in both engines."""
    q = F.col("measure").cast("bigint")
    mix = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber") * 7) % 600
    mix2 = (F.col("l_orderkey") * 13 + F.col("l_suppkey") * 29 + F.col("l_partkey") * 5) % 600
    e = events(spark, d).select(
        "region", "entity", "date", *ROW_KEYS,
        F.col("l_linenumber").alias("horizon"),
        (F.col("measure") > 32).cast("int").alias("y_true"),
        ((q * 12 + mix).cast("double") / 1200.0).alias("score"),
        ((q * 12 + mix2).cast("double") / 1200.0).alias("score_b"),
        ((q + F.col("l_partkey")) % 6).alias("count_now"))
    e = e.withColumns({"y_pred": (F.col("score") >= 0.5).cast("int"),
                       "y_pred_b": (F.col("score_b") >= 0.55).cast("int"),
                       "now_label": (F.col("count_now") > 2).cast("int")})
    return e.withColumns({"persistence": F.col("now_label"),
                          "transition": text.transition("now_label", "y_true"),
                          "regime": text.regime("count_now")})


PRELUDE = {
    "ent": """SELECT n_nationkey, r_name AS region, n_name AS entity
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "ev": """SELECT e.region, e.entity, CAST(l.l_shipdate AS DATE) AS date, l.l_quantity AS measure,
      CAST(300 + l.l_partkey % 60 AS DOUBLE) AS bright_a,
      CAST(280 + l.l_linenumber AS DOUBLE) AS bright_b,
      l.l_returnflag AS confidence, l.l_linestatus AS daynight, l.l_orderkey, l.l_partkey,
      l.l_suppkey, l.l_linenumber, l.l_shipdate, l.l_extendedprice
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
      JOIN ent e ON s.s_nationkey = e.n_nationkey""",
    "cal": """SELECT CAST(g AS DATE) AS date FROM (SELECT make_date(min(year(l_shipdate)), 10, 1) AS first_day,
      make_date(max(year(l_shipdate)), 11, 30) AS last_day FROM lineitem) r,
      generate_series(first_day, last_day, INTERVAL 1 DAY) t(g) WHERE month(g) IN (10, 11)""",
    "obs": """SELECT region, entity, date, count(*) AS event_count, sum(measure) AS measure_sum,
      avg(measure) AS measure_mean, max(measure) AS measure_max,
      count(*) FILTER (WHERE confidence = 'R') AS high_count,
      count(*) FILTER (WHERE daynight = 'O') AS day_count,
      count(*) FILTER (WHERE daynight = 'F') AS night_count,
      avg(bright_a) AS bright_a_mean, max(bright_a) AS bright_a_max,
      avg(bright_b) AS bright_b_mean
      FROM ev WHERE month(date) IN (10, 11) GROUP BY region, entity, date""",
    "skel": "SELECT region, entity, date FROM ent, cal",
    "panel": """SELECT k.region, k.entity, k.date, coalesce(event_count, 0) AS event_count,
      coalesce(measure_sum, 0.0) AS measure_sum, coalesce(measure_mean, 0.0) AS measure_mean,
      coalesce(measure_max, 0.0) AS measure_max, coalesce(high_count, 0) AS high_count,
      coalesce(day_count, 0) AS day_count, coalesce(night_count, 0) AS night_count,
      coalesce(bright_a_mean, 0.0) AS bright_a_mean, coalesce(bright_a_max, 0.0) AS bright_a_max,
      coalesce(bright_b_mean, 0.0) AS bright_b_mean
      FROM skel k LEFT JOIN obs o ON k.region = o.region AND k.entity = o.entity
        AND k.date = o.date""",
    "side_obs": """SELECT e.region, e.entity, CAST(o.o_orderdate AS DATE) AS date,
      round(sum(o.o_totalprice), 2) AS side_value, count(*) AS side_count,
      count(*) FILTER (WHERE o.o_orderpriority = '1-URGENT') AS side_high
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN ent e ON c.c_nationkey = e.n_nationkey
      WHERE month(o.o_orderdate) IN (10, 11) GROUP BY ALL""",
    "side": """SELECT k.region, k.entity, k.date, coalesce(side_value, 0.0) AS side_value,
      coalesce(side_count, 0) AS side_count, coalesce(side_high, 0) AS side_high
      FROM skel k LEFT JOIN side_obs o ON k.region = o.region AND k.entity = o.entity
        AND k.date = o.date""",
    "scored0": """SELECT region, entity, date, l_orderkey, l_partkey, l_suppkey, l_linenumber,
      l_shipdate, l_extendedprice, l_linenumber AS horizon,
      CAST(measure > 32 AS INTEGER) AS y_true,
      CAST(CAST(measure AS BIGINT) * 12
        + (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 600 AS DOUBLE)
        / CAST(1200 AS DOUBLE) AS score,
      CAST(CAST(measure AS BIGINT) * 12
        + (l_orderkey * 13 + l_suppkey * 29 + l_partkey * 5) % 600 AS DOUBLE)
        / CAST(1200 AS DOUBLE) AS score_b,
      (CAST(measure AS BIGINT) + l_partkey) % 6 AS count_now FROM ev""",
    "scored": """SELECT *, CAST(score >= CAST(0.5 AS DOUBLE) AS INTEGER) AS y_pred,
      CAST(score_b >= CAST(0.55 AS DOUBLE) AS INTEGER) AS y_pred_b,
      CAST(count_now > 2 AS INTEGER) AS now_label,
      CAST(count_now > 2 AS INTEGER) AS persistence,
      CASE WHEN count_now > 2 THEN 'E' ELSE 'N' END || '->'
        || CASE WHEN y_true = 1 THEN 'E' ELSE 'N' END AS transition,
      CASE WHEN count_now <= 0 THEN 'No current activity'
        WHEN count_now <= 2 THEN 'Low current activity'
        ELSE 'Elevated current activity' END AS regime FROM scored0""",
}
NEEDS = {"ev": ["ent"], "obs": ["ev"], "skel": ["ent", "cal"], "panel": ["skel", "obs"],
         "side_obs": ["ent"], "side": ["skel", "side_obs"], "scored0": ["ev"],
         "scored": ["scored0"]}


def oracle_sql() -> dict[str, str]:
    """Every registered SQL with the shared views it needs in front."""
    return {name: compose(sql) for name, sql in ORACLE.items()}


def define(name: str, sql: str, *needs: str) -> None:
    """Add a shared SQL view to the prelude."""
    PRELUDE[name] = sql
    NEEDS[name] = list(needs)


def compose(sql: str) -> str:
    """Put the prelude views a query mentions in front of it.

    A query may start with its own views: 'WITH a AS (...) SELECT ...'.
    """
    import re

    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for n in NEEDS.get(name, []):
            need(n)
        order.append(name)

    for name in PRELUDE:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    views = [f"{n} AS ({PRELUDE[n]})" for n in order]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        body = body[5:]
        return "WITH " + ",\n".join([*views, body]) if views else sql
    return ("WITH " + ",\n".join(views) + "\n" + body) if views else body
