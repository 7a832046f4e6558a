"""Unions, differences, intersections."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymosaic.operators import sets as S
from daymosaic.suite.base import DAY_KEYS, observed, panel, query, scored, side


@query("union_history_live", """SELECT region, entity, date, event_count FROM obs WHERE year(date) < 2001
  UNION ALL SELECT region, entity, date, event_count FROM obs WHERE year(date) = 2001""")
def union_history_live(spark, d):
    o = observed(spark, d).select(*DAY_KEYS, "event_count")
    return S.union(o.filter(F.year("date") < 2001), o.filter(F.year("date") == 2001))


@query("union_missing", """SELECT 'model' AS method, horizon, count(*) AS rows, NULL::DOUBLE AS mae
    FROM scored GROUP BY horizon
  UNION ALL SELECT 'baseline', horizon, count(*), avg(abs(count_now - y_true)) FROM scored
    GROUP BY horizon""")
def union_missing(spark, d):
    s = scored(spark, d)
    a = s.groupBy(F.lit("model").alias("method"), "horizon").agg(F.count(F.lit(1)).alias("rows"))
    b = s.groupBy(F.lit("baseline").alias("method"), "horizon").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(F.col("count_now") - F.col("y_true"))).alias("mae"))
    return S.union_missing(a, b)


@query("keys_equal", """SELECT (SELECT count(*) FROM panel p ANTI JOIN obs o
    ON p.region = o.region AND p.entity = o.entity AND p.date = o.date) AS left_only,
  0::BIGINT AS right_only, (SELECT count(*) FROM panel) = (SELECT count(*) FROM obs) AS equal""")
def keys_equal(spark, d):
    return S.keys_equal(panel(spark, d), observed(spark, d), DAY_KEYS)


@query("difference", """SELECT region, entity, date FROM panel EXCEPT
  SELECT region, entity, date FROM obs""")
def difference(spark, d):
    return S.difference(panel(spark, d), observed(spark, d), DAY_KEYS)


@query("intersect", """SELECT region, entity, date FROM obs INTERSECT
  SELECT region, entity, date FROM side WHERE side_count > 0""")
def intersect(spark, d):
    return S.intersect(observed(spark, d), side(spark, d).filter("side_count > 0"), DAY_KEYS)


@query("distinct_keys", "SELECT DISTINCT region, entity, date FROM ev")
def distinct_keys(spark, d):
    from daymosaic.suite.base import events
    return S.distinct(events(spark, d), DAY_KEYS)
