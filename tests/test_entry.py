"""The driver contract, on the smallest scale."""

import math

import pytest

import __spark_entry__ as entry
import tools_check as tc

SF = "/root/testdata/sf0.001"
FAST = ["flagship_persistence", "lag_days", "grouped_metrics", "roc_auc", "pick_threshold_scores", "describe",
        "point_in_polygon_inner", "cell_overlaps", "assign_cells", "features_trend", "window_coverage",
        "verify_predictions", "dedup_events", "keys_equal", "daily_counts_stream"]


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["region", "horizon"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in tc.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    a = sorted((tuple(tc.canon(r[df.columns.index(c)]) for c in order) for r in df.collect()), key=tc.key)
    b = sorted((tuple(tc.canon(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=tc.key)
    assert a == b
    assert not any(isinstance(x, float) and math.isinf(x) for r in a for x in r)
