"""Event files and raw downloaded bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daymosaic.functions.text import strip
from daymosaic.operators.cleaning import require_columns
from daymosaic.schemas import EVENTS


def read_events(spark: SparkSession, path: str | Sequence[str], schema: str = EVENTS,
                fmt: str = "csv") -> DataFrame:
    """Event files with an explicit schema: no inference pass over the data."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    return reader.format(fmt).load(path)


def read_pruned(spark: SparkSession, path: str, cols: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Only the wanted columns; fails before any job when one is missing."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return require_columns(reader.load(path), cols, path).select(*cols)


def read_many(spark: SparkSession, paths: Sequence[str], schema: str, fmt: str = "csv",
              label: str = "source_file") -> DataFrame:
    """Many files as one frame, each row labelled with its file name."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(list(paths))
    return df.withColumn(label, F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(source, body): one row per downloaded file."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("source"), F.col("value").alias("body")))


def classify_bodies(bodies: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add status: ok, empty, error (first line says so) or missing_columns."""
    body = strip(F.col("body"))
    first = F.lower(strip(F.element_at(F.split(body, "\r?\n"), 1)))
    have = F.transform(F.split(first, ","), lambda c: strip(c))
    missing = F.size(F.array_except(F.array(*[F.lit(c.lower()) for c in required]), have)) > 0
    return bodies.withColumn(
        "status", F.when(body.isNull() | (body == ""), "empty")
        .when(first.startswith("invalid") | first.contains("error"), "error")
        .when(missing, "missing_columns").otherwise("ok"))


# a comma outside quotes: an even number of quotes follows it
COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    """Cells of a CSV line, unquoted and stripped."""
    return F.transform(F.split(line, COMMA, -1), lambda c: strip(F.regexp_replace(
        F.regexp_replace(strip(c), '^"(.*)"$', "$1"), '""', '"')))


def _lines(bodies: DataFrame, required: Sequence[str]) -> DataFrame:
    """(source, line, cells, header) of the data lines of good bodies."""
    good = classify_bodies(bodies, required).filter("status = 'ok'")
    lines = F.split(strip(F.col("body")), "\r?\n")
    header = _cells(F.lower(F.element_at(lines, 1)))
    rows = good.select("source", header.alias("header"), F.explode(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line")
    ).filter(strip("line") != "")
    return rows.withColumn("cells", _cells(F.col("line")))


def parse_event_payloads(bodies: DataFrame, schema: str, required: Sequence[str]) -> DataFrame:
    """Rows of the good bodies. The header gives each file's own column order.

    Cells may be quoted. ``rejected_lines`` lists the lines that do not fit the header.
    """
    rows = _lines(bodies, required).filter(F.size("cells") == F.size("header"))
    cells = F.map_from_arrays("header", F.transform("cells", lambda c: F.nullif(c, F.lit(""))))
    rows = rows.select("source", cells.alias("cells"))
    out = []
    for field in schema.split(","):
        name, kind = field.strip().split(" ")
        out.append(F.try_element_at("cells", F.lit(name.lower())).try_cast(kind).alias(name))
    return rows.select("source", *out)


def rejected_lines(bodies: DataFrame, required: Sequence[str]) -> DataFrame:
    """(source, status, line) of lines with more or fewer cells than their header."""
    bad = _lines(bodies, required).filter(F.size("cells") != F.size("header"))
    return bad.select("source", F.lit("bad_line").alias("status"), "line")


def rejected_bodies(bodies: DataFrame, required: Sequence[str]) -> DataFrame:
    return classify_bodies(bodies, required).filter("status <> 'ok'").select("source", "status")
