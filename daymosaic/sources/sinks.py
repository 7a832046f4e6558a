"""Tables, publication and run records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                sort_by: Sequence[str] = ()) -> str:
    """Write a table, clustered by its partition columns so that each directory
    gets few files. AQE splits a partition value that holds most of the rows."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    w = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return path


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write once; an existing target is an error. The committer moves the files
    into place only when every task is done."""
    return write_table(df, path, fmt=fmt)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> str:
    """Overwrite only the partitions present in ``df``."""
    (df.hint("rebalance", *partition_by).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
    return path


def run_record(spark: SparkSession, kind: str, values: Mapping[str, object]) -> DataFrame:
    """One row (kind, created_at, values) for configs, manifests, locks, failures."""
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (str(k), str(v))])
    return spark.range(1).select(F.lit(kind).alias("kind"),
                                 F.current_timestamp().alias("created_at"), table.alias("values"))


def write_run_record(record: DataFrame, path: str) -> str:
    record.write.mode("append").json(path)
    return path


def read_run_record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, created_at timestamp, values map<string,string>").json(path)
