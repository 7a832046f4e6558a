"""Scoring, threshold locks, experiments over arms and horizons."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymosaic.functions.numeric import close_to
from daymosaic.modelling.learners import TASK_ROWS
from daymosaic.operators import metrics as M
from daymosaic.session import materialise
from daymosaic.sources.sinks import read_run_record, run_record, write_run_record

#: Fits that run at the same time.
AT_ONCE = 4


def score_checks(df: DataFrame, score: str) -> DataFrame:
    """One row: rows, missing scores, scores outside [0, 1]."""
    s = F.col(score)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(s.isNull() | F.isnan(s)).alias("missing"),
                  F.count_if((s < 0) | (s > 1)).alias("outside"))


class LockChanged(ValueError):
    """The threshold in use is not the one that was locked."""


def lock_threshold(validation: DataFrame, path: str, name: str, score: str, y: str,
                   candidates: str = "grid") -> float:
    """Pick the threshold on validation rows and write it down before the test is read."""
    best = M.pick_threshold(validation.withColumn("_name", F.lit(name)), ["_name"], score, y, candidates).first()
    write_run_record(run_record(validation.sparkSession, f"threshold-lock:{name}",
                                {"threshold": repr(best["threshold"]), "validation_f1": repr(best["f1"])}), path)
    return best["threshold"]


def locked_threshold(spark, path: str, name: str, expected: float | None = None) -> float:
    """Read a lock back; with ``expected``, fail if it differs."""
    rows = read_run_record(spark, path).filter(F.col("kind") == f"threshold-lock:{name}").select(
        F.col("values")["threshold"].cast("double").alias("t")).distinct().take(2)
    if len(rows) != 1:
        raise LockChanged(f"{name}: {len(rows)} different locks")
    if expected is not None and rows[0]["t"] != expected:
        raise LockChanged(f"{name}: locked {rows[0]['t']}, in use {expected}")
    return rows[0]["t"]


def full_metrics(scored: DataFrame, keys: Sequence[str], score: str, y: str, pred: str) -> DataFrame:
    """Confusion, ratios, ROC AUC and average precision per key."""
    a = M.class_metrics(M.confusion(scored, keys, y, pred))
    return a.join(M.rank_metrics(scored, keys, score, y).select(*keys, "roc_auc", "average_precision"), list(keys))


def run_arms(data: DataFrame, arms: Mapping[str, Callable[[DataFrame, str], object]],
             horizons: Sequence[int], target: Callable[[int], object], splits: Callable[[DataFrame], Mapping[str, DataFrame]],
             keep: Sequence[str], lock_path: str, candidates: str = "grid", at_once: int = AT_ONCE) -> DataFrame:
    """Long predictions (arm, horizon, keys, y_true, score, threshold, y_pred).

    An arm is a function (train, label) -> model with ``score``. The threshold is locked on the validation rows before the
    test rows are scored. Rows with all targets are stored once. A fit is many small jobs that leave executors idle in between, so
    ``at_once`` fits are submitted from threads, each in a job group and a pool of its own: with the FAIR scheduler they share
    the executors evenly, and a failed fit cancels the jobs of the others.
    """
    spark = data.sparkSession
    sc = spark.sparkContext
    # few rows are one file: the order in which files are listed, and so that of sums in a fit, changes from run to run
    files = max(1, math.ceil(data.count() / TASK_ROWS))
    stored = materialise(data.withColumns({f"__y_{h}": target(h) for h in horizons}).coalesce(files), "arms")
    run = uuid.uuid4().hex[:8]

    def one(arm: str, h: int) -> DataFrame:
        name = f"{arm}+{h}d"
        sc.setJobGroup(f"{run}:{name}", name, interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", f"{run}:{name}")
        labelled = stored.withColumn("y_true", F.col(f"__y_{h}")).drop(*[f"__y_{x}" for x in horizons])
        parts = splits(labelled.filter(F.col("y_true").isNotNull()))
        model = arms[arm](parts["train"], "y_true")
        own = f"{lock_path}/{name}"  # locks are appended, and appends to one folder exclude each other
        lock_threshold(model.score(parts["val"]), own, name, "score", "y_true", candidates)
        t = locked_threshold(spark, own, name)
        p = model.score(parts["test"]).select(
            F.lit(arm).alias("arm"), F.lit(h).alias("horizon"), *keep, "y_true", "score",
            F.lit(t).alias("threshold"), (F.col("score") >= t).cast("int").alias("y_pred"))
        return materialise(p, f"predictions-{arm}-{h}")

    todo = [(arm, h) for h in horizons for arm in arms]
    with ThreadPoolExecutor(min(at_once, len(todo))) as pool:
        fits = [pool.submit(inheritable_thread_target(spark)(one), *x) for x in todo]
        try:
            done = [f.result() for f in fits]
        except BaseException:
            for f in fits:
                f.cancel()
            for arm, h in todo:
                sc.cancelJobGroup(f"{run}:{arm}+{h}d")
            raise
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return out


def reproduction_gate(metrics: DataFrame, expected: DataFrame, keys: Sequence[str], value: str,
                      tolerance: float) -> DataFrame:
    """Re-derived metric against the frozen one, with a pass flag per row."""
    e = expected.select(*keys, F.col(value).alias("expected"))
    j = e.join(metrics.select(*keys, F.col(value).alias("actual")), list(keys), "left")
    return j.withColumn("passed", close_to("actual", "expected", tolerance))


def swap_columns(a: DataFrame, b: DataFrame, keys: Sequence[str], swap: Sequence[str]) -> DataFrame:
    """Table ``a`` with the given columns taken from ``b`` at the same keys."""
    rest = [c for c in a.columns if c not in swap]
    return a.select(*rest).join(b.select(*keys, *swap), list(keys)).select(*a.columns)
