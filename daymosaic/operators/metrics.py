"""Classification metrics, ranking metrics, calibration and thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymosaic.functions.numeric import (clip, equal_width_bin, ratio_or_null,
                                         ratio_or_zero)
from daymosaic.operators.joins import join_small
from daymosaic.operators.running import logit_position, running_totals

CELLS = ("tp", "tn", "fp", "fn")


def _cells(y: Column, p: Column, weight: Column | None = None) -> list[Column]:
    tests = {"tp": (y == 1) & (p == 1), "tn": (y == 0) & (p == 0),
             "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0)}
    if weight is None:
        return [F.count_if(t).alias(c) for c, t in tests.items()]
    return [F.sum(F.when(t, weight).otherwise(F.lit(0))).alias(c) for c, t in tests.items()]


def confusion(df: DataFrame, keys: Sequence[str], y: str = "y_true", pred: str = "y_pred",
              weight: str | None = None) -> DataFrame:
    """TP, TN, FP, FN per key; with a weight column, weighted counts."""
    w = F.col(weight) if weight else None
    return df.groupBy(*keys).agg(*_cells(F.col(y), F.col(pred), w))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Add the ratios of a confusion table. Empty denominators give 0.0 for
    precision, recall and F1, and NULL for the error rates."""
    c = {k: F.col(k) for k in CELLS}
    n = c["tp"] + c["tn"] + c["fp"] + c["fn"]
    recall = ratio_or_zero(c["tp"], c["tp"] + c["fn"])
    specificity = ratio_or_zero(c["tn"], c["tn"] + c["fp"])
    return counts.withColumns({
        "total": n,
        "positives": c["tp"] + c["fn"],
        "predicted_positives": c["tp"] + c["fp"],
        "accuracy": ratio_or_zero(c["tp"] + c["tn"], n),
        "balanced_accuracy": (recall + specificity) / 2,
        "precision": ratio_or_zero(c["tp"], c["tp"] + c["fp"]),
        "recall": recall,
        "f1": ratio_or_zero(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
        "prevalence": ratio_or_zero(c["tp"] + c["fn"], n),
        "fp_rate": ratio_or_null(c["fp"], c["fp"] + c["tn"]),
        "fn_rate": ratio_or_null(c["fn"], c["fn"] + c["tp"]),
    })


def grouped_counts(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]],
                   aggs: Mapping[str, Column]) -> DataFrame:
    """Additive counts for many groupings from one scan.

    Rows are first reduced to one row per combination of all dimensions; the
    grouping sets then expand that small table, not the data. Adds
    ``analysis`` (the dimension names) and ``group`` (their values).
    """
    base = df.groupBy(*dims).agg(*[a.alias(n) for n, a in aggs.items()])
    flags = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    out = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(
        *[F.sum(n).alias(n) for n in aggs], *flags)
    name = F.array_join(F.array_compact(F.array(
        *[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims])), "|")
    value = F.concat_ws(" | ", *[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string"))
                                 for d in dims])
    return (out.withColumns({"analysis": name, "group": value})
            .drop(*[f"_g_{d}" for d in dims]))


def grouped_metrics(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]],
                    y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    yy, pp = F.col(y), F.col(pred)
    aggs = {"tp": F.count_if((yy == 1) & (pp == 1)), "tn": F.count_if((yy == 0) & (pp == 0)),
            "fp": F.count_if((yy == 0) & (pp == 1)), "fn": F.count_if((yy == 1) & (pp == 0))}
    return class_metrics(grouped_counts(df, dims, sets, aggs))


def agreement_counts(y: str, model: str, baseline: str) -> dict[str, Column]:
    m, b = F.col(model) == F.col(y), F.col(baseline) == F.col(y)
    return {"both_correct": F.count_if(m & b), "model_only": F.count_if(m & ~b),
            "baseline_only": F.count_if(~m & b), "both_wrong": F.count_if(~m & ~b)}


def agreement(df: DataFrame, dims: Sequence[str], y: str, model: str, baseline: str) -> DataFrame:
    """Who was right, per horizon, per horizon and region, and overall, with shares."""
    parts = list(agreement_counts(y, model, baseline))
    base = df.groupBy(*dims).agg(*[c.alias(n) for n, c in
                                   agreement_counts(y, model, baseline).items()])
    out = base.rollup(*dims).agg(*[F.sum(p).alias(p) for p in parts],
                                 F.grouping_id().alias("level"))
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return out.withColumns({"total": total} | {f"{p}_share": ratio_or_zero(p, total)
                                               for p in parts})


def transition_table(df: DataFrame, keys: Sequence[str], y: str, model: str,
                     baseline: str) -> DataFrame:
    m, b = F.col(model) == F.col(y), F.col(baseline) == F.col(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(m).alias("model_correct"), F.count_if(b).alias("baseline_correct"),
        F.count_if(m & ~b).alias("model_only"), F.count_if(~m & b).alias("baseline_only"),
    ).withColumns({"model_accuracy": ratio_or_zero("model_correct", "total"),
                   "baseline_accuracy": ratio_or_zero("baseline_correct", "total")})


def transition_recall(df: DataFrame, keys: Sequence[str], which: str, model: str,
                      baseline: str, transition_col: str = "transition") -> DataFrame:
    """Caught and missed on one transition ('N->E' onset, 'E->E' continuation).

    Every row of such a transition is positive, so accuracy equals recall.
    """
    rows = df.filter(F.col(transition_col) == which)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col(model) == 1).alias("model_caught"),
        F.count_if(F.col(model) == 0).alias("model_missed"),
        F.count_if(F.col(baseline) == 1).alias("baseline_caught"),
    ).withColumns({"model_recall": ratio_or_zero("model_caught", "events"),
                   "baseline_recall": ratio_or_zero("baseline_caught", "events")})


def reliability_bins(df: DataFrame, keys: Sequence[str], score: str, y: str, bins: int = 10,
                     closed: str = "right") -> DataFrame:
    return (df.withColumn("bin", equal_width_bin(score, bins, closed))
            .groupBy(*keys, "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
                 F.avg(y).alias("actual_rate"))
            .withColumns({"gap": F.col("mean_score") - F.col("actual_rate"),
                          "bin_low": F.col("bin") / F.lit(float(bins)),
                          "bin_high": (F.col("bin") + 1) / F.lit(float(bins))}))


def ece(df: DataFrame, keys: Sequence[str], score: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width [lo, hi) bins."""
    b = reliability_bins(df, keys, score, y, bins, closed="left")
    return b.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.abs(F.col("gap"))) / F.sum("n")).alias("ece"))


def prob_scores(df: DataFrame, keys: Sequence[str], score: str, y: str,
                eps: float = 1e-7) -> DataFrame:
    """Brier score, clipped log loss, and mean score minus actual rate."""
    p, t = F.col(score), F.col(y)
    q = clip(p, eps, 1.0 - eps)
    return df.groupBy(*keys).agg(
        F.avg((p - t) * (p - t)).alias("brier"),
        (-F.avg(F.when(t == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q)))).alias("log_loss"),
        F.avg(p).alias("mean_score"), F.avg(t).alias("actual_rate"),
    ).withColumn("score_minus_rate", F.col("mean_score") - F.col("actual_rate"))


def mae(df: DataFrame, keys: Sequence[str], actual: str, forecast: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(actual) - F.col(forecast))).alias("mae"))


def score_frame(df: DataFrame, keys: Sequence[str], score: str, y: str,
                weight: str | None = None) -> DataFrame:
    """One row per distinct score, best first, with running and total weights.

    Columns: score, pos, neg, cum_pos, cum_neg, total_pos, total_neg. Every
    curve and every ranking metric below is a fold over this frame.
    """
    w = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(F.col(y) == 0, w).otherwise(F.lit(0))).alias("neg"))
    return with_running_counts(g, keys)


def with_running_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame above from (keys, score, pos, neg) rows, one per distinct score."""
    return running_totals(counts, keys, F.col("score").desc(),
                          logit_position(F.col("score"), descending=True), ["pos", "neg"])


def rank_metrics(df: DataFrame, keys: Sequence[str], score: str, y: str,
                 weight: str | None = None) -> DataFrame:
    """Exact, tie-aware ROC AUC and average precision (step sum) per key.

    AUC is NULL when a group has one class only; AP is NULL without positives.
    """
    return fold_ranks(score_frame(df, keys, score, y, weight), keys)


def fold_ranks(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUC and AP of a score frame. Products are taken as doubles: with 1e10 rows
    per class they no longer fit a 64-bit integer."""
    pos, neg, cum_pos, cum_neg = (F.col(c).cast("double") for c in ("pos", "neg", "cum_pos", "cum_neg"))
    area = neg * (cum_pos - pos + cum_pos) / 2
    gain = F.when(pos > 0, pos * cum_pos / (cum_pos + cum_neg)).otherwise(F.lit(0.0))
    return frame.groupBy(*keys).agg(
        F.sum(area).alias("_area"), F.sum(gain).alias("_gain"),
        F.max("total_pos").alias("positives"), F.max("total_neg").alias("negatives"),
    ).withColumns({
        "roc_auc": ratio_or_null(F.col("_area"), F.col("positives").cast("double") * F.col("negatives")),
        "average_precision": ratio_or_null(F.col("_gain"), F.col("positives")),
    }).drop("_area", "_gain")


def roc_curve(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    f = score_frame(df, keys, score, y)
    return f.select(*keys, F.col("score").alias("threshold"),
                    ratio_or_null("cum_neg", "total_neg").alias("fpr"),
                    ratio_or_null("cum_pos", "total_pos").alias("tpr"))


def pr_curve(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    f = score_frame(df, keys, score, y)
    return f.select(*keys, F.col("score").alias("threshold"),
                    ratio_or_zero(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
                    .alias("precision"),
                    ratio_or_null("cum_pos", "total_pos").alias("recall"))


def grid_value(i: Column, low: float, high: float, n: int) -> Column:
    """The i-th of n evenly spaced points, the last one exactly ``high``."""
    step = (high - low) / (n - 1)
    return F.when(i == n - 1, F.lit(high)).otherwise(
        F.lit(low) + i.cast("double") * F.lit(step))


def _grid_slot(score: Column, low: float, high: float, n: int) -> Column:
    """Largest i with grid_value(i) <= score; -1 below the grid."""
    step = (high - low) / (n - 1)
    guess = F.floor((score - F.lit(low)) / F.lit(step)).cast("int")
    guess = F.greatest(F.lit(-1), F.least(F.lit(n - 1), guess))
    up = F.when((guess < n - 1) & (grid_value(guess + 1, low, high, n) <= score), guess + 1)
    down = F.when((guess >= 0) & (grid_value(guess, low, high, n) > score), guess - 1)
    return F.coalesce(up, down, guess)


def threshold_sweep(df: DataFrame, keys: Sequence[str], score: str, y: str,
                    low: float = 0.05, high: float = 0.95, n: int = 181) -> DataFrame:
    """Metrics at every grid threshold from one scan.

    Rows are counted per grid slot (partial aggregation keeps n + 1 rows per
    key and task), then summed from the top over at most n + 1 slots.
    """
    slots = df.groupBy(*keys, _grid_slot(F.col(score), low, high, n).alias("slot")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    totals = slots.groupBy(*keys).agg(F.sum("pos").alias("total_pos"),
                                      F.sum("neg").alias("total_neg"))
    every = totals.select(*keys, "total_pos", "total_neg",
                          F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    w = (Window.partitionBy(*keys).orderBy(F.col("slot").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    on = [*keys, "slot"]
    out = every.join(slots, on, "left").fillna({"pos": 0, "neg": 0}).withColumns({
        "tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "total_pos", "total_neg"))
    return out.select(
        *keys, grid_value(F.col("slot"), low, high, n).alias("threshold"), "tp", "fp",
        (pos - tp).alias("fn"), (neg - fp).alias("tn"),
        ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, pos).alias("recall"),
        ratio_or_zero(2 * tp, tp + fp + pos).alias("f1"),
        ratio_or_zero(tp + neg - fp, pos + neg).alias("accuracy"),
        ratio_or_zero(tp + fp, pos + neg).alias("predicted_positive_rate"))


# The three candidate conventions for picking a threshold.
CANDIDATES = {
    "grid": {"grid": (0.01, 0.99, 199), "scores": False, "extra": ()},
    "grid_and_scores": {"grid": (0.01, 0.99, 197), "scores": True, "extra": (0.5,)},
    "scores": {"grid": None, "scores": True, "extra": (0.0, 1.0)},
}


def pick_threshold(df: DataFrame, keys: Sequence[str], score: str, y: str,
                   candidates: str = "grid") -> DataFrame:
    """Best-F1 threshold per key, the lowest one on ties."""
    spec = CANDIDATES[candidates]
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    if not spec["scores"]:
        low, high, n = spec["grid"]
        curve = threshold_sweep(df, keys, score, y, low, high, n)
        return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", "b.f1")
    t = F.array(*[F.lit(float(x)) for x in spec["extra"]])
    if spec["grid"]:
        low, high, n = spec["grid"]
        t = F.concat(t, F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                    lambda i: grid_value(i, low, high, n)))
    counts = df.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    extra = (counts.select(*keys).distinct()
             .select(*keys, F.explode(t).alias("threshold"))
             .withColumns({"pos": F.lit(0).cast("bigint"), "neg": F.lit(0).cast("bigint")}))
    marks = counts.unionByName(extra).groupBy(*keys, "threshold").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    run = running_totals(marks, keys, F.col("threshold").desc(),
                         logit_position(F.col("threshold"), descending=True), ["pos", "neg"])
    f1 = ratio_or_zero(2 * F.col("cum_pos"),
                       F.col("cum_pos") + F.col("cum_neg") + F.col("total_pos"))
    return (run.withColumn("f1", f1).groupBy(*keys).agg(best.alias("b"))
            .select(*keys, "b.threshold", "b.f1"))


def balance_weights(df: DataFrame, group: str, out: str = "weight") -> DataFrame:
    """Row weight n / (groups x n_group), so that every group weighs the same.

    Group sizes come from an aggregate joined back, not from a window that
    would gather a whole group in one task.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    everything = sizes.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
    table = sizes.select(group, (everything / F.col("_n")).alias(out))
    return join_small(df, table, [group])


def weighted_metrics(df: DataFrame, keys: Sequence[str], y: str, pred: str, score: str,
                     weight: str) -> DataFrame:
    """F1 and average precision with row weights, per key (at least one)."""
    counts = confusion(df, keys, y, pred, weight)
    f1 = counts.select(*keys, ratio_or_zero(
        2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    ap = rank_metrics(df, keys, score, y, weight).select(*keys, "average_precision")
    return f1.join(ap, list(keys))
