"""The vector bootstrap against plain Python that weighs row by row."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from daymosaic.modelling import bootstrap as B

MODELS = {"a": ("pred_a", "score_a"), "b": ("pred_b", "score_b"), "ties": ("pred_t", "score_t")}
M64 = (1 << 64) - 1


def weight(h, replicate):
    """Splitmix of the row's hash and the pair of replicates; the even one takes the low half."""
    if replicate == 0:
        return 1
    x = ((h & M64) + (replicate // 2 + 1) * 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    x ^= x >> 31
    u = (x >> (32 * (replicate % 2))) & 0xFFFFFFFF
    return sum(u >= e for e in B.poisson_edges())


def brute(data, replicate, pred, score):
    w = [weight(r["h"], replicate) for r in data]
    pos = sum(x for x, r in zip(w, data) if r["y_true"])
    tp = sum(x for x, r in zip(w, data) if r["y_true"] and r[pred])
    fp = sum(x for x, r in zip(w, data) if not r["y_true"] and r[pred])
    f1 = 2 * tp / (2 * tp + fp + pos - tp) if 2 * tp + fp + pos - tp else 0.0
    gain = p = n = 0
    for s in sorted({r[score] for r in data}, reverse=True):
        here = [(x, r["y_true"]) for x, r in zip(w, data) if r[score] == s]
        own = sum(x for x, y in here if y)
        p, n = p + own, n + sum(x for x, y in here if not y)
        gain += own * p / (p + n) if p + n else 0.0
    return f1, (gain / pos if pos else None)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    out = []
    for i in range(260):
        y, a = int(r.random() < 0.4), float(r.random())
        b, t = min(1.0, max(0.0, a * 0.4 + 0.5 * y)), float(r.integers(0, 3)) / 2
        out.append((i, "g%d" % (i % 3 > 0), y, int(a > 0.5), a, int(b > 0.4), b, int(t > 0), t))
    return spark.createDataFrame(out, "id long, g string, y_true int, pred_a int, score_a double, pred_b int, score_b double, "
                                      "pred_t int, score_t double")


@pytest.mark.parametrize("block,vector,at_once", [(16_384, 2_048, 256), (40, 3, 2), (7, 8, 16)])
def test_every_replicate_equals_row_by_row(data, monkeypatch, block, vector, at_once):
    """Blocks smaller than a tie, vectors cut anywhere."""
    for name, n in (("BLOCK", block), ("VECTOR", vector), ("AT_ONCE", at_once)):
        monkeypatch.setattr(B, name, n)
    models = {m: (f"pred_{c}", f"score_{c}") for m, c in (("a", "a"), ("b", "b"), ("ties", "t"))}
    got = {(r["_group"], r["model"], r["replicate"]): (r["f1"], r["average_precision"])
           for r in B.replicate_metrics(data.repartition(3), "g", ["id"], models, 9, 5).collect()}
    held = data.withColumn("h", F.xxhash64(F.lit(5), "id")).collect()
    assert len(got) == 3 * 3 * 10
    for (g, m, k), (f1, ap) in got.items():
        some = [r for r in held if g in (B.POOLED, r["g"])]
        assert (f1, ap) == pytest.approx(brute(some, k, *models[m]), abs=1e-12)


def test_draws_are_poisson():
    w = B.weights(np.arange(4000, dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0, 501)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.003 and abs(w[:, 1:].var() - 1) < 0.01
    assert abs((w[:, 1:] == 0).mean() - np.exp(-1)) < 0.003 and B.weights(np.array([7], dtype=np.uint64), 3, 9).tolist() == [
        [weight(7, k) for k in range(3, 9)]]


def test_interval_covers_repeats_and_shuffles_no_more_rows(spark, data):
    models = {"a": ("pred_a", "score_a"), "b": ("pred_b", "score_b")}
    run = lambda df, n: B.paired_bootstrap(df, "g", ["id"], models, [("a", "b")], n, 7)
    first = rows(run(data, 200))
    assert first == rows(run(data.repartition(5), 200)) and len(first) == 6
    for r in run(data, 200).collect():
        assert r["ci_lower"] < r["difference"] < r["ci_upper"] and r["valid_replicates"] == 200
        assert r["difference"] == pytest.approx(r["candidate_point"] - r["reference_point"])
    planned = B._planned(B._long(data, "g", ["id"], models, "y_true", 7))
    assert planned.count() == 260 * 2 * 2  # whatever the replicates


def test_empty_and_one_class(spark, data):
    models = {"a": ("pred_a", "score_a")}
    assert B.replicate_metrics(data.filter("id < 0"), "g", ["id"], models, 5, 1).count() == 0
    none = B.replicate_metrics(data.withColumn("y_true", F.lit(0)), "g", ["id"], models, 5, 1).collect()
    assert len(none) == 18 and all(r["average_precision"] is None and r["f1"] == 0.0 for r in none)


@pytest.mark.parametrize("crowd,block", [(1, 16_384), (2, 40), (20, 7)])
def test_crowded_scores_draw_once_and_equal_row_by_row(data, monkeypatch, crowd, block):
    """Crowded scores among others, the pooled sums of which come from the groups; no second pass over them."""
    monkeypatch.setattr(B, "CROWD", crowd)
    monkeypatch.setattr(B, "BLOCK", block)
    models = {m: (f"pred_{c}", f"score_{c}") for m, c in (("a", "a"), ("b", "b"), ("ties", "t"))}
    mixed = data.withColumn("score_a", F.when(F.col("id") % 3 == 0, F.round("score_a", 1)).otherwise(F.col("score_a")))
    got = {(r["_group"], r["model"], r["replicate"]): (r["f1"], r["average_precision"])
           for r in B.replicate_metrics(mixed.repartition(3), "g", ["id"], models, 9, 5).collect()}
    held = mixed.withColumn("h", F.xxhash64(F.lit(5), "id")).collect()
    assert len(got) == 3 * 3 * 10
    for (g, m, k), (f1, ap) in got.items():
        some = [r for r in held if g in (B.POOLED, r["g"])]
        assert (f1, ap) == pytest.approx(brute(some, k, *models[m]), abs=1e-12)
    planned = B._planned(B._long(mixed, "g", ["id"], models, "y_true", 5)).filter("model = 'ties'")
    assert planned.filter("not tie or pooled_block is null").count() == 0


def test_rows_without_truth_or_group_are_not_shared(spark, data):
    models = {"t": ("pred_t", "score_t")}
    odd = data.withColumn("score_t", F.lit(0.5))
    for c, kind in (("y_true", "int"), ("g", "string")):
        some = odd.withColumn(c, F.when(F.col("id") == 3, F.lit(None).cast(kind)).otherwise(F.col(c)))
        assert B._planned(B._long(some, "g", ["id"], models, "y_true", 5)).filter("pooled_block is not null").count() == 0
    assert B._planned(B._long(odd, "g", ["id"], models, "y_true", 5)).filter("pooled_block is null").count() == 0


def test_gathered_sums_equal_weights_by_label():
    """Labels of a few rows and of more than 256 times what a byte adds up, some rows with none."""
    r = np.random.default_rng(4)
    labels = np.where(r.random(9_000) < 0.7, 2, r.integers(-1, 400, 9_000))
    h = r.integers(0, 2 ** 63, 9_000).astype(np.uint64)
    w = np.zeros((9_001, 16), dtype=np.uint8)
    w[:-1] = B.weights(h, 0, 16)
    g = B.Gather(labels, 9_000)
    assert g.labels.tolist() == sorted(set(labels.tolist()) - {-1}) and g.again is not None
    got = g.sums(w.view(np.uint64), np.empty((len(g.rows), 2), dtype=np.uint64))
    for x, sums in zip(g.labels, got):
        assert sums.tolist() == w[:-1][labels == x].sum(axis=0, dtype=np.int64).tolist()


@pytest.mark.parametrize("share,block", [((7, 60), 16_384), ((300, 300), 11)])
def test_rows_draw_once_for_all_models_and_equal_row_by_row(data, monkeypatch, share, block):
    """Several tasks a group, or one for all; scores of one model drawn apart; predictions and scores that are missing."""
    for name, x in (("SHARE", share), ("TASKS", 3), ("BLOCK", block), ("CROWD", 2), ("SPREAD", 2), ("VECTOR", 5)):
        monkeypatch.setattr(B, name, x)
    models = {m: (f"pred_{c}", f"score_{c}") for m, c in (("a", "a"), ("b", "b"), ("ties", "t"))}
    odd = data.withColumns({"score_b": F.round("score_b", 1), "pred_b": F.when(F.col("id") % 7 > 0, F.col("pred_b")),
                            "score_t": F.when(F.col("id") % 11 > 0, F.col("score_t"))})
    counts = B._counts(B._each(odd, "g", ["id"], models, "y_true", 5))
    cells, places, size, tasks = B._cells(B._plan(counts), list(models))
    dealt = B._dealt(odd, "g", ["id"], models, "y_true", 5, cells, places, size)
    assert dealt.count() == 260 and dealt.select("task").distinct().count() == tasks  # not once for each model
    assert {r["model"] for r in cells.collect()} == {"b", "ties"}
    got = {(r["_group"], r["model"], r["replicate"]): (r["f1"], r["average_precision"])
           for r in B.replicate_metrics(odd.repartition(3), "g", ["id"], models, 9, 5).collect()}
    held = odd.withColumn("h", F.xxhash64(F.lit(5), "id")).collect()
    assert len(got) == 3 * 3 * 10
    for (g, m, k), (f1, ap) in got.items():
        pred, score = models[m]
        some = [r for r in held if g in (B.POOLED, r["g"]) and r[score] is not None]
        assert (f1, ap) == pytest.approx(brute(some, k, pred, score), abs=1e-12)
