"""Metrics, bootstrap, drift and model operators beyond the SQL comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardflow.functions.resample import poisson_weights
from cardflow.operators import bootstrap as B
from cardflow.operators import drift as R
from cardflow.operators import metrics as M
from cardflow.operators import model


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(600) < 0.25).astype(int)
    a, b = np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1).round(2), np.clip(rng.normal(0.3 + 0.2 * y, 0.2), 0, 1)
    return spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(600)], "id long, y int, a double, b double")


@pytest.mark.parametrize("mean", [1, 3, 40, 5000])
def test_poisson_weights(mean):
    w = poisson_weights(np.full(400, mean), np.arange(400) - 200, np.arange(500), 9)
    assert w.mean() == pytest.approx(mean, rel=0.01)
    assert w.var() == pytest.approx(mean, rel=0.05)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2


def test_bootstrap_surrounds_the_observed_values(preds):
    points = M.curve(preds, "y", "a")
    ap, auc = M.average_precision(points).first()[0], M.roc_auc(points).first()[0]
    got = {r["metric"]: r for r in B.bootstrap(preds, "y", "a", 0.5, replicates=400).collect()}
    assert got["pr_auc"]["mean"] == pytest.approx(ap, abs=0.02) and got["roc_auc"]["mean"] == pytest.approx(auc, abs=0.02)
    at = M.confusion(preds, "y", "a", 0.5).first()
    for name in ("precision", "recall", "f1", "mcc"):
        assert got[name]["mean"] == pytest.approx(at[name], abs=0.03)
        assert got[name]["ci_lower"] < at[name] < got[name]["ci_upper"]
    assert got["f1"]["n_valid"] == 400


def test_bootstrap_does_not_depend_on_slices(preds, monkeypatch):
    def run():
        one = {r["metric"]: tuple(r)[1:] for r in B.bootstrap(preds, "y", "a", 0.5, replicates=50).collect()}
        two = tuple(B.paired_bootstrap(preds, "y", "a", "b", replicates=50).first())[1:]
        return one, two

    whole = run()
    monkeypatch.setattr(B, "GROUPS_PER_SLICE", 9)
    pieces = run()
    for name in whole[0]:
        assert pieces[0][name] == pytest.approx(whole[0][name], rel=1e-9)
    assert pieces[1] == pytest.approx(whole[1], rel=1e-9)


def test_paired_bootstrap_of_equal_scores_is_zero(preds):
    got = B.paired_bootstrap(preds.withColumn("c", F.col("a")), "y", "a", "c", replicates=50).first()
    assert (got["mean"], got["ci_lower"], got["ci_upper"]) == (0.0, 0.0, 0.0)


def test_curve_per_group(preds):
    both = preds.withColumn("g", F.col("id") % 2)
    got = {r["g"]: r["roc_auc"] for r in M.roc_auc(M.curve(both, "y", "a", ["g"]), ["g"]).collect()}
    for g in (0, 1):
        alone = M.roc_auc(M.curve(both.filter(F.col("g") == g), "y", "a")).first()[0]
        assert got[g] == pytest.approx(alone)


def test_sliced_curve(preds, limit):
    limit(10)
    sliced = M.average_precision(M.curve(preds, "y", "b")).first()[0]
    limit(10_000)
    assert M.average_precision(M.curve(preds, "y", "b")).first()[0] == pytest.approx(sliced)


def test_confusion_of_nothing_is_zero(spark):
    got = M.confusion(spark.createDataFrame([(0, 0.1)], "y int, p double"), "y", "p", 0.5).first()
    assert (got["precision"], got["recall"], got["f1"], got["mcc"]) == (0.0, 0.0, 0.0, 0.0)


def test_unknown_metric_is_refused(preds):
    with pytest.raises(ValueError):
        M.select_threshold(M.curve(preds, "y", "a"), "accuracy")


def test_psi_clip_modes(spark):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 4 < 1).cast("double").alias("b"))
    model_ = R.fit_psi(ref, ["x", "b"], [])
    none = {r["feature"]: r["psi"] for r in R.psi_numeric(model_, ref, "none").collect()}
    inner = {r["feature"]: r["psi"] for r in R.psi_numeric(model_, ref, "inner").collect()}
    assert none["x"] == pytest.approx(0.0) and inner["x"] > 1.0 and none["b"] == inner["b"] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        R.psi_numeric(model_, ref, "outer")


def test_small_monitoring_window_is_refused(spark):
    with pytest.raises(ValueError):
        R.drift_trigger(spark.createDataFrame([("x", 0.5)], "feature string, psi double"), rows=49_999)


def test_drift_windows_count_every_row(spark):
    df = spark.range(0, 1001).select(F.col("id").alias("t"), F.lit(0).alias("y"), F.lit(1.0).alias("a"), F.lit("c").alias("k"))
    rows = R.drift_windows(df, "t", "y", "a", "k", 7).collect()
    assert sum(r["rows"] for r in rows) == 1001 and max(r["window"] for r in rows) == 7


def test_trained_model_ranks(spark, preds):
    config = model.TreeConfig(iterations=5, depth=3)
    train, val = preds.filter("id < 400"), preds.filter("id >= 400")
    fitted = model.train_gbt(train, ["a", "b"], "y", config, val)
    scored = model.score(val, fitted, ["id", "y"])
    assert M.roc_auc(M.curve(scored, "y", "probability")).first()[0] > 0.7
    weights = model.importance(spark, fitted, ["a", "b"]).collect()
    assert sum(r["importance"] for r in weights) == pytest.approx(1.0)


def plain_resampling(preds, times=600):
    """Rows drawn with replacement, the metrics by their definitions."""
    rows = np.array([(r["y"], r["a"], r["b"]) for r in preds.collect()])
    rng, out = np.random.default_rng(3), {k: [] for k in (*B.METRICS, "delta")}

    def precision(y, s):
        cut = np.unique(s)[::-1]
        taken = [(y[s >= c].sum(), (s >= c).sum()) for c in cut]
        gained = np.diff([0] + [t for t, _ in taken])
        return sum(g * t / n for g, (t, n) in zip(gained, taken)) / y.sum()

    for _ in range(times):
        y, a, b = rows[rng.integers(0, len(rows), len(rows))].T
        up, down = a[y == 1][:, None], a[y == 0][None, :]
        tp, fp, fn, tn = ((a >= 0.5) & (y == 1)).sum(), ((a >= 0.5) & (y == 0)).sum(), ((a < 0.5) & (y == 1)).sum(), ((a < 0.5) & (y == 0)).sum()
        out["pr_auc"].append(precision(y, a))
        out["roc_auc"].append(((up > down) + 0.5 * (up == down)).mean())
        out["precision"].append(tp / (tp + fp))
        out["recall"].append(tp / (tp + fn))
        out["f1"].append(2 * tp / (2 * tp + fp + fn))
        out["mcc"].append((tp * tn - fp * fn) / np.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
        out["delta"].append(precision(y, b) - out["pr_auc"][-1])
    return {k: np.array(v) for k, v in out.items()}


def test_bootstrap_agrees_with_plain_resampling(preds):
    some = preds.filter("id < 200")
    want = plain_resampling(some)
    got = {r["metric"]: r for r in B.bootstrap(some, "y", "a", 0.5, replicates=1000).collect()}
    got["delta"] = B.paired_bootstrap(some, "y", "a", "b", replicates=1000).first()
    for name, values in want.items():
        assert got[name]["std"] == pytest.approx(values.std(), rel=0.12), name
        for bound, q in (("ci_lower", 0.025), ("ci_upper", 0.975)):
            assert got[name][bound] == pytest.approx(np.quantile(values, q), abs=0.35 * values.std()), name


def test_a_wrong_interval_is_seen(preds):
    """The check of the registered queries refuses an interval or a deviation that is twice as wide, or half."""
    from cardflow.plans.metrics import against, points_of

    points, good = points_of(preds, "y", "a", 0.5), B.bootstrap(preds, "y", "a", 0.5)
    assert all(r["fits"] for r in against(good, points).collect())
    for factor in (2.0, 0.5):
        middle = F.col("mean")
        wide = good.withColumn("ci_lower", middle + (F.col("ci_lower") - middle) * factor).withColumn("ci_upper", middle + (F.col("ci_upper") - middle) * factor)
        assert not any(r["fits"] for r in against(wide, points).collect())
        both = against(wide.withColumn("std", F.col("std") * factor), points).collect()
        assert not any(r["fits"] for r in both if r["deviation"] is not None)


def test_report_with_intervals(preds):
    rows = preds.withColumn("split", F.when(F.col("id") < 300, "val").when(F.col("id") < 590, "test").otherwise("none")).withColumn(
        "y", F.when(F.col("split") == "none", 0).otherwise(F.col("y")))
    got = {(r["split"], r["metric"]): r["value"] for r in B.full_report(rows, "y", "a", 0.5, ["id"], ["val", "test", "none"], replicates=200).collect()}
    want = {r["metric"]: r for r in B.bootstrap(rows.filter("split = 'val'"), "y", "a", 0.5, replicates=200).collect()}
    for name in B.METRICS:
        assert got["val", f"{name}_ci_lower"] == want[name]["ci_lower"] < got["val", f"{name}_mean"] < got["val", f"{name}_ci_upper"]
        assert got["test", f"{name}_n_valid"] == 200.0 and ("none", f"{name}_mean") not in got
    assert got["val", "roc_auc"] == pytest.approx(got["val", "roc_auc_mean"], abs=0.03) and ("none", "brier") in got


def test_deviations_of_millions_of_rows(spark):
    """The product of three counts of millions is more than a long holds."""
    from cardflow.plans.metrics import points_of

    rows = spark.range(9_000_000).select((F.col("id") % 3 > 0).cast("int").alias("y"), F.when(F.col("id") % 2 == 0, 0.75).otherwise(0.25).alias("p"))
    points = points_of(rows, "y", "p", 0.5)
    tp, fp, fn = 3e6, 1.5e6, 3e6
    assert points["f1"] == pytest.approx((2 * tp / (2 * tp + fp + fn), 2 * (tp * (fp + fn) * (tp + fp + fn)) ** 0.5 / (2 * tp + fp + fn) ** 2))
