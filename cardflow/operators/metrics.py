"""Score metrics from one shared table: counts per distinct score, accumulated from the
highest score down. Everything after ``curve`` works on distinct scores only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardflow.functions.columns import ratio
from cardflow.operators.ordered import ROWS, running
from cardflow.operators.quantiles import with_row
from cardflow.session import materialize

# Operating points reported by default.
FPR_TARGETS = (0.001, 0.005, 0.01, 0.02)
TOP_KS = (100, 500, 1000, 5000)


def curve(df: DataFrame, label: str, score: str, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    """Per distinct score: ``pos``, ``neg``; rows at or above it: ``tp``, ``fp``; its rank from
    the top ``k``; and the totals ``p_all``, ``n_all``, ``k_all`` of the group."""
    by = list(by)
    positive = F.col(label).cast("int") == 1
    groups = materialize(df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")))
    pos, neg = ("sum", F.col("pos")), ("sum", F.col("neg"))
    return running(groups, by, [F.col("score").desc()], {"tp": pos, "fp": neg, "k": ROWS},
                   totals={"p_all": pos, "n_all": neg, "k_all": ROWS}, split=split)


def average_precision(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of (recall step) x precision."""
    step = ratio(F.col("pos"), F.col("p_all")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return points.groupBy(*by).agg(F.sum(step).alias("average_precision"))


def roc_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; a tied score contributes a trapezoid."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return points.groupBy(*by).agg(
        ratio(F.sum(area), F.max(F.col("p_all").cast("double") * F.col("n_all"))).alias("roc_auc"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    def share(num: Column, den: Column) -> Column:
        return F.coalesce(ratio(num, den), F.lit(0.0))

    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    recall, specificity = share(tp, tp + fn), share(tn, tn + fp)
    mcc = share(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return {
        "precision": share(tp, tp + fp), "recall": recall, "f1": share(2 * tp, 2 * tp + fp + fn), "mcc": mcc,
        "balanced_accuracy": (recall + specificity) / 2.0, "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp)}


def confusion(df: DataFrame, label: str, score: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at ``score >= threshold`` and the rates derived from them, 0 when undefined."""
    y, hit = F.col(label).cast("int") == 1, F.col(score) >= threshold
    counts = df.groupBy(*by).agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
                                 F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return counts.select("*", *[c.alias(n) for n, c in rates.items()])


def threshold_scores(points: DataFrame) -> DataFrame:
    """The rates at every distinct score used as threshold."""
    fn, tn = F.col("p_all") - F.col("tp"), F.col("n_all") - F.col("fp")
    return points.select("*", *[c.alias(n) for n, c in _rates(F.col("tp"), F.col("fp"), fn, tn).items()])


def select_threshold(points: DataFrame, metric: str = "f1", grid: int | None = None) -> DataFrame:
    """The score that maximises ``metric``; the lowest one among equals. All scores are
    searched; with ``grid``, balanced accuracy only on so many scores at evenly spaced ranks (from the lowest score)."""
    if metric not in ("f1", "precision", "recall", "balanced_accuracy"):
        raise ValueError(f"unknown metric {metric!r}")
    scores = threshold_scores(points)
    if metric == "balanced_accuracy" and grid is not None:
        rank, last = F.col("k_all") - F.col("k"), F.col("k_all") - 1
        steps = F.least(F.lit(grid), F.col("k_all")) - 1
        place = F.ceil(rank * steps / F.greatest(last, F.lit(1)))
        on_grid = F.floor(place * last / F.greatest(steps, F.lit(1))) == rank
        scores = scores.filter(on_grid)
    return scores.orderBy(F.desc(metric), F.asc("score")).limit(1).select(
        F.col("score").alias("threshold"), F.col(metric).alias("value"))


def grid_index(value: Column, low: float, step: float) -> Column:
    """Index of the largest grid point ``low + i * step`` that is <= value, compared as doubles."""
    guess = F.floor((value - low) / step)
    up = (low + (guess + 1) * step <= value).cast("long")
    down = (low + guess * step > value).cast("long")
    return guess + up - down


def sweep(df: DataFrame, label: str, score: str, n: int = 200, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rates at ``n`` evenly spaced thresholds. Rows are counted per grid cell first, so the
    running sum covers ``n`` rows whatever the size of the table."""
    step = (high - low) / (n - 1)
    y = F.col(label).cast("int") == 1
    cell = F.least(F.greatest(grid_index(F.col(score).cast("double"), low, step), F.lit(-1)), F.lit(n - 1))
    cells = df.groupBy(cell.alias("i")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    grid = df.sparkSession.range(-1, n, 1, 1).withColumnRenamed("id", "i")
    above = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = grid.join(cells, "i", "left").select(
        "i", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg")).select(
        "i", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(everything).alias("p_all"), F.sum("neg").over(everything).alias("n_all"))
    rates = threshold_scores(filled.filter("i >= 0"))
    return rates.select((F.lit(low) + F.col("i") * step).alias("threshold"), "f1", "precision", "recall")


def best_of_sweep(swept: DataFrame) -> DataFrame:
    return swept.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def precision_at_k(df: DataFrame, label: str, score: str, tiebreak: Sequence[str], ks: Sequence[int] = TOP_KS) -> DataFrame:
    """Share of positives among the ``k`` highest scores; ``k`` is cut to the table size. Only
    the largest ``k`` rows leave the top-k sort."""
    order = [F.desc(score), *[F.asc(t) for t in tiebreak]]
    top = df.select(F.col(label).cast("int").alias("y"), score, *tiebreak).orderBy(*order).limit(max(ks))
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    wide = ranked.agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.when(F.col("rank") <= k, F.col("y")).otherwise(0)).alias(f"hits_{k}") for k in ks])
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits"),
                               ratio(F.col(f"hits_{k}"), F.least(F.lit(k), F.col("n"))).alias("precision")) for k in ks])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def recall_at_fpr(points: DataFrame, alphas: Sequence[float] = FPR_TARGETS) -> DataFrame:
    """Highest recall among all thresholds whose false positive rate is at most alpha."""
    fpr, tpr = ratio(F.col("fp"), F.col("n_all")), ratio(F.col("tp"), F.col("p_all"))
    wide = points.agg(*[F.coalesce(F.max(F.when(fpr <= a, tpr)), F.lit(0.0)).alias(f"r{i}") for i, a in enumerate(alphas)])
    cells = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"r{i}").alias("recall")) for i, a in enumerate(alphas)])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def brier(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the score, beside that of always predicting the positive rate."""
    y = F.col(label).cast("double")
    error = F.col(score) - y
    return df.groupBy(*by).agg(F.avg(error * error).alias("brier"), (F.avg(y) * (1 - F.avg(y))).alias("naive_brier"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Reliability table over equal-width bins of [0, 1], the last one closed."""
    cell = F.least(grid_index(F.col(score).cast("double"), 0.0, 1.0 / bins), F.lit(bins - 1))
    return df.groupBy(cell.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_score") - F.col("positive_rate"))
    return table.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def decide(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """The frozen-threshold decision."""
    return df.withColumn("prediction", (F.col(score) >= threshold).cast("int"))


def headline(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row with ranking, threshold and calibration metrics of one score column."""
    points = curve(df, label, score)
    out = with_row(average_precision(points), roc_auc(points))
    out = with_row(out, brier(df, label, score).select("brier"))
    return with_row(out, confusion(df, label, score, threshold))


def long_metrics(row: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return row.select(F.explode(cells).alias("c")).select("c.*")


COMPARED = ("average_precision", "roc_auc", "brier", "precision", "recall", "f1", "mcc", "balanced_accuracy", "fpr", "fnr")


def compare_models(df: DataFrame, label: str, a: str, b: str, threshold: float) -> DataFrame:
    """Every metric of two scores on the same rows, and the difference."""
    def side(score: str, name: str) -> DataFrame:
        return long_metrics(headline(df, label, score, threshold), COMPARED).withColumnRenamed("value", name)
    return side(a, "model_a").join(side(b, "model_b"), "metric").withColumn("delta", F.col("model_b") - F.col("model_a"))


def evaluation_report(preds: DataFrame, label: str, score: str, threshold: float, tiebreak: Sequence[str],
                      splits: Sequence[str]) -> DataFrame:
    """Long form ``(split, metric, value)`` from a prediction table."""
    out = None
    for name in splits:
        rows = preds.filter(F.col("split") == name)
        points = curve(rows, label, score)
        base = headline(rows, label, score, threshold)
        parts = [
            long_metrics(base, [*COMPARED, "tp", "fp", "fn", "tn"]),
            long_metrics(expected_calibration_error(calibration(rows, label, score)), ["ece"]),
            recall_at_fpr(points).select(F.concat(F.lit("recall_at_fpr_"), F.format_string("%.3f", "alpha"))
                                         .alias("metric"), F.col("recall").alias("value")),
            precision_at_k(rows, label, score, tiebreak).select(
                F.concat(F.lit("precision_at_top_"), F.col("k").cast("string")).alias("metric"),
                F.col("precision").alias("value"))]
        for part in parts:
            tagged = part.select(F.lit(name).alias("split"), "metric", "value")
            out = tagged if out is None else out.unionByName(tagged)
    return out
