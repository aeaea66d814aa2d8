"""Bootstrap intervals by Poisson resampling of score groups.

A resample gives every row an independent Poisson(1) weight; a group of ``n`` equal rows
therefore weighs Poisson(n). Weights are a function of (seed, group, replicate), so two
models on the same rows get the same ones and a replayed task repeats them. Groups are cut
into ordered slices of similar size; a slice handles all replicates in memory-bounded blocks
and passes on one row per replicate, so nothing of size groups x replicates is ever stored
or shuffled. A score whose groups lie in several slices is put together from its pieces."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardflow.functions.resample import weighted_blocks
from cardflow.operators.metrics import _rates, evaluation_report
from cardflow.operators.ordered import SLICE, ordered_slices
from cardflow.operators.quantiles import quantile_columns
from cardflow.session import materialize

GROUPS_PER_SLICE = 500_000

METRICS = ("pr_auc", "roc_auc", "precision", "recall", "f1", "mcc")
SUMS = ("pos", "neg", "tp", "fp", "first_pos", "first_neg", "last_pos", "last_neg")


# The pandas functions below travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _slice_totals(replicates: int, seed: int, threshold: float):
    def totals(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, last = pdf["score"].max(), pdf["score"].min()
        sums = np.zeros((len(SUMS), replicates))
        for score, wp, wn in weighted_blocks(pdf, replicates, seed):
            for i, rows in enumerate((slice(None), score >= threshold, score == first, score == last)):
                sums[2 * i] += wp[rows].sum(0)
                sums[2 * i + 1] += wn[rows].sum(0)
        return pd.DataFrame({SLICE: key[0], "rep": np.arange(replicates), "first": first, "last": last,
                             **dict(zip(SUMS, sums))})
    return totals


def _slice_areas(replicates: int, seed: int):
    def areas(key: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        """Area of the scores that lie wholly inside the slice."""
        before = before.sort_values("rep")
        tp = (before["pos"] + before["first_pos"]).to_numpy()
        fp = (before["neg"] + before["first_neg"]).to_numpy()
        inner = pdf[(pdf["score"] < pdf["score"].max()) & (pdf["score"] > pdf["score"].min())]
        precision_area, roc_area = np.zeros(replicates), np.zeros(replicates)
        tie, tie_pos, tie_neg = None, np.zeros((0, replicates)), np.zeros((0, replicates))

        def enter(p: np.ndarray, n: np.ndarray) -> None:
            """Finished scores in order: the rows of a score enter the curve together."""
            nonlocal tp, fp, precision_area, roc_area
            if len(p):
                up, down = tp + np.cumsum(p, axis=0), fp + np.cumsum(n, axis=0)
                roc_area = roc_area + (n * (up - p / 2)).sum(axis=0)
                precision_area = precision_area + (p * up / np.maximum(up + down, 1e-300)).sum(axis=0)
                tp, fp = up[-1], down[-1]

        for score, wp, wn in weighted_blocks(inner, replicates, seed):
            starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
            wp, wn = np.add.reduceat(wp, starts, axis=0), np.add.reduceat(wn, starts, axis=0)
            if score[0] == tie:  # goes on from the block before
                wp[0], wn[0] = wp[0] + tie_pos[0], wn[0] + tie_neg[0]
            else:
                enter(tie_pos, tie_neg)
            enter(wp[:-1], wn[:-1])
            tie, tie_pos, tie_neg = score[-1], wp[-1:], wn[-1:]
        enter(tie_pos, tie_neg)
        return pd.DataFrame({"rep": np.arange(replicates), "precision_area": precision_area, "roc_area": roc_area})
    return areas


def replicate_sums(groups: DataFrame, replicates: int, seed: int, threshold: float) -> DataFrame:
    """One row per replicate with the weighted sums behind all metrics; ``groups`` has
    ``score, key, pos, neg``."""
    slices = max(2, -(-groups.count() // GROUPS_PER_SLICE))
    sliced = ordered_slices(groups, [], [F.col("score").desc(), F.col("key")], slices)
    per_slice = materialize(sliced.groupBy(SLICE).applyInPandas(
        _slice_totals(replicates, seed, threshold),
        f"{SLICE} int, rep int, first double, last double, " + ", ".join(f"{c} double" for c in SUMS)))
    earlier = W.partitionBy("rep").orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slice.select(SLICE, "rep", "first", "last", "first_pos", "first_neg", "last_pos", "last_neg",
                               F.col("pos").alias("all_pos"), F.col("neg").alias("all_neg"), *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(c) for c in ("pos", "neg")])
    area = sliced.groupBy(SLICE).cogroup(offsets.groupBy(SLICE)).applyInPandas(
        _slice_areas(replicates, seed), "rep int, precision_area double, roc_area double")

    # The first and last score of each slice may go on in the neighbouring slices.
    ends = offsets.select("rep", F.explode(F.array(
        F.struct(F.col("first").alias("score"), F.col("first_pos").alias("p"), F.col("first_neg").alias("n"),
                 F.col("pos").alias("tp"), F.col("neg").alias("fp")),
        F.when(F.col("last") < F.col("first"), F.struct(
            F.col("last").alias("score"), F.col("last_pos").alias("p"), F.col("last_neg").alias("n"),
            (F.col("pos") + F.col("all_pos") - F.col("last_pos")).alias("tp"),
            (F.col("neg") + F.col("all_neg") - F.col("last_neg")).alias("fp"))))).alias("e"))
    pieces = ends.filter(F.col("e").isNotNull()).select("rep", "e.*")
    whole = pieces.groupBy("rep", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"),
                                               F.min("tp").alias("tp"), F.min("fp").alias("fp"))
    reached = F.col("tp") + F.col("p")
    ends_area = whole.select(
        "rep", (F.col("p") * reached / F.greatest(reached + F.col("fp") + F.col("n"), F.lit(1e-300))).alias("precision_area"),
        (F.col("n") * (F.col("tp") + F.col("p") / 2)).alias("roc_area"))

    sums = per_slice.groupBy("rep").agg(*[F.sum(c).alias(c) for c in SUMS[:4]])
    return sums.join(area.unionByName(ends_area).groupBy("rep").agg(
        F.sum("precision_area").alias("precision_area"), F.sum("roc_area").alias("roc_area")), "rep")


def _groups(df: DataFrame, label: str, score: str, identity: list[Column], seed: int) -> DataFrame:
    y = F.col(label).cast("int") == 1
    keyed = df.select(F.col(score).cast("double").alias("score"), F.xxhash64(F.lit(seed), *identity).alias("key"),
                      y.alias("y"))
    return materialize(keyed.groupBy("score", "key").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")))


def _valid(sums: DataFrame) -> DataFrame:
    """Replicates with both classes."""
    return sums.filter((F.col("pos") > 0) & (F.col("neg") > 0))


def bootstrap(df: DataFrame, label: str, score: str, threshold: float, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Mean, deviation and 95 % interval per metric over the non-degenerate replicates."""
    groups = _groups(df, label, score, [F.col(score).cast("double")], seed)
    sums = _valid(replicate_sums(groups, replicates, seed, threshold))
    fn, tn = F.col("pos") - F.col("tp"), F.col("neg") - F.col("fp")
    rates = _rates(F.col("tp"), F.col("fp"), fn, tn)
    values = {"pr_auc": F.col("precision_area") / F.col("pos"),
              "roc_auc": F.col("roc_area") / (F.col("pos") * F.col("neg")),
              **{m: rates[m] for m in METRICS[2:]}}
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in values.items()])
    return _intervals(sums.select("rep", F.explode(cells).alias("c")).select("rep", "c.*"))


def _intervals(long: DataFrame) -> DataFrame:
    """Per metric over at most ``replicates`` values."""
    long = materialize(long)
    stats = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                       F.count("value").alias("n_valid"))
    bounds = quantile_columns(long, ["metric"], "value", {"ci_lower": 0.025, "ci_upper": 0.975}, split=False)
    return stats.join(bounds, "metric")


def paired_bootstrap(df: DataFrame, label: str, a: str, b: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Interval of the average precision difference ``b - a`` on shared weights. Degenerate
    replicates are skipped."""
    identity = [F.col(a).cast("double"), F.col(b).cast("double")]

    def precision(score: str, name: str) -> DataFrame:
        sums = _valid(replicate_sums(_groups(df, label, score, identity, seed), replicates, seed, 0.5))
        return sums.select("rep", (F.col("precision_area") / F.col("pos")).alias(name))

    both = precision(a, "ap_a").join(precision(b, "ap_b"), "rep")
    return _intervals(both.select("rep", F.lit("delta_average_precision").alias("metric"),
                                  (F.col("ap_b") - F.col("ap_a")).alias("value")))


def full_report(preds: DataFrame, label: str, score: str, threshold: float, tiebreak: Sequence[str], splits: Sequence[str],
                replicates: int = 2000, seed: int = 42) -> DataFrame:
    """``evaluation_report`` with the bootstrap of every split: ``{metric}_mean``, ``_std``, ``_ci_lower``, ``_ci_upper`` and ``_n_valid``. A split
    without both classes has no valid replicate and gets no such rows."""
    out = evaluation_report(preds, label, score, threshold, tiebreak, splits)
    for name in splits:
        intervals = bootstrap(preds.filter(F.col("split") == name), label, score, threshold, replicates, seed)
        cells = F.array(*[F.struct(F.concat("metric", F.lit(f"_{c}")).alias("metric"), F.col(c).cast("double").alias("value"))
                          for c in ("mean", "std", "ci_lower", "ci_upper", "n_valid")])
        out = out.unionByName(intervals.select(F.lit(name).alias("split"), F.explode(cells).alias("c")).select("split", "c.*"))
    return out
