"""Grouped and global aggregation. Sums of money are exact (decimal)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardflow.functions.columns import money_sum, ratio
from cardflow.operators.quantiles import quantile_columns, with_row

PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def aggregate_card_history(df: DataFrame, key: str, amount: str, label: str) -> DataFrame:
    """Per-card count, sum, average, minimum, maximum, positive count and rate."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        money_sum(amount).alias("total_amount"),
        (money_sum(amount) / F.count(amount)).alias("avg_amount"),
        F.min(amount).alias("min_amount"), F.max(amount).alias("max_amount"),
        F.sum(F.col(label).cast("long")).alias("fraud_count"),
        F.avg(F.col(label).cast("double")).alias("fraud_rate"))


def summarize(df: DataFrame, amount: str) -> DataFrame:
    """Count, sum and average of the whole table, 0 when it is empty."""
    total = F.coalesce(money_sum(amount), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("transaction_count"), total.alias("total_amount"),
                  F.coalesce(ratio(total, F.count(F.lit(1))), F.lit(0.0)).alias("average_amount"))


def unique_merchants(df: DataFrame, by: Sequence[str], merchant: str, approx: float | None = None) -> DataFrame:
    """Distinct non-empty merchants, exact or within ``approx`` relative deviation."""
    value = F.nullif(F.col(merchant).cast("string"), F.lit(""))
    n = F.count_distinct(value) if approx is None else F.approx_count_distinct(value, approx)
    return df.groupBy(*by).agg(n.alias("unique_merchants"))


def merchant_sketches(df: DataFrame, by: Sequence[str], merchant: str, size: int = 12) -> DataFrame:
    """One sketch of the distinct non-empty values per group, such as a card and day, to be stored and merged later (``size``: log2 of its
    registers; the relative deviation is about 0.8 / 2**(size / 2))."""
    value = F.nullif(F.col(merchant).cast("string"), F.lit(""))
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, size).alias("merchants"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values of coarser groups from stored sketches; the rows behind them are not read again."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("merchants")).alias("unique_merchants"))


def hop_sketches(sketches: DataFrame, by: Sequence[str], pane: str, panes: int) -> DataFrame:
    """Distinct values of windows of so many panes (whole numbers), one pane apart, from the sketches of the panes."""
    starts = F.explode(F.sequence(F.col(pane) - (panes - 1), F.col(pane)))
    return merge_sketches(sketches.withColumn("window", starts), [*by, "window"])


def run_counters(df: DataFrame, by: Sequence[str], amount: str, label: str | Column) -> DataFrame:
    """Rows, positives and volume per partition, source or rule."""
    hit = F.col(label) if isinstance(label, str) else label
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(hit.cast("boolean")).alias("fraud_rows"),
        money_sum(amount).alias("volume"))


def distribution(df: DataFrame, value: str, by: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    """Count, mean, sample deviation, range and exact interpolated percentiles."""
    v = F.col(value).cast("double")
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    points = quantile_columns(df, by, value, PERCENTILES, split=split)
    return with_row(stats, points) if not by else stats.join(points, list(by))


def percentile_nearest(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                       split: bool | None = None) -> DataFrame:
    """Value at rank ``int(p * n)``, without interpolation."""
    return quantile_columns(df, by, value, probs, method="nearest", split=split)


def monitor_summary(log: DataFrame, latency: str = "latency_ms", status: str = "status",
                    time: str | None = None, window: str | None = None) -> DataFrame:
    """Request totals by status class and latency figures, overall or per time window."""
    code = F.col(status)
    rows, by = log, []
    if window:
        rows, by = log.withColumn("window_start", F.window(time, window).getField("start")), ["window_start"]
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(code.between(200, 299)).alias("status_2xx"),
        F.count_if(code.between(400, 499)).alias("status_4xx"),
        F.count_if(code >= 500).alias("status_5xx"),
        F.avg(code.between(200, 299).cast("double")).alias("success_rate"))
    latencies = distribution(rows, latency, by)
    return with_row(counts, latencies) if not by else counts.join(latencies, by)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sort_entities(df: DataFrame, key: str, time: str, tiebreak: Sequence[str]) -> DataFrame:
    return df.orderBy(key, time, *tiebreak)
