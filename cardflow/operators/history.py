"""Per-key history up to each row (batch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardflow.functions.columns import amount_of, money, money_rest
from cardflow.operators.ordered import ROWS, Aggs, latest, prefix, running


def _order(time: str, tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(time), *[F.col(t) for t in tiebreak]]


def history_features(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], amount: str = "amount",
                     split: bool | None = None) -> DataFrame:
    """Count, sum, mean and maximum over the earlier rows of the key; the first row has
    count 0 and no values."""
    out = running(df, [key], _order(time, tiebreak), {
        "hist_count": ROWS, "__sum": ("sum", money(amount)), "__rest": ("sum", money_rest(amount)), "hist_max": ("max", F.col(amount)),
    }, include_current=False, split=split)
    total = amount_of("__sum", "__rest")
    return out.select(*df.columns, "hist_count", total.alias("hist_sum"),
                      (total / F.nullif(F.col("hist_count"), F.lit(0))).alias("hist_mean"), "hist_max")


def label_history(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], label: str, delay: int = 0,
                  split: bool | None = None) -> DataFrame:
    """Number of positive labels known at each row. A label is known ``delay`` time units
    after its row; with 0 every earlier row counts at once."""
    value = F.col(label).cast("long")
    aggs = {"__labels": ("sum", value)}
    if delay == 0:
        out = running(df, [key], _order(time, tiebreak), aggs, include_current=False, split=split)
    else:
        out = prefix(df, [key], time, tiebreak, aggs, shift=delay, inclusive=True, split=split)
    return out.select(*df.columns, F.coalesce(F.col("__labels"), F.lit(0)).alias("label_count_before"))


def previous_gap(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], prev: str = "row",
                 split: bool | None = None) -> DataFrame:
    """Previous time of the key and the distance to it. ``row``: the row before in
    (time, tiebreak) order. ``strict``: the latest time before this one, as in the stream."""
    if prev == "row":
        out = running(df, [key], _order(time, tiebreak), {"prev_time": ("last", F.col(time))},
                      include_current=False, split=split)
    elif prev == "strict":
        out = prefix(df, [key], time, tiebreak, {"prev_time": ("max", F.col(time))}, split=split)
    else:
        raise ValueError(f"prev must be 'row' or 'strict', not {prev!r}")
    return out.withColumn("gap", F.col(time) - F.col("prev_time"))


def causal_history(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], aggs: Aggs,
                   split: bool | None = None) -> DataFrame:
    """Aggregates over all rows of the key that are strictly earlier."""
    return prefix(df, [key], time, tiebreak, aggs, split=split)


def causal_counters(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], accepted: Column | None = None,
                    velocity_count: str | None = None, day: float = 86400.0,
                    split: bool | None = None) -> DataFrame:
    """c1, c2: accepted earlier rows + 1 (c1 at least the trailing count, if given);
    d1, d2: days since the first and since the latest accepted earlier row."""
    counts = F.lit(True) if accepted is None else accepted
    moment = F.when(counts, F.col(time))
    out = prefix(df, [key], time, tiebreak, {
        "__n": ("count", moment), "__first": ("min", moment), "__prev": ("max", moment)}, split=split)
    c2 = (F.col("__n") + 1).cast("double")
    c1 = c2 if velocity_count is None else F.greatest(c2, F.col(velocity_count).cast("double"))

    def days(since: str) -> Column:
        return F.coalesce((F.col(time) - F.col(since)) / F.lit(day), F.lit(0.0))

    return out.select(*df.columns, c1.alias("c1"), c2.alias("c2"),
                      days("__first").alias("d1"), days("__prev").alias("d2"))


def causality_violations(df: DataFrame, key: str, time: str, tiebreak: Sequence[str],
                         split: bool | None = None) -> DataFrame:
    """Rows whose latest history row is not strictly earlier; must be empty. The history is
    rebuilt here through ``latest``, independently of the frames used to make features."""
    rows = df.select(key, time, *tiebreak)
    moments = rows.select(key, F.col(time).alias("hist_time")).distinct()
    found = latest(rows, moments, [key], time, "hist_time", ["hist_time"], inclusive=False, split=split)
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count("hist_time").alias("with_history"),
                     F.count_if(F.col("hist_time") >= F.col(time)).alias("violations"))


def running_totals(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], amount: str = "amount",
                   split: bool | None = None) -> DataFrame:
    """Total and count of the key including the row."""
    out = running(df, [key], _order(time, tiebreak),
                  {"__sum": ("sum", money(amount)), "__rest": ("sum", money_rest(amount)), "running_count": ROWS}, split=split)
    return out.select(*df.columns, amount_of("__sum", "__rest").alias("running_total"), "running_count")


def replay_order(df: DataFrame, time: str, tiebreak: Sequence[str]) -> DataFrame:
    """Chronological order with a stable tiebreak (a range partitioned sort)."""
    return df.orderBy(*_order(time, tiebreak))


def first_profile(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Attributes of the first row of each key."""
    first = F.min_by(F.struct(*attributes), F.struct(time, *tiebreak)).alias("__first")
    return df.groupBy(key).agg(first).select(key, "__first.*")
