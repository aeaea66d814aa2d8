"""Quantile sketches that are stored, merged and looked up without the rows behind them.

One aggregation reads the table once and keeps a sketch per column and group (a period, a window); no cell is a row of its own. Sketches of periods
merge to those of longer ones, so that a reference window that moves reads nothing again. A quantile taken from a sketch is within its rank error; ``exact_quantiles``
takes the sketch as a bracket, and reads the rows once for the values inside. Should a bracket miss, all values are ranked, so the result is exact in any case.

NULL and not-a-number are no values; a column without values has no row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cardflow.operators.quantiles import MAX_BRACKETED_GROUPS, long_form, quantile_columns

SIZE = 4096  # of a sketch: rank error below 2.3 / SIZE ** 0.9, or 0.0013 of the rows, in 99 of 100 cases
MARGIN = 0.004  # of a bracket, three times that


def column_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``(by..., feature, n, sketch)``: a row per group and column that has values."""
    values = [F.col(c).cast("double") for c in cols]
    wide = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.when(~F.isnan(v), v), size).alias(f"s{i}") for i, v in enumerate(values)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])
    return _sized(wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*"), by)


def _sized(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.kll_sketch_get_n_double("sketch")
    return sketches.filter(F.col("sketch").isNotNull()).select(*by, "feature", n.alias("n"), "sketch").filter("n > 0")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups."""
    return _sized(sketches.groupBy(*by, "feature").agg(F.kll_merge_agg_double("sketch").alias("sketch")), by)


def sketched_quantiles(sketches: DataFrame, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, n, a column per quantile)``, within the rank error of the sketch."""
    return sketches.select(*by, "feature", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])


def brackets(sketches: DataFrame, probs: Mapping[str, float], by: Sequence[str] = (), margin: float = MARGIN) -> DataFrame | None:
    """Bracket ends as ``quantile_columns`` takes them, NULL for an open end; at most MAX_BRACKETED_GROUPS rows, or None."""
    keys, ends = [*by, "feature"], []
    for i, p in enumerate(sorted(set(probs.values()))):
        for q, side in ((p - margin, "lo"), (p + margin, "hi")):
            end = F.kll_sketch_get_quantile_double("sketch", F.lit(q)) if 0 < q < 1 else F.lit(None).cast("double")
            ends.append(end.alias(f"__{side}{i}"))
    found = sketches.select(*[F.col(k).alias(f"__b_{k}") for k in keys], *ends)
    rows = found.limit(MAX_BRACKETED_GROUPS + 1).collect()
    return sketches.sparkSession.createDataFrame(rows, found.schema) if len(rows) <= MAX_BRACKETED_GROUPS else None


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float], sketches: DataFrame, by: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """``(by..., feature, a column per quantile)`` of the rows that ``sketches`` stand for, one sketch per group and column."""
    cells = long_form(df, cols, by).filter(~F.isnan("value"))
    return quantile_columns(cells, [*by, "feature"], "value", probs, method, ends=brackets(sketches, probs, by))
