"""Fixed-length windows of consecutive rows of a key, for sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardflow.operators.ordered import tail_rows


def gap_vector(times: Column) -> Column:
    """0 for the first time, ln(1 + difference) for the others."""
    return F.transform(times, lambda t, i: F.when(i == 0, F.lit(0.0)).otherwise(
        F.log1p((t - F.get(times, i - 1)).cast("double"))))


def _strict(times: Column) -> Column:
    return F.forall(F.transform(times, lambda t, i: (i == 0) | (t > F.get(times, i - 1))), lambda ok: ok)


def candidate_windows(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], features: Sequence[str],
                      label: str, length: int = 5, keep: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    """Every run of ``length`` rows: the last one is the target, ``strict`` tells whether all
    times rise."""
    step = F.struct(F.col(time).alias("t"), F.array(*[F.col(f).cast("double") for f in features]).alias("f"))
    rows = df.select(key, time, *tiebreak, *[k for k in keep if k not in (key, time, *tiebreak)],
                     F.col(label).cast("int").alias("y"), step.alias("__step"))
    out = tail_rows(rows, [key], [F.col(time), *[F.col(t) for t in tiebreak]], F.col("__step"), length, "__w", split)
    return out.filter(F.size("__w") == length).withColumn("strict", _strict(F.col("__w.t"))).drop("__step")


def build_sequences(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], features: Sequence[str],
                    label: str, length: int = 5, keep: Sequence[str] = (), split: bool | None = None) -> DataFrame:
    """One row per strictly rising window: key, time, id and label of the target, and ``x``, the
    features of the ``length - 1`` history rows with their log gap appended."""
    windows = candidate_windows(df, key, time, tiebreak, features, label, length, keep, split).filter("strict")
    history = F.slice("__w", 1, length - 1)
    gaps = gap_vector(history["t"])
    x = F.zip_with(history["f"], gaps, lambda f, g: F.concat(f, F.array(g)))
    return windows.withColumn("x", x).drop("__w", "strict")


def sequence_audit(windows: DataFrame, key: str, by: str) -> DataFrame:
    """Kept and excluded (tied) windows per split, and entities that have a window."""
    return windows.groupBy(by).agg(
        F.count_if("strict").alias("windows"), F.count_if(~F.col("strict")).alias("excluded_tied"),
        F.sum(F.when(F.col("strict"), F.col("y")).otherwise(0)).cast("long").alias("positive_windows"),
        F.count_distinct(F.when(F.col("strict"), F.col(key))).alias("entities"))
