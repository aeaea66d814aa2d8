"""Data-quality profiling. Column-wise figures come from one aggregation over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cardflow.functions.columns import DAY_SECONDS, money_sum, ratio
from cardflow.operators.quantiles import long_form, quantile_columns, with_row

# Sequence lengths and shares reported for entities.
SEQUENCE_LENGTHS = (2, 3, 5, 10, 20, 50)
SHARES = (2, 5, 10, 20)

# Column families of the wide table by name pattern, first match wins.
COLUMN_GROUPS = (
    ("^isFraud$", "M_TARGET"), ("^TransactionID$", "L_IDENTIFIER"), ("^TransactionDT$", "K_TEMPORAL"),
    ("^(TransactionAmt|ProductCD)$", "A_TRANSACTION"), ("^card", "B_CARD"), ("^addr", "C_ADDRESS"),
    ("(?i)email", "D_EMAIL"), ("^dist", "E_DISTANCE"), ("^C.{0,2}$", "F_COUNTING"), ("^D.{0,2}$", "G_TIMEDELTA"),
    ("^M.{0,2}$", "H_MATCH_FLAG"), ("^V", "I_ANONYMIZED_V"), ("^(id_|DeviceType$|DeviceInfo$)", "J_IDENTITY"),
)


def column_group(name: Column) -> Column:
    out = None
    for pattern, group in COLUMN_GROUPS:
        hit = name.rlike(pattern)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("Z_OTHER")


def _per_column(df: DataFrame, cols: Sequence[str], measures: dict) -> DataFrame:
    """One row per column with the given aggregates, from a single pass."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        agg(F.col(f"`{c}`")).alias(f"__{m}_{i}") for i, c in enumerate(cols) for m, agg in measures.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"),
                               *[F.col(f"__{m}_{i}").alias(m) for m in measures]) for i, c in enumerate(cols)])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def missingness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count, percentage and band per column."""
    out = _per_column(df, cols or df.columns, {"present": F.count})
    pct = F.coalesce(ratio((F.col("rows") - F.col("present")) * 100.0, F.col("rows")), F.lit(0.0))
    band = (F.when(F.col("missing_pct") == 0, "0").when(F.col("missing_pct") <= 20, "0-20")
            .when(F.col("missing_pct") <= 80, "20-80").otherwise(">80"))
    return out.select("column", (F.col("rows") - F.col("present")).alias("missing"), pct.alias("missing_pct")).withColumn(
        "band", band)


def missing_ranking(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return missingness(df, cols).orderBy(F.desc("missing_pct"), "column")


def missing_signal(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Positive rate where a column is present and where it is missing; a difference above one
    percentage point is a signal."""
    y = F.col(label).cast("double")
    out = _per_column(df, cols, {
        "missing_pct": lambda c: F.avg(c.isNull().cast("double")) * 100,
        "rate_present": lambda c: F.avg(F.when(c.isNotNull(), y)),
        "rate_missing": lambda c: F.avg(F.when(c.isNull(), y))})
    strong = F.abs(F.col("rate_present") - F.col("rate_missing")) > 0.01
    return out.drop("rows").withColumn("signal", F.when(strong, "YES").otherwise("WEAK"))


def class_balance(df: DataFrame, label: str, amount: str) -> DataFrame:
    """Rows, rate, imbalance and amount figures per class and in total."""
    return (df.withColumn("class", F.col(label).cast("string")).rollup("class").agg(
        F.count(F.lit(1)).alias("rows"), (money_sum(amount) / F.count(amount)).alias("mean_amount"),
        F.min(amount).alias("min_amount"), F.max(amount).alias("max_amount"),
        F.stddev_samp(amount).alias("std_amount")).withColumn("class", F.coalesce("class", F.lit("total"))))


def validate_table(df: DataFrame, key: str, time: str, label: str, amount: str) -> DataFrame:
    """Checks with value and PASS/FAIL: one row each."""
    # A repeated id is counted without listing ids: rows minus distinct ids.
    figures = df.agg(
        F.count(F.lit(1)).alias("rows"), (F.count(key) - F.count_distinct(key)).alias("duplicate_ids"),
        F.count_if(F.col(label).isNull()).alias("label_nulls"),
        F.count_if(~F.col(label).cast("int").isin(0, 1)).alias("label_outside"),
        F.sum(F.col(label).cast("long")).alias("positives"), F.min(time).alias("t_min"), F.max(time).alias("t_max"),
        F.min(amount).alias("amount_min"), F.max(amount).alias("amount_max"),
        (money_sum(amount) / F.count(amount)).alias("amount_mean"))
    negatives = F.col("rows") - F.col("positives")
    checks = {
        "rows": (F.col("rows"), F.col("rows") > 0),
        "duplicate_ids": (F.col("duplicate_ids"), F.col("duplicate_ids") == 0),
        "label_nulls": (F.col("label_nulls"), F.col("label_nulls") == 0),
        "label_outside_0_1": (F.col("label_outside"), F.col("label_outside") == 0),
        "both_classes": (F.col("positives"), (F.col("positives") > 0) & (negatives > 0)),
        "positive_pct": (ratio(F.col("positives") * 100.0, F.col("rows")), F.lit(True)),
        "negatives_per_positive": (ratio(negatives, F.col("positives")), F.lit(True)),
        "span_days": ((F.col("t_max") - F.col("t_min")) / F.lit(float(DAY_SECONDS)), F.col("t_max") > F.col("t_min")),
        "amount_min": (F.col("amount_min"), F.col("amount_min") >= 0),
        "amount_max": (F.col("amount_max"), F.lit(True)),
        "amount_mean": (F.col("amount_mean"), F.lit(True)),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"),
                               F.when(ok, "PASS").otherwise("FAIL").alias("status")) for n, (v, ok) in checks.items()])
    return figures.select(F.explode(cells).alias("c")).select("c.*")


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, examples: int = 3) -> DataFrame:
    """Type, missing share, distinct values, smallest example values and column family."""
    cols = list(cols or df.columns)
    # Distinct cells first; everything after works on distinct values.
    values = (long_form(df, cols, kind="string", name="column").groupBy("column", "value")
              .agg(F.count(F.lit(1)).alias("n")))
    figures = values.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct_values"))
    ranked = values.filter(F.col("value").isNotNull()).withColumn(
        "__r", F.row_number().over(W.partitionBy("column").orderBy("value"))).filter(F.col("__r") <= examples)
    shown = ranked.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("__r", "value"))), lambda s: s["value"]), "|").alias("examples"))
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes if c in cols for x in (c, t)])
    return figures.join(shown, "column", "left").select(
        "column", types[F.col("column")].alias("type"), ratio(F.col("missing") * 100.0, F.col("rows")).alias("missing_pct"),
        "distinct_values", "examples", column_group(F.col("column")).alias("family"))


def entity_stats(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """How many rows an entity has: figures, shares and a grade for sequence models."""
    per_entity = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(label).cast("int")).alias("hit"))
    shares = {f"pct_{k}plus": F.avg((F.col("n") >= k).cast("double")) * 100 for k in SHARES}
    figures = per_entity.agg(
        F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows"), F.avg("n").alias("mean_rows"),
        F.max("n").alias("max_rows"), (F.avg((F.col("n") == 1).cast("double")) * 100).alias("pct_single"),
        *[c.alias(k) for k, c in shares.items()], F.sum("hit").cast("long").alias("fraud_entities"))
    points = quantile_columns(per_entity, [], "n", {"median_rows": .5, "p90_rows": .9, "p95_rows": .95, "p99_rows": .99})
    grade = (F.when((F.col("pct_5plus") > 30) & (F.col("median_rows") >= 3), "EXCELLENT")
             .when((F.col("pct_5plus") > 15) & (F.col("median_rows") >= 2), "GOOD")
             .when(F.col("pct_2plus") > 10, "WEAK").otherwise("POOR"))
    return with_row(figures, points).withColumn("grade", grade).withColumn("entity", F.lit("+".join(keys)))


def sequence_viability(df: DataFrame, key: str, label: str, lengths: Sequence[int] = SEQUENCE_LENGTHS) -> DataFrame:
    """Entities and windows per minimum length, all and those of entities with a positive."""
    per_entity = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(label).cast("int")).alias("hit"))
    wide = per_entity.agg(*[agg.alias(f"{name}_{k}") for k in lengths for name, agg in {
        "e": F.count_if(F.col("n") >= k), "s": F.sum(F.greatest(F.col("n") - (k - 1), F.lit(0))),
        "fe": F.count_if((F.col("n") >= k) & (F.col("hit") == 1)),
        "fs": F.sum(F.when(F.col("hit") == 1, F.greatest(F.col("n") - (k - 1), F.lit(0))).otherwise(0))}.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("min_length"), F.col(f"e_{k}").alias("entities"),
                               F.col(f"s_{k}").alias("windows"), F.col(f"fe_{k}").alias("fraud_entities"),
                               F.col(f"fs_{k}").alias("fraud_windows")) for k in lengths])
    viable = F.when(F.col("fraud_windows") > 5000, "YES").when(F.col("fraud_windows") > 1000, "MARGINAL").otherwise("NO")
    return wide.select(F.explode(cells).alias("c")).select("c.*").withColumn("viable", viable)


def time_histogram(df: DataFrame, time: str, label: str, bins: int = 50) -> DataFrame:
    """Rows per class in equal-width time bins, over all rows."""
    span = df.agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    cell = F.least(F.floor((F.col(time) - F.col("__lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    y = F.col(label).cast("int") == 1
    return with_row(df.select(time, label), span).groupBy(F.coalesce(cell, F.lit(0)).alias("bin")).agg(
        F.count_if(y).alias("fraud_rows"), F.count_if(~y).alias("other_rows"))


def class_means(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Mean of each column in both classes."""
    y = F.col(label).cast("int")
    return _per_column(df, cols, {"mean_0": lambda c: F.avg(F.when(y == 0, c)),
                                  "mean_1": lambda c: F.avg(F.when(y == 1, c))}).drop("rows")


def time_span(df: DataFrame, time: str) -> DataFrame:
    days = (F.max(time) - F.min(time)) / F.lit(float(DAY_SECONDS))
    return df.agg(F.min(time).alias("t_min"), F.max(time).alias("t_max"), days.alias("days"),
                  (days / 30.0).alias("months"), ratio(F.count(F.lit(1)), days).alias("rows_per_day"))


def rate_by(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("fraud_rows"),
                               F.avg(F.col(label).cast("double")).alias("fraud_rate"))


def reconcile(df: DataFrame, difference: Column, tolerance: float = 0.01) -> DataFrame:
    """Rows whose books do not balance."""
    off = F.abs(difference) > tolerance
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(off).alias("mismatches"),
                  F.avg(off.cast("double")).alias("mismatch_rate"))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None, near: int = 5) -> DataFrame:
    """Distinct values per column and whether it is constant or nearly so."""
    cols = list(cols or df.columns)
    cells = long_form(df, cols, kind="string", name="column").groupBy("column").agg(
        F.count_distinct("value").alias("distinct_values"))
    return cells.withColumn("kind", F.when(F.col("distinct_values") <= 1, "CONSTANT").when(
        F.col("distinct_values") <= near, "NEAR_CONSTANT").otherwise("VARIED"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in full."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long_form(df, cols, kind="string", name="column").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, range and exact quartiles per numeric column."""
    cells = long_form(df, cols, name="column")
    stats = cells.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                        F.max("value").alias("max"))
    return stats.join(quantile_columns(cells, ["column"], "value", {"p25": .25, "p50": .5, "p75": .75}), "column")
