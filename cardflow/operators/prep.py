"""Leakage-safe preprocessing: every ``fit`` reads training rows and returns a small model
table, every ``apply`` is an expression or a join with it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardflow.functions.columns import DAY_SECONDS, cyclic_hour, ratio
from cardflow.operators.clean import LABEL_ALIASES
from cardflow.operators.ordered import ROWS, running
from cardflow.operators.profile import column_group
from cardflow.operators.quantiles import long_form, quantile_columns
from cardflow.session import materialize, stored

MISSING, UNSEEN = "MISSING", "UNSEEN"
TEMPORAL = ("hour_sin", "hour_cos", "day_index")
NUMERIC_TYPES = ("double", "float", "bigint", "int", "smallint")

# Online availability tiers.
TIER_DIRECT, TIER_DERIVED = "EVENT_DIRECT", "EVENT_DERIVED"
TIER_PROFILE, TIER_HISTORY, TIER_NONE = "ENTITY_PROFILE", "HISTORICAL_AGGREGATION", "UNRECONSTRUCTABLE"
TIER_PATTERNS = (
    ("^(TransactionID|TransactionDT|TransactionAmt|ProductCD)$", TIER_DIRECT),
    ("^(hour_sin|hour_cos|day_index)$|_missing$", TIER_DERIVED),
    ("^(card[1-6]|addr[12]|dist1|[PR]_emaildomain|DeviceType|DeviceInfo|id_(0[1-9]|[12][0-9]|3[0-8]))$", TIER_PROFILE),
    ("^(C([1-9]|1[0-4])|D([1-9]|1[0-5])|M[1-9]|V([1-9]|[1-9][0-9]|[12][0-9]{2}|3[0-3][0-9]))$", TIER_HISTORY),
)


def missing_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(f"__p{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(ratio(
        F.col("__rows") - F.col(f"__p{i}"), F.col("__rows")), F.lit(0.0)).alias("missing_share"))
        for i, c in enumerate(cols)])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def fit_drop_missing(df: DataFrame, threshold: float = 0.80, prefix: str = "V") -> DataFrame:
    """Columns with ``prefix`` whose missing share on the training rows is above the threshold."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return missing_shares(df, cols).filter(F.col("missing_share") > threshold)


def fit_median(df: DataFrame, cols: Sequence[str], split: bool | None = None) -> DataFrame:
    """Exact median per column; 0 for a column without values."""
    medians = quantile_columns(long_form(df, cols), ["feature"], "value", {"median": 0.5}, split=split)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(medians, "feature", "left").select("feature", F.coalesce("median", F.lit(0.0)).alias("median"))


def apply_median(df: DataFrame, model: DataFrame) -> DataFrame:
    """Fills missing numbers. The model has one row per column and is read to the driver."""
    medians = {r["feature"]: r["median"] for r in model.collect()}
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) if c in medians else F.col(c)
                       for c in df.columns])


def fit_labels(df: DataFrame, cols: Sequence[str], specials: Sequence[str] = (MISSING, UNSEEN)) -> DataFrame:
    """``(feature, category, code, train_count)``: sorted training categories numbered from 0,
    with the special ones appended where the data does not have them."""
    counts = (long_form(df, cols, kind="string", value="category")
              .groupBy("feature", F.coalesce("category", F.lit(MISSING)).alias("category"))
              .agg(F.count(F.lit(1)).alias("train_count")))
    counts = materialize(counts)
    coded = running(counts, ["feature"], [F.col("category")], {"code": ROWS}, include_current=False)
    if not specials:
        return coded
    # Appended after the sorted ones, in the given order, skipping those already there.
    have = coded.groupBy("feature").agg(F.max("code").alias("__last"), *[
        F.max((F.col("category") == s).cast("int")).alias(f"__has{i}") for i, s in enumerate(specials)])
    rows, at = [], F.col("__last")
    for i, s in enumerate(specials):
        at = at + (1 - F.col(f"__has{i}"))
        rows.append(F.when(F.col(f"__has{i}") == 0, F.struct(
            F.lit(s).alias("category"), at.alias("code"), F.lit(0).cast("long").alias("train_count"))))
    extra = have.select("feature", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("feature", "x.*")
    return coded.select("feature", "category", "code", "train_count").unionByName(extra)


def fit_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes of the training categories only."""
    return fit_labels(df, cols, specials=())


def apply_labels(df: DataFrame, model: DataFrame, cols: Sequence[str], unseen: str = "token",
                 value: str = "code") -> DataFrame:
    """Replaces categories by their code. Unseen ones become the code of UNSEEN (``token``), the
    number of categories (``next``), NULL (``null``) or 0 (``zero``)."""
    model = stored(model)  # its true size decides about a broadcast, not that of the rows it was fitted on
    out = df
    for c in cols:
        mine = model.filter(F.col("feature") == c)
        side = mine.select(F.col("category").alias("__cat"), F.col(value).alias("__code"))
        out = out.withColumn("__key", F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))
        out = out.join(side, F.col("__key") == F.col("__cat"), "left")
        if unseen == "token":
            fallback = mine.filter(F.col("category") == UNSEEN).select(value).scalar()
        elif unseen == "next":
            fallback = mine.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
        else:
            fallback = {"null": F.lit(None), "zero": F.lit(0)}[unseen]
        out = out.withColumn(c, F.coalesce(F.col("__code"), fallback.cast("long"))).drop("__key", "__cat", "__code")
    return out


def fit_frequency(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, category, train_count)``."""
    return (long_form(df, cols, kind="string", value="category")
            .groupBy("feature", F.coalesce("category", F.lit(MISSING)).alias("category"))
            .agg(F.count(F.lit(1)).alias("train_count")))


def apply_frequency(df: DataFrame, model: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_labels(df, model, cols, unseen="zero", value="train_count")


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``{column}_missing``; taken before imputation."""
    return df.select("*", *[F.col(c).isNull().cast("tinyint").alias(f"{c}_missing") for c in cols if c in df.columns])


def flagged_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.05) -> list[str]:
    """Candidates whose training missing share exceeds the threshold."""
    have = [c for c in cols if c in df.columns]
    rows = missing_shares(df, have).filter(F.col("missing_share") > threshold).collect()
    found = {r["feature"] for r in rows}
    return [c for c in have if c in found]


def temporal_features(df: DataFrame, time: str, start: float = float(DAY_SECONDS)) -> DataFrame:
    """Cyclic hour of day and fractional day since ``start``."""
    sin, cos = cyclic_hour(time)
    return df.select("*", sin.alias("hour_sin"), cos.alias("hour_cos"),
                     ((F.col(time) - F.lit(start)) / float(DAY_SECONDS)).alias("day_index"))


def feature_plan(columns: Sequence[str], dropped: Mapping[str, str], flags: Sequence[str], time: str) -> list[tuple]:
    """Ordered decisions ``(position, feature, action, reason)``; position is NULL for what is
    not a feature."""
    plan, position = [], 0
    for c in columns:
        if c == time:
            plan.append((None, c, "TRANSFORM", "replaced by cyclic hour and day"))
        elif c in dropped:
            plan.append((None, c, "DROP", dropped[c]))
        else:
            plan.append((position, c, "KEEP", ""))
            position += 1
    for name, reason in [*[(t, "derived from time") for t in TEMPORAL], *[(f"{c}_missing", "missingness") for c in flags]]:
        plan.append((position, name, "ADD", reason))
        position += 1
    return plan


def enforce_contract(df: DataFrame, names: Sequence[str], forbidden: Sequence[str] = ("TransactionID",)) -> DataFrame:
    """Exactly the given features in the given order; absent ones are NULL, the target and ids
    are refused."""
    banned = [n for n in names if n in LABEL_ALIASES or n in forbidden]
    if banned:
        raise ValueError(f"not features: {banned}")
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n in names])


def feature_inventory(df: DataFrame, drops: Mapping[str, str] | None = None) -> DataFrame:
    """Column, family, type, missing percentage and reason for dropping."""
    drops = drops or {}
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    reason = F.lit("")
    for name, why in drops.items():
        reason = F.when(F.col("feature") == name, why).otherwise(reason)
    return missing_shares(df, df.columns).select(
        F.col("feature").alias("column"), column_group(F.col("feature")).alias("family"),
        types[F.col("feature")].alias("type"), F.round(F.col("missing_share") * 100, 2).alias("missing_pct"),
        reason.alias("drop_reason"))


def tier(name: Column) -> Column:
    out = None
    for pattern, label in TIER_PATTERNS:
        hit = name.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(TIER_NONE)


def classify_features(names: DataFrame, col: str = "feature") -> DataFrame:
    """Online availability tier of each feature name."""
    return names.withColumn("tier", tier(F.col(col)))


def provenance_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("tier").agg(F.count(F.lit(1)).alias("features"))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight ``n / (classes * n_class)`` for every row."""
    sizes = df.groupBy(F.col(label).alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    weights = sizes.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"),
                        F.map_from_entries(F.collect_list(F.struct("__y", "__n"))).alias("by"))  # two classes
    packed = weights.select(F.struct("n", "k", "by").alias("s")).scalar()
    return df.withColumn("__w", packed).withColumn(
        name, F.col("__w.n") / (F.col("__w.k") * F.col("__w.by")[F.col(label)])).drop("__w")


def fit_scaler(sequences: DataFrame, x: str = "x") -> DataFrame:
    """Mean and population deviation per feature over all steps of all windows; a deviation
    below 1e-8 becomes 1."""
    cells = sequences.select(F.explode(x).alias("step")).select(F.posexplode("step").alias("feature", "value"))
    out = cells.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select("feature", "mean", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")).alias("scale"))


def apply_scaler(sequences: DataFrame, model: DataFrame, x: str = "x") -> DataFrame:
    """Scales every step. The model has one row per feature and is read to the driver."""
    rows = sorted(model.collect(), key=lambda r: r["feature"])
    mean = F.array(*[F.lit(r["mean"]) for r in rows])
    scale = F.array(*[F.lit(r["scale"]) for r in rows])

    def one(step: Column) -> Column:
        centred = F.zip_with(step, mean, lambda v, m: v - m)
        return F.zip_with(centred, scale, lambda v, s: v / s)

    return sequences.withColumn(x, F.transform(F.col(x), one))
