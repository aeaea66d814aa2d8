"""Population stability, drift triggers and time-window audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardflow.functions.columns import money_sum, ratio
from cardflow.operators import sketches as S
from cardflow.operators.ordered import running
from cardflow.operators.quantiles import long_form, quantile_columns, with_row
from cardflow.session import materialize

# Smoothing, trigger threshold and counts of the drift protocol.
EPSILON = 1e-6
PSI_THRESHOLD = 0.10
TRIGGER_FEATURES = 6
MIN_ROWS = 50_000
UNSEEN = "__UNSEEN__"
MISSING = "__NULL__"


def _bin(value: Column, inner: Sequence[float], clip: str) -> Column:
    """Number of inner edges at or below the value. ``clip="inner"`` first moves values to the
    range of the inner edges, which leaves the first bin empty."""
    if not inner:
        return F.lit(0)
    if clip == "inner":
        value = F.least(F.greatest(value, F.lit(inner[0])), F.lit(inner[-1]))
    elif clip != "none":
        raise ValueError(f"clip must be 'none' or 'inner', not {clip!r}")
    return F.size(F.filter(F.array(*[F.lit(e) for e in inner]), lambda e: e <= value))


def numeric_edges(df: DataFrame, cols: Sequence[str], bins: int = 10, sketches: DataFrame | None = None) -> dict[str, list[float]]:
    """Inner edges per column: distinct interpolated quantiles without the two outer ones, which
    stand for minus and plus infinity. A model table of ``columns x bins`` numbers. With stored ``sketches`` of the rows (one per column), the pass that
    brackets the quantiles isn't needed; the edges are the same."""
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    if sketches is not None:
        rows = S.exact_quantiles(df, cols, names, sketches).collect()
    else:
        rows = quantile_columns(long_form(df, cols), ["feature"], "value", names).collect()
    return {r["feature"]: sorted({r[n] for n in names})[1:-1] for r in rows}


def _bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], clip: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), _bin(
        F.col(c).cast("double"), inner, clip)).alias("bin")) for c, inner in edges.items()])
    return (df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("bin").isNotNull())
            .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")))


def _numeric_props(df: DataFrame, edges: Mapping[str, Sequence[float]], clip: str = "none") -> DataFrame:
    """Smoothed share of every bin, empty ones included. The counts are at most columns x bins
    numbers and are read to the driver."""
    counts = {(r["feature"], r["bin"]): r["n"] for r in _bin_counts(df, edges, clip).collect()}
    rows = []
    for c, inner in edges.items():
        bins = len(inner) + 1
        total = sum(counts.get((c, i), 0) for i in range(bins))
        rows += [(c, i, bins, (counts.get((c, i), 0) + EPSILON) / (total + EPSILON * bins)) for i in range(bins)]
    return df.sparkSession.createDataFrame(rows, "feature string, bin int, bins int, prop double")


def _category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (long_form(df, cols, kind="string", value="category")
            .groupBy("feature", F.coalesce("category", F.lit(MISSING)).alias("category"))
            .agg(F.count(F.lit(1)).alias("n")))


class PsiReference:
    """Reference distributions: ``edges`` and two small tables, ``numeric (feature, bin, bins, prop)``
    and ``categorical (feature, category, share)``."""

    def __init__(self, edges: dict[str, list[float]], numeric: DataFrame | None, categorical: DataFrame | None):
        self.edges, self.numeric, self.categorical = edges, numeric, categorical


def fit_psi(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = 10, sketches: DataFrame | None = None) -> PsiReference:
    edges = numeric_edges(df, numeric, bins, sketches) if numeric else {}
    shares = None
    if categorical:
        counts = _category_counts(df, categorical)
        totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
        shares = materialize(counts.join(totals, "feature").select(
            "feature", "category", (F.col("n") / F.col("total")).alias("share")))
    props = _numeric_props(df, edges) if edges else None
    return PsiReference(edges, props, shares)


def psi_numeric(ref: PsiReference, df: DataFrame, clip: str = "none") -> DataFrame:
    """PSI per numeric feature. ``inner`` keeps the clipping rule of the published figures."""
    now = _numeric_props(df, ref.edges, clip).select("feature", "bin", F.col("prop").alias("now"))
    term = (F.col("now") - F.col("prop")) * F.log(F.col("now") / F.col("prop"))
    return ref.numeric.join(now, ["feature", "bin"]).groupBy("feature").agg(F.sum(term).alias("psi"))


def psi_categorical(ref: PsiReference, df: DataFrame) -> DataFrame:
    """PSI per categorical feature; categories outside the reference are pooled."""
    features = [r["feature"] for r in ref.categorical.select("feature").distinct().collect()]
    counts = _category_counts(df, features)
    sizes = ref.categorical.groupBy("feature").agg((F.count(F.lit(1)) + 1).alias("k"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    matched = counts.join(ref.categorical, ["feature", "category"], "full_outer")
    pooled = matched.groupBy("feature", F.when(F.col("share").isNotNull(), F.col("category")).otherwise(
        UNSEEN).alias("category")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.max("share").alias("share"))
    # Tables of one row per feature join by size at run time.
    terms = pooled.join(sizes, "feature").join(totals, "feature", "left")
    total = F.coalesce("total", F.lit(0))
    now = (F.col("n") + EPSILON) / (total + EPSILON * F.col("k"))
    before = F.coalesce("share", F.lit(0.0)) + EPSILON / F.col("k")
    return terms.groupBy("feature").agg(F.sum((now - before) * F.log(now / before)).alias("psi"))


def psi(ref: PsiReference, df: DataFrame, clip: str = "none") -> DataFrame:
    parts = []
    if ref.numeric is not None:
        parts.append(psi_numeric(ref, df, clip))
    if ref.categorical is not None:
        parts.append(psi_categorical(ref, df))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def top_drift(values: DataFrame, n: int = 5) -> DataFrame:
    return values.orderBy(F.desc("psi"), "feature").limit(n)


def drift_trigger(values: DataFrame, rows: int, threshold: float = PSI_THRESHOLD, features: int = TRIGGER_FEATURES,
                  min_rows: int = MIN_ROWS) -> DataFrame:
    """Number of shifted features and whether the monitor fires. Too small a window is an error."""
    if rows < min_rows:
        raise ValueError(f"monitoring window too small: {rows} < {min_rows}")
    shifted = F.count_if(F.col("psi") >= threshold)
    return values.agg(F.count(F.lit(1)).alias("features"), shifted.alias("shifted"),
                      (shifted >= features).alias("triggered")).withColumn("rows", F.lit(rows).cast("long"))


def save_reference(ref: PsiReference, path: str) -> None:
    """Three Parquet tables under ``path``."""
    spark = (ref.numeric or ref.categorical).sparkSession
    edge_rows = [(c, [float(e) for e in inner]) for c, inner in ref.edges.items()]
    spark.createDataFrame(edge_rows, "feature string, inner array<double>").write.mode("overwrite").parquet(f"{path}/edges")
    for name, table in (("numeric", ref.numeric), ("categorical", ref.categorical)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_reference(spark: SparkSession, path: str, numeric: bool = True, categorical: bool = True) -> PsiReference:
    edges = {r["feature"]: list(r["inner"]) for r in spark.read.parquet(f"{path}/edges").collect()}
    return PsiReference(edges, spark.read.parquet(f"{path}/numeric") if numeric else None,
                        spark.read.parquet(f"{path}/categorical") if categorical else None)


def ks_stat(ref: DataFrame, df: DataFrame, cols: Sequence[str], split: bool | None = None) -> DataFrame:
    """Largest distance between the two empirical distributions, per feature."""
    both = (long_form(ref, cols).withColumn("now", F.lit(0))
            .unionByName(long_form(df, cols).withColumn("now", F.lit(1))).filter(F.col("value").isNotNull()))
    counts = both.groupBy("feature", "value").agg(F.count_if(F.col("now") == 0).alias("a"),
                                                  F.count_if(F.col("now") == 1).alias("b"))
    counts = materialize(counts)
    a, b = ("sum", F.col("a")), ("sum", F.col("b"))
    upto = running(counts, ["feature"], [F.col("value")], {"a_upto": a, "b_upto": b},
                   totals={"a_all": a, "b_all": b}, split=split)
    gap = F.abs(ratio(F.col("a_upto"), F.col("a_all")) - ratio(F.col("b_upto"), F.col("b_all")))
    return upto.groupBy("feature").agg(F.max(gap).alias("ks"))


def drift_windows(df: DataFrame, time: str, label: str, amount: str, card: str, n: int = 6) -> DataFrame:
    """Equal-width time windows. The last one is closed, so every row is counted."""
    span = df.agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    placed = with_row(df.select(time, label, amount, card), span)
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(n))
    # Compared with the window bounds themselves: dividing by the width may round across one.
    guess = F.floor((F.col(time) - F.col("__lo")) / F.nullif(width, F.lit(0.0)))
    up = (F.col("__lo") + (guess + 1) * width <= F.col(time)).cast("long")
    down = (F.col("__lo") + guess * width > F.col(time)).cast("long")
    window = F.least(F.coalesce(guess + up - down, F.lit(0)), F.lit(n - 1)) + 1
    return placed.groupBy(window.alias("window")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("fraud_rows"),
        F.avg(F.col(label).cast("double")).alias("fraud_rate"),
        (money_sum(amount) / F.count(amount)).alias("mean_amount"),
        F.count_distinct(card).alias("unique_cards"))


def period_audit(df: DataFrame, period: str, label: str, cols: Sequence[str]) -> DataFrame:
    """Rows, positives, rate and mean share of missing cells per period."""
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.groupBy(F.col(period).alias("period")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("fraud_rows"),
        F.avg(F.col(label).cast("double")).alias("fraud_rate"),
        (F.sum(missing) / (F.count(F.lit(1)) * len(cols))).alias("mean_missing"))
