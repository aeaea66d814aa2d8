"""Equi-joins, lookups, alignment and the as-of join.

No side is broadcast by hint: Spark broadcasts what is below its size threshold, measured
at run time by adaptive execution, and otherwise shuffles and splits skewed partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from cardflow.functions.columns import bare_card, canonical_card
from cardflow.operators.ordered import latest
from cardflow.operators.quantiles import quantile_columns, with_row


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``; give an order that is total to make the survivor
    unique. Spark keeps one row per key and input partition before the shuffle (a partial
    window group limit), so a key with many copies is reduced where it is read."""
    if not [c for c in df.columns if c not in keys]:
        return df.distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def join_identity(tx: DataFrame, identity: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Left join of one optional row per key, both sides deduplicated."""
    def one(df: DataFrame) -> DataFrame:
        return dedup(df, [key], [c for c in order if c in df.columns] or [c for c in df.columns if c != key])
    return one(tx).join(one(identity), key, "left")


def join_optional(a: DataFrame, b: DataFrame | None, key: str) -> DataFrame:
    """Left join; ``a`` unchanged when the other side or the key is missing."""
    if b is None or key not in a.columns or key not in b.columns:
        return a
    return a.join(b, key, "left")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Left join that must not change the number of rows: refuses a key that occurs twice."""
    for name, side in (("left", a), ("right", b)):
        if not duplicate_keys(side.select(key), [key]).isEmpty():
            raise ValueError(f"{key} is not unique on the {name} side")
    return a.join(b, key, "left")


def linkage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides, only left, only right."""
    left = a.select(F.col(key).alias("__l")).filter(F.col(key).isNotNull()).distinct()
    right = b.select(F.col(key).alias("__r")).filter(F.col(key).isNotNull()).distinct()
    return left.join(right, F.col("__l") == F.col("__r"), "full_outer").agg(
        F.count("__l").alias("left_keys"), F.count("__r").alias("right_keys"),
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("overlap"),
        F.count_if(F.col("__r").isNull()).alias("left_only"),
        F.count_if(F.col("__l").isNull()).alias("right_only"))


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str,
              payload: Sequence[str], tiebreak: Sequence[str] = (), tolerance: int | None = None,
              split: bool | None = None) -> DataFrame:
    """The latest right row of the key at or before the left time, if it is at most
    ``tolerance`` old. A record from the future is never used."""
    found = latest(left, right.withColumn("__rt", F.col(right_time)), [by], left_time, right_time,
                   ["__rt", *payload], tiebreak, split=split)
    fresh = F.col("__rt").isNotNull()
    if tolerance is not None:
        fresh = F.col(left_time) - F.col("__rt") <= tolerance
    return found.select(*left.columns, F.when(fresh, F.col("__rt")).alias("matched_time"),
                        *[F.when(fresh, F.col(p)).alias(p) for p in payload])


def lookup_profile(events: DataFrame, profiles: DataFrame, key: str = "card_id") -> DataFrame:
    """Left join in which ``CARD-7`` and ``7`` meet; ``known`` tells whether a profile exists. A card has one profile: that of the
    event's own spelling, else that of the other. Of profiles with one spelling, the one with the greatest hash."""
    names = [c for c in profiles.columns if c != key]
    spelled = F.col(key).cast("string")
    rank = F.xxhash64(*[F.col(c) for c in names if profiles.schema[c].dataType.typeName() not in ("map", "variant")])
    profile, prefixed = F.struct(*names), spelled.startswith("CARD-")
    side = profiles.filter(F.col(key).isNotNull()).groupBy(bare_card(key).alias("__key")).agg(
        F.max_by(F.when(prefixed, profile), F.when(prefixed, rank)).alias("__card"),
        F.max_by(F.when(~prefixed, profile), F.when(~prefixed, rank)).alias("__bare"))
    keyed = events.withColumn("__key", bare_card(canonical_card(key))).join(side, "__key", "left")
    own = F.when(spelled.startswith("CARD-"), F.coalesce("__card", "__bare")).otherwise(F.coalesce("__bare", "__card"))
    return keyed.withColumn("__own", own).select(
        *[F.col(c) for c in events.columns], *[F.col(f"__own.`{c}`").alias(c) for c in names], F.col("__own").isNotNull().alias("known"))


def align_predictions(a: DataFrame, b: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Scores of two models on their common ids, with a flag where the labels agree."""
    left = a.select(key, F.col(label).alias("y"), F.col(score).alias("p_a"))
    right = b.select(key, F.col(label).alias("__y"), F.col(score).alias("p_b"))
    return left.join(right, key).select(key, "y", "p_a", "p_b", F.col("y").eqNullSafe(F.col("__y")).alias("labels_agree"))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.count(F.lit(1)).alias("common_ids"),
                       F.count_if(~F.col("labels_agree")).alias("label_mismatches"))


def parity_report(a: DataFrame, b: DataFrame, key: str, score: str, threshold: float, tolerance: float) -> DataFrame:
    """Absolute score differences of two runs: counts, decision agreement and quantiles."""
    joined = a.select(key, F.col(score).alias("__a")).join(b.select(key, F.col(score).alias("__b")), key)
    diff = joined.select(F.abs(F.col("__a") - F.col("__b")).alias("diff"),
                         ((F.col("__a") >= threshold) == (F.col("__b") >= threshold)).alias("same"))
    counts = diff.agg(F.count(F.lit(1)).alias("rows"), F.count_if("same").alias("decisions_equal"),
                      F.count_if(F.col("diff") <= tolerance).alias("within_tolerance"),
                      F.avg("diff").alias("mean_diff"), F.max("diff").alias("max_diff"))
    return with_row(counts, quantile_columns(diff, [], "diff", {"p50": .5, "p95": .95, "p99": .99}))


def lineage(events: DataFrame, features: DataFrame, key: str, feature_cols: Sequence[str]) -> DataFrame:
    """Each event with the feature record it triggered, flat."""
    side = features.select(key, *feature_cols, F.lit(True).alias("__has"))
    return events.join(side, key, "left").withColumn(
        "has_features", F.coalesce("__has", F.lit(False))).drop("__has")


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that occur on both sides."""
    return a.select(key).intersect(b.select(key))


def id_missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids of ``a`` left over after taking away those of ``b`` (duplicates count)."""
    return a.select(key).exceptAll(b.select(key))


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits in one table, tagged with their name."""
    out = None
    for name, df in splits.items():
        tagged = df.withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that only one of two tables has, or that differ in type."""
    types_a, types_b = dict(a.dtypes), dict(b.dtypes)
    rows = [(c, types_a.get(c), types_b.get(c)) for c in sorted({*types_a, *types_b})
            if types_a.get(c) != types_b.get(c)]
    return a.sparkSession.createDataFrame(rows, "column string, left_type string, right_type string")
