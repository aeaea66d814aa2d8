"""Log, delivery and split audits. Each returns a small table; hot partitions and keys are
handled by the ordered functions they build on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cardflow.operators.aggregate import distribution
from cardflow.operators.joins import parity_report
from cardflow.operators.ordered import running


def audit_offsets(log: DataFrame, partition: str = "partition", offset: str = "offset",
                  arrival: Sequence[str] = ("offset",), split: bool | None = None) -> DataFrame:
    """Per partition: offsets that do not rise in arrival order, and gaps."""
    out = running(log.select(partition, offset, *[a for a in arrival if a != offset]), [partition],
                  [F.col(a) for a in arrival], {"__prev": ("last", F.col(offset))}, include_current=False, split=split)
    step = F.col(offset) - F.col("__prev")
    return out.groupBy(partition).agg(
        F.count(F.lit(1)).alias("rows"), F.min(offset).alias("first_offset"), F.max(offset).alias("last_offset"),
        F.count_if(step <= 0).alias("not_rising"), F.count_if(step > 1).alias("gaps"))


def audit_affinity(log: DataFrame, key: str, partition: str = "partition") -> DataFrame:
    """Keys, and keys that were seen in more than one partition."""
    per_key = log.groupBy(key).agg((F.min(partition) != F.max(partition)).alias("spread"))
    return per_key.agg(F.count(F.lit(1)).alias("keys"), F.count_if("spread").alias("keys_in_several_partitions"))


def audit_order(log: DataFrame, key: str, sequence: str, offset: str = "offset", split: bool | None = None) -> DataFrame:
    """Rows whose sequence number does not rise with the offset within their key."""
    out = running(log.select(key, sequence, offset), [key], [F.col(offset)],
                  {"__prev": ("last", F.col(sequence))}, include_current=False, split=split)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(sequence) <= F.col("__prev")).alias("out_of_order"))


def audit_delivery(sent: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Sent ids, lost ids, repeated deliveries and ids nobody sent."""
    a = sent.groupBy(F.col(key).alias("__s")).agg(F.count(F.lit(1)).alias("__ns"))
    b = received.groupBy(F.col(key).alias("__r")).agg(F.count(F.lit(1)).alias("__nr"))
    both = a.join(b, F.col("__s") == F.col("__r"), "full_outer")
    return both.agg(
        F.count("__s").alias("sent_ids"), F.count("__r").alias("received_ids"),
        F.count_if(F.col("__r").isNull()).alias("lost"),
        F.coalesce(F.sum(F.greatest(F.col("__nr") - F.coalesce("__ns", F.lit(1)), F.lit(0))), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("__s").isNull()).alias("unexpected"))


def audit_repeatable(a: DataFrame, b: DataFrame, key: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Two runs agree when every difference is within 1e-12."""
    report = parity_report(a, b, key, score, threshold, 1e-12)
    return report.select("rows", "decisions_equal", "within_tolerance", "max_diff",
                         (F.col("rows") == F.col("within_tolerance")).alias("repeatable"))


def ingest_latency(log: DataFrame, received: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Distribution of receive time minus event time; negative differences are clock errors."""
    late = log.select(*by, (F.col(received) - F.col(event)).alias("latency")).filter("latency >= 0")
    return distribution(late, "latency", by)


def integrity(df: DataFrame, key: str, time: str, features: Sequence[str], label: str,
              splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Split checks as rows ``(check, passed)`` from one aggregation per id and one over ids."""
    per_id = df.groupBy(key).agg(*[F.count_if(F.col("split") == s).alias(f"__{s}") for s in splits])
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    ids = per_id.agg(
        *[F.count_if(F.col(f"__{s}") > 1).alias(f"no_duplicate_ids_{s}") for s in splits],
        *[F.count_if((F.col(f"__{a}") > 0) & (F.col(f"__{b}") > 0)).alias(f"no_overlap_{a}_{b}") for a, b in pairs])
    ranges = df.agg(*[f(F.when(F.col("split") == s, F.col(time))).alias(f"__{n}_{s}")
                      for s in splits for n, f in (("min", F.min), ("max", F.max))],
                    *[F.count_if(F.col("split") == s).alias(f"__rows_{s}") for s in splits],
                    F.count(F.lit(1)).alias("__rows"), F.count_if(F.col(label).isNull()).alias("__label_nulls"))
    checks = [F.struct(F.lit(c).alias("check"), (F.col(c) == 0).alias("passed")) for c in ids.columns]
    order = [F.struct(F.lit(f"{a}_before_{b}").alias("check"), F.coalesce(
        F.col(f"__max_{a}") < F.col(f"__min_{b}"), F.lit(False)).alias("passed")) for a, b in zip(splits, splits[1:])]
    more = {
        "label_not_a_feature": F.lit(label not in features), "id_not_a_feature": F.lit(key not in features),
        "time_not_a_feature": F.lit(time not in features), "labels_complete": F.col("__label_nulls") == 0,
        "every_split_filled": sum((F.col(f"__rows_{s}") > 0).cast("int") for s in splits) == len(splits),
        "split_rows_add_up": sum(F.col(f"__rows_{s}") for s in splits) == F.col("__rows")}
    order += [F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in more.items()]
    return ids.select(F.explode(F.array(*checks)).alias("c")).select("c.*").unionByName(
        ranges.select(F.explode(F.array(*order)).alias("c")).select("c.*"))
