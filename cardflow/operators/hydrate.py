"""Point-in-time assembly of feature rows and the gate in front of scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardflow.functions.columns import true_labels
from cardflow.operators.history import causal_counters
from cardflow.operators.ordered import by_heat
from cardflow.operators.joins import asof_join, lookup_profile
from cardflow.operators.prep import tier
from cardflow.sources.sinks import write_once

# Fields without which a row is not scored, and the reasons given.
ESSENTIAL_EVENT = ("amount", "event_time", "product_code")
ESSENTIAL_PROFILE = ("card1", "card4", "card6")
UNKNOWN_CARD_MISSING = ("card1", "card4", "card6", "addr1")
MISSING_EVENT = "MISSING_EVENT_FIELDS"
UNKNOWN_CARD = "UNKNOWN_CARD"
INCOMPLETE = "INCOMPLETE_HYDRATION"


def gate(df: DataFrame, profile_fields: Sequence[str] = ESSENTIAL_PROFILE,
         event_fields: Sequence[str] = ESSENTIAL_EVENT, identity: str = "transaction_id",
         known: str = "known") -> DataFrame:
    """Adds ``complete``, ``rejection_reason`` and ``missing_features``. The decision uses the event
    and the profile only, so it does not depend on the order of events."""
    no_event = F.col(identity).isNull() | F.col("amount").isNull() | F.col("event_time").isNull()
    absent = true_labels({c: F.col(c).isNull() for c in (*profile_fields, *event_fields) if c in df.columns})
    event_absent = true_labels({c: F.col(c).isNull() for c in (identity, "amount", "event_time")})
    reason = (F.when(no_event, MISSING_EVENT).when(~F.col(known), UNKNOWN_CARD)
              .when(F.size(absent) > 0, INCOMPLETE))
    missing = (F.when(no_event, event_absent).when(~F.col(known), F.array(*[F.lit(c) for c in UNKNOWN_CARD_MISSING]))
               .otherwise(absent))
    return df.withColumn("rejection_reason", reason).withColumn("missing_features", missing).withColumn(
        "complete", F.col("rejection_reason").isNull())


def hydrate(events: DataFrame, profiles: DataFrame, velocity: DataFrame | None = None, key: str = "card_id",
            time: str = "event_time", tiebreak: Sequence[str] = ("transaction_id",), velocity_time: str = "velocity_time",
            velocity_count: str = "count_5m", tolerance: int | None = None, day: float = 86400.0,
            profile_fields: Sequence[str] = ESSENTIAL_PROFILE, split: bool | None = None) -> DataFrame:
    """Event + profile + gate + as-of velocity + causal counters. Only rows that pass the gate
    enter the history of later ones."""
    if split is None:
        # One look at the keys of both sides decides for all steps.
        sides = [events] if velocity is None else [events, velocity]
        return by_heat(sides, [key], lambda ev, vel=None, split=False: hydrate(
            ev, profiles, vel, key, time, tiebreak, velocity_time, velocity_count, tolerance, day, profile_fields, split))
    rows = gate(lookup_profile(events, profiles, key), profile_fields)
    if velocity is not None:
        rows = asof_join(rows, velocity, key, time, velocity_time, [velocity_count], (velocity_count,), tolerance, split)
        rows = rows.drop("matched_time")
    return causal_counters(rows, key, time, tiebreak, F.col("complete"),
                           velocity_count if velocity is not None else None, day, split)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to score, rejected rows)."""
    return df.filter("complete"), df.filter(~F.col("complete"))


def provenance_map(names: Sequence[str]) -> Column:
    """Map from feature name to its availability tier."""
    keys = F.array(*[F.lit(n) for n in names])
    return F.map_from_arrays(keys, F.transform(keys, tier))


def write_gated(batch: DataFrame, scored_path: str, quarantine_path: str, batch_id: int) -> None:
    """Both outputs of one micro-batch, in folders of the same number; a batch that comes again is not written again."""
    batch = batch.persist()  # computed once for both

    def write(slot: int) -> None:
        kept, rejected = quarantine(batch)
        for df, path in ((kept, scored_path), (rejected, quarantine_path)):
            df.write.mode("overwrite").parquet(f"{path}/batch_id={slot}")

    try:
        write_once([scored_path, quarantine_path], batch, batch_id, write)
    finally:
        batch.unpersist()
