"""Trailing-time features per event and event-time windows (batch).

The window functions also accept streaming DataFrames unless stated otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardflow.functions.columns import (
    AMOUNT_SCALE_BELOW, AMOUNT_SCALE_UPTO, LONG_UNITS, MONEY_UNIT, amount_of, bucketize, money, money_rest, money_sum, ratio, true_labels)
from cardflow.operators.ordered import ROWS, by_heat, prefixes, running, slice_count, trailing
from cardflow.session import drop_stored

SECOND = 1_000_000
LARGE = LONG_UNITS / MONEY_UNIT
ROWS_PER_TASK = 100_000  # rows whose windows a task forms, ten windows or so each


def _parts(amount: str) -> dict[str, tuple[str, Column]]:
    """What sums over trailing windows are made of: whole units, parts of a unit, and amounts too large for units."""
    rest, huge = money_rest(amount), F.abs(F.col(amount).cast("double")) >= LARGE
    return {"__s": ("sum", money(amount)), "__r": ("sum", F.when(huge | F.isnan(rest), 0.0).otherwise(rest)),
            "__b": ("sum", F.when(huge & (F.abs(rest) < float("inf")), rest).otherwise(0.0))}


def _odd(amount: str, time: str) -> dict[str, tuple[str, Column]]:
    """The latest time of each kind of amount that has no units: whether one is in a window does not follow from a difference."""
    value = F.col(amount).cast("double")
    kinds = {"nan": F.isnan(value), "inf": value == float("inf"), "-inf": value == float("-inf"), "huge": (F.abs(value) >= LARGE) & (F.abs(value) < float("inf"))}
    return {f"__{name}": ("max", F.when(hit, F.col(time))) for name, hit in kinds.items()}


def _total(label: str, time: str, width: int) -> Column:
    """The sum over a trailing window, as Spark's own sum would be."""
    inside = {name: F.coalesce(F.col(f"`__{name}`") >= F.col(time) - F.lit(width), F.lit(False)) for name in ("nan", "inf", "-inf", "huge")}
    odd = F.when(inside["nan"] | (inside["inf"] & inside["-inf"]), float("nan")).when(inside["inf"], float("inf")).when(inside["-inf"], float("-inf"))
    total = amount_of(f"__s_{label}", f"__r_{label}")
    return odd.when(inside["huge"], total + F.col(f"__b_{label}")).otherwise(total)


def trailing_velocity(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], amount: str = "amount",
                      short: int = 300 * SECOND, long: int = 600 * SECOND, split: bool | None = None) -> DataFrame:
    """Count, sum and average over ``[time - width, time]`` for two widths, their ratios and
    the bucket of the long sum. Tied rows count up to the row itself."""
    widths = {"short": short, "long": long}
    out = trailing(df, [key], time, tiebreak, widths, {"__n": ROWS, **_parts(amount)}, split=split, now=_odd(amount, time))

    def total(w: str) -> Column:
        return F.greatest(F.coalesce(_total(w, time, widths[w]), F.lit(0.0)), F.lit(0.0))

    one = F.lit(1)
    return out.select(
        *df.columns,
        F.col("__n_short").alias("count_short"), total("short").alias("total_short"),
        (total("short") / F.greatest(F.col("__n_short"), one)).alias("avg_short"),
        F.col("__n_long").alias("count_long"), total("long").alias("total_long"),
        (total("long") / F.greatest(F.col("__n_long"), one)).alias("avg_long"),
        (F.col("__n_short") / F.greatest(F.col("__n_long"), one)).alias("count_ratio"),
        (total("short") / F.greatest(total("long"), F.lit(1.0))).alias("amount_ratio"),
        bucketize(total("long"), AMOUNT_SCALE_UPTO, right=True).alias("amount_bucket"))


def trailing_distinct(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], value: str, width: int,
                      name: str, split: bool | None = None, slices: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """Distinct non-null values in ``[time - width, time]``, all tied rows included.

    Each occurrence is "the latest one of its value" for a stretch of time: from its own time
    until the value's next occurrence or until it leaves the window. The distinct count is the
    number of open stretches, i.e. stretches begun minus stretches ended: two running counts.
    ``slices`` are those of the rows; ``paths`` gets the folder of the slices that the result reads."""
    if split is None:
        return by_heat([df], [key], lambda rows, split: trailing_distinct(
            rows, key, time, tiebreak, value, width, name, split))
    first: list[str] = []
    occurrences = df.filter(F.col(value).isNotNull()).select(key, time, *tiebreak, value)
    descending = [F.col(time).desc(), *[F.col(t).desc() for t in tiebreak]]
    nexts = running(occurrences, [key, value], descending, {"__next": ("last", F.col(time))},
                    include_current=False, split=split, slices=slices, paths=first)
    leaves = F.col(time) + F.lit(width + 1)
    edges = nexts.select(key, F.explode(F.array(
        F.struct(F.col(time).alias("__at"), F.lit(1).alias("__delta")),
        F.struct(F.least(leaves, F.coalesce(F.col("__next"), leaves)).alias("__at"), F.lit(-1).alias("__delta")),
    )).alias("__e")).select(key, "__e.*")
    # One row per (key, time) is enough, and collapses hot instants before the ordered pass.
    steps = edges.groupBy(key, "__at").agg(F.sum("__delta").alias("__delta"))
    stacked = steps.select(key, F.col("__at").alias(time), "__delta", F.lit(0).alias("__side")).unionByName(
        df.select(key, time, F.lit(1).alias("__side"), *[F.col(t) for t in tiebreak],
                  F.struct(*[F.col(c) for c in df.columns]).alias("__row")), allowMissingColumns=True)
    order = [F.col(time), F.col("__side"), *[F.col(t) for t in tiebreak]]
    counted = running(stacked, [key], order, {"__open": ("sum", F.col("__delta"))}, split=split, slices=slices and 3 * slices, paths=paths)
    for path in first:  # read by the slices just written
        drop_stored(df.sparkSession, path)
    return counted.filter(F.col("__row").isNotNull()).select(
        *[F.col(f"__row.`{c}`").alias(c) for c in df.columns],
        F.coalesce(F.col("__open"), F.lit(0)).cast("long").alias(name))


def features_at(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], amount: str = "amount",
                merchant: str = "merchant_id", short: int = 300 * SECOND, long: int = 600 * SECOND,
                split: bool | None = None) -> DataFrame:
    """The six trailing features with "now" at each row's own time, all tied rows included."""
    if split is None:
        return by_heat([df], [key], lambda rows, split: features_at(
            rows, key, time, tiebreak, amount, merchant, short, long, split))
    aggs = {"__n": ROWS, **_parts(amount), "__t": ("max", F.col(time)), **_odd(amount, time)}
    slices, paths = slice_count(df) if split else None, []
    out = trailing_distinct(df, key, time, tiebreak, merchant, long, "unique_merchants_long", split, slices, paths)
    out = prefixes(out, [key], time, tiebreak, aggs, {"now": (0, True), "before": (0, False), "short": (short, False), "long": (long, False)}, split, slices=slices)
    for path in paths:  # read by the slices just written
        drop_stored(df.sparkSession, path)

    out = out.withColumnsRenamed({f"__{name}_now": f"__{name}" for name in ("nan", "inf", "-inf", "huge")})
    for w in ("short", "long"):
        out = out.withColumns({f"__{p}_{w}": F.col(f"__{p}_now") - F.coalesce(F.col(f"__{p}_{w}"), F.lit(0)) for p in ("s", "r", "b")})

    # The distance between the two latest events up to now is 0 when now itself is tied.
    tied = F.col("__n_now") - F.col("__n_before") > 1
    gap = F.when(tied, F.lit(0).cast("long")).otherwise(F.col(time) - F.col("__t_before"))
    return out.select(
        *df.columns,
        (F.col("__n_now") - F.col("__n_short")).alias("count_short"), _total("short", time, short).alias("amount_short"),
        (F.col("__n_now") - F.col("__n_long")).alias("count_long"), _total("long", time, long).alias("amount_long"),
        "unique_merchants_long", gap.alias("since_previous"))


def features_now(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], now: Column, amount: str = "amount",
                 merchant: str = "merchant_id", short: int = 300 * SECOND, long: int = 600 * SECOND,
                 split: bool | None = None) -> DataFrame:
    """The six trailing features of every key at one given moment: a single aggregation."""
    past = df.filter(F.col(time) <= now)
    gaps = running(past, [key], [F.col(time), *[F.col(t) for t in tiebreak]],
                   {"__prev": ("last", F.col(time))}, include_current=False, split=split)
    in_short, in_long = F.col(time) >= now - F.lit(short), F.col(time) >= now - F.lit(long)
    zero = F.lit(0.0)
    return gaps.groupBy(key).agg(
        F.count_if(in_short).alias("count_short"),
        F.coalesce(money_sum(F.when(in_short, F.col(amount))), zero).alias("amount_short"),
        F.count_if(in_long).alias("count_long"),
        F.coalesce(money_sum(F.when(in_long, F.col(amount))), zero).alias("amount_long"),
        F.count_distinct(F.when(in_long, F.col(merchant))).alias("unique_merchants_long"),
        F.max_by(F.col(time) - F.col("__prev"), F.struct(time, *tiebreak)).alias("since_previous"))


def velocity_alerts(df: DataFrame, key: str, time: str, tiebreak: Sequence[str], amount: str = "amount",
                    country: str = "country", width: int = 60 * SECOND, max_count: int = 3,
                    max_spend: float = 5000.0, foreign: str = "FOREIGN", split: bool | None = None) -> DataFrame:
    """Trailing count and spend, and the alerts they raise: more than ``max_count`` rows, spend
    above ``max_spend``, or a foreign country beside another one."""
    is_foreign = F.col(country) == foreign
    out = trailing(df, [key], time, tiebreak, {"w": width}, {
        "__n": ROWS, **_parts(amount),
        "__foreign": ("count", F.when(is_foreign, 1)),
        "__other": ("count", F.when(~is_foreign & (F.col(country) != ""), 1))}, split=split, now=_odd(amount, time))
    spend = _total("w", time, width)
    alerts = true_labels({
        "VELOCITY": F.col("__n_w") > max_count,
        "BURST_SPEND": spend > max_spend,
        "GEO_HOP": (F.col("__foreign_w") > 0) & (F.col("__other_w") > 0)})
    return out.select(*df.columns, F.col("__n_w").alias("count_in_window"),
                      F.coalesce(spend, F.lit(0.0)).alias("spend_in_window"), alerts.alias("alerts"))


UNITS = {"second": SECOND, "minute": 60 * SECOND, "hour": 3600 * SECOND, "day": 86400 * SECOND}


def micros(duration: str) -> int:
    """``10 minutes`` in microseconds."""
    number, unit = duration.split()
    return int(number) * UNITS[unit.rstrip("s")]


def hopping_features(df: DataFrame, size: str = "10 minutes", slide: str = "1 minute", tail: str = "5 minutes",
                     distinct: str = "exact", key: str = "card_id", time: str = "event_time",
                     amount: str = "amount", merchant: str = "merchant_id") -> DataFrame:
    """Hopping windows per key: count and sum over the window and over its last ``tail``, and
    distinct merchants. ``distinct``: ``exact`` (batch), ``set`` (exact) or ``approx``. On a stream: ``streams.hopping_stream``."""
    if distinct == "exact" and not micros(size) % micros(slide) and not micros(tail) % micros(slide):
        return _hopping_panes(df, micros(size), micros(slide), micros(tail), key, time, amount, merchant)
    merchants = {"exact": F.count_distinct, "approx": F.approx_count_distinct,
                 "set": lambda c: F.size(F.collect_set(c)).cast("long")}[distinct](F.col(merchant))
    windowed = df.withColumn("__w", F.window(time, size, slide))
    in_tail = F.col(time) >= F.col("__w.end") - F.expr(f"INTERVAL {tail}")
    return windowed.groupBy("__w", key).agg(
        F.count_if(in_tail).alias("count_tail"),
        money_sum(F.when(in_tail, F.col(amount)).otherwise(0.0)).alias("amount_tail"),
        F.count(F.lit(1)).alias("count_window"), money_sum(amount).alias("amount_window"),
        merchants.alias("unique_merchants"),
    ).select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), key,
             "count_tail", "amount_tail", "count_window", "amount_window", "unique_merchants")


def _hopping_panes(df: DataFrame, size: int, slide: int, tail: int, key: str, time: str, amount: str,
                   merchant: str) -> DataFrame:
    """The same in batch, without shuffling a row once per window: rows are summed per pane (one
    slide long) first, and a pane is sent to the at most two blocks of windows it lies in.
    Windows are then formed inside the block, where all their panes are."""
    k, keep = size // slide, (size - tail) // slide
    panes = df.filter(F.col(time).isNotNull()).groupBy(
        key, F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(slide)).alias("__p"), merchant).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(money(amount)).alias("__s"), F.sum(money_rest(amount)).alias("__r"))
    pane = F.col("__p")
    blocks = F.array_distinct(F.array(F.floor((pane - (k - 1)) / F.lit(k)), F.floor(pane / F.lit(k))))
    # A task holds every window of its panes, so the number of tasks goes by the rows.
    spark = df.sparkSession
    tasks = -(-df.count() // ROWS_PER_TASK)
    several = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    placed = panes.withColumn("__b", F.explode(blocks)).repartition(*several, key, "__b")
    first = F.col("__b") * k
    starts = F.sequence(F.greatest(pane - (k - 1), first), F.least(pane, first + (k - 1)))
    in_tail = pane >= F.col("__w") + keep
    out = placed.withColumn("__w", F.explode(starts)).groupBy(key, "__b", "__w").agg(
        F.sum(F.when(in_tail, F.col("__n")).otherwise(0)).alias("count_tail"),
        F.coalesce(amount_of(F.sum(F.when(in_tail, F.col("__s"))), F.sum(F.when(in_tail, F.col("__r")))), F.lit(0.0)).alias("amount_tail"),
        F.sum("__n").alias("count_window"), amount_of(F.sum("__s"), F.sum("__r")).alias("amount_window"),
        F.count_distinct(merchant).alias("unique_merchants"))
    start = F.col("__w") * slide
    return out.select(F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + size).alias("window_end"), key,
                      "count_tail", "amount_tail", "count_window", "amount_window", "unique_merchants")


def window_summary(df: DataFrame, size: str, slide: str | None = None, key: str = "card_id",
                   time: str = "event_time", amount: str = "amount") -> DataFrame:
    """Tumbling (no slide) or hopping count, total, average and amount bucket per key."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(window.alias("__w"), key).agg(
        F.count(F.lit(1)).alias("transaction_count"), money_sum(amount).alias("total_amount"))
    return out.select(
        F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), key,
        "transaction_count", "total_amount",
        (F.col("total_amount") / F.col("transaction_count")).alias("average_amount"),
        bucketize("total_amount", AMOUNT_SCALE_BELOW).alias("amount_bucket"))


def window_velocity(df: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", back: str = "5 minutes",
                    key: str = "card_id", time: str = "event_time", amount: str = "amount") -> DataFrame:
    """Per hopping window and key: the whole window against the time ``back`` from its latest
    event (on a stream: ``streams.window_velocity_stream``). Rows are first summed per (window, key, instant), so a hot window
    enters the join with its latest instant in pre-aggregated form."""
    instants = df.groupBy(F.window(time, size, slide).alias("__w"), key, time).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(money(amount)).alias("__s"), F.sum(money_rest(amount)).alias("__r"))
    newest = instants.groupBy("__w", key).agg(F.max(time).alias("__latest")).select(
        F.col("__w").alias("__lw"), F.col(key).alias("__lk"), "__latest")
    joined = instants.join(newest, (F.col("__w") == F.col("__lw")) & F.col(key).eqNullSafe(F.col("__lk")))
    recent = F.col(time) >= F.col("__latest") - F.expr(f"INTERVAL {back}")
    out = joined.groupBy("__w", key).agg(
        F.sum(F.when(recent, F.col("__n")).otherwise(0)).alias("count_short"),
        amount_of(F.sum(F.when(recent, F.col("__s"))), F.sum(F.when(recent, F.col("__r")))).alias("total_short"),
        F.sum("__n").alias("count_long"), amount_of(F.sum("__s"), F.sum("__r")).alias("total_long"))
    return velocity_columns(out, key)


def recent_totals(held: DataFrame, rows: str, latest: str, back: int, key: str) -> DataFrame:
    """The result of ``window_velocity`` from the instants of a window: structs of time, rows, units and rest of the amounts."""
    def total(some: Column) -> Column:
        units = F.aggregate(some, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.coalesce(x["s"], F.lit(0))).cast("decimal(38,0)"))
        return F.when(F.exists(some, lambda x: x["s"].isNotNull()), amount_of(units, F.aggregate(some, F.lit(0.0), lambda a, x: a + F.coalesce(x["r"], F.lit(0.0)))))

    def count(some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x["n"])

    recent = F.filter(rows, lambda x: x["t"] >= F.col(latest) - F.lit(back))
    return velocity_columns(held.select(
        "__w", key, count(recent).alias("count_short"), total(recent).alias("total_short"),
        count(F.col(rows)).alias("count_long"), total(F.col(rows)).alias("total_long")), key)


def velocity_columns(out: DataFrame, key: str) -> DataFrame:
    total_ratio = F.when(F.col("total_long") > 0, ratio(F.col("total_short"), F.col("total_long"))).otherwise(0.0)
    return out.select(
        F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), key,
        "count_short", "total_short", (F.col("total_short") / F.col("count_short")).alias("avg_short"),
        "count_long", "total_long", (F.col("total_long") / F.col("count_long")).alias("avg_long"),
        (F.col("count_short") / F.col("count_long")).alias("count_ratio"), total_ratio.alias("amount_ratio"),
        bucketize("total_long", AMOUNT_SCALE_BELOW).alias("amount_bucket"))


def accept_late(df: DataFrame, time: str, arrival: Sequence[str], delay: int, keys: Sequence[str] = (),
                split: bool | None = None) -> DataFrame:
    """Adds ``accepted``: the row is at most ``delay`` behind the newest time seen so far, in
    arrival order (of its source, if ``keys`` name one)."""
    out = running(df, keys, [F.col(a) for a in arrival], {"__seen": ("max", F.col(time))}, split=split)
    return out.select(*df.columns, (F.col(time) >= F.col("__seen") - F.lit(delay)).alias("accepted"))
