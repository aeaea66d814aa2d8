"""Ordered per-key computation that does not depend on how large a key is.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. That is the best plan
while a key is small (one shuffle, one sort), and it fails when a single key holds a large
part of the table. The functions below therefore count rows per key first (one aggregation
over the key columns) and treat hot keys apart. Their rows are range partitioned by
(key, order) into slices of similar size, every slice is computed on its own, and the totals
of the earlier slices of the same key (one small row per key and slice) are added.

``split`` overrules the count: False uses the plain window for all keys, True slices all.

Aggregates are given as ``{name: (kind, column)}`` with the kinds ``count``
(non-null values; ``ROWS`` counts rows), ``sum``, ``min``, ``max`` and ``last``
(latest non-null).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardflow.session import materialize, max_group_rows, shuffles_dropped, stored, stored_at

SLICE = "__slice"
ROWS = ("count", None)
WHOLE = ("byte", "short", "integer", "long")

Aggs = Mapping[str, tuple[str, Column | None]]


def hot_keys(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame | None:
    """Keys with more than ``spark.cardflow.maxGroupRows`` rows, whatever the table holds, or None. One aggregate says whether there are any;
    only then is their list stored, so that Spark knows its size and chooses between broadcast and shuffle by it."""
    both = dfs[0].select(*keys)
    for df in dfs[1:]:
        both = both.unionByName(df.select(*keys))
    counted, limit = both.groupBy(*keys).count(), max_group_rows(both.sparkSession)
    if (counted.agg(F.max("count")).first()[0] or 0) <= limit:
        return None
    return stored(counted.filter(F.col("count") > limit).select(*keys))


def by_heat(dfs: Sequence[DataFrame], keys: Sequence[str], work: Callable[..., DataFrame]) -> DataFrame:
    """``work(*tables, split=False)`` for the ordinary keys and ``split=True`` for the hot ones.
    Without keys the tables are one group, which is hot when it is large."""
    if not keys:
        large = sum(df.count() for df in dfs) > max_group_rows(dfs[0].sparkSession)
        return work(*dfs, split=large)
    hot = hot_keys(dfs, keys)
    if hot is None:
        return work(*dfs, split=False)

    def part(df: DataFrame, how: str) -> DataFrame:
        side = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
        return df.join(side, [df[k].eqNullSafe(side[f"__hot_{k}"]) for k in keys], how)

    return work(*[part(df, "left_anti") for df in dfs], split=False).unionByName(
        work(*[part(df, "left_semi") for df in dfs], split=True))


def slice_count(df: DataFrame, times: int = 1) -> int:
    """As many slices as so many times the rows need, and at least as many as a shuffle would make."""
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    return max(least, -(-times * df.count() // max_group_rows(df.sparkSession)))


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   slices: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """Adds ``SLICE``: consecutive, evenly filled slices in (keys, order). The result
    is stored because range bounds are sampled anew on every evaluation; what it was shuffled by
    is dropped. ``paths`` gets its folder, for a caller that drops it."""
    slices = slice_count(df) if slices is None else slices
    ranged = df.repartitionByRange(slices, *[F.col(k) for k in keys], *order).withColumn(SLICE, F.spark_partition_id())
    with shuffles_dropped(df.sparkSession):
        if re.search('"(void|interval[^"]*)"', ranged.schema.json()):  # types that Parquet doesn't hold
            return materialize(ranged)
        out, path = stored_at(ranged)
    if paths is not None:
        paths.append(path)
    return out


def _value(column: Column | None) -> Column:
    return F.lit(1) if column is None else column


def _aggregate(kind: str, column: Column | None) -> Column:
    column = _value(column)
    if kind == "last":
        return F.last(column, ignorenulls=True)
    return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[kind](column)


def _merge(kind: str) -> str:
    """The aggregate that folds partial results of ``kind``."""
    return "sum" if kind == "count" else kind


def _combine(kind: str, before: Column, local: Column) -> Column:
    if kind == "count":
        return F.coalesce(before, F.lit(0)) + local
    if kind == "sum":
        return F.coalesce(before + local, before, local)
    if kind == "last":
        return F.coalesce(local, before)
    return {"min": F.least, "max": F.greatest}[kind](before, local)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], aggs: Aggs,
            include_current: bool = True, totals: Aggs | None = None, split: bool | None = None,
            slices: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """Running aggregates over the rows of the key up to (or before) each row, and ``totals``
    over all rows of the key. ``order`` must be total within a key; without keys the whole
    table is one group. ``slices`` and ``paths`` are those of ``ordered_slices``."""
    if split is None:
        return by_heat([df], keys, lambda rows, split: running(
            rows, keys, order, aggs, include_current, totals, split))
    totals = totals or {}
    end = W.currentRow if include_current else -1
    if not split:
        group = W.partitionBy(*keys)
        frame = group.orderBy(*order).rowsBetween(W.unboundedPreceding, end)
        return df.select("*", *[_aggregate(k, c).over(frame).alias(n) for n, (k, c) in aggs.items()],
                         *[_aggregate(k, c).over(group).alias(n) for n, (k, c) in totals.items()])

    sliced = ordered_slices(df, keys, order, slices, paths)
    group = [*keys, SLICE]
    by_slice = W.partitionBy(*group).orderBy(*order)
    frame = by_slice.rowsBetween(W.unboundedPreceding, end)
    local = sliced.select("*", *[_aggregate(k, c).over(frame).alias(f"__l_{n}") for n, (k, c) in aggs.items()])

    parts = {**aggs, **totals}
    ranked = any(k == "last" for k, _ in parts.values())
    source = sliced.withColumn("__rn", F.row_number().over(by_slice)) if ranked else sliced
    sums = source.groupBy(*group).agg(*[
        F.max_by(c, F.when(c.isNotNull(), F.col("__rn"))).alias(f"__t_{n}") if k == "last"
        else _aggregate(k, c).alias(f"__t_{n}")
        for n, (k, c) in parts.items()])
    # One row per key and slice, so at most as many rows per key as there are slices.
    slices = W.partitionBy(*keys).orderBy(SLICE)
    earlier = slices.rowsBetween(W.unboundedPreceding, -1)
    every = slices.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carry = sums.select(
        *[F.col(g).alias(f"__c_{g}") for g in group],
        *[_aggregate(_merge(k), F.col(f"__t_{n}")).over(earlier).alias(f"__c_{n}") for n, (k, _) in aggs.items()],
        *[_aggregate(_merge(k), F.col(f"__t_{n}")).over(every).alias(f"__c_{n}") for n, (k, _) in totals.items()])
    match = [local[g].eqNullSafe(carry[f"__c_{g}"]) for g in group]
    joined = local.join(carry, match, "left")
    return joined.select(
        *[local[c] for c in df.columns],
        *[_combine(k, F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n) for n, (k, _) in aggs.items()],
        *[F.col(f"__c_{n}").alias(n) for n in totals])


def latest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
           payload: Sequence[str], tiebreak: Sequence[str] = (), inclusive: bool = True,
           null_keys: bool = False, split: bool | None = None) -> DataFrame:
    """For each left row the latest right row of the same key with
    ``right_time <= left_time`` (``<`` if not inclusive). Both sides are stacked and
    read in time order, so the work is one sort and no pairs are formed.
    Adds ``payload`` (columns of the right side), NULL where nothing precedes. As in a join,
    a NULL key matches nothing, unless ``null_keys`` makes it a key like any other."""
    if split is None:
        return by_heat([left, right], keys, lambda a, b, split: latest(
            a, b, keys, left_time, right_time, payload, tiebreak, inclusive, null_keys, split))
    value = F.struct(*[F.col(c).alias(c) for c in payload])
    row = F.struct(*[F.col(c) for c in left.columns])
    ties = [f"__tie{i}" for i in range(len(tiebreak))]
    usable = F.col(right_time).isNotNull()
    for k in () if null_keys else keys:
        usable = usable & F.col(k).isNotNull()
    rights = right.filter(usable).select(
        *keys, F.col(right_time).alias("__t"), F.lit(0 if inclusive else 1).alias("__side"),
        *[F.col(c).alias(t) for c, t in zip(tiebreak, ties)], value.alias("__value"))
    lefts = left.select(
        *keys, F.col(left_time).alias("__t"), F.lit(1 if inclusive else 0).alias("__side"),
        *[F.lit(None).cast(right.schema[c].dataType).alias(t) for c, t in zip(tiebreak, ties)],
        row.alias("__row"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    order = [F.col("__t"), F.col("__side"), *[F.col(t) for t in ties]]
    if split:
        # Left rows that share a key and time are interchangeable here; a hash spreads them.
        order.append(F.xxhash64(*[F.col(f"__row.`{c}`") for c in left.columns
                                  if left.schema[c].dataType.typeName() not in ("map", "variant")]))
    found = running(both, keys, order, {"__found": ("last", F.col("__value"))}, split=split)
    return found.filter(F.col("__row").isNotNull()).select(
        *[F.col(f"__row.`{c}`").alias(c) for c in left.columns],
        *[F.col(f"__found.`{c}`").alias(c) for c in payload])


def _upto(df: DataFrame, keys: Sequence[str], time: str, tiebreak: Sequence[str], aggs: Aggs) -> DataFrame:
    """Sliced running aggregates under their own names, with nothing but the order columns."""
    source = df.select(*keys, time, *tiebreak, *[_value(c).alias(f"__v_{n}") for n, (_, c) in aggs.items()])
    order = [F.col(time), *[F.col(t) for t in tiebreak]]
    out = running(source, keys, order, {n: (k, F.col(f"__v_{n}")) for n, (k, _) in aggs.items()}, split=True)
    return out.select(*keys, time, *tiebreak, *aggs)


def prefixes(df: DataFrame, keys: Sequence[str], time: str, tiebreak: Sequence[str], aggs: Aggs,
             points: Mapping[str, tuple[int, bool]], split: bool | None = None,
             upto: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """Aggregates over the rows of the key before several points per row. A point
    ``{label: (shift, inclusive)}`` takes the rows with ``time < row.time - shift`` (``<=`` if
    inclusive) and adds ``{aggregate}_{label}``: unlike ``running`` with rows, tied rows never
    see each other. ``time`` is a whole number; counts are 0 and the others NULL when nothing
    qualifies. ``upto`` are sliced running aggregates, if the caller has them; else the rows are
    sliced once, and only points that lie in another slice than their row are looked up."""
    if df.schema[time].dataType.typeName() not in WHOLE:
        raise TypeError(f"{time} must be a whole number, for instance epoch microseconds")
    if split is None:
        return by_heat([df], keys, lambda rows, split: prefixes(rows, keys, time, tiebreak, aggs, points, split))
    if not split:
        order = W.partitionBy(*keys).orderBy(time)
        frames = {label: order.rangeBetween(W.unboundedPreceding, -shift if inclusive else -shift - 1)
                  for label, (shift, inclusive) in points.items()}
        return df.select("*", *[_aggregate(k, c).over(frame).alias(f"{n}_{label}")
                                for label, frame in frames.items() for n, (k, c) in aggs.items()])
    if upto is not None or any(k == "last" for k, _ in aggs.values()):
        return _looked_up(df, keys, time, tiebreak, aggs, points, _upto(df, keys, time, tiebreak, aggs) if upto is None else upto)
    return _sliced(ordered_slices(df, keys, [F.col(time), *[F.col(t) for t in tiebreak]], slices), keys, time, tiebreak, aggs, points)


def _sliced(sliced: DataFrame, keys: Sequence[str], time: str, tiebreak: Sequence[str], aggs: Aggs,
            points: Mapping[str, tuple[int, bool]]) -> DataFrame:
    """``prefixes`` of slices. A point is answered by the row's own slice and the totals of the earlier ones, if all of their rows
    and none of the later ones lie before it."""
    columns, group = [c for c in sliced.columns if c != SLICE], [*keys, SLICE]
    every = {**aggs, "__timed": ("count", F.col(time))}
    # One row per key and slice, of keys in more than one: at most two per slice.
    sums = sliced.groupBy(*group).agg(F.min(time).alias("__first"), F.max(time).alias("__last"), *[_aggregate(k, c).alias(f"__t_{n}") for n, (k, c) in every.items()])
    by_slice = W.partitionBy(*keys).orderBy(SLICE)
    earlier, later = by_slice.rowsBetween(W.unboundedPreceding, -1), by_slice.rowsBetween(1, W.unboundedFollowing)
    edges = sums.select(
        *group, F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("__slices"),
        F.max("__last").over(earlier).alias("__before"), F.min("__first").over(later).alias("__after"),
        *[_aggregate(_merge(k), F.col(f"__t_{n}")).over(earlier).alias(f"__c_{n}") for n, (k, _) in every.items()])
    with shuffles_dropped(sliced.sparkSession):
        edges = stored(edges.filter("__slices > 1").drop("__slices").withColumnsRenamed({g: f"__e_{g}" for g in group}))
    marked = sliced.join(edges, [sliced[g].eqNullSafe(edges[f"__e_{g}"]) for g in group], "left").drop(*[f"__e_{g}" for g in group])

    def aside(shift: int, inclusive: bool) -> Column:
        point, before, after = F.col(time) - F.lit(shift), F.col("__before"), F.col("__after")
        return F.coalesce((before > point) | (after < point) | ((after if inclusive else before) == point), F.lit(False))

    far = reduce(lambda a, b: a | b, [aside(*point) for point in points.values()])
    order = W.partitionBy(*group).orderBy(time)
    frames = {label: order.rangeBetween(W.unboundedPreceding, -shift if inclusive else -shift - 1) for label, (shift, inclusive) in points.items()}
    local = marked.withColumn("__far", far).select("*", *[_aggregate(k, c).over(frame).alias(f"__l_{n}_{label}") for label, frame in frames.items() for n, (k, c) in every.items()])

    def value(n: str, kind: str, label: str) -> Column:
        some = F.col(time).isNotNull() & (_combine("count", F.col("__c___timed"), F.col(f"__l___timed_{label}")) > 0)
        found = F.when(some, _combine(kind, F.col(f"__c_{n}"), F.col(f"__l_{n}_{label}")))
        return (F.coalesce(found, F.lit(0)) if kind == "count" else found).alias(f"{n}_{label}")

    near = local.filter(~F.col("__far")).select(*columns, *[value(n, k, label) for label in points for n, (k, _) in aggs.items()])
    rows = marked.filter(far).select(*columns)
    if rows.isEmpty():
        return near
    several = edges.select(*[F.col(f"__e_{k}") for k in keys]).distinct()
    sources = sliced.join(several, [sliced[k].eqNullSafe(several[f"__e_{k}"]) for k in keys], "left_semi") if keys else sliced
    rows = stored(rows)
    return near.unionByName(_looked_up(rows, keys, time, tiebreak, aggs, points, _upto(sources, keys, time, tiebreak, aggs)))


def _looked_up(df: DataFrame, keys: Sequence[str], time: str, tiebreak: Sequence[str], aggs: Aggs, points: Mapping[str, tuple[int, bool]],
               upto: DataFrame) -> DataFrame:
    """``prefixes`` by the value of the latest row before each point, found among the running aggregates."""
    out = df
    for label, (shift, inclusive) in points.items():
        named = upto.select(*keys, time, *tiebreak, *[F.col(n).alias(f"{n}_{label}") for n in aggs])
        probes = out.withColumn("__probe", F.col(time) - F.lit(shift))
        out = latest(probes, named, keys, "__probe", time, [f"{n}_{label}" for n in aggs], tiebreak, inclusive,
                     null_keys=True, split=True).drop("__probe")
    return out.select(*df.columns, *[
        (F.coalesce(F.col(f"{n}_{label}"), F.lit(0)) if k == "count" else F.col(f"{n}_{label}")).alias(f"{n}_{label}")
        for label in points for n, (k, _) in aggs.items()])


def prefix(df: DataFrame, keys: Sequence[str], time: str, tiebreak: Sequence[str], aggs: Aggs,
           shift: int = 0, inclusive: bool = False, split: bool | None = None) -> DataFrame:
    """``prefixes`` for a single point; the aggregates keep their names."""
    out = prefixes(df, keys, time, tiebreak, aggs, {"__p": (shift, inclusive)}, split)
    return out.select(*df.columns, *[F.col(f"{n}___p").alias(n) for n in aggs])


def trailing(df: DataFrame, keys: Sequence[str], time: str, tiebreak: Sequence[str],
             widths: Mapping[str, int], aggs: Aggs, peers: str = "arrived",
             split: bool | None = None, now: Aggs | None = None) -> DataFrame:
    """Counts and sums over ``[time - width, time]`` for every row, as the difference of
    two running totals: the cost is linear however long the window is. Sums should be
    decimal so that the difference is exact. ``peers="arrived"`` counts tied rows up to
    the row itself in ``tiebreak`` order, ``peers="all"`` all tied rows.
    Adds ``{agg}_{width name}`` for every pair, and the aggregates ``now`` over all rows up to this one."""
    if split is None:
        return by_heat([df], keys, lambda rows, split: trailing(
            rows, keys, time, tiebreak, widths, aggs, peers, split, now))
    now = now or {}
    points = {f"__old_{label}": (width, False) for label, width in widths.items()}
    if peers == "arrived":
        order = [F.col(time), *[F.col(t) for t in tiebreak]]
        out = running(df, keys, order, {f"{n}___now": a for n, a in {**aggs, **now}.items()}, split=split)
        upto = out.select(*keys, time, *tiebreak, *[F.col(f"{n}___now").alias(n) for n in aggs]) if split else None
        out = prefixes(out, keys, time, tiebreak, aggs, points, split, upto)
    else:
        out = prefixes(df, keys, time, tiebreak, {**aggs, **now}, {"__now": (0, True)}, split)
        out = prefixes(out, keys, time, tiebreak, aggs, points, split)
    return out.select(*df.columns, *[
        (F.col(f"{n}___now") - F.coalesce(F.col(f"{n}___old_{label}"), F.lit(0))).alias(f"{n}_{label}")
        for label in widths for n in aggs], *[F.col(f"{n}___now").alias(n) for n in now])


def tail_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, length: int,
              name: str, split: bool | None = None) -> DataFrame:
    """Adds an array with ``value`` of the row and of its up to ``length - 1`` predecessors."""
    if split is None:
        return by_heat([df], keys, lambda rows, split: tail_rows(rows, keys, order, value, length, name, split))
    if not split:
        frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(length - 1), 0)
        return df.select("*", F.collect_list(value).over(frame).alias(name))
    sliced = ordered_slices(df, keys, order)
    group = [*keys, SLICE]
    by_slice = W.partitionBy(*group).orderBy(*order)
    local = sliced.select("*", F.collect_list(value).over(by_slice.rowsBetween(-(length - 1), 0)).alias("__local"),
                          F.row_number().over(by_slice).alias("__rn"))
    ends = local.groupBy(*group).agg(F.max_by("__local", "__rn").alias("__end"))
    # Every slice of a key holds at least one row, so length - 1 slices are enough.
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(-(length - 1), -1)
    carry = ends.select(*[F.col(g).alias(f"__c_{g}") for g in group],
                        F.flatten(F.collect_list("__end").over(earlier)).alias("__before"))
    joined = local.join(carry, [local[g].eqNullSafe(carry[f"__c_{g}"]) for g in group], "left")
    merged = F.concat(F.coalesce(F.col("__before"), F.slice("__local", 1, 0)), F.col("__local"))
    tail = F.when(F.col("__rn") >= length, F.col("__local")).otherwise(
        F.slice(merged, F.greatest(F.size(merged) - F.lit(length - 1), F.lit(1)), length))
    return joined.select(*[local[c] for c in df.columns], tail.alias(name))
