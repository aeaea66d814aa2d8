"""Exact quantiles without a task that holds all values, and without sorting the table.

A first pass brackets every quantile by an approximate sketch whose rank error is known. A
second pass counts the rows between the brackets as a whole and the values inside them one
by one, which leaves a small table with exact ranks. Should a bracket miss, or should there
be too many groups for this, all distinct values are ranked instead (``ordered.running``,
which splits large groups)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardflow.operators.ordered import running
from cardflow.session import materialize

ACCURACY = 10_000  # rank error of the sketch: rows / ACCURACY
MAX_BRACKETED_GROUPS = 1_000


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row result as a scalar subquery, evaluated once."""
    packed = row.select(F.struct(*[F.col(c) for c in row.columns]).alias("__packed")).scalar()
    return df.withColumn("__row", packed).select(
        *df.columns, *[F.col(f"__row.`{c}`").alias(c) for c in row.columns])


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), kind: str = "double",
              name: str = "feature", value: str = "value") -> DataFrame:
    """One row per cell: ``(keep..., feature, value)`` in a single pass over the table."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in cols])
    return df.select(*keep, F.explode(cells).alias("__cell")).select(*keep, f"__cell.{name}", f"__cell.{value}")


def _ranks(p: float, size: Column, method: str) -> list[Column]:
    """Ranks from 0 whose values make up the quantile."""
    if method == "nearest":
        return [F.least(F.floor(F.lit(float(p)) * size), size - 1)]
    position = F.lit(float(p)) * (size - 1)
    return [F.floor(position), F.ceil(position)]


def _hits(ranked: DataFrame, by: Sequence[str], probs: Mapping[str, float], method: str) -> DataFrame:
    """``(by, __size, __value, __gap, __quantile, __part)``: the value at every wanted rank, out of rows
    that stand for the ranks from ``__upto - __n`` to below ``__upto``."""
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), rank.alias("rank"))
                       for i, p in enumerate(probs.values()) for j, rank in enumerate(_ranks(p, F.col("__size"), method))])
    here = F.filter(wanted, lambda w: (w["rank"] >= F.col("__upto") - F.col("__n")) & (w["rank"] < F.col("__upto")))
    return ranked.select(*by, "__size", "__value", "__gap", F.explode(here).alias("__w")).select(
        *by, "__size", "__value", "__gap", F.col("__w.i").alias("__quantile"), F.col("__w.j").alias("__part"))


def _between(p: float, size: int, parts: Mapping[int, float], method: str):
    if method == "nearest":
        return parts[0]
    position = float(p) * (size - 1)
    return float(parts[0]) + (float(parts[1]) - float(parts[0])) * (position - int(position))


def _ranked_values(df: DataFrame, by: Sequence[str], value: str, split: bool | None) -> DataFrame:
    """Every distinct value with the number of rows at or below it."""
    counts = df.groupBy(*by, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    if split is None:
        counts = materialize(counts)  # read twice: for the size check and for the ranks
    n = ("sum", F.col("__n"))
    return running(counts, by, [F.col("__value")], {"__upto": n}, totals={"__size": n}, split=split).withColumn(
        "__gap", F.lit(False))


def _brackets(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame | None:
    """``(by, __lo0, __hi0, __lo1, ...)``: rising bracket ends, NULL for an open end. At most
    MAX_BRACKETED_GROUPS rows, or None."""
    margin = 2.0 / ACCURACY
    points = sorted(set(probs.values()))
    ends = [(q, f"__{side}{i}") for i, p in enumerate(points) for q, side in ((p - margin, "lo"), (p + margin, "hi"))]
    sketch = F.percentile_approx(value, [max(0.0, min(1.0, q)) for q, _ in ends], ACCURACY)
    rows = df.groupBy(*by).agg(sketch.alias("__q")).limit(MAX_BRACKETED_GROUPS + 1).collect()
    if len(rows) > MAX_BRACKETED_GROUPS:
        return None
    found = [(*[r[b] for b in by], *[x if 0 < q < 1 else None for x, (q, _) in zip(r["__q"] or [None] * len(ends), ends)])
             for r in rows]
    kind = df.schema[value].dataType.simpleString()
    schema = [f"`__b_{b}` {df.schema[b].dataType.simpleString()}" for b in by] + [f"{name} {kind}" for _, name in ends]
    return df.sparkSession.createDataFrame(found, ", ".join(schema))


def _ranked_inside(df: DataFrame, by: Sequence[str], value: str, ends: DataFrame) -> DataFrame:
    """Values inside a bracket, and one row for all values of each gap between brackets."""
    if by:
        side = F.broadcast(ends)  # at most MAX_BRACKETED_GROUPS rows
        placed = df.join(side, [F.col(b).eqNullSafe(F.col(f"__b_{b}")) for b in by])
    else:
        placed = with_row(df, ends)
    v, k = F.col(value), sum(c.startswith("__lo") for c in ends.columns)
    los, his = [F.col(f"__lo{i}") for i in range(k)], [F.col(f"__hi{i}") for i in range(k)]
    inside, gap, below = F.lit(False), F.lit(0), []
    for lo, hi in zip(los, his):
        inside = inside | (F.coalesce(v >= lo, F.lit(True)) & F.coalesce(v <= hi, F.lit(True)))
        gap = gap + F.coalesce((hi < v).cast("int"), F.lit(0))
        below.insert(0, F.when(hi < v, hi))  # the highest bracket below the value comes first
    rows = placed.select(*by, F.when(inside, v).alias("__value"), F.when(~inside, gap).alias("__g"),
                         F.when(inside, v).otherwise(F.coalesce(*below)).alias("__anchor"))
    counts = materialize(rows.groupBy(*by, "__anchor", "__g", "__value").agg(F.count(F.lit(1)).alias("__n")))
    # A gap lies right above the end of the bracket before it.
    order = [F.col("__anchor").asc_nulls_first(), F.col("__g").asc_nulls_first()]
    n = ("sum", F.col("__n"))
    return running(counts, by, order, {"__upto": n}, totals={"__size": n}).withColumn("__gap", F.col("__g").isNotNull())


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
                     method: str = "linear", split: bool | None = None, ends: DataFrame | None = None) -> DataFrame:
    """One row per group with a column per quantile. ``linear`` interpolates between ranks,
    ``nearest`` takes the value at rank ``int(p * n)``. ``split`` forces the ranking of all
    values, in one task per group or in slices. ``ends``: brackets from elsewhere (``sketches.brackets``), which saves the first pass."""
    present = df.filter(F.col(value).isNotNull()).select(*by, value)
    kind = df.schema[value].dataType.simpleString() if method == "nearest" else "double"
    if split is None:
        ends = _brackets(present, by, value, probs) if ends is None else ends
        if ends is not None:
            # A few rows per bracketed group.
            rows = _hits(_ranked_inside(present, by, value, ends), by, probs, method).collect()
            if not any(r["__gap"] for r in rows):
                groups: dict[tuple, dict] = {}
                for r in rows:
                    mine = groups.setdefault(tuple(r[b] for b in by), {"size": r["__size"]})
                    mine.setdefault(r["__quantile"], {})[r["__part"]] = r["__value"]
                out = [(*key, *[_between(p, g["size"], g[i], method) for i, p in enumerate(probs.values())])
                       for key, g in groups.items()]
                fields = [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by] + [f"`{n}` {kind}" for n in probs]
                return df.sparkSession.createDataFrame(out, ", ".join(fields))
    hits = _hits(_ranked_values(present, by, value, split), by, probs, method)
    position = F.struct("__quantile", "__part")
    found = hits.groupBy(*by, "__size").agg(F.map_from_entries(F.collect_list(F.struct(position, "__value"))).alias("__at"))
    out = []
    for i, (name, p) in enumerate(probs.items()):
        at = [F.col("__at")[F.struct(F.lit(i).alias("__quantile"), F.lit(j).alias("__part"))]
              for j in range(len(_ranks(p, F.lit(1), method)))]
        place = F.lit(float(p)) * (F.col("__size") - 1)
        one = at[0] if method == "nearest" else at[0].cast("double") + (
            at[1].cast("double") - at[0].cast("double")) * (place - F.floor(place))
        out.append(one.cast(kind).alias(name))
    return found.select(*by, *out)
