"""Aggregates of one's own, in two phases: rows are added to partial states where they lie, and the states of a group are merged.

An aggregate says how a state begins, takes rows, takes another state, and ends as a result row. Only states are shuffled, one for each group and task (or for each
HELD groups of a task), so that a group with most of the rows is no more work for its merging task than any other. Results don't depend on how rows
are spread, as far as the aggregate's own arithmetic doesn't."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cardflow.functions.columns import MONEY_UNIT, amount_of, money, money_rest
from cardflow.operators.velocity import micros, velocity_columns

#: Groups whose states a task holds before it passes them on.
HELD = 50_000


class Aggregate:
    """``result``: the schema of what ``finish`` gives. A state is anything that can be pickled."""

    result: str

    def create(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, rows: dict[str, np.ndarray]) -> Any:
        """Some rows of a group, by column; NULLs are NaN in numbers and None elsewhere."""
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> tuple:
        raise NotImplementedError


def _groups(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by group, and where in it each group begins."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in by:
        coded = batch.column(c).dictionary_encode()
        one = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (len(coded.dictionary) + 1) + one, return_inverse=True)
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order], prepend=-1))


def _partials(batches: Iterator[pa.RecordBatch], by: Sequence[str], columns: Sequence[str], agg: Aggregate, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, Any] = {}

    def out() -> pa.RecordBatch:
        keys = list(zip(*held)) if held else [[] for _ in by]
        states = pa.array([pickle.dumps(s) for s in held.values()], pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(list(k), schema.field(c).type) for k, c in zip(keys, by, strict=True)), states], names=[*by, "state"])

    for batch in batches:
        if not batch.num_rows:
            continue
        order, first = _groups(batch, by)
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False)[order] for c in columns}
        keys = [batch.column(c).take(pa.array(order[first])).to_pylist() for c in by]
        for a, b, *key in zip(first, [*first[1:], batch.num_rows], *keys):
            key = tuple(key)
            state = held[key] if key in held else agg.create()
            held[key] = agg.add(state, {c: x[a:b] for c, x in rows.items()})
        if len(held) >= HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _merged(batches: Iterator[pa.RecordBatch], by: Sequence[str], agg: Aggregate, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """States in the order of their groups."""
    key, state, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for *this, raw in zip(*(batch.column(c).to_pylist() for c in (*by, "state")), strict=True):
            other = pickle.loads(raw)
            if state is not None and this == key:
                state = agg.merge(state, other)
                continue
            if state is not None:
                done.append((*key, *agg.finish(state)))
            key, state = this, other
            if len(done) >= 10_000:
                yield out()
                done = []
    if state is not None:
        done.append((*key, *agg.finish(state)))
    if done:
        yield out()


def user_aggregate(df: DataFrame, by: Sequence[str], columns: Sequence[str], agg: Aggregate) -> DataFrame:
    """``by`` and the result of the aggregate over ``columns``, for each group."""
    rows = df.select(*by, *columns)
    fields = [rows.schema[c] for c in by]
    inner, outer = StructType([*fields]).add("state", "binary"), StructType([*fields])
    for f in StructType.fromDDL(agg.result):
        outer = outer.add(f)
    inner_arrow, outer_arrow = to_arrow_schema(inner), to_arrow_schema(outer)
    states = rows.mapInArrow(lambda b: _partials(b, by, columns, agg, inner_arrow), inner)
    # sorted by their bytes too, so that the order of merging doesn't depend on that of arrival
    states = states.repartition(*by).sortWithinPartitions(*by, "state")
    return states.mapInArrow(lambda b: _merged(b, by, agg, outer_arrow), outer)


class Moments(Aggregate):
    """Number, mean and variances of a column by Welford's recurrence, NULLs left out; merging adds the distance of the means."""

    result = "n long, mean double, var_pop double, var_samp double"

    def __init__(self, column: str):
        self.column = column

    def create(self) -> tuple[int, float, float]:
        return 0, 0.0, 0.0

    def add(self, state, rows):
        x = rows[self.column].astype(float)
        x = x[~np.isnan(x)]
        return self.merge(state, (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()))) if len(x) else state

    def merge(self, a, b):
        (n, mean, m2), (k, other, more) = a, b
        total = n + k
        if not total:
            return a
        gap = other - mean
        return total, mean + gap * k / total, m2 + more + gap * gap * n * k / total

    def finish(self, state):
        n, mean, m2 = state
        return n, mean if n else None, m2 / n if n else None, m2 / (n - 1) if n > 1 else None


class RecentTotals(Aggregate):
    """Rows and amounts as a whole, and of the time ``back`` from the latest one. A state keeps an entry for each instant that can still be
    recent, so a merge forgets what the other's latest time leaves behind. Columns: t (microseconds), known (there is an amount), units and rest, as ``money`` has them."""

    result = "count_short long, units_short decimal(38,0), rest_short double, count_long long, units_long decimal(38,0), rest_long double"

    def __init__(self, back: int):
        self.back = back

    def create(self):
        return {}, [0, 0, 0, 0.0]  # instants; rows, rows with an amount, units, rest

    def add(self, state, rows):
        times, at = np.unique(rows["t"], return_inverse=True)
        instants: dict[int, list] = {int(t): [0, 0, 0, 0.0] for t in times}
        for i, k, u, r in zip(times[at].tolist(), rows["known"].tolist(), rows["units"].tolist(), rows["rest"].tolist(), strict=True):
            entry = instants[i]
            entry[0] += 1
            if k:
                entry[1] += 1
                entry[2] += int(u)
                entry[3] += r
        whole = [sum(e[j] for e in instants.values()) for j in range(4)]
        return self.merge(state, (instants, whole))

    def merge(self, a, b):
        instants = dict(a[0])
        for t, entry in b[0].items():
            instants[t] = [x + y for x, y in zip(instants[t], entry, strict=True)] if t in instants else entry
        least = max(instants, default=0) - self.back
        return {t: e for t, e in instants.items() if t >= least}, [x + y for x, y in zip(a[1], b[1], strict=True)]

    def finish(self, state):
        out = []
        for rows, known, units, rest in ([sum(e[j] for e in state[0].values()) for j in range(4)], state[1]):
            out += [rows, Decimal(units) if known else None, float(rest) if known else None]
        return tuple(out)


def window_velocity_by_state(df: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", back: str = "5 minutes",
                             key: str = "card_id", time: str = "event_time", amount: str = "amount") -> DataFrame:
    """``velocity.window_velocity`` by mergeable states, without a join: one shuffled state for each window, key and task."""
    rows = df.filter(F.col(time).isNotNull()).select(F.window(time, size, slide).alias("__w"), key, F.unix_micros(F.col(time).cast("timestamp")).alias("t"),
                                                     money(amount).cast("long").alias("units"), money_rest(amount).alias("rest"))
    rows = rows.select(F.unix_micros(F.col("__w.start").cast("timestamp")).alias("__start"), key, "t", F.col("units").isNotNull().alias("known"), F.coalesce("units", F.lit(0).cast("long")).alias("units"), F.coalesce("rest", F.lit(0.0)).alias("rest"))
    out = user_aggregate(rows, ["__start", key], ["t", "known", "units", "rest"], RecentTotals(micros(back)))
    window = F.struct(F.timestamp_micros("__start").alias("start"), F.timestamp_micros(F.col("__start") + micros(size)).alias("end"))
    return velocity_columns(out.select(
        window.alias("__w"), key, "count_short", amount_of("units_short", "rest_short", MONEY_UNIT).alias("total_short"),
        "count_long", amount_of("units_long", "rest_long", MONEY_UNIT).alias("total_long")), key)
