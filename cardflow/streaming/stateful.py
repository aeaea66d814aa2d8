"""Keyed state in streams (``transformWithStateInPandas``).

Cards are dealt to a fixed number of groups (``shards``) by a hash, and a group answers the rows of all its cards at once: a call per
card and micro-batch would take more time than its rows. A micro-batch reads and writes the state of the groups it touches, so a stream of
small micro-batches over very many cards takes more shards. Their number is part of a checkpoint.

The windowed operators also cut time into buckets at least as long as the window, and a row is sent to its own bucket and, as
context, to the next one. A busy card is thereby spread over many tasks and a state never
holds more than two buckets of its cards.

With a ``delay``, rows carry a watermark: later rows are refused by Spark, every batch drops what no accepted row can ask
for any more, and a bucket's state goes when the watermark has passed it. Without one, ``ttl_ms`` (processing time) bounds
the state, or nothing does. What a card's latest time is must be kept as long as the card can come back: one number.

Rows of a micro-batch are ordered by (time, id) within their card. A late row is answered
from the history seen so far. How many rows a micro-batch brings is bounded by the rate cap
of the source."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cardflow.functions.columns import MONEY_UNIT, money, money_rest, true_labels
from cardflow.operators.hydrate import ESSENTIAL_PROFILE, gate
from cardflow.operators.joins import lookup_profile

# The processors travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMB = 1 << 31  # units are added up in two parts, so that no sum of them overflows
SHARDS = 256  # groups of cards
PANES_PER_STEP = 20_000  # panes whose windows are formed at once
WINDOW_SHARDS = 64  # groups of cards in each bucket of time


def _line(*points: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """(codes, times) as numbers in the order of code and time, all comparable with each other."""
    times = np.unique(np.concatenate([t for _, t in points]))
    return [codes * len(times) + np.searchsorted(times, t) for codes, t in points]


def _codes(*names: np.ndarray) -> list[np.ndarray]:
    """Small numbers for the cards, NULL being one."""
    found = pd.factorize(np.concatenate(names), use_na_sentinel=False)[0].astype(np.int64)
    return np.split(found, np.cumsum([len(n) for n in names])[:-1])


def _latest_below(codes: np.ndarray, times: np.ndarray, limit: int) -> np.ndarray:
    """Of rows sorted by code and time: those not below the limit, and of each code the last one that is."""
    below = times < limit
    return ~below | np.append((codes[1:] != codes[:-1]) | ~below[1:], True)[:len(codes)]


class _Rows(StatefulProcessor):
    """Keeps arrays per group, a card and a time for each row first, and hands each micro-batch, in order, to ``answer``. ``reach``: how far back
    from the watermark a row may look. ``bucket``: length of the time buckets that are part of the key."""

    fields: Sequence[tuple[str, str, type]] = ()
    order: Sequence[str] = ("us", "id")

    def __init__(self, ttl_ms: int | None = None, reach: int = 0, bucket: int | None = None):
        self.ttl_ms, self.reach, self.bucket = ttl_ms, reach, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = (("key", "string", object), *self.fields)
        schema = ", ".join(f"{name} array<{kind}>" for name, kind, _ in self.kept)
        self.state = handle.getValueState("rows", schema, self.ttl_ms)

    def load(self) -> list[np.ndarray]:
        stored = self.state.get() if self.state.exists() else [[] for _ in self.kept]
        return [np.asarray(list(v), dtype=t) for v, (_, _, t) in zip(stored, self.kept)]

    def keep(self, codes: np.ndarray, us: np.ndarray, watermark: int) -> np.ndarray:
        """What rows after the watermark can still ask for, of rows sorted by code and time."""
        return us >= watermark - self.reach

    def store(self, codes: np.ndarray, arrays: Sequence[np.ndarray]) -> None:
        if self.watermark is not None:
            some = self.keep(codes, arrays[1], self.watermark)
            arrays = [a[some] for a in arrays]
        self.state.update(tuple(a.tolist() for a in arrays))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(list(self.order), kind="stable").reset_index(drop=True)
        at = timerValues.getCurrentWatermarkInMs() if "at" in batch.columns else -1
        self.watermark = at * 1000 if at > 0 else None
        if self.bucket and "at" in batch.columns:
            ends = (key[1] + 1) * self.bucket // 1000 + 1
            if ends > at:
                self.handle.registerTimer(int(ends))
        yield self.answer(batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class TrailingSums(_Rows):
    """Counts and sums over trailing widths, rows counted up to the row itself."""

    def __init__(self, widths: Sequence[int], flags: int = 0, ttl_ms: int | None = None):
        super().__init__(ttl_ms, max(widths), max(widths) + 1)
        self.widths, self.flags = list(widths), flags
        self.fields = (("us", "bigint", np.int64), ("units", "bigint", np.int64), ("rest", "double", np.float64),
                       *[(f"f{j}", "bigint", np.int64) for j in range(flags)])

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame:
        old = self.load()
        new_us = batch["us"].to_numpy(np.int64)
        every = [np.concatenate([o, batch[name].to_numpy(kind)]) for o, (name, _, kind) in zip(old, self.kept)]
        (codes,) = _codes(every[0])
        new_codes = codes[len(old[0]):]
        # Rows that came earlier go before new rows of the same time.
        order = np.lexsort((every[1], codes))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = codes[order]
        names, us, units, rest, *flags = (a[order] for a in every)
        mine = place[len(old[0]):]
        high, low = _upto(units // LIMB), _upto(units % LIMB)
        odd, counted = _upto((rest != 0).astype(np.int64)), [_upto(f) for f in flags]
        line, *starts = _line((codes, us), *[(new_codes, new_us - width) for width in self.widths])
        out = {"id": batch["id"]}
        for i, start in enumerate(starts):
            first = np.searchsorted(line, start, side="left")
            out[f"n{i}"] = mine - first + 1
            total = ((high[mine + 1] - high[first]) * float(LIMB) + (low[mine + 1] - low[first])) / MONEY_UNIT
            for j in np.flatnonzero(odd[mine + 1] > odd[first]):
                with np.errstate(invalid="ignore"):
                    total[j] += rest[first[j]:mine[j] + 1].sum()
            out[f"s{i}"] = total
            for j, c in enumerate(counted):
                out[f"f{i}_{j}"] = c[mine + 1] - c[first]
        self.store(codes, [names, us, units, rest, *flags])
        return pd.DataFrame(out)[batch["own"].to_numpy(bool)]


def _upto(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


class LatestRecord(_Rows):
    """Events (side 1) against the latest record (side 0) at or before them."""

    def __init__(self, tolerance: int, id_type: str, ttl_ms: int | None = None):
        super().__init__(ttl_ms, tolerance, tolerance + 1)
        self.tolerance = tolerance
        self.fields = (("us", "bigint", np.int64), ("record", id_type, object))

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame:
        old_names, old_us, old_record = self.load()
        side = batch["side"].to_numpy()
        fresh, events = batch[side == 0], batch[(side == 1) & batch["own"].to_numpy(bool)]
        names = np.concatenate([old_names, fresh["key"].to_numpy(object)])
        codes, asked = _codes(names, events["key"].to_numpy(object))
        known = pd.DataFrame({"code": codes, "name": names, "us": np.concatenate([old_us, fresh["us"].to_numpy(np.int64)]),
                              "record": np.concatenate([old_record, fresh["id"].to_numpy(object)])})
        known = known.sort_values(["code", "us", "record"], kind="stable")
        codes, us, record = known["code"].to_numpy(np.int64), known["us"].to_numpy(np.int64), known["record"].to_numpy(object)
        self.store(codes, [known["name"].to_numpy(object), us, record])
        at = events["us"].to_numpy(np.int64)
        line, probe = _line((codes, us), (asked, at))
        last = np.searchsorted(line, probe, side="right") - 1
        hit = last >= 0
        hit[hit] = (codes[last[hit]] == asked[hit]) & (at[hit] - us[last[hit]] <= self.tolerance)
        record_us, record_id = pd.array(np.zeros(len(at), np.int64), dtype="Int64"), np.full(len(at), None, object)
        record_us[hit], record_id[hit] = us[last[hit]], record[last[hit]]
        record_us[~hit] = pd.NA
        return pd.DataFrame({"id": events["id"].to_numpy(object), "record_us": record_us, "record_id": pd.Series(record_id, dtype=object)})


class PreviousTime(_Rows):
    """Latest known time strictly before each row. Of a card's times below the watermark only the latest is kept."""

    fields = (("us", "bigint", np.int64),)

    def keep(self, codes: np.ndarray, us: np.ndarray, watermark: int) -> np.ndarray:
        return _latest_below(codes, us, watermark)

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame:
        old_names, old_us = self.load()
        names = np.concatenate([old_names, batch["key"].to_numpy(object)])
        new = batch["us"].to_numpy(np.int64)
        (codes,), us = _codes(names), np.concatenate([old_us, new])
        asked = codes[len(old_us):]
        order = np.lexsort((us, codes))
        order = order[np.append(True, (np.diff(codes[order]) != 0) | (np.diff(us[order]) != 0))]
        names, codes, us = names[order], codes[order], us[order]
        line, probe = _line((codes, us), (asked, new))
        last = np.searchsorted(line, probe, side="left") - 1
        previous = pd.array(us[np.maximum(last, 0)], dtype="Int64")
        previous[(last < 0) | (codes[np.maximum(last, 0)] != asked)] = pd.NA
        self.store(codes, [names, us])
        return pd.DataFrame({"key": batch["key"], "id": batch["id"], "us": new, "prev_us": previous})


class LastArrival(_Rows):
    """Distance to the row of the card that arrived before, never negative."""

    fields = (("us", "bigint", np.int64),)
    order = ("arrival", "id")

    def keep(self, codes: np.ndarray, us: np.ndarray, watermark: int) -> np.ndarray:
        return np.ones(len(us), bool)

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame:
        old_names, old_us = self.load()
        names = np.concatenate([old_names, batch["key"].to_numpy(object)])
        new = batch["us"].to_numpy(np.int64)
        (codes,), us = _codes(names), np.concatenate([old_us, new])
        order = np.argsort(codes, kind="stable")
        begins = np.append(True, np.diff(codes[order]) != 0)
        sorted_gap = pd.array(np.maximum(np.diff(us[order], prepend=0), 0), dtype="Int64")
        sorted_gap[begins] = pd.NA
        gap = sorted_gap[np.argsort(order)][len(old_us):]
        latest = order[np.append(begins[1:], True)]
        self.store(codes[latest], [names[latest], us[latest]])
        return pd.DataFrame({"key": batch["key"], "id": batch["id"], "us": new, "gap": gap})


class Hydration(StatefulProcessor):
    """Events (side 1) with the latest velocity record (side 0) of their card and the counters over its accepted earlier events. Accepted times below the
    watermark are counted, not kept, but for a card's latest; records too old for any accepted row are dropped."""

    def __init__(self, tolerance: int | None, day: float):
        self.tolerance, self.day = tolerance, day

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = (("card", "string", object), ("n", "bigint", np.int64), ("first", "bigint", np.int64), ("done_card", "string", object), ("done", "bigint", np.int64),
                  ("rec_card", "string", object), ("rec_us", "bigint", np.int64), ("rec_n", "double", np.float64))
        self.types = [t for _, _, t in fields]
        self.state = handle.getValueState("cards", ", ".join(f"{name} array<{kind}>" for name, kind, _ in fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        stored = self.state.get() if self.state.exists() else [[] for _ in self.types]
        card, n, begun, done_card, done, rec_card, rec_us, rec_n = (np.asarray(list(v), dtype=t) for v, t in zip(stored, self.types))
        events, records = batch[batch["side"] == 1], batch[batch["side"] == 0]
        accepted = events[events["accepted"].to_numpy(bool)]
        at = events["us"].to_numpy(np.int64)
        done_card = np.concatenate([done_card, accepted["key"].to_numpy(object)])
        done = np.concatenate([done, accepted["us"].to_numpy(np.int64)])
        rec_card = np.concatenate([rec_card, records["key"].to_numpy(object)])
        rec_us = np.concatenate([rec_us, records["us"].to_numpy(np.int64)])
        rec_n = np.concatenate([rec_n, records["n"].to_numpy(np.float64)])
        every = [card, done_card, rec_card, events["key"].to_numpy(object)]
        card_code, done_code, rec_code, code = _codes(*every)
        cards = max(int(c.max(initial=-1)) for c in (card_code, done_code, rec_code, code)) + 1
        folded, first, name = np.zeros(cards, np.int64), np.zeros(cards, np.int64), np.full(cards, None, object)
        folded[card_code], first[card_code] = n, begun
        for codes, names in zip((card_code, done_code), every):
            name[codes] = names
        order = np.lexsort((done, done_code))
        done_card, done_code, done = done_card[order], done_code[order], done[order]
        order = np.lexsort((rec_n, rec_us, rec_code))
        rec_card, rec_code, rec_us, rec_n = rec_card[order], rec_code[order], rec_us[order], rec_n[order]

        done_line, rec_line, probe = _line((done_code, done), (rec_code, rec_us), (code, at))
        last = np.searchsorted(rec_line, probe, side="right") - 1
        fresh = last >= 0
        fresh[fresh] = rec_code[last[fresh]] == code[fresh]
        if self.tolerance is not None:
            fresh[fresh] = at[fresh] - rec_us[last[fresh]] <= self.tolerance
        count = np.full(len(at), np.nan)
        count[fresh] = rec_n[last[fresh]]
        begin, upto = np.searchsorted(done_code, code, side="left"), np.searchsorted(done_line, probe, side="left")
        before = upto - begin
        some = before > 0
        since, previous = at.copy(), at.copy()
        since[some] = np.where(folded[code[some]] > 0, first[code[some]], done[begin[some]])
        previous[some] = done[upto[some] - 1]
        c2 = (folded[code] + before + 1).astype(float)
        yield pd.DataFrame({"row": events["row"].to_numpy(object), "count": pd.array([float(c) if f else None for c, f in zip(count, fresh)], dtype="Float64"),
                            "c1": np.where(fresh, np.fmax(c2, count), c2), "c2": c2, "d1": (at - since) / self.day, "d2": (at - previous) / self.day})
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if watermark > 0:
            drop = ~_latest_below(done_code, done, watermark)
            dropped, earliest = np.unique(done_code[drop], return_index=True)
            fresh_cards = folded[dropped] == 0
            first[dropped[fresh_cards]] = done[drop][earliest[fresh_cards]]
            folded += np.bincount(done_code[drop], minlength=cards)
            done_card, done = done_card[~drop], done[~drop]
            keep = rec_us >= watermark - self.tolerance if self.tolerance is not None else _latest_below(rec_code, rec_us, watermark)
            rec_card, rec_us, rec_n = rec_card[keep], rec_us[keep], rec_n[keep]
        known = np.flatnonzero(folded)
        self.state.update(tuple(a.tolist() for a in (name[known], folded[known], first[known], done_card, done, rec_card, rec_us, rec_n)))

    def close(self) -> None:
        pass


class HoppingWindows(StatefulProcessor):
    """Panes (sums over one slide each) to the windows they lie in, ``k`` panes each, of which the last from ``keep`` on are its tail. A micro-batch gives the windows
    that the watermark has come past since the last one; what is kept are panes with a window still open."""

    def __init__(self, slide: int, k: int, keep: int):
        self.slide, self.k, self.keep = slide, k, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("panes", "done bigint, panes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return self.closed(list(rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.closed([], timerValues)

    def closed(self, panes: list[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, kept = self.state.get() if self.state.exists() else (None, None)
        if kept is not None:
            panes = [pickle.loads(bytes(kept)), *panes]
        if not panes:
            return
        panes = pd.concat(panes, ignore_index=True)
        # the first pane behind the last window that ends by now
        upto = timerValues.getCurrentWatermarkInMs() * 1000 // self.slide
        since = np.iinfo(np.int64).min if done is None else done
        (codes,) = _codes(panes["key"].to_numpy(object))
        order = np.lexsort((panes["pane"].to_numpy(np.int64), codes))
        panes, codes = panes.iloc[order].reset_index(drop=True), codes[order]
        at = panes["pane"].to_numpy(np.int64)
        # panes that share no window with the one before begin a new stretch; some stretches are one step
        begins = np.flatnonzero(np.append(True, (np.diff(codes) != 0) | (np.diff(at) >= self.k)))
        steps = begins[np.append(True, np.diff(begins // PANES_PER_STEP) != 0)]
        for a, b in zip(steps, np.append(steps[1:], len(at)), strict=True):
            yield self.windows(panes.iloc[a:b], codes[a:b], at[a:b], since, upto)
        still = at + self.k > upto
        if still.any():
            self.state.update((int(upto), pickle.dumps(panes[still])))
            ends = int(max(at[still].min(), upto) + 1) * self.slide  # of the next window; a timer fires when the watermark is behind it
            self.handle.registerTimer(-(-ends // 1000) - 1)
        else:
            self.state.clear()

    def windows(self, panes: pd.DataFrame, codes: np.ndarray, at: np.ndarray, since: int, upto: int) -> pd.DataFrame:
        row = np.repeat(np.arange(len(at)), self.k)
        start = at[row] - np.tile(np.arange(self.k), len(at))
        now = (start + self.k <= upto) & (start + self.k > since)
        row, start = row[now], start[now]
        order = np.lexsort((start, codes[row]))  # stable: the panes of a window stay in their order
        row, start = row[order], start[order]
        first = np.flatnonzero(np.append(True, (np.diff(codes[row]) != 0) | (np.diff(start) != 0))) if len(row) else np.zeros(0, np.int64)
        tail = at[row] >= start + self.keep

        def total(name: str, kind: type, some=None) -> np.ndarray:
            values = panes[name].to_numpy(kind)[row]
            if some is not None:
                values = np.where(some, values, kind(0))
            with np.errstate(invalid="ignore"):
                return np.add.reduceat(values, first) if len(first) else values

        out = {"key": panes["key"].to_numpy(object)[row[first]], "start": start[first] * self.slide}
        for name, kind in (("n", np.int64), ("known", np.int64), ("high", np.int64), ("low", np.int64), ("rest", np.float64)):
            out[name] = total(name, kind)
            if name != "known":
                out[f"{name}_tail"] = total(name, kind, tail)
        # nested values are slow to pass on: a window of one pane has that pane's number of merchants, only one of several has their merchants
        held, sizes = panes["m"].to_numpy(object), np.diff(np.append(first, len(row)))
        several, m = sizes > 1, np.full(len(first), None, object)
        for i in np.flatnonzero(several):
            m[i] = list(held[row[first[i]:first[i] + sizes[i]]])
        out["distinct"], out["m"] = panes["distinct"].to_numpy(np.int64)[row[first]], pd.Series(m, dtype=object)
        return pd.DataFrame(out)

    def close(self) -> None:
        pass


def _shard(key: str, shards: int) -> list[Column]:
    """A card as text, and its group."""
    return [F.col(key).cast("string").alias("key"), F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")]


def _bucketed(df: DataFrame, width: int) -> DataFrame:
    """Each row under its own time bucket and, as context, under the next one."""
    own = F.floor(F.col("us") / F.lit(width))
    copies = F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own")),
                     F.struct((own + 1).alias("bucket"), F.lit(False).alias("own")))
    return df.withColumn("__copy", F.explode(copies)).select("*", "__copy.bucket", "__copy.own").drop("__copy")


def _mode(ttl_ms: int | None, delay: str | None) -> str:
    if ttl_ms and delay:
        raise ValueError("state ends by event time (delay) or by processing time (ttl_ms), not by both")
    return "eventTime" if delay else "processingTime" if ttl_ms else "none"


def _marked(df: DataFrame, delay: str | None) -> DataFrame:
    """With a watermark, if there is a delay, on the time in microseconds."""
    return df.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay) if delay else df


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def trailing_stream(df: DataFrame, widths: Sequence[int], key: str = "card_id", time: str = "us", row_id: str = "transaction_id",
                    amount: str = "amount", flags: Sequence[Column] = (), ttl_ms: int | None = None, delay: str | None = None,
                    shards: int = WINDOW_SHARDS) -> DataFrame:
    """``id, n0, s0, f0_0, ..., n1, ...``: rows, sum and rows with each flag in each trailing width, per row. A NULL amount counts as a row
    and adds nothing, a NULL flag is no flag; sums are those of ``trailing_velocity``."""
    rows = df.select(*_shard(key, shards), F.col(time).alias("us"), F.col(row_id).alias("id"), F.coalesce(money(amount).cast("long"), F.lit(0).cast("long")).alias("units"),
                     F.coalesce(money_rest(amount), F.lit(0.0)).alias("rest"),
                     *[F.coalesce(f.cast("long"), F.lit(0).cast("long")).alias(f"f{j}") for j, f in enumerate(flags)])
    schema = f"id {_type(df, row_id)}, " + ", ".join(
        f"n{i} long, s{i} double" + "".join(f", f{i}_{j} long" for j in range(len(flags))) for i in range(len(widths)))
    return _bucketed(_marked(rows, delay), max(widths) + 1).groupBy("shard", "bucket").transformWithStateInPandas(
        TrailingSums(widths, len(flags), ttl_ms), schema, "append", _mode(ttl_ms, delay))


def velocity_alerts_stream(df: DataFrame, width: int, max_count: int = 3, max_spend: float = 5000.0,
                           foreign: str = "FOREIGN", ttl_ms: int | None = None, delay: str | None = None, shards: int = WINDOW_SHARDS) -> DataFrame:
    """Alerts of the trailing window of each row, by the rules of ``velocity_alerts``."""
    is_foreign = F.col("country") == foreign
    out = trailing_stream(df, [width], flags=[is_foreign, ~is_foreign & (F.col("country") != "")], ttl_ms=ttl_ms, delay=delay, shards=shards)
    alerts = true_labels({"VELOCITY": F.col("n0") > max_count, "BURST_SPEND": F.col("s0") > max_spend,
                          "GEO_HOP": (F.col("f0_0") > 0) & (F.col("f0_1") > 0)})
    return out.select(F.col("id").alias("transaction_id"), F.col("n0").alias("count_in_window"),
                      F.col("s0").alias("spend_in_window"), alerts.alias("alerts"))


def hopping_windows(panes: DataFrame, slide: int, k: int, keep: int, key: str, shards: int = SHARDS) -> DataFrame:
    """Windows of ``k`` panes from a stream of closed panes: ``__pane`` (a window one slide long, with the watermark), the key, and ``__n, __s, __r`` and ``__m``, rows, units and rest
    of the amounts, merchants (binary) and ``__d``, their number. Gives ``start``, the key, ``n``, ``units``, ``rest`` (of the tail: ``n_tail`` and so on), ``m``, the merchants of each
    of its panes, NULL if there is one, and ``distinct``, their number then."""
    units = F.coalesce("__s", F.lit(0).cast("decimal(38,0)"))
    high = F.floor(units / F.lit(LIMB)).cast("decimal(38,0)")
    rows = panes.select(
        *_shard(key, shards), F.window_time("__pane").alias("at"), F.floor(F.unix_micros("__pane.start") / F.lit(slide)).alias("pane"), F.col("__n").alias("n"),
        F.col("__s").isNotNull().cast("long").alias("known"), high.cast("long").alias("high"), (units - high * LIMB).cast("long").alias("low"),
        F.coalesce("__r", F.lit(0.0)).alias("rest"), F.col("__m").alias("m"), F.col("__d").cast("long").alias("distinct"))
    schema = ("key string, start long, n long, n_tail long, known long, high long, high_tail long, low long, low_tail long, rest double, rest_tail double, distinct long, m array<binary>")
    out = rows.groupBy("shard").transformWithStateInPandas(HoppingWindows(slide, k, keep), schema, "append", "eventTime")

    def whole(tail: str) -> Column:
        return F.col(f"high{tail}").cast("decimal(28,0)") * F.lit(LIMB).cast("decimal(10,0)") + F.col(f"low{tail}").cast("decimal(38,0)")

    return out.select(F.col("key").cast(panes.schema[key].dataType).alias(key), "start", "n", "n_tail", F.when(F.col("known") > 0, whole("")).alias("units"), "distinct", "m",
                      whole("_tail").alias("units_tail"), *[F.coalesce(r, F.lit(float("nan"))).alias(r) for r in ("rest", "rest_tail")])  # pandas gives NaN as NULL


def asof_stream(events: DataFrame, records: DataFrame, tolerance: int, key: str = "card_id", time: str = "us",
                event_id: str = "transaction_id", record_time: str = "vel_us", record_id: str = "vel_id",
                ttl_ms: int | None = None, delay: str | None = None, shards: int = WINDOW_SHARDS) -> DataFrame:
    """For each event the latest record of its card that is not newer and at most ``tolerance`` old.
    Event and record ids have one type."""
    left = events.select(*_shard(key, shards), F.col(time).alias("us"), F.col(event_id).alias("id"), F.lit(1).alias("side"))
    right = records.select(*_shard(key, shards), F.col(record_time).alias("us"), F.col(record_id).alias("id"), F.lit(0).alias("side"))
    both, kind = _marked(left.unionByName(right), delay), _type(records, record_id)
    return _bucketed(both, tolerance + 1).groupBy("shard", "bucket").transformWithStateInPandas(
        LatestRecord(tolerance, kind, ttl_ms), f"id {kind}, record_us long, record_id {kind}", "append", _mode(ttl_ms, delay))


def _per_key(df: DataFrame, processor: _Rows, extra: str, key: str, time: str, row_id: str, delay: str | None, shards: int, *more: Column) -> DataFrame:
    rows = _marked(df.select(*_shard(key, shards), F.col(time).alias("us"), F.col(row_id).alias("id"), *more), delay)
    schema = f"key string, id {_type(df, row_id)}, us long, {extra} long"
    out = rows.groupBy("shard").transformWithStateInPandas(processor, schema, "append", _mode(processor.ttl_ms, delay))
    return out.select(F.col("key").cast(df.schema[key].dataType).alias(key), "id", "us", extra)


def previous_gap_stream(df: DataFrame, key: str = "card_id", time: str = "us", row_id: str = "transaction_id",
                        ttl_ms: int | None = None, delay: str | None = None, shards: int = SHARDS) -> DataFrame:
    """Previous time in event-time order, as ``previous_gap(prev="strict")`` in batch."""
    out = _per_key(df, PreviousTime(ttl_ms), "prev_us", key, time, row_id, delay, shards)
    return out.withColumn("gap", F.col("us") - F.col("prev_us"))


def arrival_gap_stream(df: DataFrame, key: str = "card_id", time: str = "us", row_id: str = "transaction_id", arrival: str | None = None,
                       ttl_ms: int | None = None, delay: str | None = None, shards: int = SHARDS) -> DataFrame:
    """Distance to the previously arrived row of the key. ``arrival`` numbers the rows of a micro-batch as they came (an offset, a time);
    without it the row's id does."""
    return _per_key(df, LastArrival(ttl_ms), "gap", key, time, row_id, delay, shards, F.col(arrival or row_id).alias("arrival"))


def hydrate_stream(events: DataFrame, profiles: DataFrame, velocity: DataFrame, key: str = "card_id", time: str = "event_time", velocity_time: str = "velocity_time",
                   velocity_count: str = "count_5m", tolerance: int | None = None, day: float = 86400.0,
                   profile_fields: Sequence[str] = ESSENTIAL_PROFILE, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """``hydrate`` on streams of events and velocity records (times in microseconds), with a table of profiles: profile, gate, the latest record that is known and not newer, and the
    counters over accepted events that are known and earlier. An event without time passes with the counters of a first one; it is rejected anyway."""
    rows = gate(lookup_profile(events, profiles, key), profile_fields)
    timed = rows.filter(F.col(time).isNotNull())
    left = timed.select(*_shard(key, shards), F.col(time).alias("us"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("n"), F.col("complete").alias("accepted"),
                        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))
    right = velocity.select(*_shard(key, shards), F.col(velocity_time).alias("us"), F.lit(0).alias("side"), F.col(velocity_count).cast("double").alias("n"),
                            F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("row"))
    out = _marked(left.unionByName(right), delay).groupBy("shard").transformWithStateInPandas(
        Hydration(tolerance, day), "row string, count double, c1 double, c2 double, d1 double, d2 double", "append", "eventTime")
    kind = velocity.schema[velocity_count].dataType
    out = out.withColumn("row", F.from_json("row", rows.schema)).select("row.*", F.col("count").cast(kind).alias(velocity_count), "c1", "c2", "d1", "d2")
    one, zero = F.lit(1.0), F.lit(0.0)
    return out.unionByName(rows.filter(F.col(time).isNull()).select(
        "*", F.lit(None).cast(kind).alias(velocity_count), one.alias("c1"), one.alias("c2"), zero.alias("d1"), zero.alias("d2")))
