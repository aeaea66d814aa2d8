"""Event-time streaming built from the batch operators, and the life cycle of queries."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from cardflow.functions.columns import amount_of, money, money_rest, money_sum
from cardflow.operators.velocity import hopping_features, micros, recent_totals, window_summary
from cardflow.session import checkpoint_dir
from cardflow.streaming.stateful import hopping_windows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state outside the JVM heap; required by ``transformWithState``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def with_watermark(df: DataFrame, time: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """A timestamp without zone cannot carry a watermark and is read as UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def hopping_stream(df: DataFrame, delay: str = "10 minutes", distinct: str = "approx", size: str = "10 minutes", slide: str = "1 minute", tail: str = "5 minutes",
                   key: str = "card_id", time: str = "event_time", amount: str = "amount", merchant: str = "merchant_id") -> DataFrame:
    """``hopping_features`` on a stream: an aggregate sums rows per pane (one slide long), so that a row is shuffled once and not once per window, and when the
    watermark has passed a pane, keyed state forms the windows, of all panes of a group of cards at once, so that no window is ever a row of state. Distinct merchants are sketches that are
    merged (``approx``), or sets (``set``). A row behind the watermark is in no window."""
    marked = with_watermark(df, time, delay)
    if micros(size) % micros(slide) or micros(tail) % micros(slide):
        return hopping_features(marked, size, slide, tail, distinct, key, time, amount, merchant)
    approx = distinct == "approx"
    name = F.col(merchant).cast("string")
    panes = marked.groupBy(F.window(time, slide).alias("__pane"), key).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(money(amount)).alias("__s"), F.sum(money_rest(amount)).alias("__r"),
        (F.hll_sketch_agg(name) if approx else F.collect_set(name)).alias("__m"))
    panes = panes.withColumn("__d", F.hll_sketch_estimate("__m") if approx else F.size("__m"))
    if not approx:
        panes = panes.withColumn("__m", F.to_json("__m").cast("binary"))
    k = micros(size) // micros(slide)
    out = hopping_windows(panes, micros(slide), k, k - micros(tail) // micros(slide), key)

    if approx:
        several = F.hll_sketch_estimate(F.aggregate(F.slice("m", 2, F.size("m") - 1), F.col("m")[0], lambda a, b: F.hll_union(a, b)))
    else:
        several = F.size(F.array_distinct(F.flatten(F.transform("m", lambda m: F.from_json(m.cast("string"), "array<string>"))))).cast("long")
    merchants = F.when(F.col("m").isNull(), F.col("distinct")).otherwise(several)
    return out.select(F.timestamp_micros("start").alias("window_start"), F.timestamp_micros(F.col("start") + micros(size)).alias("window_end"), key,
                      F.col("n_tail").alias("count_tail"), amount_of("units_tail", "rest_tail").alias("amount_tail"), F.col("n").alias("count_window"),
                      amount_of("units", "rest").alias("amount_window"), merchants.alias("unique_merchants"))


def window_velocity_stream(df: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", back: str = "5 minutes", delay: str = "10 minutes",
                           key: str = "card_id", time: str = "event_time", amount: str = "amount") -> DataFrame:
    """``window_velocity`` on a stream, as two aggregates: the first adds up the rows of each instant of a window as they come, the second gets the instants when the
    watermark has passed the window, and finds which are recent. State grows with the instants of a window, not with its rows."""
    marked = with_watermark(df, time, delay)
    instants = marked.groupBy(F.window(time, size, slide).alias("__w"), key, F.unix_micros(time).alias("__t")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(money(amount)).alias("__s"), F.sum(money_rest(amount)).alias("__r"))
    held = instants.groupBy("__w", key).agg(F.collect_list(F.struct(*[F.col(f"__{c}").alias(c) for c in "tnsr"])).alias("__rows"), F.max("__t").alias("__latest"))
    return recent_totals(held, "__rows", "__latest", micros(back), key)


def summary_stream(df: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    return window_summary(with_watermark(df, delay=delay), size, slide)


def dedup_stream(df: DataFrame, keys: Sequence[str], time: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Drops repeated keys that arrive within the watermark delay."""
    return with_watermark(df, time, delay).dropDuplicatesWithinWatermark(list(keys))


def running_totals_stream(df: DataFrame, key: str = "card_id", amount: str = "amount") -> DataFrame:
    """Total and count per key, for update mode."""
    return df.groupBy(key).agg(money_sum(amount).alias("running_total"),
                               F.count(F.lit(1)).alias("running_count"))


def start(writer: DataStreamWriter, trigger: str | None = None) -> StreamingQuery:
    """``trigger`` is a processing interval such as ``10 seconds``; without one the query takes
    what is there and ends."""
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def run_all(writers: Sequence[DataStreamWriter], trigger: str | None = None) -> list[StreamingQuery]:
    """Independent queries, each with its own checkpoint. They end together: when one fails the
    others are stopped and the error is raised."""
    started = [start(w, trigger) for w in writers]
    try:
        while any(query.isActive for query in started):
            for query in started:
                query.awaitTermination(1)  # raises the error of a failed query
        for query in started:
            query.awaitTermination()
    finally:
        for query in started:
            if query.isActive:
                query.stop()
    return started


def catch_up(writer: DataStreamWriter) -> StreamingQuery:
    """Runs micro-batch after micro-batch until nothing waits, and ends. For sources whose rate cap ``availableNow`` would take for the end."""
    query = start(writer, "0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


class ProgressTotals(StreamingQueryListener):
    """Adds up the progress of every query as it is reported, so that a long run is counted in full (a query itself remembers its last
    hundred micro-batches). As a context manager it listens to all queries of the session that start inside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.changed = spark, threading.Condition()
        self.totals: dict[str, dict[str, float]] = {}
        self.ended: set[str] = set()

    def __enter__(self) -> ProgressTotals:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        add = {"rows": p.numInputRows, "batches": int(p.numInputRows > 0), "millis": p.durationMs.get("triggerExecution", 0) if p.numInputRows else 0,
               "dropped": sum(op.numRowsDroppedByWatermark for op in p.stateOperators)}
        with self.changed:
            mine = self.totals.setdefault(str(p.runId), dict.fromkeys(add, 0))
            for name, value in add.items():
                mine[name] += value

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of(self, query: StreamingQuery, wait: float = 60.0) -> dict[str, float]:
        """The totals of a run: rows, batches with rows, their milliseconds, and rows the watermark refused. Reports come after the fact, so those
        of a query that has ended are waited for."""
        run = str(query.runId)
        with self.changed:
            if not query.isActive and not self.changed.wait_for(lambda: run in self.ended, wait):
                raise TimeoutError(f"the end of query {run} was not reported")
            return dict(self.totals.get(run, {"rows": 0, "batches": 0, "millis": 0, "dropped": 0}))


def stream_progress(totals: ProgressTotals, queries: Sequence[StreamingQuery]) -> DataFrame:
    """Rows, micro-batches and rows per batch and second of finished or running queries."""
    rows = []
    for query in queries:
        t = totals.of(query)
        rows.append((query.name or str(query.id), int(t["rows"]), int(t["batches"]), t["rows"] / t["batches"] if t["batches"] else 0.0,
                     t["rows"] * 1000.0 / t["millis"] if t["millis"] else 0.0, int(t["dropped"])))
    return totals.spark.createDataFrame(rows, "query string, rows long, batches long, rows_per_batch double, rows_per_second double, dropped long")
