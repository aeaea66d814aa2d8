"""Streams over several micro-batches, restarts, late rows, sinks and options."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from cardflow.operators import history, joins, velocity
from cardflow.sources import readers, sinks
from cardflow.streaming import stateful, streams

US = velocity.SECOND
SCHEMA = "transaction_id long, card_id long, us long, amount double, country string, merchant_id string"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(11)
    times = sorted(rng.sample(range(4000), 300))
    return [(i, rng.choice([1, 1, 2, 3]), t * US, rng.randrange(1, 9000) / 4, rng.choice(["LOCAL", "FOREIGN"]), rng.choice("abc"))
            for i, t in enumerate(times)]


@pytest.fixture
def inbox(spark, events, tmp_path):
    """Five files that arrive in time order; each is a micro-batch of its own."""
    folder = str(tmp_path / "inbox")
    for i in range(5):
        part = spark.createDataFrame(events[i * 60:(i + 1) * 60], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)
        stamp = time.time() - 1000 + i * 10
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > time.time() - 500:
                os.utime(path, (stamp, stamp))
    return folder


def arriving(spark, inbox):
    streams.use_rocksdb(spark)
    return readers.read_file_events(spark, inbox, SCHEMA, max_files=1)


def run(df, tmp_path, name, mode="append"):
    path = str(tmp_path / name)
    writer = (sinks.sink_parquet(df, path, path + "-c") if mode == "append" else
              sinks.sink_foreach_batch(df, path, path + "-c", mode))
    with streams.ProgressTotals(df.sparkSession) as totals:
        (query,) = streams.run_all([writer])
        row = streams.stream_progress(totals, [query]).first()
    return df.sparkSession.read.parquet(path), row["batches"], row


def test_trailing_state_across_batches(spark, events, inbox, tmp_path):
    out, batches, _ = run(stateful.trailing_stream(arriving(spark, inbox), [300 * US, 600 * US]), tmp_path, "trailing")
    batch = velocity.trailing_velocity(spark.createDataFrame(events, SCHEMA), "card_id", "us", ["transaction_id"])
    want = {r["transaction_id"]: (r["count_short"], r["total_short"], r["count_long"], r["total_long"]) for r in batch.collect()}
    assert batches == 5
    assert {r["id"]: (r["n0"], r["s0"], r["n1"], r["s1"]) for r in out.collect()} == want


def test_previous_time_across_batches(spark, events, inbox, tmp_path):
    out, batches, _ = run(stateful.previous_gap_stream(arriving(spark, inbox)), tmp_path, "previous")
    batch = history.previous_gap(spark.createDataFrame(events, SCHEMA), "card_id", "us", ["transaction_id"], "strict")
    assert batches == 5
    assert {(r["id"], r["prev_us"], r["gap"]) for r in out.collect()} == {
        (r["transaction_id"], r["prev_time"], r["gap"]) for r in batch.collect()}


def test_arrival_gap_across_batches(spark, events, inbox, tmp_path):
    out, _, _ = run(stateful.arrival_gap_stream(arriving(spark, inbox)), tmp_path, "arrival")
    batch = history.previous_gap(spark.createDataFrame(events, SCHEMA), "card_id", "us", ["transaction_id"], "row")
    assert {(r["id"], r["gap"]) for r in out.collect()} == {(r["transaction_id"], r["gap"]) for r in batch.collect()}


def test_alerts_across_batches(spark, events, inbox, tmp_path):
    out, _, _ = run(stateful.velocity_alerts_stream(arriving(spark, inbox), 60 * US, 2, 3000.0), tmp_path, "alerts")
    batch = velocity.velocity_alerts(spark.createDataFrame(events, SCHEMA), "card_id", "us", ["transaction_id"], width=60 * US,
                                     max_count=2, max_spend=3000.0)
    want = {r["transaction_id"]: (r["count_in_window"], tuple(r["alerts"])) for r in batch.collect()}
    assert {r["transaction_id"]: (r["count_in_window"], tuple(r["alerts"])) for r in out.collect()} == want
    assert any(alerts for _, alerts in want.values())


def test_asof_stream_across_batches(spark, events, inbox, tmp_path):
    source = arriving(spark, inbox)
    records = source.select("card_id", F.col("us").alias("vel_us"), F.col("transaction_id").alias("vel_id"))
    shifted = arriving(spark, inbox).withColumn("us", F.col("us") + 5 * US)
    out, _, _ = run(stateful.asof_stream(shifted, records, 100 * US), tmp_path, "asof")
    table = spark.createDataFrame(events, SCHEMA)
    batch = joins.asof_join(table.withColumn("us", F.col("us") + 5 * US), table.select(
        "card_id", F.col("us").alias("vel_us"), F.col("transaction_id").alias("vel_id")), "card_id", "us", "vel_us", ["vel_id"],
        ["vel_id"], 100 * US)
    # Two rows of a card less than 5 s apart may be split by a batch border; the stream then
    # answers from what it has seen.
    want = {r["transaction_id"]: r["vel_id"] for r in batch.collect()}
    got = {r["id"]: r["record_id"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert sum(got[i] != want[i] for i in want) <= 4


def test_text_ids_across_batches(spark, events, inbox, tmp_path):
    """Cards and transactions are usually named by text."""
    def named(df):
        return df.withColumn("card_id", F.concat(F.lit("CARD-"), F.col("card_id"))).withColumn(
            "transaction_id", F.format_string("TX-%05d", "transaction_id"))

    batch = named(spark.createDataFrame(events, SCHEMA))
    gaps, _, _ = run(stateful.previous_gap_stream(named(arriving(spark, inbox))), tmp_path, "text-gaps")
    want = history.previous_gap(batch, "card_id", "us", ["transaction_id"], "strict")
    assert {(r["card_id"], r["id"], r["gap"]) for r in gaps.collect()} == {
        (r["card_id"], r["transaction_id"], r["gap"]) for r in want.collect()}
    sums, _, _ = run(stateful.trailing_stream(named(arriving(spark, inbox)), [600 * US]), tmp_path, "text-sums")
    want = velocity.trailing_velocity(batch, "card_id", "us", ["transaction_id"])
    assert {(r["id"], r["n0"], r["s0"]) for r in sums.collect()} == {
        (r["transaction_id"], r["count_long"], r["total_long"]) for r in want.collect()}
    source = named(arriving(spark, inbox))
    records = source.select("card_id", F.col("us").alias("vel_us"), F.concat(F.lit("V"), "transaction_id").alias("vel_id"))
    found, _, _ = run(stateful.asof_stream(named(arriving(spark, inbox)), records, 100 * US), tmp_path, "text-asof")
    assert {(r["id"], r["record_id"]) for r in found.collect()} == {
        (r["transaction_id"], "V" + r["transaction_id"]) for r in batch.collect()}


def test_console_sink(spark, inbox, tmp_path):
    streams.run_all([sinks.sink_console(arriving(spark, inbox).select("transaction_id"), str(tmp_path / "console-c"), rows=1)])


def test_windows_across_batches(spark, events, inbox, tmp_path):
    stream = arriving(spark, inbox).withColumn("event_time", F.timestamp_micros("us"))
    out, _, _ = run(streams.hopping_stream(stream, "1 minute", distinct="set"), tmp_path, "hop")
    table = spark.createDataFrame(events, SCHEMA).withColumn("event_time", F.timestamp_micros("us"))
    closed = F.unix_micros("window_end") <= events[-1][2] - 60 * US
    want = velocity.hopping_features(table).filter(closed)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_windows_are_no_state_and_keep_odd_rows(spark, events, inbox, tmp_path):
    """A window of a minute's panes is formed when it closes: the ten windows of each pane are never written as state. NULL cards, merchants and amounts, and amounts without units."""
    def odd(df):
        i = F.col("transaction_id")
        return df.select(i, F.when(i % 11 != 0, F.col("card_id")).alias("card_id"), F.timestamp_micros("us").alias("event_time"), F.when(i % 5 != 0, F.col("merchant_id")).alias("merchant_id"),
                         F.when(i % 7 == 0, None).when(i % 97 == 0, float("nan")).when(i % 41 == 0, 1e30).otherwise(F.col("amount")).alias("amount"))

    path = str(tmp_path / "odd")
    for distinct in ("set", "approx"):
        writer = sinks.sink_parquet(streams.hopping_stream(odd(arriving(spark, inbox)), "1 minute", distinct), path + distinct, path + distinct + "-c")
        (query,) = streams.run_all([writer])
        assert max(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators) <= 60  # rows of a micro-batch
        closed = F.unix_micros("window_end") <= events[-1][2] - 60 * US
        want = velocity.hopping_features(odd(spark.createDataFrame(events, SCHEMA))).filter(closed)
        got = spark.read.parquet(path + distinct)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder = str(tmp_path / "late")
    for i, minutes in enumerate(([1, 4], [30], [31], [2, 29])):
        spark.createDataFrame([(m,) for m in minutes], "m long").coalesce(1).write.mode("append").parquet(folder)
        stamp = time.time() - 1000 + i * 10
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > time.time() - 500:
                os.utime(path, (stamp, stamp))
    df = readers.read_file_events(spark, folder, "m long", max_files=1).select(
        F.timestamp_seconds(F.col("m") * 60).alias("event_time"), F.lit(1).alias("card_id"), F.lit(1.0).alias("amount"))
    out, _, progress = run(streams.summary_stream(df, "5 minutes", delay="10 minutes"), tmp_path, "late-out")
    assert progress["dropped"] == 1
    assert out.agg(F.sum("transaction_count")).first()[0] == 2


def test_dedup_within_the_watermark(spark, inbox, events, tmp_path):
    twice = arriving(spark, inbox).withColumn("event_time", F.timestamp_micros("us")).withColumn(
        "copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out, _, _ = run(streams.dedup_stream(twice, ["transaction_id"]), tmp_path, "dedup")
    assert out.count() == len(events)


def test_replayed_batch_does_not_double(spark, tmp_path):
    write = sinks.write_batch(str(tmp_path / "b"))
    df = spark.range(10)
    for _ in range(2):
        write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 20


def test_two_checkpoints_on_one_path(spark, inbox, events, tmp_path):
    """A query that starts anew overwrites nothing, also when its batches have the numbers of the first one's; a batch that comes again is written once."""
    path, (first, second) = str(tmp_path / "out"), (str(tmp_path / c) for c in "ab")
    for checkpoint in (first, first, second):
        streams.run_all([sinks.sink_foreach_batch(arriving(spark, inbox).select("transaction_id"), path, checkpoint, "append")])
    rows = spark.read.parquet(path)
    assert rows.count() == 2 * len(events) and sorted(r[0] for r in rows.select("batch_id").distinct().collect()) == list(range(10))
    assert {r["count"] for r in rows.groupBy("transaction_id").count().collect()} == {2}


def test_batch_that_broke_off(spark, tmp_path):
    """The folder of a batch that failed is written again, and no other."""
    path, calls = str(tmp_path / "b"), []

    def write(slot):
        calls.append(slot)
        spark.range(3).write.mode("overwrite").parquet(f"{path}/batch_id={slot}")
        if len(calls) == 2:
            raise RuntimeError("lost")

    for i in (0, 1, 1, 1, 2):
        try:
            sinks.write_once([path], spark.range(3), i, write)
        except RuntimeError:
            pass
    assert calls == [0, 1, 1, 2] and spark.read.parquet(path).count() == 9


def test_long_run_is_counted_in_full(spark, tmp_path):
    """More micro-batches than a query remembers."""
    folder = str(tmp_path / "many")
    spark.range(150).repartitionByRange(150, "id").write.option("maxRecordsPerFile", 1).parquet(folder)
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    _, batches, row = run(source, tmp_path, "many-out")
    assert batches == 150 and row["rows"] == 150 and row["rows_per_batch"] == 1


def test_window_velocity_across_batches(spark, events, inbox, tmp_path):
    """Instants with several rows, missing and odd amounts; state has an entry for each instant."""
    odd = F.when(F.col("transaction_id") % 7 == 0, None).when(F.col("transaction_id") % 50 == 1, float("inf")).otherwise(F.col("amount"))

    def shaped(df):
        return df.withColumn("event_time", F.timestamp_seconds(F.floor(F.col("us") / (30 * US)) * 30)).withColumn("amount", odd)

    out, _, _ = run(streams.window_velocity_stream(shaped(arriving(spark, inbox)), delay="1 minute"), tmp_path, "w4")
    table = shaped(spark.createDataFrame(events, SCHEMA))
    last = table.agg(F.max(F.unix_micros("event_time"))).first()[0]
    want = velocity.window_velocity(table).filter(F.unix_micros("window_end") <= last - 60 * US)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() > 20


def test_failed_query_stops_the_others(spark, inbox, tmp_path):
    good = sinks.sink_parquet(arriving(spark, inbox), str(tmp_path / "good"), str(tmp_path / "good-c"))
    bad = arriving(spark, inbox).writeStream.option("checkpointLocation", str(tmp_path / "bad-c")).foreachBatch(
        lambda batch, i: (_ for _ in ()).throw(RuntimeError("broken sink")))
    with pytest.raises(Exception, match="broken sink"):
        streams.run_all([good, bad], trigger="1 second")
    assert not spark.streams.active


def test_progress(spark, inbox, events, tmp_path):
    _, _, row = run(arriving(spark, inbox).select("transaction_id"), tmp_path, "progress")
    assert (row["rows"], row["batches"], row["rows_per_batch"]) == (len(events), 5, len(events) / 5)


def test_convert_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.convert_to_parquet(spark.range(5), path) == 5
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.convert_to_parquet(spark.range(5), path)


def test_kafka_options():
    options = readers.kafka_source_options("host:9092", "transactions", 10)
    assert options == {"kafka.bootstrap.servers": "host:9092", "subscribe": "transactions", "startingOffsets": "earliest",
                       "failOnDataLoss": "false", "maxOffsetsPerTrigger": "10"}
    assert "maxOffsetsPerTrigger" not in readers.kafka_source_options("host:9092", "transactions")
    assert sinks.kafka_sink_options("h", "t")["topic"] == "t"


def test_unknown_source_is_refused(spark):
    with pytest.raises(ValueError):
        readers.source(spark, "nothing", "/tmp")


def test_groups_of_cards_not_one_per_card(spark, tmp_path):
    """Many cards, one of them NULL, share a bounded number of states, and each keeps its own history."""
    inbox, cards = str(tmp_path / "many"), 500
    rows = [(card if card else None, card * 10 + i, i * US, float(i + 1)) for card in range(cards) for i in range(2)]
    spark.createDataFrame(rows, "card_id long, transaction_id long, us long, amount double").coalesce(1).write.parquet(inbox)
    df = readers.read_file_events(spark, inbox, "card_id long, transaction_id long, us long, amount double")
    queries = {"sums": stateful.trailing_stream(df, [60 * US]), "previous": stateful.previous_gap_stream(df), "arrival": stateful.arrival_gap_stream(df),
               "asof": stateful.asof_stream(df, df.select("card_id", (F.col("us") - 1).alias("vel_us"), F.col("transaction_id").alias("vel_id")), 60 * US)}
    made = {}
    for name, query in queries.items():
        (done,) = streams.run_all([sinks.sink_parquet(query, str(tmp_path / name), str(tmp_path / f"{name}-c"))])
        assert done.lastProgress["stateOperators"][0]["numRowsTotal"] <= 256 < cards, name
        made[name] = spark.read.parquet(str(tmp_path / name)).collect()
    assert {(r["id"], r["n0"], r["s0"]) for r in made["sums"]} == {(c * 10 + i, i + 1, (1.0, 3.0)[i]) for c in range(cards) for i in range(2)}
    for name in ("previous", "arrival"):
        assert {(r["card_id"], r["id"], r["gap"]) for r in made[name]} == {(c or None, c * 10 + i, (None, US)[i]) for c in range(cards) for i in range(2)}
    assert {(r["id"], r["record_id"]) for r in made["asof"]} == {(c * 10 + i, c * 10 + i) for c in range(cards) for i in range(2)}


def test_hydration_by_groups_of_cards(spark, tmp_path):
    """Many cards in few states: each event gets the record and the counters of its own card."""
    cards = 500
    spark.createDataFrame([(c, c * 10 + i, (i + 1) * US, 1.0) for c in range(cards) for i in range(3)], "card_id long, transaction_id long, event_time long, amount double").coalesce(1).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(c, 2 * US, c) for c in range(0, cards, 2)], "card_id long, velocity_time long, count_5m long").coalesce(1).write.parquet(str(tmp_path / "v"))
    streams.use_rocksdb(spark)
    out = stateful.hydrate_stream(
        readers.read_file_events(spark, str(tmp_path / "e"), "card_id long, transaction_id long, event_time long, amount double"), spark.range(cards).select(F.col("id").alias("card_id"), F.lit("x").alias("card4")),
        readers.read_file_events(spark, str(tmp_path / "v"), "card_id long, velocity_time long, count_5m long"), profile_fields=["card4"], day=float(US))
    (done,) = streams.run_all([sinks.sink_parquet(out, str(tmp_path / "h"), str(tmp_path / "h-c"))])
    assert max(o["numRowsTotal"] for o in done.lastProgress["stateOperators"]) <= 256
    got = {(r["transaction_id"], r["count_5m"], r["c1"], r["c2"], r["d1"], r["d2"]) for r in spark.read.parquet(str(tmp_path / "h")).collect()}
    assert got == {(c * 10 + i, c if i and not c % 2 else None, float(max(i + 1, c) if i and not c % 2 else i + 1), i + 1.0, float(i), float(min(i, 1)))
                   for c in range(cards) for i in range(3)}
