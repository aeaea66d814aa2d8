"""Queries that write what they compute and read it back: sources, sinks and streams (S, W, J6)."""

from pyspark.sql import functions as F

from cardflow.operators import hydrate as H
from cardflow.operators.velocity import SECOND, hopping_features
from cardflow.plans.features import (
    DAY_US, HYDRATE_SQL, HYDRATED_SQL, PROFILE_FIELDS, TOLERANCE, events, hydrate_columns, hydrated, profiles, velocity)
from cardflow.plans.relational import SPLIT_SQL, VEL_SQL, rounded, split_tx, velocity_records, wide_rows
from cardflow.plans.sql import EV, LOG, MONEY, TX, with_
from cardflow.plans.velocity import summary_columns, summary_sql, us, velocity_window_columns, window_velocity_sql
from cardflow.session import stored
from cardflow.sources import logs as L
from cardflow.sources import readers as I
from cardflow.sources import sinks as O
from cardflow.sources.views import ev, table
from cardflow.streaming import stateful as T
from cardflow.streaming import streams as S

QUERIES = {}

# ---- S: batch

ORDERS = "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate DATE, o_orderpriority STRING"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"


def plain_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")


def csv_round_trip(spark, sf, schema=None):
    path = S.scratch(spark, "orders-csv")
    O.write_features(plain_orders(spark, sf), path, "csv")
    return I.read_transactions_csv(spark, path, schema, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "date"})


QUERIES["s1_csv_inferred"] = (csv_round_trip, ORDERS_SQL)
QUERIES["s1_csv_schema"] = (lambda spark, sf: csv_round_trip(spark, sf, ORDERS), ORDERS_SQL)
QUERIES["s2_read_columns"] = (
    lambda spark, sf: I.read_columns(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"]),
    "SELECT o_orderkey, o_totalprice FROM orders")


def converted(spark, sf):
    path = S.scratch(spark, "orders-parquet")
    O.convert_to_parquet(csv_round_trip(spark, sf, ORDERS), path)
    return I.read_parquet(spark, path)


QUERIES["s3_convert_to_parquet"] = (converted, ORDERS_SQL)
QUERIES["s4_read_parquet"] = (
    lambda spark, sf: I.read_parquet(spark, f"{sf}/customer.parquet"), "SELECT * FROM customer")
QUERIES["s7_envelope"] = (
    lambda spark, sf: I.envelope(ev(spark, sf).select(
        F.encode(F.col("card_id").cast("string"), "UTF-8").alias("key"),
        F.encode(F.to_json(F.struct("transaction_id", "k")), "UTF-8").alias("value"), F.col("event_time").alias("timestamp")))
    .withColumn("ingest_time", F.unix_micros("ingest_time")),
    with_(EV) + """SELECT CAST(card_id AS VARCHAR) AS card_key, '{"transaction_id":' || transaction_id || ',"k":' || k || '}' AS value,
  us AS ingest_time FROM ev""")
QUERIES["s11_json_payload"] = (
    lambda spark, sf: O.json_payload(ev(spark, sf).select("card_id", "transaction_id", "country"), "card_id"),
    with_(EV) + """SELECT CAST(card_id AS VARCHAR) AS key,
  '{"card_id":' || card_id || ',"transaction_id":' || transaction_id || ',"country":"' || country || '"}' AS value FROM ev""")


def eight_files(spark, sf):
    path = S.scratch(spark, "eight")
    O.write_parquet(plain_orders(spark, sf), path, files=8)
    back = I.read_parquet(spark, path)
    files = back.select(F.input_file_name().alias("file")).agg(F.count_distinct("file").alias("files")).scalar()
    return back.withColumn("files", files)


QUERIES["s12_write_parquet"] = (
    eight_files,
    ORDERS_SQL.replace("SELECT ", "SELECT CAST(8 AS BIGINT) AS files, "))


def formats(spark, sf):
    path, out = S.scratch(spark, "formats"), None
    for fmt in ("parquet", "csv"):
        O.write_features(plain_orders(spark, sf), f"{path}/{fmt}", fmt)
        back = (I.read_parquet(spark, f"{path}/{fmt}") if fmt == "parquet" else
                I.read_transactions_csv(spark, f"{path}/{fmt}", ORDERS)).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


QUERIES["s13_write_features"] = (
    formats, ORDERS_SQL.replace("SELECT ", "SELECT fmt, ") + ", (VALUES ('parquet'), ('csv')) v(fmt)")


def replaced(spark, sf):
    path = S.scratch(spark, "predictions")
    rows = split_tx(spark, sf).select("transaction_id", F.lit(0.1).alias("probability"), "split")
    O.replace_partition(rows, path)
    O.replace_partition(rows.filter("split = 'val'").withColumn("probability", F.lit(0.9)), path)
    return I.read_parquet(spark, path).select("transaction_id", "probability", "split")


QUERIES["s14_replace_partition"] = (
    replaced, with_(TX) + f""", s AS (SELECT transaction_id, {SPLIT_SQL} AS split FROM tx)
SELECT transaction_id, CASE WHEN split = 'val' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS probability, split FROM s""")


def registered(spark, sf):
    path = S.scratch(spark, "wide-csv")
    O.write_features(wide_rows(spark, sf), path, "csv")
    return I.source(spark, "wide", path).select("transaction_id", "card_id", "amount", "is_fraud", "dataset_source")


QUERIES["s15_source_registry"] = (
    registered, """SELECT 'TX-' || o_orderkey AS transaction_id, 'CARD-' || o_custkey AS card_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice, 2) ELSE 0 END AS amount, o_orderstatus = 'F' AS is_fraud, 'wide' AS dataset_source FROM orders""")

# ---- streams: the events table as a file stream, drained with availableNow

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def stream(spark, sf):
    S.use_rocksdb(spark)
    k = F.get_json_object("props", "$.k").cast("int")
    raw = I.read_file_events(spark, sf, EVENTS, pattern="events*.parquet")
    stamp = F.col("ts").cast("timestamp")
    return raw.select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("card_id"), F.col("event_type").alias("merchant_id"),
        F.col("value").alias("amount"), stamp.alias("event_time"), F.unix_micros(stamp).alias("us"), k.alias("k"),
        F.when(k >= 80, "FOREIGN").otherwise("LOCAL").alias("country"))


def drained(df, name, mode="append"):
    """The output of a stream as a table."""
    spark = df.sparkSession
    path, checkpoint = S.scratch(spark, name), S.scratch(spark, f"{name}-checkpoint")
    writer = O.sink_parquet(df, path, checkpoint) if mode == "append" else O.sink_foreach_batch(df, path, checkpoint, mode)
    S.run_all([writer])
    return I.read_parquet(spark, path)


QUERIES["s6_file_events"] = (
    lambda spark, sf: drained(stream(spark, sf).select("transaction_id", "card_id", "amount", "us"), "s6"),
    with_(EV) + "SELECT transaction_id, card_id, amount, us FROM ev")


def logged(spark, sf):
    """Two appends; the query ends after the first one and goes on from its offsets after the second."""
    log, path, checkpoint, progress = (S.scratch(spark, n) for n in ("s5-log", "s5-out", "s5-checkpoint", "s5-progress"))
    rows = ev(spark, sf)
    middle, n = rows.agg(F.avg("transaction_id"), F.count("*")).first()
    for half in (F.col("transaction_id") < middle, F.col("transaction_id") >= middle):
        records = rows.where(half).select(
            F.col("card_id").cast("string").alias("key"), F.to_json(F.struct("transaction_id", "us", "amount")).alias("value"), "transaction_id", "card_id", "us")
        L.append_log(records.withColumn("time", F.col("transaction_id")), log, "time", partition=F.col("card_id") % 6)
        arriving = L.read_log_events(spark, log, max_offsets=max(n // 6, 1), progress=progress, fail_on_data_loss=True)
        S.catch_up(O.sink_parquet(arriving, path, checkpoint))
    out = I.read_parquet(spark, path)
    value = F.from_json(F.col("value").cast("string"), "transaction_id long, us long, amount double")
    return out.select("partition", "offset", F.col("key").cast("string").cast("long").alias("card_id"), value.alias("v")).select("partition", "offset", "card_id", "v.*")


QUERIES["s5_log_events"] = (logged, with_(LOG) + 'SELECT partition, "offset", card_id, transaction_id, us, amount FROM log')
QUERIES["s8_sink_parquet"] = (
    lambda spark, sf: drained(stream(spark, sf).select("transaction_id", "country"), "s8"),
    with_(EV) + "SELECT transaction_id, country FROM ev")


def replayed_batches(spark, sf):
    """The writer is called twice for every micro-batch, as after a crash."""
    path, checkpoint = S.scratch(spark, "s9"), S.scratch(spark, "s9-checkpoint")
    write = O.write_batch(path)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    totals = S.running_totals_stream(stream(spark, sf))
    S.run_all([totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(twice)])
    return rounded(O.latest_state(I.read_parquet(spark, path), ["card_id"]), ["running_total"], 4)


TOTALS_SQL = with_(EV) + f"""SELECT card_id, round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE), 4) AS running_total,
  count(*) AS running_count FROM ev GROUP BY card_id"""
QUERIES["s9_foreach_batch_replay"] = (replayed_batches, TOTALS_SQL)


def two_checkpoints(spark, sf):
    """A second query with a new checkpoint on the folder of the first: its output comes after that of the first and replaces nothing."""
    path = S.scratch(spark, "s9-two")
    for name in ("s9-first", "s9-second"):
        S.run_all([O.sink_foreach_batch(S.running_totals_stream(stream(spark, sf)), path, S.scratch(spark, name))])
    rows = I.read_parquet(spark, path)
    newest = rounded(O.latest_state(rows, ["card_id"]), ["running_total"], 4)
    return newest.join(rows.groupBy("card_id").agg(F.count_distinct("batch_id").alias("written")), "card_id")


QUERIES["s9_two_checkpoints"] = (two_checkpoints, with_(EV) + f"""SELECT card_id, round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE), 4) AS running_total,
  count(*) AS running_count, 2 AS written FROM ev GROUP BY card_id""")
QUERIES["w14_running_totals_stream"] = (
    lambda spark, sf: rounded(O.latest_state(drained(S.running_totals_stream(stream(spark, sf)), "w14", "update"),
                                             ["card_id"]), ["running_total"], 4), TOTALS_SQL)

CLOSED = "(SELECT max(us) FROM ev) - 600000000"
QUERIES["w1_hopping_stream"] = (
    lambda spark, sf: drained(S.hopping_stream(stream(spark, sf), distinct="set"), "w1").select(
        us("window_start"), us("window_end"), "card_id", "count_tail", F.round("amount_tail", 4).alias("amount_tail"),
        "count_window", F.round("amount_window", 4).alias("amount_window"), "unique_merchants"),
    # Append mode emits the windows that the watermark has passed.
    with_(EV) + f""", h AS (SELECT ev.*, us // 60000000 * 60000000 - r.i * 60000000 AS ws FROM ev, range(10) r(i))
SELECT ws AS window_start, ws + 600000000 AS window_end, card_id, count(*) FILTER (us >= ws + 300000000) AS count_tail,
  round(CAST(coalesce(sum(CAST(amount AS {MONEY})) FILTER (us >= ws + 300000000), 0) AS DOUBLE), 4) AS amount_tail,
  count(*) AS count_window, round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE), 4) AS amount_window,
  count(DISTINCT merchant_id) AS unique_merchants FROM h WHERE ws + 600000000 <= {CLOSED} GROUP BY ws, card_id""")


def approx_windows(spark, sf):
    """The approximate distinct counts of the stream against the exact ones."""
    approx = drained(S.hopping_stream(stream(spark, sf)), "w1a").select("window_start", "card_id", "count_window", F.col("unique_merchants").alias("approx"))
    both = approx.join(hopping_features(ev(spark, sf)).select("window_start", "card_id", F.col("unique_merchants").alias("exact")), ["window_start", "card_id"])
    near = F.abs(F.col("approx") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.15)
    return both.select(us("window_start"), "card_id", "count_window", "exact", near.alias("near"))


QUERIES["w1_hopping_stream_approx"] = (
    approx_windows,
    with_(EV) + f"""SELECT us // 60000000 * 60000000 - r.i * 60000000 AS window_start, card_id, count(*) AS count_window, count(DISTINCT merchant_id) AS exact, TRUE AS near
FROM ev, range(10) r(i) WHERE us // 60000000 * 60000000 - r.i * 60000000 + 600000000 <= {CLOSED} GROUP BY 1, 2""")
QUERIES["w3_tumbling_stream"] = (
    lambda spark, sf: drained(S.summary_stream(stream(spark, sf), "5 minutes"), "w3").select(*summary_columns()),
    with_(EV) + summary_sql(300 * SECOND, 300 * SECOND).replace("FROM h GROUP BY", f"FROM h WHERE ws + 300000000 <= {CLOSED} GROUP BY"))
QUERIES["w4_window_velocity_stream"] = (
    lambda spark, sf: drained(S.window_velocity_stream(stream(spark, sf)), "w4").select(*velocity_window_columns()),
    window_velocity_sql(600 * SECOND, 300 * SECOND, 300 * SECOND) + f" WHERE ws + 600000000 <= {CLOSED}")


def watermark(spark, sf):
    """What a watermark of ten minutes lets through when nothing is late: every row."""
    rows = S.with_watermark(stream(spark, sf)).select("transaction_id", "event_time", "amount")
    return drained(rows, "w2").select("transaction_id", us("event_time"), "amount")


QUERIES["w2_with_watermark"] = (watermark, with_(EV) + "SELECT transaction_id, us AS event_time, amount FROM ev")

HOURS = 3600 * SECOND
QUERIES["w5_trailing_stream"] = (
    lambda spark, sf: drained(T.trailing_stream(stream(spark, sf), [6 * HOURS, 24 * HOURS]), "w5").select(
        F.col("id").alias("transaction_id"), F.col("n0").alias("count_short"), F.round("s0", 4).alias("total_short"),
        F.col("n1").alias("count_long"), F.round("s1", 4).alias("total_long")),
    with_(EV) + f"""SELECT a.transaction_id, count(*) FILTER (b.us >= a.us - {6 * HOURS}) AS count_short,
  round(CAST(sum(CAST(b.amount AS {MONEY})) FILTER (b.us >= a.us - {6 * HOURS}) AS DOUBLE), 4) AS total_short, count(*) AS count_long,
  round(CAST(sum(CAST(b.amount AS {MONEY})) AS DOUBLE), 4) AS total_long
FROM ev a JOIN ev b ON b.card_id = a.card_id AND b.us <= a.us AND b.us >= a.us - {24 * HOURS} GROUP BY a.transaction_id""")
QUERIES["w6_previous_gap_stream"] = (
    lambda spark, sf: drained(T.previous_gap_stream(stream(spark, sf)), "w6").select(
        F.col("id").alias("transaction_id"), "card_id", "us", "prev_us", "gap"),
    with_(EV) + """SELECT transaction_id, card_id, us, lag(us) OVER w AS prev_us, us - lag(us) OVER w AS gap FROM ev
WINDOW w AS (PARTITION BY card_id ORDER BY us)""")
QUERIES["w7_arrival_gap_stream"] = (
    lambda spark, sf: drained(T.arrival_gap_stream(stream(spark, sf).withColumn(
        "us", F.col("us") - F.col("k").cast("long") * (600 * SECOND))), "w7").select(F.col("id").alias("transaction_id"), "card_id", "us", "gap"),
    with_(EV) + f""", e AS (SELECT transaction_id, card_id, us - CAST(k AS BIGINT) * {600 * SECOND} AS us FROM ev)
SELECT transaction_id, card_id, us, CASE WHEN lag(us) OVER w IS NOT NULL THEN greatest(us - lag(us) OVER w, 0) END AS gap FROM e
WINDOW w AS (PARTITION BY card_id ORDER BY transaction_id)""")
QUERIES["w12_alerts_stream"] = (
    lambda spark, sf: drained(T.velocity_alerts_stream(stream(spark, sf), 24 * HOURS, max_spend=400.0), "w12").select(
        "transaction_id", "count_in_window", F.round("spend_in_window", 4).alias("spend_in_window"),
        F.array_join("alerts", ",").alias("alerts")),
    with_(EV) + f""", w AS (SELECT a.transaction_id, count(*) AS n, CAST(sum(CAST(b.amount AS {MONEY})) AS DOUBLE) AS s, count(DISTINCT b.country) AS c,
  bool_or(b.country = 'FOREIGN') AS f FROM ev a JOIN ev b ON b.card_id = a.card_id AND b.us <= a.us AND b.us >= a.us - {24 * HOURS} GROUP BY ALL)
SELECT transaction_id, n AS count_in_window, round(s, 4) AS spend_in_window, concat_ws(',', CASE WHEN n > 3 THEN 'VELOCITY' END,
  CASE WHEN s > 400 THEN 'BURST_SPEND' END, CASE WHEN c > 1 AND f THEN 'GEO_HOP' END) AS alerts FROM w""")


def asof_streamed(spark, sf):
    S.use_rocksdb(spark)
    path = S.scratch(spark, "velocity")
    O.write_parquet(velocity_records(spark, sf), path)
    records = I.read_file_events(spark, path, "card_id LONG, vel_us LONG, vel_id LONG, count_short LONG, total_long DOUBLE")
    events = stream(spark, sf).select("card_id", "transaction_id", (F.col("us") - 2500000).alias("us"))
    return drained(T.asof_stream(events, records, 6 * HOURS), "j6").select(
        F.col("id").alias("transaction_id"), "record_us", "record_id")


QUERIES["j6_asof_stream"] = (
    asof_streamed,
    with_(EV, VEL_SQL) + f""", e AS (SELECT transaction_id, card_id, us - 2500000 AS us FROM ev)
SELECT transaction_id, CASE WHEN us - vel_us <= {6 * HOURS} THEN vel_us END AS record_us, CASE WHEN us - vel_us <= {6 * HOURS} THEN vel_id END AS record_id
FROM e ASOF LEFT JOIN vel v ON e.card_id = v.card_id AND e.us >= v.vel_us""")


# The same operators over five micro-batches, with late rows, missing amounts and countries and busy cards.

WEEK = 7 * 86400 * SECOND
LATE = "10 days"
BATCHES_SQL = EV + f""", b AS (SELECT transaction_id, card_id % 40 AS card_id, us, CASE WHEN k % 9 <> 0 THEN amount END AS amount,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' ELSE country END AS country,
  CAST(least((us - (SELECT min(us) FROM ev)) // {WEEK}, 3) AS INTEGER) + CAST(k % 10 = 0 AS INTEGER) AS batch FROM ev),
seen AS (SELECT a.transaction_id AS id, a.us AS t, x.* FROM b a JOIN b x ON x.card_id = a.card_id AND x.batch <= a.batch
  AND (x.us < a.us OR x.us = a.us AND (x.batch, x.transaction_id) <= (a.batch, a.transaction_id)))"""


def batches(spark, sf, late_by=1):
    """``ev`` by weeks; every tenth row comes one batch late, or more. Busy cards, and holes in amounts and countries."""
    rows = ev(spark, sf)
    first = rows.agg(F.min("us")).first()[0]
    late = (F.col("k") % 10 == 0).cast("int")
    return rows.select(
        "transaction_id", F.pmod("card_id", F.lit(40)).alias("card_id"), "us", F.when(F.col("k") % 9 != 0, F.col("amount")).alias("amount"),
        F.when(F.col("k") % 11 != 0, F.when(F.col("k") % 13 == 0, "").otherwise(F.col("country"))).alias("country"),
        (F.least(F.floor((F.col("us") - first) / F.lit(WEEK)), F.lit(3)) + late * late_by).cast("int").alias("batch"))


def arriving(spark, rows, name):
    """A stream that gets the rows of one batch number after the other, each as a micro-batch of its own."""
    S.use_rocksdb(spark)
    inbox = S.scratch(spark, name)
    rows = stored(rows)  # computed once, by many tasks; only the copy to a file of its own is one task
    for i in range(6):
        rows.filter(F.col("batch") == i).coalesce(1).write.mode("append").parquet(inbox)
    return I.read_file_events(spark, inbox, rows.schema, max_files=1)


QUERIES["w5_trailing_batches"] = (
    lambda spark, sf: drained(T.trailing_stream(arriving(spark, batches(spark, sf), "w5b-in"), [6 * HOURS, 24 * HOURS], delay=LATE), "w5b").select(
        F.col("id").alias("transaction_id"), F.col("n0").alias("count_short"), F.round("s0", 4).alias("total_short"),
        F.col("n1").alias("count_long"), F.round("s1", 4).alias("total_long")),
    with_(BATCHES_SQL) + f"""SELECT id AS transaction_id, count(*) FILTER (us >= t - {6 * HOURS}) AS count_short,
  round(CAST(coalesce(sum(CAST(amount AS {MONEY})) FILTER (us >= t - {6 * HOURS}), 0) AS DOUBLE), 4) AS total_short, count(*) AS count_long,
  round(CAST(coalesce(sum(CAST(amount AS {MONEY})), 0) AS DOUBLE), 4) AS total_long FROM seen WHERE us >= t - {24 * HOURS} GROUP BY id""")
QUERIES["w6_previous_gap_batches"] = (
    lambda spark, sf: drained(T.previous_gap_stream(arriving(spark, batches(spark, sf), "w6b-in"), delay=LATE), "w6b").select(
        F.col("id").alias("transaction_id"), "card_id", "us", "prev_us", "gap"),
    with_(BATCHES_SQL) + """, p AS (SELECT a.transaction_id, max(x.us) AS prev_us FROM b a JOIN b x ON x.card_id = a.card_id AND x.batch <= a.batch AND x.us < a.us GROUP BY 1)
SELECT transaction_id, card_id, us, prev_us, us - prev_us AS gap FROM b LEFT JOIN p USING (transaction_id)""")
QUERIES["w7_arrival_gap_batches"] = (
    lambda spark, sf: drained(T.arrival_gap_stream(arriving(spark, batches(spark, sf), "w7b-in"), arrival="transaction_id", delay=LATE), "w7b").select(
        F.col("id").alias("transaction_id"), "card_id", "us", "gap"),
    with_(BATCHES_SQL) + """SELECT transaction_id, card_id, us, CASE WHEN lag(us) OVER w IS NOT NULL THEN greatest(us - lag(us) OVER w, 0) END AS gap FROM b
WINDOW w AS (PARTITION BY card_id ORDER BY batch, transaction_id)""")
QUERIES["w12_alerts_batches"] = (
    lambda spark, sf: drained(T.velocity_alerts_stream(arriving(spark, batches(spark, sf), "w12b-in"), 24 * HOURS, max_spend=400.0, delay=LATE), "w12b").select(
        "transaction_id", "count_in_window", F.round("spend_in_window", 4).alias("spend_in_window"), F.array_join("alerts", ",").alias("alerts")),
    with_(BATCHES_SQL) + f""", w AS (SELECT id, count(*) AS n, CAST(coalesce(sum(CAST(amount AS {MONEY})), 0) AS DOUBLE) AS s,
  count(*) FILTER (country = 'FOREIGN') AS f, count(*) FILTER (country NOT IN ('FOREIGN', '')) AS o FROM seen WHERE us >= t - {24 * HOURS} GROUP BY id)
SELECT id AS transaction_id, n AS count_in_window, round(s, 4) AS spend_in_window, concat_ws(',', CASE WHEN n > 3 THEN 'VELOCITY' END,
  CASE WHEN s > 400 THEN 'BURST_SPEND' END, CASE WHEN f > 0 AND o > 0 THEN 'GEO_HOP' END) AS alerts FROM w""")


def asof_batches(spark, sf):
    """Every third row is a record, the others are events."""
    rows = batches(spark, sf)
    records = rows.filter("transaction_id % 3 = 0").select("card_id", F.col("us").alias("vel_us"), F.col("transaction_id").alias("vel_id"), "batch")
    events = rows.filter("transaction_id % 3 <> 0")
    return drained(T.asof_stream(arriving(spark, events, "j6b-events"), arriving(spark, records, "j6b-records"), 24 * HOURS, delay=LATE), "j6b").select(
        F.col("id").alias("transaction_id"), "record_us")


QUERIES["j6_asof_batches"] = (
    asof_batches, with_(BATCHES_SQL) + f"""SELECT a.transaction_id, max(x.us) AS record_us FROM b a LEFT JOIN b x ON x.card_id = a.card_id AND x.batch <= a.batch
  AND x.us BETWEEN a.us - {24 * HOURS} AND a.us AND x.transaction_id % 3 = 0 WHERE a.transaction_id % 3 <> 0 GROUP BY 1""")


def refused(spark, sf):
    """Every tenth row comes two batches late. Spark refuses what is behind the watermark of the batch before the last."""
    rows = batches(spark, sf, late_by=2).withColumn("event_time", F.timestamp_micros("us"))
    return drained(S.dedup_stream(arriving(spark, rows, "w2-in"), ["transaction_id"], delay="2 days").select("transaction_id", "amount"), "w2b")


QUERIES["w2_late_rows"] = (
    refused, with_(BATCHES_SQL.replace("CAST(k % 10 = 0 AS INTEGER)", "2 * CAST(k % 10 = 0 AS INTEGER)"))
    + f""", w AS (SELECT batch, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS top FROM b GROUP BY batch)
SELECT transaction_id, amount FROM b JOIN w USING (batch) WHERE top IS NULL OR us > top // 1000 * 1000 - {2 * 86400 * SECOND}""")


def doubled(spark, sf):
    """Every event twice in the stream."""
    twice = stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return drained(S.dedup_stream(twice, ["transaction_id"], delay="40 days").select("transaction_id", "amount"), "w9")


QUERIES["w9_dedup_stream"] = (doubled, with_(EV) + "SELECT transaction_id, amount FROM ev")


def two_queries(spark, sf):
    """Window features and previous gaps from the same source, separate checkpoints."""
    windows = S.hopping_stream(stream(spark, sf), distinct="set")
    gaps = T.previous_gap_stream(stream(spark, sf))
    paths = {n: S.scratch(spark, n) for n in ("w10-windows", "w10-gaps")}
    S.run_all([O.sink_parquet(df, paths[n], S.scratch(spark, f"{n}-checkpoint"))
               for n, df in (("w10-windows", windows), ("w10-gaps", gaps))])
    made = {n: I.read_parquet(spark, p) for n, p in paths.items()}
    windows = made["w10-windows"].select(F.lit("w10-windows").alias("query"), F.unix_micros("window_start").alias("place"), "card_id", F.col("count_window").alias("value"))
    return windows.unionByName(made["w10-gaps"].select(F.lit("w10-gaps").alias("query"), F.col("id").alias("place"), "card_id", F.col("gap").alias("value")))


QUERIES["w10_two_queries"] = (
    two_queries,
    with_(EV) + f"""SELECT 'w10-gaps' AS query, transaction_id AS place, card_id, us - lag(us) OVER (PARTITION BY card_id ORDER BY us) AS value FROM ev
UNION ALL SELECT 'w10-windows', ws, card_id, count(*) FROM (SELECT card_id, us // 60000000 * 60000000 - r.i * 60000000 AS ws FROM ev, range(10) r(i))
WHERE ws + 600000000 <= {CLOSED} GROUP BY ws, card_id""")


def restarted(spark, sf):
    """Two runs on one checkpoint, the second after new files have come: each row once."""
    inbox, path, checkpoint = (S.scratch(spark, n) for n in ("w11-in", "w11-out", "w11-checkpoint"))
    rows = ev(spark, sf).select("transaction_id", "amount", "k")
    for part in ("k < 40", "k >= 40"):
        rows.filter(part).write.mode("append").parquet(inbox)
        arriving = I.read_file_events(spark, inbox, "transaction_id LONG, amount DOUBLE, k INT", max_files=2)
        S.run_all([O.sink_parquet(arriving, path, checkpoint)])
    return I.read_parquet(spark, path)


QUERIES["w11_restart"] = (restarted, with_(EV) + "SELECT transaction_id, amount, k FROM ev")


def progress(spark, sf):
    path, checkpoint = S.scratch(spark, "w13"), S.scratch(spark, "w13-checkpoint")
    with S.ProgressTotals(spark) as totals:
        done = S.run_all([O.sink_parquet(stream(spark, sf).select("transaction_id"), path, checkpoint)])
        found = S.stream_progress(totals, done)
    return found.select("rows", (F.col("batches") >= 1).alias("ran"), (F.col("rows_per_second") > 0).alias("measured"))


QUERIES["w13_stream_progress"] = (progress, "SELECT count(*) AS rows, TRUE AS ran, TRUE AS measured FROM events")


def hydrated_stream(spark, sf):
    """Events and velocity records week by week, five micro-batches on one state."""
    first = ev(spark, sf).agg(F.min("us")).first()[0]

    def weeks(df, time):
        return df.withColumn("batch", F.least(F.greatest(F.floor((F.col(time) - first) / F.lit(WEEK)), F.lit(0)), F.lit(4)).cast("int"))

    rows = arriving(spark, weeks(events(spark, sf), "event_time"), "h1-events").drop("batch")
    records = arriving(spark, weeks(velocity(spark, sf), "velocity_time"), "h1-velocity").drop("batch")
    return drained(T.hydrate_stream(rows, profiles(spark, sf), records, tolerance=TOLERANCE, day=DAY_US, profile_fields=PROFILE_FIELDS, delay="1 day"), "h1")


QUERIES["h1_hydrate_stream"] = (lambda spark, sf: hydrated_stream(spark, sf).select(*hydrate_columns()), HYDRATE_SQL + HYDRATED_SQL)


def gated(spark, sf):
    """Scored and rejected rows through one ``foreachBatch``."""
    inbox, kept, rejected, checkpoint = (S.scratch(spark, n) for n in ("h3-in", "h3-scored", "h3-quarantine", "h3-checkpoint"))
    rows = hydrated(spark, sf).select("transaction_id", "complete", "rejection_reason", "c2")
    O.write_parquet(rows, inbox)
    arriving = I.read_file_events(spark, inbox, rows.schema)
    S.run_all([arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: H.write_gated(batch, kept, rejected, batch_id))])
    return I.read_parquet(spark, kept).select("transaction_id", "rejection_reason").unionByName(
        I.read_parquet(spark, rejected).select("transaction_id", "rejection_reason"))


QUERIES["h3_gated_stream"] = (gated, HYDRATE_SQL + "SELECT transaction_id, rejection_reason FROM o")
