"""Queries over trailing features and event-time windows."""

from pyspark.sql import functions as F

from cardflow.operators import user_aggregate as U
from cardflow.operators import velocity as V
from cardflow.plans.sql import EV, MONEY, TX, with_
from cardflow.plans.sql import digits as sql_digits, odd as sql_odd
from cardflow.sources.views import digits, ev, odd, tx

QUERIES = {}
HOUR = 3600 * V.SECOND
DAY = 86400


def bucket_sql(x: str) -> str:
    return (f"CASE WHEN {x} <= 500 THEN 'LOW' WHEN {x} <= 2000 THEN 'MEDIUM' WHEN {x} <= 5000 THEN 'HIGH' "
            f"ELSE 'VERY_HIGH' END")


def below_sql(x: str) -> str:
    return (f"CASE WHEN {x} < 100 THEN 'LOW' WHEN {x} < 1000 THEN 'MEDIUM' WHEN {x} < 10000 THEN 'HIGH' "
            f"ELSE 'VERY_HIGH' END")


def us(col: str):
    return F.unix_micros(col).alias(col)


# Trailing velocity


def velocity_columns():
    rounded = [F.round(c, d).alias(c) for c, d in (
        ("total_short", 4), ("avg_short", 7), ("total_long", 4), ("avg_long", 7), ("count_ratio", 7), ("amount_ratio", 7))]
    return ["transaction_id", "card_id", "count_short", "count_long", *rounded, "amount_bucket"]


def velocity_sql(view: str, time: str, short: int, long: int) -> str:
    """By definition: every row joined with the rows of its window."""
    seen = f"b.card_id = a.card_id AND b.{time} <= a.{time} AND (b.{time} < a.{time} OR b.transaction_id <= a.transaction_id)"
    near = f"b.{time} >= a.{time} - {short}"
    return f""", w AS (SELECT a.transaction_id, a.card_id, count(*) FILTER ({near}) AS cs, count(*) AS cl,
  CAST(sum(CAST(b.amount AS {MONEY})) FILTER ({near}) AS DOUBLE) AS ts, CAST(sum(CAST(b.amount AS {MONEY})) AS DOUBLE) AS tl
  FROM {view} a JOIN {view} b ON {seen} AND b.{time} >= a.{time} - {long} GROUP BY ALL)
SELECT transaction_id, card_id, cs AS count_short, round(ts, 4) AS total_short, round(ts / cs, 7) AS avg_short,
  cl AS count_long, round(tl, 4) AS total_long, round(tl / cl, 7) AS avg_long, round(cs / cl, 7) AS count_ratio,
  round(ts / greatest(tl, 1.0), 7) AS amount_ratio, {bucket_sql('tl')} AS amount_bucket FROM w"""


for label, short, long in (("5m_10m", 300 * V.SECOND, 600 * V.SECOND), ("6h_24h", 6 * HOUR, 24 * HOUR)):
    QUERIES[f"n5_trailing_velocity_{label}"] = (
        lambda spark, sf, short=short, long=long: V.trailing_velocity(
            ev(spark, sf), "card_id", "us", ["transaction_id"], short=short, long=long).select(*velocity_columns()),
        with_(EV) + velocity_sql("ev", "us", short, long))
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"n5_trailing_velocity_odd{suffix}"] = (
        lambda spark, sf, split=split: V.trailing_velocity(
            odd(tx(spark, sf)), "card_id", "dt", ["transaction_id"], short=30 * DAY, long=300 * DAY, split=split).select(
            "transaction_id", "count_short", "count_long", digits("total_short", 7).alias("total_short"), digits("total_long", 7).alias("total_long"), "amount_bucket"),
        with_(TX, sql_odd("tx")) + f""", w AS (SELECT a.transaction_id, count(*) FILTER (near) AS cs, count(*) AS cl,
  greatest(sum(amount) FILTER (near), 0) AS ts, greatest(sum(amount), 0) AS tl
  FROM (SELECT a.transaction_id, b.amount, b.dt >= a.dt - {30 * DAY} AS near FROM odd a JOIN odd b
    ON b.card_id = a.card_id AND b.dt BETWEEN a.dt - {300 * DAY} AND a.dt AND (b.dt < a.dt OR b.transaction_id <= a.transaction_id)) a GROUP BY ALL)
SELECT transaction_id, cs AS count_short, cl AS count_long, {sql_digits('ts', 7)} AS total_short, {sql_digits('tl', 7)} AS total_long,
  {bucket_sql('tl')} AS amount_bucket FROM w""")
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"n5_trailing_velocity_ties{suffix}"] = (
        lambda spark, sf, split=split: V.trailing_velocity(
            tx(spark, sf), "card_id", "dt", ["transaction_id"], short=30 * DAY, long=90 * DAY, split=split)
        .select(*velocity_columns()),
        with_(TX) + velocity_sql("tx", "dt", 30 * DAY, 90 * DAY))

# Features at each row's time


def feature_columns():
    return ["count_short", F.round("amount_short", 4).alias("amount_short"), "count_long",
            F.round("amount_long", 4).alias("amount_long"), "unique_merchants_long", "since_previous"]


def features_sql(view: str, time: str, merchant: str, short: int, long: int) -> str:
    near, far = f"b.{time} >= a.{time} - {short}", f"b.{time} >= a.{time} - {long}"
    return f"""SELECT a.transaction_id, a.card_id, count(*) FILTER ({near}) AS count_short,
  round(CAST(sum(CAST(b.amount AS {MONEY})) FILTER ({near}) AS DOUBLE), 4) AS amount_short,
  count(*) FILTER ({far}) AS count_long,
  round(CAST(sum(CAST(b.amount AS {MONEY})) FILTER ({far}) AS DOUBLE), 4) AS amount_long,
  count(DISTINCT b.{merchant}) FILTER ({far}) AS unique_merchants_long,
  a.{time} - CASE WHEN count(*) FILTER (b.{time} = a.{time}) > 1 THEN a.{time}
    ELSE max(b.{time}) FILTER (b.{time} < a.{time}) END AS since_previous
FROM {view} a JOIN {view} b ON b.card_id = a.card_id AND b.{time} <= a.{time}
GROUP BY a.transaction_id, a.card_id, a.{time}"""


QUERIES["n6_features_at"] = (
    lambda spark, sf: V.features_at(ev(spark, sf), "card_id", "us", ["transaction_id"],
                                    short=6 * HOUR, long=24 * HOUR).select("transaction_id", "card_id", *feature_columns()),
    with_(EV) + features_sql("ev", "us", "merchant_id", 6 * HOUR, 24 * HOUR))
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"n6_features_at_ties{suffix}"] = (
        lambda spark, sf, split=split: V.features_at(
            tx(spark, sf), "card_id", "dt", ["transaction_id"], merchant="product_cd", short=90 * DAY,
            long=400 * DAY, split=split).select("transaction_id", "card_id", *feature_columns()),
        with_(TX) + features_sql("tx", "dt", "product_cd", 90 * DAY, 400 * DAY))

NOW = 1_705_276_800 * V.SECOND  # 2024-01-15 00:00 UTC, inside the events

QUERIES["n6_features_now"] = (
    lambda spark, sf: V.features_now(ev(spark, sf), "card_id", "us", ["transaction_id"], F.lit(NOW),
                                     short=24 * HOUR, long=72 * HOUR).select("card_id", *feature_columns()),
    with_(EV) + f""", p AS (SELECT *, us - lag(us) OVER (PARTITION BY card_id ORDER BY us, transaction_id) AS gap
  FROM ev WHERE us <= {NOW})
SELECT card_id, count(*) FILTER (us >= {NOW - 24 * HOUR}) AS count_short,
  round(CAST(coalesce(sum(CAST(amount AS {MONEY})) FILTER (us >= {NOW - 24 * HOUR}), 0) AS DOUBLE), 4) AS amount_short,
  count(*) FILTER (us >= {NOW - 72 * HOUR}) AS count_long,
  round(CAST(coalesce(sum(CAST(amount AS {MONEY})) FILTER (us >= {NOW - 72 * HOUR}), 0) AS DOUBLE), 4) AS amount_long,
  count(DISTINCT merchant_id) FILTER (us >= {NOW - 72 * HOUR}) AS unique_merchants_long,
  arg_max(coalesce(gap, -1), us) AS g, nullif(g, -1) AS since_previous
FROM p GROUP BY card_id""".replace("  arg_max(coalesce(gap, -1), us) AS g, nullif(g, -1) AS since_previous",
                                   "  nullif(arg_max(coalesce(gap, -1), us), -1) AS since_previous"))

# alerts

for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"n7_velocity_alerts{suffix}"] = (
        lambda spark, sf, split=split: V.velocity_alerts(
            ev(spark, sf), "card_id", "us", ["transaction_id"], width=24 * HOUR, max_spend=400.0, split=split).select(
            "transaction_id", "card_id", "count_in_window", F.round("spend_in_window", 4).alias("spend_in_window"),
            F.array_join("alerts", ",").alias("alerts")),
        with_(EV) + f""", w AS (SELECT a.transaction_id, a.card_id, count(*) AS n,
  CAST(sum(CAST(b.amount AS {MONEY})) AS DOUBLE) AS s, count(DISTINCT b.country) AS c,
  bool_or(b.country = 'FOREIGN') AS f FROM ev a JOIN ev b ON b.card_id = a.card_id AND b.us <= a.us
  AND b.us >= a.us - {24 * HOUR} GROUP BY ALL)
SELECT transaction_id, card_id, n AS count_in_window, round(s, 4) AS spend_in_window,
  concat_ws(',', CASE WHEN n > 3 THEN 'VELOCITY' END, CASE WHEN s > 400 THEN 'BURST_SPEND' END,
    CASE WHEN c > 1 AND f THEN 'GEO_HOP' END) AS alerts FROM w""")

# Event-time windows

QUERIES["w1_hopping_features"] = (
    lambda spark, sf: V.hopping_features(ev(spark, sf)).select(
        us("window_start"), us("window_end"), "card_id", "count_tail", F.round("amount_tail", 4).alias("amount_tail"),
        "count_window", F.round("amount_window", 4).alias("amount_window"), "unique_merchants"),
    with_(EV) + f""", h AS (SELECT *, us // 60000000 * 60000000 - k * 60000000 AS ws
  FROM (SELECT * EXCLUDE k FROM ev), range(10) r(k))
SELECT ws AS window_start, ws + 600000000 AS window_end, card_id,
  count(*) FILTER (us >= ws + 300000000) AS count_tail,
  round(CAST(coalesce(sum(CAST(amount AS {MONEY})) FILTER (us >= ws + 300000000), 0) AS DOUBLE), 4) AS amount_tail,
  count(*) AS count_window, round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE), 4) AS amount_window,
  count(DISTINCT merchant_id) AS unique_merchants
FROM h GROUP BY ws, card_id""")


def summary_columns():
    return [us("window_start"), us("window_end"), "card_id", "transaction_count",
            F.round("total_amount", 4).alias("total_amount"), F.round("average_amount", 7).alias("average_amount"),
            "amount_bucket"]


def summary_sql(size: int, slide: int) -> str:
    return f""", h AS (SELECT *, us // {slide} * {slide} - r.i * {slide} AS ws FROM ev, range({size // slide}) r(i))
SELECT ws AS window_start, ws + {size} AS window_end, card_id, count(*) AS transaction_count,
  round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE), 4) AS total_amount,
  round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE) / count(*), 7) AS average_amount,
  {below_sql(f'CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE)')} AS amount_bucket
FROM h GROUP BY ws, card_id"""


QUERIES["w3_tumbling_5m"] = (
    lambda spark, sf: V.window_summary(ev(spark, sf), "5 minutes").select(*summary_columns()),
    with_(EV) + summary_sql(300 * V.SECOND, 300 * V.SECOND))
QUERIES["w3_hopping_10m_5m"] = (
    lambda spark, sf: V.window_summary(ev(spark, sf), "10 minutes", "5 minutes").select(*summary_columns()),
    with_(EV) + summary_sql(600 * V.SECOND, 300 * V.SECOND))


def window_velocity_sql(z: int, s: int, b: int) -> str:
    return with_(EV) + f""", h AS (SELECT *, us // {s} * {s} - r.i * {s} AS ws FROM ev, range({z // s}) r(i)),
m AS (SELECT *, max(us) OVER (PARTITION BY ws, card_id) AS latest FROM h),
g AS (SELECT ws, card_id, count(*) FILTER (us >= latest - {b}) AS cs, count(*) AS cl,
  CAST(sum(CAST(amount AS {MONEY})) FILTER (us >= latest - {b}) AS DOUBLE) AS ts,
  CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE) AS tl FROM m GROUP BY ws, card_id)
SELECT ws AS window_start, ws + {z} AS window_end, card_id, cs AS count_short, round(ts, 4) AS total_short,
  round(ts / cs, 7) AS avg_short, cl AS count_long, round(tl, 4) AS total_long, round(tl / cl, 7) AS avg_long,
  round(cs / cl, 7) AS count_ratio, CASE WHEN tl > 0 THEN round(ts / tl, 7) ELSE 0 END AS amount_ratio,
  {below_sql('tl')} AS amount_bucket FROM g"""


def velocity_window_columns():
    return [us("window_start"), us("window_end"), "card_id", "count_short",
            F.round("total_short", 4).alias("total_short"), F.round("avg_short", 7).alias("avg_short"), "count_long",
            F.round("total_long", 4).alias("total_long"), F.round("avg_long", 7).alias("avg_long"),
            F.round("count_ratio", 7).alias("count_ratio"), F.round("amount_ratio", 7).alias("amount_ratio"), "amount_bucket"]


for label, size, slide, back, unit in (("10m_5m", "10 minutes", "5 minutes", "5 minutes", (600, 300, 300)),
                                       ("2d_1d", "48 hours", "24 hours", "24 hours", (172800, 86400, 86400))):
    z, s, b = (x * V.SECOND for x in unit)
    QUERIES[f"w4_window_velocity_{label}"] = (
        lambda spark, sf, size=size, slide=slide, back=back: V.window_velocity(ev(spark, sf), size, slide, back).select(*velocity_window_columns()),
        window_velocity_sql(z, s, b))

for label, size, slide, back, unit in (("10m_5m", "10 minutes", "5 minutes", "5 minutes", (600, 300, 300)),
                                       ("2d_1d", "48 hours", "24 hours", "24 hours", (172800, 86400, 86400))):
    z, s, b = (x * V.SECOND for x in unit)
    QUERIES[f"a10_window_velocity_{label}"] = (
        lambda spark, sf, size=size, slide=slide, back=back: U.window_velocity_by_state(ev(spark, sf), size, slide, back).select(*velocity_window_columns()),
        window_velocity_sql(z, s, b))

# Late rows; arrival order is the id, event time is shifted back for some rows

for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"w8_accept_late{suffix}"] = (
        lambda spark, sf, split=split: V.accept_late(
            ev(spark, sf).select("transaction_id", (F.col("us") - F.col("k") * F.lit(10 * V.SECOND)).alias("us")),
            "us", ["transaction_id"], 300 * V.SECOND, split=split),
        with_(EV) + f""", e AS (SELECT transaction_id, us - k * {10 * V.SECOND} AS us FROM ev)
SELECT transaction_id, us, us >= max(us) OVER (ORDER BY transaction_id ROWS UNBOUNDED PRECEDING) - {300 * V.SECOND}
  AS accepted FROM e""")
