"""Queries over per-card history."""

from pyspark.sql import functions as F

from cardflow.functions.columns import amount_of, money
from cardflow.operators import history as H
from cardflow.operators.clean import clean_transactions
from cardflow.operators.ordered import ROWS
from cardflow.plans.sql import EV, MONEY, TX, with_
from cardflow.plans.sql import digits as sql_digits, odd as sql_odd
from cardflow.sources.views import digits, ev, odd, tx

QUERIES = {}



def hist_columns():
    return [F.col("transaction_id"), F.col("card_id").cast("long").alias("card_id"), "dt", "hist_count",
            F.round("hist_sum", 2).alias("hist_sum"), F.round("hist_mean", 8).alias("hist_mean"), "hist_max"]


HIST_SQL = f"""SELECT transaction_id, card_id, dt, count(*) OVER w AS hist_count,
  round(CAST(sum(CAST(amount AS {MONEY})) OVER w AS DOUBLE), 2) AS hist_sum,
  round(CAST(sum(CAST(amount AS {MONEY})) OVER w AS DOUBLE) / nullif(count(*) OVER w, 0), 8) AS hist_mean,
  max(amount) OVER w AS hist_max
FROM tx WINDOW w AS (PARTITION BY card_id ORDER BY dt, transaction_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def history_features(spark, sf):
    return H.history_features(clean_transactions(tx(spark, sf), "amount", "dt", "card_id"), "card_id", "dt",
                              ["transaction_id"]).select(*hist_columns())


QUERIES["n1_history_features"] = (history_features, with_(TX) + HIST_SQL)
QUERIES["n1_history_features_split"] = (
    lambda spark, sf: H.history_features(tx(spark, sf), "card_id", "dt", ["transaction_id"], split=True).select(*hist_columns()),
    with_(TX) + HIST_SQL)

for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"n1_history_odd{suffix}"] = (
        lambda spark, sf, split=split: H.history_features(odd(tx(spark, sf)), "card_id", "dt", ["transaction_id"], split=split).select(
            "transaction_id", "hist_count", digits("hist_sum", 7).alias("hist_sum")),
        with_(TX, sql_odd("tx")) + f"""SELECT transaction_id, count(*) OVER w AS hist_count, {sql_digits('sum(amount) OVER w', 7)} AS hist_sum
FROM odd WINDOW w AS (PARTITION BY card_id ORDER BY dt, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

for delay in (0, 90 * 86400):
    frame = ("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING" if delay == 0 else
             f"RANGE BETWEEN UNBOUNDED PRECEDING AND {delay} PRECEDING")
    order = "dt, transaction_id" if delay == 0 else "dt"
    for suffix, split in (("", None), ("_split", True)):
        QUERIES[f"n2_label_history{'_delayed' if delay else ''}{suffix}"] = (
            lambda spark, sf, delay=delay, split=split: H.label_history(
                tx(spark, sf), "card_id", "dt", ["transaction_id"], "is_fraud", delay, split).select(
                "transaction_id", "card_id", "label_count_before"),
            with_(TX) + f"""SELECT transaction_id, card_id, CAST(coalesce(sum(is_fraud) OVER (
  PARTITION BY card_id ORDER BY {order} {frame}), 0) AS BIGINT) AS label_count_before FROM tx""")

GAP = ["transaction_id", "card_id", "dt", "prev_time", "gap"]
QUERIES["n3_previous_gap_row"] = (
    lambda spark, sf: H.previous_gap(tx(spark, sf), "card_id", "dt", ["transaction_id"]).select(*GAP),
    with_(TX) + """SELECT transaction_id, card_id, dt, lag(dt) OVER w AS prev_time, dt - lag(dt) OVER w AS gap
FROM tx WINDOW w AS (PARTITION BY card_id ORDER BY dt, transaction_id)""")

STRICT_SQL = """SELECT transaction_id, card_id, dt, prev_time, dt - prev_time AS gap FROM (
  SELECT *, (SELECT max(b.dt) FROM tx b WHERE b.card_id = a.card_id AND b.dt < a.dt) AS prev_time FROM tx a)"""
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"n4_previous_gap_strict{suffix}"] = (
        lambda spark, sf, split=split: H.previous_gap(
            tx(spark, sf), "card_id", "dt", ["transaction_id"], "strict", split).select(*GAP),
        with_(TX) + STRICT_SQL)

QUERIES["n8_causal_counters"] = (
    lambda spark, sf: H.causal_counters(ev(spark, sf), "card_id", "us", ["transaction_id"],
                                        F.col("k") % 7 != 0, day=86400e6).select(
        "transaction_id", "card_id", "c1", "c2", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2")),
    with_(EV) + """, a AS (SELECT *, CASE WHEN k % 7 <> 0 THEN us END AS m FROM ev)
SELECT transaction_id, card_id, CAST(count(m) OVER w + 1 AS DOUBLE) AS c1,
  CAST(count(m) OVER w + 1 AS DOUBLE) AS c2,
  round(coalesce((us - min(m) OVER w) / 86400e6::DOUBLE, 0), 6) AS d1,
  round(coalesce((us - max(m) OVER w) / 86400e6::DOUBLE, 0), 6) AS d2
FROM a WINDOW w AS (PARTITION BY card_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

QUERIES["n12_replay_order"] = (
    lambda spark, sf: H.replay_order(tx(spark, sf).select("transaction_id", "card_id", "dt"), "dt",
                                     ["transaction_id"]),
    with_(TX) + "SELECT transaction_id, card_id, dt FROM tx ORDER BY dt, transaction_id")

QUERIES["n13_first_profile"] = (
    lambda spark, sf: H.first_profile(tx(spark, sf), "card_id", "dt", ["transaction_id"],
                                      ["transaction_id", "amount", "product_cd"]),
    with_(TX) + """SELECT card_id, transaction_id, amount, product_cd FROM tx
QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY dt, transaction_id) = 1""")

QUERIES["w14_running_totals"] = (
    lambda spark, sf: H.running_totals(ev(spark, sf), "card_id", "us", ["transaction_id"]).select(
        "transaction_id", "card_id", F.round("running_total", 4).alias("running_total"), "running_count"),
    with_(EV) + f"""SELECT transaction_id, card_id,
  round(CAST(sum(CAST(amount AS {MONEY})) OVER w AS DOUBLE), 4) AS running_total, count(*) OVER w AS running_count
FROM ev WINDOW w AS (PARTITION BY card_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING)""")

J8_SQL = f"""SELECT transaction_id, card_id, dt, count(*) OVER w AS n,
  round(CAST(sum(CAST(amount AS {MONEY})) OVER w AS DOUBLE), 2) AS total, min(dt) OVER w AS first_dt,
  max(dt) OVER w AS prev_dt FROM tx
WINDOW w AS (PARTITION BY card_id ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"j8_causal_history{suffix}"] = (
        lambda spark, sf, split=split: H.causal_history(tx(spark, sf), "card_id", "dt", ["transaction_id"], {
            "n": ROWS, "total": ("sum", money("amount")), "first_dt": ("min", F.col("dt")),
            "prev_dt": ("max", F.col("dt"))}, split).select(
            "transaction_id", "card_id", "dt", "n", F.round(amount_of("total"), 2).alias("total"),
            "first_dt", "prev_dt"),
        with_(TX) + J8_SQL)

QUERIES["h4_causality_audit"] = (
    lambda spark, sf: H.causality_violations(tx(spark, sf), "card_id", "dt", ["transaction_id"]),
    with_(TX) + """SELECT count(*) AS rows, count(p) AS with_history,
  count(CASE WHEN p >= dt THEN 1 END) AS violations
FROM (SELECT dt, (SELECT max(b.dt) FROM tx b WHERE b.card_id = a.card_id AND b.dt < a.dt) AS p FROM tx a)""")
