"""Queries over cleaning, rules, splits, joins, aggregation, sets and sorting (P, J, A, K)."""

from pyspark.sql import functions as F

from cardflow.functions import columns as C
from cardflow.operators import aggregate as A
from cardflow.operators import clean as P
from cardflow.operators import joins as J
from cardflow.operators import user_aggregate as U
from cardflow.operators.velocity import SECOND, trailing_velocity
from cardflow.plans.sql import API_LOG, EV, MONEY, NULLS, PROF, SCORED2, TX, with_
from cardflow.plans.sql import digits as sql_digits, odd as sql_odd
from cardflow.sources import normalize as N
from cardflow.sources.readers import read_parquet
from cardflow.sources.sinks import write_parquet
from cardflow.sources.views import api_log, digits, ev, nulls, odd, prof, scored2, table, tx
from cardflow.streaming.streams import scratch

QUERIES = {}
DAY = 86400

# ---- P: projection, filter, normalisation

QUERIES["p1_parse_events"] = (
    lambda spark, sf: P.parse_events(table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
        .alias("value")), "k INT", "value"),
    """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k
FROM events""")

QUERIES["p2_validate_events"] = (
    lambda spark, sf: P.validate_events(
        nulls(spark, sf), ["transaction_id", "card_id", "merchant_id", "amount", "event_time"])
    .select("transaction_id", "card_id", "merchant_id", "amount"),
    with_(NULLS) + """SELECT transaction_id, card_id, merchant_id, amount FROM nulls
WHERE merchant_id IS NOT NULL AND amount >= 0""")

QUERIES["p3_clean_transactions"] = (
    lambda spark, sf: P.clean_transactions(nulls(spark, sf), "amount", "us", "card_id").select(
        "transaction_id", "card_id", "amount", "us"),
    with_(NULLS) + """SELECT transaction_id, CAST(card_id AS VARCHAR) AS card_id, amount, us FROM nulls
WHERE amount >= 0""")

QUERIES["p4_clean_lenient"] = (
    lambda spark, sf: P.clean_lenient(
        ev(spark, sf).select("transaction_id", F.when(F.col("k") % 9 == 0, "n/a").otherwise(
            F.col("amount").cast("string")).alias("amt"), F.when(F.col("k") % 5 != 0, F.col("us")).alias("t"),
            F.when(F.col("k") % 4 != 0, F.col("is_fraud").cast("int").cast("string")).alias("label")),
        "t", "amt", "label").select("transaction_id", "amt", "event_time_seconds", F.col("label").cast("int").alias("label")),
    with_(EV) + """SELECT transaction_id, CASE WHEN k % 9 = 0 THEN 0 ELSE amount END AS amt,
  CASE WHEN k % 5 <> 0 THEN CAST(us AS DOUBLE) ELSE 0 END AS event_time_seconds,
  CASE WHEN k % 4 <> 0 THEN CAST(is_fraud AS INTEGER) ELSE 0 END AS label FROM ev""")

QUERIES["p5_resolve_aliases"] = (
    lambda spark, sf: P.resolve_aliases(ev(spark, sf).select(
        F.when(F.col("k") % 2 == 0, F.col("card_id")).alias("customer_id"),
        F.when(F.col("k") % 3 == 0, F.col("card_id") + 1000).alias("uid"),
        F.when(F.col("k") % 7 != 0, F.col("transaction_id")).alias("txn_id"),
        F.floor("amount").alias("transaction_amount"), F.col("us").alias("timestamp"))).select(
        "transaction_id", "user_id", "amount", "event_time"),
    with_(EV) + """, u AS (SELECT *, CASE WHEN k % 2 = 0 THEN CAST(card_id AS VARCHAR)
  WHEN k % 3 = 0 THEN CAST(card_id + 1000 AS VARCHAR) ELSE 'UNKNOWN' END AS user_id FROM ev)
SELECT CASE WHEN k % 7 <> 0 THEN CAST(transaction_id AS VARCHAR)
  ELSE 'txn-' || user_id || '-' || CAST(floor(amount) AS VARCHAR) END AS transaction_id,
  user_id, floor(amount) AS amount, CAST(us AS VARCHAR) AS event_time FROM u""")

QUERIES["p6_normalize_event"] = (
    lambda spark, sf: P.normalize_event(ev(spark, sf).select(
        F.col("transaction_id").alias("TransactionID"),
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("CARD-"), F.col("card_id"))).when(
            F.col("k") % 7 != 0, F.col("card_id").cast("string")).alias("card_id"),
        F.when(F.col("k") % 9 != 0, F.col("amount")).alias("amount"),
        F.floor(F.col("us") / 1000).alias("timestamp"),
        F.when(F.col("k") % 4 != 0, F.concat(F.lit("M-"), F.col("merchant_id"))).alias("merchant_id"),
        "country", "is_fraud")).select("*", ).withColumn("event_time", F.round("event_time", 3)),
    with_(EV) + """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id,
  CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'CARD-UNKNOWN' ELSE 'CARD-' || card_id END AS card_id,
  CASE WHEN k % 9 <> 0 THEN amount END AS amount, round((us // 1000) / 1000.0::DOUBLE, 3) AS event_time,
  CASE WHEN k % 4 <> 0 THEN merchant_id ELSE 'W' END AS product_code, CAST(NULL AS VARCHAR) AS device_type,
  country FROM ev""")

QUERIES["p7_canonical_card"] = (
    lambda spark, sf: P.canonical_keys(ev(spark, sf).select("transaction_id", F.when(
        F.col("k") % 3 == 0, F.concat(F.lit("acct_"), F.col("card_id"))).otherwise(
        F.col("card_id").cast("string")).alias("card")), "card"),
    with_(EV) + """SELECT transaction_id, CASE WHEN k % 3 = 0 THEN 'acct_' || card_id ELSE 'CARD-' || card_id END
  AS card FROM ev""")

QUERIES["p8_epoch_seconds"] = (
    lambda spark, sf: ev(spark, sf).select("transaction_id", F.round(C.epoch_seconds(
        F.when(F.col("k") % 2 == 0, F.floor(F.col("us") / 1000)).otherwise(F.floor(F.col("us") / SECOND))), 3).alias("sec")),
    with_(EV) + """SELECT transaction_id, round(CASE WHEN k % 2 = 0 THEN (us // 1000) / 1000.0::DOUBLE
  ELSE CAST(us // 1000000 AS DOUBLE) END, 3) AS sec FROM ev""")

QUERIES["p9_to_epoch"] = (
    lambda spark, sf: ev(spark, sf).select("transaction_id", F.round(C.to_epoch(
        F.when(F.col("k") % 3 == 0, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("k") % 3 == 1, F.floor(F.col("us") / SECOND).cast("string")).otherwise(F.lit("soon"))), 3).alias("sec")),
    with_(EV) + """SELECT transaction_id, CASE WHEN k % 3 <> 2 THEN CAST(us // 1000000 AS DOUBLE) END AS sec FROM ev""")


def wide_rows(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("TransactionID"), F.col("o_custkey").cast("string").alias("card1"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .otherwise("bad").alias("TransactionAmt"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("isFraud"),
        F.col("o_orderpriority").alias("ProductCD"),
        F.when(F.col("o_orderkey") % 2 == 0, "desktop").otherwise("mobile").alias("DeviceType"),
        F.when(F.col("o_orderkey") % 3 == 0, "87").otherwise("").alias("addr2"))


QUERIES["p10_normalize_wide"] = (
    lambda spark, sf: N.normalize_source(wide_rows(spark, sf), "wide").select(
        "transaction_id", "card_id", "amount", "merchant_id", "device_type", "country", "is_fraud", "dataset_source"),
    """SELECT 'TX-' || o_orderkey AS transaction_id, 'CARD-' || o_custkey AS card_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice, 2) ELSE 0 END AS amount, 'M-' || o_orderpriority AS merchant_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'web' ELSE 'mobile' END AS device_type,
  CASE WHEN o_orderkey % 3 = 0 THEN '87' ELSE 'US' END AS country, o_orderstatus = 'F' AS is_fraud,
  'wide' AS dataset_source FROM orders""")

QUERIES["p10_normalize_card10k"] = (
    lambda spark, sf: N.normalize_source(ev(spark, sf).select(
        F.col("transaction_id").cast("string").alias("transaction_id"), F.col("amount").cast("string").alias("amount"),
        F.col("merchant_id").alias("merchant_category"), F.when(F.col("k") >= 80, "1").otherwise("0")
        .alias("foreign_transaction"), (F.col("k") % 2).cast("string").alias("location_mismatch"),
        F.col("k").cast("string").alias("device_trust_score"), (F.col("k") % 9).cast("string").alias("velocity_last_24h"),
        (F.col("card_id") % 60 + 20).cast("string").alias("cardholder_age"),
        F.col("is_fraud").cast("int").cast("string").alias("is_fraud")), "card10k").select(
        "transaction_id", "card_id", "amount", "merchant_id", "device_type", "country", "is_fraud", "location_mismatch",
        "velocity_24h"),
    with_(EV) + """SELECT 'TX-' || transaction_id AS transaction_id,
  'CARD-HOLDER-' || (card_id % 60 + 20) || '-' || lpad(CAST(transaction_id % 500 AS VARCHAR), 3, '0') AS card_id,
  amount, 'CAT-' || merchant_id AS merchant_id, CASE WHEN k < 50 THEN 'mobile' ELSE 'web' END AS device_type, country,
  is_fraud, k % 2 = 1 AS location_mismatch, CAST(k % 9 AS INTEGER) AS velocity_24h FROM ev""")

QUERIES["p10_normalize_mobile_money"] = (
    lambda spark, sf: N.normalize_source(table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("step"), F.col("l_returnflag").alias("type"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("nameOrig"),
        F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("nameDest"),
        (F.col("l_linestatus") == "F").cast("int").cast("string").alias("isFraud")), "mobile_money").select(
        "card_id", "merchant_id", "amount", "device_type", "country", "is_fraud", "type"),
    """SELECT 'C' || l_orderkey AS card_id, 'M' || l_suppkey AS merchant_id, round(l_extendedprice, 2) AS amount,
  'mobile' AS device_type, 'GLOBAL' AS country, l_linestatus = 'F' AS is_fraud, l_returnflag AS type FROM lineitem""")

QUERIES["p10_normalize_custom"] = (
    lambda spark, sf: N.normalize_source(table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("account_id"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("Amount"),
        (F.col("o_orderstatus") == "F").cast("int").cast("string").alias("Class")), "custom").select(
        "transaction_id", "card_id", "amount", "merchant_id", "is_fraud"),
    """SELECT 'TX-' || o_orderkey AS transaction_id, CAST(o_custkey AS VARCHAR) AS card_id,
  CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice, 2) ELSE 100 END AS amount, 'M100' AS merchant_id,
  o_orderstatus = 'F' AS is_fraud FROM orders""")

QUERIES["p11_compact_record"] = (
    lambda spark, sf: P.compact_record(wide_rows(spark, sf).withColumn(
        "TransactionAmt", F.nullif("TransactionAmt", F.lit("bad")))),
    """SELECT CAST(o_orderkey AS INTEGER) AS "TransactionID", CAST(o_orderstatus = 'F' AS INTEGER) AS "isFraud",
  0 AS "TransactionDT", CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice, 2) ELSE 0 END AS "TransactionAmt",
  o_orderpriority AS "ProductCD", CAST(o_custkey AS VARCHAR) AS card1, '' AS card2, '' AS card3, '' AS card4,
  '' AS card5, '' AS card6, '' AS addr1, CASE WHEN o_orderkey % 3 = 0 THEN '87' ELSE '' END AS addr2,
  '' AS "P_emaildomain", '' AS "R_emaildomain" FROM orders""")

QUERIES["p11_typed_record"] = (
    lambda spark, sf: P.typed_record(wide_rows(spark, sf).select("TransactionID", "TransactionAmt", "addr2"),
                                     ["TransactionAmt", "addr2"]).select(
        "TransactionID", F.col("TransactionAmt.float").alias("amt_float"), F.col("TransactionAmt.text").alias("amt_text"),
        F.col("addr2.int").alias("addr2_int"), F.col("addr2.text").alias("addr2_text")),
    """SELECT CAST(o_orderkey AS VARCHAR) AS "TransactionID",
  CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice, 2) END AS amt_float,
  CASE WHEN o_orderkey % 10 = 0 THEN 'bad' END AS amt_text,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(87 AS BIGINT) END AS addr2_int, CAST(NULL AS VARCHAR) AS addr2_text FROM orders""")

QUERIES["p12_tier_score"] = (
    lambda spark, sf: tx(spark, sf).select("transaction_id", C.risk_score(F.col("amount") / 50).alias("risk_score"))
    .withColumn("decision", C.audit_decision("risk_score")),
    with_(TX) + """SELECT transaction_id, s AS risk_score, CASE WHEN s >= 0.6 THEN 'FLAGGED_FOR_AUDIT' ELSE 'APPROVED' END
  AS decision FROM (SELECT transaction_id, CAST(CASE WHEN amount / 50 > 5000 THEN 0.95 WHEN amount / 50 > 1000 THEN 0.6
  WHEN amount / 50 > 250 THEN 0.3 ELSE 0.05 END AS DOUBLE) AS s FROM tx)""")

QUERIES["p13_apply_rules"] = (
    lambda spark, sf: P.apply_rules(ev(spark, sf).withColumn("v", F.col("k") % 9), threshold=150.0, velocity="v").select(
        "transaction_id", F.array_join("reasons", ",").alias("reasons"), "flagged"),
    with_(EV) + """SELECT transaction_id, concat_ws(',', CASE WHEN amount >= 150 THEN 'HIGH_AMOUNT' END,
  CASE WHEN country = 'FOREIGN' THEN 'LOCATION_MISMATCH' END, CASE WHEN k % 9 > 5 THEN 'HIGH_VELOCITY' END) AS reasons,
  amount >= 150 OR country = 'FOREIGN' OR k % 9 > 5 AS flagged FROM ev""")

QUERIES["p14_bucketize"] = (
    lambda spark, sf: ev(spark, sf).select(
        "transaction_id", C.bucketize(F.col("amount") * 30, C.AMOUNT_SCALE_BELOW).alias("below"),
        C.bucketize(F.col("amount") * 30, C.AMOUNT_SCALE_UPTO, right=True).alias("upto")),
    with_(EV) + """SELECT transaction_id, CASE WHEN amount * 30 < 100 THEN 'LOW' WHEN amount * 30 < 1000 THEN 'MEDIUM'
  WHEN amount * 30 < 10000 THEN 'HIGH' ELSE 'VERY_HIGH' END AS below, CASE WHEN amount * 30 > 5000 THEN 'VERY_HIGH'
  WHEN amount * 30 > 2000 THEN 'HIGH' WHEN amount * 30 > 500 THEN 'MEDIUM' ELSE 'LOW' END AS upto FROM ev""")

QUERIES["p15_log_amount"] = (
    lambda spark, sf: prof(spark, sf).select("card_id", F.round(C.log_amount("addr1"), 9).alias("ln1"),
                                             F.round(C.log_amount("addr1", 2.0), 9).alias("ln2")),
    with_(PROF) + "SELECT card_id, round(ln(greatest(addr1, 0) + 1), 9) AS ln1, round(ln(greatest(addr1, 0) + 2), 9) AS ln2 FROM prof")

QUERIES["p16_project_available"] = (
    lambda spark, sf: P.project_available(tx(spark, sf), ["transaction_id", "amount", "dist1", "product_cd", "addr1"]),
    with_(TX) + "SELECT transaction_id, amount, product_cd FROM tx")

QUERIES["p17_drop_labels"] = (
    lambda spark, sf: P.drop_labels(tx(spark, sf)),
    with_(TX) + "SELECT transaction_id, card_id, amount, dt, product_cd FROM tx")

QUERIES["p18_limit"] = (
    lambda spark, sf: A.top_k(tx(spark, sf).select("transaction_id", "amount"), [F.col("transaction_id")], 100),
    with_(TX) + "SELECT transaction_id, amount FROM tx ORDER BY transaction_id LIMIT 100")

TRAIN_END, VAL_END = 883612800, 946684800  # 1998-01-01 and 2000-01-01
SPLIT_SQL = f"CASE WHEN dt <= {TRAIN_END} THEN 'train' WHEN dt <= {VAL_END} THEN 'val' ELSE 'test' END"


def split_tx(spark, sf):
    return P.chronological_split(tx(spark, sf), "dt", TRAIN_END, VAL_END)


QUERIES["p19_split_stats"] = (
    lambda spark, sf: P.split_stats(split_tx(spark, sf), "dt", "is_fraud").withColumn("rate", F.round("rate", 9)),
    with_(TX) + f"""SELECT coalesce(split, 'total') AS split, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS positives,
  round(avg(is_fraud), 9) AS rate, min(dt) AS t_min, max(dt) AS t_max
FROM (SELECT *, {SPLIT_SQL} AS split FROM tx) GROUP BY ROLLUP (split)""")

PERIODS = {1995: "train", 1996: "train", 1997: "val", 1998: "monitor", 1999: "test"}


def period_tx(spark, sf):
    return P.period_split(tx(spark, sf).withColumn("year", F.year(F.timestamp_seconds("dt"))), "year", PERIODS)


QUERIES["p20_period_split"] = (
    lambda spark, sf: P.check_counts(period_tx(spark, sf), {"train": 4500, "val": 2300, "monitor": 1}).select("*"),
    with_(TX) + """, s AS (SELECT CASE year(make_timestamp(dt * 1000000)) WHEN 1995 THEN 'train' WHEN 1996 THEN 'train'
  WHEN 1997 THEN 'val' WHEN 1998 THEN 'monitor' WHEN 1999 THEN 'test' END AS split FROM tx)
SELECT split, count(*) AS rows, CAST(CASE split WHEN 'train' THEN 4500 WHEN 'val' THEN 2300 WHEN 'monitor' THEN 1 END
  AS BIGINT) AS expected, count(*) IS NOT DISTINCT FROM CASE split WHEN 'train' THEN 4500 WHEN 'val' THEN 2300
  WHEN 'monitor' THEN 1 END AS passed FROM s WHERE split IS NOT NULL GROUP BY split""")

QUERIES["p20_unmapped_periods"] = (
    lambda spark, sf: P.unmapped_periods(tx(spark, sf).withColumn("year", F.year(F.timestamp_seconds("dt"))), "year", {y: "any" for y in range(1995, 2000)}),
    with_(TX) + "SELECT CAST(year(make_timestamp(dt * 1000000)) AS INTEGER) AS year, count(*) AS rows FROM tx WHERE year(make_timestamp(dt * 1000000)) > 1999 GROUP BY 1")
QUERIES["k8_schema_diff"] = (
    lambda spark, sf: J.schema_diff(table(spark, sf, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string")), table(spark, sf, "orders").drop("o_orderstatus").withColumn("extra", F.lit(1))),
    """SELECT "column", CASE "column" WHEN 'o_custkey' THEN 'string' WHEN 'o_orderstatus' THEN 'string' END AS left_type,
  CASE "column" WHEN 'o_custkey' THEN 'bigint' WHEN 'extra' THEN 'int' END AS right_type
FROM (SELECT DISTINCT unnest(['o_custkey', 'o_orderstatus', 'extra']) AS "column" FROM orders)""")
QUERIES["p21_sample_n"] = (
    lambda spark, sf: P.sample_n(tx(spark, sf).select("transaction_id", "amount"), 500, "transaction_id", 42),
    with_(TX) + "SELECT transaction_id, amount FROM tx ORDER BY md5(transaction_id || ':42'), transaction_id LIMIT 500")

# ---- J: joins

QUERIES["j1_join_identity"] = (
    lambda spark, sf: J.join_identity(
        table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"),
        table(spark, sf, "labels"), "doc_id"),
    "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")

QUERIES["j2_join_optional"] = (
    lambda spark, sf: J.join_optional(J.join_optional(
        table(spark, sf, "documents").select("doc_id", "lang"), None, "doc_id"),
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id"),
    "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")

QUERIES["j3_join_one_to_one"] = (
    lambda spark, sf: J.join_one_to_one(table(spark, sf, "documents").select("doc_id", "source"),
                                        table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id"),
    "SELECT doc_id, source, toxic FROM documents LEFT JOIN labels USING (doc_id)")

for label, left, right, lk, rk in (("labels", "documents", "labels", "doc_id", "doc_id"),
                                   ("orders", "lineitem", "orders", "l_orderkey", "o_orderkey")):
    QUERIES[f"j4_linkage_{label}"] = (
        lambda spark, sf, left=left, right=right, lk=lk, rk=rk: J.linkage(
            table(spark, sf, left).select(F.col(lk).alias("id")), table(spark, sf, right).select(F.col(rk).alias("id")), "id"),
        f"""SELECT count(d.id) AS left_keys, count(l.id) AS right_keys,
  count(CASE WHEN d.id IS NOT NULL AND l.id IS NOT NULL THEN 1 END) AS overlap, count(CASE WHEN l.id IS NULL THEN 1 END) AS left_only,
  count(CASE WHEN d.id IS NULL THEN 1 END) AS right_only
FROM (SELECT DISTINCT {lk} AS id FROM {left}) d FULL JOIN (SELECT DISTINCT {rk} AS id FROM {right}) l ON d.id = l.id""")


def velocity_records(spark, sf):
    """N5 output one second earlier, as the right side of the as-of join."""
    return trailing_velocity(ev(spark, sf), "card_id", "us", ["transaction_id"]).select(
        "card_id", (F.col("us") - SECOND).alias("vel_us"), F.col("transaction_id").alias("vel_id"),
        "count_short", F.round("total_long", 4).alias("total_long"))


VEL_SQL = f"""vel AS (SELECT a.card_id, a.us - 1000000 AS vel_us, a.transaction_id AS vel_id,
  count(*) FILTER (b.us >= a.us - 300000000) AS count_short,
  round(CAST(sum(CAST(b.amount AS {MONEY})) AS DOUBLE), 4) AS total_long
  FROM ev a JOIN ev b ON b.card_id = a.card_id AND b.us <= a.us AND b.us >= a.us - 600000000
  GROUP BY a.card_id, a.us, a.transaction_id)"""

for label, tolerance in (("300s", 300 * SECOND), ("6h", 6 * 3600 * SECOND)):
    for suffix, split in (("", None), ("_split", True)):
        # Events are matched against the records of other events: 2.5 s before each event.
        QUERIES[f"j5_asof_join_{label}{suffix}"] = (
            lambda spark, sf, tolerance=tolerance, split=split: J.asof_join(
                ev(spark, sf).select("transaction_id", "card_id", (F.col("us") - 2500000).alias("us")),
                velocity_records(spark, sf), "card_id", "us", "vel_us", ["vel_id", "count_short", "total_long"],
                ["vel_id"], tolerance, split),
            with_(EV, VEL_SQL) + f""", e AS (SELECT transaction_id, card_id, us - 2500000 AS us FROM ev),
j AS (SELECT e.transaction_id, e.card_id, e.us, v.vel_us, v.vel_id, v.count_short, v.total_long
  FROM e ASOF LEFT JOIN vel v ON e.card_id = v.card_id AND e.us >= v.vel_us)
SELECT transaction_id, card_id, us, CASE WHEN us - vel_us <= {tolerance} THEN vel_us END AS matched_time,
  CASE WHEN us - vel_us <= {tolerance} THEN vel_id END AS vel_id,
  CASE WHEN us - vel_us <= {tolerance} THEN count_short END AS count_short,
  CASE WHEN us - vel_us <= {tolerance} THEN total_long END AS total_long FROM j""")

QUERIES["j7_lookup_profile"] = (
    lambda spark, sf: J.lookup_profile(
        ev(spark, sf).select("transaction_id", F.when(F.col("k") % 2 == 0, F.concat(
            F.lit("CARD-"), F.col("card_id"))).otherwise(F.col("card_id").cast("string")).alias("card_id")),
        prof(spark, sf).filter("addr1 >= 0")),
    with_(EV, PROF) + """SELECT e.transaction_id, CASE WHEN k % 2 = 0 THEN 'CARD-' || e.card_id
  ELSE CAST(e.card_id AS VARCHAR) END AS card_id, p.card4, p.card1, p.addr1, p.card_id IS NOT NULL AS known
FROM ev e LEFT JOIN prof p ON p.card_id = e.card_id AND p.addr1 >= 0""")



def both_spellings(spark, sf):
    """Profiles under the bare key, under the prefixed one, under both, and under none."""
    p = prof(spark, sf)
    bare = p.filter("card_id % 3 <> 0").withColumn("card_id", F.col("card_id").cast("string"))
    return bare.unionByName(p.filter("card_id % 5 < 3").select(
        F.concat(F.lit("CARD-"), F.col("card_id")).alias("card_id"), F.concat(F.lit("P-"), F.col("card4")).alias("card4"), "card1", "addr1"))


def spelled(spark, sf):
    """Events under either spelling of their card."""
    card = F.when(F.col("k") % 2 == 0, F.concat(F.lit("CARD-"), F.col("card_id"))).otherwise(F.col("card_id").cast("string"))
    return ev(spark, sf).select("transaction_id", card.alias("card_id"))


QUERIES["j7_lookup_both_spellings"] = (
    lambda spark, sf: J.lookup_profile(spelled(spark, sf), both_spellings(spark, sf)).select("transaction_id", "card_id", "card4", "known"),
    with_(EV, PROF) + """, s AS (SELECT CAST(card_id AS VARCHAR) AS key, card4 FROM prof WHERE card_id % 3 <> 0
  UNION ALL SELECT 'CARD-' || card_id, 'P-' || card4 FROM prof WHERE card_id % 5 < 3),
e AS (SELECT transaction_id, CAST(card_id AS VARCHAR) AS bare, CASE WHEN k % 2 = 0 THEN 'CARD-' || card_id ELSE CAST(card_id AS VARCHAR) END AS card_id FROM ev)
SELECT e.transaction_id, e.card_id, coalesce(a.card4, CASE WHEN e.card_id = e.bare THEN c.card4 ELSE b.card4 END) AS card4,
  a.key IS NOT NULL OR b.key IS NOT NULL OR c.key IS NOT NULL AS known
FROM e LEFT JOIN s a ON a.key = e.card_id LEFT JOIN s b ON b.key = e.bare LEFT JOIN s c ON c.key = 'CARD-' || e.bare""")

QUERIES["j9_align_predictions"] = (
    lambda spark, sf: J.alignment_summary(J.align_predictions(
        scored2(spark, sf).select("id", "y", F.col("p_a").alias("p")),
        table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("y"), F.lit(0.5).alias("p")),
        "id", "y", "p")),
    """SELECT count(*) AS common_ids, count(CASE WHEN a.toxic <> 1 - b.quality THEN 1 END) AS label_mismatches
FROM documents JOIN labels a USING (doc_id) JOIN labels b USING (doc_id)""")

QUERIES["j10_parity_report"] = (
    lambda spark, sf: J.parity_report(
        scored2(spark, sf).select("id", F.col("p_a").alias("p")), scored2(spark, sf).select("id", F.col("p_b").alias("p")),
        "id", "p", 0.5, 0.25).select("rows", "decisions_equal", "within_tolerance", *[
            F.round(c, 9).alias(c) for c in ("mean_diff", "max_diff", "p50", "p95", "p99")]),
    with_(SCORED2) + """, d AS (SELECT abs(p_a - p_b) AS diff, (p_a >= 0.5) = (p_b >= 0.5) AS same FROM scored2)
SELECT count(*) AS rows, count(*) FILTER (same) AS decisions_equal, count(*) FILTER (diff <= 0.25) AS within_tolerance,
  round(avg(diff), 9) AS mean_diff, round(max(diff), 9) AS max_diff, round(quantile_cont(diff, 0.5), 9) AS p50,
  round(quantile_cont(diff, 0.95), 9) AS p95, round(quantile_cont(diff, 0.99), 9) AS p99 FROM d""")

QUERIES["j11_lineage"] = (
    lambda spark, sf: J.lineage(
        ev(spark, sf).select("transaction_id", "card_id"), velocity_records(spark, sf).filter("total_long > 100")
        .withColumnRenamed("vel_id", "transaction_id"), "transaction_id", ["vel_us", "count_short"]),
    with_(EV, VEL_SQL) + """SELECT e.transaction_id, e.card_id, v.vel_us, v.count_short, v.vel_id IS NOT NULL AS has_features
FROM ev e LEFT JOIN vel v ON v.vel_id = e.transaction_id AND v.total_long > 100""")

# ---- A: aggregation

QUERIES["a1_card_rollup"] = (
    lambda spark, sf: A.aggregate_card_history(tx(spark, sf), "card_id", "amount", "is_fraud").select(
        "card_id", "transaction_count", F.round("total_amount", 2).alias("total_amount"),
        F.round("avg_amount", 8).alias("avg_amount"), "min_amount", "max_amount", "fraud_count",
        F.round("fraud_rate", 9).alias("fraud_rate")),
    with_(TX) + f"""SELECT card_id, count(*) AS transaction_count,
  round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE), 2) AS total_amount,
  round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE) / count(*), 8) AS avg_amount, min(amount) AS min_amount,
  max(amount) AS max_amount, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, round(avg(is_fraud), 9) AS fraud_rate
FROM tx GROUP BY card_id""")

QUERIES["a1_card_rollup_odd"] = (
    lambda spark, sf: A.aggregate_card_history(odd(tx(spark, sf)), "card_id", "amount", "is_fraud").select(
        "card_id", "transaction_count", digits("total_amount", 7).alias("total_amount"), digits("avg_amount", 5).alias("avg_amount")),
    with_(TX, sql_odd("tx")) + f"""SELECT card_id, count(*) AS transaction_count, {sql_digits('sum(amount)', 7)} AS total_amount,
  {sql_digits('sum(amount) / count(*)', 5)} AS avg_amount FROM odd GROUP BY card_id""")
QUERIES["a1_part_rollup"] = (
    lambda spark, sf: A.aggregate_card_history(table(spark, sf, "lineitem").withColumn("late", (F.col("l_returnflag") == "R").cast("int")), "l_suppkey", "l_extendedprice", "late").select(
        "l_suppkey", "transaction_count", F.round("total_amount", 2).alias("total_amount"), "min_amount", "max_amount", "fraud_count"),
    f"""SELECT l_suppkey, count(*) AS transaction_count, round(CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE), 2) AS total_amount,
  min(l_extendedprice) AS min_amount, max(l_extendedprice) AS max_amount, CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS fraud_count FROM lineitem GROUP BY l_suppkey""")

for label, cond in (("", "TRUE"), ("_empty", "amount < 0")):
    QUERIES[f"a2_summarize{label}"] = (
        lambda spark, sf, cond=cond: A.summarize(tx(spark, sf).filter(cond), "amount").select(
            "transaction_count", F.round("total_amount", 2).alias("total_amount"),
            F.round("average_amount", 6).alias("average_amount")),
        with_(TX) + f"""SELECT count(*) AS transaction_count,
  round(CAST(coalesce(sum(CAST(amount AS {MONEY})), 0) AS DOUBLE), 2) AS total_amount,
  round(coalesce(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE) / nullif(count(*), 0), 0), 6) AS average_amount
FROM tx WHERE {cond}""")

QUERIES["a3_conditional"] = (
    lambda spark, sf: ev(spark, sf).groupBy("card_id").agg(
        F.count_if(F.col("amount") > 100).alias("big_count"),
        F.round(C.money_sum(F.when(F.col("amount") > 100, F.col("amount"))), 4).alias("big_sum")),
    with_(EV) + f"""SELECT card_id, count(*) FILTER (amount > 100) AS big_count,
  round(CAST(sum(CAST(amount AS {MONEY})) FILTER (amount > 100) AS DOUBLE), 4) AS big_sum FROM ev GROUP BY card_id""")

QUERIES["a4_approx_merchants"] = (
    # Within three times the relative deviation asked for, of the exact number.
    lambda spark, sf: A.unique_merchants(ev(spark, sf), ["card_id"], "merchant_id", approx=0.05).join(
        A.unique_merchants(ev(spark, sf), ["card_id"], "merchant_id").withColumnRenamed("unique_merchants", "exact"), "card_id").select(
        "card_id", "exact", (F.abs(F.col("unique_merchants") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.15)).alias("near")),
    with_(EV) + "SELECT card_id, count(DISTINCT merchant_id) AS exact, TRUE AS near FROM ev GROUP BY card_id")


def sketched(spark, sf):
    """Cards per day and event type in stored sketches, from which days, types and windows of a week are rolled up."""
    path = scratch(spark, "a4-sketches")
    day = F.floor(F.col("us") / F.lit(86400 * 1000000)).cast("long").alias("day")
    write_parquet(A.merchant_sketches(ev(spark, sf).select("card_id", "merchant_id", day), ["merchant_id", "day"], "card_id"), path)
    return read_parquet(spark, path)


def rolled(spark, sf):
    """Each roll-up with the exact number, and whether it is within three deviations."""
    sketches = sketched(spark, sf)
    made = [("day", A.merge_sketches(sketches, ["day"]).withColumnRenamed("day", "place")),
            ("week", A.hop_sketches(sketches, [], "day", 7).withColumnRenamed("window", "place")),
            ("type", A.merge_sketches(sketches, ["merchant_id"]).withColumn("place", F.ascii("merchant_id").cast("long")).drop("merchant_id"))]
    rows = ev(spark, sf).select("card_id", "merchant_id", F.floor(F.col("us") / F.lit(86400 * 1000000)).cast("long").alias("day"))
    weeks = rows.withColumn("place", F.explode(F.sequence(F.col("day") - 6, F.col("day"))))
    exact = {"day": rows.withColumnRenamed("day", "place"), "week": weeks, "type": rows.withColumn("place", F.ascii("merchant_id").cast("long"))}
    out = None
    for name, estimates in made:
        both = estimates.join(A.unique_merchants(exact[name], ["place"], "card_id").withColumnRenamed("unique_merchants", "exact"), "place")
        near = F.abs(F.col("unique_merchants") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.04)
        part = both.select(F.lit(name).alias("rollup"), "place", "exact", near.alias("near"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["a4_sketch_rollups"] = (
    rolled,
    with_(EV) + """SELECT 'day' AS rollup, us // 86400000000 AS place, count(DISTINCT card_id) AS exact, TRUE AS near FROM ev GROUP BY 2
UNION ALL SELECT 'week', us // 86400000000 - i, count(DISTINCT card_id), TRUE FROM ev, range(7) r(i) GROUP BY 2
UNION ALL SELECT 'type', ascii(merchant_id), count(DISTINCT card_id), TRUE FROM ev GROUP BY 2""")

for suffix, by in (("", ["card_id"]), ("_pairs", ["merchant_id", "country"])):
    keys = ", ".join(by)
    QUERIES[f"a10_user_moments{suffix}"] = (
        lambda spark, sf, by=by: rounded(U.user_aggregate(nulls(spark, sf).repartition(7), by, ["amount"], U.Moments("amount")), ["mean", "var_pop", "var_samp"], 5),
        with_(NULLS) + f"""SELECT {keys}, count(amount) AS n, round(avg(amount), 5) AS mean, round(var_pop(amount), 5) AS var_pop,
  round(var_samp(amount), 5) AS var_samp FROM nulls GROUP BY {keys}""")

QUERIES["a5_exact_merchants"] = (
    lambda spark, sf: A.unique_merchants(nulls(spark, sf), ["card_id"], "merchant_id"),
    with_(NULLS) + "SELECT card_id, count(DISTINCT merchant_id) AS unique_merchants FROM nulls GROUP BY card_id")

QUERIES["a6_run_counters"] = (
    lambda spark, sf: A.run_counters(ev(spark, sf), ["merchant_id", "country"], "amount", "is_fraud").withColumn(
        "volume", F.round("volume", 4)),
    with_(EV) + f"""SELECT merchant_id, country, count(*) AS rows, count(*) FILTER (is_fraud) AS fraud_rows,
  round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE), 4) AS volume FROM ev GROUP BY merchant_id, country""")


def rounded(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


STATS = ["mean", "std", "min", "max", "p50", "p90", "p95", "p99"]
STATS_SQL = """count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min,
  round(max({v}), 6) AS max, round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.9), 6) AS p90,
  round(quantile_cont({v}, 0.95), 6) AS p95, round(quantile_cont({v}, 0.99), 6) AS p99"""

QUERIES["a7_distribution"] = (
    lambda spark, sf: rounded(A.distribution(api_log(spark, sf), "latency_ms"), STATS),
    with_(API_LOG) + f"SELECT {STATS_SQL.format(v='latency_ms')} FROM api_log")
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"a7_distribution_by{suffix}"] = (
        lambda spark, sf, split=split: rounded(A.distribution(api_log(spark, sf), "latency_ms", ["status"], split), STATS),
        with_(API_LOG) + f"SELECT status, {STATS_SQL.format(v='latency_ms')} FROM api_log GROUP BY status")

QUERIES["a8_percentile_nearest"] = (
    lambda spark, sf: A.percentile_nearest(ev(spark, sf), "amount", {"p50": .5, "p99": .99}, ["merchant_id"]),
    with_(EV) + """, r AS (SELECT merchant_id, amount, row_number() OVER (PARTITION BY merchant_id ORDER BY amount) - 1 AS i,
  count(*) OVER (PARTITION BY merchant_id) AS n FROM ev)
SELECT merchant_id, max(CASE WHEN i = CAST(floor(0.5 * n) AS BIGINT) THEN amount END) AS p50,
  max(CASE WHEN i = CAST(floor(0.99 * n) AS BIGINT) THEN amount END) AS p99 FROM r GROUP BY merchant_id""")

MONITOR_SQL = f"""count(*) AS requests, count(*) FILTER (status BETWEEN 200 AND 299) AS status_2xx,
  count(*) FILTER (status BETWEEN 400 AND 499) AS status_4xx, count(*) FILTER (status >= 500) AS status_5xx,
  round(avg(CAST(status BETWEEN 200 AND 299 AS INTEGER)), 6) AS success_rate, {STATS_SQL.format(v='latency_ms')}"""
QUERIES["a9_monitor_summary"] = (
    lambda spark, sf: rounded(A.monitor_summary(api_log(spark, sf)), ["success_rate", *STATS]),
    with_(API_LOG) + f"SELECT {MONITOR_SQL} FROM api_log")
QUERIES["a9_monitor_by_day"] = (
    lambda spark, sf: rounded(A.monitor_summary(api_log(spark, sf), time="event_time", window="1 day"),
                              ["success_rate", *STATS]).withColumn("window_start", F.unix_micros("window_start")),
    with_(API_LOG) + f"""SELECT epoch_us(date_trunc('day', event_time)) AS window_start, {MONITOR_SQL}
FROM api_log GROUP BY 1""")

# ---- K: sort, top-k, sets

QUERIES["k1_sort_entities"] = (
    lambda spark, sf: A.sort_entities(tx(spark, sf).select("card_id", "dt", "transaction_id"), "card_id", "dt",
                                      ["transaction_id"]),
    with_(TX) + "SELECT card_id, dt, transaction_id FROM tx ORDER BY card_id, dt, transaction_id")
QUERIES["k2_top_k"] = (
    lambda spark, sf: A.top_k(tx(spark, sf).select("transaction_id", "amount"),
                              [F.desc("amount"), F.asc("transaction_id")], 50),
    with_(TX) + "SELECT transaction_id, amount FROM tx ORDER BY amount DESC, transaction_id LIMIT 50")
QUERIES["k5_id_overlap"] = (
    lambda spark, sf: J.id_overlap(ev(spark, sf).filter("k < 60"), ev(spark, sf).filter("k >= 60"), "card_id"),
    with_(EV) + "SELECT card_id FROM ev WHERE k < 60 INTERSECT SELECT card_id FROM ev WHERE k >= 60")
QUERIES["k5_id_missing"] = (
    lambda spark, sf: J.id_missing(tx(spark, sf).filter("is_fraud = 1"), tx(spark, sf).filter("is_fraud = 0"), "card_id"),
    with_(TX) + "SELECT card_id FROM tx WHERE is_fraud = 1 EXCEPT ALL SELECT card_id FROM tx WHERE is_fraud = 0")
QUERIES["k6_union_splits"] = (
    lambda spark, sf: J.union_splits({
        "train": tx(spark, sf).filter(F.col("dt") <= TRAIN_END).select("transaction_id", "amount"),
        "rest": tx(spark, sf).filter(F.col("dt") > TRAIN_END).select("transaction_id", "is_fraud")}),
    with_(TX) + f"""SELECT transaction_id, CASE WHEN dt <= {TRAIN_END} THEN amount END AS amount,
  CASE WHEN dt > {TRAIN_END} THEN is_fraud END AS is_fraud, CASE WHEN dt <= {TRAIN_END} THEN 'train' ELSE 'rest' END AS split
FROM tx""")
ORDER_KEYS = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
QUERIES["k7_dedup"] = (
    lambda spark, sf: J.dedup(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ORDER_KEYS).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"),
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ORDER_KEYS)}) = 1""")
