"""Queries over preprocessing, sequences and hydration (F, N9-N11, H, Q6)."""

from pyspark.sql import functions as F

from cardflow.operators import hydrate as H
from cardflow.operators import prep as E
from cardflow.operators import sequences as S
from cardflow.operators.clean import normalize_event
from cardflow.operators.velocity import SECOND, trailing_velocity
from cardflow.plans.relational import SPLIT_SQL, rounded, split_tx
from cardflow.plans.sql import EV, NULLS, PROF, TX, with_
from cardflow.sources.views import ev, nulls, prof, tx

QUERIES = {}
CUT_US = 1_705_276_800 * SECOND  # training rows are before 2024-01-15


def split_nulls(spark, sf):
    df = nulls(spark, sf)
    return df.filter(F.col("us") < CUT_US), df


# ---- F: preprocessing

VS = ["V1", "V2", "V3"]


def v_columns(spark, sf):
    k = F.col("k")
    return ev(spark, sf).select("us", F.when(k % 10 == 0, k).alias("V1"), F.when(k % 2 == 0, k).alias("V2"), k.alias("V3"), "amount")


QUERIES["f1_drop_missing"] = (
    lambda spark, sf: rounded(E.fit_drop_missing(v_columns(spark, sf).filter(F.col("us") < CUT_US), 0.4), ["missing_share"], 9),
    with_(EV) + f""", t AS (SELECT * FROM ev WHERE us < {CUT_US}), m AS (SELECT 'V1' AS feature, avg(CAST(k % 10 <> 0 AS INTEGER)) AS s FROM t
UNION ALL SELECT 'V2', avg(CAST(k % 2 <> 0 AS INTEGER)) FROM t UNION ALL SELECT 'V3', avg(CAST(k IS NULL AS INTEGER)) FROM t)
SELECT feature, round(s, 9) AS missing_share FROM m WHERE s > 0.4""")

QUERIES["f2_fit_median"] = (
    lambda spark, sf: rounded(E.fit_median(split_nulls(spark, sf)[0].withColumn(
        "nothing", F.lit(None).cast("double")), ["amount", "k", "nothing"]), ["median"]),
    with_(NULLS) + f"""SELECT 'amount' AS feature, round(quantile_cont(amount, 0.5), 6) AS median FROM nulls WHERE us < {CUT_US}
UNION ALL SELECT 'k', round(quantile_cont(k::DOUBLE, 0.5), 6) FROM nulls WHERE us < {CUT_US} UNION ALL SELECT 'nothing', 0""")
QUERIES["f2_apply_median"] = (
    lambda spark, sf: (lambda train, df: rounded(E.apply_median(
        df.select("transaction_id", "amount"), E.fit_median(train, ["amount"])), ["amount"]))(*split_nulls(spark, sf)),
    with_(NULLS) + f"""SELECT transaction_id, round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM nulls WHERE us < {CUT_US})), 6)
  AS amount FROM nulls""")

# Training knows three event types only, so the others are unseen.
TRAIN_TYPES = "merchant_id IN ('click', 'view', 'error') OR merchant_id IS NULL"


def label_train(spark, sf):
    return nulls(spark, sf).filter(TRAIN_TYPES).select("merchant_id", "country")


def label_all(spark, sf):
    return nulls(spark, sf).select("transaction_id", "merchant_id", "country")


CATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce({c}, 'MISSING') AS category, count(*) AS train_count FROM nulls WHERE {TRAIN_TYPES} GROUP BY ALL"
    for c in ("merchant_id", "country"))
CODES = f", b AS ({CATS_SQL}), c AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS code FROM b)"
FULL = CODES + """, n AS (SELECT feature, max(code) AS last, max(CAST(category = 'MISSING' AS INTEGER)) AS hm FROM c GROUP BY feature),
f AS (SELECT feature, category, code, train_count FROM c UNION ALL SELECT feature, 'MISSING', last + 1, 0 FROM n WHERE hm = 0
UNION ALL SELECT feature, 'UNSEEN', last + 2 - hm, 0 FROM n)"""
QUERIES["f3_fit_labels"] = (
    lambda spark, sf: E.fit_labels(label_train(spark, sf), ["merchant_id", "country"]),
    with_(NULLS) + FULL + " SELECT feature, category, code, train_count FROM f")


def code_sql(fallback, table_name="c", value="code"):
    def one(c):
        return (f"coalesce((SELECT max({value}) FROM {table_name} t WHERE t.feature = '{c}' AND t.category = coalesce(x.{c}, 'MISSING')), "
                f"{fallback.format(c=c)}) AS {c}")
    return f"SELECT transaction_id, {one('merchant_id')}, {one('country')} FROM nulls x"


QUERIES["f3_apply_labels"] = (
    lambda spark, sf: E.apply_labels(label_all(spark, sf), E.fit_labels(label_train(spark, sf), ["merchant_id", "country"]),
                                     ["merchant_id", "country"]),
    with_(NULLS) + FULL + " " + code_sql("(SELECT max(code) FROM f WHERE feature = '{c}' AND category = 'UNSEEN')", "f"))
QUERIES["f4_labels_next"] = (
    lambda spark, sf: E.apply_labels(label_all(spark, sf), E.fit_categories(label_train(spark, sf), ["merchant_id", "country"]),
                                     ["merchant_id", "country"], unseen="next"),
    with_(NULLS) + CODES + " " + code_sql("(SELECT count(*) FROM c WHERE feature = '{c}')"))
QUERIES["f5_native_categories"] = (
    lambda spark, sf: E.apply_labels(label_all(spark, sf), E.fit_categories(label_train(spark, sf), ["merchant_id", "country"]),
                                     ["merchant_id", "country"], unseen="null"),
    with_(NULLS) + CODES + " " + code_sql("NULL"))
QUERIES["f6_frequency"] = (
    lambda spark, sf: E.apply_frequency(label_all(spark, sf), E.fit_frequency(label_train(spark, sf), ["merchant_id", "country"]),
                                        ["merchant_id", "country"]),
    with_(NULLS) + CODES + " " + code_sql("0", value="train_count"))

QUERIES["f7_missing_flags"] = (
    lambda spark, sf: (lambda df: E.missing_flags(df, E.flagged_columns(df, ["amount", "merchant_id", "country"], 0.08)).select(
        "transaction_id", F.col("amount_missing").cast("int").alias("amount_missing")))(nulls(spark, sf)),
    with_(NULLS) + "SELECT transaction_id, CAST(amount IS NULL AS INTEGER) AS amount_missing FROM nulls")
QUERIES["f8_temporal"] = (
    lambda spark, sf: rounded(E.temporal_features(ev(spark, sf).select(
        "transaction_id", (F.col("us") / SECOND).alias("t")), "t"), ["hour_sin", "hour_cos", "day_index"], 7).drop("t"),
    with_(EV) + """, h AS (SELECT transaction_id, us / 1e6::DOUBLE AS t FROM ev)
SELECT transaction_id, round(sin(2 * pi() * (fmod(t, 86400.0::DOUBLE) / 3600) / 24), 7) AS hour_sin,
  round(cos(2 * pi() * (fmod(t, 86400.0::DOUBLE) / 3600) / 24), 7) AS hour_cos, round((t - 86400) / 86400, 7) AS day_index FROM h""")


def plan(spark, sf):
    df = v_columns(spark, sf)
    dropped = {r["feature"]: "missing in training" for r in E.fit_drop_missing(df.filter(F.col("us") < CUT_US), 0.8).collect()}
    flags = E.flagged_columns(df, ["V2", "V3"], 0.05)
    rows = E.feature_plan(df.columns, dropped, flags, "us")
    return spark.createDataFrame(rows, "position int, feature string, action string, reason string")


QUERIES["f9_feature_plan"] = (
    plan,
    with_(EV) + f""", s AS (SELECT avg(CAST(k % 10 <> 0 AS INTEGER)) > 0.8 AS d1, avg(CAST(k % 2 <> 0 AS INTEGER)) > 0.05 AS f2 FROM ev WHERE us < {CUT_US})
SELECT CAST(v.p AS INTEGER) AS position, v.feature, v.action, v.reason FROM s, (VALUES (NULL, 'us', 'TRANSFORM', 'replaced by cyclic hour and day'),
  (NULL, 'V1', 'DROP', 'missing in training'), (0, 'V2', 'KEEP', ''), (1, 'V3', 'KEEP', ''), (2, 'amount', 'KEEP', ''), (3, 'hour_sin', 'ADD', 'derived from time'),
  (4, 'hour_cos', 'ADD', 'derived from time'), (5, 'day_index', 'ADD', 'derived from time'), (6, 'V2_missing', 'ADD', 'missingness')) v(p, feature, action, reason)
WHERE d1 AND f2""")
QUERIES["f10_enforce_contract"] = (
    lambda spark, sf: E.enforce_contract(tx(spark, sf), ["amount", "dist1", "product_cd"]),
    with_(TX) + "SELECT amount, CAST(NULL AS DOUBLE) AS dist1, product_cd FROM tx")


def sequences(spark, sf, split=None):
    return S.build_sequences(split_tx(spark, sf), "card_id", "dt", ["transaction_id"], ["amount"], "is_fraud",
                             keep=["split"], split=split)


SEQ_SQL = f""", s AS (SELECT *, {SPLIT_SQL} AS split FROM tx), w AS (SELECT card_id, dt, transaction_id, is_fraud AS y, split,
  lag(dt, 4) OVER o AS t1, lag(dt, 3) OVER o AS t2, lag(dt, 2) OVER o AS t3, lag(dt, 1) OVER o AS t4,
  lag(amount, 4) OVER o AS a1, lag(amount, 3) OVER o AS a2, lag(amount, 2) OVER o AS a3, lag(amount, 1) OVER o AS a4
  FROM s WINDOW o AS (PARTITION BY card_id ORDER BY dt, transaction_id)),
c AS (SELECT *, t1 < t2 AND t2 < t3 AND t3 < t4 AND t4 < dt AS strict FROM w WHERE t1 IS NOT NULL)"""
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"n9_build_sequences{suffix}"] = (
        lambda spark, sf, split=split: sequences(spark, sf, split).select(
            "card_id", "dt", "transaction_id", "y", "split", F.size("x").alias("steps"),
            *[F.get(F.get("x", i), 0).alias(f"a{i + 1}") for i in range(4)],
            *[F.round(F.get(F.get("x", i), 1), 7).alias(f"g{i + 1}") for i in range(4)]),
        with_(TX) + SEQ_SQL + """ SELECT card_id, dt, transaction_id, y, split, 4 AS steps, a1, a2, a3, a4, 0.0::DOUBLE AS g1,
  round(ln(1 + t2 - t1), 7) AS g2, round(ln(1 + t3 - t2), 7) AS g3, round(ln(1 + t4 - t3), 7) AS g4 FROM c WHERE strict""")
QUERIES["n10_gap_vector"] = (
    lambda spark, sf: sequences(spark, sf).select("transaction_id", F.round(F.aggregate(
        F.transform("x", lambda s: F.get(s, 1)), F.lit(0.0), lambda a, g: a + g), 6).alias("gap_sum")),
    with_(TX) + SEQ_SQL + """ SELECT transaction_id, round(ln(1 + t2 - t1) + ln(1 + t3 - t2) + ln(1 + t4 - t3), 6) AS gap_sum
FROM c WHERE strict""")
QUERIES["n11_sequence_audit"] = (
    lambda spark, sf: S.sequence_audit(S.candidate_windows(
        split_tx(spark, sf), "card_id", "dt", ["transaction_id"], ["amount"], "is_fraud", keep=["split"]), "card_id", "split"),
    with_(TX) + SEQ_SQL + """ SELECT split, count(*) FILTER (strict) AS windows, count(*) FILTER (NOT strict) AS excluded_tied,
  CAST(coalesce(sum(y) FILTER (strict), 0) AS BIGINT) AS positive_windows, count(DISTINCT card_id) FILTER (strict) AS entities
FROM c GROUP BY split""")

SCALER_SQL = SEQ_SQL + """, v AS (SELECT 0 AS feature, unnest([a1, a2, a3, a4]) AS x FROM c WHERE strict AND split = 'train'
UNION ALL SELECT 1, unnest([0, ln(1 + t2 - t1), ln(1 + t3 - t2), ln(1 + t4 - t3)]) FROM c WHERE strict AND split = 'train'),
m AS (SELECT feature, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS scale FROM v GROUP BY feature)"""
QUERIES["f11_fit_scaler"] = (
    lambda spark, sf: rounded(E.fit_scaler(sequences(spark, sf).filter("split = 'train'")), ["mean", "scale"], 5),
    with_(TX) + SCALER_SQL + " SELECT feature, round(mean, 5) AS mean, round(scale, 5) AS scale FROM m")
QUERIES["f11_apply_scaler"] = (
    lambda spark, sf: (lambda s: E.apply_scaler(s, E.fit_scaler(s.filter("split = 'train'"))).select(
        "transaction_id", F.round(F.get(F.get("x", 0), 0), 6).alias("a1"),
        F.round(F.get(F.get("x", 3), 1), 6).alias("g4")))(sequences(spark, sf)),
    with_(TX) + SCALER_SQL + """ SELECT transaction_id, round((a1 - m0.mean) / m0.scale, 6) AS a1, round((ln(1 + t4 - t3) - m1.mean) / m1.scale, 6) AS g4
FROM c, m m0, m m1 WHERE strict AND m0.feature = 0 AND m1.feature = 1""")


def wide_names(spark, sf):
    """``ev`` under the column names of the wide table."""
    return nulls(spark, sf).select(
        F.col("transaction_id").alias("TransactionID"), F.col("us").alias("TransactionDT"), F.col("amount").alias("TransactionAmt"),
        F.col("card_id").alias("card1"), F.col("merchant_id").alias("P_emaildomain"), F.col("k").alias("V17"),
        F.col("country").alias("addr2"), F.col("is_fraud").alias("isFraud"))


WIDE = [("TransactionID", "transaction_id", "L_IDENTIFIER", "bigint", "EVENT_DIRECT", "identifier"),
        ("TransactionDT", "us", "K_TEMPORAL", "bigint", "EVENT_DIRECT", ""),
        ("TransactionAmt", "amount", "A_TRANSACTION", "double", "EVENT_DIRECT", ""), ("card1", "card_id", "B_CARD", "bigint", "ENTITY_PROFILE", ""),
        ("P_emaildomain", "merchant_id", "D_EMAIL", "string", "ENTITY_PROFILE", ""), ("V17", "k", "I_ANONYMIZED_V", "int", "HISTORICAL_AGGREGATION", ""),
        ("addr2", "country", "C_ADDRESS", "string", "ENTITY_PROFILE", ""), ("isFraud", "is_fraud", "M_TARGET", "boolean", "UNRECONSTRUCTABLE", "target")]
QUERIES["f12_feature_inventory"] = (
    lambda spark, sf: E.feature_inventory(wide_names(spark, sf), {"isFraud": "target", "TransactionID": "identifier"}),
    with_(NULLS) + " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{g}' AS family, '{t}' AS type,
  round((count(*) - count({s})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, '{why}' AS drop_reason FROM nulls""" for c, s, g, t, _, why in WIDE))


def classified(spark, sf):
    return E.classify_features(E.missing_shares(wide_names(spark, sf), [w[0] for w in WIDE]).select(
        "feature", F.round("missing_share", 9).alias("missing_share")))


TIER_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS feature, round((count(*) - count({s})) / count(*)::DOUBLE, 9) AS missing_share, '{tier}' AS tier
FROM nulls""" for c, s, _, _, tier, _ in WIDE)
QUERIES["f13_classify_features"] = (classified, with_(NULLS) + TIER_SQL)
QUERIES["f14_provenance_summary"] = (
    lambda spark, sf: E.provenance_summary(classified(spark, sf)),
    with_(NULLS) + f"SELECT tier, count(*) AS features FROM ({TIER_SQL}) GROUP BY tier")
QUERIES["f15_balanced_weights"] = (
    lambda spark, sf: rounded(E.balanced_weights(tx(spark, sf).select("transaction_id", "is_fraud"), "is_fraud"), ["weight"], 9),
    with_(TX) + """SELECT transaction_id, is_fraud, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY is_fraud)), 9) AS weight FROM tx""")

# ---- H: hydration. Cards with a negative balance have no profile; some profiles and events have holes.

PROFILE_FIELDS = ("card1", "card4")
DAY_US, TOLERANCE = 86400e6, 6 * 3600 * SECOND


def profiles(spark, sf):
    return prof(spark, sf).filter("addr1 >= 0").withColumn(
        "card4", F.when(F.col("card_id") % 11 != 0, F.col("card4")))


def events(spark, sf):
    return ev(spark, sf).select(
        "transaction_id", "card_id", F.col("us").alias("event_time"),
        F.when(F.col("k") % 10 != 0, F.col("amount")).alias("amount"),
        F.when(F.col("k") % 13 != 0, F.col("merchant_id")).alias("product_code"))


def velocity(spark, sf):
    return trailing_velocity(ev(spark, sf), "card_id", "us", ["transaction_id"], short=24 * 3600 * SECOND,
                             long=48 * 3600 * SECOND).select(
        "card_id", (F.col("us") - SECOND).alias("velocity_time"), F.col("count_short").alias("count_5m"))


def hydrated(spark, sf, split=None):
    return H.hydrate(events(spark, sf), profiles(spark, sf), velocity(spark, sf), tolerance=TOLERANCE, day=DAY_US,
                     profile_fields=PROFILE_FIELDS, split=split)


HYDRATE_SQL = with_(EV, PROF) + f""", p AS (SELECT * REPLACE (CASE WHEN card_id % 11 <> 0 THEN card4 END AS card4) FROM prof WHERE addr1 >= 0),
e AS (SELECT ev.transaction_id, ev.card_id, us AS event_time, CASE WHEN k % 10 <> 0 THEN amount END AS amount,
  CASE WHEN k % 13 <> 0 THEN merchant_id END AS product_code, p.card4, p.card1, p.addr1, p.card_id IS NOT NULL AS known
  FROM ev LEFT JOIN p ON p.card_id = ev.card_id),
g AS (SELECT *, CASE WHEN amount IS NULL THEN 'MISSING_EVENT_FIELDS' WHEN NOT known THEN 'UNKNOWN_CARD'
  WHEN card4 IS NULL OR product_code IS NULL THEN 'INCOMPLETE_HYDRATION' END AS rejection_reason,
  CASE WHEN amount IS NULL THEN 'amount' WHEN NOT known THEN 'card1,card4,card6,addr1'
  ELSE concat_ws(',', CASE WHEN card4 IS NULL THEN 'card4' END, CASE WHEN product_code IS NULL THEN 'product_code' END) END AS missing_features FROM e),
vel AS (SELECT a.card_id, a.us - 1000000 AS vt, count(*) AS n FROM ev a JOIN ev b ON b.card_id = a.card_id AND b.us <= a.us
  AND b.us >= a.us - {24 * 3600 * SECOND} GROUP BY a.card_id, a.us),
v AS (SELECT g.*, CASE WHEN event_time - vt <= {TOLERANCE} THEN n END AS count_5m FROM g ASOF LEFT JOIN vel ON g.card_id = vel.card_id AND g.event_time >= vel.vt),
h AS (SELECT a.transaction_id, count(b.event_time) AS n, min(b.event_time) AS first, max(b.event_time) AS prev FROM v a LEFT JOIN v b
  ON b.card_id = a.card_id AND b.event_time < a.event_time AND b.rejection_reason IS NULL GROUP BY a.transaction_id),
o AS (SELECT v.*, n, first, prev FROM v JOIN h USING (transaction_id)) """
HYDRATED_SQL = """SELECT transaction_id, card_id, amount, product_code, card4, card1, addr1, rejection_reason IS NULL AS complete, count_5m,
  greatest(n + 1, coalesce(count_5m, 0))::DOUBLE AS c1, (n + 1)::DOUBLE AS c2, round(coalesce((event_time - first) / 86400e6::DOUBLE, 0), 6) AS d1,
  round(coalesce((event_time - prev) / 86400e6::DOUBLE, 0), 6) AS d2 FROM o"""


def hydrate_columns():
    return ["transaction_id", "card_id", "amount", "product_code", "card4", "card1", "addr1", "complete", "count_5m", "c1", "c2",
            F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2")]


for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"h1_hydrate{suffix}"] = (
        lambda spark, sf, split=split: hydrated(spark, sf, split).select(*hydrate_columns()), HYDRATE_SQL + HYDRATED_SQL)
QUERIES["h2_gate"] = (
    lambda spark, sf: hydrated(spark, sf).select("transaction_id", "complete", "rejection_reason",
                                                 F.array_join("missing_features", ",").alias("missing_features")),
    HYDRATE_SQL + "SELECT transaction_id, rejection_reason IS NULL AS complete, rejection_reason, missing_features FROM o")
QUERIES["h3_quarantine"] = (
    lambda spark, sf: H.quarantine(hydrated(spark, sf))[1].groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("rows")),
    HYDRATE_SQL + "SELECT rejection_reason, count(*) AS rows FROM o WHERE rejection_reason IS NOT NULL GROUP BY 1")
NAMES = ["TransactionAmt", "hour_sin", "card4", "C1", "V339", "D5_missing", "V340"]
QUERIES["h5_provenance_map"] = (
    lambda spark, sf: H.quarantine(hydrated(spark, sf))[0].select("transaction_id", F.explode(H.provenance_map(NAMES)).alias(
        "feature", "tier")),
    HYDRATE_SQL + """SELECT transaction_id, v.feature, v.tier FROM o, (VALUES ('TransactionAmt', 'EVENT_DIRECT'), ('hour_sin', 'EVENT_DERIVED'),
  ('card4', 'ENTITY_PROFILE'), ('C1', 'HISTORICAL_AGGREGATION'), ('V339', 'HISTORICAL_AGGREGATION'), ('D5_missing', 'EVENT_DERIVED'),
  ('V340', 'UNRECONSTRUCTABLE')) v(feature, tier) WHERE rejection_reason IS NULL""")

# ---- Q6: every event is damaged in one of ten ways, by its id


def damaged(spark, sf):
    c = F.col("transaction_id") % 10
    return ev(spark, sf).select(
        F.when(c != 0, F.col("transaction_id")).alias("TransactionID"),
        F.when(c == 1, F.lit("ghost")).when(c != 2, F.col("card_id").cast("string")).alias("card_id"),
        F.when(c == 3, F.lit(None)).when(c == 4, -F.col("amount")).when(c == 5, F.lit(1e9)).otherwise(F.col("amount")).alias("TransactionAmt"),
        F.when(c == 6, F.lit(None).cast("string")).when(c == 7, F.lit("INVALID_TS")).otherwise(F.col("us").cast("string")).alias("TransactionDT"),
        F.when(c != 8, F.col("merchant_id")).alias("ProductCD"), F.col("is_fraud").alias("isFraud"), F.col("is_fraud").alias("fraud_bool"))


QUERIES["q6_negative_cases"] = (
    lambda spark, sf: H.gate(H.lookup_profile(normalize_event(damaged(spark, sf)), prof(spark, sf)), PROFILE_FIELDS).select(
        "transaction_id", "card_id", "complete", "rejection_reason", F.array_join("missing_features", ",").alias("missing_features"),
        "product_code", "amount"),
    with_(EV) + """, d AS (SELECT *, transaction_id % 10 AS c FROM ev)
SELECT CASE WHEN c <> 0 THEN CAST(transaction_id AS VARCHAR) END AS transaction_id,
  CASE c WHEN 1 THEN 'CARD-ghost' WHEN 2 THEN 'CARD-UNKNOWN' ELSE 'CARD-' || card_id END AS card_id, c NOT IN (0, 1, 2, 3, 6) AS complete,
  CASE WHEN c IN (0, 3, 6) THEN 'MISSING_EVENT_FIELDS' WHEN c IN (1, 2) THEN 'UNKNOWN_CARD' END AS rejection_reason,
  CASE c WHEN 0 THEN 'transaction_id' WHEN 3 THEN 'amount' WHEN 6 THEN 'event_time' WHEN 1 THEN 'card1,card4,card6,addr1'
    WHEN 2 THEN 'card1,card4,card6,addr1' ELSE '' END AS missing_features, CASE WHEN c = 8 THEN 'W' ELSE merchant_id END AS product_code,
  CASE c WHEN 3 THEN NULL WHEN 4 THEN -amount WHEN 5 THEN 1e9 ELSE amount END AS amount FROM d""")
