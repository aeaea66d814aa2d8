"""Queries over drift, profiling and audits (R, D, Q)."""

from pyspark.sql import functions as F

from cardflow.operators import audit as Q
from cardflow.operators import clean as P
from cardflow.operators import drift as R
from cardflow.operators import profile as D
from cardflow.operators import sketches as S
from cardflow.plans.relational import STATS, STATS_SQL, TRAIN_END, VAL_END, rounded, split_tx
from cardflow.plans.sql import EV, LOG, MONEY, NULLS, SCORED2, TX, with_
from cardflow.session import stored
from cardflow.sources.views import ev, log, nulls, scored2, table, tx

QUERIES = {}

# ---- R: drift

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus", "ship_month"]
CUT = "1998-01-01"


def windows(spark, sf, unseen=False):
    """Reference and monitored rows; with ``unseen``, one month of the second window is unknown to the first."""
    rows = table(spark, sf, "lineitem").withColumn("ship_month", F.month("l_shipdate")).select(
        "l_shipdate", *NUMERIC, *CATEGORICAL)
    before = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    return rows.filter(before & (F.col("ship_month") != 12) if unseen else before), rows.filter(~before)


BASE = f"""li AS (SELECT *, month(l_shipdate) AS ship_month FROM lineitem),
ref AS (SELECT * FROM li WHERE l_shipdate < TIMESTAMP '{CUT}'),
mon AS (SELECT * FROM li WHERE l_shipdate >= TIMESTAMP '{CUT}')"""


UNSEEN = BASE.replace(f"TIMESTAMP '{CUT}'),", f"TIMESTAMP '{CUT}' AND ship_month <> 12),", 1)


def numeric_sql(clip: str, source: str) -> str:
    """Long rows with their bin, from the edges of ``ref``."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM {{t}}" for c in NUMERIC)
    edges = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, list_sort(list_distinct(quantile_cont({c}, [i / 10.0 FOR i IN range(11)]))) AS e FROM ref"""
        for c in NUMERIC)
    value = "v" if clip == "none" else "least(greatest(v, e[1]), e[len(e)])"
    return f"""ed AS (SELECT feature, e[2:len(e) - 1] AS e FROM ({edges})),
grid AS (SELECT feature, unnest(range(len(e) + 1)) AS bin, len(e) + 1 AS bins FROM ed),
rc AS (SELECT feature, len([x FOR x IN e IF x <= v]) AS bin, count(*) AS n FROM ({cells.format(t='ref')}) JOIN ed USING (feature) GROUP BY ALL),
rp AS (SELECT feature, bin, bins, (coalesce(n, 0) + 1e-6::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY feature) + 1e-6::DOUBLE * bins) AS prop
  FROM grid LEFT JOIN rc USING (feature, bin)),
mc AS (SELECT feature, len([x FOR x IN e IF x <= {value}]) AS bin, count(*) AS n FROM ({cells.format(t=source)}) JOIN ed USING (feature) GROUP BY ALL),
mp AS (SELECT feature, bin, (coalesce(n, 0) + 1e-6::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY feature) + 1e-6::DOUBLE * bins) AS now
  FROM grid LEFT JOIN mc USING (feature, bin)),
pn AS (SELECT feature, sum((now - prop) * ln(now / prop)) AS psi FROM rp JOIN mp USING (feature, bin) GROUP BY feature)"""


def categorical_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::VARCHAR AS cat FROM {{t}}" for c in CATEGORICAL)
    return f"""cr AS (SELECT feature, cat, count(*) / sum(count(*)) OVER (PARTITION BY feature)::DOUBLE AS share FROM ({cells.format(t='ref')}) GROUP BY feature, cat),
cm AS (SELECT feature, cat, count(*) AS n FROM ({cells.format(t='mon')}) GROUP BY ALL),
ck AS (SELECT feature, count(*) + 1 AS k FROM cr GROUP BY feature), ct AS (SELECT feature, sum(n)::DOUBLE AS total FROM cm GROUP BY feature),
cp AS (SELECT coalesce(cr.feature, cm.feature) AS feature, CASE WHEN share IS NULL THEN '__U' ELSE cr.cat END AS cat,
  sum(coalesce(n, 0))::DOUBLE AS n, max(share) AS share FROM cr FULL JOIN cm ON cr.feature = cm.feature AND cr.cat = cm.cat GROUP BY ALL),
cq AS (SELECT feature, (n + 1e-6::DOUBLE) / (total + 1e-6::DOUBLE * k) AS now, coalesce(share, 0) + 1e-6::DOUBLE / k AS prop FROM cp JOIN ck USING (feature) JOIN ct USING (feature)),
pc AS (SELECT feature, sum((now - prop) * ln(now / prop)) AS psi FROM cq GROUP BY feature)"""


def reference(spark, sf, numeric=True, categorical=True):
    return R.fit_psi(windows(spark, sf)[0], NUMERIC if numeric else [], CATEGORICAL if categorical else [])


QUERIES["r1_psi_reference"] = (
    lambda spark, sf: rounded(reference(spark, sf, categorical=False).numeric, ["prop"], 9).withColumn("bin", F.col("bin").cast("long")).withColumn(
        "bins", F.col("bins").cast("long")),
    with_(BASE, numeric_sql("none", "mon")) + "SELECT feature, bin, bins, round(prop, 9) AS prop FROM rp")
for clip in ("none", "inner"):
    QUERIES[f"r2_psi_numeric_{clip}"] = (
        lambda spark, sf, clip=clip: rounded(R.psi_numeric(reference(spark, sf, categorical=False), windows(spark, sf)[1], clip), ["psi"], 8),
        with_(BASE, numeric_sql(clip, "mon")) + "SELECT feature, round(psi, 8) AS psi FROM pn")
def by_year(spark, sf):
    """Stored sketches per year of shipping."""
    rows = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), *NUMERIC)
    return rows, stored(S.column_sketches(rows, NUMERIC, ["year"]))


def psi_from_sketches(spark, sf):
    """The reference window's edges from the merged sketches of its years."""
    ref, mon = windows(spark, sf)
    merged = S.merge_sketches(by_year(spark, sf)[1].filter(F.col("year") < int(CUT[:4])))
    return rounded(R.psi_numeric(R.fit_psi(ref, NUMERIC, [], sketches=merged), mon), ["psi"], 8)


def quantiles_by_year(spark, sf):
    """Exact quantiles of each year, and whether those read from the sketches alone are within four times their rank error."""
    points = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    rows, sketches = by_year(spark, sf)
    exact = S.exact_quantiles(rows, NUMERIC, points, sketches, ["year"])
    wide = {f"{n}_{side}": min(1.0, max(0.0, p + d)) for n, p in points.items() for side, d in (("lo", -4 * 0.0013), ("hi", 4 * 0.0013))}
    near = S.sketched_quantiles(sketches, {**points, **wide}, ["year"])
    close = F.lit(True)
    for n in points:
        close = close & F.col(n).between(F.col(f"{n}_lo"), F.col(f"{n}_hi"))
    near = near.select("year", "feature", "n", *[F.col(f"{n}_{s}") for n in points for s in ("lo", "hi")])
    both = exact.join(near, ["year", "feature"])
    return rounded(both.select(F.col("year").cast("long").alias("year"), "feature", "n", *points, close.alias("near")), list(points), 6)


YEAR_CELLS = " UNION ALL ".join(f"SELECT year(l_shipdate) AS year, '{c}' AS feature, {c}::DOUBLE AS v FROM lineitem" for c in NUMERIC)
QUERIES["r2_psi_from_sketches"] = (psi_from_sketches, with_(BASE, numeric_sql("none", "mon")) + "SELECT feature, round(psi, 8) AS psi FROM pn")
QUERIES["a7_sketched_quantiles"] = (
    quantiles_by_year,
    f"""SELECT year, feature, count(v) AS n, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95,
  TRUE AS near FROM ({YEAR_CELLS}) GROUP BY year, feature""")
QUERIES["r3_psi_categorical"] = (
    lambda spark, sf: rounded(R.psi_categorical(reference(spark, sf, numeric=False), windows(spark, sf)[1]), ["psi"], 8),
    with_(BASE, categorical_sql()) + "SELECT feature, round(psi, 8) AS psi FROM pc")
QUERIES["r3_psi_unseen_category"] = (
    lambda spark, sf: rounded(R.psi_categorical(R.fit_psi(windows(spark, sf, unseen=True)[0], [], CATEGORICAL), windows(spark, sf)[1]), ["psi"], 8),
    with_(UNSEEN, categorical_sql()) + "SELECT feature, round(psi, 8) AS psi FROM pc")


def trigger(spark, sf):
    mon = windows(spark, sf)[1]
    return R.drift_trigger(R.psi(reference(spark, sf), mon, "inner"), mon.count(), features=3, min_rows=1)


ALL_PSI = "pa AS (SELECT * FROM pn UNION ALL SELECT * FROM pc)"
QUERIES["r4_drift_trigger"] = (
    trigger,
    with_(BASE, numeric_sql("inner", "mon"), categorical_sql(), ALL_PSI) + """SELECT count(*) AS features,
  count(*) FILTER (psi >= 0.1) AS shifted, count(*) FILTER (psi >= 0.1) >= 3 AS triggered, (SELECT count(*) FROM mon) AS rows FROM pa""")


def saved_reference(spark, sf):
    import os
    import uuid

    from cardflow.session import checkpoint_dir

    path = os.path.join(checkpoint_dir(spark), f"psi-reference-{uuid.uuid4().hex}")
    R.save_reference(reference(spark, sf), path)
    return rounded(R.psi(R.load_reference(spark, path), windows(spark, sf)[1]), ["psi"], 8)


PSI_BOTH = with_(BASE, numeric_sql("none", "mon"), categorical_sql(), ALL_PSI) + "SELECT feature, round(psi, 8) AS psi FROM pa"
QUERIES["r5_saved_reference"] = (saved_reference, PSI_BOTH)
QUERIES["k3_top_drift"] = (
    lambda spark, sf: rounded(R.top_drift(R.psi(reference(spark, sf), windows(spark, sf)[1]), 3), ["psi"], 8),
    PSI_BOTH + " ORDER BY pa.psi DESC, feature LIMIT 3")

KS_SQL = ", ".join(["x AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v, {i} AS now FROM {t}" for c in NUMERIC for i, t in enumerate(("ref", "mon"))) + ")",
    """u AS (SELECT feature, v, count(*) FILTER (now = 0) AS a, count(*) FILTER (now = 1) AS b FROM x GROUP BY ALL),
c AS (SELECT feature, sum(a) OVER w / sum(a) OVER (PARTITION BY feature)::DOUBLE AS fa,
  sum(b) OVER w / sum(b) OVER (PARTITION BY feature)::DOUBLE AS fb FROM u WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING))"""])
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"r7_ks_stat{suffix}"] = (
        lambda spark, sf, split=split: rounded(R.ks_stat(*windows(spark, sf), NUMERIC, split), ["ks"], 9),
        with_(BASE, KS_SQL) + "SELECT feature, round(max(abs(fa - fb)), 9) AS ks FROM c GROUP BY feature")

QUERIES["r8_drift_windows"] = (
    lambda spark, sf: rounded(R.drift_windows(tx(spark, sf), "dt", "is_fraud", "amount", "card_id"),
                              ["fraud_rate", "mean_amount"], 6),
    with_(TX) + f""", s AS (SELECT min(dt) AS lo, (max(dt) - min(dt)) / 6.0::DOUBLE AS w FROM tx)
SELECT i + 1 AS window, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows, round(avg(is_fraud), 6) AS fraud_rate,
  round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE) / count(*), 6) AS mean_amount, count(DISTINCT card_id) AS unique_cards
FROM tx, s, range(6) r(i) WHERE dt >= lo + i * w AND (dt < lo + (i + 1) * w OR i = 5) GROUP BY i""")

QUERIES["r9_period_audit"] = (
    lambda spark, sf: rounded(R.period_audit(
        nulls(spark, sf).withColumn("day", F.to_date("event_time").cast("string")), "day", "is_fraud",
        ["amount", "merchant_id", "country"]).withColumn("fraud_rows", F.col("fraud_rows")),
        ["fraud_rate", "mean_missing"], 9),
    with_(NULLS) + """SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS period, count(*) AS rows,
  CAST(sum(CAST(is_fraud AS INTEGER)) AS BIGINT) AS fraud_rows, round(avg(CAST(is_fraud AS INTEGER)), 9) AS fraud_rate,
  round(sum(CAST(amount IS NULL AS INTEGER) + CAST(merchant_id IS NULL AS INTEGER)) / (count(*) * 3)::DOUBLE, 9) AS mean_missing
FROM nulls GROUP BY 1""")

# ---- D: profiling

CHECKS_SQL = """, f AS (SELECT count(*) AS n, count({k}) - count(DISTINCT {k}) AS dup, count(*) FILTER ({y} IS NULL) AS yn,
  count(*) FILTER ({y} NOT IN (0, 1)) AS yo, sum({y}) AS p, min({t}) AS lo, max({t}) AS hi, min({a}) AS amin, max({a}) AS amax,
  CAST(sum(CAST({a} AS {m})) AS DOUBLE) / count({a}) AS amean FROM {v})
SELECT r.check, round(CAST(r.value AS DOUBLE), 6) AS value, CASE WHEN r.ok THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT unnest([
  {{'check': 'rows', 'value': n::DOUBLE, 'ok': n > 0}}, {{'check': 'duplicate_ids', 'value': dup::DOUBLE, 'ok': dup = 0}},
  {{'check': 'label_nulls', 'value': yn::DOUBLE, 'ok': yn = 0}}, {{'check': 'label_outside_0_1', 'value': yo::DOUBLE, 'ok': yo = 0}},
  {{'check': 'both_classes', 'value': p::DOUBLE, 'ok': p > 0 AND n > p}}, {{'check': 'positive_pct', 'value': p * 100.0::DOUBLE / n, 'ok': true}},
  {{'check': 'negatives_per_positive', 'value': (n - p) / p::DOUBLE, 'ok': true}},
  {{'check': 'span_days', 'value': (hi - lo) / 86400.0::DOUBLE, 'ok': hi > lo}}, {{'check': 'amount_min', 'value': amin, 'ok': amin >= 0}},
  {{'check': 'amount_max', 'value': amax, 'ok': true}}, {{'check': 'amount_mean', 'value': amean, 'ok': true}}]) AS r FROM f)"""
QUERIES["d1_validate_table"] = (
    lambda spark, sf: rounded(D.validate_table(tx(spark, sf), "transaction_id", "dt", "is_fraud", "amount"), ["value"]),
    with_(TX) + CHECKS_SQL.format(k="transaction_id", y="is_fraud", t="dt", a="amount", v="tx", m=MONEY))
QUERIES["d1_validate_duplicates"] = (
    lambda spark, sf: rounded(D.validate_table(table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("a")), "id", "t", "y", "a"), ["value"]),
    """WITH li AS (SELECT l_orderkey AS id, CAST(epoch(l_shipdate) AS BIGINT) AS t, CAST(l_returnflag = 'R' AS INTEGER) AS y,
  l_quantity AS a FROM lineitem)""" + CHECKS_SQL.format(k="id", y="y", t="t", a="a", v="li", m=MONEY))

QUERIES["d2_class_balance"] = (
    lambda spark, sf: rounded(D.class_balance(tx(spark, sf), "is_fraud", "amount"), ["mean_amount", "std_amount"], 5),
    with_(TX) + f"""SELECT coalesce(CAST(is_fraud AS VARCHAR), 'total') AS class, count(*) AS rows,
  round(CAST(sum(CAST(amount AS {MONEY})) AS DOUBLE) / count(*), 5) AS mean_amount, min(amount) AS min_amount, max(amount) AS max_amount,
  round(stddev_samp(amount), 5) AS std_amount FROM tx GROUP BY ROLLUP (is_fraud)""")

WIDE = ["transaction_id", "card_id", "merchant_id", "amount", "country"]
MISS_SQL = ", m AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM nulls"""
    for c in WIDE) + """) SELECT *, CASE WHEN missing_pct = 0 THEN '0' WHEN missing_pct <= 20 THEN '0-20' WHEN missing_pct <= 80 THEN '20-80' ELSE '>80' END AS band FROM m"""
QUERIES["d3_missingness"] = (
    lambda spark, sf: rounded(D.missingness(nulls(spark, sf), WIDE), ["missing_pct"]), with_(NULLS) + MISS_SQL)
QUERIES["k4_missing_ranking"] = (
    lambda spark, sf: rounded(D.missing_ranking(nulls(spark, sf), WIDE), ["missing_pct"]),
    with_(NULLS) + MISS_SQL + ' ORDER BY m.missing_pct DESC, "column"')
QUERIES["d4_missing_signal"] = (
    lambda spark, sf: rounded(D.missing_signal(nulls(spark, sf), ["amount", "merchant_id", "country"], "is_fraud"),
                              ["missing_pct", "rate_present", "rate_missing"]),
    with_(NULLS) + ", s AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", avg(CAST({c} IS NULL AS INTEGER)) * 100 AS mp,
  avg(CAST(is_fraud AS INTEGER)) FILTER ({c} IS NOT NULL) AS rp, avg(CAST(is_fraud AS INTEGER)) FILTER ({c} IS NULL) AS rm FROM nulls"""
                                                   for c in ("amount", "merchant_id", "country")) + """)
SELECT "column", round(mp, 6) AS missing_pct, round(rp, 6) AS rate_present, round(rm, 6) AS rate_missing,
  CASE WHEN abs(rp - rm) > 0.01 THEN 'YES' ELSE 'WEAK' END AS signal FROM s""")

PROFILE = {"card_id": ("bigint", "B_CARD"), "merchant_id": ("string", "Z_OTHER"), "country": ("string", "Z_OTHER"),
           "k": ("int", "Z_OTHER")}
QUERIES["d5_column_profile"] = (
    lambda spark, sf: rounded(D.column_profile(nulls(spark, sf), list(PROFILE)), ["missing_pct"]),
    with_(NULLS) + " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS type, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6)
  AS missing_pct, count(DISTINCT {c}) AS distinct_values, array_to_string(list_sort(list_distinct(list(CAST({c} AS VARCHAR)) FILTER ({c} IS NOT NULL)))[1:3], '|') AS examples,
  '{f}' AS family FROM nulls""" for c, (t, f) in PROFILE.items()))

ENTITY = ["mean_rows", "pct_single", "pct_2plus", "pct_5plus", "pct_10plus", "pct_20plus", "median_rows", "p90_rows", "p95_rows", "p99_rows"]
for name, keys in (("card", ["card_id"]), ("card_product", ["card_id", "product_cd"])):
    QUERIES[f"d6_entity_stats_{name}"] = (
        lambda spark, sf, keys=keys: rounded(D.entity_stats(tx(spark, sf), keys, "is_fraud"), ENTITY),
        with_(TX) + f""", e AS (SELECT count(*) AS n, max(is_fraud) AS hit FROM tx GROUP BY {', '.join(keys)}),
f AS (SELECT count(*) AS entities, CAST(sum(n) AS BIGINT) AS rows, round(avg(n), 6) AS mean_rows, max(n) AS max_rows,
  round(avg(CAST(n = 1 AS INTEGER)) * 100, 6) AS pct_single, round(avg(CAST(n >= 2 AS INTEGER)) * 100, 6) AS pct_2plus,
  round(avg(CAST(n >= 5 AS INTEGER)) * 100, 6) AS pct_5plus, round(avg(CAST(n >= 10 AS INTEGER)) * 100, 6) AS pct_10plus,
  round(avg(CAST(n >= 20 AS INTEGER)) * 100, 6) AS pct_20plus, CAST(sum(hit) AS BIGINT) AS fraud_entities,
  round(quantile_cont(n, 0.5), 6) AS median_rows, round(quantile_cont(n, 0.9), 6) AS p90_rows,
  round(quantile_cont(n, 0.95), 6) AS p95_rows, round(quantile_cont(n, 0.99), 6) AS p99_rows FROM e)
SELECT *, CASE WHEN pct_5plus > 30 AND median_rows >= 3 THEN 'EXCELLENT' WHEN pct_5plus > 15 AND median_rows >= 2 THEN 'GOOD'
  WHEN pct_2plus > 10 THEN 'WEAK' ELSE 'POOR' END AS grade, '{"+".join(keys)}' AS entity FROM f""")

QUERIES["d7_sequence_viability"] = (
    lambda spark, sf: D.sequence_viability(tx(spark, sf), "card_id", "is_fraud"),
    with_(TX) + """, e AS (SELECT count(*) AS n, max(is_fraud) AS hit FROM tx GROUP BY card_id),
s AS (SELECT CAST(k AS INTEGER) AS min_length, count(*) FILTER (n >= k) AS entities, CAST(sum(greatest(n - (k - 1), 0)) AS BIGINT) AS windows,
  count(*) FILTER (n >= k AND hit = 1) AS fraud_entities, CAST(sum(CASE WHEN hit = 1 THEN greatest(n - (k - 1), 0) ELSE 0 END) AS BIGINT) AS fraud_windows
  FROM e, (VALUES (2), (3), (5), (10), (20), (50)) v(k) GROUP BY k)
SELECT *, CASE WHEN fraud_windows > 5000 THEN 'YES' WHEN fraud_windows > 1000 THEN 'MARGINAL' ELSE 'NO' END AS viable FROM s""")

QUERIES["d8_time_histogram"] = (
    lambda spark, sf: D.time_histogram(ev(spark, sf), "us", "is_fraud"),
    with_(EV) + """, s AS (SELECT min(us) AS lo, (max(us) - min(us)) / 50.0::DOUBLE AS w FROM ev)
SELECT CAST(least(floor((us - lo) / w), 49) AS BIGINT) AS bin, count(*) FILTER (is_fraud) AS fraud_rows,
  count(*) FILTER (NOT is_fraud) AS other_rows FROM ev, s GROUP BY 1""")

QUERIES["d9_class_means"] = (
    lambda spark, sf: rounded(D.class_means(ev(spark, sf), ["amount", "k", "card_id"], "is_fraud"), ["mean_0", "mean_1"]),
    with_(EV) + " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg({c}) FILTER (NOT is_fraud), 6) AS mean_0,
  round(avg({c}) FILTER (is_fraud), 6) AS mean_1 FROM ev""" for c in ("amount", "k", "card_id")))

QUERIES["d10_time_span"] = (
    lambda spark, sf: rounded(D.time_span(tx(spark, sf), "dt"), ["days", "months", "rows_per_day"]),
    with_(TX) + """, s AS (SELECT min(dt) AS t_min, max(dt) AS t_max, (max(dt) - min(dt)) / 86400.0::DOUBLE AS d, count(*) AS n FROM tx)
SELECT t_min, t_max, round(d, 6) AS days, round(d / 30, 6) AS months, round(n / d, 6) AS rows_per_day FROM s""")

QUERIES["d11_rate_by"] = (
    lambda spark, sf: rounded(D.rate_by(tx(spark, sf), "product_cd", "is_fraud"), ["fraud_rate"], 9),
    with_(TX) + """SELECT product_cd, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows, round(avg(is_fraud), 9) AS fraud_rate
FROM tx GROUP BY product_cd""")


def books(spark, sf):
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(line.cast("decimal(28,6)")).cast("double").alias("booked"))
    orders = table(spark, sf, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


for name, tolerance in (("cent", 0.01), ("wide", 200000.0)):
    QUERIES[f"d12_reconcile_{name}"] = (
        lambda spark, sf, tolerance=tolerance: rounded(D.reconcile(
            books(spark, sf), F.col("o_totalprice") - F.coalesce("booked", F.lit(0.0)), tolerance), ["mismatch_rate"], 9),
        f"""WITH b AS (SELECT o_totalprice - coalesce(s, 0) AS d FROM orders LEFT JOIN (SELECT l_orderkey,
  CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS {MONEY})) AS DOUBLE) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
SELECT count(*) AS rows, count(*) FILTER (abs(d) > {tolerance}) AS mismatches,
  round(avg(CAST(abs(d) > {tolerance} AS INTEGER)), 9) AS mismatch_rate FROM b""")

CONST = ["l_returnflag", "l_linestatus", "l_linenumber", "one"]
QUERIES["d13_constant_columns"] = (
    lambda spark, sf: D.constant_columns(table(spark, sf, "lineitem").withColumn("one", F.lit(1)), CONST),
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, CASE WHEN count(DISTINCT {c}) <= 1 THEN 'CONSTANT'
  WHEN count(DISTINCT {c}) <= 5 THEN 'NEAR_CONSTANT' ELSE 'VARIED' END AS kind FROM (SELECT *, 1 AS one FROM lineitem)""" for c in CONST))
QUERIES["d13_duplicate_rows"] = (
    lambda spark, sf: D.duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")),
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")

QUERIES["d13_duplicate_whole_rows"] = (
    lambda spark, sf: D.duplicate_rows(table(spark, sf, "lineitem").unionByName(table(spark, sf, "lineitem").filter("l_orderkey % 7 = 0"))),
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0) GROUP BY ALL)""".replace("count(*) AS n", "COLUMNS(*), count(*) AS n"))

TABLES = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3,
          "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}
QUERIES["d14_inventory"] = (
    lambda spark, sf: D.inventory(spark, {t: table(spark, sf, t) for t in TABLES}),
    " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS rows, CAST({n} AS INTEGER) AS columns FROM {t}"""
                       for t, n in TABLES.items()))
QUERIES["d15_value_counts"] = (
    lambda spark, sf: D.value_counts(nulls(spark, sf), ["merchant_id", "country"]),
    with_(NULLS) + """SELECT 'merchant_id' AS "column", merchant_id AS value, count(*) AS rows FROM nulls GROUP BY merchant_id
UNION ALL SELECT 'country', country, count(*) FROM nulls GROUP BY country""")
QUERIES["d15_describe"] = (
    lambda spark, sf: rounded(D.describe(nulls(spark, sf), ["amount", "k"]), ["mean", "std", "min", "max", "p25", "p50", "p75"]),
    with_(NULLS) + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25,
  round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75 FROM nulls""" for c in ("amount", "k")))

# ---- Q: audits

for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"q1_audit_offsets{suffix}"] = (
        lambda spark, sf, split=split: Q.audit_offsets(
            # A gap after every 50th record and a repeated offset after every 333rd.
            log(spark, sf).withColumn("offset", F.floor(F.col("offset") / 50) + F.when(
                F.col("offset") % 333 == 5, F.col("offset") - 1).otherwise(F.col("offset"))),
            arrival=["transaction_id"], split=split),
        with_(LOG) + """, g AS (SELECT partition, transaction_id, "offset" // 50 + CASE WHEN "offset" % 333 = 5 THEN "offset" - 1 ELSE "offset" END AS o
  FROM log), s AS (SELECT partition, o, o - lag(o) OVER (PARTITION BY partition ORDER BY transaction_id) AS d FROM g)
SELECT partition, count(*) AS rows, min(o) AS first_offset, max(o) AS last_offset, count(*) FILTER (d <= 0) AS not_rising,
  count(*) FILTER (d > 1) AS gaps FROM s GROUP BY partition""")
QUERIES["q2_audit_affinity"] = (
    lambda spark, sf: Q.audit_affinity(log(spark, sf).withColumn("partition", F.when(
        F.col("transaction_id") % 997 == 0, 0).otherwise(F.col("partition"))), "card_id"),
    with_(LOG) + """, k AS (SELECT card_id, count(DISTINCT CASE WHEN transaction_id % 997 = 0 THEN 0 ELSE partition END) AS n FROM log GROUP BY card_id)
SELECT count(*) AS keys, count(*) FILTER (n > 1) AS keys_in_several_partitions FROM k""")
QUERIES["q3_audit_order"] = (
    lambda spark, sf: Q.audit_order(log(spark, sf).withColumn("seq", F.when(
        F.col("transaction_id") % 101 == 0, F.col("transaction_id") - 5000).otherwise(F.col("transaction_id"))), "card_id", "seq"),
    with_(LOG) + """, s AS (SELECT card_id, "offset", CASE WHEN transaction_id % 101 = 0 THEN transaction_id - 5000 ELSE transaction_id END AS q FROM log),
d AS (SELECT q - lag(q) OVER (PARTITION BY card_id ORDER BY "offset") AS d FROM s)
SELECT count(*) AS rows, count(*) FILTER (d <= 0) AS out_of_order FROM d""")
QUERIES["q4_audit_delivery"] = (
    lambda spark, sf: Q.audit_delivery(
        ev(spark, sf).filter("k <> 3"), ev(spark, sf).filter("k <> 7").unionByName(ev(spark, sf).filter("k = 9")),
        "transaction_id"),
    with_(EV) + """SELECT count(*) FILTER (k <> 3) AS sent_ids, count(*) FILTER (k <> 7) AS received_ids, count(*) FILTER (k = 7) AS lost,
  count(*) FILTER (k = 9) AS duplicates, count(*) FILTER (k = 3) AS unexpected FROM ev""")
QUERIES["q5_audit_repeatable"] = (
    lambda spark, sf: rounded(Q.audit_repeatable(
        scored2(spark, sf).select("id", "p_a"), scored2(spark, sf).select("id", (F.col("p_a") + F.when(
            F.col("id") % 50 == 0, 0.001).otherwise(0.0)).alias("p_a")), "id", "p_a"), ["max_diff"]),
    with_(SCORED2) + """, d AS (SELECT p_a, p_a + CASE WHEN id % 50 = 0 THEN 0.001 ELSE 0.0 END AS q FROM scored2)
SELECT count(*) AS rows, count(*) FILTER ((p_a >= 0.5) = (q >= 0.5)) AS decisions_equal, count(*) FILTER (abs(p_a - q) <= 1e-12) AS within_tolerance,
  round(max(abs(p_a - q)), 6) AS max_diff, count(*) = count(*) FILTER (abs(p_a - q) <= 1e-12) AS repeatable FROM d""")
QUERIES["q7_integrity"] = (
    lambda spark, sf: Q.integrity(split_tx(spark, sf), "transaction_id", "dt", ["amount", "product_cd", "dt"], "is_fraud"),
    with_(TX) + f""", s AS (SELECT *, CASE WHEN dt <= {TRAIN_END} THEN 0 WHEN dt <= {VAL_END} THEN 1 ELSE 2 END AS g FROM tx),
i AS (SELECT transaction_id, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b, count(*) FILTER (g = 2) AS c FROM s GROUP BY 1),
j AS (SELECT count(*) FILTER (a > 1) AS da, count(*) FILTER (b > 1) AS db, count(*) FILTER (c > 1) AS dc, count(*) FILTER (a > 0 AND b > 0) AS ab,
  count(*) FILTER (a > 0 AND c > 0) AS ac, count(*) FILTER (b > 0 AND c > 0) AS bc FROM i),
m AS (SELECT max(dt) FILTER (g = 0) < min(dt) FILTER (g = 1) AS o1, max(dt) FILTER (g = 1) < min(dt) FILTER (g = 2) AS o2,
  count(*) FILTER (is_fraud IS NULL) = 0 AS lc, count(DISTINCT g) = 3 AS fi FROM s)
SELECT r.c AS "check", r.p AS passed FROM (SELECT unnest([{{'c': 'no_duplicate_ids_train', 'p': da = 0}}, {{'c': 'no_duplicate_ids_val', 'p': db = 0}},
  {{'c': 'no_duplicate_ids_test', 'p': dc = 0}}, {{'c': 'no_overlap_train_val', 'p': ab = 0}}, {{'c': 'no_overlap_train_test', 'p': ac = 0}},
  {{'c': 'no_overlap_val_test', 'p': bc = 0}}, {{'c': 'train_before_val', 'p': o1}}, {{'c': 'val_before_test', 'p': o2}},
  {{'c': 'label_not_a_feature', 'p': true}}, {{'c': 'id_not_a_feature', 'p': true}}, {{'c': 'time_not_a_feature', 'p': false}},
  {{'c': 'labels_complete', 'p': lc}}, {{'c': 'every_split_filled', 'p': fi}}, {{'c': 'split_rows_add_up', 'p': true}}]) AS r FROM j, m)""")
QUERIES["q8_ingest_latency"] = (
    lambda spark, sf: rounded(Q.ingest_latency(ev(spark, sf).select(
        "us", (F.col("us") + F.col("k") * 1000 - 5000).alias("received"), "country"), "received", "us", ["country"]), STATS),
    with_(EV) + f""", l AS (SELECT country, CAST(k * 1000 - 5000 AS DOUBLE) AS x FROM ev WHERE k * 1000 - 5000 >= 0)
SELECT country, {STATS_SQL.format(v='x')} FROM l GROUP BY country""")
QUERIES["q9_label_tier"] = (
    lambda spark, sf: P.assert_no_labels(P.drop_labels(ev(spark, sf).select("transaction_id", "amount", "is_fraud"))),
    with_(EV) + "SELECT transaction_id, amount FROM ev")
