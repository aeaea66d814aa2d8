"""Queries over score metrics."""

from pyspark.sql import functions as F

from cardflow.operators import bootstrap as B
from cardflow.operators import metrics as M
from cardflow.plans.sql import SCORED, SCORED2, with_
from cardflow.sources.views import scored, scored2

QUERIES = {}
THRESHOLD = 0.5

CURVE = """g AS (SELECT {p} AS score, count(*) FILTER ({y} = 1) AS pos, count(*) FILTER ({y} = 0) AS neg FROM {t} GROUP BY 1),
c AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  row_number() OVER w AS k, CAST(sum(pos) OVER () AS BIGINT) AS p_all, CAST(sum(neg) OVER () AS BIGINT) AS n_all,
  count(*) OVER () AS k_all FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
C1 = with_(SCORED, CURVE.format(p="p", y="y", t="scored"))
C2 = with_(SCORED2, CURVE.format(p="p_a", y="y", t="scored2"))
AP = "sum(pos / p_all::DOUBLE * tp / (tp + fp))"
AUC = "sum(neg * (tp - pos / 2.0::DOUBLE)) / max(p_all::DOUBLE * n_all)"


def rounded(df, digits=9, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


QUERIES["m0_curve"] = (lambda spark, sf: M.curve(scored(spark, sf), "y", "p"), C1 + "SELECT * FROM c")
for suffix, split in (("", None), ("_split", True)):
    QUERIES[f"m0_curve_distinct{suffix}"] = (
        lambda spark, sf, split=split: rounded(M.curve(scored2(spark, sf), "y", "p_a", split=split)),
        C2 + "SELECT * REPLACE (round(score, 9) AS score) FROM c")

RATES_SQL = """{f}(tp / nullif(tp + fp, 0)::DOUBLE) AS precision, {f}(tp / nullif(tp + fn, 0)::DOUBLE) AS recall,
  {f}(2.0 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE) AS f1,
  {f}((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0)) AS mcc,
  {f}((coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2) AS balanced_accuracy,
  {f}(fp / nullif(fp + tn, 0)::DOUBLE) AS fpr, {f}(fn / nullif(fn + tp, 0)::DOUBLE) AS fnr"""


def rates_sql():
    import re
    return re.sub(r"\{f\}(\(.*\)) AS (\w+)", r"round(coalesce(\1, 0), 9) AS \2", RATES_SQL.replace(", {f}", ",\n {f}"))


def confusion_cte(view, y, p, t):
    return f"""x AS (SELECT count(*) FILTER ({y} = 1 AND {p} >= {t}) AS tp, count(*) FILTER ({y} = 0 AND {p} >= {t}) AS fp,
  count(*) FILTER ({y} = 1 AND {p} < {t}) AS fn, count(*) FILTER ({y} = 0 AND {p} < {t}) AS tn FROM {view})"""


for label, threshold in (("", THRESHOLD), ("_nothing_above", 2.0)):
    QUERIES[f"m1_confusion{label}"] = (
        lambda spark, sf, threshold=threshold: rounded(M.confusion(scored(spark, sf), "y", "p", threshold)),
        with_(SCORED, confusion_cte("scored", "y", "p", threshold)) + f"SELECT tp, fp, fn, tn, {rates_sql()} FROM x")

QUERIES["m2_average_precision"] = (
    lambda spark, sf: rounded(M.average_precision(M.curve(scored(spark, sf), "y", "p"))),
    C1 + f"SELECT round({AP}, 9) AS average_precision FROM c")
QUERIES["m3_roc_auc"] = (
    lambda spark, sf: rounded(M.roc_auc(M.curve(scored(spark, sf), "y", "p"))),
    C1 + f"SELECT round({AUC}, 9) AS roc_auc FROM c")
QUERIES["m3_roc_auc_pairs"] = (
    lambda spark, sf: rounded(M.roc_auc(M.curve(scored2(spark, sf), "y", "p_a"))),
    # By definition: the share of (positive, negative) pairs in the right order.
    with_(SCORED2) + """SELECT round(avg(CASE WHEN a.p_a > b.p_a THEN 1.0 WHEN a.p_a = b.p_a THEN 0.5 ELSE 0.0 END), 9) AS roc_auc
FROM scored2 a JOIN scored2 b ON a.y = 1 AND b.y = 0""")

SCORES = {"f1": "2.0 * tp / (2 * tp + fp + p_all - tp)::DOUBLE", "precision": "tp / (tp + fp)::DOUBLE",
          "recall": "tp / p_all::DOUBLE"}
for metric, formula in SCORES.items():
    QUERIES[f"m4_threshold_{metric}"] = (
        lambda spark, sf, metric=metric: rounded(M.select_threshold(M.curve(scored2(spark, sf), "y", "p_a"), metric)),
        C2 + f"""SELECT round(score, 9) AS threshold, round(v, 9) AS value FROM (SELECT score, {formula} AS v FROM c)
ORDER BY v DESC, score LIMIT 1""")
for grid in (1000, 50):
    QUERIES[f"m4b_threshold_balanced_{grid}"] = (
        lambda spark, sf, grid=grid: rounded(M.select_threshold(
            M.curve(scored2(spark, sf), "y", "p_a"), "balanced_accuracy", grid)),
        C2 + f""", r AS (SELECT score, k_all - k AS rank, k_all - 1 AS last, least({grid}, k_all) - 1 AS steps,
  (tp / p_all::DOUBLE + (n_all - fp) / n_all::DOUBLE) / 2 AS v FROM c),
i AS (SELECT (g.i * last) // greatest(steps, 1) AS rank FROM (SELECT max(last) AS last, max(steps) AS steps FROM r) m,
  range({grid}) g(i) WHERE g.i <= steps)
SELECT round(score, 9) AS threshold, round(v, 9) AS value FROM r WHERE rank IN (SELECT rank FROM i) ORDER BY v DESC, score LIMIT 1""")

QUERIES["m4b_threshold_balanced"] = (
    lambda spark, sf: rounded(M.select_threshold(M.curve(scored2(spark, sf), "y", "p_a"), "balanced_accuracy")),
    C2 + """SELECT round(score, 9) AS threshold, round(v, 9) AS value FROM (SELECT score, (tp / p_all::DOUBLE + (n_all - fp) / n_all::DOUBLE) / 2 AS v FROM c)
ORDER BY v DESC, score LIMIT 1""")

SWEEP_SQL = """, t AS (SELECT i, 0.01::DOUBLE + i * ((0.99::DOUBLE - 0.01::DOUBLE) / 199) AS threshold FROM range(200) r(i)),
s AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp,
  count(*) FILTER (y = 1 AND p < threshold) AS fn FROM t, scored GROUP BY threshold),
q AS (SELECT threshold, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM s)
SELECT round(threshold, 9) AS threshold, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM q"""
QUERIES["m5_sweep"] = (lambda spark, sf: rounded(M.sweep(scored(spark, sf), "y", "p")), with_(SCORED) + SWEEP_SQL)
QUERIES["m5_best_of_sweep"] = (
    lambda spark, sf: rounded(M.best_of_sweep(M.sweep(scored(spark, sf), "y", "p"))),
    with_(SCORED) + SWEEP_SQL + " ORDER BY q.f1 DESC, q.threshold LIMIT 1")

QUERIES["m6_precision_at_k"] = (
    lambda spark, sf: rounded(M.precision_at_k(scored2(spark, sf), "y", "p_a", ["id"])),
    with_(SCORED2) + """, r AS (SELECT y, row_number() OVER (ORDER BY p_a DESC, id) AS rank, count(*) OVER () AS n FROM scored2)
SELECT CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN rank <= k THEN y ELSE 0 END) AS BIGINT) AS hits,
  round(sum(CASE WHEN rank <= k THEN y ELSE 0 END) / least(k, max(n))::DOUBLE, 9) AS precision
FROM r, (VALUES (100), (500), (1000), (5000)) ks(k) GROUP BY k""")

QUERIES["m7_recall_at_fpr"] = (
    lambda spark, sf: rounded(M.recall_at_fpr(M.curve(scored2(spark, sf), "y", "p_a"), (0.001, 0.01, 0.1, 0.25))),
    C2 + """SELECT CAST(a AS DOUBLE) AS alpha, round(coalesce(max(CASE WHEN fp / n_all::DOUBLE <= CAST(a AS DOUBLE)
  THEN tp / p_all::DOUBLE END), 0), 9) AS recall FROM c, (VALUES (0.001), (0.01), (0.1), (0.25)) v(a) GROUP BY a""")

QUERIES["m8_brier"] = (
    lambda spark, sf: rounded(M.brier(scored(spark, sf), "y", "p")),
    with_(SCORED) + "SELECT round(avg((p - y) * (p - y)), 9) AS brier, round(avg(y) * (1 - avg(y)), 9) AS naive_brier FROM scored")

CAL_SQL = """, b AS (SELECT i AS bin, p, y FROM scored JOIN range(10) r(i)
  ON p >= i * 0.1::DOUBLE AND (p < (i + 1) * 0.1::DOUBLE OR (i = 9 AND p <= 1)))"""
QUERIES["m9_calibration"] = (
    lambda spark, sf: rounded(M.calibration(scored(spark, sf), "y", "p")),
    with_(SCORED) + CAL_SQL + """ SELECT bin, count(*) AS n, round(avg(p), 9) AS mean_score, round(avg(y), 9) AS positive_rate
FROM b GROUP BY bin""")
QUERIES["m9_ece"] = (
    lambda spark, sf: rounded(M.expected_calibration_error(M.calibration(scored(spark, sf), "y", "p"))),
    with_(SCORED) + CAL_SQL + """, t AS (SELECT count(*) AS n, avg(p) AS m, avg(y) AS f FROM b GROUP BY bin)
SELECT round(sum(n * abs(m - f)) / sum(n), 9) AS ece FROM t""")

def headline_sql(view, p, y, t, tag):
    return (CURVE.format(p=p, y=y, t=view).replace("g AS", f"g{tag} AS").replace("FROM g ", f"FROM g{tag} ")
            .replace("\nc AS", f"\nc{tag} AS") + ", " + confusion_cte(view, y, p, t).replace("x AS", f"x{tag} AS")
            + f""", h{tag} AS (SELECT (SELECT round({AP}, 9) FROM c{tag}) AS average_precision,
  (SELECT round({AUC}, 9) FROM c{tag}) AS roc_auc, (SELECT round(avg(({p} - {y}) * ({p} - {y})), 9) FROM {view}) AS brier,
  {rates_sql()}, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn FROM x{tag}),
l{tag} AS (UNPIVOT h{tag} ON COLUMNS(*) INTO NAME metric VALUE value)""")



# The deviation of a ratio of counts, each of which a resample draws around its value: the width an interval must have.
DEVIATIONS = {"precision": "sqrt(tp * fp / power(tp + fp, 3))", "recall": "sqrt(tp * fn / power(tp + fn, 3))",
              "f1": "2 * sqrt(tp * (fp + fn) * (tp + fp + fn)) / power(2 * tp + fp + fn, 2)"}


def against(intervals, points):
    """Each metric of a bootstrap with its value and the deviation expected of it (where there is a formula), and whether the interval fits them: the mean is within a deviation
    of the value, the deviation within a quarter of the expected one, and the interval as wide as one of 95 % is for such a deviation."""
    spark = intervals.sparkSession
    side = spark.createDataFrame([(k, float(v), d) for k, (v, d) in points.items()], "metric string, point double, deviation double")
    width = (F.col("ci_upper") - F.col("ci_lower")) / F.col("std")
    fits = F.abs(F.col("mean") - F.col("point")) <= F.col("std")
    fits = fits & F.col("mean").between(F.col("ci_lower"), F.col("ci_upper")) & width.between(3.3, 4.5)
    fits = fits & F.coalesce((F.col("std") / F.col("deviation")).between(0.8, 1.25), F.lit(True))
    return intervals.join(side, "metric").select("metric", F.round("point", 7).alias("point"), F.round("deviation", 7).alias("deviation"), fits.alias("fits"),
                                                 (F.col("n_valid") > 1800).alias("mostly_valid"))


def points_of(df, y, p, threshold):
    points, x = M.curve(df, y, p), M.confusion(df, y, p, threshold)
    x = x.withColumns({c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")})  # a product of three counts of millions does not fit a long
    rates = x.select("*", *[F.expr(f"CAST({d} AS DOUBLE)").alias(f"{m}_deviation") for m, d in DEVIATIONS.items()]).first().asDict()
    return {"pr_auc": (M.average_precision(points).first()[0], None), "roc_auc": (M.roc_auc(points).first()[0], None),
            **{m: (rates[m], rates.get(f"{m}_deviation")) for m in ("precision", "recall", "f1", "mcc")}}


def bootstrapped(df, y, p, threshold):
    return against(B.bootstrap(df, y, p, threshold), points_of(df, y, p, threshold))


def points_sql(base, view, p, t):
    deviation = "CASE metric " + " ".join(f"WHEN '{m}' THEN (SELECT round({d}, 7) FROM x1)" for m, d in DEVIATIONS.items()) + " END"
    return with_(base, headline_sql(view, p, "y", t, 1)) + f"""SELECT CASE metric WHEN 'average_precision' THEN 'pr_auc' ELSE metric END AS metric, round(value, 7) AS point,
  {deviation} AS deviation, TRUE AS fits, TRUE AS mostly_valid FROM l1 WHERE metric IN ('average_precision', 'roc_auc', 'precision', 'recall', 'f1', 'mcc')"""


def paired(spark, sf):
    df = scored2(spark, sf)
    delta = M.average_precision(M.curve(df, "y", "p_b")).first()[0] - M.average_precision(M.curve(df, "y", "p_a")).first()[0]
    return against(B.paired_bootstrap(df, "y", "p_a", "p_b"), {"delta_average_precision": (delta, None)})


QUERIES["m10_bootstrap"] = (lambda spark, sf: bootstrapped(scored2(spark, sf), "y", "p_a", 0.05), points_sql(SCORED2, "scored2", "p_a", 0.05))
QUERIES["m10_bootstrap_ties"] = (lambda spark, sf: bootstrapped(scored(spark, sf), "y", "p", 0.5), points_sql(SCORED, "scored", "p", 0.5))
QUERIES["m11_paired_bootstrap"] = (
    paired, with_(SCORED2, headline_sql("scored2", "p_a", "y", 0.05, 1), headline_sql("scored2", "p_b", "y", 0.05, 2))
    + """SELECT 'delta_average_precision' AS metric, round(b.value - a.value, 7) AS point, CAST(NULL AS DOUBLE) AS deviation, TRUE AS fits, TRUE AS mostly_valid
FROM l1 a JOIN l2 b USING (metric) WHERE a.metric = 'average_precision'""")

QUERIES["m12_compare_models"] = (
    lambda spark, sf: rounded(M.compare_models(scored2(spark, sf), "y", "p_a", "p_b", 0.2), 7),
    with_(SCORED2, headline_sql("scored2", "p_a", "y", 0.2, 1), headline_sql("scored2", "p_b", "y", 0.2, 2))
    + """SELECT a.metric, round(a.value, 7) AS model_a, round(b.value, 7) AS model_b, round(b.value - a.value, 7) AS delta
FROM l1 a JOIN l2 b USING (metric) WHERE a.metric NOT IN ('tp', 'fp', 'fn', 'tn')""")

QUERIES["m13_decide"] = (
    lambda spark, sf: M.decide(scored2(spark, sf), "p_a", 0.2).select("id", "prediction"),
    with_(SCORED2) + "SELECT id, CAST(p_a >= 0.2 AS INTEGER) AS prediction FROM scored2")


def _extras(tag, view):
    return f"""SELECT '{tag}' AS split, metric, value FROM l{tag} UNION ALL
SELECT '{tag}', 'ece', round(sum(n * abs(m - f)) / sum(n), 9) FROM (SELECT count(*) AS n, avg(p_a) AS m, avg(y) AS f
  FROM {view} GROUP BY least(floor(p_a * 10), 9)) UNION ALL
SELECT '{tag}', 'recall_at_fpr_' || a, round(coalesce(max(CASE WHEN fp / n_all::DOUBLE <= CAST(a AS DOUBLE)
  THEN tp / p_all::DOUBLE END), 0), 9) FROM c{tag}, (VALUES ('0.001'), ('0.005'), ('0.010'), ('0.020')) v(a) GROUP BY a UNION ALL
SELECT '{tag}', 'precision_at_top_' || k, round(sum(CASE WHEN rank <= k THEN y ELSE 0 END) / least(k, max(n))::DOUBLE, 9)
FROM (SELECT y, row_number() OVER (ORDER BY p_a DESC, id) AS rank, count(*) OVER () AS n FROM {view}),
  (VALUES (100), (500), (1000), (5000)) ks(k) GROUP BY k"""


QUERIES["m18_evaluation_report"] = (
    lambda spark, sf: rounded(M.evaluation_report(
        scored2(spark, sf).withColumn("split", F.when(F.col("id") % 2 == 0, "val").otherwise("test")),
        "y", "p_a", 0.2, ["id"], ["val", "test"])),
    with_(SCORED2, "sval AS (SELECT * FROM scored2 WHERE id % 2 = 0)", "stest AS (SELECT * FROM scored2 WHERE id % 2 = 1)",
          headline_sql("sval", "p_a", "y", 0.2, "val"), headline_sql("stest", "p_a", "y", 0.2, "test"))
    + _extras("val", "sval") + " UNION ALL " + _extras("test", "stest"))


# The bootstrap rows of the report: their form, as m10 holds their values against what is expected.


def reported(spark, sf):
    preds = scored2(spark, sf).withColumn("split", F.when(F.col("id") % 2 == 0, "val").otherwise("test"))
    parts = F.regexp_extract("metric", "^(.*)_(mean|std|ci_lower|ci_upper|n_valid)$", 1)
    rows = B.full_report(preds, "y", "p_a", 0.2, ["id"], ["val", "test"]).withColumn("base", parts).where("base != ''")
    at = {s: F.max(F.when(F.col("metric").endswith(f"_{s}"), F.col("value"))) for s in ("mean", "std", "ci_lower", "ci_upper", "n_valid")}
    rows = rows.groupBy("split", F.col("base").alias("metric")).agg(F.count("*").alias("rows"), *[c.alias(s) for s, c in at.items()])
    # a metric that is 0 or 1 in every draw (few rows of a class) has no spread
    ordered = F.col("mean").between(F.col("ci_lower"), F.col("ci_upper")) & ((F.col("std") > 0) == (F.col("ci_lower") < F.col("ci_upper"))) & (F.col("n_valid") > 1800)
    return rows.select("split", "metric", "rows", ordered.alias("fits"))


QUERIES["m18_report_intervals"] = (
    reported, "SELECT split, metric, CAST(5 AS BIGINT) AS rows, TRUE AS fits FROM (VALUES ('val'), ('test')) s(split), (VALUES "
    + ", ".join(f"('{m}')" for m in B.METRICS) + ") m(metric)")
