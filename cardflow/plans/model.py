"""Queries that train models (M14-M17, R6). Their values depend on the trainer, so SQL states what must hold of them: one feature, ``signal``, decides the label in 70 % of
the rows, so that a model must rank by it (its own area is 0.85), and a constant one is seen."""

from pyspark.sql import functions as F

from cardflow.operators import boosting as B, model as M
from cardflow.operators.adapt import adapt
from cardflow.operators.metrics import curve, roc_auc
from cardflow.plans.relational import SPLIT_SQL, split_tx
from cardflow.plans.sql import TX, with_
from cardflow.session import materialize
from cardflow.sources.readers import read_file_events, read_parquet
from cardflow.sources.sinks import sink_parquet, write_parquet
from cardflow.sources.views import prof
from cardflow.streaming.streams import run_all, scratch

QUERIES = {}
FEATURES = ["amount", "weekday", "priority", "balance", "signal"]
LEAST_AUC = 0.75


def rows(spark, sf):
    """Transactions with numeric features and their split."""
    profiles = prof(spark, sf).select("card_id", F.col("addr1").alias("balance"), "card4")
    return split_tx(spark, sf).join(profiles, "card_id", "left").select(
        "transaction_id", "amount", F.year(F.timestamp_seconds("dt")).alias("year"), "product_cd", "card4",
        F.pmod(F.col("dt") / 86400, F.lit(7.0)).alias("weekday"),
        F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(10)) < 7, F.col("is_fraud")).otherwise(
            F.pmod(F.xxhash64("transaction_id", F.lit(1)), F.lit(2))).cast("double").alias("signal"), F.substring("product_cd", 1, 1).cast("int").alias("priority"),
        F.col("balance").cast("double").alias("balance"), "is_fraud", "split")


def trained(spark, sf):
    df = rows(spark, sf)
    return M.train_gbt(df.filter("split = 'train'"), FEATURES, "is_fraud", val=df.filter("split = 'val'")), df


def auc(df, label="is_fraud", score="probability"):
    return roc_auc(curve(df, label, score)).first()["roc_auc"]


def scored(spark, sf):
    model, df = trained(spark, sf)
    out = materialize(M.score(df, model, ["transaction_id", "split", "is_fraud"]))
    held = out.filter("split = 'test'")
    return valid(out).select("transaction_id", "split", "valid", F.lit(auc(held) > LEAST_AUC).alias("ranks"))


def valid(df):
    """Whether the probability is one."""
    return df.withColumn("valid", F.col("probability").between(0, 1)).drop("probability")


def scored_stream(spark, sf):
    """The stream's scores, and whether they are those of the same model on the table."""
    model, df = trained(spark, sf)
    inbox, path, checkpoint = (scratch(spark, n) for n in ("m15-in", "m15-out", "m15-checkpoint"))
    write_parquet(df, inbox)
    arriving = read_file_events(spark, inbox, df.schema)
    run_all([sink_parquet(M.score(arriving, model, ["transaction_id"]), path, checkpoint)])
    table = M.score(df, model, ["transaction_id"], "on_table")
    both = read_parquet(spark, path).join(table, "transaction_id", "left").withColumn("same", F.col("probability") == F.col("on_table"))
    return valid(both).select("transaction_id", "valid", "same")


def importances(spark, sf):
    model, _ = trained(spark, sf)
    shares = M.importance(spark, model, FEATURES)
    total, best = shares.agg(F.abs(F.sum("importance") - 1) < 1e-6, F.max("importance")).first()
    return shares.select("feature", (F.col("importance") >= 0).alias("valid"), F.lit(total).alias("whole"), (F.col("importance") == best).alias("first"))


def encodings(spark, sf):
    df = rows(spark, sf)
    part = {s: df.filter(F.col("split") == s) for s in ("train", "val", "test")}
    out = M.compare_encodings(part["train"], part["val"], part["test"], ["product_cd", "card4"], ["amount", "weekday", "signal"],
                              "is_fraud", ["transaction_id"])
    shares = F.array("average_precision", "roc_auc", "precision", "recall", "f1", "threshold")
    return out.select("encoding", (F.col("tp") + F.col("fn")).cast("long").alias("positives"),
                      (F.col("fp") + F.col("tn")).cast("long").alias("negatives"), F.forall(shares, lambda x: x.between(0, 1)).alias("valid"),
                      (F.col("roc_auc") > LEAST_AUC).alias("ranks"))


def adapted(spark, sf):
    df = rows(spark, sf)
    shares = df.groupBy(F.col("year").alias("period")).agg(F.avg("is_fraud").alias("share"))
    out = adapt(df, "year", "is_fraud", ["amount", "weekday", "balance"], ["product_cd", "card4"], FEATURES,
                train=[1995, 1996], validate=1997, monitor=[1998, 1999, 2000], evaluate=[1999, 2000, 2001], trigger_features=1,
                min_rows=1, clip="inner")
    close = F.abs(F.col("ap_adaptive") - F.col("ap_static") - F.col("delta")) < 1e-9
    ordered = (F.col("ci_lower") <= F.col("ci_upper")) & F.col("ap_static").between(0, 1)
    # a constant score has the share of positives as its average precision
    better = F.least("ap_static", "ap_adaptive") > F.col("share") + 0.15
    out = out.join(shares, "period")
    return out.select("period", F.coalesce(better, F.col("ap_static").isNull()).alias("ranks"), F.col("ap_static").isNotNull().alias("evaluated"), F.col("triggered").isNotNull().alias("monitored"),
                      F.coalesce(close & ordered, F.col("ap_static").isNull()).alias("valid"), F.col("version").rlike("^v[1-4]$").alias("versioned"))


BOOSTED = ["amount", "weekday", "priority", "balance"]
SMALL = B.BoostConfig(trees=8, leaves=7, rate=0.3, patience=6, block=4)


def together(spark, sf):
    """A label that no single feature decides: in 80 % of the rows, whether it is early in the week and the priority is high; an amount that is missing tells it from the rest."""
    early = (F.col("weekday") < 4) & (F.col("priority") <= 3)
    draw = F.pmod(F.xxhash64("transaction_id", F.lit(3)), F.lit(10))
    df = rows(spark, sf).withColumn("target", F.when(draw < 8, early.cast("int")).otherwise((draw == 8).cast("int")))
    gone = (F.col("target") == 1) & (F.pmod(F.xxhash64("transaction_id", F.lit(4)), F.lit(3)) == 0)
    return df.withColumn("amount", F.when(~gone, F.col("amount").cast("double")))


def boosted(spark, sf):
    """Histogram boosting against a constant, a single split of the same table, and itself on rows that lie otherwise."""
    df = together(spark, sf)
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'")
    model = B.train(train, BOOSTED, "target", ["transaction_id"], SMALL, val)
    stump = B.train(train, BOOSTED, "target", ["transaction_id"], B.BoostConfig(trees=1, leaves=2, feature_share=1.0))
    out = materialize(df.select("transaction_id", "split", "target", B.probability(model).alias("probability"), B.probability(stump).alias("by_stump")))
    held = out.filter("split = 'test'")
    area, least = auc(held, "target"), auc(held, "target", "by_stump")
    return valid(out).select("transaction_id", "split", "valid", F.lit(area > LEAST_AUC).alias("ranks"), F.lit(area > least + 0.05).alias("above_stump"))


def boosted_importances(spark, sf):
    df = together(spark, sf).filter("split = 'train'")
    config = B.BoostConfig(trees=3, leaves=7, feature_share=1.0)
    shares = B.importance(spark, B.train(df, BOOSTED, "target", ["transaction_id"], config))
    decide = F.col("feature").isin("amount", "weekday", "priority")
    total, least, most = shares.agg(F.sum("importance"), F.min(F.when(decide, F.col("importance"))), F.max(F.when(~decide, F.col("importance")))).first()
    return shares.select("feature", (F.col("importance") >= 0).alias("valid"), F.lit(abs(total - 1) < 1e-9).alias("whole"), F.lit(least > most).alias("found"))


SPLITS = with_(TX) + f"SELECT transaction_id, {SPLIT_SQL} AS split, TRUE AS valid, TRUE AS ranks FROM tx"
QUERIES["m14_train_gbt"] = (scored, SPLITS)
QUERIES["m14_boost_trees"] = (boosted, SPLITS.replace("TRUE AS ranks", "TRUE AS ranks, TRUE AS above_stump"))
QUERIES["m16_boost_importance"] = (boosted_importances, f"SELECT feature, TRUE AS valid, TRUE AS whole, TRUE AS found FROM (SELECT unnest({BOOSTED}) AS feature)")
QUERIES["m15_score_stream"] = (scored_stream, with_(TX) + "SELECT transaction_id, TRUE AS valid, TRUE AS same FROM tx")
QUERIES["m16_importance"] = (importances, f"SELECT feature, TRUE AS valid, TRUE AS whole, feature = 'signal' AS first FROM (SELECT unnest({FEATURES}) AS feature)")
QUERIES["m17_compare_encodings"] = (
    encodings, with_(TX) + f"""SELECT unnest(['label', 'native', 'frequency']) AS encoding, count(*) FILTER (is_fraud = 1) AS positives,
  count(*) FILTER (is_fraud = 0) AS negatives, TRUE AS valid, TRUE AS ranks FROM tx WHERE {SPLIT_SQL} = 'test' GROUP BY ALL""".replace(" GROUP BY ALL", ""))
QUERIES["r6_adapt"] = (
    adapted, with_(TX) + """SELECT DISTINCT CAST(year(make_timestamp(dt * 1000000)) AS INTEGER) AS period, year(make_timestamp(dt * 1000000)) >= 1999 AS evaluated,
  year(make_timestamp(dt * 1000000)) <= 2000 AS monitored, TRUE AS valid, TRUE AS ranks, TRUE AS versioned FROM tx WHERE year(make_timestamp(dt * 1000000)) >= 1998""")
