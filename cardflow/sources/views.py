"""Logical views over the test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardflow.operators.ordered import ROWS, running
from cardflow.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    stamp = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("card_id"),
        F.col("event_type").alias("merchant_id"), F.col("value").alias("amount"),
        stamp.alias("event_time"), F.unix_micros(stamp).alias("us"), k.alias("k"),
        F.when(k >= 80, "FOREIGN").otherwise("LOCAL").alias("country"),
        (F.col("event_type") == "error").alias("is_fraud"))


def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ev`` with holes."""
    return (ev(spark, sf_dir)
            .withColumn("amount", F.when(F.col("k") % 10 != 0, F.col("amount")))
            .withColumn("merchant_id", F.when(F.col("k") % 13 != 0, F.col("merchant_id"))))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("card_id"),
        F.col("o_totalprice").alias("amount"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("dt"),
        F.col("o_orderpriority").alias("product_cd"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_fraud"))


def odd(df: DataFrame) -> DataFrame:
    """The amounts with some that are no ordinary sums of money: not a number, infinite, tiny and huge."""
    part = F.pmod("transaction_id", F.lit(499))
    return df.withColumn("amount", F.when(part == 1, float("nan")).when(part == 2, float("inf")).when(part == 3, float("-inf"))
                         .when(part == 4, 1e33).when(part % 5 == 0, 1e-7).otherwise(F.col("amount")))


def digits(name: str, n: int) -> Column:
    """Rounded, unless so large that there are no such digits."""
    return F.when(F.abs(name) < 1e15, F.round(name, n)).otherwise(F.col(name))


def prof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("card_id"), F.col("c_mktsegment").alias("card4"),
        F.col("c_nationkey").alias("card1"), F.col("c_acctbal").alias("addr1"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct scores, many ties. Ids are not unique (``lineitem`` has duplicates)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(F.col("l_discount") * 10, 6).alias("p"))


def scored2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("y"),
        F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("p_a"),
        (F.pmod(F.col("doc_id") * 7919 + 104729, F.lit(1009)) / 1009.0).alias("p_b"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ev`` as a partitioned log; the offset is the number of earlier ids in the partition."""
    part = F.pmod("card_id", F.lit(6)).cast("int")
    events = ev(spark, sf_dir).select(part.alias("partition"), "transaction_id", "card_id", "us", "amount")
    return running(events, ["partition"], [F.col("transaction_id")], {"offset": ROWS}, include_current=False)


def api_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select(
        "transaction_id", "us", "event_time", F.col("amount").alias("latency_ms"),
        F.when(F.col("k") < 85, 200).when(F.col("k") < 95, 422).otherwise(500).alias("status"))
