"""Batch and streaming sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from cardflow.session import use_utc
from cardflow.sources.normalize import SHAPES, normalize_source

STREAM_EVENT = StructType([
    StructField("transaction_id", StringType()), StructField("card_id", StringType()),
    StructField("merchant_id", StringType()), StructField("amount", DoubleType()),
    StructField("event_time", TimestampType())])

# Types of the key columns of the wide transaction table.
KEY_CASTS = {"TransactionID": "bigint", "TransactionDT": "bigint", "TransactionAmt": "double"}


def read_transactions_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
                          casts: Mapping[str, str] = KEY_CASTS) -> DataFrame:
    """CSV with a header. Give a schema where it is known: inferring reads the data twice."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(path)


def read_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Only the given columns are read from the files."""
    return read_parquet(spark, path).select(*cols)


def kafka_source_options(servers: str, topic: str, max_offsets: int | None = None,
                         starting: str = "earliest") -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting,
               "failOnDataLoss": "false"}
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_kafka_events(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None,
                      starting: str = "earliest") -> DataFrame:
    """The log as a stream. Needs the Kafka connector on the cluster's classpath."""
    return spark.readStream.format("kafka").options(**kafka_source_options(servers, topic, max_offsets, starting)).load()


def read_file_events(spark: SparkSession, folder: str, schema: StructType | str, max_files: int | None = None,
                     pattern: str | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; ``max_files`` bounds a micro-batch."""
    use_utc(spark)
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def envelope(df: DataFrame, key: str = "key", value: str = "value", time: str = "timestamp") -> DataFrame:
    """Message key, payload text and ingest time of a log record."""
    return df.select(F.col(key).cast("string").alias("card_key"), F.col(value).cast("string").alias("value"),
                     F.col(time).alias("ingest_time"))


def _csv_source(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    # All-string rows: the shapes cast leniently themselves.
    return lambda spark, path: normalize_source(spark.read.option("header", True).csv(path), kind)


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{kind: _csv_source(kind) for kind in SHAPES},
    "parquet": read_parquet,
}


def source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Reads a registered dataset kind in the common event schema."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    return SOURCES[name](spark, path)
