"""Batch and streaming sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter


def convert_to_parquet(df: DataFrame, path: str) -> int:
    """Writes a table that must not exist yet and checks the row count of what was written."""
    seen = Observation()  # counted on the way, so that the source is read once
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    written, expected = df.sparkSession.read.parquet(path).count(), seen.get["rows"]
    if written != expected:
        raise ValueError(f"{path}: {written} rows written, {expected} expected")
    return written


def write_parquet(df: DataFrame, path: str, files: int | None = None, partition_by: str | None = None) -> None:
    """Overwrites a table. ``files`` sets how many files of similar size; by default Spark's
    partitioning is kept, which saves a shuffle."""
    writer = (df.repartition(files) if files else df).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes in the named format; nothing falls back to another one silently."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def replace_partition(df: DataFrame, path: str, column: str = "split") -> None:
    """Replaces the partitions that occur in ``df`` and keeps all others."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def json_payload(df: DataFrame, key: str) -> DataFrame:
    """Key and JSON value of a log record."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def sink_parquet(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append sink; exactly once by the sink's own file log."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def _slots(spark: SparkSession, log: str) -> dict[tuple[str, int], tuple[int, bool]]:
    """(query, its batch) -> (folder number, whether it is written)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    rows = spark.read.schema("query string, batch long, slot long, done boolean").json(log)
    rows = rows.groupBy("query", "batch").agg(F.max("slot").alias("slot"), F.max("done").alias("done"))
    return {(r["query"], r["batch"]): (r["slot"], r["done"]) for r in rows.collect()}


def write_once(paths: Sequence[str], batch: DataFrame, batch_id: int, write: Callable[[int], None]) -> bool:
    """Calls ``write(slot)`` unless this batch of this query has been written; says whether it was called. Slots count the batches of all queries that wrote
    to ``paths[0]``, one after the other, and name the folders: a query that starts anew on an old path gets new ones and overwrites nothing, and a batch that comes again
    gets the folder it had. The commit table (a row before and a row after the write) lies in ``_commits`` beside the folders, where readers don't look."""
    spark = batch.sparkSession
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
    log = f"{paths[0]}/_commits"
    slots = _slots(spark, log)
    slot, done = slots.get((query, batch_id), (None, False))
    if done:
        return False
    if slot is None:
        slot = 1 + max((s for s, _ in slots.values()), default=-1)
        _commit(spark, log, query, batch_id, slot, False)
    write(slot)
    _commit(spark, log, query, batch_id, slot, True)
    return True


def _commit(spark: SparkSession, log: str, *row) -> None:
    spark.createDataFrame([row], "query string, batch long, slot long, done boolean").coalesce(1).write.mode("append").json(log)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: one folder per micro-batch, which is written once. ``batch_id`` of the folders goes on from query to query."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_once([path], batch, batch_id, lambda slot: batch.write.mode("overwrite").parquet(f"{path}/batch_id={slot}"))
    return write


def sink_foreach_batch(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataStreamWriter:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write_batch(path))


def latest_state(df: DataFrame, keys: list[str], batch: str = "batch_id") -> DataFrame:
    """The last row per key of an update-mode output."""
    rest = [c for c in df.columns if c not in (*keys, batch)]
    newest: Column = F.max_by(F.struct(*rest), F.col(batch).cast("long")).alias("__last")
    return df.groupBy(*keys).agg(newest).select(*keys, "__last.*")


def sink_console(df: DataFrame, checkpoint: str, rows: int = 20) -> DataStreamWriter:
    return (df.writeStream.format("console").outputMode("append").option("truncate", "false").option("numRows", rows)
            .option("checkpointLocation", checkpoint))


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}


def sink_kafka(df: DataFrame, servers: str, topic: str, key: str, checkpoint: str) -> DataStreamWriter:
    """At-least-once feature sink keyed by card. Needs the Kafka connector."""
    return (json_payload(df, key).writeStream.format("kafka").options(**kafka_sink_options(servers, topic))
            .option("checkpointLocation", checkpoint))
