"""A partitioned log with offsets, as a table and as a stream (S5 where no connector is at hand).

A log is a folder: ``data/batch=B/partition=P/chunk=C`` holds the records of one append, at most ``CHUNK_ROWS`` offsets to a file, and ``index`` one row
per file with the offsets it holds. A reader goes by the index, which is written last: an append is seen whole or not at all. Offsets count the
records of a partition without gaps. One writer at a time may append.

As a stream, a micro-batch is a range of offsets per partition, which Spark keeps in its checkpoint; the driver reads index files that it hasn't seen, the
tasks read pieces of at most ``ROWS_PER_TASK`` offsets."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cardflow.operators.ordered import running

CHUNK_ROWS = 1_000_000
ROWS_PER_TASK = 250_000

RECORD = "key binary, value binary, partition int, offset long, timestamp timestamp"
INDEX = "batch string, partition int, chunk long, first long, last long"

# The reader travels to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _index(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def append_log(df: DataFrame, path: str, time: str, tiebreak: Sequence[str] = (), partitions: int = 6, partition: Column | None = None,
               split: bool | None = None) -> None:
    """Appends the records of ``df`` (``key, value`` and ``time`` in epoch microseconds), in the order of (time, tiebreak), which must be total. The key chooses the
    partition, a NULL key is one key; ``partition`` is another choice. A partition with very many records is numbered in slices."""
    spark = df.sparkSession
    place = F.pmod(F.xxhash64(F.col("key").cast("binary")), F.lit(partitions)) if partition is None else partition
    records = df.select(place.cast("int").alias("partition"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
                        F.col(time).cast("long").alias("time"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(tiebreak)])
    # one row per partition of the log
    ends = {r["partition"]: r["end"] for r in _index(spark, path).groupBy("partition").agg((F.max("last") + 1).alias("end")).collect()}
    numbered = running(records, ["partition"], ["time", *[f"__t{i}" for i in range(len(tiebreak))]], {"__n": ("count", None)}, split=split)
    base = F.lit(0)
    for p, end in ends.items():
        base = F.when(F.col("partition") == p, end).otherwise(base)
    numbered = numbered.select("key", "value", "time", "partition", (base + F.col("__n") - 1).cast("long").alias("offset"))
    numbered = numbered.withColumn("chunk", F.floor(F.col("offset") / CHUNK_ROWS))
    batch = uuid.uuid4().hex
    data = f"{path}/data/batch={batch}"
    # a chunk is in one task and in one file, in order
    numbered.repartition("partition", "chunk").sortWithinPartitions("partition", "chunk", "offset").write.partitionBy("partition", "chunk").parquet(data)
    written = spark.read.schema("offset long, partition int, chunk long").parquet(data)
    files = written.groupBy("partition", "chunk").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    files.select(F.lit(batch).alias("batch"), "partition", "chunk", "first", "last").coalesce(1).write.mode("append").parquet(f"{path}/index")


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def shares(backlog: dict[str, int], cap: int) -> dict[str, int]:
    """``cap`` records dealt to partitions by their backlog; none gets more than it has, and all of the cap is used."""
    total = sum(backlog.values())
    if total <= cap:
        return dict(backlog)
    out = {p: cap * n // total for p, n in backlog.items()}
    for p in sorted(backlog, key=lambda p: (-(cap * backlog[p] % total), p))[:cap - sum(out.values())]:
        out[p] += 1
    return out


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"].rstrip("/")
        self.starting = options.get("startingOffsets", "earliest")
        self.cap = int(options.get("maxOffsetsPerTrigger", 0))
        self.strict = options.get("failOnDataLoss", "true").lower() == "true"
        self.progress = options.get("progress")
        if self.cap and not self.progress:
            raise ValueError("maxOffsetsPerTrigger needs a folder 'progress', from which a restarted query goes on")
        self.read_files: set[str] = set()
        self.files: dict[str, list[tuple[int, int, str, int]]] = {}  # partition -> (first, last, batch, chunk)
        self.ends: dict[str, int] = {}
        self.at: dict[str, int] | None = None

    def _refresh(self) -> None:
        system, folder = _folder(f"{self.path}/index")
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.base_name.endswith(".parquet") or info.path in self.read_files:
                continue
            self.read_files.add(info.path)
            for r in pq.read_table(info.path, filesystem=system).to_pylist():
                p = str(r["partition"])
                self.files.setdefault(p, []).append((r["first"], r["last"], r["batch"], r["chunk"]))
                self.ends[p] = max(self.ends.get(p, 0), r["last"] + 1)
        for files in self.files.values():
            files.sort()

    def initialOffset(self) -> dict:
        self._refresh()
        earliest = {p: files[0][0] for p, files in self.files.items()}
        if self.starting == "latest":
            self.at = dict(self.ends)
        else:
            self.at = earliest if self.starting == "earliest" else earliest | {str(p): int(o) for p, o in json.loads(self.starting).items()}
        return self.at

    def _reached(self) -> dict[str, int]:
        """Where the last planned micro-batch ended. Spark doesn't tell a source that is asked for the next end, so it is kept beside the checkpoint."""
        if self.at is None:
            system, name = _folder(f"{self.progress}/reached.json")
            if system.get_file_info(name).type == fs.FileType.File:
                with system.open_input_stream(name) as f:
                    self.at = json.loads(f.read())
            else:
                self.initialOffset()
        return self.at

    def latestOffset(self) -> dict:
        self._refresh()
        if not self.cap:
            return dict(self.ends)
        reached = self._reached()
        backlog = {p: max(end - reached.get(p, 0), 0) for p, end in self.ends.items()}
        taken = shares(backlog, self.cap)
        return {p: reached.get(p, 0) + taken[p] for p in self.ends}

    def _plan(self, p: str, start: int, end: int) -> list[InputPartition]:
        """The pieces of files that hold offsets from ``start`` to before ``end``."""
        pieces, at = [], start
        for first, last, batch, chunk in self.files.get(p, ()):
            low, high = max(first, at), min(last + 1, end)
            if low >= high:
                continue
            if low > at and self.strict:
                raise RuntimeError(f"offsets {at} to {low - 1} of partition {p} are not in the log any more")
            pieces += [InputPartition((batch, int(p), chunk, a, min(a + ROWS_PER_TASK, high))) for a in range(low, high, ROWS_PER_TASK)]
            at = high
        if at < end and self.strict:
            raise RuntimeError(f"offsets {at} to {end - 1} of partition {p} are not in the log any more")
        return pieces

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._refresh()
        pieces = []
        for p in sorted(end, key=int):
            if end[p] < start.get(p, 0):
                if self.strict:
                    raise RuntimeError(f"partition {p} ends at {end[p]}, before {start[p]}, where the query was")
                continue
            pieces += self._plan(p, start.get(p, 0), end[p])
        if self.progress:
            system, folder = _folder(self.progress)
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/reached.json") as f:
                f.write(json.dumps(end).encode())
        self.at = dict(end)
        return pieces

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        batch, p, chunk, low, high = partition.value
        system, folder = _folder(f"{self.path}/data/batch={batch}/partition={p}/chunk={chunk}")
        of = ds.field("offset")
        rows = ds.dataset(folder, format="parquet", filesystem=system).to_batches(columns=["key", "value", "time", "offset"], filter=(of >= low) & (of < high))
        for b in rows:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").cast(pa.binary()), b.column("value").cast(pa.binary()), pa.array([p] * b.num_rows, pa.int32()), b.column("offset"),
                     b.column("time").cast(pa.timestamp("us", "UTC"))], names=["key", "value", "partition", "offset", "timestamp"])

    def commit(self, end: dict) -> None:
        """Files before the end aren't asked for again."""
        for p, files in self.files.items():
            self.files[p] = [f for f in files if f[1] >= end.get(p, 0)]


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cardflow_log"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)  # whose names ignore case


def read_log_events(spark: SparkSession, path: str, max_offsets: int | None = None, starting: str = "earliest", progress: str | None = None,
                    fail_on_data_loss: bool = False) -> DataFrame:
    """The log as a stream, with the columns and options of ``read_kafka_events``. ``starting``: earliest, latest, or JSON ``{"partition": offset}`` (others from
    their first); it holds for a query without a checkpoint. ``max_offsets`` bounds a micro-batch and is dealt to the partitions by what waits in each; it needs a
    folder ``progress`` of the query's own, and a trigger by time (see ``streams.catch_up``): with ``availableNow`` Spark asks for an end only once. Offsets that are
    no longer in the log fail the query, or are passed over."""
    spark.dataSource.register(LogSource)
    options = {"startingOffsets": starting, "failOnDataLoss": str(fail_on_data_loss).lower()}
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    if progress:
        options["progress"] = progress
    return spark.readStream.format("cardflow_log").options(**options).load(path)
