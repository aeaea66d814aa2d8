"""Helpers on DataFrames: stored tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.session import checkpoint_dir

__all__ = ["Tables", "components", "small", "stored", "table"]

#: Most rows that are broadcast; beyond it, Spark shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Steps of one computation, written as Parquet in the shared checkpoint folder and read from there: each is computed once, survives
    a lost executor, and Spark knows its true size. A step is dropped when the next ones are written."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def stored(self, df: DataFrame, *by: str) -> DataFrame:
        """by: columns whose values become folders, so that reading some of them leaves the files of the others alone."""
        spark = df.sparkSession
        path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _, path = self.paths.pop(id(df))
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """A step that stays, as what is returned reads it."""
    return Tables().stored(df)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: node, component (its least node), for every node of an edge.

    Each round sends the neighbours of a node above it to its least neighbour (large star), then those below it (small star),
    until every node hangs on the least one of its component. Rounds grow with the logarithm of the longest path. A hub is
    a key of a min() and of a join, which Spark splits; no group is gathered. Self-links and repeated links may occur."""
    steps = Tables()
    e = steps.stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.union(e.where("u = v")).where("u >= v").distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        hung = star.join(least, "u")
        before, e = e, steps.stored(hung.select("v", "m").union(hung.select("u", "m")).distinct().toDF("u", "v"))
        steps.drop(before)
        # a star forest: each node once, and no root below another node
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
