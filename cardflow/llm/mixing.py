"""Mixing sources to target weights by weighted fair queueing.

Sources in code point order (null last) take the weights in turn and share a budget of words; no target exceeds `most` times the
source's size, and what is above is shared again by weight (a common level of words per weight, found from running sums).
Each source is a queue of its documents in an order given by a hash of doc_id, and after the last document the queue starts again. A document's virtual
finish time is the words of its queue up to its end, divided by the source's target. The mix is the queue of all sources in the order of
the finish times (a global range sort), truncated at the budget: as the targets sum up to the budget, all sources reach it at virtual time 1,
and the document that a source is serving then is taken up to the word it has come to. So every source gives its target, to the word.

Words before a document are added up in two levels (totals of hash ranges, then rows of one range), so a source of any size is spread over tasks.

Defined results: null, empty and blank texts have no words, take no part in any sum and are never taken. Rows without source are a source of their own. Rows that
repeat a doc_id queue next to each other, shorter ones first. Input columns stay together in the struct `doc`, so their names can't clash.

Only DataFrame functions are used."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.llm.frames import table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, source_size and target, from one row per source with key, source and source_size. One row per source is sorted as a whole."""
    every = W.orderBy("ratio", "key")
    names = W.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights) + 1)))
    weighed = weighed.withColumn("limit", F.col("source_size") * most)
    weighed = weighed.withColumn("ratio", F.col("limit").cast("double") / F.col("weight"))
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum("limit").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(every.rowsBetween(0, W.unboundedFollowing))
    leveled = weighed.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - before) / left)
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole)
    leveled = leveled.withColumn("level", level)
    full = F.col("level").isNull() | (F.col("ratio") < F.col("level"))
    return leveled.select("key", "source_size", F.when(full, F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def schedule(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc, size, source_size, target; and for each pass over the queue, when the document ends there (`finish`, in virtual time) and the words that
    the mix takes of it (`taken`)."""
    bits = max(4, math.ceil(math.log2(max(docs.count(), 1)) / 2))
    queue = docs.select(
        F.struct("*").alias("doc"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"))
    queue = queue.withColumn("range", F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), 32 - bits))
    ranges = queue.groupBy("key", "source", "range").agg(F.sum("size").alias("words"))
    sizes = ranges.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    starts = ranges.select("key", "range", (F.sum("words").over(W.partitionBy("key").orderBy("range")) - F.col("words")).alias("start"))
    starts = starts.join(targets(sizes, weights, share, most), "key")
    order = W.partitionBy("key", "range").orderBy("place", F.col("doc.doc_id"), "size")
    rows = queue.drop("source").join(starts, ["key", "range"])
    rows = rows.withColumn("end", F.col("start") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ends = [F.col("end") + F.col("source_size") * c for c in range(math.ceil(most))]
    taken = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - e + F.col("size"))) for e in ends]
    finish = [F.when(F.col("target") > 0, e / F.col("target")) for e in ends]
    return rows.select("doc", "size", "source_size", "target", "place", F.array(*finish).alias("finish"), F.array(*taken).alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents as the mix takes them, in its order: doc, size, copy (from 0), virtual_finish and taken (above 0)."""
    rows = schedule(docs, weights, share, most)
    rows = rows.select("doc", "size", "place", F.posexplode(F.arrays_zip("finish", "taken")).alias("copy", "served"))
    rows = rows.where("served.taken > 0").select("doc", "size", "place", "copy", F.col("served.finish").alias("virtual_finish"), F.col("served.taken").alias("taken"))
    return rows.orderBy("virtual_finish", "place", "copy")


def query(spark, sf_dir: str) -> DataFrame:
    rows = schedule(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = rows.select("doc.doc_id", "size", "source_size", "target", F.expr("aggregate(taken, 0L, (a, x) -> a + x)").alias("taken"), F.element_at("finish", 1).alias("virtual_finish"))
    return rows.orderBy("virtual_finish", "doc_id")


SQL = r"""WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key, source),
weighed AS (SELECT *, list_element([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)) AS weight, source_size * 2 AS most FROM sizes),
ratios AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM weighed),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(CAST(sum(most) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
  / CAST(sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ratios),
leveled AS (SELECT key, source_size, weight, most, ratio,
  (SELECT arg_min(level, (ratio, key)) FROM levels WHERE level <= ratio) AS level FROM levels),
goals AS (SELECT key, source_size, CASE WHEN level IS NULL OR ratio < level THEN CAST(most AS DOUBLE) ELSE level * weight END AS target FROM leveled),
queued AS (SELECT doc_id, size, source_size, target,
  CAST(sum(size) OVER (PARTITION BY key ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM sized JOIN goals USING (key))
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - e + size)) + greatest(0, least(size, CAST(floor(target) AS BIGINT) - e - source_size + size)) AS BIGINT) AS taken,
  CASE WHEN target > 0 THEN e / target END AS virtual_finish FROM queued"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: rows of documents, some twice; the last one that a source serves ends at the word it has come to."""
    rows = mix(docs)
    words = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("taken"), F.lit("}+"))
    text = F.when(F.col("taken") < F.col("size"), F.regexp_substr(F.col("doc.text"), words)).otherwise(F.col("doc.text"))
    rows = rows.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
    if "n_chars" not in docs.columns:
        return rows
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


QUERIES = {"op3_mix_sources": (query, SQL)}
