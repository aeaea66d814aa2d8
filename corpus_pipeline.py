"""A corpus prepared in five stages: language, repeated passages, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardflow.llm import lang_id, line_dedup, mixing, near_dup, packing
from cardflow.llm.frames import stored, table

STAGES = [
    ("language ID", lang_id.stage),
    ("line dedup", line_dedup.stage),
    ("MinHash near-dedup", near_dup.stage),
    ("mixing sources", mixing.stage),
    ("packing", packing.stage),
]

#: No SQL: the first, third and last stage can't be expressed in it. tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
