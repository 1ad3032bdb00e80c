"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import pipeline
from rankloom.llm.common import Scratch

STAGES = [
    ("quality classifier", pipeline.keep_good),
    ("MinHash near-dedup", pipeline.keep_one),
    ("secret scans", pipeline.redact),
    ("mixing sources to target weights", pipeline.mix),
    ("packing", pipeline.pack),
]
#: No SQL expresses the trained classifier and forest; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder as Parquet and read as the next one's, and
    go when that one's are written."""
    scratch, old = Scratch(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(old)
        old = docs
    return docs
