"""Index statistics that follow a growing collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import postings, term_lists


def passage_stream(spark: SparkSession, folder: str, schema: str = "id string, contents string") -> DataFrame:
    """JSON-lines files as they arrive in a folder."""
    return spark.readStream.schema(schema).json(folder).withColumnRenamed("id", "docid")


def document_frequencies(passages: DataFrame) -> DataFrame:
    """term, df, tf over all passages so far; use with outputMode('complete') or 'update'."""
    lists = term_lists(passages, "docid", "contents")
    words = lists.select("docid", F.explode(F.array_distinct("words")).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


def append_postings(passages: DataFrame, path: str, checkpoint: str):
    """Write each arriving batch's postings; a batch that runs again replaces its own files."""

    def save(batch: DataFrame, number: int) -> None:
        postings(term_lists(batch, "docid", "contents")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return passages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
