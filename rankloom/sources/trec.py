"""Run and judgement files in the usual six- and four-column text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked


def parse_run(lines: DataFrame, ties_down: bool = False) -> DataFrame:
    """qid, docid, score, rank, tag from lines `qid Q0 docid rank score tag`; the rank is that of the scores, not the stored one,
    equal scores by docid (ties_down: from the greatest docid, as the usual evaluation program has it)."""
    p = F.split("value", " ")
    rows = lines.filter(F.size(p) >= 5).select(p[0].alias("qid"), p[2].alias("docid"), p[4].cast("double").alias("score"), F.get(p, F.lit(5)).alias("tag"))
    return ranked(rows, ["qid"], ties_down=ties_down)


def read_run(spark: SparkSession, path: str, ties_down: bool = False) -> DataFrame:
    return parse_run(spark.read.text(path), ties_down)


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    return run.select("qid", "rank", F.format_string("%s Q0 %s %d %s %s", F.col("qid").cast("string"), F.col("docid").cast("string"), F.col("rank"), F.col("score").cast("string"), F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, tag: str) -> None:
    """Sorted by query and rank across files."""
    run_lines(run, tag).sort("qid", "rank").select("value").write.mode("overwrite").text(path)


def parse_qrels(lines: DataFrame) -> DataFrame:
    """qid, docid, rel from lines `qid iter docid rel`."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.size(p) >= 4).select(p[0].alias("qid"), p[2].alias("docid"), p[3].cast("int").alias("rel"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return parse_qrels(spark.read.text(path))


def hyphenated(line: Column) -> Column:
    """A judgement line with _ replaced by - in its first field only."""
    return F.concat(F.regexp_replace(F.regexp_extract(line, r"^(\S*)", 1), "_", "-"), F.regexp_extract(line, r"^\S*([\s\S]*)$", 1))


def judged_queries(qrels: DataFrame) -> DataFrame:
    return qrels.select("qid").distinct()
