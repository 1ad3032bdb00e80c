"""Where measures go: means and single queries as JSON, and one file for each measure and run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import latex_row


def measure_rows(means: DataFrame, name: str, measures: list[str]) -> DataFrame:
    """measure, value (a line `name-[mean]`) of a table of means of one row."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.concat(F.lit(f"{name}-["), F.col(m).cast("string"), F.lit("]")).alias("value")) for m in measures))
    return means.select(F.explode(pairs).alias("x")).select("x.measure", "x.value")


def save_measures(per_query: DataFrame, means: DataFrame, folder: str, name: str, measures: list[str], settings: dict | None = None, shown: list[str] | None = None) -> None:
    """Write under folder: means/<name> (JSON, with a table row of the shown measures and the settings), queries/<name> (a JSON
    line for each query), and measures/measure=<m>/run=<name> (its line), all replacing what was there under that name,
    so that a job that runs again leaves one line."""
    row = latex_row([F.col(m) for m in shown or measures]).alias("latex")
    fixed = [F.lit(str(v)).alias(f"setting_{k}") for k, v in (settings or {}).items()]
    means.select(F.lit(name).alias("name"), "*", row, *fixed).coalesce(1).write.mode("overwrite").json(f"{folder}/means/{name}")
    per_query.write.mode("overwrite").json(f"{folder}/queries/{name}")
    rows = measure_rows(means, name, measures).withColumn("run", F.lit(name)).coalesce(1)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("measure", "run").text(f"{folder}/measures")
