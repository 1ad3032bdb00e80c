"""Runs: tables (qid, docid, score, rank), ranked by score, ties by docid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACES = 6


def settled(score: Column) -> Column:
    """Scores are rounded before they are ranked, so that the order of a sum's terms can't order near-ties."""
    return F.round(score, PLACES)


def ranked(scored: DataFrame, keys: list[str], k: int | None = None, ties_down: bool = False) -> DataFrame:
    """Add rank within keys; with k keep the first k, which each task cuts before the exchange."""
    tie = F.col("docid").desc() if ties_down else F.col("docid").asc()
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), tie)))
    return out.filter(F.col("rank") <= k) if k else out


def normalized(runs: DataFrame, method: str, keys: list[str]) -> DataFrame:
    """min-max: (s - min) / (max - min), 0 for constant lists; max: s / max, 0 where max is 0; none: as it is.
    Not rounded, so that weighted sums of it have no ties by rounding."""
    if method == "none":
        return runs
    w = W.partitionBy(*keys)
    low, high = F.min("score").over(w), F.max("score").over(w)
    if method == "max":
        new = F.coalesce(F.try_divide(F.col("score"), F.nullif(high, F.lit(0.0))), F.lit(0.0))
    elif method == "min-max":
        new = F.coalesce((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    return runs.withColumn("score", new)
