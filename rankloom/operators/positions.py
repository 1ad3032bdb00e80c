"""Phrases and ordered windows on an index with positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import kept
from .index import Index
from .ranking import ranked, settled


def phrase_places(places: list[np.ndarray]) -> np.ndarray:
    """Where the first term stands with the others right behind it, from each term's sorted places."""
    at = places[0]
    for i, other in enumerate(places[1:], 1):
        at = at[np.isin(at + i, other, assume_unique=True)]
    return at


def window_places(places: list[np.ndarray], width: int) -> np.ndarray:
    """Where the first term stands with the others behind it in order, each at most `width` places after the one before.
    From the last term backwards: a place stays if the next term's nearest one behind it is near enough."""
    after = places[-1]
    for now in places[-2::-1]:
        nearest = np.searchsorted(after, now, "right")
        ok = nearest < len(after)
        now = now[ok]
        after = now[after[nearest[ok]] - now <= width] if len(after) else after
    return after


def counted(width: int | None):
    """A column function: how often the terms of slots (array of slot, gaps) stand as a phrase or, with a width, in a window."""

    @F.pandas_udf("long")
    def count(slots: pd.Series) -> pd.Series:
        def of(row) -> int:
            places = [np.cumsum(x["gaps"]) for x in sorted(row, key=lambda x: x["slot"])]
            return len(phrase_places(places) if width is None else window_places(places, width))

        return slots.map(of)

    return count


def matches(queries: DataFrame, index: Index, keys: list[str], width: int | None = None) -> DataFrame:
    """keys, docid, dl, tf: the passages in which a query's terms (array column words, in order, repeats allowed) stand as a
    phrase, or each at most `width` places after the one before, and how many places they begin at.

    Only the terms' folders of the index are opened. All positions of a passage lie in one task, so the terms of a query
    meet there without an exchange, and position lists are merged for passages that have every term alone.
    """
    if "gaps" not in index.postings.columns:
        raise ValueError("the index was written without positions")
    slots = kept(queries.filter(F.size("words") > 0).select(*keys, F.size("words").alias("_n"), F.posexplode("words").alias("slot", "term")))
    known, rows = index.met_by(slots)
    each = known.join(rows.select("term", "docid", "dl", "gaps"), "term")
    found = each.groupBy(*keys, "docid", "dl", "_n").agg(F.collect_list(F.struct("slot", "gaps")).alias("slots")).filter(F.size("slots") == F.col("_n"))
    return found.select(*keys, "docid", "dl", counted(width)("slots").alias("tf")).filter("tf > 0")


def topk(queries: DataFrame, index: Index, keys: list[str], k: int = 1000, width: int | None = None, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """The k best passages by BM25, the phrase or window being one term: keys, docid, tf, score, rank."""
    found = matches(queries, index, keys, width).crossJoin(F.broadcast(index.stats.select("n_docs", "avgdl")))
    df: Column = F.count("*").over(W.partitionBy(*keys))
    idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
    tf = F.col("tf")
    score = idf * tf / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return ranked(found.select(*keys, "docid", "tf", settled(score).alias("score")), keys, k)
