"""Reranking: scores by a caller's model, rescoring of the head of a run, listwise windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import kept, names_in
from .ranking import settled


def rescored(run: DataFrame, model_score: str, head: int) -> DataFrame:
    """The first `head` passages of each query in the order of the model's score (ties as they were), the others after
    them as they were; the score is 1 / new rank."""
    in_head = F.col("rank") <= head
    w = W.partitionBy("qid", in_head).orderBy(F.when(in_head, F.col(model_score)).desc(), "rank")
    new = F.when(in_head, F.row_number().over(w)).otherwise(F.col("rank")).cast("int")
    return run.withColumn("new_rank", new).select("qid", "docid", settled(1.0 / F.col("new_rank")).alias("score"), F.col("new_rank").alias("rank"))


def scored(pairs: DataFrame, score: Callable[[list[str], list[str]], np.ndarray], batch: int = 50) -> DataFrame:
    """Add model_score from columns query and contents by a model that the caller supplies."""

    def work(frames):
        for f in frames:
            parts = [np.asarray(score(f["query"].iloc[i : i + batch].tolist(), f["contents"].iloc[i : i + batch].tolist()), float) for i in range(0, len(f), batch)]
            yield f.assign(model_score=np.concatenate(parts) if parts else np.zeros(0))

    return pairs.mapInPandas(work, T.StructType(list(pairs.schema)).add("model_score", "double"))


def pointwise_prompt(query: Column, document: Column) -> Column:
    return F.format_string("Query: %s Document: %s Relevant:", query, document)


def overlap(query_words: Column, words: Column) -> Column:
    """A stand-in for a model: the share of the query's distinct words that the passage has."""
    q = F.array_distinct(query_words)
    return settled(F.coalesce(F.size(F.array_intersect(q, words)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)))


def encoder_pair(query: Column, document: Column) -> tuple[Column, Column]:
    """What a pairwise encoder reads: the query's and the document's side, each with its prefix."""
    return F.concat(F.lit("query: "), query), F.concat(F.lit("document: "), document)


def window_starts(head: int, window: int, step: int) -> list[tuple[int, int]]:
    """(start, end) of listwise windows from place `head` of a ranking to its start; they end when a start would be negative."""
    out, end = [], head
    start = head - window
    while start >= 0:
        out.append((start, end))
        start, end = start - step, end - step
    return out


def repaired(named: list[int], n: int) -> list[int]:
    """0-based order from 1-based places: out of range and repeats go, missing ones follow."""
    seen = list(dict.fromkeys(x - 1 for x in named if 1 <= x <= n))
    return seen + [i for i in range(n) if i not in set(seen)]


def listwise(run: DataFrame, permute: Callable[[str, list[str]], list[int]], window: int = 20, step: int = 10, head: int = 100) -> DataFrame:
    """Sliding-window listwise reranking of each query's first `head` passages (columns qid, query, docid, contents,
    score, rank): permute(query, contents) names places from 1. Passages move, scores stay at their places, and so do all
    passages after the head. Windows are counted from place `head` whether or not a query has so many; a window beyond
    the end is what there is of it. Only heads, of a bounded size, are brought together by query."""
    out = run.select("qid", "docid", "score", F.col("rank").cast("int").alias("rank"))

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        rows = list(zip(f["docid"], f["contents"]))
        for start, end in window_starts(head, window, step):
            if part := rows[start:end]:
                rows[start:end] = [part[i] for i in repaired(permute(f["query"].iloc[0], [c for _, c in part]), len(part))]
        return pd.DataFrame({"qid": f["qid"].to_numpy(), "docid": [d for d, _ in rows], "score": f["score"].to_numpy(), "rank": f["rank"].to_numpy()})

    first = run.filter(F.col("rank") <= head).groupBy("qid").applyInPandas(work, out.schema)
    return first.unionByName(out.filter(F.col("rank") > head))


def listwise_rounds(run: DataFrame, permute: Callable[[list[str], list[list[str]]], list[list[int]]], folder: str, window: int = 20, step: int = 10, head: int = 100, batch: int = 8) -> DataFrame:
    """listwise, one window of all queries at a time: permute(queries, contents of each) answers a batch of prompts at once.

    A round's prompts are made by a join of the order so far (ids alone) with the window's texts, and its answers are
    written under `folder` before the next round begins. A round that is there is read and not asked again: a lost executor
    repeats its own tasks' prompts of one round at most, and a job that starts anew with the same folder goes on after
    the last whole round. Give each run and setting a folder of its own.
    """
    spark = run.sparkSession
    out = run.select("qid", "docid", "score", F.col("rank").cast("int").alias("rank"))
    first = run.filter(F.col("rank") <= head)
    # place from 0 of each passage, by number among the query's head
    order = first.select("qid", "docid", (F.row_number().over(W.partitionBy("qid").orderBy("rank")) - 1).alias("place"))
    texts = first.select("qid", "docid", "query", "contents")
    answer = T.StructType([run.schema["qid"], T.StructField("named", T.ArrayType(T.IntegerType()))])

    def ask(frames):
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                contents = [list(x) for x in part["contents"]]
                got = permute(part["query"].tolist(), contents)
                yield pd.DataFrame({"qid": part["qid"].to_numpy(), "named": [repaired(list(g), len(c)) for g, c in zip(got, contents)]})

    for start, end in window_starts(head, window, step):
        path = f"{folder}/round-{start}-{end}"
        inside = order.filter((F.col("place") >= start) & (F.col("place") < end))
        if "_SUCCESS" not in names_in(spark, path):
            sorted_ = F.array_sort(F.collect_list(F.struct("place", "contents")))
            prompts = inside.join(texts, ["qid", "docid"]).groupBy("qid").agg(F.first("query").alias("query"), F.transform(sorted_, lambda x: x["contents"]).alias("contents"))
            prompts.mapInPandas(ask, answer).write.mode("overwrite").parquet(path)
        answers = spark.read.schema(answer).parquet(path)
        # named holds, for each new place, the old one within the window
        moved = F.array_position("named", F.col("place") - start) - 1 + start
        order = order.join(answers, "qid", "left").withColumn("place", F.when((F.col("place") >= start) & (F.col("place") < end), moved).otherwise(F.col("place")).cast("int")).drop("named")
        order = kept(order)
    scores = first.select("qid", F.col("score"), F.col("rank").cast("int").alias("rank"), (F.row_number().over(W.partitionBy("qid").orderBy("rank")) - 1).alias("place"))
    return order.join(scores, ["qid", "place"]).select("qid", "docid", "score", "rank").unionByName(out.filter(F.col("rank") > head))
