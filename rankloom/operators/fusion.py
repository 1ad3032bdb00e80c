"""Fusion of ranked lists: runs (list_id, qid, docid, score, rank) -> run (qid, docid, score, rank)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import ranked, settled


def linear_weighted(first: DataFrame, second: DataFrame, alpha: float = 0.1, k: int = 1000) -> DataFrame:
    """s0 + alpha * s1 over the passages of either list; a passage that a list lacks has that list's least score for the
    query. Queries are those of the first list; presence, not a score of zero, decides what is missing."""
    a = first.select("qid", "docid", F.col("score").alias("s0"), F.lit(None).cast("double").alias("s1"))
    b = second.join(first.select("qid").distinct(), "qid", "left_semi").select("qid", "docid", F.lit(None).cast("double").alias("s0"), F.col("score").alias("s1"))
    each = a.unionByName(b).groupBy("qid", "docid").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    w = W.partitionBy("qid")
    s0 = F.coalesce("s0", F.min("s0").over(w), F.lit(0.0))
    s1 = F.coalesce("s1", F.min("s1").over(w), F.lit(0.0))
    return ranked(each.select("qid", "docid", settled(s0 + alpha * s1).alias("score")), ["qid"], k)


def fold(lists: list[DataFrame], alphas: list[float], k: int = 1000) -> DataFrame:
    """linear_weighted over the lists from left to right, cut to k after each step."""
    out = lists[0]
    for other, alpha in zip(lists[1:], alphas, strict=True):
        out = linear_weighted(out, other, alpha, k)
    return out


def linear_combination(runs: DataFrame, weights: DataFrame, k: int = 1000, missing: str = "min") -> DataFrame:
    """The weighted sum of scores, weights (qid, list_id, weight). A passage that a list lacks has the list's least score
    for the query (missing='min') or 0 ('zero'); a list without the query adds nothing. Queries are those of list 0.

    sum w * s over all lists = sum w * least + sum over the lists that hold it of w * (s - least): one grouped sum
    and a constant a query, without a row for every passage and list.
    """
    own = runs.filter("list_id = 0").select("qid").distinct()
    each = runs.join(own, "qid", "left_semi").groupBy("qid", "list_id", "docid").agg(F.max_by("score", "rank").alias("score"))
    least = F.min("score").over(W.partitionBy("qid", "list_id")) if missing == "min" else F.lit(0.0)
    each = each.withColumn("_least", least).join(weights, ["qid", "list_id"])
    rest = each.groupBy("qid", "list_id").agg(F.first("_least").alias("_least"), F.first("weight").alias("weight")).groupBy("qid").agg(F.sum(F.col("_least") * F.col("weight")).alias("_rest"))
    total = each.groupBy("qid", "docid").agg(F.sum(F.col("weight") * (F.col("score") - F.col("_least"))).alias("_sum")).join(rest, "qid")
    return ranked(total.select("qid", "docid", settled(F.col("_sum") + F.col("_rest")).alias("score")), ["qid"], k)


def same_weights(runs: DataFrame, values: list[float]) -> DataFrame:
    """One weight a list for every query of list 0."""
    pairs = F.array(*(F.struct(F.lit(i).alias("list_id"), F.lit(float(v)).alias("weight")) for i, v in enumerate(values)))
    return runs.filter("list_id = 0").select("qid").distinct().select("qid", F.explode(pairs).alias("x")).select("qid", "x.list_id", "x.weight")


def reciprocal_rank(runs: DataFrame, k: int = 1000, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank), rank from 1."""
    return ranked(runs.groupBy("qid", "docid").agg(settled(F.sum(1.0 / (constant + F.col("rank")))).alias("score")), ["qid"], k)


def concatenation(runs: DataFrame) -> DataFrame:
    """Passages in the order of list and rank, each at its first place and with its score there; then ranked by score.
    first_list and first_rank keep that place."""
    first = runs.groupBy("qid", "docid").agg(F.min_by("score", F.struct("list_id", "rank")).alias("score"), F.min(F.struct("list_id", "rank")).alias("_at"))
    return ranked(first.select("qid", "docid", "score", F.col("_at.list_id").alias("first_list"), F.col("_at.rank").alias("first_rank")), ["qid"])


def queries_lacking(runs: DataFrame, first: int = 0, second: int = 1) -> DataFrame:
    """qid of the queries that list `first` has and list `second` lacks."""
    qids = lambda i: runs.filter(F.col("list_id") == i).select("qid").distinct()
    return qids(first).join(qids(second), "qid", "left_anti")


def draw_order(n: int, seed: int = 42) -> list[int]:
    """The order in which lists are drawn from: one shuffle of the seed, used at every rank."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def round_robin(runs: DataFrame, n_lists: int, k: int = 1000, seed: int = 42) -> DataFrame:
    """Lists in turn, rank by rank down to the end of the shortest, each passage at its first place. If k are reached,
    the first k score 1 / place; otherwise passages keep their scores and are ranked by them. A query that a list lacks
    has a shortest list of length 0, so nothing is drawn and it is not in the result."""
    turn = F.array(*(F.lit(draw_order(n_lists, seed).index(i)) for i in range(n_lists)))
    depth = runs.groupBy("qid", "list_id").agg(F.max("rank").alias("_n")).groupBy("qid").agg(F.min("_n").alias("_n"), F.count("*").alias("_lists"))
    near = runs.join(depth, "qid").filter((F.col("_lists") == n_lists) & (F.col("rank") <= F.least("_n", F.lit(k))))
    at = F.struct("rank", F.get(turn, F.col("list_id")).alias("turn"))
    once = near.groupBy("qid", "docid").agg(F.min_by("score", at).alias("score"), F.min(at).alias("_at"))
    place = F.row_number().over(W.partitionBy("qid").orderBy("_at"))
    once = once.withColumn("_place", place).withColumn("_all", F.count("*").over(W.partitionBy("qid")))
    full = F.col("_all") >= k
    once = once.filter(~full | (F.col("_place") <= k)).withColumn("score", settled(F.when(full, 1.0 / F.col("_place")).otherwise(F.col("score"))))
    return ranked(once.select("qid", "docid", "score"), ["qid"])


LEVELS = "abcd"


def level_weight(level: Column, kind: int = 1, most: float = 0.75, levels: int = 4) -> Column:
    """The weight of a personalization level. kind 1: from 0 at a to `most`; 2: from most / levels; 3: fixed steps."""
    place = F.instr(F.lit(LEVELS[:levels]), level)
    if kind == 1:
        return F.when(place > 0, most / (levels - 1) * (place - 1))
    if kind == 2:
        return F.when(place > 0, most / levels * place)
    return F.when(level == "a", 0.4).when(level == "b", 0.5).when(level.isin("c", "d"), 0.6)


def level_weights(levels: DataFrame, base: tuple[float, ...] = (1.0, 0.1)) -> DataFrame:
    """(qid, list_id, weight) from (qid, level): fixed weights of the first lists, and the level's for the last."""
    all_ = [F.struct(F.lit(i).alias("list_id"), F.lit(v).alias("weight")) for i, v in enumerate(base)]
    all_.append(F.struct(F.lit(len(base)).alias("list_id"), level_weight(F.col("level"), 3).alias("weight")))
    return levels.select("qid", F.explode(F.array(*all_)).alias("x")).select("qid", "x.list_id", "x.weight")


def three_weights(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """Weights of three lists from those of (list 0, list 1) and of (their fusion, list 2): [a, b, d(a + b) / c]."""
    (a, b), (c, d) = first, second
    return F.array(a, b, d * (a + b) / F.nullif(c, F.lit(0.0)))
