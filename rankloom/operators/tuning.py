"""Search for fusion weights over a grid, all trials and groups in one plan: a query's passages times all trials is a product
of matrices, of which only the measures leave the task."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fusion
from .metrics import ideal, judged, mean, per_query
from .ranking import settled


def grid(n_lists: int, steps: int) -> list[tuple[float, ...]]:
    """All weights in steps of 1 / steps that sum to 1, counted in whole steps so that rounding loses none, in order."""

    def shares(n: int, left: int):
        if n == 1:
            yield (left,)
            return
        for x in range(left + 1):
            yield from ((x, *rest) for rest in shares(n - 1, left - x))

    return [tuple(x / steps for x in p) for p in shares(n_lists, steps)]


def trial_rows(trials: list[tuple[float, ...]]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("trial"), F.array(*map(F.lit, t)).alias("w")) for i, t in enumerate(trials)))


def score_rows(runs: DataFrame, n_lists: int, least: bool = False) -> DataFrame:
    """qid, docid, s0, s1, ...: the passage's score in each list; where it isn't, 0 or the list's least score for the query."""
    cells = runs.groupBy("qid", "docid").agg(*(F.max(F.when(F.col("list_id") == i, F.col("score"))).alias(f"s{i}") for i in range(n_lists)))
    whole = W.partitionBy("qid")
    low = lambda i: F.coalesce(F.min(f"s{i}").over(whole), F.lit(0.0)) if least else F.lit(0.0)
    return cells.select("qid", "docid", *(F.coalesce(f"s{i}", low(i)).cast("double").alias(f"s{i}") for i in range(n_lists)))


#: Trials whose scores for one query's passages are held at once.
TRIALS_AT_ONCE = 256


def fused_keys(f: pd.DataFrame, n_lists: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the passages of a query, sorted by docid, and some trials (rows of weights): fused scores in millionths, and keys
    that order as score and then docid do; both passages x trials."""
    total = np.zeros((len(f), len(weights)))
    for i in range(n_lists):  # in the order of the lists, as a row's sum is
        total = total + np.outer(f[f"s{i}"].to_numpy(), weights[:, i])
    score = np.floor(total * 1e6 + 0.5).astype(np.int64)
    return score, score * len(f) + np.arange(len(f) - 1, -1, -1)[:, None]


def first_places(keys: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k greatest keys of each column, greatest first."""
    k = min(k, len(keys))
    top = np.argpartition(keys, len(keys) - k, axis=0)[len(keys) - k :]
    order = np.argsort(-np.take_along_axis(keys, top, 0), axis=0)
    return np.take_along_axis(top, order, 0)


def by_query(cells: DataFrame, schema: str, trials: list[tuple[float, ...]], n_lists: int, measure) -> DataFrame:
    """One row for each query and trial: measure(f, score, keys) gives its columns for a query's passages f and some trials. A
    query's passages are as many as its lists are deep together; they are brought together, and of all their fused scores
    only the measures are handed on."""
    weights = np.array(trials, float)

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("docid", kind="stable").reset_index(drop=True)
        out = []
        for at in range(0, len(weights), TRIALS_AT_ONCE):
            part = weights[at : at + TRIALS_AT_ONCE]
            columns = measure(f, *fused_keys(f, n_lists, part))
            out.append(pd.DataFrame({"qid": f["qid"].iloc[0], "trial": np.arange(at, at + len(part), dtype=np.int32), **columns}))
        return pd.concat(out)

    kind = cells.schema["qid"].dataType.simpleString()
    return cells.groupBy("qid").applyInPandas(work, f"qid {kind}, trial int, {schema}")


def with_weights(objectives: DataFrame, trials: list[tuple[float, ...]]) -> DataFrame:
    """Add each trial's weights; the grid is fixed and small."""
    table = objectives.sparkSession.createDataFrame([(i, list(map(float, t))) for i, t in enumerate(trials)], "trial int, w array<double>")
    return objectives.join(F.broadcast(table), "trial").select("grp", "trial", "w", "objective")


def best(objectives: DataFrame, keys: list[str]) -> DataFrame:
    """The first trial with the highest objective, for each value of keys."""
    order = W.partitionBy(*keys).orderBy(F.col("objective").desc(), "trial")
    return objectives.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def supervised(runs: DataFrame, qrels: DataFrame, groups: DataFrame, n_lists: int, trials: list[tuple[float, ...]], terms: tuple[str, ...] = ("mrr", "ndcg@3", "recall@10", "recall@100")) -> DataFrame:
    """grp, trial, w, objective of every trial: the mean over a group's judged queries of the sum of terms, which are mrr,
    ndcg@k, recall@k and precision@k; one term tunes for a single measure. groups: (qid, grp); one value of grp tunes for
    all queries together."""
    parts = [(name, int(k or 0)) for name, _, k in (t.partition("@") for t in terms)]
    if bad := [t for t, (name, k) in zip(terms, parts) if name not in ("mrr", "ndcg", "recall", "precision") or (name != "mrr") != bool(k)]:
        raise ValueError(f"unknown measures {bad}")
    cells = judged(score_rows(runs, n_lists), qrels)
    at_dcg, at_hit = (sorted({k for name, k in parts if name in names}) for names in (("ndcg",), ("recall", "precision")))

    def measure(f: pd.DataFrame, score: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
        rel = f["rel"].to_numpy()
        good = rel > 0
        first = (keys > keys[good].max(0)).sum(0) + 1.0 if good.any() else np.full(keys.shape[1], np.nan)
        top = first_places(keys, max([1, *at_dcg, *at_hit]))
        gain = np.maximum(rel, 0)[top] / np.log2(np.arange(2, len(top) + 2))[:, None]
        hit = good[top].astype(float)
        return {"_first": first, **{f"_dcg_{k}": gain[:k].sum(0) for k in at_dcg}, **{f"_hit_{k}": hit[:k].sum(0) for k in at_hit}}

    schema = ", ".join(["_first double", *(f"_dcg_{k} double" for k in at_dcg), *(f"_hit_{k} double" for k in at_hit)])
    q = by_query(cells, schema, trials, n_lists, measure).join(ideal(qrels, tuple(at_dcg)), "qid").join(groups, "qid")
    q = q.withColumn("_first", F.nanvl("_first", F.lit(None).cast("double")))
    value = {
        "mrr": lambda _: 1.0 / F.col("_first"),
        "ndcg": lambda k: F.try_divide(F.col(f"_dcg_{k}"), F.col(f"idcg_{k}")),
        "recall": lambda k: F.try_divide(F.col(f"_hit_{k}"), F.col("num_rel").cast("double")),
        "precision": lambda k: F.col(f"_hit_{k}") / float(k),
    }
    total = reduce(add, (F.coalesce(value[name](k), F.lit(0.0)) for name, k in parts))
    return with_weights(q.groupBy("grp", "trial").agg(settled(F.avg(total)).alias("objective")), trials)


def by_score(runs: DataFrame, groups: DataFrame, n_lists: int, trials: list[tuple[float, ...]], top: int = 100) -> DataFrame:
    """grp, trial, w, objective without judgements: the sum of fused scores over each query's first `top` passages, a
    missing passage having its list's least score."""

    def measure(f: pd.DataFrame, score: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
        return {"total": np.take_along_axis(score, first_places(keys, top), 0).sum(0)}

    q = by_query(score_rows(runs, n_lists, True), "total long", trials, n_lists, measure).join(groups, "qid")
    return with_weights(q.groupBy("grp", "trial").agg(settled(F.sum("total") / 1e6).alias("objective")), trials)


def weights_of(chosen: DataFrame, groups: DataFrame) -> DataFrame:
    """(qid, list_id, weight) from each group's chosen trial."""
    return groups.join(chosen, "grp").select("qid", F.posexplode("w").alias("list_id", "weight"))


def measured(runs: DataFrame, qrels: DataFrame, chosen: DataFrame, groups: DataFrame, k: int = 1000) -> DataFrame:
    """The mean measures of each group's queries under its chosen weights, beside these: grp, trial, w, objective, n_queries
    and the measures. A missing passage has its list's least score."""
    run = fusion.linear_combination(runs, weights_of(chosen, groups), k)
    return chosen.join(mean(per_query(run, qrels).join(groups, "qid"), ("grp",)), "grp")


def two_plus_one(runs: DataFrame, qrels: DataFrame, groups: DataFrame, steps: int, k: int = 1000) -> DataFrame:
    """Lists 0 and 1 are tuned together for all queries and fused; that list and list 2 are tuned by group and fused."""
    trials = grid(2, steps)
    everyone = groups.select("qid", F.lit("all").alias("grp"))
    pair = runs.filter("list_id < 2")
    first = best(supervised(pair, qrels, everyone, 2, trials), ["grp"])
    both = fusion.linear_combination(pair, weights_of(first, everyone), k)
    second = both.withColumn("list_id", F.lit(0)).unionByName(runs.filter("list_id = 2").withColumn("list_id", F.lit(1)).select("qid", "docid", "score", "rank", "list_id"))
    chosen = best(supervised(second, qrels, groups, 2, trials), ["grp"])
    return fusion.linear_combination(second, weights_of(chosen, groups), k)
