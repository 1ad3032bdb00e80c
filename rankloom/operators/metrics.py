"""Ranking measures of a run (qid, docid, rank) against qrels (qid, docid, rel); rel > 0 is relevant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import kept, small
from .ranking import ranked, settled

NDCG_CUTS, P_CUTS, RECALL_CUTS = (1, 3, 5, 10), (1, 3, 5, 10, 20), (5, 10, 20, 50, 100, 1000)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with rel, 0 where nobody judged. The run is written, and broadcast to qrels while it is small: of these only the rows
    of its passages are then exchanged."""
    run = kept(run)
    near = qrels.select("qid", "docid", "rel").join(small(run.select("qid", "docid")), ["qid", "docid"], "left_semi")
    return run.join(near, ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


#: Places whose discounts are summed at once.
PLACES_AT_ONCE = 4096


def ideal(qrels: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """qid, num_rel and the best gain possible: idcg over all, idcg_<cut>. A query's passages are counted by rel, each of which
    fills a run of places, so that no judgement is exchanged or sorted by itself."""
    rel, n, end = F.col("rel"), F.col("_n"), F.col("_end")
    each = qrels.groupBy("qid", "rel").agg(F.count("*").alias("_n"))
    each = each.withColumn("_end", F.sum("_n").over(W.partitionBy("qid").orderBy(rel.desc()).rowsBetween(W.unboundedPreceding, 0)))
    # places without gain need no steps
    parts = F.when(rel > 0, F.sequence(end - n, end - 1, F.lit(PLACES_AT_ONCE))).otherwise(F.array(end - n))
    each = each.select("*", F.posexplode(parts).alias("_part", "_from"))

    def gain(last: Column) -> Column:
        """Of the places after _from, down to last."""
        places = F.sequence(F.col("_from") + 1, last)
        return F.when((rel > 0) & (last > F.col("_from")), F.aggregate(places, F.lit(0.0), lambda x, at: x + rel / F.log2(at + 1.0))).otherwise(0.0)

    last = F.least(end, F.col("_from") + PLACES_AT_ONCE)
    sums = [F.sum(gain(F.least(last, F.lit(c)))).alias(f"idcg_{c}") for c in cuts]
    relevant = (rel > 0).cast("long") * F.when(F.col("_part") == 0, n).otherwise(0)
    return each.groupBy("qid").agg(F.sum(relevant).alias("num_rel"), F.sum(gain(last)).alias("idcg"), *sums)


def per_query(run: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = (), trec_ties: bool = False) -> DataFrame:
    """One row a query (and keys, such as a run's name) that has judgements: num_rel, map, ndcg, ndcg_cut_k, p_k,
    recall_k, recip_rank. Queries without judgements are left out; p_k divides by k however few were found. With trec_ties
    ranks are made anew from the scores, equal ones from the greatest docid, as the usual evaluation program has it."""
    group = [*keys, "qid"]
    run = ranked(run.drop("rank"), group, ties_down=True) if trec_ties else run
    r = judged(run, qrels)
    hit = (F.col("rel") > 0).cast("long")
    r = r.withColumn("_hits", F.sum(hit).over(W.partitionBy(*group).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    gain = F.greatest(F.col("rel"), F.lit(0)) / F.log2(F.col("rank") + 1.0)
    sums = [F.sum(F.when(F.col("rel") > 0, F.col("_hits") / F.col("rank")).otherwise(0.0)).alias("_ap"), F.sum(gain).alias("_dcg"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("_first")]
    sums += [F.sum(F.when(F.col("rank") <= c, gain).otherwise(0.0)).alias(f"_dcg_{c}") for c in NDCG_CUTS]
    sums += [F.sum(F.when(F.col("rank") <= c, hit).otherwise(0)).alias(f"_hit_{c}") for c in sorted({*P_CUTS, *RECALL_CUTS})]
    q = r.groupBy(*group).agg(*sums).join(ideal(qrels, NDCG_CUTS), "qid")
    ratio = lambda a, b: settled(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    n = F.col("num_rel").cast("double")
    out = [ratio(F.col("_ap"), n).alias("map"), ratio(F.col("_dcg"), F.col("idcg")).alias("ndcg"), settled(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("recip_rank")]
    out += [ratio(F.col(f"_dcg_{c}"), F.col(f"idcg_{c}")).alias(f"ndcg_cut_{c}") for c in NDCG_CUTS]
    out += [settled(F.col(f"_hit_{c}") / float(c)).alias(f"p_{c}") for c in P_CUTS]
    out += [ratio(F.col(f"_hit_{c}").cast("double"), n).alias(f"recall_{c}") for c in RECALL_CUTS]
    return q.select(*group, "num_rel", *out)


def mean(measures: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The mean of every measure over queries, and n_queries."""
    names = [c for c in measures.columns if c not in (*keys, "qid")]
    return measures.groupBy(*keys).agg(F.count("*").alias("n_queries"), *(settled(F.avg(c)).alias(c) for c in names))


def hit_rates(run: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10, 20, 30, 50, 100)) -> DataFrame:
    """By the rank of the first gold passage of each query of gold (qid, docid), from 0, 1000 if not found: the share
    found within each cut, MRR and NDCG as 1 / log2(rank + 2), all times 100 with two decimals."""
    at = gold.join(run, ["qid", "docid"], "left").groupBy("qid").agg(F.coalesce(F.min(F.col("rank") - 1), F.lit(1000)).alias("at"))
    rates = [F.round(100 * F.avg((F.col("at") < c).cast("double")), 2).alias(f"r_{c}") for c in cuts]
    return at.agg(F.count("*").alias("n_queries"), *rates, F.round(100 * F.avg(F.when(F.col("at") < 1000, 1.0 / (F.col("at") + 1)).otherwise(0.0)), 2).alias("mrr"), F.round(100 * F.avg(F.when(F.col("at") < 1000, 1.0 / F.log2(F.col("at") + 2.0)).otherwise(0.0)), 2).alias("ndcg"))
