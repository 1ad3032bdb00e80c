"""Lexical retrieval: postings, BM25, its explanation, and relevance-model feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import kept, small
from .impacts import best_in_blocks
from .index import Index, as_index, index_once, index_texts, joined, postings, term_lists, term_stats, write_index  # noqa: F401
from .ranking import ranked, settled


def query_terms(queries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, qtf of queries with an array column `words`."""
    return queries.select(*keys, F.explode("words").alias("term")).groupBy(*keys, "term").agg(F.count("*").cast("double").alias("qtf"))


def known_terms(weights: DataFrame, index: Index) -> DataFrame:
    """weights (keys, term, qtf) of terms that the index has, with df, avgdl and weight (qtf * idf); written."""
    n = F.col("n_docs")
    known = weights.join(index.terms.select("term", "df"), "term").crossJoin(F.broadcast(index.stats.select("n_docs", "avgdl")))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return kept(known.withColumn("weight", F.col("qtf") * idf).drop("n_docs"))


def saturation(k1: float, b: float) -> Column:
    """The share of its weight that a term adds to a passage, by tf, dl and avgdl."""
    tf = F.col("tf")
    return tf / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def contributions(weights: DataFrame, lists: DataFrame | Index, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """What each query term adds to each passage: keys, docid, term, tf, df, part. weights: keys, term, qtf; lists: a stored
    index, or term lists.

    The queries' weights meet the terms' statistics first, are written, and then meet the postings of these terms; they
    are broadcast while they are few. A stored index has all postings of a passage in one place, so that what follows
    sums them up without an exchange.
    """
    index = as_index(lists)
    known, rows = index.met_by(known_terms(weights, index))
    return known.join(rows, "term").withColumn("part", F.col("weight") * saturation(k1, b))


def bm25(weights: DataFrame, lists: DataFrame | Index, keys: list[str], k: int = 1000, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """The k best passages for each query.

    Each posting of the queries' terms is read once, however many queries have the term, and passages meet queries in
    blocks, as in impacts.search. There a sum of 0 means that no term is shared; where a weight isn't above 0, as that of
    a term that feedback has rounded away, what each term adds is summed row by row.
    """
    index = as_index(lists)
    known = known_terms(weights, index)
    n, odd = known.agg(F.count("*"), F.count_if(~F.coalesce(F.col("weight") > 0, F.lit(False)))).first()
    if odd or not (k1 >= 0 and 0 <= b <= 1):
        few, rows = index.met_by(known)
        scored = few.join(rows, "term").groupBy(*keys, "docid").agg(F.sum(F.col("weight") * saturation(k1, b)).alias("score"))
    else:
        words = kept(known.select("term", "avgdl").distinct().withColumn("dim", F.monotonically_increasing_id()))
        asked = small(words.select("term", "dim")).join(known, "term").select(F.struct(*keys).alias("qid"), "dim", F.col("weight").alias("q"))
        few, rows = index.met_by(words)
        best = best_in_blocks(asked, few.join(rows, "term").select("docid", "dim", saturation(k1, b).alias("value")), k, n)
        scored = best.select(*(F.col("qid")[c].alias(c) for c in keys), "docid", "score")
    return ranked(scored.withColumn("score", settled(F.col("score"))), keys, k)


def bm25_explain(weights: DataFrame, lists: DataFrame | Index, keys: list[str], k: int = 10, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """The terms behind the k best passages: keys, docid, rank, term, tf, df, part. The best are written, and a stored index
    gives the terms of these passages alone, so that no other part is made or moved."""
    index = as_index(lists)
    best = kept(bm25(weights, index, keys, k, k1, b).drop("score"))
    rows = joined(best, index.of_passages(best).select("docid", "term", "tf", "dl"), "docid")
    parts = rows.join(small(known_terms(weights, index)), [*keys, "term"])
    return parts.select(*keys, "docid", "rank", "term", "tf", "df", settled(F.col("weight") * saturation(k1, b)).alias("part"))


def feedback_terms(weights: DataFrame, run: DataFrame, lists: DataFrame | Index, keys: list[str], fb_docs: int = 10, fb_terms: int = 10, original: float = 0.5) -> DataFrame:
    """Relevance-model query terms: keys, term, qtf. The head of the run is written, and a stored index gives the terms of its
    passages alone. Terms of the first fb_docs passages weigh by P(w|d) and the passage's share of score; the best fb_terms are mixed with the query's own distribution, which weighs `original`."""
    each = W.partitionBy(*keys)
    top = kept(run.filter(F.col("rank") <= fb_docs).withColumn("share", F.col("score") / F.sum("score").over(each)).select(*keys, "docid", "share"))
    words = joined(top, as_index(lists).of_passages(top), "docid")
    model = words.groupBy(*keys, "term").agg(settled(F.sum(F.col("share") * F.col("tf") / F.col("dl"))).alias("score")).withColumnRenamed("term", "docid")
    best = ranked(model, keys, fb_terms).withColumnRenamed("docid", "term")
    given = weights.select(*keys, "term", (original * F.col("qtf") / F.sum("qtf").over(each)).alias("qtf"))
    fresh = best.select(*keys, "term", ((1 - original) * F.col("score") / F.sum("score").over(each)).alias("qtf"))
    return given.unionByName(fresh).groupBy(*keys, "term").agg(settled(F.sum("qtf")).alias("qtf"))
