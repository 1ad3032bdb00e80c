"""Conversation turns: nested topic files, flat turn files, and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.conversation import submission_id

TOPICS = "number string, title string, ptkb map<string,string>, turns array<struct<turn_id:string,utterance:string,response:string,response_provenance:array<string>,resolved_utterance:string,ptkb_provenance:array<int>>>"
TURNS = (
    "turn_id string, conversation_id string, title string, current_utterance string, current_response string, oracle_utterance string, response_provenance array<string>, "
    "context_utterances array<string>, ptkb map<string,string>, ptkb_provenance array<int>, reformulations array<struct<reformulation_name:string,reformulated_query:string,ptkb_provenance:array<int>>>, "
    "results array<struct<collection:string,retrieval_model:string,reranker:string,generation_model:string,retrieval_query_type:string,reranking_query_type:string,generation_query_type:string,metrics:map<string,double>,response:string>>"
)


def from_topics(topics: DataFrame) -> DataFrame:
    """One row a turn, with the utterances of the conversation's earlier turns as context."""
    t = topics.select("number", "title", "ptkb", F.posexplode("turns").alias("pos", "t"))
    before = W.partitionBy("number").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return t.select(
        F.concat_ws("-", "number", "t.turn_id").alias("turn_id"), F.col("number").alias("conversation_id"), "title", F.col("t.utterance").alias("current_utterance"), F.col("t.response").alias("current_response"),
        F.col("t.resolved_utterance").alias("oracle_utterance"), "t.response_provenance", F.collect_list("t.utterance").over(before).alias("context_utterances"), "ptkb", "t.ptkb_provenance",
    )


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return from_topics(spark.read.schema(TOPICS).option("multiLine", True).json(path))


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns from JSON lines; of reformulations of one name, and of results of one key, the last stays."""
    t = spark.read.schema(TURNS).json(path)
    last = lambda column, key: F.filter(column, lambda x, i: ~F.exists(F.slice(column, i + 2, F.size(column)), lambda y: key(y).eqNullSafe(key(x))))
    result_key = lambda x: F.struct(*(x[c] for c in ("collection", "retrieval_model", "reranker", "generation_model", "retrieval_query_type", "reranking_query_type", "generation_query_type")))
    return t.withColumn("reformulations", last(F.col("reformulations"), lambda x: x["reformulation_name"])).withColumn("results", last(F.col("results"), result_key))


def sliced(turns: DataFrame, order: str, start: int = 0, end: int = -1) -> DataFrame:
    """Turns from place start to place end, both included; -1 is the last."""
    return turns.filter((F.col(order) >= start) & ((F.lit(end) == -1) | (F.col(order) <= end)))


def write_turns(turns: DataFrame, path: str) -> None:
    turns.write.mode("overwrite").json(path)


def submission(run: DataFrame, responses: DataFrame, top_k: int, name: str, kind: str = "automatic") -> DataFrame:
    """One row: run_name, run_type, turns, each turn with its response and the passages in rank order, used being rank <=
    top_k. run: qid, docid, score, rank; responses: qid, text. A submission is one document, as its readers expect."""
    passages = run.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("docid").cast("string").alias("id"), "score", (F.col("rank") <= top_k).alias("used")))).alias("p"))
    rows = responses.join(passages, "qid").select(submission_id(F.col("qid").cast("string")).alias("turn_id"), F.array(F.struct(F.lit(1).alias("rank"), "text", F.array().cast("array<int>").alias("ptkb_provenance"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["used"].alias("used"))).alias("passage_provenance"))).alias("responses"))
    return rows.agg(F.lit(name).alias("run_name"), F.lit(kind).alias("run_type"), F.array_sort(F.collect_list(F.struct("turn_id", "responses"))).alias("turns"))
