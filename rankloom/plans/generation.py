"""Rewrites and answers by a caller's model: prompt, model, parser, and what is written back to the turns."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing
from ..operators.conversation import upserted
from ..sources.passages import with_contents

#: What the names of a rewrite's parts end in.
SUFFIXES = {"cot": "_cot", "level": "_lv", "rewrite": "_rw", "response": "_rs"}


def answered(prompts: DataFrame, generate: Callable[[list[str]], list[str | None]], batch: int = 16) -> DataFrame:
    """Add answer to rows with a prompt; prompts reach the model in batches, null ones don't."""

    def work(frames):
        for f in frames:
            out: list = [None] * len(f)
            at = [i for i, p in enumerate(f["prompt"].tolist()) if p is not None]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, a in zip(part, generate([f["prompt"].iloc[i] for i in part])):
                    out[i] = a
            yield f.assign(answer=out)

    return prompts.mapInPandas(work, T.StructType(list(prompts.schema)).add("answer", "string"))


def rewritten(turns: DataFrame, prompt: Column, generate: Callable, parse: Callable[[Column], Column], name: str, old: DataFrame | None = None) -> DataFrame:
    """turn_id, name, query, seq: the fields of each turn's parsed answer under name and the field's suffix, put over old
    rows of the same columns. A turn whose answer breaks the parser's contract is skipped, and so keeps its old rows."""
    got = answered(turns.select("turn_id", prompt.alias("prompt")), generate).select("turn_id", parse(F.col("answer")).alias("x")).filter("x is not null")
    fields = [f.name for f in got.schema["x"].dataType.fields if f.name in SUFFIXES]
    each = F.array(*(F.struct(F.lit(name + SUFFIXES[f]).alias("name"), F.col("x")[f].alias("query")) for f in fields))
    new = got.select("turn_id", F.explode(each).alias("y")).select("turn_id", "y.name", "y.query", F.lit(0).cast("long").alias("seq")).filter("query is not null")
    if old is None:
        return new
    return upserted(old.select("turn_id", "name", "query", F.col("seq").cast("long").alias("seq")), new, ["turn_id", "name"])


def several(turns: DataFrame, prompt: Column, generate: Callable, name: str, n: int, filler: str) -> DataFrame:
    """turn_id, name, query, seq of n queries each, name_1 to name_n; an answer with fewer is filled up with the filler, and one
    that breaks the contract gives fillers alone."""
    got = answered(turns.select("turn_id", prompt.alias("prompt")), generate)
    queries = parsing.pad_queries(F.coalesce(parsing.parse_queries(F.col("answer")), F.array().cast("array<string>")), n, filler)
    return got.select("turn_id", F.posexplode(queries).alias("i", "query")).select("turn_id", F.concat(F.lit(f"{name}_"), (F.col("i") + 1).cast("string")).alias("name"), "query", F.lit(0).cast("long").alias("seq"))


def responses(turns: DataFrame, queries: DataFrame, run: DataFrame, passages: DataFrame, generate: Callable | None, top_k: int = 5, kind: str = "raw", instruction: str = "Answer the current turn from the passages. Begin with `Response: `.") -> DataFrame:
    """qid, response: an answer to each query of the run from its first top_k passages, the conversation and the profile; null
    if the model's answer doesn't begin as asked. With another kind than raw nothing is generated, and the response says so.
    turns: qid, context (array), profile (array); queries: qid, generation."""
    if kind != "raw":
        return run.select("qid").distinct().select("qid", F.lit("No response generated").alias("response"))
    top = with_contents(run.filter(F.col("rank") <= top_k).select("qid", "rank", "docid"), passages).filter("contents is not null")
    found = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "contents"))), lambda x: x["contents"]).alias("found"))
    rows = run.select("qid").distinct().join(turns.select("qid", "context", "profile"), "qid").join(queries.select("qid", "generation"), "qid").join(found, "qid", "left")
    shown = F.when(F.size("found") > 0, F.concat(F.lit("Passages:\n"), parsing.numbered(F.col("found"))))
    prompt = F.concat_ws("\n\n", shown, parsing.prompt(instruction, F.col("generation"), F.col("context"), F.col("profile")))
    return answered(rows.select("qid", prompt.alias("prompt")), generate).select("qid", parsing.parse_prefixed(F.col("answer"), "Response: ").alias("response"))


def read_demonstrations(spark: SparkSession, path: str, cot: str | None = None) -> str:
    """A JSON file of demos as text (see parsing.demonstrations); without the file a warning, and no text."""
    try:
        text = spark.read.option("wholetext", True).text(path).first()
    except Exception as e:  # Spark names a missing path only when it looks for it
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = None
    if text is None:
        warnings.warn(f"no demonstrations in {path}", stacklevel=2)
        return ""
    return parsing.demonstrations(json.loads(text[0]), cot)
