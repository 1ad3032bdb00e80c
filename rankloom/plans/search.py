"""Search end to end: query texts, retrieval by terms, vectors or term weights, stored runs, fusion, reranking, files."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import passage_text, run_name, terms
from ..operators import lexical, rerank, vectors
from ..operators.conversation import evaluated, level_of, of_level, resolve
from ..operators.ranking import ranked
from ..sources import trec
from ..sources.passages import with_contents
from ..sources.storage import kept, literal, names_in, small
from . import runs
from .experiments import Config, fuse


@dataclass
class Collection:
    """What is searched; only what the retrieval model needs must be there."""

    passages: DataFrame | None = None  # docid, contents
    index: lexical.Index | None = None
    vectors: DataFrame | None = None  # docid, embedding
    weights: DataFrame | None = None  # dim, docid, value
    state: str = ""  # what tells collections apart in a run catalogue; without it the files and the plan of what is searched


@dataclass
class Models:
    """The caller's models: texts -> vectors; texts -> {term: weight} each; queries, passages -> scores; a query and passages
    -> places; prompts -> answers."""

    encode: Callable | None = None
    encode_terms: Callable | None = None
    score: Callable | None = None
    permute: Callable | None = None
    generate: Callable | None = None
    label: str = ""  # tells stored runs of different models of one kind apart


def prepared(turns: DataFrame) -> DataFrame:
    """Turns as conversation.resolve reads them: qid, current, oracle, queries, provenance, beside all columns of turns."""
    entries = F.transform(F.coalesce("reformulations", F.array().cast(turns.schema["reformulations"].dataType)), lambda x: F.struct(x["reformulation_name"], x["reformulated_query"]))
    return turns.withColumns({"qid": F.col("turn_id"), "current": F.col("current_utterance"), "oracle": F.col("oracle_utterance"), "queries": F.map_from_entries(entries), "provenance": F.coalesce("ptkb_provenance", F.array().cast("array<int>"))})


def query_list(turns: DataFrame, config: Config, ids: DataFrame | list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The turns' queries and the texts to be fused: (qid, level, retrieval, reranking, generation) and (list_id, qid, text).

    Turns are those among ids, where given, and of config.group; list_id is the place among config.queries, or 0 for the
    retrieval query where nothing is fused. A turn without a level has none; a text is null where its kind lacks a part.
    """
    t = prepared(turns if ids is None else evaluated(turns, ids))
    t = of_level(t.withColumn("level", level_of(config.level_type)), config.group)
    text = lambda kind: resolve(kind, config.fb_terms, config.query_weight)
    queries = t.select("qid", "level", text(config.retrieval_query).alias("retrieval"), text(config.reranking_query).alias("reranking"), text(config.generation_query).alias("generation"))
    kinds = config.queries if config.fusion != "none" and config.queries else (config.retrieval_query,)
    each = F.array(*(F.struct(F.lit(i).alias("list_id"), text(kind).alias("text")) for i, kind in enumerate(kinds)))
    return queries, t.select("qid", F.explode(each).alias("x")).select("x.list_id", "qid", "x.text")


def stored_run(names: list[str], query: str, model: str) -> str | None:
    """The first of the run names that stands for this query and retrieval model without a reranker."""
    for name in names:
        parts = re.findall(r"\[([^\]]+)\]", name)
        if len(parts) >= 5 and parts[0] == query and parts[3] == model and parts[4].split("_")[0] == "none":
            return name
    return None


def runs_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of runs, sorted; none if there is no folder. What begins with _ or . is no run."""
    return sorted(x for x in names_in(spark, folder) if x[0] not in "_.")


def retrieve(texts: DataFrame, collection: Collection, config: Config, models: Models | None = None) -> DataFrame:
    """Runs (list_id, qid, docid, score, rank) of all lists at once: texts (list_id, qid, text); by config.model BM25, dense
    (vectors by models.encode) or sparse (term weights by models.encode_terms)."""
    keys, models = ["list_id", "qid"], models or Models()
    texts = texts.filter("text is not null")
    if config.model == "BM25":
        weights = lexical.query_terms(texts.withColumn("words", terms(F.col("text"))), keys)
        run = lexical.bm25(weights, collection.index, keys, config.k, config.k1, config.b)
        if config.feedback:
            more = kept(lexical.feedback_terms(weights, run, collection.index, keys, config.fb_docs, config.fb_terms, config.original_weight))
            run = lexical.bm25(more, collection.index, keys, config.k, config.k1, config.b)
        return run
    if config.model == "dense":
        given = texts.select(*keys).distinct()
        numbered = kept(texts.select(*keys, "text").withColumn("n", F.xxhash64(*keys)))
        q = vectors.encoded(numbered.select(F.col("n").alias("qid"), "text"), "text", models.encode).select("qid", "embedding")
        run = vectors.dense(q, collection.vectors, config.k).withColumnRenamed("qid", "n")
        return run.join(small(kept(given.withColumn("n", F.xxhash64(*keys)))), "n").select(*keys, "docid", "score", "rank")
    if config.model == "sparse":
        encode_terms = models.encode_terms

        def work(frames):
            for f in frames:
                found = encode_terms(f["text"].tolist())
                f = f.assign(x=[[{"dim": str(d), "q": float(v)} for d, v in row.items()] for row in found])
                yield f[[*keys, "x"]]

        pair = T.StructType().add("dim", "string").add("q", "double")
        schema = texts.select(*keys).schema.add("x", T.ArrayType(pair))
        q = texts.select(*keys, "text").mapInPandas(work, schema).select(F.struct(*keys).alias("qid"), F.explode("x").alias("x")).select("qid", F.col("x.dim").alias("dim"), F.col("x.q").alias("q"))
        return vectors.sparse(q, collection.weights.withColumn("dim", F.col("dim").cast("string")), config.k).select("qid.*", "docid", "score", "rank")
    raise ValueError(f"no retrieval model {config.model!r}")


def reranked(run: DataFrame, queries: DataFrame, collection: Collection, config: Config, models: Models | None = None) -> DataFrame:
    """The head of a run in a model's order (config.reranker: none, pointwise, listwise); queries: qid, reranking."""
    if config.reranker == "none":
        return run.select("qid", "docid", "score", "rank")
    models = models or Models()
    head = run.filter(F.col("rank") <= config.rerank_k)
    asked = head.join(queries.select("qid", F.col("reranking").alias("query")), "qid")
    with_text = with_contents(asked, collection.passages).withColumn("contents", F.coalesce("contents", F.lit("")))
    if config.reranker == "listwise":
        new = rerank.listwise(with_text, models.permute, config.window, config.step, config.rerank_k)
        return new.unionByName(run.filter(F.col("rank") > config.rerank_k).select("qid", "docid", "score", "rank"))
    if config.reranker == "pointwise":
        scored = rerank.scored(with_text.select("qid", "docid", "score", "rank", "query", "contents"), models.score)
        tail = run.filter(F.col("rank") > config.rerank_k).select("qid", "docid", "score", "rank").withColumn("model_score", F.lit(None).cast("double"))
        return rerank.rescored(scored.select("qid", "docid", "score", "rank", "model_score").unionByName(tail), "model_score", config.rerank_k)
    raise ValueError(f"no reranker {config.reranker!r}")


def with_passages(run: DataFrame, passages: DataFrame, k: int = 100) -> DataFrame:
    """The first k of a run with their texts, white space made single: qid, docid, rank, score, content. passages: docid and
    contents, or title and text where there is a title (columns that aren't there count as null). Only passages of the
    run are read whole."""
    has = lambda c: F.col(c) if c in passages.columns else F.lit(None).cast("string")
    plain = F.trim(F.regexp_replace(F.coalesce(has("contents"), has("text"), F.lit("")), r"\s+", " "))
    content = F.when(has("title").isNotNull(), passage_text(has("title"), has("text"))).otherwise(plain)
    top = run.filter(F.col("rank") <= k).select("qid", "docid", "rank", "score")
    return small(top).join(passages, "docid").select("qid", "docid", "rank", "score", content.alias("content"))


def name_of(config: Config) -> str:
    """The name under which config's run is stored."""
    window = (config.window, config.step) if config.reranker == "listwise" else ()
    return run_name(config.retrieval_query, config.reranking_query, config.generation_query, config.model, config.reranker, config.rerank_k, "" if config.group == "all" else config.group, config.feedback, window)


def search(queries: DataFrame, texts: DataFrame, collection: Collection, config: Config, models: Models | None = None, qrels: DataFrame | None = None, folder: str | None = None, given: DataFrame | None = None) -> DataFrame:
    """The run (qid, docid, score, rank) that config asks for: a given one, or each list retrieved (or read from `folder`, where
    a run of the same texts, collection, model, depth and parameters is catalogued; see runs) and fused; then reranked;
    and, with a folder, stored there.

    queries and texts as query_list gives them; levels come from queries; qrels where weights are tuned by judgements.
    """
    spark = queries.sparkSession
    if given is None:
        lists = config.queries if config.fusion != "none" and config.queries else (config.retrieval_query,)
        digests = runs.digests(texts, len(lists), collection, config, models) if folder else {}
        found = runs.lookup(spark, folder, digests) if folder else {}
        docid = (collection.passages if collection.passages is not None else collection.index.postings).schema["docid"].dataType
        rest = [i for i in range(len(lists)) if i not in found]
        parts = [retrieve(texts.filter(F.col("list_id").isin(rest)), collection, config, models)] if rest else []
        for i, name in found.items():
            run = trec.read_run(spark, literal(f"{folder}/{name}"))
            parts.append(run.filter(F.col("rank") <= config.k).select(F.lit(i).alias("list_id"), F.col("qid").cast(queries.schema["qid"].dataType).alias("qid"), F.col("docid").cast(docid).alias("docid"), "score", "rank"))
        every = parts[0].select("list_id", "qid", "docid", "score", "rank")
        for x in parts[1:]:
            every = every.unionByName(x)
        every = kept(every) if config.fusion != "none" else every  # fusion reads the lists several times
        run = fuse(every, replace(config, lists=list(range(len(lists)))), queries.select("qid", "level"), qrels)
    else:
        run = ranked(given.select("qid", "docid", "score"), ["qid"])
    run = reranked(run.select("qid", "docid", "score", "rank"), queries, collection, config, models)
    if folder:
        run = kept(run)
        plain = config.reranker == "none" and given is None and len(digests) == 1
        runs.store(run, folder, name_of(config), next(iter(digests.values())) if plain else None)
    return run


def fused_files(spark: SparkSession, first: str, second: str, out: str, alpha: float = 0.1, k: int = 1000, normalization: str = "none", tag: str = "fusion") -> DataFrame:
    """Two run files fused (s0 + alpha * s1, see fusion.linear_weighted) into a third, which is read back."""
    from ..operators import fusion
    from ..operators.ranking import normalized

    a, b = (normalized(trec.read_run(spark, p), normalization, ["qid"]) for p in (first, second))
    trec.write_run(fusion.linear_weighted(a, b, alpha, k), out, tag)
    return trec.read_run(spark, out)
