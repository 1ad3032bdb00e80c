"""A catalogue of stored runs, by a digest of all that decides a run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import trec
from ..sources.storage import literal, names_in, plan_of

MANIFEST = "_manifest"


def collection_state(collection, model: str) -> str:
    """What tells a collection from others: the state it was given, or the files and the plan of its passages, or of the
    vectors or term weights that the model searches."""
    if collection.state:
        return collection.state
    searched = {"dense": collection.vectors, "sparse": collection.weights}.get(model, collection.passages)
    if searched is None and collection.index is not None:
        searched = collection.index.stats
    return "" if searched is None else hashlib.sha256(repr(plan_of(searched)).encode()).hexdigest()


def digests(texts: DataFrame, n: int, collection, config, models=None) -> dict[int, str]:
    """list_id -> digest of the run of each of n lists: its queries with their texts, the collection, the model with its
    parameters and label, and the depth."""
    said = {r["list_id"]: (r["h"], r["h2"], r["n"]) for r in texts.groupBy("list_id").agg(F.bit_xor(F.xxhash64("qid", "text")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "qid", "text")).alias("h2"), F.count("*").alias("n")).collect()}
    feedback = [config.fb_docs, config.fb_terms, config.original_weight] if config.feedback else None
    fixed = [collection_state(collection, config.model), config.model, config.k, [config.k1, config.b] if config.model == "BM25" else None, feedback, getattr(models, "label", "")]
    return {i: hashlib.sha256(json.dumps([said.get(i), *fixed]).encode()).hexdigest() for i in range(n)}


def store(run: DataFrame, folder: str, name: str, digest: str | None) -> str:
    """Write a run and its line in the catalogue; returns the name it has there. A run without a digest (of several lists, or
    reranked) is stored under the plain name and never served for another search. Each digest has a file and a line of
    its own, so that a job that runs again replaces both."""
    stored = f"{name}-{digest[:16]}" if digest else name
    trec.write_run(run, f"{folder}/{stored}", name)
    if digest:
        run.sparkSession.createDataFrame([(digest, stored)], "digest string, name string").coalesce(1).write.mode("overwrite").json(f"{folder}/{MANIFEST}/{digest}")
    return stored


def lookup(spark: SparkSession, folder: str, wanted: dict[int, str]) -> dict[int, str]:
    """list_id -> name of the stored run of its digest, for those that are there."""
    if MANIFEST not in names_in(spark, folder):
        return {}
    known = spark.read.schema("digest string, name string").option("recursiveFileLookup", True).json(f"{literal(folder)}/{MANIFEST}")
    asked = spark.createDataFrame(list(wanted.items()), "list_id int, digest string")
    return {r["list_id"]: r["name"] for r in asked.join(known, "digest").collect()}
