"""Dense and sparse vector retrieval, and vector helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.passages import blocks
from .ranking import ranked, settled


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column, eps: float = 1e-9) -> Column:
    length = norm(a) + eps
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 128 << 20


def packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """keys, flat: rows (key, embedding) of one length as blocks of at most `size` rows, each a row: the keys and the
    components one after the other."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                flat = part.column(1).flatten().cast(pa.float64())
                ends = lambda x: pa.array([0, len(x)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends(part.column(0)), part.column(0)), pa.ListArray.from_arrays(ends(flat), flat)], names=["keys", "flat"])

    return rows.select(key, "embedding").mapInArrow(work, f"keys array<{kind}>, flat array<double>")


def dense(queries: DataFrame, vectors: DataFrame, k: int = 1000, block: int = 2048, query_block: int = 1024) -> DataFrame:
    """Exact inner-product search: queries (qid, embedding) against vectors (docid, embedding), the k best for each.

    Both sides are packed into blocks, and each block of vectors meets each block of queries where it was read: the
    query blocks are broadcast, QUERY_BYTES of them at once, and more in further passes over the vectors. Nothing is
    collected, however many queries there are. A pair of blocks is one product of matrices that hands on the k best for
    each query, so the exchange carries few rows. Queries must have one length and no null components, or it raises;
    passages whose vector is null, of another length or holds nulls are left out.
    """
    null = F.exists("embedding", lambda x: x.isNull())
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    facts = queries.agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.coalesce(F.bool_or(F.col("embedding").isNull() | F.coalesce(null, F.lit(True))), F.lit(False)).alias("bad")).first()
    if facts["bad"] or facts["least"] != facts["most"]:
        raise ValueError("queries need vectors of one length without nulls")
    dim = facts["most"] or 0
    schema = T.StructType([queries.select("qid").schema[0], vectors.select("docid").schema[0], T.StructField("score", T.DoubleType())])

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docids, flat, qids, asked = (batch.column(c)[i].values for c in range(4))
                scores = asked.to_numpy().reshape(-1, dim) @ flat.to_numpy().reshape(-1, dim).T
                few = min(k + 1, scores.shape[1])  # one more, as rounding may make ties at the cut
                cut = -np.partition(-scores, few - 1, axis=1)[:, few - 1]
                which, doc = np.nonzero(np.round(scores, 6) >= np.round(cut, 6)[:, None])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(which)), docids.take(pa.array(doc)), pa.array(scores[which, doc])], names=["qid", "docid", "score"])

    if not dim:
        return ranked(queries.select("qid").limit(0).crossJoin(vectors.select("docid").limit(0)).withColumn("score", F.lit(0.0)), ["qid"], k)
    whole = vectors.filter(F.col("embedding").isNotNull()).filter((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))
    blocks_ = packed(whole, "docid", block)
    passes = max(1, -(-facts["n"] * dim * 8 // QUERY_BYTES))
    found = []
    for i in range(passes):
        some = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i) if passes > 1 else queries
        asked = packed(some, "qid", query_block).toDF("qids", "asked")
        found.append(blocks_.crossJoin(F.broadcast(asked)).mapInArrow(work, schema))
    every = reduce(DataFrame.unionByName, found)
    return ranked(every.select("qid", "docid", settled(F.col("score")).alias("score")), ["qid"], k)


class PerWorker:
    """A model that each Python worker loads once, when it is first called there, and keeps: load() gives the callable."""

    def __init__(self, load: Callable[[], Callable]):
        self.load, self.key = load, uuid.uuid4().hex

    def __call__(self, *args):
        if self.key not in _loaded:
            _loaded[self.key] = self.load()
        return _loaded[self.key](*args)


#: What the models of this worker process are, by PerWorker's key.
_loaded: dict[str, Callable] = {}


def by_length(lengths: list[int], budget: int, most: int) -> list[np.ndarray]:
    """Places of texts in batches, longest first: a batch has at most `most` texts, and at most `budget` tokens when each is
    padded to its longest (a text longer than that is a batch of its own)."""
    order, out = np.argsort(-np.asarray(lengths), kind="stable"), []
    at = 0
    while at < len(order):
        longest = max(1, lengths[order[at]])
        n = max(1, min(most, budget // longest))
        out.append(order[at : at + n])
        at += n
    return out


def encoded(rows: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], batch: int = 200, budget: int | None = None) -> DataFrame:
    """Add `embedding` by a model that the caller supplies (PerWorker loads it once a worker); texts reach it in batches. With a
    budget of words, texts of like length share a batch, so that little is padded; rows keep their order."""
    schema = T.StructType([*rows.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def work(frames):
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            places = by_length([len(t.split()) for t in texts], budget, batch) if budget else [np.arange(i, min(i + batch, len(texts))) for i in range(0, len(texts), batch)]
            out: list = [None] * len(texts)
            for at in places:
                for i, v in zip(at.tolist(), np.asarray(encode([texts[i] for i in at]), np.float32)):
                    out[i] = v
            yield frame.assign(embedding=out)

    return rows.mapInPandas(work, schema)


def write_blocks(rows: DataFrame, text: str, order: str, encode: Callable[[list[str]], np.ndarray], path: str, size: int = 1_000_000) -> DataFrame:
    """Encode rows and write docid, embedding in blocks of `size` rows in order of a whole number, one folder a block; read
    back with its block. Passages are numbered before they are encoded, so that blocks don't depend on the tasks."""
    numbered = blocks(rows, order, size).select("docid", text, "block")
    encoded(numbered, text, encode).select("docid", "embedding", "block").write.partitionBy("block").parquet(path)
    return rows.sparkSession.read.parquet(path)


def sparse(weights: DataFrame, index: DataFrame, k: int = 1000) -> DataFrame:
    """Inner products on an inverted index: weights (qid, dim, q) and index (dim, docid, value); only scores above 0 count."""
    scored = weights.filter("q <> 0").join(index, "dim").groupBy("qid", "docid").agg(settled(F.sum(F.col("q") * F.col("value"))).alias("score"))
    return ranked(scored.filter("score > 0"), ["qid"], k)


def inverted(vectors: DataFrame) -> DataFrame:
    """dim, docid, value of the components that aren't zero."""
    return vectors.select("docid", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0").select("dim", "docid", F.col("value").cast("double").alias("value"))


def pooled(rows: Column, how: str = "max") -> Column:
    """log(1 + relu(x)) of token logits (array of arrays), pooled over tokens by max or sum."""
    squash = lambda row: F.transform(row, lambda x: F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))
    join = (lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))) if how == "max" else (lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.aggregate(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), squash), squash(F.element_at(rows, 1)), join)


def mean_pooled(rows: Column, mask: Column, skip: int = 0) -> Column:
    """The mean of token vectors (array of arrays) where mask is 1, the first `skip` tokens left out; null if none is left."""
    real = F.filter(F.transform(rows, lambda r, i: F.when((i >= skip) & (F.get(mask, i) == 1), r)), lambda r: r.isNotNull())
    total = F.aggregate(F.slice(real, 2, F.greatest(F.size(real) - 1, F.lit(0))), F.transform(F.get(real, F.lit(0)), lambda x: x.cast("double")), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.when(F.size(real) > 0, F.transform(total, lambda x: x / F.size(real)))


def first_pooled(rows: Column) -> Column:
    """The vector of the first token."""
    return F.get(rows, F.lit(0))


def denoised(rows: Column, k: int) -> Column:
    """The k token vectors after the first that are most like the first by cosine, in their order; ties by place."""
    first = F.get(rows, F.lit(0))
    like = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r, i: F.struct((-cosine(first, r)).alias("s"), i.alias("i"), r.alias("r")))
    best = F.slice(F.array_sort(like), 1, k)
    return F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r")))), lambda x: x["r"])


def bag_of_words(words: Column) -> Column:
    """Each distinct word with weight 1."""
    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("dim"), F.lit(1.0).alias("q")))


def nucleus(scored: DataFrame, keys: list[str], p: float) -> DataFrame:
    """Rows whose softmax mass before them, in descending order of score, is at most p; the first always stays."""
    from pyspark.sql import Window as W

    best = F.max("score").over(W.partitionBy(*keys))
    e = scored.withColumn("_e", F.exp(F.col("score") - best))
    share = F.col("_e") / F.sum("_e").over(W.partitionBy(*keys))
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("docid"))
    e = e.withColumn("prob", share).withColumn("_before", settled(F.coalesce(F.sum("prob").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))))
    return e.filter(F.col("_before") <= p).withColumn("prob", settled(F.col("prob"))).drop("_e", "_before")
