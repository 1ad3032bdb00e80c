"""Quality classification by supervised subword embeddings, averaged per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, slices, table
from .langid import sampled, softmax
from .rolling import Text, mix

#: Hash buckets, vector length, lengths of character n-grams, and about how many rows of either label train the model.
BUCKETS, SIZE, LENGTHS, PER_LABEL = 1 << 16, 16, (3, 4), 2000
U = np.uint64


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of the texts in one array, white space runs and text ends as one space each, and where each text's
    begin and end; a text begins with the space that ends the one before it."""
    raw = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(size + 1)
    c = np.full(int(end[-1]) + 1 if len(raw) else 1, 32, np.uint32)
    keep = np.ones(len(c), bool)
    keep[0] = False
    keep[end] = False
    c[keep] = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    kept = np.concatenate([[True], ~(space[1:] & space[:-1])])
    at = np.cumsum(kept) - 1
    begin = np.concatenate([[0], at[end[:-1]]]) if len(raw) else np.zeros(0, np.int64)
    return np.where(space, np.uint32(32), c)[kept], begin, at[end]


def families(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed features of whole texts: for words, word pairs and the character n-grams of words, with a space as the mark of
    their beginning and end (buckets, and the range of each text's)."""
    t = Text(texts)
    w = t.words()
    h = w.hashes()
    out = [(h, w.first, w.last)]
    if len(h) > 1:
        first = np.minimum(w.first, len(h) - 1)  # texts without words may follow the last word
        out.append((mix(h[:-1] * U(3) + h[1:]), first, np.maximum(w.last - 1, first)))
    c, begin, end = code_points(texts)
    inner = np.concatenate([[0], np.cumsum(c == 32)])
    for n in LENGTHS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        # no space but at the n-gram's first or last place
        at = np.flatnonzero(inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]) if n > 2 else np.arange(m)
        g = np.full(len(at), n, U)
        for k in range(n):
            g = mix(g * U(0x100000001B3) + c[at + k].astype(U))
        first = np.searchsorted(at, begin)
        out.append((g, first, np.maximum(first, np.searchsorted(at, end - n + 2))))
    return [((x >> U(7)).astype(np.int64) & (BUCKETS - 1), a, np.maximum(a, z)) for x, a, z in out]


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, count) of each text; bucket BUCKETS is in every text once."""
    found, out = families(texts), []
    for i in range(len(texts)):
        at, n = np.unique(np.concatenate([x[a[i] : z[i]] for x, a, z in found]), return_counts=True)
        out.append((np.append(at, BUCKETS), np.append(n, 1)))
    return out


def fit(data: list[tuple[bytes, bytes, int]], epochs: int = 5, rate: float = 2.0, seed: int = 7) -> np.ndarray:
    """Stochastic gradient descent on the softmax loss; data has each row's buckets (uint16), their counts (uint32), which are
    unpacked one row at a time, and its label. The score's log odds are linear in the average vector, so
    the result is one number a bucket: what the bucket's vector adds to the log odds of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS + 1, SIZE)).astype(np.float32)
    out = np.zeros((2, SIZE), np.float32)
    steps, k = epochs * len(data), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            packed, counts, y = data[i]
            # the bucket that every text has
            at, n = np.append(np.frombuffer(packed, "<u2").astype(np.int64), BUCKETS), np.append(np.frombuffer(counts, "<u4"), 1)
            share = (n / n.sum()).astype(np.float32)
            own = vectors[at]
            mean = share @ own
            g = softmax(out @ mean)
            g[y] -= 1
            lr = rate * (1 - k / steps)
            back = g @ out
            out -= lr * np.outer(g, mean)
            # a frequent bucket would otherwise learn for all: steps go by the root of the share
            vectors[at] = own - lr * np.sqrt(share)[:, None] * back
            k += 1
    return (vectors @ (out[1] - out[0])).astype(np.float64)


def train(learnable: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> np.ndarray:
    """From doc_id and text of learnable and doc_id and quality of labels (the best of several; nulls teach nothing).

    Fits on about per_label rows of either label, chosen by a hash: the documented bound, which also bounds the
    ids that are broadcast. Without rows of both labels every score is that of no evidence, 0.5.
    """
    marked = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") >= 1).cast("int")).alias("_y"))
    marked = marked.filter(crc_of_id("_id") % 3 != 1)
    ids = sampled(marked, "_y", per_label, "_id")
    rows = learnable.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("_doc", "_y", "text")

    def describe(batches):
        for whole in batches:
            for batch in slices(whole, 2, 1 << 19):
                found = features(batch.column(2).to_pylist())
                # the bucket that every text has comes last, and is added again in fit
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a[:-1].astype("<u2").tobytes() for a, _ in found], pa.binary()), pa.array([n[:-1].astype("<u4").tobytes() for _, n in found], pa.binary())], names=["doc", "y", "at", "n"])

    def learn(batches):
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))), key=lambda r: r[:2])
        model = np.zeros(BUCKETS + 1)
        if len({r[1] for r in rows}) == 2:
            model = fit([(at, n, y) for _, y, at, n in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])

    # the sample is bounded, so that one task can hold it; the driver gets the model alone
    sample = rows.mapInArrow(describe, "doc long, y int, at binary, n binary").repartition(1)
    model = sample.mapInArrow(learn, "model binary").first()  # none where Spark has seen that there are no rows
    return np.frombuffer(model["model"], np.float64) if model else np.zeros(BUCKETS + 1)


def score(docs: DataFrame, model: np.ndarray, keep: list | None = None) -> DataFrame:
    """Add score and predicted to the columns in keep (default: doc_id and held_out); only text is looked at.

    An empty or null text has the score of its lack of features; a very long one is averaged over the whole. A score of
    exactly 0.5 counts as good. Rows with a null doc_id are held out; repeated rows get equal scores; docs may have any
    other columns; no rows give no rows.
    """
    base = float(model[BUCKETS])

    def work(batches):
        for whole in batches:
            for batch in slices(whole, 0, 1 << 19):
                total, n = np.full(batch.num_rows, base), np.ones(batch.num_rows)
                for at, a, z in families(batch.column(0).to_pylist()):
                    sums = np.concatenate([[0.0], np.cumsum(model[at])])
                    total += sums[z] - sums[a]
                    n += z - a
                s = 1 / (1 + np.exp(-np.clip(total / n, -50, 50)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "_score", "_predicted"])

    if keep is None:
        keep = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of_id() % 3 == 1, F.lit(True)).alias("held_out")]
    src = docs.select(F.col("text").alias("_text"), *keep)
    schema = src.drop("_text").schema.add("_score", "double").add("_predicted", "integer")
    return src.mapInArrow(work, schema).withColumnsRenamed({"_score": "score", "_predicted": "predicted"})


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from labels of those whose id has a crc32 that isn't 1 modulo 3."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
