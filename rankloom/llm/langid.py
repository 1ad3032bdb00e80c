"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table

#: Hash buckets of n-grams, n-gram lengths, and about how many documents of each language train the model.
BUCKETS, LENGTHS, PER_LANGUAGE = 1 << 14, (1, 2, 3), 500
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The n-gram buckets of the lower-cased letters of the whole text, other runs being one space, and how often each
    occurs; None without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c[letter | np.concatenate([[False], letter[:-1]])], [np.uint32(32)]])
    found = []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in LENGTHS:
            found.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(18))
    return np.unique(np.concatenate(found), return_counts=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of every bucket over all rows of docs, and the number of rows with a letter; each task sends one count a bucket."""

    def work(batches):
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (c := counts(text.as_py())) is not None:
                    df[c[0]] += 1
                    n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])

    found = docs.select("text").mapInArrow(work, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[found["bucket"]] = found["df"]
    return df[:-1], int(df[-1])


def sampled(docs: DataFrame, column: str, each: int, key: str = "doc_id", most: int = 1024) -> DataFrame:
    """About `each` rows of every value of column, by a hash of the key; the same rows on every run. Of more than `most`
    values the most frequent are taken (a documented bound, as one count for each comes to the driver)."""
    counted = docs.filter(F.col(column).isNotNull()).groupBy(column).count()
    fractions = {r[0]: each / r[1] for r in counted.orderBy(F.col("count").desc(), column).limit(most).collect()}
    if not fractions:
        return docs.limit(0)
    u = (F.xxhash64(F.lit("sample"), key).bitwiseAND(0xFFFFFF)) / float(1 << 24)
    share = F.create_map(*(F.lit(x) for pair in fractions.items() for x in pair))
    return docs.filter(u < F.coalesce(F.try_element_at(share, F.col(column)), F.lit(0.0)))


def tfidf(c: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = c
    x = n * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max())
    return x / x.sum()


class Ftrl:
    """Follow the regularised leader (proximal, per coordinate) with L1 and L2 penalties; most weights stay exactly zero."""

    def __init__(self, classes: int, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits that makes the held-back rows likeliest, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    low, high, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts(text)
        if c is None or not self.languages:
            return "und", 0.0
        at, x = tfidf(c, self.idf)
        p = softmax(x @ self.weights[at] / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(learnable: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 3) -> Model:
    """From doc_id, text, lang; rows without text or lang teach nothing.

    Document frequencies are those of all learnable rows. The weights are fitted on about per_language rows of each
    language, chosen by a hash (the documented bound); a fifth of these only calibrates the temperature.
    """
    rows = learnable.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1

    def work(batches):
        for batch in batches:
            out = [(d, lang, c) for d, t, lang in zip(*(batch.column(i).to_pylist() for i in range(3))) if (c := counts(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([c[0].tolist() for _, _, c in out], pa.list_(pa.int32())), pa.array([c[1].tolist() for _, _, c in out], pa.list_(pa.int64()))], names=["doc_id", "lang", "at", "n"])

    sample = sampled(rows, "lang", per_language).select(F.col("doc_id").cast("long"), "text", "lang")
    got = sorted(sample.mapInArrow(work, "doc_id long, lang string, at array<int>, n array<long>").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["at"]))
    languages = sorted({r["lang"] for r in got})
    data = []
    for r in got:
        data.append((*tfidf((np.array(r["at"]), np.array(r["n"])), idf), languages.index(r["lang"])))
    order = np.random.default_rng(3).permutation(len(data))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    ftrl = Ftrl(len(languages), BUCKETS)
    for _ in range(epochs):
        for i in fit:
            ftrl.learn(*data[i])
    weights = ftrl.weights()
    logits = np.array([data[i][1] @ weights[data[i][0]] for i in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights.astype(np.float32), temperature(logits, np.array([data[i][2] for i in held], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs; only text is looked at.

    A null text or one without a letter is `und` with score 0, as is any text when nothing could be learnt. Of languages
    that tie the first by name is taken. A very long text is read whole by one task. Rows with a null doc_id are held
    out; repeated rows get equal results; other columns are ignored; no rows give no rows.
    """

    def work(batches):
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_of_id() % 3 == 1, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose id has a crc32 that isn't 1 modulo 3."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.filter(crc_of_id() % 3 != 1)))
