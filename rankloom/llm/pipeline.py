"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir); all but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import minhash, mixing, packing, quality, secret_scan
from .common import WORD, Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored under 0.5 go. It learns from the labelled rows of docs (see quality.train).

    Each row is scored by its whole text, equal rows alike; null and empty texts get the score of no evidence. No labels,
    or none of one kind: every score is 0.5 and nothing goes. Columns of docs may have any names; no rows give no rows.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return quality.score(rows, model, [F.col("row")]).filter("predicted = 1").select("row.*")


def row_keys(docs: DataFrame) -> list:
    """_id, _th: what tells rows apart unless both id and text are equal (a null id counts as the largest); and _row, a hash of
    all columns that have one."""
    hashable = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(minhash.LAST)).alias("_id"), F.xxhash64("text").alias("_th"), F.xxhash64(*hashable).alias("_row")]


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near copies one document stays, that of the least doc_id (null is the largest),
    of several rows with that id the one of the least text hash, and of several with that text the one of the least
    hash of all its columns; of equal rows one.

    Null and empty texts are copies of nothing but rows of equal id; very long texts are compared whole; no rows give no
    rows. Columns of docs may have any names. Which rows stay is decided on ids and hashes, and written before texts are
    read again, so that what led to it can go.
    """
    scratch, own = Scratch(spark), Scratch(spark)
    found = minhash.near_duplicates(docs, scratch=scratch).filter("kept and th = component_th")
    kept = own.cut(found.select(F.coalesce("doc_id", F.lit(minhash.LAST)).alias("_id"), F.col("th").alias("_th")))
    scratch.close()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_keys(docs))
    # both sides are dealt by the keys for the join, so that choosing among rows of one id and text needs no further exchange
    return rows.join(kept, ["_id", "_th"], "left_semi").groupBy("_id", "_th").agg(F.min_by("row", "_row").alias("row")).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets in texts are replaced, and n_chars follows; no document goes.

    Whole texts are read, however long; null texts stay null, equal rows get equal texts; columns of docs may have any
    names, and one called n_chars is set only where the text has changed; no rows give no rows.
    """
    words = secret_scan.dictionary(docs)
    found = secret_scan.scan(docs, secret_scan.train(spark, words=words), words=words)
    new = {"text": F.col("_redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_redacted").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("_redacted").cast(docs.schema["n_chars"].dataType))
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document stands as often as the mix takes it, which is 0 to 2 times.

    The mix is decided on ids, sizes and hashes alone; texts are exchanged once, to meet their numbers of times. Rows of one
    id and text that differ in another column, such as the source, are told apart by a hash of all columns and get their
    own numbers; rows that are equal in all are interchangeable, and are told apart by counting them. Null ids, sources and
    texts: see mixing.mix; a document without words is not taken; no rows give no rows; any column names may occur.
    """
    slim = docs.select(*row_keys(docs), "doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("_n"))
    mixed = mixing.mix(mixing.with_quality(slim, table(spark, sf_dir, "labels")), F.col("_quality"), F.col("_n"), [F.col("doc_id").cast("string"), F.col("_th").cast("string")])
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    key = ["_id", "_th", "_row"]
    times = mixed.groupBy(*key).agg(F.array_sort(F.collect_list(times)).alias("_times"))
    nth = F.row_number().over(W.partitionBy(*key).orderBy("_id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_keys(docs)).withColumn("_nth", nth)
    taken = rows.join(times, key).withColumn("_k", F.element_at("_times", F.col("_nth")))
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("_k")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents, with their token ids. A null or empty text is the end id alone, repeated rows
    are packed each, whole texts however long; other columns of docs are left out; no rows give no rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
