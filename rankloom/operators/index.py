"""A collection's stored index: postings by term, the same by passage, and optional positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.storage import BROADCAST_ROWS, once, plan_of, scratch_path, small
from ..sources.tables import MOST_BUCKETS, MOST_LITERALS, buckets_for, read_table, rows_of, whole_buckets, write_table

#: Postings of one folder of terms on average, and of one of its files at least.
PER_FOLDER, PER_FILE = 1 << 20, 1 << 16


def term_lists(passages: DataFrame, docid: str, text: str, buckets: int | None = None) -> DataFrame:
    """docid, words, dl of every passage, dealt by docid over all cores at least before texts are read."""
    rows = passages.select(F.col(docid).alias("docid"), F.col(text).alias("_text"))
    if not rows.isStreaming:
        rows = rows.repartition(buckets or buckets_for(rows), "docid")
    return rows.select("docid", terms(F.col("_text")).alias("words")).withColumn("dl", F.size("words").cast("long"))


def postings(lists: DataFrame) -> DataFrame:
    """term, docid, tf, dl."""
    return lists.select("docid", "dl", F.explode("words").alias("term")).groupBy("term", "docid", "dl").agg(F.count("*").alias("tf"))


def folder_of(term: Column, folders: int) -> Column:
    return F.pmod(F.hash(term), F.lit(folders)).alias("folder")


@dataclass
class Index:
    """A collection's postings (term, docid, tf, dl), terms (term, df, cf, max_tf) and stats (n_docs, n_tokens, avgdl); of a
    stored one also passages (docid, dl, term, tf: the postings again, by passage; a passage without terms has a null
    one) and, if it was written with them, positions (gaps: the first position of the term and the steps to the next).
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    passages: DataFrame | None = None
    folders: int = 0

    @classmethod
    def of(cls, lists: DataFrame) -> Index:
        """Of term lists, not stored: every use computes it anew."""
        p = postings(lists)
        stats = lists.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.avg("dl").alias("avgdl"))
        return cls(p, term_stats(p), stats)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        stats = spark.read.parquet(f"{path}/stats")
        return cls(read_table(spark, f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stats.drop("folders"), read_table(spark, f"{path}/passages"), stats.first()["folders"])

    def met_by(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """wanted, a stored table (term), and the postings it is to be joined with: only its terms' folders are opened, and up
        to MOST_LITERALS terms are looked for in the files' statistics too. wanted is broadcast while it is small."""
        facts = [F.count("*").alias("n"), F.count_distinct("term").alias("terms")]
        if self.folders > 1:
            facts.append(F.collect_set(folder_of(F.col("term"), self.folders)).alias("folders"))  # no more than there are
        found = wanted.agg(*facts).first()
        rows = self.postings
        if self.folders > 1 and len(found["folders"]) < self.folders:
            rows = rows.filter(F.col("folder").isin(found["folders"]))
        if self.folders and found["terms"] <= MOST_LITERALS:
            rows = rows.filter(F.col("term").isin([r[0] for r in wanted.select("term").distinct().collect()]))
        return F.broadcast(wanted) if found["n"] <= BROADCAST_ROWS else wanted, rows

    def of_passages(self, wanted: DataFrame) -> DataFrame:
        """term, docid, tf, dl of the passages of wanted, a stored table (docid); wanted is joined by the caller."""
        if self.passages is None:
            return self.postings
        return rows_of(self.passages, "docid", wanted).filter(F.col("term").isNotNull())


def term_stats(postings: DataFrame) -> DataFrame:
    """term, df, cf, max_tf: the length of each posting list, the term's occurrences, and the most in one passage."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def write_index(lists: DataFrame, path: str, positions: bool = False, folders: int | None = None, buckets: int | None = None, dealt: bool = False) -> Index:
    """Write a collection's index and read it back. dealt: lists come from term_lists with the same buckets, and stay where
    they are.

    Texts are read once: passages are written first, dealt and sorted by docid, and all else comes from there. Postings lie
    in folders by a hash of their term, and in each folder in files by a hash of their docid, sorted by term: a search
    opens its terms' folders, and as all postings of a passage meet in one task, scores are summed where they are read.
    With positions each posting also has the gaps between the term's places in the passage.
    """
    spark = lists.sparkSession
    buckets = buckets or buckets_for(lists)
    each = lists.select("docid", "dl", F.posexplode_outer("words").alias("pos", "term"))
    starts = F.sum((F.coalesce("pos", F.lit(0)) == 0).cast("long")).alias("starts")
    places = [F.array_sort(F.collect_list("pos")).alias("gaps")] if positions else []
    rows = each.groupBy("docid", "dl", "term").agg(F.count("term").alias("tf"), starts, *places)
    if positions:
        before = F.concat(F.array(F.lit(0)), F.slice("gaps", 1, F.greatest(F.size("gaps") - 1, F.lit(0))))
        rows = rows.withColumn("gaps", F.zip_with("gaps", before, lambda x, y: x - y))
        rows = rows.withColumn("gaps", F.when(F.col("term").isNotNull(), F.col("gaps")).otherwise(F.array().cast("array<int>")))
    passages = write_table(rows, f"{path}/passages", buckets, "docid", ["docid", "term"], dealt=dealt)
    size = passages.agg(F.sum("starts").alias("n_docs"), F.coalesce(F.sum(F.col("starts") * F.col("dl")), F.lit(0)).alias("n_tokens"), F.count("term").alias("n_postings"))
    n = size.first()["n_postings"]
    folders = folders or max(1, min(MOST_BUCKETS, n // PER_FOLDER, n // (buckets * PER_FILE)))
    size.select(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "n_tokens", (F.col("n_tokens") / F.nullif(F.col("n_docs"), F.lit(0))).alias("avgdl"), F.lit(folders).alias("folders")).write.parquet(f"{path}/stats")
    by_term = passages.filter("term is not null").drop("starts").withColumn("folder", folder_of(F.col("term"), folders))
    with whole_buckets(spark):
        p = write_table(by_term, f"{path}/postings", buckets, "docid", ["term", "docid"], "folder")
    term_stats(p).sort("term").write.parquet(f"{path}/terms")
    return Index.read(spark, path)


def index_texts(passages: DataFrame, docid: str, text: str, path: str, positions: bool = False) -> Index:
    """write_index of passages. How many buckets is settled before anything is moved, so that texts move once."""
    buckets = buckets_for(passages.select(docid, text))
    return write_index(term_lists(passages, docid, text, buckets), path, positions, buckets=buckets, dealt=True)


def index_once(passages: DataFrame, docid: str, text: str, positions: bool = False) -> Index:
    """The stored index of passages, written into the shared folder when it is first asked for, and again for another plan
    (another filter or another text of the same files is another collection) or if a file of theirs has changed since."""
    spark = passages.sparkSession
    key = (spark.sparkContext.applicationId, "index", docid, text, positions, plan_of(passages))

    return once(key, lambda: index_texts(passages, docid, text, scratch_path(spark), positions))


def as_index(lists: DataFrame | Index) -> Index:
    return lists if isinstance(lists, Index) else Index.of(lists)


def joined(few: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """few, a stored table, with rows: few is broadcast if it is small, else both are exchanged."""
    return small(few).join(rows, on)
