"""Passage collections: tab-separated and JSON lines, repairs, and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import kept, small
from .tables import buckets_for, rows_of, write_table


def repaired_tsv(lines: DataFrame) -> DataFrame:
    """docid, contents, url, ok of lines `id <tab> text [parts] <tab> url`: surplus parts in the middle are joined by four
    spaces; fewer than three fields, or a url that isn't http, is not ok."""
    p = F.split("value", "\t")
    n = F.size(p)
    url = F.element_at(p, -1)
    body = F.array_join(F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0))), "    ")
    ok = (n >= 3) & url.startswith("http")
    return lines.select(p[0].alias("docid"), F.when(ok, body).alias("contents"), F.when(ok, url).alias("url"), ok.alias("ok"))


def plain_tsv(lines: DataFrame) -> DataFrame:
    """docid, contents of lines `id <tab> text`; a lone id has an empty text."""
    p = F.split("value", "\t")
    return lines.select(p[0].alias("docid"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("contents"))


def clean_tsv(lines: DataFrame) -> DataFrame:
    """Lines `id <tab> text` of the lines that repaired_tsv calls ok."""
    return repaired_tsv(lines).filter("ok").select(F.concat_ws("\t", "docid", "contents").alias("value"))


def write_passages(passages: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """A keyed store of passages (docid, contents and others), dealt and sorted by docid: a lookup of few ids opens their
    buckets alone, and one of any number moves only the ids. Read back by tables.read_table."""
    return write_table(passages, path, buckets or buckets_for(passages), "docid", ["docid"])


def with_contents(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """rows (docid and others), each with the contents of its passage, null where there is none. rows are written first.

    Texts stay where they are read: the rows go to them, broadcast while they are few, and rows without a passage are found
    by ids alone. More rows are exchanged, and so are the texts unless they come from a store.
    """
    rows = kept(rows)
    some = rows_of(passages.select("docid", "contents"), "docid", rows)
    few = small(rows)
    if few is rows:
        return rows.join(some, "docid", "left")
    found = few.join(some, "docid").select(*rows.columns, "contents")
    lost = rows.join(some.select("docid"), "docid", "left_anti").select(*rows.columns, F.lit(None).cast("string").alias("contents"))
    return found.unionByName(lost)


def by_ids(passages: DataFrame, ids: DataFrame) -> DataFrame:
    """docid, contents of every row of ids (docid); contents is null where there is no such passage."""
    return with_contents(ids.select("docid"), passages)


def gold_passages(turns: DataFrame, passages: DataFrame, key: str = "turn_id") -> DataFrame:
    """key, gold: the passages (docid, contents) of each turn's response_provenance, in its order; a passage that isn't
    there has null contents, and a turn without provenance an empty array. Only the passages found are brought together."""
    each = turns.select(key, F.posexplode("response_provenance").alias("pos", "docid"))
    found = with_contents(each, passages).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "docid", "contents"))).alias("g"))
    gold = F.transform("g", lambda x: F.struct(x["docid"].alias("docid"), x["contents"].alias("contents")))
    empty = F.array().cast(f"array<struct<docid:{passages.schema['docid'].dataType.simpleString()},contents:string>>")
    return turns.select(key).join(found.select(key, gold.alias("gold")), key, "left").withColumn("gold", F.coalesce("gold", empty))


def permuted(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add place: the rows in an order that the seed alone decides; equal keys keep one place each by chance of Spark's order."""
    mixed = rows.withColumn("_u", F.xxhash64(F.lit(seed), key))
    part = F.shiftright("_u", 48)  # ranges of the hash are counted first, so that no task orders all rows
    counts = mixed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_p").orderBy("_u", key)) + F.col("_before") - 1
    return mixed.withColumn("_p", part).join(before, "_p").withColumn("place", place.cast("long")).drop("_p", "_u", "_before")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if they are fewer), the same on every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def to_jsonl(passages: DataFrame) -> DataFrame:
    return passages.select(F.to_json(F.struct(F.col("docid").alias("id"), "contents")).alias("value"))


def csv_field(c):
    """A field as csv writers give it: with a tab, a quote or a line break in it, quoted and its quotes doubled."""
    return F.when(c.rlike("[\t\"\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def jsonl_to_tsv(lines: DataFrame) -> DataFrame:
    """`id <tab> contents <tab> url` with a made-up url; missing keys are empty, and fields are quoted where they must be."""
    j = F.from_json("value", "id string, contents string")
    docid = F.coalesce(j["id"], F.lit(""))
    return lines.select(F.concat_ws("\t", *map(csv_field, (docid, F.coalesce(j["contents"], F.lit("")), F.concat(F.lit("http://example.com/"), docid)))).alias("value"))


def collection(rows: DataFrame) -> DataFrame:
    """docid as a number, contents as title, [SEP] and text where there is a title; rows whose id is no number are left out."""
    title = F.when(F.length(F.coalesce("title", F.lit(""))) > 0, F.concat(F.col("title"), F.lit("[SEP]"))).otherwise("")
    return rows.select(F.col("docid").try_cast("long").alias("docid"), F.concat(title, F.coalesce("text", F.lit(""))).alias("contents")).filter("docid is not null")


def blocks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Add pos and block: rows in order of a whole number, `size` to a block.

    Positions are counted within ranges of the order, and a range starts where those before it end; the ranges'
    counts, one row a range, are all that is brought together.
    """
    parts = rows.withColumn("_range", F.floor(F.col(order) / F.lit(1 << 16)))
    counts = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    pos = F.row_number().over(W.partitionBy("_range").orderBy(order)) + F.col("_before") - 1
    return parts.join(before, "_range").withColumn("pos", pos.cast("long")).withColumn("block", F.floor(F.col("pos") / size).cast("long")).drop("_range", "_before")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, contents string").json(path).withColumnRenamed("id", "docid")
