"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

#: Quality weights of documents that labels.quality marks 1, marks 0, or doesn't mark.
GOOD, POOR, UNKNOWN = 2.0, 0.5, 1.0
CYCLE = (5.0, 2.0, 1.0)


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from the md5 of the key's text; the same on every run."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *key).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float, most: float, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Water filling over (source, source_size), one row a source: sources ordered by code point, null last, weigh
    cycle over and over and share `share` of all sizes; a target stops at `most` times its source's size and what is
    over goes to the others by weight until none is above. Adds target. Runs over one row per source only."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size"))
    up = W.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    all_rows = W.partitionBy()
    s = s.withColumn("_budget", share * F.sum("source_size").over(all_rows))
    s = s.withColumn("_before", F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest_w", F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing)))
    level = (F.col("_budget") - F.col("_before")) / F.col("_rest_w")
    # the first source, from the least cap a weight on, that the level doesn't fill sets the level for the rest
    s = s.withColumn("_level", F.min(F.when(level * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("o"), level.alias("level")))).over(all_rows)["level"])
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))).select("source", "source_size", "target")


def mix(docs: DataFrame, weight: Column, size: Column, key: Column | list[Column], share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE, ranges: int | None = None, seed: int = 8) -> DataFrame:
    """Add size, source_size, target, taken to docs, which has a source column. key identifies a document: an id as text,
    or several columns of which the first that isn't null does, so that null ids can go by a hash of their text.

    A source whose target is k whole sizes and a rest takes every document k times (complete epochs) and then, for the
    rest, documents in the order of -ln(u)/weight (Efraimidis-Spirakis keys; u from an md5 of seed and key) while the
    words before them are less than the rest and the step does not leave the sum farther from it than it was. If a
    document is passed over for its size, those after it fill what is left in the same way, in one more pass.
    Sums within a source are prefix sums over ranges of the key's order and then within a range, so no task holds a whole
    source. Rows are dealt to ranges of (source, key) by quantiles of what is there (`ranges` of them; as many as the
    session shuffles to without it), so ranges are even whatever the weights are. Null text: size 0. Null source: a source of its own. Weights of
    null, zero or less count as the least positive weight. Rows with equal keys go by size and then by a hash of all
    their columns; rows equal in all of them are interchangeable. No rows give no rows. Columns of docs called size,
    source_size, target or taken are replaced; all other names may occur.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    keys = key if isinstance(key, list) else [key]
    hashable = [F.col(f.name) for f in docs.schema if f.name in kept and "map<" not in f.dataType.simpleString()]
    row = F.struct(*(F.col(c) for c in kept)) if kept else F.lit(None)
    n = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    d = docs.select(row.alias("row"), F.col("source").alias("source"), n.alias("size"), F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9)).alias("w"), uniform(F.lit(str(seed)), F.coalesce(*keys, F.lit("null"))).alias("u"), (F.xxhash64(*hashable) if hashable else F.lit(0)).alias("tie"))
    d = d.withColumn("key", -F.log("u") / F.col("w"))
    scratch = Scratch(docs.sparkSession)  # all passes go on from written tables, which keeps their plans short
    order = ["source", "key", "size", "tie"]
    d = scratch.cut((d.repartitionByRange(ranges, *order) if ranges else d.repartitionByRange(*order)).withColumn("bin", F.spark_partition_id()))
    goals = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, cycle)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - epochs * F.col("source_size"))
    g = scratch.cut(goals).select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest")
    ranged = d
    d = d.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = summed(d, F.col("size"), "before")
    left = F.col("rest") - F.col("before")
    first = (left > 0) & (F.col("size") <= 2 * left) & (F.col("epochs") < most)
    d = scratch.cut(d.withColumn("first", first))
    scratch.drop(ranged)
    # what the first pass took is known at its first refusal; the documents after it that are small enough share what is left
    refused = d.filter((F.col("before") < F.col("rest")) & ~F.col("first") & (F.col("epochs") < most)).groupBy("source").agg(F.min("before").alias("stop"))
    r = refused.select(F.col("source").alias("s"), "stop")
    d = d.join(r, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    gap = F.col("rest") - F.col("stop")
    d = d.withColumn("small", F.col("stop").isNotNull() & (F.col("before") >= F.col("stop")) & (F.col("size") <= 2 * gap))
    d = summed(d, F.when(F.col("small"), F.col("size")).otherwise(0), "again")
    left = gap - F.col("again")
    one_more = (F.col("first") & (F.col("stop").isNull() | (F.col("before") < F.col("stop")))) | (F.col("small") & (left > 0) & (F.col("size") <= 2 * left))
    taken = (F.col("size") * (F.col("epochs") + F.when(one_more, 1).otherwise(0))).cast("long")
    return d.select(*([F.col("row")[c].alias(c) for c in kept]), "size", "source_size", "target", taken.alias("taken"))


def summed(d: DataFrame, value: Column, name: str) -> DataFrame:
    """Add name: the sum of value over the rows of the source that come before, by range and then within it."""
    d = d.withColumn("_v", value)
    by_bin = d.groupBy("source", "bin").agg(F.sum("_v").alias("_bin_size"))
    over = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    b = by_bin.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), F.coalesce(F.sum("_bin_size").over(over), F.lit(0)).alias("_bin_before"))
    within = W.partitionBy("source", "bin").orderBy("key", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    d = d.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    return d.withColumn(name, F.col("_bin_before") + F.col("_in")).drop("_v", "_s", "_b", "_bin_before", "_in")


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add _quality, the document's weight by its labels (the best of several; unmarked: UNKNOWN). A column of docs of that
    name is replaced; all other names may occur."""
    names = [c for c in docs.columns if c != "_quality"]
    q = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("q"))
    weight = F.when(F.col("q") >= 1, GOOD).when(F.col("q").isNotNull(), POOR).otherwise(UNKNOWN)
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(q, "id", "left").select(*(F.col("row")[c].alias(c) for c in names), weight.alias("_quality"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all documents takes from each, sources weighing 5, 2, 1 in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("_n"), F.xxhash64("text").alias("_th"))
    docs = with_quality(docs, table(spark, sf_dir, "labels"))
    return mix(docs, F.col("_quality"), F.col("_n"), [F.col("doc_id").cast("string"), F.col("_th").cast("string")]).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT documents.doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('8:' || documents.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN q.q >= 1 THEN 2.0 WHEN q.q IS NOT NULL THEN 0.5 ELSE 1.0 END AS k
  FROM documents LEFT JOIN q ON q.doc_id = documents.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lvl, cap / w) FROM l WHERE lvl * w <= cap) * w, cap)) AS target FROM l),
r AS (SELECT d.doc_id, d.source, d.k, d.size, g.source_size, g.target, floor(g.target / nullif(g.source_size, 0)) AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
f AS (SELECT doc_id, source, k, size, source_size, target, before, coalesce(epochs, 0) AS e, target - coalesce(epochs, 0) * source_size AS rest,
    coalesce(epochs, 0) < 2 AND target - coalesce(epochs, 0) * source_size > before AND size <= 2 * (target - coalesce(epochs, 0) * source_size - before) AS first FROM r),
z AS (SELECT source AS zs, min(before) AS stop FROM f WHERE before < rest AND NOT first AND e < 2 GROUP BY source),
t AS (SELECT f.*, stop, stop IS NOT NULL AND before >= stop AND size <= 2 * (rest - stop) AS small FROM f LEFT JOIN z ON source IS NOT DISTINCT FROM zs),
v AS (SELECT *, coalesce(sum(CASE WHEN small THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS again FROM t)
SELECT doc_id, size, source_size, target, (size * (e + CASE WHEN (first AND (stop IS NULL OR before < stop))
  OR (small AND rest - stop > again AND size <= 2 * (rest - stop - again)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM v
"""
