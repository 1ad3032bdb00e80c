"""Stored postings of learned sparse weights: whole-number impacts in segments that are appended and merged."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import kept, names_in
from ..sources.tables import MOST_BUCKETS, MOST_LITERALS, buckets_for, drop_table, read_table, write_table
from .index import folder_of
from .ranking import ranked, settled

#: Impacts of one folder of dimensions on average, and of one of its files at least.
PER_FOLDER, PER_FILE = 1 << 20, 1 << 16
#: Rows of a block of passages and of queries, and their weights at most; bytes of a query's weight, and of all at once.
PASSAGES, QUERIES, ENTRIES, QUERY_ENTRY, QUERY_BYTES = 2048, 1024, 1 << 19, 32, 128 << 20
#: Candidates that a task holds at most; and those beyond k, as rounding may order the last ones otherwise.
HELD, SPARE = 1 << 22, 8
#: Dimensions multiplied at once, and products added at once.
DIMS, PRODUCTS = 512, 1 << 22
PACKED = ("keys", "ends", "dims", "flat")
NAME = re.compile(r"segment-(\d+)-(\d+)")


def segments(spark: SparkSession, path: str) -> list[str]:
    """The segments of an index, oldest first: those that were written to the end, without those that a merged one holds."""
    spans = sorted((int(m[1]), int(m[2])) for n in names_in(spark, path) if (m := NAME.fullmatch(n)) and "_SUCCESS" in names_in(spark, f"{path}/{n}/dims"))
    return [f"segment-{a}-{b}" for a, b in spans if not any((c, d) != (a, b) and c <= a and b <= d for c, d in spans)]


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """dim (as text), docid, impact: weights times scale as whole numbers; those that become 0 are left out."""
    return rows.select(F.col("dim").cast("string").alias("dim"), "docid", F.round(F.col("value").cast("double") * scale).cast("int").alias("impact")).filter("impact <> 0")


def _write(impacts: DataFrame, path: str, scale: int, buckets: int | None) -> None:
    """impacts: of stored tables, as they are read twice."""
    buckets = buckets or buckets_for(impacts)
    n = impacts.count()
    folders = max(1, min(MOST_BUCKETS, n // PER_FOLDER, n // (buckets * PER_FILE)))
    table = write_table(impacts.withColumn("folder", folder_of(F.col("dim"), folders)), f"{path}/postings", buckets, "docid", ["dim", "docid"], "folder")
    # written last: a segment counts from then on
    table.groupBy("dim").agg(F.count("*").alias("df"), F.max("impact").alias("most"), F.lit(scale).alias("scale"), F.lit(folders).alias("folders")).write.mode("overwrite").parquet(f"{path}/dims")


def append(rows: DataFrame, path: str, scale: int = 1000, buckets: int | None = None) -> None:
    """Write weights (dim, docid, value) as one more segment of the index at path (the first, where there is none). Passages
    of older segments can't come again: it raises if some do."""
    spark = rows.sparkSession
    old = segments(spark, path)
    given = kept(quantised(rows, scale))
    for name in old:
        if not given.select("docid").distinct().join(read_table(spark, f"{path}/{name}/postings").select("docid"), "docid", "left_semi").isEmpty():
            raise ValueError(f"{name} has some of these passages")
    last = max((int(NAME.fullmatch(n)[2]) for n in old), default=-1) + 1
    _write(given, f"{path}/segment-{last}-{last}", scale, buckets)


def merge(spark: SparkSession, path: str, buckets: int | None = None) -> None:
    """Write all segments as one, then delete them. Impacts are whole numbers of one scale, so nothing is rounded again; if the
    job dies on the way, either the old segments count or the new one."""
    old = segments(spark, path)
    if len(old) < 2:
        return
    scales = {spark.read.parquet(f"{path}/{n}/dims").select("scale").first() for n in old} - {None}
    if len(scales) > 1:
        raise ValueError(f"segments of different scales: {scales}")
    rows = reduce(DataFrame.unionByName, (read_table(spark, f"{path}/{n}/postings").select("dim", "docid", "impact") for n in old))
    first, last = NAME.fullmatch(old[0])[1], NAME.fullmatch(old[-1])[2]
    _write(rows, f"{path}/segment-{first}-{last}", scales.pop()["scale"] if scales else 1, buckets)
    jvm = spark._jvm.org.apache.hadoop.fs
    for name in old:
        drop_table(spark, f"{path}/{name}/postings")
        p = jvm.Path(f"{path}/{name}")
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows (key, x: array of dim and value) as blocks of at most `size` rows and some ENTRIES weights, each a row: a number,
    the keys, where each one's weights end, and all dimensions and values one after the other."""
    kinds = (rows.schema[key].dataType, T.LongType(), rows.schema["x"].dataType.elementType["dim"].dataType, T.DoubleType())
    schema = T.StructType([T.StructField("id", T.StringType()), *(T.StructField(n, T.ArrayType(t)) for n, t in zip(PACKED, kinds))])
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def work(batches):
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < len(keys):
                before = ends[at - 1] if at else 0
                to = min(at + size, max(at + 1, int(np.searchsorted(ends, before + ENTRIES, "right"))))
                flat = lists.slice(at, to - at).flatten()
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), whole(keys.slice(at, to - at)), whole(pa.array(ends[at:to] - before, pa.int64())), whole(flat.field(0)), whole(flat.field(1))], names=["id", *PACKED])
                at = to

    return rows.select(key, "x").mapInArrow(work, schema)


def products(asked: tuple, block: tuple) -> np.ndarray:
    """Inner products of queries and passages, each given as (rows, row of each weight, its dimension, its value). Dimensions
    that many of both have are multiplied as matrices, the others weight by weight."""
    (n, q_row, q_dim, q), (m, p_row, p_dim, p) = asked, block
    names = q_dim.unique()
    code = lambda x: pc.fill_null(pc.index_in(x, value_set=names), -1).to_numpy(zero_copy_only=False)
    qc, pc_ = code(q_dim), code(p_dim)
    qo, po = np.argsort(qc, kind="stable"), np.argsort(pc_, kind="stable")
    po = po[pc_[po] >= 0]
    q_n, p_n = np.bincount(qc, minlength=len(names)), np.bincount(pc_[po], minlength=len(names))
    many = (q_n * p_n * 16 >= n * m) & (p_n > 0)
    out = np.zeros((n, m))
    common = np.flatnonzero(many)
    for at in range(0, len(common), DIMS):
        place = np.full(len(names), -1)
        place[common[at : at + DIMS]] = range(len(common[at : at + DIMS]))
        sides = []
        for rows, row, c, value, order in ((n, q_row, qc, q, qo), (m, p_row, pc_, p, po)):
            mine = order[place[c[order]] >= 0]
            side = np.zeros((rows, min(DIMS, len(common) - at)))
            np.add.at(side, (row[mine], place[c[mine]]), value[mine])
            sides.append(side)
        out += sides[0] @ sides[1].T
    q_at, p_at = np.cumsum(q_n) - q_n, np.cumsum(p_n) - p_n
    mine = qo[~many[qc[qo]] & (p_n[qc[qo]] > 0)]  # each with all passages that have its dimension
    times = p_n[qc[mine]]
    upto = np.cumsum(times)
    at = 0
    while at < len(mine):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + PRODUCTS, "right")))
        few, t = mine[at:to], times[at:to]
        which = np.repeat(few, t)
        other = po[np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(p_at[qc[few]], t)]
        np.add.at(out.reshape(-1), q_row[which] * m + p_row[other], q[which] * p[other])
        at = to
    return out


class Best:
    """The best passages so far for a block of queries: candidates gather, and are cut to `few` a query now and then."""

    def __init__(self, qids: pa.Array, few: int):
        self.qids, self.few, self.found, self.n = qids, few, [], 0
        self.least = np.zeros(len(qids))  # millionths: nothing below counts any more

    def add(self, scores: np.ndarray, docids: pa.Array) -> None:
        """scores: queries x passages, passages in order of their docids."""
        whole, width = np.floor(scores * 1e6 + 0.5), scores.shape[1]
        good = (whole >= self.least[:, None]) & (scores > 0)
        if width > self.few and good.sum() > 2 * self.few * len(scores) and np.abs(whole).max() < 2.0**50:
            order = np.where(good, whole, -1).astype(np.int64) * width + np.arange(width - 1, -1, -1)
            top = np.argpartition(order, width - self.few, axis=1)[:, width - self.few :]
            only = np.zeros_like(good)
            np.put_along_axis(only, top, True, 1)
            good &= only
        which, doc = np.nonzero(good)
        if len(which):
            self.found.append((which, scores[which, doc], docids.take(pa.array(doc))))
            self.n += len(which)
        if self.n > 4 * self.few * len(self.qids):
            self.cut()

    def cut(self) -> None:
        which, score, docid = np.concatenate([x[0] for x in self.found]), np.concatenate([x[1] for x in self.found]), pa.concat_arrays([x[2] for x in self.found])
        place = np.empty(len(which), np.int64)
        place[pc.sort_indices(docid, null_placement="at_start").to_numpy()] = np.arange(len(which))
        whole = np.floor(score * 1e6 + 0.5)
        order = np.lexsort((place, -whole, which))
        n = np.bincount(which, minlength=len(self.qids))
        nth = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        last = order[nth == self.few - 1]
        self.least[which[last]] = whole[last]
        order = order[nth < self.few]
        self.found, self.n = [(which[order], score[order], docid.take(pa.array(order)))], len(order)

    def rows(self):
        for which, score, docid in self.found:
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(which)), docid, pa.array(score)], names=["qid", "docid", "score"])


def best_of_pairs(k: int):
    """A function of batches whose rows are pairs of a packed block of passages and one of queries: qid, docid, score of
    the best passages of these blocks for each query, some more than k."""

    def unpacked(batch, i: int, first: int, by_key: bool) -> tuple[pa.Array, tuple]:
        keys, ends, dims, flat = (batch.column(first + c)[i].values for c in range(4))
        each = np.diff(ends.to_numpy(), prepend=0)
        place = np.arange(len(keys))
        if by_key:
            order = pc.sort_indices(keys, null_placement="at_start")
            place[order.to_numpy()] = np.arange(len(keys))
            keys = keys.take(order)
        return keys, (len(keys), np.repeat(place, each), dims, flat.to_numpy())

    def work(batches):
        held: dict[str, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                docids, block = unpacked(batch, i, 0, True)
                qids, asked = unpacked(batch, i, 5, False)
                best = held.setdefault(batch.column(4)[i].as_py(), Best(qids, k + SPARE))
                best.add(products(asked, block), docids)
                if sum(b.n for b in held.values()) > HELD:
                    for b in held.values():
                        yield from b.rows()
                    held = {}
        for b in held.values():
            yield from b.rows()

    return work


def best_in_blocks(asked: DataFrame, rows: DataFrame, k: int, n: int) -> DataFrame:
    """qid, docid, score: of each task the best passages for every query, some more than k, by inner products above 0 of asked
    (qid, dim, q; n rows) and rows (docid, dim, value).

    Rows are packed into blocks of passages, where they lie if they are dealt by docid; each block meets every block of
    queries (these are broadcast, QUERY_BYTES of them at once, and more in further passes). A pair of blocks is one product
    of matrices, no row for a query and passage is made, and a task hands on the best for each query alone.
    """
    passages = packed(rows.groupBy("docid").agg(F.collect_list(F.struct("dim", "value")).alias("x")), "docid", PASSAGES)
    schema = T.StructType([asked.schema["qid"], rows.schema["docid"], T.StructField("score", T.DoubleType())])
    passes, parts = max(1, -(-n * QUERY_ENTRY // QUERY_BYTES)), []
    for i in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i) if passes > 1 else asked
        some = kept(packed(some.groupBy("qid").agg(F.collect_list(F.struct("dim", F.col("q").alias("value"))).alias("x")), "qid", QUERIES))
        pairs = passages.crossJoin(F.broadcast(some.select(F.col("id").alias("asked_id"), *(F.col(c).alias(f"asked_{c}") for c in PACKED))))
        parts.append(pairs.select(*PACKED, "asked_id", *(f"asked_{c}" for c in PACKED)).mapInArrow(best_of_pairs(k), schema))
    return reduce(DataFrame.unionByName, parts)


def search(weights: DataFrame, path: str, k: int = 1000) -> DataFrame:
    """Inner products of queries (qid, dim, q) with the stored weights: qid, docid, score, rank; only scores above 0 count.

    In each segment a query's weights meet the dimensions that are there and then these dimensions' folders alone. A
    passage's impacts lie in one task, so that the best are found in blocks. Segments hold different passages, so that the
    best of each are ranked together.
    """
    spark = weights.sparkSession
    w = kept(weights.filter("q <> 0").select("qid", F.col("dim").cast("string").alias("dim"), F.col("q").cast("double").alias("q")))
    parts = []
    for name in segments(spark, path):
        dims = spark.read.parquet(f"{path}/{name}/dims")
        known = kept(w.join(dims, "dim").select("qid", "dim", (F.col("q") / F.col("scale")).alias("q"), "folders"))
        facts = known.agg(F.count("*").alias("n"), F.max("folders").alias("folders"), F.count_distinct("dim").alias("dims")).first()
        if not facts["n"]:
            continue
        rows = read_table(spark, f"{path}/{name}/postings")
        if facts["folders"] > 1:
            rows = rows.filter(F.col("folder").isin([r[0] for r in known.select(folder_of(F.col("dim"), facts["folders"])).distinct().collect()]))
        if facts["dims"] <= MOST_LITERALS:
            rows = rows.filter(F.col("dim").isin([r[0] for r in known.select("dim").distinct().collect()]))
        scored = best_in_blocks(known, rows.select("docid", "dim", F.col("impact").cast("double").alias("value")), k, facts["n"])
        parts.append(ranked(scored.withColumn("score", settled(F.col("score"))).filter("score > 0"), ["qid"], k).drop("rank"))
    if not parts:
        return ranked(weights.select("qid", F.lit(None).cast("string").alias("docid"), F.lit(0.0).alias("score")).limit(0), ["qid"], k)
    return ranked(reduce(DataFrame.unionByName, parts), ["qid"], k)
