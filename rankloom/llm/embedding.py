"""Embedding near-dedup: Euclidean p-stable hashing in several tables, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NODE, Scratch, forest, spanning, split_join, table
from .minhash import LAST
from .rolling import mix

#: Width of a projection's cells for vectors of length one. A pair at cosine 0.93 (distance 0.374) shares a cell in one
#: projection with probability NEAR, a pair of unlike vectors with about FAR. A label of n vectors gets as many projections
#: a table as leave about CELL unlike vectors in a cell, and as many tables as miss a pair at 0.93 in MISSED of cases, so
#: that the work for a label grows as n to the power 1 + ln(NEAR) / ln(FAR), 1.24, and not as its square.
WIDTH, NEAR, FAR, CELL, MISSED = 1.5, 0.80, 0.40, 5.0, 6e-4
#: Classes of a cell that are compared in one task at most with each other, before its blocks are dealt to several.
BLOCK = 1024


def projections_for(n: int) -> int:
    return max(3, math.ceil(math.log(max(n, 1) / CELL) / -math.log(FAR)))


def tables_for(projections: int) -> int:
    return math.ceil(math.log(MISSED) / math.log1p(-(NEAR**projections)))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(units: np.ndarray, projections: int) -> np.ndarray:
    """A 64-bit key for each row and table. Vectors and directions are rounded to integers, so that their products are
    exact and a vector has the same keys wherever they are computed."""
    dim, tables = units.shape[1], tables_for(projections)
    rng = np.random.default_rng((dim, projections))
    directions = np.rint(rng.standard_normal((dim, tables * projections)) * 1024)
    offsets = np.rint(rng.random(tables * projections) * WIDTH * (1 << 30))
    at = np.floor((np.rint(units * (1 << 20)) @ directions + offsets) / (WIDTH * (1 << 30))).astype(np.int64).view(np.uint64)
    at = at.reshape(len(units), tables, projections)
    key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), (len(units), tables))
    for k in range(projections):
        key = mix(key * np.uint64(31) + at[:, :, k])
    return key


def pairs_within(units: np.ndarray, run: np.ndarray, side: np.ndarray, threshold: float):
    """(i, j) of rows of the same run (rows are sorted by it) and, where a run has two sides, of different sides, at
    cosine threshold or more. Products by blocks find what may reach it; whether it does is one sum for every pair, which
    does not depend on what it is found with."""
    n = len(units)
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(first, n))
    of = np.repeat(np.arange(len(first)), size)

    def settled(i: np.ndarray, j: np.ndarray):
        for part in np.array_split(np.arange(len(i)), len(i) // 20000 + 1):
            ok = part[np.einsum("ij,ij->i", units[i[part]], units[j[part]]) >= threshold]
            yield i[ok], j[ok]

    # runs of a few rows all at once by distance in the table, others by products of their own
    few = (size <= 16)[of]
    for lag in range(1, 16):
        i = np.flatnonzero((of[:-lag] == of[lag:]) & few[:-lag]) if n > lag else np.zeros(0, np.int64)
        if not len(i):
            break
        yield from settled(i, i + lag)
    for f, m in zip(first[size > 16].tolist(), size[size > 16].tolist()):
        x = units[f : f + m]
        for a in range(0, m, BLOCK):
            i, j = np.nonzero(x[a : a + BLOCK] @ x.T >= threshold - 1e-9)
            i += a
            ok = i < j
            if side[f : f + m].any():
                ok &= side[f + i] != side[f + j]
            yield from settled(f + i[ok], f + j[ok])


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    1. Equal vectors of one label become a class, whose node is its least vec_id with a hash of the vector.
    2. Each class is posted in every table under its label, length and cells, with projections and tables by the number of
       classes of its label and length. Cells with one class are dropped; a cell of more than `block` classes is cut into
       blocks, and each pair of blocks is one unit of work.
    3. A unit computes the cosines of its pairs in double precision. A pair is counted only in the first table whose
       cells it shares, so that n_links (copies counted) needs no list of pairs; of links a unit gives only those
       that join its components.
    4. Components over these links.

    Rows whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, have n_links
    0 and are kept, each a component of its own; vectors of different length aren't compared. A null vec_id comes after
    all others; its component_id is null if no other is in it. Other columns are ignored; no rows give no rows.
    """
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    good = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    src = src.withColumn("s", F.when(good, F.xxhash64("label", F.size("v"), "v")))
    classes = src.filter("s is not null").groupBy("label", "v", "s").agg(F.min(F.coalesce("vec_id", F.lit(LAST))).alias("d"), F.count("*").alias("copies"))
    scratch = Scratch(vectors.sparkSession)
    classes = scratch.cut(classes.select(F.struct("d", "s").alias("node"), "s", "label", "v", "copies", F.size("v").alias("dim"), F.xxhash64("label", F.size("v")).alias("apart")))

    def batch_vectors(column) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])

    def post(batches):
        for batch in batches:
            flat, at = batch_vectors(batch.column(1))
            dims, n = np.diff(at), batch.column(3).to_numpy()
            apart = batch.column(2).to_numpy().view(np.uint64)
            for dim, size in np.unique(np.stack([dims, n], 1), axis=0).tolist():
                every = np.flatnonzero((dims == dim) & (n == size))
                for rows in np.array_split(every, len(every) // 2048 + 1):
                    keys = cells(unit_vectors(flat[at[rows][:, None] + np.arange(dim)]), projections_for(size))
                    tables = keys.shape[1]
                    bucket = mix(keys + mix(apart[rows])[:, None]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(rows, tables))), pa.array(bucket.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows)))], names=["node", "bucket", "t"])

    sizes = classes.groupBy("apart").agg(F.count("*").alias("n"))
    counted = scratch.cut(split_join(classes, sizes, ["apart"]))
    scratch.drop(classes)
    classes = counted
    posts = classes.select("node", "v", "apart", "n").mapInArrow(post, f"node {NODE}, bucket long, t int")
    full = posts.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket", F.ceil(F.col("m") / block).alias("blocks"))
    todo = split_join(posts, full, ["bucket"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    roles = todo.select("node", "t", "bucket", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    roles = roles.select("node", F.struct(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "t", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).cast("int").alias("two")).alias("role"))
    roles = roles.groupBy("node").agg(F.collect_list("role").alias("roles")).join(classes, "node")
    units = roles.select("node", "v", "copies", "n", F.explode("roles").alias("r")).select("r.unit", "r.t", "r.side", "r.two", "node", "copies", "n", "v")
    units = units.repartition("unit").sortWithinPartitions("unit")

    def solve(t: pa.Table):
        flat, at = batch_vectors(t.column("v").combine_chunks())
        if len(at) < 3:
            return
        x = unit_vectors(flat.reshape(len(at) - 1, -1))
        run, side, two, no = (t.column(c).to_numpy() for c in ("unit", "side", "two", "t"))
        copies, node = t.column("copies").to_numpy(), t.column("node").combine_chunks()
        count, keys = np.zeros(len(x), np.int64), cells(x, projections_for(t.column("n")[0].as_py()))
        for i, j in pairs_within(x, run, side, threshold):
            ok = ~((two[i] == 1) & (side[i] == side[j]))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            # a pair counts, and links, in the first table alone whose cells it shares
            new = np.concatenate([(keys[i[part]] == keys[j[part]]).argmax(1) == no[i[part]] for part in np.array_split(np.arange(len(i)), len(i) // 20000 + 1)])
            i, j = i[new], j[new]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            up = spanning(i, j, len(x))
            a, b = np.flatnonzero(up != np.arange(len(x))), up[up != np.arange(len(x))]
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b)), pa.array(a * 0)], names=["a", "b", "links"])
        got = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([node.take(pa.array(got)), node.take(pa.array(got)), pa.array(count[got])], names=["a", "b", "links"])

    def work(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            run = t.column("unit").to_numpy()
            end = int(np.searchsorted(run, run[-1]))
            held = t.slice(end)
            yield from by_length(t.slice(0, end))
        if held is not None:
            yield from by_length(held)

    def by_length(t: pa.Table):
        if not len(t):
            return
        dims = t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        kinds = np.stack([dims, t.column("n").to_numpy()], 1)  # vectors that have the same tables
        for kind in np.unique(kinds, axis=0):
            yield from solve(t.take(pa.array(np.flatnonzero((kinds == kind).all(1)))))

    found = scratch.cut(units.mapInArrow(work, f"a {NODE}, b {NODE}, links long"))
    joined = forest(found.filter("a <> b").select("a", "b"), scratch)
    counts = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    ids = classes.select("label", "v", "s", "node", "copies").join(counts, "node", "left").join(joined, "node", "left")
    ids = ids.select("label", "v", "s", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce(F.col("component.d"), F.col("node.d")).alias("component_id"))
    out = src.join(ids, ["s", "label", "v"], "left")
    component = F.when(F.col("component_id").isNull(), F.col("vec_id")).when((F.col("component_id") != LAST) | (F.col("vec_id") == LAST), F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings of equal label at a cosine of 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
