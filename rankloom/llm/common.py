"""Shared plumbing: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder

#: The white space that separates words everywhere in this folder.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator: compressed parquet in the shared folder, so that a lost executor costs no
    recomputation. drop() deletes a table once what was made from it is durable; all go at the application's end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/rankloom-{uuid.uuid4().hex}"
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = self.path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.fs.mkdirs(self.path)
        self.fs.deleteOnExit(self.path)
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and go on from what was written."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._kept = self.paths  # its id stays its own as long as it lives
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and (path := self.paths.pop(id(t), None)):
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def close(self) -> None:
        """Delete all tables; nothing made from them may be computed later."""
        self.paths.clear()
        self.fs.delete(self.path, True)


def crc_of_id(column: str = "doc_id"):
    """crc32 of the decimal text of an id; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 19):
    """Cut an Arrow batch into runs of rows whose strings hold about limit bytes, so that memory in a worker stays bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for a left side with very many rows of one key and a right side fresh from a group-by.

    Joined on two 64-bit hashes of the keys: Spark can't see that right is already dealt by them, so both sides get an
    exchange of their own, and only then can it split the tasks of the hot key.
    """
    names = ["_split0", "_split1"]
    marks = lambda: [F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)]
    r = right.withColumns(dict(zip(names, marks()))).drop(*keys)
    return left.withColumns(dict(zip(names, marks()))).join(r, names, how).drop(*names)


#: What edges join: an id and what tells rows of equal ids apart.
NODE = "struct<d:long,s:long>"


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row it is connected with by pairs (i, j)."""
    up = np.arange(n)
    while True:
        new = up.copy()
        np.minimum.at(new, i, up[j])
        np.minimum.at(new, j, up[i])
        new = new[new]
        if np.array_equal(new, up):
            return up
        up = new


def stars(x: np.ndarray) -> np.ndarray:
    """Rows (a.d, a.s, b.d, b.s), edges -> rows (node, least node of its component), for all nodes but the least ones."""
    both = np.concatenate([x[:, :2], x[:, 2:]])
    order = np.lexsort((both[:, 1], both[:, 0]))
    new = np.concatenate([[True], (np.diff(both[order], axis=0) != 0).any(1)])
    no = np.empty(len(both), np.int64)
    no[order] = np.cumsum(new) - 1
    nodes = both[order[new]]
    root = spanning(no[: len(x)], no[len(x) :], len(nodes))
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return np.concatenate([nodes[at], nodes[root[at]]], 1)


def contracted(batches, most: int = 1 << 20):
    """The edges of one task as stars; a task's memory holds one edge for each of its nodes and `most` more."""
    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(c).field(k).to_numpy() for c in (0, 1) for k in (0, 1)], 1))
        size += len(held[-1])
        if size > most:
            held = [stars(np.concatenate(held))]
            size = 0
    x = stars(np.concatenate(held)) if held else np.zeros((0, 4), np.int64)
    node = lambda k: pa.StructArray.from_arrays([pa.array(x[:, k]), pa.array(x[:, k + 1])], ["d", "s"])
    yield pa.RecordBatch.from_arrays([node(0), node(2)], names=["a", "b"])


def forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b) of NODEs, as (node, component) for every node that isn't the least of its own.

    Each round joins up the edges that lie in one task as they come (no exchange), and then brings together the least
    nodes that each node was given by different tasks, which are as many as tasks at most; if a node got several, these
    are the next round's edges. It ends when every node has one. Then nodes point at smaller nodes, and pointers are
    followed, twice as far each time, until none moves. Both loops end by themselves, as edges only move to smaller
    nodes. No task holds a node's neighbours; joins on a node that very many point at can be split.
    """
    e, old = edges.select("a", "b"), None
    while True:
        got = e.mapInArrow(contracted, f"a {NODE}, b {NODE}").groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs"))
        first = F.col("bs")[0]
        rows = F.transform("bs", lambda x, i: F.struct(F.when(i == 0, F.col("a")).otherwise(x).alias("a"), first.alias("b"), (i > 0).alias("more")))
        now = scratch.cut(got.select(F.explode(rows).alias("x")).select("x.*"))
        scratch.drop(old)
        e, old = now.select("a", "b"), now
        if now.filter("more").isEmpty():
            break
    up = scratch.cut(e.select(F.col("a").alias("node"), F.col("b").alias("component"), F.lit(True).alias("moved")))
    scratch.drop(old)
    while not up.filter("moved").isEmpty():
        above = up.select(F.col("node").alias("at"), F.col("component").alias("to"))
        now = split_join(up.select("node", F.col("component").alias("at")), above, ["at"], "left")
        now = scratch.cut(now.select("node", F.coalesce("to", "at").alias("component"), F.col("to").isNotNull().alias("moved")))
        scratch.drop(up)
        up = now
    return up.select("node", "component")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge table (a, b) of longs: (node, component) for every node that has an edge
    to another, component being the least node reachable."""
    node = lambda c: F.struct(F.col(c).alias("d"), F.lit(0).cast("long").alias("s")).alias(c)
    found = forest(edges.filter("a <> b").select(node("a"), node("b")), Scratch(edges.sparkSession)).select("node.d", F.col("component.d").alias("c"))
    return found.select(F.col("d").alias("node"), F.col("c").alias("component")).unionByName(found.select(F.col("c").alias("node"), F.col("c").alias("component")).distinct())
