"""Where tables go that are written during a query: the folder that all machines share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, of terms and ids some 60 bytes each; and its bytes, where Spark knows them.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 256 << 20
_kept: dict[tuple, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir. Only a local master, as in tests, may leave that unset; then it is a
    temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rankloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df, written once and read from there by all that use it."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_of(df: DataFrame) -> tuple:
    """What decides the rows of df: its plan, and name, length and time of change of every file it reads, as Spark has
    listed them."""
    plan, files = df._jdf.queryExecution().analyzed(), []
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            files.append(leaf.relation().location().allFiles().mkString(","))  # one call, however many files there are
    return df.semanticHash(), plan.canonicalized().toString(), hashlib.sha256("\n".join(files).encode()).hexdigest()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def literal(path: str) -> str:
    """A path whose brackets and stars are letters, not a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def once(key: tuple, build):
    """What build() gives, asked for once in an application for each key."""
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has at most `most` rows (which is counted: df is best a stored table) and, where it is made
    of one table, that has no more than BROADCAST_BYTES; else as it is, to be joined by exchange."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.collectLeaves().size() == 1 and int(plan.stats().sizeInBytes()) > BROADCAST_BYTES:
        return df
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer: whole texts are then read by all."""
    if df.isStreaming:
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df
