"""Stored tables that are dealt by a key: files hold one bucket each, so that a join or a sum on the key moves only the other
side, and a lookup of few keys opens only their buckets."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of one table at most.
MOST_BUCKETS = 4096
#: Bytes of the files that one bucket is made of, so that what a task holds doesn't grow with the table.
BUCKET_BYTES = 8 << 20
#: Values that a lookup hands to the scan as literals.
MOST_LITERALS = 1000


def buckets_for(df: DataFrame) -> int:
    """As many as df has partitions, but no fewer than there are cores, and one for every BUCKET_BYTES that it reads."""
    n = max(df._jdf.queryExecution().toRdd().getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism, bytes_read(df) // BUCKET_BYTES)
    return min(n, MOST_BUCKETS)


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files and local rows that df is made of; 0 where Spark doesn't know them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return n if n < 1 << 50 else 0  # what isn't known counts as the greatest number


def write_table(df: DataFrame, path: str, buckets: int, by: str, sort: list[str], folder: str | None = None, dealt: bool = False) -> DataFrame:
    """Write df dealt by a hash of `by` and, within a bucket, sorted; with `folder` (a column) in one folder for each of its
    values too. Read back as read_table does. dealt: df comes from repartition(buckets, by), and isn't moved again (if that
    isn't so, a bucket has several files)."""
    spark = df.sparkSession
    rows = df if dealt else df.repartition(buckets, by)
    out = rows.write.option("path", f"{path}/data").bucketBy(buckets, by).sortBy(*sort)
    name = name_of(path)
    (out.partitionBy(folder) if folder else out).saveAsTable(name)
    spark.createDataFrame([(buckets, by, sort, folder)], "buckets int, by string, sort array<string>, folder string").write.json(f"{path}/spec")
    return spark.table(name)


def name_of(path: str) -> str:
    return f"rankloom_{hashlib.md5(path.encode()).hexdigest()}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of write_table, in this session or another: Spark learns how it is dealt from its specification."""
    name = name_of(path)
    if not spark.catalog.tableExists(name):
        spec = spark.read.schema("buckets int, by string, sort array<string>, folder string").json(f"{path}/spec").first()
        schema = spark.read.parquet(f"{path}/data").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parted = f"PARTITIONED BY (`{spec['folder']}`)" if spec["folder"] else ""
        order = ", ".join(f"`{c}`" for c in spec["sort"])
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parted} CLUSTERED BY (`{spec['by']}`) SORTED BY ({order}) INTO {spec['buckets']} BUCKETS LOCATION '{path}/data'")
        if spec["folder"]:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def drop_table(spark: SparkSession, path: str) -> None:
    """Forget a table's name, which a metastore would keep beyond the application; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name_of(path)}")


@contextmanager
def whole_buckets(spark: SparkSession):
    """What is planned within reads dealt tables a bucket a task. Else Spark cuts their files into splits where no join or sum
    needs them dealt, and as it has left out the exchange to the same buckets by then, tasks over whole splits sort them."""
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rows_of(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of a table whose key is among those of wanted (column key; a stored, cheap table). Up to MOST_LITERALS
    distinct keys are handed to the scan, which opens their buckets alone; more are left to the join that follows."""
    few = [r[0] for r in wanted.select(key).filter(F.col(key).isNotNull()).distinct().limit(MOST_LITERALS + 1).collect()]
    return table.filter(F.col(key).isin(few)) if len(few) <= MOST_LITERALS else table
