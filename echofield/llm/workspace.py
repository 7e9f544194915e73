"""Shared working folders and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key is spread over several tasks where it has more rows than this, and more than this share of all rows.
HOT_ROWS, MAX_HOT_KEYS = 1000, 100_000


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session leaves that setting unset and runs on one machine is a local folder chosen.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="echofield-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage.

    Reading the files survives the loss of any executor. Tables of hashes take codec "none": hashes do not compress,
    and each open file's codec holds buffers outside the heap until the next collection.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def bucketed(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """``df`` written as a table bucketed and sorted by ``keys``, and read back.

    There are as many buckets as shuffle partitions, so a join or aggregation by the keys needs no exchange of it.
    No codec is used, see ``written``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    name = "echofield_" + path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).sortBy(*keys).options(path=path, compression="none").format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.written_path, table.written_name = path, name
    return table


@contextmanager
def _setting(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sorted_buckets(spark: SparkSession):
    """Plans made inside rely on the order of buckets that are one file each, as ``bucketed`` writes them."""
    return _setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true", "false")


def small_batches(spark: SparkSession, rows: int = 2000):
    """Texts go to Python in batches of at most ``rows`` rows, as a batch is held in both processes."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows), "10000")


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, by: Column) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, one row a key, whose column ``count`` tells the key's rows.

    Keys of many rows are dealt by ``by`` over several tasks, with a copy of the key's row for each. Such a key has more
    than 1/MAX_HOT_KEYS of the ``total`` rows, so the broadcast holds at most MAX_HOT_KEYS keys at any size.
    """
    limit = max(HOT_ROWS, total // MAX_HOT_KEYS)
    parts = F.ceil(F.col(count) / limit)
    hot = per_key.filter(F.col(count) > limit).select(key, parts.alias("__parts"))
    dealt = rows.withColumn("__by", by).join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod("__by", "__parts"), F.lit(0).cast("bigint"))).drop("__by", "__parts")
    copies = per_key.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copies, [key, "__part"]).drop("__part")


def forget(*tables: DataFrame) -> None:
    """Delete tables that nothing refers to any more, through Hadoop so that any store works."""
    for table in tables:
        spark = table.sparkSession
        if getattr(table, "written_name", None):
            spark.sql(f"DROP TABLE IF EXISTS {table.written_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
