"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset and the master is local (tests,
a laptop) a temporary folder of this machine is used; on a cluster it must be set. Tables written here survive the
loss of any executor and are removed when the JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
#: Bytes of stored input for one part of a shuffle or one file.
_PART_BYTES = 64 << 20
_MOST_PARTS = 100_000
#: What the optimizer takes for the size of an input that it knows nothing of is far above.
_UNKNOWN = 1 << 60


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets a local one only if none is configured and the master is local."""
    found = spark.sparkContext.getConf().get(_CONF) or spark.conf.get(_CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_CONF} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sedgeline-")
        spark.conf.set(_CONF, found)
    return found.rstrip("/")


def parts_for(df: DataFrame, part_bytes: int = _PART_BYTES) -> int:
    """Parts for ``df``: as many as the size of the files below asks for, and at least as many as the session's shuffles have.

    Inputs whose size isn't known count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(s for s in sizes if s < _UNKNOWN)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // part_bytes), _MOST_PARTS))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted at JVM exit."""
    root = f"{shared_dir(spark)}/sedgeline"
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as a zstd Parquet table in the shared folder, and read back.

    Cuts the lineage: what is read back does not depend on any executor's memory or local disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with its rows' numbers, from 1, in an order over all of them, though no task sees them all.

    Rows are spread by ranges of the order and written; each range counts its own, and begins where the ranges before it end. The
    offsets are one row a range.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    ranged = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in zip(keys, order, strict=True)]).repartitionByRange(parts_for(df), *keys)
    kept = stored(ranged.withColumn("__range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return kept.withColumn("__own", own).join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).select(*df.columns, name)
