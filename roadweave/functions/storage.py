"""Shared storage for results that are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder in local mode (tests); on a cluster that is an error, as
    no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not found and known.isDefined():
        found = known.get()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not known.isDefined():
        context.setCheckpointDir(found)
    return found


_folders: dict[tuple[str, str], str] = {}


def session_dir(spark: SparkSession) -> str:
    """A folder of this session in the shared one; it is deleted when the session's JVM ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _folders:
        folder = f"{key[1].rstrip('/')}/tables-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders[key] = folder
    return _folders[key]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and gives true sizes."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to all shuffle partitions, also where its rows are few.

    For steps that cost much a row (windows, n-grams) and group by ``keys`` afterwards: that grouping
    then needs no shuffle of its own, and adaptive execution does not put small partitions together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
