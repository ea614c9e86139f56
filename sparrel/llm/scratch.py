"""Intermediate tables in the folder that the driver and all executors share, and columns by any name."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that this driver has written and not yet deleted.
_WRITTEN: list[str] = []


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only on one machine, where none is. RuntimeError on a cluster without one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparrel-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors. ``release`` deletes it."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    _WRITTEN.append(path)
    del df
    # shuffle files of the written plan go once the driver has collected it; else they would fill disks until it does by chance
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that operators wrote so far. For callers that have stored their results: what was not yet computed from them is lost."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
