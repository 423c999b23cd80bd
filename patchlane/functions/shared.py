"""Folders that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir; a local one only where that is unset in local mode. Its folder goes when the
    application's JVM ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/patchlane-shared"
    folder = f"{base.rstrip('/')}/patchlane-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/table"


def stored(df: DataFrame) -> DataFrame:
    """df written to a new shared folder and read again, so that what reads it several times computes it once, and lost
    executors cost a retry only."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that stored wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(table: DataFrame) -> int:
    """Bytes of the numbers in a table's arrays, and eight a row."""
    arrays = [F.size(f.name) for f in table.schema if f.dataType.typeName() == "array"]
    return int(table.agg(F.coalesce(F.sum(sum(arrays, F.lit(1)) * 8), F.lit(0))).first()[0])
