"""A log of result rows by unit that holds each unit once, whatever fails, repeats or runs at the same time.

An attempt writes its rows below `data/attempt=<name>` and then one file below `commits/` that names the units it has
finished. Rows count only by that file: what a job that broke off left behind is not read. Where several attempts have
committed a unit, the one of the least (time, name) counts, for every reader alike, so units are neither lost nor doubled.
Nothing is ever changed in place, so the log works on any shared folder whose single files appear whole."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import KEYS


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def new_attempt() -> str:
    """A name that sorts by time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def winners(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame | None:
    """keys and the attempt that counts, of every committed unit; none before the first commit."""
    if not exists(spark, f"{path}/commits"):
        return None
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/commits").groupBy(*keys).agg(F.min("attempt").alias("attempt"))


def write_rows(df: DataFrame, path: str, attempt: str) -> DataFrame:
    """The attempt's rows, written, as they are read back; they do not count yet."""
    place = f"{path}/data/attempt={attempt}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def commit(units: DataFrame, path: str, attempt: str) -> None:
    """One file of the units that the attempt has finished, those without a row, too."""
    units.distinct().withColumn("attempt", F.lit(attempt)).coalesce(1).write.parquet(f"{path}/commits/{attempt}")


def append(df: DataFrame, path: str, keys: Sequence[str] = KEYS, units: DataFrame | None = None) -> str:
    """Add the rows of units that no attempt has committed yet, and commit them (all that `units` names, otherwise those with
    rows). Gives the attempt's name."""
    keys, spark, attempt = list(keys), df.sparkSession, new_attempt()
    known = winners(spark, path, keys)
    if known is not None:
        df = df.join(known.select(*keys), keys, "left_anti")
        units = None if units is None else units.select(*keys).join(known.select(*keys), keys, "left_anti")
    written = write_rows(df, path, attempt)
    commit((written if units is None else units).select(*keys), path, attempt)
    return attempt


def read(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, schema: str | None = None) -> DataFrame:
    """The rows of committed units, each unit once. schema is only needed where the log may be empty."""
    known = winners(spark, path, keys)
    if known is None:
        if schema is None:
            raise ValueError(f"nothing is committed at {path}")
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(f"{path}/data")
    return rows.join(known, [*keys, "attempt"], "left_semi").drop("attempt")
