"""Result rows, score maps and feature caches: reading and storing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the files of a store, before compression.
FILE_BYTES = 256 << 20
KEYS = ("dataset", "method", "n_train", "seed")


def read_runs(spark: SparkSession, path: str, sep: str = ",", rename: Mapping[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """Result rows of CSV files with a header; empty cells are null."""
    reader = spark.read.option("header", True).option("sep", sep)
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return rows.withColumnsRenamed(dict(rename or {}))


def formatted(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics as text of four decimals, null as an empty cell."""
    return df.withColumns({m: F.when(F.col(m).isNotNull(), F.round(m, 4).cast("decimal(20,4)").cast("string")).otherwise("") for m in metrics})


def append_runs(df: DataFrame, path: str, metrics: Sequence[str]) -> None:
    formatted(df, metrics).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row, about: lengths of strings, eight for each number of an array and for anything else."""
    kinds = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: 8 * F.size(c)}
    sizes = [F.coalesce(kinds.get(f.dataType.typeName(), lambda c: F.lit(8))(F.col(f.name)), F.lit(0)) for f in df.schema]
    return sum(sizes, F.lit(0)).cast("long")


def write_store(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], file_bytes: int = FILE_BYTES) -> None:
    """Rows as Parquet, a folder for each combination of keys, in files of about file_bytes.

    Rows are dealt by ranges of (keys, order), as many as their measured bytes ask for, so a large key is written by many
    tasks, small ones share a task, and a file holds a range of `order`, which its statistics tell readers."""
    total = df.select(row_bytes(df).alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    df.repartitionByRange(1 + total // file_bytes, *keys, *order).sortWithinPartitions(*keys, *order).write.mode("overwrite").partitionBy(*keys).parquet(path)


def save_maps(maps: DataFrame, path: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("image_id", "y", "x"), file_bytes: int = FILE_BYTES) -> None:
    """Score maps as Parquet, a folder for each run, so that reading one run touches its files alone."""
    write_store(maps, path, keys, order, file_bytes)


def load_maps(spark: SparkSession, path: str, **run: object) -> DataFrame:
    rows = spark.read.parquet(path)
    for k, v in run.items():
        rows = rows.where(F.col(k) == F.lit(v))
    return rows


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds the mark that Spark leaves when a write has been committed whole."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def cache_features(patches: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Features written once by dataset and view, and read again; a folder with its done mark is only read, one that a
    broken-off write left is written anew."""
    if not is_done(patches.sparkSession, path):
        write_store(patches, path, ["dataset", "view"], [c for c in ("image_id", "gy", "gx") if c in patches.columns], file_bytes)
    return patches.sparkSession.read.parquet(path)
