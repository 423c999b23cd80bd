"""Shared plumbing of the training-data operators: shared folder, materialised tables, Arrow batch mapping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on at once; longer texts are taken alone, whole.
SLICE_BYTES = 2 << 20
#: Bytes of text whose words are looked for at once: arrays of this size stay in the cache and are not mapped anew each time.
BLOCK_BYTES = 1 << 18
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder the cluster names in spark.checkpoint.dir.

    Only where the setting is missing (tests, local mode) a local folder is used."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/patchlane-shared"
    return f"{base.rstrip('/')}/patchlane-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives lost executors.

    The write's shuffle files are no longer needed then, and Spark may drop them when it ends."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.mode("overwrite").parquet(path)  # a frame made under the setting
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that materialize wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that is free inside this Python worker back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose sizes come to about limit together; a larger row stands in a run's end."""
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about limit bytes together."""
    yield from slices(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), limit)


def array_slices(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Runs of rows of a string array with about limit bytes together."""
    for part in text_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", limit):
        yield part.column(0)


def compute_columns(
    df: DataFrame,
    text_col: str,
    carry: list[str],
    fields: list[T.StructField],
    fn: Callable[[pa.Array], list],
    setup: Callable[[], object] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Add columns that fn computes from slices of text_col (nulls as empty strings), keeping the columns in carry.

    fn(texts) or, with setup, fn(texts, state) returns one array for each field. A computed name replaces a carried
    column of that name. The text itself only returns to the JVM if carry names it."""
    names = {f.name for f in fields}
    carry = [c for c in carry if c not in names]
    kept = [df.schema[c] for c in carry]
    schema = T.StructType([*kept, *fields])
    passed = text_col in carry and isinstance(df.schema[text_col].dataType, T.StringType)
    own = text_col if passed else "__text__"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in text_slices(batch, own, limit):
                texts = pc.fill_null(part.column(own), "")
                made = fn(texts, state) if setup else fn(texts)
                arrays = [part.column(i) for i in range(len(carry))]
                arrays += [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in made]
                yield pa.RecordBatch.from_arrays(
                    [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=[f.name for f in schema]
                )
        release()

    source = df.select(*[df[c] for c in carry], *([] if passed else [df[text_col].cast("string").alias(own)]))
    return source.mapInArrow(run, schema)
