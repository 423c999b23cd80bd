"""Making the package known to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH_BYTES, BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's source, once a Spark application. Spark's file server carries it."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python workers and back have about 4 MB, unless the application was started with a size of its
    own; at Spark's 64 MB a task holds some of them outside the heap and again in its worker."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, BATCH_LIMIT)
