"""Stores of large runs and the log of units: bounded files, and each unit once whatever happens."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from patchlane.sources import runs, unit_log

UNIT = "dataset string, method string, n_train int, seed int"


def results(spark, seeds, value=0.0, rows=2):
    made = [("d", "m", 1, s, k, value + s) for s in seeds for k in range(rows)]
    return spark.createDataFrame(made, UNIT + ", part int, img_ap double")


def logged(spark, path):
    return sorted((r.seed, r.part, r.img_ap) for r in unit_log.read(spark, path).collect())


def test_units_are_there_once_after_repeats_and_broken_attempts(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with pytest.raises(ValueError):
        unit_log.read(spark, path)
    assert unit_log.read(spark, path, schema=UNIT).collect() == [] and unit_log.winners(spark, path) is None
    unit_log.write_rows(results(spark, [0, 1], 100.0), path, unit_log.new_attempt())  # killed before its commit
    assert unit_log.winners(spark, path) is None
    first = unit_log.append(results(spark, [0, 1]), path)
    unit_log.append(results(spark, [1, 2], 50.0), path)  # 1 is done
    unit_log.append(results(spark, [0, 1, 2], 70.0), path)
    assert logged(spark, path) == [(s, k, v + s) for s, v in ((0, 0.0), (1, 0.0), (2, 50.0)) for k in (0, 1)]
    assert {r.seed: r.attempt for r in unit_log.winners(spark, path).collect()}[1] == first
    # A unit without rows is finished, too, and a later attempt may bring new columns.
    unit_log.append(results(spark, []), path, units=results(spark, [7]).select(*runs.KEYS))
    unit_log.append(results(spark, [7, 8]).withColumn("aupro", F.lit(0.5)), path)
    assert [r.aupro for r in unit_log.read(spark, path).where("seed >= 7").collect()] == [0.5, 0.5]


def test_two_attempts_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    a, b = unit_log.new_attempt(), unit_log.new_attempt()
    for attempt, value in ((b, 10.0), (a, 20.0)):  # both looked before either wrote
        rows = unit_log.write_rows(results(spark, [0, 1], value), path, attempt)
        unit_log.commit(rows.select(*runs.KEYS), path, attempt)
    assert logged(spark, path) == [(s, k, 20.0 + s) for s in (0, 1) for k in (0, 1)]
    jobs = [threading.Thread(target=unit_log.append, args=(results(spark, [s, 5], float(s)), path)) for s in (2, 3, 4)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    found = logged(spark, path)
    assert [r[:2] for r in found] == [(s, k) for s in range(6) for k in (0, 1)]
    assert len({v for s, _, v in found if s == 5}) == 1  # one attempt's rows, not a mixture


def test_files_are_bounded_and_a_run_is_read_alone(spark, tmp_path):
    maps = spark.range(30_000).selectExpr("id as image_id", "cast(0 as int) as y", "cast(0 as int) as x", "rand(1) as value", "if(id % 3 = 0, 'hot', concat('d', id % 40)) as dataset", "'m' as method", "1 as n_train", "0 as seed")
    path = f"file://{tmp_path}/maps"
    runs.save_maps(maps, path, file_bytes=64_000)
    hot = runs.load_maps(spark, path, dataset="hot")
    files = [f for f in hot.inputFiles() if "/dataset=hot/" in f]
    assert "PartitionFilters: [isnotnull(dataset" in hot._jdf.queryExecution().executedPlan().toString()
    sizes = [spark.read.parquet(f).count() for f in files]
    whole = 64_000 // 46  # rows of about 46 bytes in a file
    assert hot.count() == 10_000 and len(files) >= 5 and max(sizes) < 3 * whole
    assert sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(tmp_path / "maps")) < 41 + 2 * (30_000 // whole)
    extents = sorted(spark.read.parquet(f).agg(F.min("image_id"), F.max("image_id")).first()[:] for f in files)
    assert all(a[1] < b[0] for a, b in zip(extents, extents[1:]))  # files hold ranges, so their statistics prune
    assert runs.load_maps(spark, path, dataset="d7").count() == maps.where("dataset = 'd7'").count()
    runs.save_maps(maps.limit(0), f"{path}-none")


def test_features_are_cached_once(spark, tmp_path):
    rows = spark.range(50).selectExpr("id as image_id", "0 as gy", "0 as gx", "array(1.0D, 2.0D) as vec", "'d' as dataset", "concat('v', id % 2) as view")
    path = f"file://{tmp_path}/features"
    assert runs.cache_features(rows, path).count() == 50 == runs.cache_features(rows.where("false"), path).count()
    assert rows.select(runs.row_bytes(rows).alias("b")).first().b == 8 * 3 + 16 + 1 + 2
