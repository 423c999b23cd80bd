"""Image catalogs from path tables: folder layout, masks, split files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File name endings of images.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp")


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a folder, relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return found.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", "").alias("path"))


def image_catalog(paths: DataFrame) -> DataFrame:
    """dataset, split, defect, stem, path and label of images in <dataset>/train/good and <dataset>/test/<defect>."""
    part = lambda g: F.regexp_extract("path", r"^(.*)/(train|test)/([^/]+)/([^/]+)\.([^./]+)$", g)
    made = paths.select("path", part(1).alias("dataset"), part(2).alias("split"), part(3).alias("defect"), part(4).alias("stem"), F.lower(part(5)).alias("ext"))
    kept = made.where(F.col("ext").isin(*EXTENSIONS) & ((F.col("split") == "test") | ((F.col("split") == "train") & (F.col("defect") == "good"))))
    return kept.withColumn("label", F.when(F.col("defect") == "good", 0).otherwise(1)).drop("ext")


def resolve_masks(images: DataFrame, paths: DataFrame) -> DataFrame:
    """Test images with mask_path: <stem>.png in the defect's mask folder, else <stem>_mask.png; null for good ones."""
    part = lambda g: F.regexp_extract("path", r"^(.*)/ground_truth/([^/]+)/([^/]+?)(_mask)?\.png$", g)
    masks = paths.select(F.col("path").alias("mask_path"), part(1).alias("dataset"), part(2).alias("defect"), part(3).alias("stem"), (part(4) != "").alias("second")).where("dataset <> ''")
    best = masks.withColumn("k", F.row_number().over(Window.partitionBy("dataset", "defect", "stem").orderBy("second"))).where("k = 1").drop("k", "second")
    bad = images.where("split = 'test'")
    joined = bad.join(best, ["dataset", "defect", "stem"], "left")
    return joined.withColumn("mask_path", F.when(F.col("label") == 1, F.col("mask_path")))


def mask_folders(images: DataFrame, paths: DataFrame) -> DataFrame:
    """Test images with all masks of <defect>/<stem>/, as a sorted array."""
    part = lambda g: F.regexp_extract("path", r"^(.*)/ground_truth/([^/]+)/([^/]+)/[^/]+\.png$", g)
    masks = paths.select("path", part(1).alias("dataset"), part(2).alias("defect"), part(3).alias("stem")).where("dataset <> ''")
    found = masks.groupBy("dataset", "defect", "stem").agg(F.array_sort(F.collect_set("path")).alias("mask_paths"))
    return images.where("split = 'test'").join(found, ["dataset", "defect", "stem"], "left")


def load_split(rows: DataFrame, paths: DataFrame, category: str) -> DataFrame:
    """Split-file rows (object, split, label, image, mask) of a category whose image exists; blank masks are null."""
    own = rows.where((F.col("object") == category) & F.col("split").isin("train", "test")).join(paths.select(F.col("path").alias("image")), "image", "left_semi")
    return own.select("image", "split", F.when(F.col("label") == "normal", 0).otherwise(1).alias("label"), F.nullif(F.trim(F.coalesce("mask", F.lit(""))), F.lit("")).alias("mask"))


def union_masks(cells: DataFrame, value: str = "value") -> DataFrame:
    """Set cells of an image over all its masks."""
    return cells.groupBy("image_id", "y", "x").agg(F.max((F.col(value) > 0).cast("int")).alias("value")).where("value = 1")
