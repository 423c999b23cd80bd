"""Whole runs: from references to image scores and maps, and from a work grid to appended result rows.

Patches are the 4 x 4 patches of each image in two layers (see fixtures); an image's category is its identifier modulo 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mathx
from ..functions.shared import scratch
from ..operators import grid as grd
from ..operators import localize
from ..operators import metrics as met
from ..operators import mixtures as mix
from ..operators import planning as jon
from ..operators import pooling as pol
from ..operators import projections as prj
from ..sources import unit_log
from ..sources import runs as run_files
from .registry import query
from .result_queries import rounded
from .vector_queries import all_patches

G, D, K = 4, 8, 3
KAPPA = 20.0


def patches(spark, sf_dir):
    rows = all_patches(spark, sf_dir).withColumn("row_id", F.concat_ws("|", *[F.col(c).cast("string") for c in ("image_id", "layer", "gy", "gx")]))
    return rows.withColumn("dataset", F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string")))


def layer_maps(scored, sigma=1.0, keys=()):
    """Smoothed maps of each layer: keys, image_id, layer, y, x, value."""
    cells = scored.select(*keys, "image_id", "layer", F.col("gy").alias("y"), F.col("gx").alias("x"), "value")
    return grd.gaussian_smooth(cells, sigma, G, G, (*keys, "image_id", "layer"))


def tail_scores(spark, sf_dir):
    """Chi-square tail scores of all patches in the shrunk mixture of their layer's references."""
    rows = patches(spark, sf_dir)
    models = mix.fit_by_key(rows.where("is_ref"), ["layer"], K, D, KAPPA)
    scored = mix.score_by_key(rows.select("image_id", "layer", "gy", "gx", "mask", "vec"), models, ["layer"])
    return scored.withColumn("value", mathx.chi2_tail_score(F.col("distance"), D))


@query("run1_fit_and_score")
def _(spark, sf_dir):
    """Image scores: PCA, shrunk mixture, tail score, smoothing, 95th percentile of each layer, mean over layers."""
    scored = tail_scores(spark, sf_dir)
    scores = pol.layer_mean(pol.pool(layer_maps(scored), "p95", ("image_id", "layer")))
    labels = scored.groupBy("image_id").agg(F.max("mask").alias("label"))
    return rounded(scores.join(labels, "image_id"), "score")


@query("run2_score_maps")
def _(spark, sf_dir):
    """Score maps: the layers' smoothed maps, averaged and upsampled to sixteen cells a patch side."""
    fused = pol.fused_map(layer_maps(tail_scores(spark, sf_dir)))
    return rounded(grd.upsample(fused, G, G, 16 * G, 16 * G, "corner"), "value")


def rotated_references(rows):
    """Eight views of each reference patch; a view's features stand in for those of the turned image."""
    turned = F.concat(F.slice("vec", F.col("view") * 4 + 1, F.size("vec")), F.slice("vec", F.lit(1), F.col("view") * 4))
    views = rows.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("vec", turned)
    return views.withColumn("row_id", F.concat_ws("|", "row_id", F.col("view").cast("string")))


@query("run4_localize")
def _(spark, sf_dir):
    """The composed calls with the method's own settings for every category: models of the references' eight views, image
    scores of all test images and the mean of their pixel maps (16 cells a patch side)."""
    rows, keys = patches(spark, sf_dir), ["dataset", "layer"]
    models = localize.fit(rotated_references(rows.where("is_ref")), keys)
    scores, maps = localize.score(rows.where("not is_ref"), models, G, keys, ["dataset", "image_id"])
    means = maps.groupBy("dataset", "image_id").agg(F.avg("value").alias("mean_value"), F.count("*").alias("cells"))
    return rounded(scores.join(means, ["dataset", "image_id"]), "score", "mean_value", places=5)


KEYS = list(run_files.KEYS)
METRICS = ["img_ap", "img_auroc", "aupro_30", "aupro_05", "pix_auroc", "pix_ap"]
DONE = [("d0", "knn", 1, 0), ("d1", "knn", 1, 0), ("d1", "mixture", 2, 1)]


def unit_scores(spark, rows, todo, seed_ids):
    """value of every test patch for every unit of todo; features are read once for all units and methods."""
    unit = ["dataset", "n_train", "seed"]
    images = rows.where("is_ref").select("dataset", F.col("image_id").cast("string").alias("path")).distinct()
    drawn = prj.sample_references(images, (1, 2), seed_ids).select("dataset", F.col("n").alias("n_train"), "seed", F.col("path").cast("long").alias("image_id"))
    refs = drawn.join(rows.select("dataset", "image_id", "layer", "row_id", "vec"), ["dataset", "image_id"])
    test = rows.where("not is_ref").select("dataset", "image_id", "layer", "gy", "gx", "vec")
    keys, made = [*unit, "layer"], None
    for method in ("mixture", "knn"):
        units = todo.where(F.col("method") == method).select(*unit)
        own, asked = refs.join(units, unit), test.join(units, "dataset")
        if method == "mixture":
            scored = mix.score_by_key(asked, mix.fit_by_key(own, keys, K, D, KAPPA), keys)
            scored = scored.withColumn("value", mathx.chi2_tail_score(F.col("distance"), D))
        else:
            scored = mix.nearest_by_key(asked, own, keys).withColumn("value", F.col("distance"))
        scored = scored.select(F.lit(method).alias("method"), *unit, "image_id", "layer", "gy", "gx", "value")
        made = scored if made is None else made.unionByName(scored)
    return made


@query("run3_evaluation")
def _(spark, sf_dir):
    """The work grid minus committed units, both methods on shared features, their metrics, and the rows appended to the log
    that holds those of the units that were finished before."""
    folder, seeds = scratch(spark), (0, 1)
    rows = patches(spark, sf_dir)
    rows.write.parquet(f"{folder}/features")
    rows = spark.read.parquet(f"{folder}/features")
    done = spark.createDataFrame([(*d, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5) for d in DONE], "dataset string, method string, n_train int, seed int, " + ", ".join(f"{m} double" for m in METRICS))
    unit_log.append(done, f"{folder}/runs")
    grid = jon.work_grid(rows.select("dataset").distinct(), method=["mixture", "knn"], n_train=[1, 2], seed=list(seeds))
    todo = jon.pending(grid, unit_log.winners(spark, f"{folder}/runs"))
    maps = layer_maps(unit_scores(spark, rows, todo, seeds), keys=KEYS)
    maps.write.parquet(f"{folder}/maps")
    maps = spark.read.parquet(f"{folder}/maps")
    image = rows.where("not is_ref").groupBy("image_id").agg(F.max("mask").cast("int").alias("label"))
    scores = pol.layer_mean(pol.pool(maps, "p95", (*KEYS, "image_id", "layer")), (*KEYS, "image_id")).withColumn("score", F.round("score", 6)).join(image, "image_id")
    on_images = met.curve(scores, keys=KEYS).groupBy(*KEYS).agg(met.ap_of().alias("img_ap"), met.auroc_of().alias("img_auroc"))
    # A patch is defective in both layers or in none.
    mask = rows.where("layer = 'a' and not is_ref").select("image_id", F.col("gy").alias("y"), F.col("gx").alias("x"), "mask")
    cells = pol.fused_map(maps, (*KEYS, "image_id", "y", "x")).join(mask, ["image_id", "y", "x"])
    found = grd.connected_components(grd.masks_of(cells.select("image_id", "y", "x", "mask").distinct()))
    named = cells.select(*KEYS, "image_id", "y", "x").join(found, ["image_id", "y", "x"])
    pixels = met.aupro_binned(cells, named, (0.3, 0.05), KEYS)
    wide = pixels.groupBy(*KEYS).agg(F.max(F.when(F.col("limit") == 0.3, F.col("aupro"))).alias("aupro_30"), F.max(F.when(F.col("limit") == 0.05, F.col("aupro"))).alias("aupro_05"), F.max("pixel_auroc").alias("pix_auroc"), F.max("pixel_ap").alias("pix_ap"))
    made = todo.select(*KEYS).join(on_images, KEYS, "left").join(wide, KEYS, "left")
    unit_log.append(rounded(made.select(*KEYS, *METRICS), *METRICS, places=4), f"{folder}/runs")
    return unit_log.read(spark, f"{folder}/runs")


@query("fit11_restarts")
def _(spark, sf_dir):
    """Of five restarts of each layer's and label's mixture the one of the highest likelihood, for three covariances."""
    refs, made = patches(spark, sf_dir).where("is_ref"), None
    for cov in ("full", "lw", "tied"):
        models = mix.fit_by_key(refs, ["layer", "dataset"], K, D, KAPPA, n_init=5, cov=cov, variant=cov)
        own = models.groupBy("variant", "key").agg(F.max("fit").alias("fit"), F.max("restart").alias("restart"), F.count("*").alias("k"), F.max("rounds").alias("rounds"))
        made = own if made is None else made.unionByName(own)
    return rounded(made, "fit", places=5)
