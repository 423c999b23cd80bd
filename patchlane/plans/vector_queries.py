"""Queries of sources, projections, model fitting and scoring over the path, patch and run views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import mathx
from ..operators import keyed
from ..operators import metrics as met
from ..operators import mixtures as mix
from ..operators import models as fit
from ..operators import pooling as pol
from ..operators import projections as prj
from ..operators import scoring as scr
from ..sources import catalog, patches, unit_log
from ..sources import runs as run_files
from . import fixtures as fx
from .metric_queries import AP, AUROC, curve_sql
from .registry import query
from .result_queries import R, rounded, runs

P = "with " + fx.PATCHES
PA = "with " + fx.PATHS
D = 32


def all_patches(spark, sf_dir):
    """image_id, layer, gy, gx, label, mask, is_ref, vec."""
    made = patches.as_patches(fx.vectors(spark, sf_dir).drop("image_id"), 4, {"a": (1, D), "b": (D + 1, D)}, keep=("label",))
    return made.withColumn("mask", (F.col("label") == 9) & (F.col("image_id") % 2 == 1)).withColumn("is_ref", F.col("image_id") % 4 == 0)


def digest(v):
    """One number of a vector: the sum of place times value, from 1."""
    return F.round(mathx.total(F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda x, i: x * i)), 5).alias("digest")


IMAGES = PA + """,
parts as (select path, regexp_extract(path, '^(.*)/(train|test)/([^/]+)/([^/]+)\\.([^./]+)$', ['dataset', 'split', 'defect', 'stem', 'ext']) as p from paths),
images as (select path, p.dataset, p.split, p.defect, p.stem, case when p.defect = 'good' then 0 else 1 end as label from parts
  where lower(p.ext) in ('png', 'jpg', 'jpeg', 'bmp') and (p.split = 'test' or (p.split = 'train' and p.defect = 'good')))
"""


@query("src1_image_catalog", IMAGES + "select * from images")
def _(spark, sf_dir):
    return catalog.image_catalog(fx.paths(spark, sf_dir))


@query(
    "src2_resolve_masks",
    IMAGES + """, masks as (select path as mask_path, regexp_extract(path, '^(.*)/ground_truth/([^/]+)/([^/]+?)(_mask)?\\.png$', ['dataset', 'defect', 'stem', 'second']) as m from paths where path like '%/ground_truth/%'),
    best as (select mask_path, m from masks qualify row_number() over (partition by m.dataset, m.defect, m.stem order by m.second) = 1)
    select i.path, i.label, case when i.label = 1 then b.mask_path end as mask_path from images i left join best b on b.m.dataset = i.dataset and b.m.defect = i.defect and b.m.stem = i.stem where i.split = 'test'""",
)
def _(spark, sf_dir):
    paths = fx.paths(spark, sf_dir)
    return catalog.resolve_masks(catalog.image_catalog(paths), paths).select("path", "label", "mask_path")


@query(
    "src2_mask_folders",
    IMAGES + """, folders as (select 'ds' || (page_id % 3) || '/cat' || (page_id % 2) || '/ground_truth/' || case page_id % 4 when 2 then 'scratch' else 'hole' end || '/' || page_id || '/' || k || '.png' as mask_path
      from pages cross join range(3) r(k) where page_id % 4 in (2, 3) and k < page_id % 5),
    named as (select mask_path, regexp_extract(mask_path, '^(.*)/ground_truth/([^/]+)/([^/]+)/[^/]+\\.png$', ['dataset', 'defect', 'stem']) as m from folders)
    select i.path, string_agg(mask_path, '|' order by mask_path) as masks from images i left join named on m.dataset = i.dataset and m.defect = i.defect and m.stem = i.stem where i.split = 'test' group by 1""",
)
def _(spark, sf_dir):
    folders = fx.table(spark, sf_dir, "pages").where("page_id % 4 in (2, 3) and page_id % 5 > 0").selectExpr(
        "explode(transform(sequence(0, cast(least(page_id % 5, 3) - 1 as int)), k -> concat('ds', page_id % 3, '/cat', page_id % 2, '/ground_truth/', case page_id % 4 when 2 then 'scratch' else 'hole' end, '/', page_id, '/', k, '.png'))) as path"
    )
    made = catalog.mask_folders(catalog.image_catalog(fx.paths(spark, sf_dir)), folders)
    return made.select("path", F.when(F.col("mask_paths").isNotNull(), F.array_join("mask_paths", "|")).alias("masks"))


@query(
    "src3_load_split",
    "with rows_ as (select 'cat' || (page_id % 4) as object, case page_id % 3 when 0 then 'train' when 1 then 'test' else 'none' end as split, case when page_id % 5 < 3 then 'normal' else 'bad' end as label, url as image, case when page_id % 2 = 0 then ' ' else url || '.png' end as mask, page_id from pages) "
    "select image, split, case when label = 'normal' then 0 else 1 end as label, nullif(trim(mask), '') as mask from rows_ where object = 'cat1' and split in ('train', 'test') and image in (select url from pages where page_id % 7 <> 0)",
)
def _(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    rows = pages.selectExpr(
        "concat('cat', page_id % 4) as object", "case page_id % 3 when 0 then 'train' when 1 then 'test' else 'none' end as split", "case when page_id % 5 < 3 then 'normal' else 'bad' end as label", "url as image", "case when page_id % 2 = 0 then ' ' else concat(url, '.png') end as mask"
    )
    return catalog.load_split(rows, pages.where("page_id % 7 <> 0").select(F.col("url").alias("path")), "cat1")


@query("src4_union_masks", "with " + fx.CELLS + "select image_id, y, x, 1 as value from cells where value > 60000 or value_b > 50000")
def _(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    a, b = (c.select("image_id", "y", "x", F.greatest(F.col(v) - t, F.lit(0.0)).alias("value")) for v, t in (("value", 60000), ("value_b", 50000)))
    return catalog.union_masks(a.unionByName(b))


@query("src5_read_runs", R + "select dataset, method, n_train, seed, round(metric, 4) as img_ap from runs")
def _(spark, sf_dir):
    """Runs written as ';'-separated rows with another metric name, and read again under the common one."""
    from ..functions.shared import scratch

    path = scratch(spark)
    run_files.formatted(runs(spark, sf_dir).select(*run_files.KEYS, F.col("metric").alias("img_aupr")), ["img_aupr"]).write.option("header", True).option("sep", ";").csv(path)
    return run_files.read_runs(spark, path, ";", {"img_aupr": "img_ap"}, "dataset string, method string, n_train int, seed int, img_aupr double")


@query("src6_append_runs", R + "select dataset, method, n_train, seed, case when seed = 3 then null else round(metric, 4) end as img_ap from runs")
def _(spark, sf_dir):
    from ..functions.shared import scratch

    path, r = scratch(spark), runs(spark, sf_dir).select(*run_files.KEYS, F.when(F.col("seed") != 3, F.col("metric")).alias("img_ap"))
    for seed in range(5):
        run_files.append_runs(r.where(F.col("seed") == seed), path, ["img_ap"])
    return run_files.read_runs(spark, path, schema="dataset string, method string, n_train int, seed int, img_ap double")


@query("src6_unit_log", R + "select dataset, method, n_train, seed, case when seed = 3 then null else round(metric, 4) end as img_ap from runs")
def _(spark, sf_dir):
    """Rows of each seed appended one after the other, twice over, beside an attempt that broke off before its commit."""
    from ..functions.shared import scratch

    path, r = scratch(spark), runs(spark, sf_dir).select(*run_files.KEYS, F.when(F.col("seed") != 3, F.round("metric", 4)).alias("img_ap"))
    unit_log.write_rows(r.where("seed < 2"), path, unit_log.new_attempt())
    for seed in (0, 1, 2, 3, 4, 0, 1):
        unit_log.append(r.where(F.col("seed") == seed), path)
    unit_log.append(r, path)
    return unit_log.read(spark, path)


@query("src7_save_load_maps", "with " + fx.CELLS + "select image_id, y, x, value from cells where image_id % 11 = 3 and image_id % 2 = 1")
def _(spark, sf_dir):
    from ..functions.shared import scratch

    path = scratch(spark)
    maps = fx.cells(spark, sf_dir).select("image_id", "y", "x", "value", F.concat(F.lit("d"), (F.col("image_id") % 11).cast("string")).alias("dataset"), F.lit("m").alias("method"), (F.col("image_id") % 2).cast("int").alias("n_train"), F.lit(0).alias("seed"))
    run_files.save_maps(maps, path)
    return run_files.load_maps(spark, path, dataset="d3", n_train=1).select("image_id", "y", "x", "value")


@query("src8_cache_features", P + "select layer as view, count(*) as n, round(sum(vec[1]), 5) as first_sum from patches group by 1")
def _(spark, sf_dir):
    from ..functions.shared import scratch

    path, rows = scratch(spark), all_patches(spark, sf_dir).withColumns({"dataset": F.lit("d"), "view": F.col("layer")})
    run_files.cache_features(rows, path)
    cached = run_files.cache_features(rows.where("false"), path)  # is done, so it is only read
    return rounded(cached.groupBy("view").agg(F.count("*").alias("n"), F.sum(F.get("vec", 0)).alias("first_sum")), "first_sum", places=5)


@query("src9_as_patches", P + "select image_id, layer, gy, gx, round(list_sum(vec), 5) as total from patches")
def _(spark, sf_dir):
    return all_patches(spark, sf_dir).select("image_id", "layer", "gy", "gx", F.round(mathx.total(F.col("vec")), 5).alias("total"))


DRAWS = PA + """, i as (select distinct split_part(path, '/', 1) as dataset, path from paths where path like '%/train/%'),
d as (select i.*, n.n, s.seed, row_number() over (partition by dataset, n, seed order by md5(seed || '|' || path), path) as k from i cross join (values (0), (2), (5), (100000)) n(n) cross join (values (0), (1), (2)) s(seed))
"""


def draws(spark, sf_dir):
    images = fx.paths(spark, sf_dir).where(F.contains("path", F.lit("/train/"))).withColumn("dataset", F.split_part("path", F.lit("/"), F.lit(1)))
    return images, prj.sample_references(images, [0, 2, 5, 100000], [0, 1, 2])


@query("prj1_sample_references", DRAWS + "select dataset, path, n, seed from d where n = 0 or k <= n")
def _(spark, sf_dir):
    return draws(spark, sf_dir)[1]


@query("prj2_check_draw", DRAWS + "select dataset, n, seed, count(*) as got, true as ok from d where n = 0 or k <= n group by all")
def _(spark, sf_dir):
    images, drawn = draws(spark, sf_dir)
    return prj.check_draw(drawn, images)


@query("prj3_leakage", "select distinct url as path from pages where page_id % 2 = 0 and url in (select url from pages where page_id % 3 = 0)")
def _(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return prj.leakage(pages.where("page_id % 2 = 0"), pages.where("page_id % 3 = 0"))


HASH = "('0x' || substr(md5({0}), 1, 8))::bigint"


@query("prj4_cap_rows", "select vec_id, label from embeddings qualify row_number() over (partition by label order by " + HASH.format("'7|' || vec_id") + ", vec_id) <= 25")
def _(spark, sf_dir):
    return prj.cap_rows(fx.table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], 25, 7, "vec_id")


LONG = ", long as (select p.*, i, vec[i] as v from patches p cross join range(1, 33) r(i))"
GATHER = "round(sum(i * v), 5) as digest"


@query("prj5_l2_normalize", P + LONG + ", n as (select image_id, layer, gy, gx, sqrt(sum(v * v)) as norm from long group by all) select image_id, layer, gy, gx, round(sum(i * v / norm), 5) as digest from long join n using (image_id, layer, gy, gx) group by all")
def _(spark, sf_dir):
    return prj.normalized(all_patches(spark, sf_dir)).select("image_id", "layer", "gy", "gx", digest(F.col("vec")))


@query("prj6_center_by", P + LONG + f", c as (select image_id, layer, gy, gx, i, v - avg(v) over (partition by image_id, layer, i) as v from long) select image_id, layer, gy, gx, {GATHER} from c group by all")
def _(spark, sf_dir):
    return prj.center_by(all_patches(spark, sf_dir), ["image_id", "layer"], D).select("image_id", "layer", "gy", "gx", digest(F.col("vec")))


@query("prj7_neighbour_mean", P + LONG + f", c as (select a.image_id, a.layer, a.gy, a.gx, a.i, avg(b.v) as v from long a join long b on a.image_id = b.image_id and a.layer = b.layer and a.i = b.i and abs(a.gy - b.gy) <= 1 and abs(a.gx - b.gx) <= 1 group by all) select image_id, layer, gy, gx, {GATHER} from c group by all")
def _(spark, sf_dir):
    return prj.neighbour_mean(all_patches(spark, sf_dir), D).select("image_id", "layer", "gy", "gx", digest(F.col("vec")))


@query("prj8_band_mean", P + LONG + f", c as (select image_id, gy, gx, i, avg(v) as v from long group by all) select image_id, gy, gx, {GATHER} from c group by all")
def _(spark, sf_dir):
    return prj.band_mean(all_patches(spark, sf_dir), ["a", "b"], D).select("image_id", "gy", "gx", digest(F.col("vec")))


@query("prj10_crop_border", "with " + fx.CELLS + "select image_id, y, x, value from cells where y between 2 and 47 and x between 2 and 8")
def _(spark, sf_dir):
    from ..operators.grid import crop_border

    return crop_border(fx.cells(spark, sf_dir).select("image_id", "y", "x", "value"), 2, fx.GRID_H, fx.GRID_W)


NAMED = "select page_id, 'a/b/' || page_id || case page_id % 4 when 0 then '_shift_left.png' when 1 then '_dark.png' when 2 then '_x1_logical.png' else '.structural.png' end as path from pages"


def named_paths(spark, sf_dir):
    """page_id and a path made of it."""
    return fx.table(spark, sf_dir, "pages").selectExpr("page_id", "concat('a/b/', page_id, case page_id % 4 when 0 then '_shift_left.png' when 1 then '_dark.png' when 2 then '_x1_logical.png' else '.structural.png' end) as path")


@query("prj11_condition_of", f"with n as ({NAMED}), s as (select *, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') as stem from n) select page_id, case when contains(stem, 'shift') then 'shift' else regexp_replace(stem, '^\\d+_', '') end as cond from s")
def _(spark, sf_dir):
    return named_paths(spark, sf_dir).select("page_id", prj.condition_of(F.col("path")).alias("cond"))


@query("prj12_kind_of", f"with n as ({NAMED}) select page_id, case when contains(path, 'logical') then 'logical' when contains(path, 'structural') then 'structural' else 'good' end as kind from n")
def _(spark, sf_dir):
    return named_paths(spark, sf_dir).select("page_id", prj.kind_of(F.col("path")).alias("kind"))


@query(
    "prj13_parse_variant",
    "select page_id, 'k' || (page_id % 13) || case page_id % 3 when 0 then 's' || (page_id % 2000) when 1 then 'lw' else '' end || case when page_id % 5 = 0 then 'v' else '' end || case page_id % 4 when 0 then '_none' when 1 then '_rot16' else '' end || case when page_id % 7 = 0 then '_d128' else '' end || case when page_id % 6 = 0 then '_skip2' else '' end || case when page_id % 11 = 0 then '_diag' else '' end as name, "
    "(page_id % 13)::int as k, case when page_id % 3 = 0 then (page_id % 2000)::double else 0 end as kappa, page_id % 3 = 1 as ledoit_wolf, page_id % 5 = 0 as whiten, case page_id % 4 when 0 then 'none' when 1 then 'rot16' else 'rot8' end as views, case when page_id % 7 = 0 then 128 else 256 end as d, case when page_id % 6 = 0 then 2 else 0 end as skip, false as ppca, page_id % 11 = 0 as diag from pages",
)
def _(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "concat('k', page_id % 13, case page_id % 3 when 0 then concat('s', page_id % 2000) when 1 then 'lw' else '' end, case when page_id % 5 = 0 then 'v' else '' end, case page_id % 4 when 0 then '_none' when 1 then '_rot16' else '' end, case when page_id % 7 = 0 then '_d128' else '' end, case when page_id % 6 = 0 then '_skip2' else '' end, case when page_id % 11 = 0 then '_diag' else '' end) as name",
    )
    return rows.withColumn("v", prj.parse_variant(F.col("name"))).select("page_id", "name", "v.*")


@query("prj14_validate_metrics", R + ", m as (select *, metric * 3 - 0.2 as other from runs) select dataset, method, n_train, seed, 'other' as metric, round(other, 6) as value from m where other < 0 or other > 1 union all select dataset, method, n_train, seed, 'metric', round(metric, 6) from m where metric < 0 or metric > 1")
def _(spark, sf_dir):
    made = prj.validate_metrics(runs(spark, sf_dir).withColumn("other", F.col("metric") * 3 - 0.2), ["metric", "other"], run_files.KEYS)
    return rounded(made, "value")


SIZES = "select page_id as image_id, 'd' || (page_id % 9) as dataset, (100 + page_id % 3)::int as h, (case when page_id % 9 in (1, 4) and page_id % 5 = 0 then 150 else 100 + page_id % 3 end)::int as w from pages"


def sizes(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").selectExpr("page_id as image_id", "concat('d', page_id % 9) as dataset", "cast(100 + page_id % 3 as int) as h", "cast(case when page_id % 9 in (1, 4) and page_id % 5 = 0 then 150 else 100 + page_id % 3 end as int) as w")


@query("prj15_non_square", f"with i as ({SIZES}) select image_id, dataset from i where dataset in (select dataset from i where h <> w)")
def _(spark, sf_dir):
    return prj.non_square(sizes(spark, sf_dir)).select("image_id", "dataset")


@query("prj16_masking_applies", R + "select distinct dataset, (dataset like 'view/%' or dataset in ('click/1', 'error/3')) as masked from runs")
def _(spark, sf_dir):
    return runs(spark, sf_dir).select("dataset").distinct().withColumn("masked", prj.masking_applies(F.col("dataset"), "view", ["click/1", "error/3"]))


@query(
    "prj17_merge_variant",
    R + """, v as (select distinct method || '+' || split_part(dataset, '/', 1) as variant, method, split_part(dataset, '/', 1) as b from runs)
    select variant, case when b = 'view' then 3.0 when method = 'm1' then 12.0 else 1.0 end::double as k, case when b = 'click' then 200.0 when method = 'm2' then 5.0 else 0.0 end::double as kappa from v""",
)
def _(spark, sf_dir):
    r = runs(spark, sf_dir)
    variants = r.select(F.concat_ws("+", "method", F.split_part("dataset", F.lit("/"), F.lit(1))).alias("variant")).distinct()
    names = r.select(F.explode(F.array("method", F.split_part("dataset", F.lit("/"), F.lit(1)))).alias("override")).distinct()
    rules = {"view": ("k", 3.0), "m1": ("k", 12.0), "click": ("kappa", 200.0), "m2": ("kappa", 5.0)}
    field = F.create_map(*[F.lit(x) for k, (f, _) in rules.items() for x in (k, f)])
    value = F.create_map(*[F.lit(x) for k, (_, v) in rules.items() for x in (k, v)])
    overrides = names.where(F.col("override").isin(*rules)).select("override", field[F.col("override")].alias("field"), value[F.col("override")].alias("value"))
    return prj.merge_variant(variants, overrides, {"k": 1.0, "kappa": 0.0})


# Fitting: a model for each layer, of the reference patches; labels stand for components.


PLACES = ("image_id", "layer", "gy", "gx")


def named(rows):
    """rows with row_id, one name for each patch."""
    return rows.withColumn("row_id", F.concat_ws("|", *[F.col(c).cast("string") for c in PLACES]))


def reference_rows(spark, sf_dir, keys=("layer",)):
    """The references' vectors dealt by key, and the keys' sizes."""
    return keyed.deal(named(all_patches(spark, sf_dir).where("is_ref")), keys)


def diagonal(spark, sf_dir, cov="diag", kappa=20.0):
    refs = all_patches(spark, sf_dir).where("is_ref").withColumn("component", (F.col("label") % 3).cast("int"))
    return fit.diagonal_m_step(refs, "layer", "component", kappa, vec="vec", cov=cov)


def diagonal_sql(var: str = "(nk * c + 20 * prior) / (nk + 20)") -> str:
    return P + LONG + f""",
refs as (select layer, label % 3 as component, i - 1 as i, v from long where is_ref),
pri as (select layer, i, var_samp(v) as prior, count(*) as n from refs group by all),
par as (select layer, component, i, count(*) as nk, avg(v) as mean, var_pop(v) as c from refs group by all),
model as (select layer as key, component, i, mean, {var} + 0.01::double as var, ln(nk / n) as log_w from par join pri using (layer, i))
"""


@query("fit1_moments", P + LONG + ", refs as (select layer, i, v from long where is_ref) select layer as key, i - 1 as i, round(avg(v), 6) as mean, round(var_samp(v), 6) as var, count(*)::double as n from refs group by all")
def _(spark, sf_dir):
    made = keyed.covariances(reference_rows(spark, sf_dir)[0])
    long = made.select("key", "n", "cov", F.size("mean").alias("d"), F.posexplode("mean").alias("i", "mean"))
    return rounded(long.select("key", F.col("i").cast("long").alias("i"), "mean", F.get("cov", F.col("i") * (F.col("d") + 1)).alias("var"), "n"), "mean", "var")


@query("fit2_pca")
def _(spark, sf_dir):
    """Leading variances of each layer, and each patch's distance from the model's subspace."""
    table = keyed.pca(reference_rows(spark, sf_dir)[0], 8)
    z = mix.project_by_key(all_patches(spark, sf_dir).select(*PLACES, "vec"), table, ["layer"], whiten=True)
    return z.select(*PLACES, F.round(mathx.dot(F.col("z"), F.col("z")), 6).alias("whitened_norm"))


@query("fit3_whitening")
def _(spark, sf_dir):
    """Mean square of each whitened coordinate of the references: 1 up to (n - 1) / n, by layer."""
    rows, _ = reference_rows(spark, sf_dir)
    z = keyed.project(rows, keyed.stored(keyed.pca(rows, 8)), whiten=True)
    long = z.select(F.col("key").alias("layer"), F.posexplode("vec").alias("i", "v"))
    return rounded(long.groupBy("layer", "i").agg(F.avg(F.col("v") * F.col("v")).alias("mean_square"), F.count("*").alias("n")), "mean_square")


@query("fit5_truncated_svd")
def _(spark, sf_dir):
    """Length of each patch inside the leading eight directions of its layer's references, without centring."""
    table = keyed.svd(*reference_rows(spark, sf_dir), 8)
    z = mix.project_by_key(all_patches(spark, sf_dir).select(*PLACES, "vec"), table, ["layer"])
    return z.select(*PLACES, F.round(F.sqrt(mathx.dot(F.col("z"), F.col("z"))), 6).alias("length"))


@query("fit4_pca_by_variance")
def _(spark, sf_dir):
    """Directions that hold 99 % of the variance, for each layer, and the squares that eight directions hold uncentred."""
    rows, sizes = reference_rows(spark, sf_dir)
    gram = keyed.svd(rows, sizes, 8).select("key", F.aggregate("evals", F.lit(0.0), lambda a, v: a + v).alias("gram_total"))
    made = keyed.pca(rows, var=0.99).select("key", F.size("evals").alias("directions"), "total").join(gram, "key")
    return rounded(made.withColumnRenamed("key", "layer"), "total", "gram_total")


@query("fit6_component_cap", P + ", c as (select label, layer, count(*) as n from patches group by all) select label, layer, n, least(12, greatest(2, n // 18))::int as k from c")
def _(spark, sf_dir):
    return fit.component_cap(all_patches(spark, sf_dir), ["label", "layer"], 8, 12)


@query(
    "fit7_assign_centres",
    P + LONG + """, centres as (select layer, label % 3 as cluster, i, avg(v) as m from long where is_ref group by all),
    d as (select image_id, layer, gy, gx, cluster, sum((v - m) * (v - m)) as d from long join centres using (layer, i) group by all)
    select image_id, layer, gy, gx, cluster::int as cluster from d qualify row_number() over (partition by image_id, layer, gy, gx order by round(d, 9), cluster) = 1""",
)
def _(spark, sf_dir):
    rows = all_patches(spark, sf_dir)
    means = prj.mean_vector(rows.where("is_ref").withColumn("cluster", (F.col("label") % 3).cast("int")), ["layer", "cluster"], D).orderBy("layer", "cluster").collect()
    centres = {k: np.array([r["mean_vec"] for r in means if r["layer"] == k]) for k in ("a", "b")}
    return fit.assign(rows.select("image_id", "gy", "gx", F.col("layer").alias("key"), F.col("vec").alias("z")), centres).select("image_id", F.col("key").alias("layer"), "gy", "gx", "cluster")


@query("fit7_kmeans")
def _(spark, sf_dir):
    """Each layer's five clusters of references: how many there are, and the rows' mean squared distance to their centres."""
    rows, sizes = reference_rows(spark, sf_dir)
    found = keyed.kmeans(rows, keyed.stored(sizes.withColumn("k", F.lit(5)))).join(sizes.select("key", "n"), "key")
    return rounded(found.select(F.col("key").alias("layer"), "n", (F.size("centres") / F.col("width")).cast("int").alias("clusters"), (F.col("cost") / F.col("n")).alias("mean_cost")), "mean_cost")


def mixtures(spark, sf_dir):
    """All patches in their layer's directions (z), and the layers' mixtures, which are three components each."""
    rows = all_patches(spark, sf_dir).withColumn("row_id", F.concat_ws("|", *[F.col(c).cast("string") for c in ("image_id", "layer", "gy", "gx")]))
    found = mix.fit_by_key(rows.where("is_ref"), ["layer"], 3, 8, 20.0).orderBy("key", "component").collect()
    models, pca = {}, {}
    for key in {r["key"] for r in found}:
        own = [r for r in found if r["key"] == key]
        models[key] = fit.Mixture(np.array([r["centre"] for r in own]), np.array([r["cov"] for r in own]).reshape(-1, 8, 8), np.array([r["log_w"] for r in own]))
        pca[key] = fit.PCA(np.array(own[0]["mean"]), np.array(own[0]["comp"]).reshape(-1, 8), np.array(own[0]["evals"]), own[0]["total"])
    return fit.project(rows.select("image_id", "layer", "gy", "gx", "vec"), "layer", pca), models


@query("fit8_mixture_em")
def _(spark, sf_dir):
    """Mixtures of both layers by EM, and each patch's chi-square tail score."""
    rows = all_patches(spark, sf_dir).withColumn("row_id", F.concat_ws("|", *[F.col(c).cast("string") for c in ("image_id", "layer", "gy", "gx")]))
    models = mix.fit_by_key(rows.where("is_ref"), ["layer"], 3, 8, 20.0)
    scored = mix.score_by_key(rows.select("image_id", "layer", "gy", "gx", "vec"), models, ["layer"]).withColumn("score", mathx.chi2_tail_score(F.col("distance"), 8))
    return rounded(scored.select("image_id", "layer", "gy", "gx", "distance", "score"), "distance", "score")


@query("fit8_mixture_rounds")
def _(spark, sf_dir):
    """The same by rounds over all references of a layer, whatever their number."""
    rows = named(all_patches(spark, sf_dir))
    models = keyed.fit(rows.where("is_ref"), ["layer"], 3, 8, 20.0)
    scored = mix.score_by_key(rows.select(*PLACES, "vec"), models, ["layer"]).withColumn("score", mathx.chi2_tail_score(F.col("distance"), 8))
    return rounded(scored.select(*PLACES, "distance", "score"), "distance", "score")


@query("fit9_m_step_diagonal", diagonal_sql() + "select key, component::int as component, i::int as i, round(mean, 6) as mean, round(var, 6) as var, round(log_w, 6) as log_w from model")
def _(spark, sf_dir):
    return rounded(diagonal(spark, sf_dir), "mean", "var", "log_w")


@query("fit10_covariance_prior", diagonal_sql("prior") + "select key, component::int as component, i::int as i, round(var, 6) as var from model")
def _(spark, sf_dir):
    return rounded(diagonal(spark, sf_dir, "prior"), "var").select("key", "component", "i", "var")


@query("fit10_covariance_tied", diagonal_sql("sum((nk * c + 20 * prior) / (nk + 20) * nk) over (partition by layer, i) / sum(nk) over (partition by layer, i)") + "select key, component::int as component, i::int as i, round(var, 6) as var from model")
def _(spark, sf_dir):
    return rounded(diagonal(spark, sf_dir, "tied"), "var").select("key", "component", "i", "var")


@query("fit12_relative_ridge", P + LONG + ", v as (select layer, i, var_samp(v) as var from long where is_ref group by all) select layer as key, round(avg(var) * 0.1::double, 8) as ridge from v group by 1")
def _(spark, sf_dir):
    return rounded(fit.relative_ridge(all_patches(spark, sf_dir).where("is_ref"), "layer", 0.1, "vec"), "ridge", places=8)


@query("fit13_model_keys", P + LONG + ", refs as (select layer || '|' || (image_id % 3) as key, i, v from long where is_ref), v as (select key, i, var_samp(v) as var, count(*) as n from refs group by all) select key, max(n)::double as n, round(sum(var), 5) as total from v group by 1")
def _(spark, sf_dir):
    """A model of each layer and third of the images."""
    refs = named(all_patches(spark, sf_dir).where("is_ref")).withColumn("third", F.col("image_id") % 3)
    return rounded(keyed.pca(keyed.deal(refs, ["layer", "third"])[0], 8).select("key", "n", "total"), "total", places=5)


@query("fit16_state_mib", R + ", s as (select dataset, method, 8 as big_d, n_train * 2 as d, seed + 1 as k, case when seed = 4 then ord end as numel, n_train from runs) select dataset, method, n_train, k, round(coalesce(4 * numel, 4 * (big_d + big_d * d + k + k * d + k * d * (d + 1) / 2)) / 1048576.0::double, 9) as mib from s")
def _(spark, sf_dir):
    r = runs(spark, sf_dir).select("dataset", "method", "n_train", F.lit(8).alias("big_d"), (F.col("n_train") * 2).alias("d"), (F.col("seed") + 1).alias("k"), F.when(F.col("seed") == 4, F.col("ord")).alias("numel"))
    return rounded(fit.state_mib(r), "mib", places=9).select("dataset", "method", "n_train", "k", "mib")


@query(
    "fit17_loo_choice",
    "with " + fx.CELLS + """, m as (select 'd' || (image_id % 5) as dataset, case when (image_id // 5) % 2 = 0 then 'rot8' else 'none' end as views, x % 3 as fold, y % 4 = 0 as held_out, value from cells),
    t as (select dataset, views, fold, quantile_cont(value, 0.95) as t from m where not held_out group by all),
    r as (select dataset, views, fold, avg((value > t)::int) as r from m join t using (dataset, views, fold) where held_out group by all),
    w as (select dataset, avg(r) filter (views = 'none') as fpr_none, avg(r) filter (views = 'rot8') as fpr_rot8 from r group by 1)
    select dataset, round(fpr_none, 6) as fpr_none, round(fpr_rot8, 6) as fpr_rot8, case when fpr_rot8 < fpr_none then 'rot8' else 'none' end as choice from w""",
)
def _(spark, sf_dir):
    maps = fx.cells(spark, sf_dir).selectExpr("concat('d', image_id % 5) as dataset", "case when (image_id div 5) % 2 = 0 then 'rot8' else 'none' end as views", "x % 3 as fold", "y % 4 = 0 as held_out", "value")
    return rounded(fit.loo_choice(maps), "fpr_none", "fpr_rot8")


# Scoring with the diagonal model.

SCORED = diagonal_sql() + """,
dist as (select p.image_id, p.layer, p.gy, p.gx, component, sum((p.v - m.mean) * (p.v - m.mean) / m.var) as d2, sum(ln(m.var)) as logdet, any_value(log_w) as log_w from long p join model m on m.key = p.layer and m.i = p.i - 1 group by all),
joint as (select *, -0.5::double * (d2 + logdet + 32 * ln(2 * pi())) + log_w as j from dist),
top as (select *, max(j) over (partition by image_id, layer, gy, gx) as mj from joint),
lse as (select image_id, layer, gy, gx, min(d2) as d2, max(mj) + ln(sum(exp(j - mj))) as ll, min(d2 + logdet) - avg(logdet) as vol from top group by all)
"""


def scored(spark, sf_dir):
    rows = all_patches(spark, sf_dir).select("image_id", F.col("layer").alias("key"), "gy", "gx", "mask", F.col("vec").alias("z"))
    return scr.diagonal_distances(rows, diagonal(spark, sf_dir))


def place(df, *columns):
    return df.select("image_id", F.col("key").alias("layer"), "gy", "gx", *columns)


@query("scr1_mahalanobis", SCORED + "select image_id, layer, gy, gx, component::int as component, round(d2, 5) as d2, round(logdet, 5) as logdet from dist")
def _(spark, sf_dir):
    long = scored(spark, sf_dir).withColumn("c", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("d2") - 1).alias("component"), "d2", "logdet")))
    return place(long, "c.component", F.round("c.d2", 5).alias("d2"), F.round("c.logdet", 5).alias("logdet"))


@query("scr2_min_distance", SCORED + "select image_id, layer, gy, gx, round(d2, 5) as d2 from lse")
def _(spark, sf_dir):
    return place(scored(spark, sf_dir), F.round(scr.min_distance(F.col("d2")), 5).alias("d2"))


@query("scr3_wilson_hilferty", SCORED + "select image_id, layer, gy, gx, round((power(d2 / 32, 1 / 3::double) - (1 - 2 / (9 * 32)::double)) / sqrt(2 / (9 * 32)::double), 5) as z from lse")
def _(spark, sf_dir):
    return place(scored(spark, sf_dir), F.round(mathx.wilson_hilferty(scr.min_distance(F.col("d2")), D), 5).alias("z"))


@query("scr3_chi2_tail_score")
def _(spark, sf_dir):
    return place(scored(spark, sf_dir), F.round(mathx.chi2_tail_score(scr.min_distance(F.col("d2")), D), 6).alias("score"))


@query("scr4_nll", SCORED + "select image_id, layer, gy, gx, round(-ll, 5) as nll from lse")
def _(spark, sf_dir):
    return place(scored(spark, sf_dir), F.round(scr.nll(D), 5).alias("nll"))


@query("scr5_raw_distance", SCORED + "select image_id, layer, round(quantile_cont(d2, 0.95), 5) as score from lse group by all")
def _(spark, sf_dir):
    """Image scores of raw distances, without a tail: the 95th percentile of each layer."""
    rows = place(scored(spark, sf_dir), scr.min_distance(F.col("d2")).alias("value"))
    return rounded(pol.pool(rows, "p95", ("image_id", "layer")), "score", places=5)


@query("scr6_weighted_tail")
def _(spark, sf_dir):
    return place(scored(spark, sf_dir), F.round(scr.weighted_tail(D), 6).alias("score"))


@query("scr7_volume_corrected", SCORED + "select image_id, layer, gy, gx, round(vol, 5) as score from lse")
def _(spark, sf_dir):
    return place(scored(spark, sf_dir), F.round(scr.volume_corrected(), 5).alias("score"))


@query("scr8_entropy", SCORED + "select image_id, layer, gy, gx, round(-sum(case when exp(j - ll) > 0 then exp(j - ll) * (j - ll) else 0 end), 5) + 0.0 as entropy from joint join lse using (image_id, layer, gy, gx) group by all")
def _(spark, sf_dir):
    return place(scored(spark, sf_dir), (F.round(scr.assignment_entropy(D), 5) + F.lit(0.0)).alias("entropy"))


@query(
    "scr9_position_nll",
    SCORED + """, pl as (select gy::int as gy, gx::int as gx, k.component::int as component, count(p.image_id) + 1 as c from range(4) y(gy) cross join range(4) x(gx) cross join range(3) k(component)
      left join (select * from patches where is_ref and layer = 'a') p using (gy, gx) where p.label % 3 = k.component or p.image_id is null group by all
      union all select gy, gx, component, 1 from (select gy::int as gy, gx::int as gx, component::int as component from range(4) y(gy) cross join range(4) x(gx) cross join range(3) k(component))
        where (gy, gx, component) not in (select gy, gx, label % 3 from patches where is_ref and layer = 'a')),
    pr as (select gy, gx, component, c / sum(c) over (partition by gy, gx) as prior from pl),
    j2 as (select d.image_id, d.layer, d.gy, d.gx, -0.5::double * (d2 + logdet + 32 * ln(2 * pi())) + ln(prior) as j from dist d join pr using (gy, gx, component)),
    t2 as (select *, max(j) over (partition by image_id, layer, gy, gx) as mj from j2)
    select image_id, layer, gy, gx, round(-(max(mj) + ln(sum(exp(j - mj)))), 5) as score from t2 group by all""",
)
def _(spark, sf_dir):
    rows = all_patches(spark, sf_dir).where("is_ref and layer = 'a'").select("gy", "gx", (F.col("label") % 3).cast("int").alias("component"))
    every = rows.select("gy", "gx").distinct().withColumn("component", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    refs = every.unionByName(rows).groupBy("gy", "gx", "component").agg(F.count("*").alias("c"))  # one more than counted
    total = refs.groupBy("gy", "gx").agg(F.sum("c").alias("t"))
    prior = refs.join(total, ["gy", "gx"]).select("gy", "gx", "component", (F.col("c") / F.col("t")).alias("prior"))
    return place(scr.position_nll(scored(spark, sf_dir), prior, D), F.round("score", 5).alias("score"))


@query("scr10_ppca_residual")
def _(spark, sf_dir):
    table = keyed.pca(reference_rows(spark, sf_dir)[0], 8)
    made = mix.residual_by_key(all_patches(spark, sf_dir).select(*PLACES, "vec"), table, ["layer"], relative=True)
    return rounded(made.select(*PLACES, "residual"), "residual")


KNN = """, bank as (select layer, vec from patches where is_ref), q as (select image_id, layer, gy, gx, vec from patches where not is_ref)
select q.image_id, q.layer, q.gy, q.gx, round({0}, 5) as distance from q join bank b using (layer) group by all"""


def knn(spark, sf_dir, cosine):
    rows = all_patches(spark, sf_dir).select("image_id", "layer", "gy", "gx", "is_ref", "vec")
    rows, made = rows.withColumn("row_id", F.col("image_id") * 16 + F.col("gy") * 4 + F.col("gx")), None
    for layer in ("a", "b"):
        own = rows.where(F.col("layer") == layer)
        own = scr.knn(own.where("not is_ref"), own.where("is_ref"), "row_id", cosine).select("image_id", "layer", "gy", "gx", "distance")
        made = own if made is None else made.unionByName(own)
    return rounded(made, "distance", places=5)


@query("scr11_knn_cosine", P + KNN.format("1 - max(list_cosine_similarity(q.vec, b.vec))"))
def _(spark, sf_dir):
    return knn(spark, sf_dir, True)


@query("scr12_knn_euclid", P + KNN.format("min(list_distance(q.vec, b.vec))"))
def _(spark, sf_dir):
    return knn(spark, sf_dir, False)


@query("scr13_subspace_residual")
def _(spark, sf_dir):
    table = keyed.pca(reference_rows(spark, sf_dir)[0], 8)
    made = mix.residual_by_key(all_patches(spark, sf_dir).select(*PLACES, "vec"), table, ["layer"])
    return rounded(made.select(*PLACES, "residual"), "residual")


@query("scr12_knn_projected")
def _(spark, sf_dir):
    """Euclidean distance to the nearest reference in the layer's eight directions, plain and whitened, and the chi-square
    tail of its square."""
    rows = named(all_patches(spark, sf_dir))
    table = keyed.stored(keyed.pca(keyed.deal(rows.where("is_ref"), ["layer"])[0], 8))
    made = None
    for whiten in (False, True):
        z = keyed.stored(mix.project_by_key(rows.select("layer", "row_id", "is_ref", "vec"), table, ["layer"], whiten=whiten))
        for layer in ("a", "b"):
            own = z.where(F.col("layer") == layer)
            near = scr.knn(own.where("not is_ref"), own.where("is_ref"), "row_id", cosine=False, vec="z").select("layer", "row_id", F.lit(whiten).alias("whitened"), "distance")
            made = near if made is None else made.unionByName(near)
    return rounded(made.withColumn("tail", mathx.chi2_tail_score(F.col("distance") * F.col("distance"), 8)), "distance", "tail")


@query("scr14_precision_diff")
def _(spark, sf_dir):
    z, models = mixtures(spark, sf_dir)
    return rounded(scr.precision_diff(z, models, "layer"), "max_rel_diff", places=9)


def flagship(spark, sf_dir):
    """Image AUROC and AP of tail scores: diagonal model, 95th percentile of each layer, mean over layers."""
    tail = place(scored(spark, sf_dir), mathx.chi2_tail_score(scr.min_distance(F.col("d2")), D).alias("value"), "mask")
    score = pol.layer_mean(pol.pool(tail, "p95", ("image_id", "layer")))
    labels = tail.groupBy("image_id").agg(F.max("mask").alias("label"))
    curve = met.curve(score.withColumn("score", F.round("score", 6)).join(labels, "image_id"))
    return rounded(curve.agg(met.auroc_of().alias("auroc"), met.ap_of().alias("ap"), F.max("n_pos").alias("anomalous"), F.max("n_neg").alias("normal")), "auroc", "ap")


@query("flagship_image_metrics")
def _(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(
    "flagship_distance_metrics",
    SCORED + """, pooled as (select image_id, layer, quantile_cont(d2, 0.95) as s from lse group by all), img as (select image_id, round(avg(s), 5) as score from pooled group by 1),
    lab as (select image_id, max(mask::int) as label from patches group by 1), both_ as (select image_id, score, label from img join lab using (image_id)),""" + curve_sql("both_", "0") + f"select round({AUROC}, 6) as auroc, round({AP}, 6) as ap from curve",
)
def _(spark, sf_dir):
    """The same with raw distances."""
    rows = scored(spark, sf_dir)
    d = place(rows, scr.min_distance(F.col("d2")).alias("value"), "mask")
    score = pol.layer_mean(pol.pool(d, "p95", ("image_id", "layer"))).withColumn("score", F.round("score", 5))
    curve = met.curve(score.join(d.groupBy("image_id").agg(F.max("mask").alias("label")), "image_id"))
    return rounded(curve.agg(met.auroc_of().alias("auroc"), met.ap_of().alias("ap")), "auroc", "ap")
