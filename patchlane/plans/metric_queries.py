"""Queries of the metric and pooling operators over the image-score and grid views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as grd
from ..operators import metrics as met
from ..operators import pooling as pol
from . import fixtures as fx
from .registry import query
from .result_queries import POINT, draws, rounded

H, W = fx.GRID_H, fx.GRID_W
IS = "with " + fx.IMAGE_SCORES
C = "with " + fx.CELLS


def scores(spark, sf_dir):
    return fx.image_scores(spark, sf_dir)


def cells(spark, sf_dir):
    """The grids with a category (k) of the image's number."""
    return fx.cells(spark, sf_dir).withColumn("k", F.col("image_id") % 2)


def regions(frame, mask="mask"):
    return grd.connected_components(grd.masks_of(frame, mask), 4, fx.GRID_H, fx.GRID_W).withColumn("k", F.col("image_id") % 2)


def curve_sql(source: str, key: str, label: str = "label", score: str = "score") -> str:
    """SQL of the points of a ranking curve by key."""
    return f"""
points as (select {key} as key, {score} as score, sum(({label})::int) as pos, sum(1 - ({label})::int) as neg from {source} where {score} is not null and {label} is not null group by all),
sums as (select key, score, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over w - pos as tp0, sum(neg) over w - neg as fp0, sum(pos) over (partition by key) as n_pos, sum(neg) over (partition by key) as n_neg
  from points window w as (partition by key order by score desc rows unbounded preceding)),
curve as (select * from sums where n_pos > 0 and n_neg > 0)
"""


AUROC = "sum((fp - fp0) / n_neg::double * (tp + tp0) / (2.0::double * n_pos))"
AP = "sum((tp - tp0) / n_pos::double * tp / (tp + fp))"
F1 = "max(2 * tp / (tp + fp + n_pos)::double)"


@query("met1_auroc", IS + "," + curve_sql("image_scores", "dataset") + f"select key as dataset, round({AUROC}, 6) as auroc from curve group by 1")
def _(spark, sf_dir):
    return rounded(met.auroc(scores(spark, sf_dir), keys=["dataset"]), "auroc")


@query("met2_average_precision", IS + "," + curve_sql("image_scores", "dataset") + f"select key as dataset, round({AP}, 6) as ap from curve group by 1")
def _(spark, sf_dir):
    return rounded(met.average_precision(scores(spark, sf_dir), keys=["dataset"]), "ap")


@query("met3_f1_max", IS + "," + curve_sql("image_scores", "dataset") + f"select key as dataset, round({F1}, 6) as f1_max from curve group by 1")
def _(spark, sf_dir):
    return rounded(met.f1_max(scores(spark, sf_dir), keys=["dataset"]), "f1_max")


TPR = "round(coalesce(max(tp / n_pos::double) filter (fp <= n_neg * {t}::double), 0), 6)"


@query("met4_tpr_at_fpr", IS + "," + curve_sql("image_scores", "dataset") + f"select key as dataset, {TPR.format(t=0.05)} as tpr_05, {TPR.format(t=0.1)} as tpr_10 from curve group by 1")
def _(spark, sf_dir):
    s = scores(spark, sf_dir)
    made = [met.tpr_at_fpr(s, t, keys=["dataset"]).withColumnRenamed("tpr", n) for t, n in ((0.05, "tpr_05"), (0.1, "tpr_10"))]
    return rounded(made[0].join(made[1], "dataset"), "tpr_05", "tpr_10")


@query("met5_pixel_metrics", C + "," + curve_sql("cells", "image_id % 2", "mask", "value") + f"select key as k, round({AUROC}, 6) as pixel_auroc, round({AP}, 6) as pixel_ap from curve group by 1")
def _(spark, sf_dir):
    return rounded(met.pixel_metrics(cells(spark, sf_dir), keys=["k"]), "pixel_auroc", "pixel_ap")


def regions_sql(mask: str = "mask", near: str = "abs(m.y - r.y) + abs(m.x - r.x) = 1", cells_name: str = "cells") -> str:
    return f"""
set_cells as (select image_id, y, x, y * 65536 + x as id from {cells_name} where {mask}),
reach(image_id, y, x, root) as (select image_id, y, x, id from set_cells union
  select m.image_id, m.y, m.x, r.root from reach r join set_cells m on m.image_id = r.image_id and {near} and r.root < m.id),
regions as (select image_id, y, x, min(root) as region_id from reach group by all)
"""


def pro_sql(score: str, key: str = "0", limits: str = "(0.3)", mask: str = "mask", source: str = "cells") -> str:
    """SQL of AU-PRO by key over the cells with regions."""
    return f"""
sizes as (select {key} as key, image_id, region_id, count(*) as size from regions group by all),
counted as (select *, count(*) over (partition by key) as regions from sizes),
weighted as (select c.*, {key} as key, coalesce(1.0::double / (s.size * s.regions), 0) as w from {source} c left join regions r using (image_id, y, x) left join counted s on s.image_id = c.image_id and s.region_id = r.region_id),
levels as (select *, {score} as score from weighted),
pro_points as (select key, score, sum((not {mask})::int) as neg, sum(w) as w from levels group by all),
pro_sums as (select key, sum(neg) over o as fp, sum(neg) over o - neg as fp0, sum(w) over o as y1, sum(w) over o - w as y0, sum(neg) over (partition by key) as n, sum(w) over (partition by key) as all_w
  from pro_points window o as (partition by key order by score desc rows unbounded preceding)),
pro_curve as (select *, fp / n::double as x1, fp0 / n::double as x0 from pro_sums where n > 0 and all_w > 0),
areas as (select key, any_value(lim.v) as "limit", sum(case when x0 < lim.v then (least(x1, lim.v) - x0) * (y0 + case when x1 > x0 then y0 + (y1 - y0) * (least(x1, lim.v) - x0) / (x1 - x0) else y1 end) / 2 else 0 end) / any_value(lim.v) as aupro
  from pro_curve cross join (select v::double as v from (values {limits}) l(v)) lim group by key, lim.v)
"""


CR = "with recursive " + fx.CELLS + "," + regions_sql()


@query("met6_aupro", CR + "," + pro_sql("value", "image_id % 2") + 'select key as k, "limit", round(aupro, 6) as aupro from areas')
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rounded(met.aupro(c, regions(c), keys=["k"]), "aupro")


LEVEL = "case when hi > lo then greatest(0, least(65535, floor((value - lo) * (65535 / (hi - lo))))) else 0 end::int"


def binned_sql(mask: str, source: str = "cells") -> str:
    inner = f"(select *, min(value) over () as lo, max(value) over () as hi from {source})"
    return pro_sql(LEVEL, "0", "(0.3), (0.05), (0.01)", mask, inner) + "," + curve_sql("levels", "0", mask)


BINNED = f"""select "limit", round(aupro, 6) as aupro, round(pixel_auroc, 6) as pixel_auroc, round(pixel_ap, 6) as pixel_ap
from areas cross join (select {AUROC} as pixel_auroc, {AP} as pixel_ap from curve)"""


@query("met7_aupro_binned", "with recursive " + fx.CELLS + "," + regions_sql("mask1") + "," + binned_sql("mask1") + BINNED)
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rounded(met.aupro_binned(c, regions(c, "mask1"), (0.3, 0.05, 0.01), mask="mask1"), "aupro", "pixel_auroc", "pixel_ap")


@query(
    "met8_auspro",
    CR + """,
    sizes as (select image_id, region_id, count(*) as size from regions group by all), n as (select count(*) as regions from sizes),
    bad as (select image_id, max(mask::int) = 1 as bad from cells group by 1),
    w as (select c.value, b.bad, coalesce(1.0::double / (s.size * n.regions), 0) as w from cells c join bad b using (image_id) left join regions r using (image_id, y, x) left join sizes s on s.image_id = c.image_id and s.region_id = r.region_id cross join n),
    e as (select max(value) filter (not bad) as hi, min(value) filter (not bad) as lo from w),
    t as (select k, hi - k * ((hi - lo) / 99) as thr from e cross join range(100) g(k)),
    pts as (select k, count(*) filter (not bad) / (select count(*) from w where not bad)::double as fpr, sum(w) as spro from t join w on w.value >= t.thr group by k),
    ok as (select *, lag(fpr) over (order by k) as f0, lag(spro) over (order by k) as s0 from pts where fpr <= 0.3)
    select round(sum((fpr - f0) * (spro + s0) / 2) / 0.3::double, 6) as auspro from ok""",
)
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    return rounded(met.auspro(c, regions(c)), "auspro")


@query("met9_interior_aupro", "with recursive " + fx.CELLS + ", inner_ as (select * from cells where y >= 2 and x >= 2 and y < 48 and x < 9)," + regions_sql("mask1", cells_name="inner_") + "," + binned_sql("mask1", "inner_") + BINNED)
def _(spark, sf_dir):
    c = grd.crop_border(cells(spark, sf_dir), 2, H, W)
    return rounded(met.aupro_binned(c, regions(c, "mask1"), (0.3, 0.05, 0.01), mask="mask1"), "aupro", "pixel_auroc", "pixel_ap")


@query(
    "met10_aupro_by_condition",
    "with recursive " + fx.CELLS + "," + regions_sql() + """,
    twice as (select c.*, g.cond from cells c, lateral (select unnest(['c' || (c.image_id % 2), 'all']) as cond) g),
    sizes as (select g.cond, image_id, region_id, count(*) as size from regions r, lateral (select unnest(['c' || (r.image_id % 2), 'all']) as cond) g group by all),
    counted as (select *, count(*) over (partition by cond) as regions from sizes),
    weighted as (select c.*, c.cond as key, coalesce(1.0::double / (s.size * s.regions), 0) as w from twice c left join regions r using (image_id, y, x) left join counted s on s.image_id = c.image_id and s.region_id = r.region_id and s.cond = c.cond),
    """ + pro_sql("value").split("levels as (select *, value as score from weighted),")[1].join(["levels as (select *, value as score from weighted),", ""]) + 'select key as cond, "limit", round(aupro, 6) as aupro from areas',
)
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    name = F.concat(F.lit("c"), (F.col("image_id") % 2).cast("string"))
    return rounded(met.aupro_by_condition(c, regions(c), name), "aupro")


@query(
    "met11_ap_by_kind",
    IS + ", split as (select g.kind as k, s.label, s.score from image_scores s, lateral (select unnest(case when s.label = 1 then [s.kind] else ['logical', 'structural'] end) as kind) g)," + curve_sql("split", "k") + f"select key as kind, round({AP}, 6) as ap from curve group by 1",
)
def _(spark, sf_dir):
    return rounded(met.ap_by_kind(scores(spark, sf_dir), ["logical", "structural"]), "ap")


@query(
    "met12_region_overlap",
    CR + """,
    q as (select image_id % 2 as k, quantile_cont(value, 0.95) as t5, quantile_cont(value, 0.99) as t1 from cells where not mask and y % 4 = 0 and x % 4 = 0 group by 1),
    o as (select q.k, image_id, region_id, f.fpr, avg((c.value > case when f.fpr = 0.05 then t5 else t1 end)::int) as overlap from cells c join regions r using (image_id, y, x) join q on q.k = c.image_id % 2 cross join (values (0.05::double), (0.01::double)) f(fpr) group by all)
    select k, fpr, round(avg(overlap), 6) as overlap, count(*) as regions from o group by all""",
)
def _(spark, sf_dir):
    c = cells(spark, sf_dir)
    made = met.region_overlap(c, regions(c).drop("k"), keys=("k",)).groupBy("k", "fpr").agg(F.avg("overlap").alias("overlap"), F.count("*").alias("regions"))
    return rounded(made, "overlap")


@query(
    "met13_image_pixel_ap",
    C + """, long as (select image_id, mask, 'value' as method, value as score from cells union all select image_id, mask, 'value_b', value_b from cells union all select image_id, mask, 'place', (y * 11 + x)::double from cells),"""
    + curve_sql("long", "{'i': image_id, 'm': method}", "mask") + f", ap as (select key.i as image_id, key.m as method, {AP} as ap from curve group by key), wide as (select image_id, max(ap) filter (method = 'value') as a, max(ap) filter (method = 'value_b') as b, max(ap) filter (method = 'place') as c from ap group by 1) "
    "select image_id, round(a, 6) as value, round(b, 6) as value_b, round(c, 6) as place, round(a - greatest(b, c), 6) as gain from wide",
)
def _(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("place", (F.col("y") * 11 + F.col("x")).cast("double"))
    return rounded(met.image_pixel_ap(c, ["value", "value_b", "place"]), "value", "value_b", "place", "gain")


@query("met14_defect_area", C + ", s as (select image_id, avg(mask::int) as share from cells group by 1 having sum(mask::int) > 0) select image_id % 11 as dataset, round(quantile_cont(share, 0.5) * 100, 6) as median_area_pct from s group by 1")
def _(spark, sf_dir):
    return rounded(met.defect_area(fx.cells(spark, sf_dir), F.col("image_id") % 11), "median_area_pct")


@query("met15_map_variants")
def _(spark, sf_dir):
    """AU-PRO of maps smoothed by sigma 0, 1 and 2, of one layer or the mean of both, and of mean maps upsampled to twice
    their size before they are smoothed by sigma 4 or 8."""
    c = cells(spark, sf_dir)
    mean = c.select("image_id", "y", "x", ((F.col("value") + F.col("value_b")) / 2).alias("value"))
    single = {"a": c.select("image_id", "y", "x", "value"), "b": c.select("image_id", "y", "x", F.col("value_b").alias("value")), "mean": mean}
    plain = {f"{name}_s{s}": grd.gaussian_smooth(frame, s, H, W) for name, frame in single.items() for s in (0, 1, 2)}
    larger = grd.upsample(mean, H, W, 2 * H, 2 * W, "corner")
    up = {f"mean_up_s{s}": grd.gaussian_smooth(larger, s, 2 * H, 2 * W) for s in (4, 8)}
    own = grd.masks_of(c, "mask1")
    made = met.map_variants(plain, own).unionByName(met.map_variants(up, grd.resize_nearest(own, H, W, 2 * H, 2 * W)))
    return rounded(made.select("variant", "aupro", "pixel_auroc", "pixel_ap"), "aupro", "pixel_auroc", "pixel_ap")


for how, sql in {"p95": "quantile_cont(value, 0.95)", "mean": "avg(value)", "max": "max(value)"}.items():

    @query(f"pol{1 if how == 'p95' else 2}_pool_{how}", C + f"select image_id, round({sql}, 4) as score from cells group by 1")
    def _(spark, sf_dir, how=how):
        return rounded(pol.pool(fx.cells(spark, sf_dir), how), "score", places=4)


TOP = "select image_id, round(avg(value), 4) as score from (select *, row_number() over (partition by image_id order by value desc) as k from cells) where k <= 5 group by 1"


@query("pol3_pool_top1pct", C + TOP)
def _(spark, sf_dir):
    return rounded(pol.pool(fx.cells(spark, sf_dir), "top1pct"), "score", places=4)


LAYERS = ", layers as (select image_id, y, x, 'a' as layer, value, mask from cells union all select image_id, y, x, 'b', value_b, mask from cells)"


def layers(spark, sf_dir):
    both = F.explode(F.array(F.struct(F.lit("a").alias("layer"), F.col("value").alias("value")), F.struct(F.lit("b").alias("layer"), F.col("value_b").alias("value")))).alias("l")
    return fx.cells(spark, sf_dir).select("image_id", "y", "x", "mask", both).select("image_id", "y", "x", "mask", "l.*")


@query("pol4_layer_mean", C + LAYERS + ", p as (select image_id, layer, quantile_cont(value, 0.95) as score from layers group by all) select image_id, round(avg(score), 7) as score from p group by 1")
def _(spark, sf_dir):
    return rounded(pol.layer_mean(pol.pool(layers(spark, sf_dir), "p95", ("image_id", "layer"))), "score", places=7)


@query("pol5_pool_fused_map", C + LAYERS + ", f as (select image_id, y, x, avg(value) as value from layers group by all) select image_id, round(quantile_cont(value, 0.95), 7) as score from f group by 1")
def _(spark, sf_dir):
    return rounded(pol.pool(pol.fused_map(layers(spark, sf_dir)), "p95"), "score", places=7)


@query("pol6_fused_map", C + LAYERS + "select image_id, y, x, round(avg(value), 6) as value from layers group by all")
def _(spark, sf_dir):
    return rounded(pol.fused_map(layers(spark, sf_dir)), "value", places=6)


@query(
    "pol7_z_fusion",
    C + LAYERS + """, st as (select layer, avg(value) as m, stddev_pop(value) as s from layers where image_id % 3 <> 0 group by 1),
    z as (select image_id, y, x, avg((value - m) / s) as value from layers join st using (layer) group by all) select image_id, y, x, round(value, 5) as value from z""",
)
def _(spark, sf_dir):
    maps = layers(spark, sf_dir)
    return rounded(pol.z_fusion(maps, maps.where("image_id % 3 <> 0")), "value", places=5)


@query(
    "pol8_normalize_maps",
    C + LAYERS + """, p as (select layer, quantile_cont(value, 0.99) as p from layers where image_id % 3 <> 0 group by 1)
    select image_id, y, x, layer, round(greatest(0, least(2, value / p)), 6) as value from layers join p using (layer)""",
)
def _(spark, sf_dir):
    maps = layers(spark, sf_dir).withColumn("label", (F.col("image_id") % 3 == 0).cast("int"))
    return rounded(pol.normalize_maps(maps, ["layer"]).select("image_id", "y", "x", "layer", "value"), "value")


@query(
    "pol9_peak_in_region",
    C + """, peak as (select image_id, y, x from cells qualify row_number() over (partition by image_id order by value desc, y, x) = 1)
    select p.image_id, p.y, p.x, exists (select 1 from cells c where c.mask1 and c.image_id = p.image_id and abs(c.y - p.y) <= 2 and abs(c.x - p.x) <= 2) as inside from peak p""",
)
def _(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return pol.peak_in_region(c, grd.dilate(grd.masks_of(c, "mask1"), 5, H, W)).select("image_id", "y", "x", "inside")


@query(
    "pol10_pool_all",
    C + LAYERS + """, t as (select image_id, layer, avg(value) as top1pct from (select *, row_number() over (partition by image_id, layer order by value desc) as k from layers) where k <= 5 group by all)
    select image_id, layer, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(max(value), 6) as max, round(any_value(top1pct), 6) as top1pct from layers join t using (image_id, layer) group by all""",
)
def _(spark, sf_dir):
    return rounded(pol.pool_all(layers(spark, sf_dir)), "p95", "p99", "max", "top1pct", places=6)


@query(
    "sta13_region_size_gain",
    "with recursive " + fx.CELLS + "," + regions_sql("mask1") + """, v as (select image_id, region_id, image_id % 11 as dataset, count(*)::double as area, avg(value) - avg(value_b) as gain from regions join cells using (image_id, y, x) group by all),
    sized as (select *, case when area <= q1 then 'small' when area <= q2 then 'medium' else 'large' end as size_class from v cross join (select quantile_cont(area, 1/3::double) as q1, quantile_cont(area, 2/3::double) as q2 from v)),
    by_c as (select size_class, dataset, avg(gain) as g, count(*) as k from sized group by all)
    select size_class, round(avg(g), 4) as gain, sum(k)::bigint as regions, count(*) as categories from by_c group by 1""",
)
def _(spark, sf_dir):
    """Gain of one map over another in regions, by region size class."""
    from ..operators import stats as sta

    c = fx.cells(spark, sf_dir)
    found = grd.connected_components(grd.masks_of(c, "mask1"), 4, fx.GRID_H, fx.GRID_W)
    values = found.join(c, ["image_id", "y", "x"]).groupBy("image_id", "region_id").agg(F.count("*").cast("double").alias("area"), (F.avg("value") - F.avg("value_b")).alias("gain"))
    made = sta.region_size_gain(values.withColumn("dataset", F.col("image_id") % 11))
    return rounded(made, "gain", places=4)


@query(
    "sta14_interior_gain",
    C + """, parts as (select *, 'whole' as part from cells union all select *, 'interior' from cells where y between 2 and 47 and x between 2 and 8),
    long as (select part, image_id % 11 as k, mask, 'a' as m, value as score from parts union all select part, image_id % 11, mask, 'b', value_b from parts),"""
    + curve_sql("long", "{'p': part, 'k': k, 'm': m}", "mask") + f""", ap as (select key.p as part, key.k::varchar as dataset, key.m as m, {AP} * 100 as ap from curve group by key),
    pairs as (select part, dataset, max(ap) filter (m = 'a') - max(ap) filter (m = 'b') as d from ap group by all having d is not null),
    u as (select part, d, row_number() over (partition by part order by dataset) - 1 as unit, count(*) over (partition by part) as units from pairs)""" + draws("part", 5000)
    + f" select p.*, round(lo, 6) as lo, round(hi, 6) as hi from (select part, {POINT} from pairs group by 1) p join ci using (part)",
)
def _(spark, sf_dir):
    """Paired bootstrap of pixel AP of two maps over categories, on whole grids and on their interior."""
    from ..operators import stats as sta

    out = None
    for part, b in (("whole", 0), ("interior", 2)):
        c = grd.crop_border(fx.cells(spark, sf_dir), b, H, W).withColumn("k", F.col("image_id") % 11)
        long = c.select("k", "mask", F.explode(F.array(F.struct(F.lit("a").alias("m"), F.col("value").alias("s")), F.struct(F.lit("b").alias("m"), F.col("value_b").alias("s")))).alias("v"))
        ap = met.average_precision(long.select("k", F.col("mask").alias("label"), "v.m", F.col("v.s").alias("score")), keys=["k", "m"])
        pairs = sta.paired(ap.select(F.col("k").cast("string").alias("dataset"), F.col("m").alias("method"), (F.col("ap") * 100).alias("mean")), "a", "b")
        made = sta.paired_bootstrap(pairs, 5_000).withColumn("part", F.lit(part))
        out = made if out is None else out.unionByName(made)
    return rounded(out, "mean", "lo", "hi")
