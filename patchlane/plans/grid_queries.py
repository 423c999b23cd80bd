"""Queries of the grid operators over the grid view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as grd
from ..operators import models as fit
from . import fixtures as fx
from .metric_queries import regions_sql
from .registry import query
from .result_queries import rounded
from .vector_queries import P, all_patches

H, W = fx.GRID_H, fx.GRID_W
C = "with " + fx.CELLS
PLACE = ("image_id", "y", "x")


def grids(spark, sf_dir):
    return fx.cells(spark, sf_dir).select(*PLACE, "value")


def masks(spark, sf_dir, name="mask1"):
    return grd.masks_of(fx.cells(spark, sf_dir), name)


@query("grd1_hflip", C + "select image_id, y, 10 - x as x, value from cells")
def _(spark, sf_dir):
    return grd.hflip(grids(spark, sf_dir), W)


@query(
    "grd2_dihedral",
    C + """, v as (select image_id, y, case when view >= 4 then 10 - x else x end as x, value, view from cells cross join range(8) r(view))
    select image_id, view::int as view, (case view % 4 when 0 then y when 1 then 10 - x when 2 then 49 - y else x end)::int as y, (case view % 4 when 0 then x when 1 then y when 2 then 10 - x else 49 - y end)::int as x, value from v""",
)
def _(spark, sf_dir):
    return grd.dihedral(grids(spark, sf_dir), H, W).select("image_id", "view", "y", "x", "value")


def mirror_sql(i: str, n: int) -> str:
    p = 2 * n - 2
    m = f"((({i}) % {p}) + {p}) % {p}"
    return f"case when {m} < {n} then {m} else {p} - {m} end"


def affine_sql(source: str, angle: str, value: str = "value", border: bool = True, nearest: bool = False, others: str = "image_id", scale: str = "1.0::double") -> str:
    y, x = (mirror_sql("y0", H), mirror_sql("x0", W)) if border else ("y0", "x0")
    corner = "select *, floor(sy + 0.5)::int as y0, floor(sx + 0.5)::int as x0, 1.0::double as w from placed" if nearest else (
        "select *, (floor(sy) + a)::int as y0, (floor(sx) + b)::int as x0, (case when a = 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) * (case when b = 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) as w "
        "from placed cross join (values (0), (1)) ga(a) cross join (values (0), (1)) gb(b)"
    )
    return f"""
placed as (select {others}, y as ty, x as tx, round((cos(radians({angle})) * (x - 5.5) - sin(radians({angle})) * (y - 25.0)) / {scale} + 5.5, 9) as sx,
  round((sin(radians({angle})) * (x - 5.5) + cos(radians({angle})) * (y - 25.0)) / {scale} + 25.0, 9) as sy from {source}),
corners as ({corner}),
sources as (select *, {y} as ys, {x} as xs from corners where w > 0)
"""


ANGLES = ", src as (select image_id, y, x, value, angle::double as angle from cells cross join (values (0), (45), (90), (135), (180), (225), (270), (315)) a(angle)),"


@query("grd3_affine", C + "," + affine_sql("cells", "30.0::double", scale="1.1::double") + "select s.image_id, s.ty as y, s.tx as x, round(sum(w * c.value), 3) as value from sources s join cells c on c.image_id = s.image_id and c.y = s.ys and c.x = s.xs group by all")
def _(spark, sf_dir):
    return rounded(grd.affine(grids(spark, sf_dir), H, W, F.lit(30.0), 1.1), "value", places=3)


@query(
    "grd3_affine_mask",
    C + ", m as (select image_id, y, x, mask1::int as value from cells)," + affine_sql("m", "20.0::double", border=False, nearest=True) + "select s.image_id, s.ty as y, s.tx as x, round(sum(w * coalesce(c.value, 0)), 3)::double as value from sources s left join m c on c.image_id = s.image_id and c.y = s.ys and c.x = s.xs group by all",
)
def _(spark, sf_dir):
    m = fx.cells(spark, sf_dir).select(*PLACE, F.col("mask1").cast("int").alias("value"))
    return rounded(grd.affine(m, H, W, F.lit(20.0), interp="nearest", border="zero"), "value", places=3)


@query("grd4_rotate_views", C + ANGLES + affine_sql("src", "angle", others="image_id, angle") + "select s.image_id, s.angle, s.ty as y, s.tx as x, round(sum(w * c.value), 6) as value from sources s join src c on c.image_id = s.image_id and c.angle = s.angle and c.y = s.ys and c.x = s.xs group by all")
def _(spark, sf_dir):
    return rounded(grd.rotate_views(grids(spark, sf_dir), H, W), "value", places=6)


@query("grd4_random_angles", C + "select image_id, k::int as k, (case when k = 0 then 0 else ('0x' || substr(md5('3|' || image_id || '|' || k), 1, 8))::bigint % 24 * 15 end)::double as angle from (select distinct image_id from cells) cross join range(30) r(k)")
def _(spark, sf_dir):
    return grd.random_angles(grids(spark, sf_dir), 30, 3)


SCALED = ", s as (select image_id, y, x, round(value / 1000) as value from cells)"


def scaled(spark, sf_dir):
    return grids(spark, sf_dir).withColumn("value", F.round(F.col("value") / 1000))


@query(
    "grd5_perturb",
    C + SCALED + """, p as (select *, (('0x' || substr(md5('1|' || image_id || '|' || y || '|' || x), 1, 8))::bigint + 1) / 4294967297.0::double as u1, ('0x' || substr(md5('1|' || image_id || '|' || y || '|' || x || '|b'), 1, 8))::bigint / 4294967296.0::double as u2 from s)
    select image_id, y, x, greatest(0, least(255, round(value * 1.25::double)))::double as bright, greatest(0, least(255, round(value * (1 + (image_id % 3 - 1) * 0.5::double))))::double as gain,
           greatest(0, least(255, round(value + 5 * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)))) as noisy from p""",
)
def _(spark, sf_dir):
    s = scaled(spark, sf_dir)
    kinds = (("brightness", 1.25, "bright"), ("gain", 0.5, "gain"), ("noise", 5.0, "noisy"))
    a, b, c = (grd.perturb(s, k, v, seed=1).withColumnRenamed("value", n) for k, v, n in kinds)
    return a.join(b, list(PLACE)).join(c, list(PLACE))


def smooth_sql(sigma: float, source: str = "cells") -> str:
    weights = ", ".join(f"({k - len(grd.kernel(sigma)) // 2}, {w!r}::double)" for k, w in enumerate(grd.kernel(sigma)))
    fold = lambda i, n: f"(case when (((({i}) % {2 * n}) + {2 * n}) % {2 * n}) < {n} then (((({i}) % {2 * n}) + {2 * n}) % {2 * n}) else {2 * n - 1} - (((({i}) % {2 * n}) + {2 * n}) % {2 * n}) end)"
    return f"""
k as (select * from (values {weights}) k(o, w)),
down as (select t.image_id, t.y, t.x, sum(k.w * c.value) as value from {source} t cross join k join {source} c on c.image_id = t.image_id and c.x = t.x and c.y = {fold("t.y + k.o", H)} group by all),
smooth as (select t.image_id, t.y, t.x, sum(k.w * c.value) as value from down t cross join k join down c on c.image_id = t.image_id and c.y = t.y and c.x = {fold("t.x + k.o", W)} group by all)
"""


@query("grd6_blur", C + "," + smooth_sql(2.0) + "select image_id, y, x, round(value, 3) as value from smooth")
def _(spark, sf_dir):
    return rounded(grd.perturb(grids(spark, sf_dir), "blur", 2.0, height=H, width=W), "value", places=3)


@query("grd7_gaussian_smooth", C + "," + smooth_sql(1.0) + "select image_id, y, x, round(value, 3) as value from smooth")
def _(spark, sf_dir):
    return rounded(grd.gaussian_smooth(grids(spark, sf_dir), 1.0, H, W), "value", places=3)


def upsample_sql(align: str, nh: int, nw: int) -> str:
    s = (lambda i, n, new: f"{i} * {n - 1} / {new - 1}.0::double") if align == "corner" else (lambda i, n, new: f"least(greatest(({i} + 0.5::double) * {n} / {new} - 0.5::double, 0), {n - 1})")
    axis = lambda v, n, new: f"select i as t, least(floor(s)::int, {n - 1}) as a, least(least(floor(s)::int, {n - 1}) + 1, {n - 1}) as b, s - least(floor(s)::int, {n - 1}) as f from (select i, round({s('i', n, new)}, 9) as s from range({new}) r(i))"
    taps = lambda v: f"select t, a as p, 1 - f as w from {v} where 1 - f > 0 union all select t, b, f from {v} where f > 0"
    return f"""ay as ({axis('y', H, nh)}), ax as ({axis('x', W, nw)}), ty as ({taps('ay')}), tx as ({taps('ax')})
select image_id, ty.t::int as y, tx.t::int as x, round(sum(value * ty.w * tx.w), 6) as value from cells join ty on ty.p = y join tx on tx.p = x group by all"""


@query("grd8_upsample_corner", C + "," + upsample_sql("corner", 75, 22))
def _(spark, sf_dir):
    return rounded(grd.upsample(grids(spark, sf_dir), H, W, 75, 22, "corner"), "value", places=6)


@query("grd9_upsample_center", C + "," + upsample_sql("center", 75, 22))
def _(spark, sf_dir):
    return rounded(grd.upsample(grids(spark, sf_dir), H, W, 75, 22, "center"), "value", places=6)


@query("grd10_resize_nearest", C + "select image_id, t.y::int as y, u.x::int as x from cells c join range(30) t(y) on floor((t.y + 0.5::double) * 50 / 30) = c.y join range(16) u(x) on floor((u.x + 0.5::double) * 11 / 16) = c.x where mask1")
def _(spark, sf_dir):
    return grd.resize_nearest(masks(spark, sf_dir), H, W, 30, 16)


@query("grd11_resize_area", C + "select image_id, (y // 5)::int as y, (x // 5)::int as x, round(avg(value), 4) as value from cells group by all")
def _(spark, sf_dir):
    return rounded(grd.resize_area(grids(spark, sf_dir), 5), "value", places=4)


DILATED = ", d as (select t.image_id, t.y, t.x from cells t where exists (select 1 from cells c where c.mask1 and c.image_id = t.image_id and {0}))"
SQUARE = "abs(c.y - t.y) <= 1 and abs(c.x - t.x) <= 1"


@query("grd12_dilate", C + DILATED.format(SQUARE) + "select * from d")
def _(spark, sf_dir):
    return grd.dilate(masks(spark, sf_dir), 3, H, W)


@query("grd12_dilate_cross", C + DILATED.format("abs(c.y - t.y) + abs(c.x - t.x) <= 3") + "select * from d")
def _(spark, sf_dir):
    return grd.dilate_cross(masks(spark, sf_dir), 3, H, W)


@query("grd12_close", C + DILATED.format(SQUARE) + "select d.image_id, d.y, d.x from d join d c on c.image_id = d.image_id and abs(c.y - d.y) <= 1 and abs(c.x - d.x) <= 1 group by all having count(*) = (least(d.y + 1, 49) - greatest(d.y - 1, 0) + 1) * (least(d.x + 1, 10) - greatest(d.x - 1, 0) + 1)")
def _(spark, sf_dir):
    return grd.close(masks(spark, sf_dir), 3, H, W)


@query("grd13_components_4", "with recursive " + fx.CELLS + "," + regions_sql("mask1") + "select image_id, y, x, region_id::bigint as region_id from regions")
def _(spark, sf_dir):
    return grd.connected_components(masks(spark, sf_dir), 4, H, W)


@query(
    "grd14_components_8",
    "with recursive " + fx.CELLS + "," + regions_sql("mask1", "abs(m.y - r.y) <= 1 and abs(m.x - r.x) <= 1") + "select image_id, region_id::bigint as region_id, count(*) as area, max((y < 1 or x < 1 or y >= 49 or x >= 10)::int) = 1 as edge from regions group by all",
)
def _(spark, sf_dir):
    return grd.region_stats(grd.connected_components(masks(spark, sf_dir), 8, H, W), H, W)


@query("grd15_foreground_mask")
def _(spark, sf_dir):
    made = None
    for layer in ("a", "b"):
        p = all_patches(spark, sf_dir).where(F.col("layer") == layer)
        keep = grd.foreground_mask(p.select("image_id", "gy", "gx", "vec"), threshold=0.1)
        own = grd.apply_mask(p.select("layer", "image_id", "gy", "gx", F.get("vec", 0).alias("value")), keep)
        made = own if made is None else made.unionByName(own)
    return rounded(made, "value")


@query(
    "grd16_tta_average",
    C + ", own as materialized (select image_id, y, x, value, value_b from cells), flipped as materialized (select image_id, y, 10 - x as x, value_b from own) "
    "select image_id, y, x, round((value + f.value_b) / 2, 6) as value from own join flipped f using (image_id, y, x)",
)
def _(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    flipped = grd.hflip(c.select(*PLACE, F.col("value_b").alias("value")), W)
    return rounded(grd.tta_average(c, flipped), "value", places=6)


@query("grd17_stride", C + "select image_id, y, x, value from cells where y % 4 = 0 and x % 4 = 0")
def _(spark, sf_dir):
    return grd.stride(grids(spark, sf_dir))


@query("grd18_aspect_extent", "with i as (select page_id as image_id, 100 + page_id % 83 as h, 90 + page_id % 71 as w from pages) select image_id, (floor(round(h * (448.0::double / least(h, w))) / 16) * 16)::int as new_h, (floor(round(w * (448.0::double / least(h, w))) / 16) * 16)::int as new_w from i")
def _(spark, sf_dir):
    images = fx.table(spark, sf_dir, "pages").selectExpr("page_id as image_id", "100 + page_id % 83 as h", "90 + page_id % 71 as w")
    return grd.aspect_extent(images, 448, 16).select("image_id", "new_h", "new_w")


@query(
    "prj9_valid_patches",
    C + ", ones as (select image_id, y, x, 1.0::double as value from cells)," + affine_sql("ones", "45.0::double", border=False)
    + ", v as (select s.image_id, s.ty as y, s.tx as x, sum(w * coalesce(c.value, 0)) as value from sources s left join ones c on c.image_id = s.image_id and c.y = s.ys and c.x = s.xs group by all) select image_id, (y // 5)::int as py, (x // 5)::int as px, round(avg(value), 6) as share from v group by all having round(avg(value), 9) >= 0.75",
)
def _(spark, sf_dir):
    ones = fx.cells(spark, sf_dir).select(*PLACE, F.lit(1.0).alias("value"))
    warped = grd.affine(ones, H, W, F.lit(45.0), border="zero")
    return rounded(grd.valid_patches(H, W, warped, 5), "share").select("image_id", "py", "px", "share")


@query("fit14_memory_bank", P + ", r as (select *, sqrt(list_sum(list_transform(vec, lambda v: v * v))) as n from patches where is_ref) select image_id, layer, gy, gx, round(vec[1] / n, 6) as first from r")
def _(spark, sf_dir):
    from ..operators.projections import normalized

    return normalized(all_patches(spark, sf_dir).where("is_ref")).select("image_id", "layer", "gy", "gx", F.round(F.get("vec", 0), 6).alias("first"))


@query(
    "fit15_spatial_prior",
    P + ", k as (select * from (values " + ", ".join(f"({i - len(grd.kernel(2.0)) // 2}, {w!r}::double)" for i, w in enumerate(grd.kernel(2.0))) + """) k(o, w)),
    refs as (select layer, gy, gx, label % 3 as component from patches where is_ref),
    full_ as (select l.layer, y.gy, x.gx, c.component, count(r.layer)::double as r from (values ('a'), ('b')) l(layer) cross join range(4) y(gy) cross join range(4) x(gx) cross join range(3) c(component)
      left join refs r on r.layer = l.layer and r.gy = y.gy and r.gx = x.gx and r.component = c.component group by all),
    smooth as (select t.layer, t.gy, t.gx, t.component, sum(a.w * b.w * f.r) + 1 as v from full_ t cross join k a cross join k b
      join full_ f on f.layer = t.layer and f.component = t.component and f.gy = least(greatest(t.gy + a.o, 0), 3) and f.gx = least(greatest(t.gx + b.o, 0), 3) group by all),
    counts as (select layer, component, count(*) as c from refs group by 1, 2), weights as (select layer, component, c / (sum(c) over (partition by layer))::double as w from counts)
    select layer, gy::int as gy, gx::int as gx, component::int as component, round(0.5::double * w + 0.5::double * v / sum(v) over (partition by layer, gy, gx), 6) as prior from smooth join weights using (layer, component)""",
)
def _(spark, sf_dir):
    made = None
    for layer in ("a", "b"):
        refs = all_patches(spark, sf_dir).where(F.col("is_ref") & (F.col("layer") == layer)).withColumn("component", (F.col("label") % 3).cast("int"))
        resp = refs.groupBy("gy", "gx", "component").agg(F.count("*").cast("double").alias("r"))
        full = refs.select("gy", "gx").distinct().withColumn("component", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).join(resp, ["gy", "gx", "component"], "left").fillna(0.0, ["r"])
        total = refs.groupBy().agg(F.count("*").alias("n"))
        weights = refs.groupBy("component").agg(F.count("*").alias("c")).join(F.broadcast(total)).select("component", (F.col("c") / F.col("n")).alias("w"))
        own = fit.spatial_prior(full, weights, 4, 4, 0.5).withColumn("layer", F.lit(layer))
        made = own if made is None else made.unionByName(own)
    return rounded(made, "prior")
