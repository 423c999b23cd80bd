"""Queries of the planning and statistics operators over the runs view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as jon
from ..operators import stats as sta
from . import fixtures as fx
from .registry import query

B = 10_000  # resamples of paired differences, as the operator's default


def runs(spark, sf_dir):
    return jon.merge_runs([fx.raw_runs(spark, sf_dir)], order="ord")


def means(spark, sf_dir):
    return sta.category_means(runs(spark, sf_dir), fx.NS)


def pairs(spark, sf_dir):
    return sta.paired(means(spark, sf_dir), "m0", "m1")


def area(spark, sf_dir):
    """Median defect share by category number 0..10."""
    masks = fx.cells(spark, sf_dir).groupBy("image_id").agg(F.sum(F.col("mask").cast("int")).alias("n")).where("n > 0")
    return masks.groupBy((F.col("image_id") % 11).alias("cat")).agg((F.percentile("n", 0.5) / 550 * 100).alias("area"))


def sized_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("cat", F.split_part(F.col("dataset"), F.lit("/"), F.lit(2)).cast("long"))
    return p.join(area(spark, sf_dir), "cat")


R = "with " + fx.RUNS
GRID = """,
grid as (select distinct c.dataset, m.method, n.n_train, s.seed from (select distinct dataset from raw_runs) c cross join (values ('m0'), ('m1'), ('m2'), ('m3')) m(method)
  cross join (values (1), (2), (4), (5)) n(n_train) cross join (values (0), (1), (2), (3), (4)) s(seed))
"""
MEANS = """,
by_n as (select dataset, method, n_train, avg(metric) as by_n from runs group by all),
means as (select dataset, method, case when count(*) = 4 then avg(by_n) * 100 end as mean from by_n group by all),
pairs as (select dataset, max(case when method = 'm0' then mean end) as x, max(case when method = 'm1' then mean end) as y from means group by 1
  having x is not null and y is not null),
diffs as (select dataset, x, y, x - y as d, split_part(dataset, '/', 1) as benchmark, split_part(dataset, '/', 2)::bigint as cat from pairs)
"""
AREA = "," + fx.CELLS + """,
masked as (select image_id, sum(mask::int) as n from cells group by 1 having n > 0),
area as (select image_id % 11 as cat, quantile_cont(n::double, 0.5) / 550 * 100 as area from masked group by 1),
sized as (select * from diffs join area using (cat))
"""


def draws(by: str = "", b: int = B) -> str:
    """SQL of b resamples of table u (by, unit, units, d)."""
    c = f"{by}, " if by else ""
    return f""",
reps as (select {c}rep, sum(d) as d, count(*) as drawn from (
  select {"p." + by + ", " if by else ""}p.rep, u.d from (
    select {c}rep, place, ('0x' || substr(md5('0|' || rep || '|' || place), 1, 8))::bigint % units as unit
    from (select *, unnest(range(units)) as place from (select distinct {c}units from u) g cross join range({b}) r(rep))) p
  join u on {"u." + by + " = p." + by + " and " if by else ""}u.unit = p.unit) group by {c}rep),
ci as (select {c}quantile_cont(d / drawn, 0.025) as lo, quantile_cont(d / drawn, 0.975) as hi from reps {"group by " + by if by else ""})
"""


POINT = "round(avg(d), 6) as mean, count(*) filter (d > 0.5) as wins, count(*) filter (abs(d) <= 0.5) as ties, count(*) filter (d < -0.5) as losses, count(*) as n"


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def grid(spark, sf_dir):
    categories = fx.raw_runs(spark, sf_dir).select("dataset").distinct()
    return jon.work_grid(categories, method=["m0", "m1", "m2", "m3"], n_train=list(fx.NS), seed=list(range(5)))


@query("jon1_work_grid", R + GRID + "select * from grid")
def _(spark, sf_dir):
    return grid(spark, sf_dir)


@query("jon2_pending", R + GRID + "select * from grid anti join runs using (dataset, method, n_train, seed)")
def _(spark, sf_dir):
    return jon.pending(grid(spark, sf_dir), runs(spark, sf_dir))


@query("jon3_done_units", R + "select dataset, n_train, count(*) as rows from runs group by all having count(*) >= 18")
def _(spark, sf_dir):
    return jon.done_units(runs(spark, sf_dir), ["dataset", "n_train"], 18)


@query("jon4_pending_counts", R + GRID + "select dataset, count(*) as pending from grid anti join runs using (dataset, method, n_train, seed) group by 1")
def _(spark, sf_dir):
    return jon.pending_counts(grid(spark, sf_dir), runs(spark, sf_dir))


@query("jon5_missing_scores", R + "select dataset, method, n_train, seed from runs anti join (select * from runs where ord % 3 <> 0) s using (dataset, method, n_train, seed)")
def _(spark, sf_dir):
    r = runs(spark, sf_dir)
    return jon.missing_scores(r, r.where("ord % 3 <> 0")).select(*jon.KEYS)


@query(
    "jon6_interleave_shard",
    R + """select dataset, position, position % 7 as shard from (select dataset, (row_number() over (order by turn, benchmark) - 1)::int as position from (
    select dataset, split_part(dataset, '/', 1) as benchmark, row_number() over (partition by split_part(dataset, '/', 1) order by dataset) as turn from (select distinct dataset from raw_runs)))""",
)
def _(spark, sf_dir):
    return jon.shard(jon.interleave(fx.raw_runs(spark, sf_dir), sta.benchmark()), 7).select("dataset", "position", "shard")


@query(
    "jon7_merge_runs",
    R + """select dataset, method, n_train, seed, metric, extra from (
    select *, row_number() over (partition by dataset, method, n_train, seed order by source desc, ord desc) as k from (
      select *, null::double as extra, 0 as source from raw_runs where ord % 2 = 0 union all select *, metric * 2 as extra, 1 as source from raw_runs where ord % 5 = 0)) where k = 1""",
)
def _(spark, sf_dir):
    r = fx.raw_runs(spark, sf_dir)
    merged = jon.merge_runs([r.where("ord % 2 = 0"), r.where("ord % 5 = 0").withColumn("extra", F.col("metric") * 2)], order="ord")
    return merged.select(*jon.KEYS, "metric", "extra")


@query("jon8_enrich_runs", R + "select r.dataset, r.method, r.n_train, r.seed, r.metric, s.again from runs r left join (select dataset, method, n_train, seed, metric + 1 as again from runs where seed < 3) s using (dataset, method, n_train, seed)")
def _(spark, sf_dir):
    r = runs(spark, sf_dir)
    return jon.enrich_runs(r, r.where("seed < 3").withColumn("again", F.col("metric") + 1), ["again"]).select(*jon.KEYS, "metric", "again")


@query("jon9_filter_runs", R + "select dataset, method, n_train, seed, metric from runs where dataset like 'view/%' and dataset in (select dataset from runs where seed = 1 and metric > 0.1)")
def _(spark, sf_dir):
    r = runs(spark, sf_dir)
    return jon.filter_runs(r, prefix="view/", allowed=r.where("seed = 1 and metric > 0.1").select("dataset").distinct()).select(*jon.KEYS, "metric")


@query("jon10_exclude_units", R + GRID + "select * from grid where not (method = 'm1' and n_train in (1, 2)) and not (method = 'm3' and n_train = 5)")
def _(spark, sf_dir):
    g = grid(spark, sf_dir)
    rules = g.where("(method = 'm1' and n_train in (1, 2)) or (method = 'm3' and n_train = 5)").select("method", "n_train").distinct()
    return jon.exclude_units(g, rules).select(*jon.KEYS)


@query("sta1_category_means", R + MEANS + "select dataset, method, round(mean, 6) as mean from means")
def _(spark, sf_dir):
    return rounded(means(spark, sf_dir), "mean")


@query(
    "sta2_complete_methods",
    R + MEANS + "select method from means where mean is not null and not (dataset = 'view/0' and method = 'm3') group by 1 having count(distinct dataset) = (select count(distinct dataset) from means)",
)
def _(spark, sf_dir):
    m = means(spark, sf_dir)
    return sta.complete_methods(m.withColumn("mean", F.when(~((F.col("dataset") == "view/0") & (F.col("method") == "m3")), F.col("mean"))))


@query(
    "sta3_summary_table",
    R + MEANS + """, rows_ as (select *, split_part(dataset, '/', 1) as benchmark from means),
    grouped as (select method, benchmark as grp, mean from rows_ union all select method, 'all', mean from rows_ union all
      select method, case when benchmark in ('click', 'view') then 'dev' else 'external' end, mean from rows_),
    v as (select method, grp, avg(mean) as value from grouped group by all)
    select method, grp, round(value, 6) as value, round(value, 1) = max(round(value, 1)) over (partition by grp) as best from v""",
)
def _(spark, sf_dir):
    m = means(spark, sf_dir)
    groups = m.select(sta.benchmark().alias("benchmark")).distinct().withColumn("grp", F.when(F.col("benchmark").isin("click", "view"), "dev").otherwise("external"))
    return rounded(sta.summary_table(m, groups), "value")


@query("sta4_per_n_table", R + MEANS + ", v as (select n_train, method, avg(by_n) * 100 as value from by_n group by all) select n_train, method, round(value, 6) as value, round(value, 1) = max(round(value, 1)) over (partition by n_train) as best from v")
def _(spark, sf_dir):
    return rounded(sta.per_n_table(runs(spark, sf_dir)), "value")


U = ", u as (select d, row_number() over (order by dataset) - 1 as unit, count(*) over () as units from diffs)"


@query("sta5_paired_bootstrap", R + MEANS + U + draws() + f"select p.*, round(lo, 6) as lo, round(hi, 6) as hi from (select {POINT} from diffs) p cross join ci")
def _(spark, sf_dir):
    return rounded(sta.paired_bootstrap(pairs(spark, sf_dir)), "mean", "lo", "hi")


@query("sta6_win_tie_loss", R + MEANS + "select count(*) filter (d > 0.5) as wins, count(*) filter (abs(d) <= 0.5) as ties, count(*) filter (d < -0.5) as losses from diffs")
def _(spark, sf_dir):
    return sta.win_tie_loss(pairs(spark, sf_dir))


@query("sta7_gain_by_benchmark", R + MEANS + "select benchmark, round(avg(d), 6) as gain, count(*) as n from diffs group by 1")
def _(spark, sf_dir):
    return rounded(sta.gain_by_benchmark(pairs(spark, sf_dir)), "gain")


@query(
    "sta8_leave_one_out",
    R + MEANS + """, kept as (select b.benchmark as left_out, d.* from diffs d join (select distinct benchmark from diffs) b on b.benchmark <> d.benchmark),
    u as (select left_out, d, row_number() over (partition by left_out order by dataset) - 1 as unit, count(*) over (partition by left_out) as units from kept)""" + draws("left_out")
    + f"select p.*, round(lo, 6) as lo, round(hi, 6) as hi from (select left_out, {POINT} from kept group by 1) p join ci using (left_out)",
)
def _(spark, sf_dir):
    return rounded(sta.leave_one_out(pairs(spark, sf_dir)), "mean", "lo", "hi")


CLASSED = """, classed as (select s.*, case when area <= q1 then 'small' when area <= q2 then 'medium' else 'large' end as size_class
  from sized s cross join (select quantile_cont(area, 1/3::double) as q1, quantile_cont(area, 2/3::double) as q2 from sized))"""


@query(
    "sta9_by_size",
    R + MEANS + AREA + CLASSED + ", u as (select size_class, d, row_number() over (partition by size_class order by dataset) - 1 as unit, count(*) over (partition by size_class) as units from classed)" + draws("size_class")
    + f"select p.*, round(lo, 6) as lo, round(hi, 6) as hi from (select size_class, {POINT} from classed group by 1) p join ci using (size_class)",
)
def _(spark, sf_dir):
    return rounded(sta.paired_bootstrap(sta.terciles(sized_pairs(spark, sf_dir), "area"), by=["size_class"]), "mean", "lo", "hi")


SLOPE = """, c as (select log10(area) - avg(log10(area)) over (partition by {g}) as dx, d - avg(d) over (partition by {g}) as dy from sized)
select round({s}sum(dx * dy) / nullif(sum(dx * dx), 0), 6) as slope, count(*) as n from c"""


@query("sta10_fixed_effect_slope", R + MEANS + AREA + SLOPE.format(g="benchmark", s="-"))
def _(spark, sf_dir):
    made = sta.within_slope(sized_pairs(spark, sf_dir), F.log10("area"), F.col("d"), [sta.benchmark()])
    return rounded(made.withColumn("slope", -F.col("slope")), "slope")


REGION_RUNS = """, scored as (select r.dataset, r.method, r.metric, split_part(r.dataset, '/', 2)::bigint as cat, r.seed, a.area * (1 + r.seed) as size
  from runs r join area a on a.cat = split_part(r.dataset, '/', 2)::bigint)"""


@query(
    "sta11_within_slope",
    R + MEANS + AREA + REGION_RUNS + """, c as (select log10(size) - avg(log10(size)) over (partition by dataset) as dx, metric - avg(metric) over (partition by dataset) as dy from scored)
    select round(sum(dx * dy) / nullif(sum(dx * dx), 0), 6) as slope, count(*) as n from c""",
)
def _(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("cat", F.split_part(F.col("dataset"), F.lit("/"), F.lit(2)).cast("long")).join(area(spark, sf_dir), "cat")
    return rounded(sta.within_slope(r, F.log10(F.col("area") * (1 + F.col("seed"))), F.col("metric"), ["dataset"]), "slope")


@query(
    "sta12_cluster_bootstrap",
    R + """, sums as (select dataset, sum(metric) as num, count(*) as den from runs group by 1),
    u as (select num, den, row_number() over (order by dataset) - 1 as unit, count(*) over () as units from sums),
    reps as (select rep, sum(num) / sum(den) as v from (
      select rep, ('0x' || substr(md5('0|' || rep || '|' || place), 1, 8))::bigint % units as unit from (select *, unnest(range(units)) as place from (select distinct units from u) cross join range(2000) r(rep))) p
      join u using (unit) group by rep)
    select round((select sum(num) / sum(den) from sums), 6) as value, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi from reps""",
)
def _(spark, sf_dir):
    return rounded(sta.cluster_bootstrap(runs(spark, sf_dir), "dataset", F.col("metric"), F.lit(1.0)), "value", "lo", "hi")


@query("sta15_gain_by_condition", R + "select cond, round(x, 10) as x, round(y, 10) as y, round(x - y, 10) as gain from (select split_part(dataset, '/', 1) as cond, avg(metric) filter (method = 'm0') as x, avg(metric) filter (method = 'm2') as y from runs group by 1)")
def _(spark, sf_dir):
    return rounded(sta.gain_by_condition(runs(spark, sf_dir).withColumn("cond", sta.benchmark()), "m0", "m2"), "x", "y", "gain", places=10)  # means of some hundred values tie at fewer places


@query(
    "sta16_ablation_table",
    R + MEANS + """, m as (select *, split_part(dataset, '/', 1) as benchmark from means), need as (select benchmark, count(distinct dataset) as need from m group by 1),
    by_b as (select method, benchmark, avg(mean) as v, count(distinct dataset) as have from m where mean is not null group by all),
    whole as (select method, case when sum(have) = (select sum(need) from need) then avg(v) end as v from by_b group by 1)
    select round(max(v) filter (method = 'm0'), 6) as x, round(max(v) filter (method = 'm1'), 6) as y, round(max(v) filter (method = 'm0') - max(v) filter (method = 'm1'), 6) as difference from whole""",
)
def _(spark, sf_dir):
    return rounded(sta.ablation_table(runs(spark, sf_dir), fx.NS, "m0", "m1"), "x", "y", "difference")


COSTS = ", costs as (select n_train, method, metric * 10 as fit_s, case when ord % 50 = 7 then 'nan'::double else 1 + metric end as score_ms, metric / 1000 as rel_diff, 40 + seed as forward_ms from runs)"


@query(
    "sta17_cost_table",
    R + COSTS + "select n_train, method, round(avg(fit_s), 6) as fit_s, round(avg(score_ms), 6) as score_ms, round(max(rel_diff), 9) as max_rel_diff, round(1000 / avg(forward_ms + score_ms), 6) as images_per_s from costs where isfinite(score_ms) group by all",
)
def _(spark, sf_dir):
    r = runs(spark, sf_dir).select(
        "n_train", "method", (F.col("metric") * 10).alias("fit_s"), F.when(F.col("ord") % 50 == 7, float("nan")).otherwise(1 + F.col("metric")).alias("score_ms"), (F.col("metric") / 1000).alias("rel_diff"), (40 + F.col("seed")).alias("forward_ms")
    )
    return rounded(rounded(sta.cost_table(r), "fit_s", "score_ms", "images_per_s"), "max_rel_diff", places=9)


@query(
    "sta18_benchmark_table",
    "with " + fx.CELLS + """, images as (select image_id, 'b' || (image_id % 4) || '/c' || (image_id % 11) as dataset, max(mask)::int as label from cells group by 1)
    select split_part(dataset, '/', 1) as benchmark, count(distinct dataset) as categories, count(*) filter (label = 0) as normal, count(*) filter (label = 1) as anomalous, round(avg(label), 6) as share from images group by 1""",
)
def _(spark, sf_dir):
    images = fx.cells(spark, sf_dir).groupBy("image_id").agg(F.max("mask").cast("int").alias("label"))
    named = images.withColumn("dataset", F.concat(F.lit("b"), (F.col("image_id") % 4).cast("string"), F.lit("/c"), (F.col("image_id") % 11).cast("string")))
    return rounded(sta.benchmark_table(named), "share")


@query(
    "sta19_numbers_table",
    R + MEANS + """, g as (select benchmark, avg(d) as gain, count(*) as n from diffs group by 1)
    select benchmark || '.gain' as name, round(gain, 1)::decimal(20, 1)::varchar as value from g union all select benchmark || '.n', round(n::double, 1)::decimal(20, 1)::varchar from g""",
)
def _(spark, sf_dir):
    return sta.numbers_table(sta.gain_by_benchmark(pairs(spark, sf_dir)), F.col("benchmark"), ["gain", "n"])


@query(
    "sta20_median_category",
    R + MEANS + """, m as (select dataset, split_part(dataset, '/', 1) as benchmark, mean from means where method = 'm0' and mean is not null),
    d as (select m.*, round(abs(mean - median), 9) as gap from m join (select benchmark, quantile_cont(mean, 0.5) as median from m group by 1) using (benchmark))
    select benchmark, dataset from d qualify row_number() over (partition by benchmark order by gap, dataset) = 1""",
)
def _(spark, sf_dir):
    return sta.median_category(means(spark, sf_dir).where("method = 'm0'"))


@query(
    "sta21_median_area_image",
    "with " + fx.CELLS + """, images as (select image_id, image_id % 11 as dataset, sum(mask1::int) as area from cells group by 1 having area > 0)
    select dataset, image_id, area::bigint as area from images qualify row_number() over (partition by dataset order by area, image_id) = count(*) over (partition by dataset) // 2 + 1""",
)
def _(spark, sf_dir):
    images = fx.cells(spark, sf_dir).groupBy("image_id").agg(F.sum(F.col("mask1").cast("int")).alias("area")).where("area > 0")
    return sta.median_area_image(images.withColumn("dataset", F.col("image_id") % 11))


@query(
    "sta22_top_gains",
    R + MEANS + """, g as (select dataset, split_part(dataset, '/', 1) as benchmark, max(mean) filter (method = 'm0') - max(mean) filter (method <> 'm0') as gain from means group by 1 having gain is not null),
    k as (select * from g qualify row_number() over (partition by benchmark order by round(gain, 9) desc, dataset) = 1)
    select dataset, round(gain, 6) as gain, benchmark from k order by round(gain, 9) desc, dataset limit 6""",
)
def _(spark, sf_dir):
    m = F.col("method") == "m0"
    gains = means(spark, sf_dir).groupBy("dataset").agg((F.max(F.when(m, F.col("mean"))) - F.max(F.when(~m, F.col("mean")))).alias("gain")).where("gain is not null")
    return rounded(sta.top_gain_categories(gains), "gain")


@query(
    "sta23_curve_by_n",
    R + MEANS + """, kept as (select * from by_n where not (method = 'm3' and dataset = 'view/0' and n_train = 4)),
    ok as (select method from kept group by 1 having count(*) = (select count(distinct dataset) * count(distinct n_train) from kept))
    select method, n_train, round(avg(by_n) * 100, 6) as value from kept join ok using (method) group by all""",
)
def _(spark, sf_dir):
    r = runs(spark, sf_dir).where("not (method = 'm3' and dataset = 'view/0' and n_train = 4)")
    return rounded(sta.curve_by_n(r), "value")


@query("sta24_timing_medians", R + "select n_train, method, round(quantile_cont(metric * 100, 0.5), 6) as median_ms, count(*) as images from runs group by all")
def _(spark, sf_dir):
    return rounded(sta.timing_medians(runs(spark, sf_dir).withColumn("ms", F.col("metric") * 100), ["n_train", "method"], "ms"), "median_ms")
