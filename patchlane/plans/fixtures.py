"""Views of the given tables that stand in for images, patch features, score grids and experiment results.

Each view is a DataFrame function and the SQL text of the same view, for the SQL side of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_H, GRID_W = 50, 11
NS = (1, 2, 4, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole images only: vec_id, image_id, label, embedding."""
    rows = table(spark, sf_dir, "embeddings").withColumn("image_id", F.expr("vec_id div 16"))
    n = rows.agg(F.expr("count(*) div 16").alias("images"))
    return rows.join(F.broadcast(n), F.col("image_id") < F.col("images")).drop("images")


VECTORS = """
vectors as (select vec_id, vec_id // 16 as image_id, label, embedding from embeddings where vec_id // 16 < (select count(*) // 16 from embeddings))
"""

PATCHES = VECTORS + """,
patches as (
  select image_id, layer, ((vec_id % 16) // 4)::int as gy, (vec_id % 4)::int as gx, (label = 9 and image_id % 2 = 1) as mask, image_id % 4 = 0 as is_ref, label,
         case layer when 'a' then embedding[1:32]::double[] else embedding[33:64]::double[] end as vec
  from vectors cross join (values ('a'), ('b')) l(layer))
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense grids: image_id, y, x, value, value_b, mask, mask1."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_quantity").cast("int") - 1).alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x"), "l_extendedprice", "l_discount", "l_returnflag"
    )
    found = items.groupBy("image_id", "y", "x").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("value"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("value_b"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("nr")
    )
    # Joined, not exploded: Spark takes an exploded grid to be no larger than its images, and broadcasts all its cells.
    places = spark.range(0, GRID_H * GRID_W, 1, 1).select(F.expr(f"cast(id div {GRID_W} as int)").alias("y"), (F.col("id") % GRID_W).cast("int").alias("x"))
    grid = items.select("image_id").distinct().crossJoin(F.broadcast(places))
    marked = F.col("image_id") % 3 == 0
    nr = F.coalesce("nr", F.lit(0))
    return grid.join(found, ["image_id", "y", "x"], "left").select(
        "image_id", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("value_b", F.lit(0.0)).alias("value_b"), (marked & (nr >= 2)).alias("mask"), (marked & (nr >= 1)).alias("mask1")
    )


CELLS = f"""
found as (
  select l_suppkey as image_id, cast(l_quantity as int) - 1 as y, cast(round(l_discount * 100) as int) as x, round(sum(l_extendedprice), 2) as value,
         round(sum(l_extendedprice * (1 - l_discount)), 4) as value_b, sum(case when l_returnflag = 'R' then 1 else 0 end) as nr
  from lineitem group by 1, 2, 3),
cells as (
  select i.image_id, gy.y::int as y, gx.x::int as x, coalesce(value, 0)::double as value, coalesce(value_b, 0)::double as value_b,
         (i.image_id % 3 = 0 and coalesce(nr, 0) >= 2) as mask, (i.image_id % 3 = 0 and coalesce(nr, 0) >= 1) as mask1
  from (select distinct l_suppkey as image_id from lineitem) i cross join range({GRID_H}) gy(y) cross join range({GRID_W}) gx(x)
  left join found f on f.image_id = i.image_id and f.y = gy.y and f.x = gx.x)
"""


def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id")
    kind = F.when(F.col("source").isin("src0", "src1", "src2"), "logical").otherwise("structural")
    return joined.select(F.col("doc_id").alias("image_id"), F.col("lang").alias("dataset"), F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("score"), kind.alias("kind"), F.col("source"))


IMAGE_SCORES = """
image_scores as (
  select d.doc_id as image_id, d.lang as dataset, l.toxic as label, d.n_chars::double as score,
         case when d.source in ('src0', 'src1', 'src2') then 'logical' else 'structural' end as kind, d.source
  from documents d join labels l on d.doc_id = l.doc_id)
"""


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, method, n_train, seed, metric, ord; keys repeat."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("/", "event_type", (F.col("user_id") % 11).cast("string")).alias("dataset"),
        F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("method"),
        F.element_at(F.array(*map(F.lit, NS)), F.expr("cast((event_id div 4) % 4 + 1 as int)")).alias("n_train"),
        F.expr("cast((event_id div 16) % 5 as int)").alias("seed"),
        (F.col("value") / 500).alias("metric"),
        F.col("event_id").alias("ord"),
    )


RAW_RUNS = """
raw_runs as (
  select event_type || '/' || (user_id % 11) as dataset, 'm' || (event_id % 4) as method, ([1, 2, 4, 5])[(event_id // 4) % 4 + 1]::int as n_train,
         ((event_id // 16) % 5)::int as seed, value / 500 as metric, event_id as ord
  from events)
"""
RUNS = RAW_RUNS + """,
runs as (
  select dataset, method, n_train, seed, metric, ord from raw_runs
  qualify row_number() over (partition by dataset, method, n_train, seed order by ord desc) = 1)
"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of images, masks and other files, one or two for each page."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        """explode(filter(array(
          concat('ds', page_id % 3, '/cat', page_id % 2, case page_id % 4 when 0 then '/train/good/' when 1 then '/test/good/' when 2 then '/test/scratch/' else '/test/hole/' end,
                 page_id, case when page_id % 17 = 5 then '.txt' when page_id % 3 = 0 then '.PNG' else '.jpg' end),
          case when page_id % 4 in (2, 3) and page_id % 5 <> 0 and page_id % 7 <> 3
               then concat('ds', page_id % 3, '/cat', page_id % 2, '/ground_truth/', case page_id % 4 when 2 then 'scratch/' else 'hole/' end, page_id, '.png') end,
          case when page_id % 4 in (2, 3) and page_id % 7 in (2, 3)
               then concat('ds', page_id % 3, '/cat', page_id % 2, '/ground_truth/', case page_id % 4 when 2 then 'scratch/' else 'hole/' end, page_id, '_mask.png') end
        ), p -> p is not null)) as path""",
    ).select("path")


PATHS = """
paths as (
  select path from (
    select 'ds' || (page_id % 3) || '/cat' || (page_id % 2) || case page_id % 4 when 0 then '/train/good/' when 1 then '/test/good/' when 2 then '/test/scratch/' else '/test/hole/' end
           || page_id || case when page_id % 17 = 5 then '.txt' when page_id % 3 = 0 then '.PNG' else '.jpg' end as path from pages
    union all
    select 'ds' || (page_id % 3) || '/cat' || (page_id % 2) || '/ground_truth/' || case page_id % 4 when 2 then 'scratch/' else 'hole/' end || page_id || '.png' from pages
    where page_id % 4 in (2, 3) and page_id % 5 <> 0 and page_id % 7 <> 3
    union all
    select 'ds' || (page_id % 3) || '/cat' || (page_id % 2) || '/ground_truth/' || case page_id % 4 when 2 then 'scratch/' else 'hole/' end || page_id || '_mask.png' from pages
    where page_id % 4 in (2, 3) and page_id % 7 in (2, 3)))
"""
