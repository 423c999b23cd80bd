"""Projections, filters, sampling and checks on images, patches and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_draw, l2_normalize


def sample_references(images: DataFrame, ns: Sequence[int], seeds: Sequence[int], keys: Sequence[str] = ("dataset",), path: str = "path") -> DataFrame:
    """n of each category's distinct paths for each (n, seed), by hash order; all of them for n = 0 or n >= their number."""
    rows = images.select(*keys, path).distinct().withColumn("n", F.explode(F.array(*map(F.lit, ns)))).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    order = Window.partitionBy(*keys, "n", "seed").orderBy(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col(path))), path)
    return rows.withColumn("__k", F.row_number().over(order)).where("n = 0 or __k <= n").drop("__k")


def check_draw(drawn: DataFrame, images: DataFrame, keys: Sequence[str] = ("dataset",), path: str = "path") -> DataFrame:
    """ok for each draw: its size is the smaller of n and the category's paths (all of them for n = 0)."""
    have = images.groupBy(*keys).agg(F.count_distinct(path).alias("have"))
    got = drawn.groupBy(*keys, "n", "seed").agg(F.count("*").alias("got"))
    need = F.when(F.col("n") == 0, F.col("have")).otherwise(F.least("n", "have"))
    return got.join(have, list(keys)).select(*keys, "n", "seed", "got", (F.col("got") == need).alias("ok"))


def leakage(train: DataFrame, test: DataFrame, path: str = "path") -> DataFrame:
    """Paths in both sets."""
    return train.select(path).intersect(test.select(path))


def cap_rows(df: DataFrame, key: Sequence[str], limit: int, seed: int, row_id: str) -> DataFrame:
    """At most limit rows of each key, those of the least seeded hash: a seeded draw without replacement.

    Draws are counted in 4096 ranges of hash values. Ranges that fit whole are kept as they are; only the one that the
    limit cuts is ranked, so no key is sorted whole."""
    key = list(key)
    drawn = df.withColumn("__draw", hash_draw(F.lit(seed), F.col(row_id))).withColumn("__range", F.shiftright("__draw", 20).cast("int"))
    sizes = drawn.groupBy(*key, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    wanted = sizes.withColumn("__room", F.lit(limit) - before).where("__room > 0").withColumnsRenamed({c: f"__of_{c}" for c in (*key, "__range")})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*key, "__range")]
    kept = drawn.join(wanted, same).select(*drawn.columns, "__n", "__room")
    order = Window.partitionBy(*key, "__range").orderBy("__draw", row_id)
    ranked = kept.where("__n > __room").withColumn("__k", F.row_number().over(order)).where("__k <= __room")
    return kept.where("__n <= __room").select(df.columns).unionByName(ranked.select(df.columns))


def normalized(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, l2_normalize(F.col(vec)))


def mean_vector(df: DataFrame, keys: Sequence[str], size: int, vec: str = "vec") -> DataFrame:
    """Mean of a vector column by key; one sum for each coordinate, so partial sums meet before the shuffle."""
    means = [F.avg(F.get(F.col(vec), i)) for i in range(size)]
    return df.groupBy(*keys).agg(F.array(*means).alias("mean_vec"))


def center_by(df: DataFrame, keys: Sequence[str], size: int, vec: str = "vec") -> DataFrame:
    """Vectors minus their group's mean vector."""
    joined = df.join(mean_vector(df, keys, size, vec), list(keys))
    return joined.withColumn(vec, F.zip_with(vec, "mean_vec", lambda a, b: a - b)).drop("mean_vec")


def neighbour_mean(patches: DataFrame, size: int, keys: Sequence[str] = ("image_id", "layer"), vec: str = "vec") -> DataFrame:
    """Mean vector of the 3 x 3 patches around each place, of those that exist."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("m")
    sent = patches.select(*keys, "gy", "gx", vec, moves).select(*keys, (F.col("gy") + F.col("m.dy")).alias("gy"), (F.col("gx") + F.col("m.dx")).alias("gx"), vec)
    made = mean_vector(sent, [*keys, "gy", "gx"], size, vec).withColumnRenamed("mean_vec", vec)
    return made.join(patches.select(*keys, "gy", "gx"), [*keys, "gy", "gx"], "left_semi")


def band_mean(patches: DataFrame, layers: Sequence[str], size: int, keys: Sequence[str] = ("image_id", "gy", "gx"), vec: str = "vec") -> DataFrame:
    return mean_vector(patches.where(F.col("layer").isin(*layers)), keys, size, vec).withColumnRenamed("mean_vec", vec)


def condition_of(path: Column) -> Column:
    """'shift' where the name holds it, else the stem without its leading number."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(F.contains(stem, F.lit("shift")), "shift").otherwise(F.regexp_replace(stem, r"^\d+_", ""))


def kind_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("logical")), "logical").when(F.contains(path, F.lit("structural")), "structural").otherwise("good")


def parse_variant(name: Column) -> Column:
    """Fields of names k{K}[s{kappa}|lw][v][_{views}][_d{D}][_skip{S}][_ppca][_diag]; defaults 0, 256 and rot8."""
    part = lambda p, g=1: F.nullif(F.regexp_extract(name, p, g), F.lit(""))
    return F.struct(
        part(r"^k(\d+)").cast("int").alias("k"),
        F.coalesce(part(r"^k\d+s(\d+)").cast("double"), F.lit(0.0)).alias("kappa"),
        name.rlike(r"^k\d+lw").alias("ledoit_wolf"),
        name.rlike(r"^k\d+(s\d+|lw)?v").alias("whiten"),
        F.coalesce(part(r"_(rot\d+|none|small)(_|$)"), F.lit("rot8")).alias("views"),
        F.coalesce(part(r"_d(\d+)").cast("int"), F.lit(256)).alias("d"),
        F.coalesce(part(r"_skip(\d+)").cast("int"), F.lit(0)).alias("skip"),
        name.rlike(r"_ppca(_|$)").alias("ppca"),
        name.rlike(r"_diag(_|$)").alias("diag"),
    )


def validate_metrics(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Metric values that are no number of 0 .. 1, one row each; nulls are no offence."""
    long = runs.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m"))
    return long.select(*keys, F.col("m.name").alias("metric"), F.col("m.v").alias("value")).where("value is not null and (isnan(value) or value < 0 or value > 1)")


def non_square(images: DataFrame) -> DataFrame:
    """Images of the categories that hold an image of unequal sides."""
    keep = images.groupBy("dataset").agg(F.max((F.col("h") != F.col("w")).cast("int")).alias("any")).where("any = 1")
    return images.join(keep.select("dataset"), "dataset", "left_semi")


def masking_applies(dataset: Column, benchmark: str, categories: Sequence[str]) -> Column:
    """Every category of one benchmark, and the listed ones of others."""
    return (F.split_part(dataset, F.lit("/"), F.lit(1)) == benchmark) | dataset.isin(*categories)


def merge_variant(variants: DataFrame, overrides: DataFrame, base: Mapping[str, float], name: str = "variant") -> DataFrame:
    """Configuration of composed variants 'a+b': the overrides of the parts in their order, on top of the base."""
    parts = variants.select(name, F.posexplode(F.split(name, r"\+")).alias("pos", "part")).join(overrides, F.col("part") == overrides["override"])
    last = parts.groupBy(name, "field").agg(F.max_by("value", "pos").alias("value"))
    wide = last.groupBy(name).pivot("field", list(base)).agg(F.max("value"))
    joined = variants.select(name).distinct().join(wide, name, "left")
    return joined.select(name, *[F.coalesce(F.col(f), F.lit(v)).alias(f) for f, v in base.items()])
