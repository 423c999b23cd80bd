"""Line dedup by distinct-site spread.

Every line that holds a word is known by two 64-bit hashes. One aggregation by line merges a HyperLogLog
sketch of the sites it stands on; a line on clearly more than min_sites sites is boilerplate, and where the estimate is
within `margin` of the threshold (at least four standard errors of the sketch) the distinct sites are counted exactly. Of a
boilerplate line the first occurrence (least identifier, then position) stays and all others go, so a passage that is
copied across sites is kept once. Lines of no more than short_chars characters may be given a threshold of their own
(short_sites), as a short sentence of prose can repeat by chance; by default all lines are alike.

Sketches, minima, counts and distinct (line, site) pairs are combined before the shuffle, so a line that stands in a third
of all documents is no hot key there. Occurrences are marked in two ways: lines that make up more than a quarter of a
shuffle partition (of these there are at most four for each partition, whatever the corpus) are broadcast, and their
occurrences stay where they are; all others meet by their hashes.

Defined cases: a null text stays null, an empty one empty; a null site is no site; a null identifier sorts first; rows of
equal identifier and text are one row for "first" and are cleaned alike; an empty table gives no rows; further columns
pass only where the caller names them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, shared_dir


def remove_spread_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5, short_chars: int = 0, short_sites: int = 5, margin: float = 0.2, lg_k: int = 12, carry: list[str] | None = None, prefix: str = ""
) -> DataFrame:
    """The columns in carry (the id column), n_lines and n_removed (long, their names after the
    prefix), and the text column without spread lines."""
    carry = [c for c in ([id_col] if carry is None else carry) if c not in (f"{prefix}n_lines", f"{prefix}n_removed", text_col)]
    text = docs[text_col].cast("string")
    rows = docs.select(*[docs[c].alias(f"__{c}") for c in carry], docs[id_col].alias("id"), text.alias("text"), docs[site_col].cast("string").alias("site"))
    rows = rows.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit("row"), "text", "id")})
    lines = rows.select("id", "site", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    lines = lines.select("id", "site", "k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), (F.char_length("line") <= short_chars).alias("short"))

    folder = shared_dir(docs.sparkSession)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
        F.count("*").alias("n"),
        F.min(F.struct(F.col("id").isNotNull(), "id", "k1", "k2", "pos")).alias("first"),
        F.when(F.first("short"), short_sites).otherwise(min_sites).alias("needed"),
    )
    margin = max(margin, 4 * 1.04 / 2 ** (lg_k / 2))
    candidates = materialize(spread.where(F.col("sites") >= F.col("needed") * (1 - margin)), "spread-candidates", folder)
    near = candidates.where(F.col("sites") <= F.col("needed") * (1 + margin)).select("h1", "h2")
    pairs = lines.where("site is not null").groupBy("h1", "h2", "site").count()
    exact = pairs.join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    # A line near the threshold without any site has no pair.
    known = F.when(F.col("sites") > F.col("needed") * (1 + margin), F.col("sites")).otherwise(F.coalesce("exact", F.lit(0)))
    spread = materialize(candidates.join(exact, ["h1", "h2"], "left").where(known >= F.col("needed")).select("h1", "h2", "n", "first"), "spread-lines", folder)

    drop_table(candidates)

    # At most 4 rows a partition are hot: their occurrences are at least a quarter of the mean partition each.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lines.groupBy().agg((F.count("*") / (4 * parts)).alias("hot"))
    sized = spread.join(F.broadcast(total)).withColumn("is_hot", F.col("n") > F.col("hot")).drop("n", "hot")
    hot, cold = (sized.where(c).drop("is_hot") for c in ("is_hot", "not is_hot"))
    cool = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    marked = lines.join(F.broadcast(hot), ["h1", "h2"]).unionByName(cool.join(cold, ["h1", "h2"]))
    marked = marked.where("not (k1 = first.k1 and k2 = first.k2 and pos = first.pos)")
    removed = marked.groupBy("k1", "k2").agg(F.collect_set("pos").alias("removed"))
    joined = rows.join(removed, ["k1", "k2"], "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("removed", i))
    return joined.select(
        *[F.col(f"__{c}").alias(c) for c in carry],
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))), F.lit(0)).cast("long").alias(f"{prefix}n_lines"),
        F.coalesce(F.when(F.col("removed").isNotNull(), F.size("removed")), F.lit(0)).cast("long").alias(f"{prefix}n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
    )


#: What remove_spread_lines gives with its own parameters on documents.
SQL = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null
), spread as (
  select line, min({'d': doc_id, 'p': pos}) as first_at from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  group by line having count(distinct source) >= 5
), marked as (
  select l.doc_id, l.pos, l.line, (s.line is not null and {'d': l.doc_id, 'p': l.pos} <> s.first_at) as gone
  from lines l left join spread s on l.line = s.line
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_removed,
       coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text
from marked group by doc_id
"""
