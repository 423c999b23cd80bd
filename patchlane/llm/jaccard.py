"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. All shingles of all rows are counted. The most frequent ones, at most `ranked` of them, are broadcast with their counts.
   They give the global order: shingles outside the table first, then rising counts.
2. Each set's prefix (size - ceil(0.75 size) + 1 shingles in that order) is kept, one for each distinct set: equal sets
   are one node from here on. Two sets that link share a shingle of both prefixes.
3. Prefixes are joined on their shingles in rounds. Nodes stand in the order of a min-wise hash of their sets (a mark),
   another one in each round, so that like sets stand side by side. In a linear round each component of nodes (at first,
   each node) sends one node of each mark to a shingle, and this meets the one before it and the first one of its mark.
   Of the pairs that pass the length, positional and suffix filters each component has the few verified that share most
   prefix shingles, and components that link become one. Rounds go on while they find links in proportion to what is left,
   each with more partners, so that a group of near copies is one component, or few, after them.
4. Then, exactly, every pair of nodes of different components that shares a prefix shingle and passes the filters is a
   candidate. Where these are more than the nodes, each component has its most alike ones verified in turns, a few at first
   and eight times as many each time; components that link become one, and candidates inside one go. No more candidates
   than nodes are verified at once. No pair is verified twice. Work here is linear in what links; like texts that just fail
   to link are compared pair by pair, as nothing else rules them out.
5. Verification intersects the whole shingle sets, made once from the text of each node that is in a pair.

Postings of frequent shingles are salted by their counts, so no task gets a hot shingle whole. Tables in the shared folder
are deleted as soon as nothing reads them any more."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunkcodec import HashTable, ragged
from .common import array_slices, compute_columns, drop_table, materialize, shared_dir
from .components import as_edges, nodes_of, settle
from .counts import most_frequent, range_counts
from .shingles import Sets

PARITY_BITS = 2048
#: Bits of the coarser sketch that the exact step's postings carry.
COARSE_BITS = 512
#: Min-wise marks of a node, taken in turn.
MARKS = 3
#: Pairs that a component verifies in the first linear round, and by how much more in each further one; they bound no result,
#: only what is left to the exact step.
PARTNERS, MORE_PARTNERS = 2, 4
#: Linear rounds go on as long as they find a link for each so many components that are left.
WORTHWHILE = 50
#: Pairs that each component takes first in the exact step, if there are more candidates than nodes; each further turn takes
#: eight times as many.
FIRST_PAIRS = 8
#: Nodes of one shingle that one task takes, about.
SALT_ROWS = 4096


class Ranks:
    """Rank (1..255, by sixths of a doubling) of frequent shingles, 0 for others."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.table = HashTable(max(len(grams), 1))
        self.table.add(grams)
        self.rank = np.r_[np.clip(np.log2(np.maximum(counts, 2)) * 6, 1, 255).astype(np.uint8), np.uint8(0)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return self.rank[self.table.find(h)]


def frequent_shingles(docs: DataFrame, text_col: str, n: int, ranked: int, folder: str | None = None) -> Ranks:
    """Ranks of the most frequent shingles, counted over all rows of docs."""

    def count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        return *np.unique(np.concatenate([np.zeros(0, np.uint64), *[Sets(part, n).hash for part in array_slices(texts)]]), return_counts=True), []

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = materialize(range_counts(texts, count, 3).where("part >= 0").select("hash", "n"), "shingle-counts", folder)  # rarer ones are all alike
    grams, counts = most_frequent(counted, ranked)
    drop_table(counted)
    return Ranks(grams, counts)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The id column, n_shingles (long) and component_id: the least identifier that links lead to, itself included.

    options are those of classes(). Defined cases: rows without words have no shingle and link with nothing; a null
    identifier counts only where a component has no other; rows of one identifier are rows like any others; an empty table
    gives no rows; further columns are not read."""
    members = classes(docs, id_col, text_col, **options)
    least = members.where("class is not null").groupBy("class").agg(F.min("id").alias("component_id"))
    own = members.join(least, "class", "left")
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs without near copies: of each class the row of the least identifier (null last), then text hash;
    of wholly equal rows one. Rows without words all stay."""
    members = classes(docs, id_col, text_col, **options).where("class is not null")
    first = members.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.text_hash").alias("__hash"))
    worded = F.coalesce(F.col(text_col).cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = docs.where(worded).withColumn("__own", F.xxhash64(F.col(text_col).cast("string")))
    kept = rows.join(first, (F.col("__own") == F.col("__hash")) & F.col(id_col).eqNullSafe(F.col("__id"))).dropDuplicates(["__hash", "__id"])
    return kept.select(docs.columns).unionByName(docs.where(~worded))


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, numerator: int = 75, denominator: int = 100, ranked: int = 1 << 20
) -> DataFrame:
    """id, text_hash, n (shingles) and class (of linked rows; null without shingles) of every row.

    Two rows link when denominator * |A and B| >= numerator * |A or B| for their sets A and B of n-word shingles."""
    if not 0 < 2 * numerator <= 2 * denominator:
        raise ValueError("the similarity must be above 0 and at most 1")
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(frequent_shingles(docs, text_col, n, ranked, folder))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    long = T.LongType()

    def prefixes(texts: pa.Array) -> list:
        sets = Sets(texts, n, ranks.value)
        s1, s2 = sets.signatures()
        keep = np.where(sets.size > 0, sets.size - -(-sets.size * numerator // denominator) + 1, 0)
        _, first = np.unique(np.stack([s1, s2]), axis=1, return_index=True)
        again = np.ones(len(keep), bool)
        again[first] = False  # of equal sets of a slice, one brings its prefix
        keep = np.where(again, 0, keep)
        ends = np.r_[0, np.cumsum(keep)].astype(np.int32)
        grams = sets.hash[ragged(sets.first[:-1], keep)]
        salts = np.maximum(2.0 ** (ranks.value(grams).astype(float) / 6) / SALT_ROWS, 1).astype(np.int64)
        parity = sets.parity(PARITY_BITS)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (grams.view(np.int64), salts.astype(np.int32))]
        shape = pa.ListArray.from_arrays(pa.array(np.arange(0, parity.size + 1, PARITY_BITS // 64, dtype=np.int32)), pa.array(parity.ravel()))
        marks = pa.ListArray.from_arrays(pa.array(np.arange(0, len(s1) * MARKS + 1, MARKS, dtype=np.int32)), pa.array(sets.marks(MARKS).ravel()))
        return [sets.size.astype(np.int64), s1, s2, *lists, shape, marks]

    fields = [T.StructField(c, long) for c in ("n", "s1", "s2")] + [T.StructField("grams", T.ArrayType(long)), T.StructField("salts", T.ArrayType(T.IntegerType())), T.StructField("parity", T.ArrayType(long)), T.StructField("marks", T.ArrayType(T.IntegerType()))]
    sets = materialize(compute_columns(source, "text", ["id", "text_hash"], fields, prefixes), "sets", folder)
    brought = sets.where("n > 0 and size(grams) > 0")
    nodes = materialize(brought.dropDuplicates(["s1", "s2"]).select(F.monotonically_increasing_id().alias("node"), "id", "text_hash", "s1", "s2", "n", "grams", "salts", "parity", "marks"), "nodes", folder)
    rows = materialize(sets.select("id", "text_hash", "n", "s1", "s2"), "rows", folder)
    drop_table(sets)

    def required(a: str, b: str) -> str:
        """The pair's least intersection, times (numerator + denominator): i * (num + den) >= num * (|A| + |B|)."""
        return f"{numerator} * ({a}n + {b}n)"

    def may_link(a: str, b: str) -> str:
        """Length and positional filter at a shared prefix shingle."""
        return (
            f"{denominator} * least({a}n, {b}n) >= {numerator} * greatest({a}n, {b}n)"
            f" and {numerator + denominator} * (1 + least({a}n - {a}pos, {b}n - {b}pos) - 1) >= {required(a, b)}"
        )

    def suffix_filter(a: str, b: str, both: Column) -> Column:
        """Whether the shingles that are not shared, at least as many as ranges of different parity, are few enough."""
        apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return (numerator + denominator) * (both - apart) >= 2 * numerator * both

    def meet(units: DataFrame, own: str, columns: list[str], order: list[Column]) -> DataFrame:
        """Postings of units `own` beside the one before it among its shingle's (in its salt) and the first one of its mark."""
        ordered, me = Window.partitionBy("gram", "salt").orderBy("mark", *order), F.struct(*columns)
        alike = Window.partitionBy("gram", "salt", "mark").orderBy(*order)
        salted = units.withColumn("salt", F.pmod(F.hash(own), "salts"))
        return salted.withColumns({"before": F.lag(me).over(ordered), "head": F.first(me).over(alike), "place": F.row_number().over(ordered), "among": F.count("*").over(Window.partitionBy("gram", "salt"))})

    def partners(met: DataFrame, own: str, columns: list[str], order: list[Column], few: int) -> DataFrame:
        """Distinct pairs (a, b) of nodes: of each unit the few others it shares most prefix shingles with."""
        me = F.struct(*columns)
        across = met.where("salts > 1 and place = 1").withColumn("before", F.lag(me).over(Window.partitionBy("gram").orderBy("mark", *order)))  # a row for each salt
        found = None
        for part, other in ((met, "before"), (met, "head"), (across, "before")):
            rows = part.where(f"{other}.{own} != {own}").select(me.alias("p"), F.col(other).alias("q")).where(may_link("p.", "q."))
            if "coarse" in columns:
                rows = rows.where(suffix_filter("p.coarse", "q.coarse", F.col("p.n") + F.col("q.n")))
            rows = rows.select(F.col(f"p.{own}").alias("unit"), F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
            found = rows if found is None else found.unionByName(rows)
        best = Window.partitionBy("unit").orderBy(F.desc("count"), "a", "b")
        counted = found.groupBy("unit", "a", "b").count().withColumn("k", F.row_number().over(best))
        return untested(counted.where(F.col("k") <= few).select("a", "b").distinct())

    tested: list[DataFrame] = []  # pairs (a, b) that were taken so far
    whole: list[DataFrame] = []  # whole sets (node, set) that were made so far

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs.join(functools.reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti") if tested else pairs

    exploded = nodes.select("node", "n", F.get("marks", 0).alias("mark"), F.posexplode(F.arrays_zip("grams", "salts")).alias("pos", "g"))
    postings = exploded.select(F.col("g.grams").alias("gram"), F.col("g.salts").alias("salts"), "node", "n", "pos", "mark")
    first = ("node", ["node", "n", "pos"], [F.col("n"), F.col("node")])
    # A shingle of one node makes no pair; of a salted one, other salts may hold more nodes.
    shared = materialize(meet(postings, *first).where("among > 1 or salts > 1").drop("salt", "among"), "shared", folder)
    attributes = materialize(nodes.drop("grams", "salts"), "attributes", folder)
    drop_table(nodes)

    def make_sets(wanted: DataFrame, name: str) -> None:
        """Add the whole sets of the nodes in wanted that have none yet."""
        for done in whole:
            wanted = wanted.join(done.select("node"), "node", "left_anti")
        wanted = materialize(attributes.join(wanted, "node").select("node", "id", "text_hash", "s1", "s2"), f"wanted-{name}", folder)

        def sets_of(texts: pa.Array) -> list:
            made = Sets(texts, n)
            s1, s2 = made.signatures()
            _, first = np.unique(np.stack([s1, s2]), axis=1, return_index=True)
            mark = np.zeros(len(s1), bool)
            mark[first] = True
            size = np.where(mark, made.size, 0)
            ends = np.r_[0, np.cumsum(size)].astype(np.int32)
            return [s1, s2, pa.ListArray.from_arrays(pa.array(ends), pa.array(made.hash[ragged(made.first[:-1], size)].view(np.int64)))]

        # The row that brought the node, found by its identifier and text; rows that repeat wholly make one set.
        keys = wanted.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
        texts = source.join(keys, (F.col("text_hash") == F.col("__hash")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
        made = compute_columns(texts, "text", [], [T.StructField("s1", long), T.StructField("s2", long), T.StructField("set", T.ArrayType(long))], sets_of)
        own = made.where("size(set) > 0").join(wanted.select("node", "s1", "s2"), ["s1", "s2"]).dropDuplicates(["node"]).select("node", "set")
        whole.append(materialize(own, f"whole-{name}", folder))
        drop_table(wanted)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (a, b), those that link."""
        pairs = materialize(pairs, f"pairs-{name}", folder)
        tested.append(pairs)
        if pairs.isEmpty():
            return pairs
        left, right = (attributes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity")) for c in "ab")
        close = pairs.join(left, "a").join(right, "b").where(suffix_filter("a_parity", "b_parity", F.col("a_n") + F.col("b_n")))
        close = materialize(close.select("a", "b", "a_n", "b_n"), f"close-{name}", folder)
        make_sets(close.select(F.col("a").alias("node")).union(close.select(F.col("b").alias("node"))).distinct(), name)
        own = whole[0]
        for more in whole[1:]:
            own = own.unionByName(more)
        both = close.join(own.select(F.col("node").alias("a"), F.col("set").alias("a_set")), "a").join(own.select(F.col("node").alias("b"), F.col("set").alias("b_set")), "b")
        common = F.size(F.array_intersect("a_set", "b_set"))
        links = materialize(both.where((numerator + denominator) * common >= numerator * (F.col("a_n") + F.col("b_n"))).select("a", "b"), f"links-{name}", folder)
        drop_table(close)
        return links

    edges: DataFrame | None = None  # all links found so far, as a star for each component: u > v

    def draw_together(links: DataFrame, name: str) -> None:
        nonlocal edges
        if edges is not None and links.isEmpty():
            return
        new, old = as_edges(links), edges
        edges = settle(new if old is None else new.unionByName(old), f"stars-{name}", folder)
        if old is not None:
            drop_table(old)

    def component_of(rows: DataFrame, end: str, name: str) -> DataFrame:
        """rows with the component of node `end`."""
        return rows.join(edges.select("u", F.col("v").alias(name)), F.col(end) == F.col("u"), "left").drop("u").withColumn(name, F.coalesce(name, end))

    def spread(postings: DataFrame, name: str, sketches: DataFrame | None = None) -> DataFrame:
        """Postings of the shingles whose nodes are of several components, with the commonest one and the node's sketch."""
        held = ["gram", "salts", "node", "n", "pos", *([] if sketches is not None else ["coarse", "marks"])]
        posted = component_of(postings.select(held), "node", "component")
        posted = materialize(posted, f"posted-{name}", folder)
        drop_table(postings)
        sizes = posted.groupBy("gram", "component").count()
        main = sizes.groupBy("gram").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("components"))
        several = posted.join(main.where("components > 1").select("gram", "main"), "gram")
        several = materialize(several if sketches is None else several.join(sketches, "node"), f"several-{name}", folder)
        drop_table(posted)
        return several

    draw_together(verified(partners(shared, *first, PARTNERS), "0"), "0")
    # The suffix filter stands in the joins from here on, on sketches whose ranges are joined (parities add up by xor).
    words = PARITY_BITS // 64
    folded = F.array(*[functools.reduce(Column.bitwiseXOR, [F.get("parity", i) for i in range(k, words, COARSE_BITS // 64)]) for k in range(COARSE_BITS // 64)])
    active = spread(shared, "0", attributes.select("node", folded.alias("coarse"), "marks"))
    k = 0
    while not active.isEmpty():
        k += 1
        # Each component sends one node of each mark to each shingle.
        columns = ["component", "node", "n", "pos", "coarse"]
        chosen = F.min_by(F.struct(*columns[1:]), F.struct(F.xxhash64(F.lit(k), "node", "gram"), "node"))
        units = active.groupBy("gram", "component", F.get("marks", k % MARKS).alias("mark")).agg(F.first("salts").alias("salts"), F.first("main").alias("main"), chosen.alias("c"))
        later = ("component", columns, [F.col("component") != F.col("main"), F.col("n"), F.col("component")])
        links = verified(partners(meet(units.select("gram", "salts", "main", "component", "mark", "c.*"), *later), *later, PARTNERS * MORE_PARTNERS**k), str(k))
        if links.isEmpty():
            break
        left = active.select("component").distinct().count()
        draw_together(links, str(k))
        active = spread(active, str(k))
        if links.count() * WORTHWHILE < left:
            break

    if not active.isEmpty():
        # All pairs across components. A side outside the commonest component goes to each salt of the other side.
        me = F.struct("node", "n", "pos", "component", "coarse")
        p = active.where("component != main").select("gram", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), me.alias("p"))
        q = active.select("gram", F.pmod(F.hash("node"), "salts").alias("salt"), me.alias("q"), (F.col("component") == F.col("main")).alias("is_main"))
        rest = p.join(q, ["gram", "salt"]).where("p.component != q.component and (is_main or p.node < q.node)").where(may_link("p.", "q."))
        rest = rest.where(suffix_filter("p.coarse", "q.coarse", F.col("p.n") + F.col("q.n")))
        a, b = F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")
        rest = rest.select(a, b, F.least("p.component", "q.component").alias("c"), F.greatest("p.component", "q.component").alias("d"))
        rest = materialize(untested(rest.groupBy("a", "b", "c", "d").count()), "candidates", folder)
        turn, few = 0, attributes.count()
        while left_over := rest.count():
            leading = rest.select("a", "b")
            if left_over > few:
                ends = rest.select("a", "b", "count", F.explode(F.array("c", "d")).alias("own"))
                best = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("count"), "a", "b"))
                leading = ends.withColumn("k", best).where(F.col("k") <= FIRST_PAIRS << 3 * turn).select("a", "b").distinct()
            draw_together(verified(leading, f"turn-{turn}"), f"turn-{turn}")
            if left_over <= few:
                break
            left = rest.select("a", "b", "count").join(tested[-1], ["a", "b"], "left_anti")
            before, rest = rest, materialize(component_of(component_of(left, "a", "c"), "b", "d").where("c != d"), f"rest-{turn}", folder)
            drop_table(before)
            turn += 1
        drop_table(rest)

    found = nodes_of(edges)
    of_node = attributes.select("node", "s1", "s2").join(found, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("class"))
    members = materialize(rows.join(of_node, ["s1", "s2"], "left").select("id", "text_hash", "n", "class"), "members", folder)
    for done in (active, attributes, rows, edges, *tested, *whole):
        drop_table(done)
    return members
