"""The corpus pipeline: quality classifier, quality rules, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents, whatever further ones these have. Between stages the rows are written to the shared folder as Parquet and read
again.

Defined cases, for every stage: an empty table gives no rows; a null identifier, language or source is a value like any
other; rows that repeat wholly are rows each for itself, but for near_duplicates, which keeps one of them; a null text is
an empty one for every decision and stays null where it stays. What each stage does with texts without a word is said
there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlane.llm import jaccard, line_crf, line_dedup, packing, quality_rules
from patchlane.llm.common import materialize, shared_dir
from patchlane.llm.queries import table, tokenizer
from patchlane.plans.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, trained on the labelled ones, finds good (a score of at least 0.5). Texts without a word
    score 0 and go; where one of the labels has no row at all, every other text stays."""
    ship_package(spark)
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score(docs, model, carry=docs.columns, names=("__score", "__predicted"))
    return scored.where("__predicted = 1").select(docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and stay near their language's distributions. Texts of fewer than ten words go."""
    ship_package(spark)
    judged = quality_rules.judge(docs, quality_rules.references(docs), carry=docs.columns, prefix="__rule_")
    return judged.where("__rule_kept").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; n_chars follows the text. A text that loses all its lines
    stays as an empty one, a null text stays null."""
    ship_package(spark)
    cleaned = line_dedup.remove_spread_lines(docs, carry=docs.columns, prefix="__line_")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links join: that of the least identifier (null last), then of the
    least text hash; of rows that are equal in both, one. Texts without a word all stay."""
    ship_package(spark)
    return jaccard.keep_one(docs, n=5, numerator=75, denominator=100)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a text without a word is its end token."""
    ship_package(spark)
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("retrieval_packing", retrieval_packing),
]
#: No SQL says these stages (trained, iterative); tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
