"""The numbered queries of the training-data operators over the given tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogue, host_reputation, html_text, jaccard, language, line_crf, line_dedup, media, packing, quality_rules, spelling, sstable, wordbpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's vocabulary file; it is the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.is_held_out())
    model = line_crf.train(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return line_crf.score(docs, model, carry=["doc_id", "held_out"])


def op2_block_rules_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_and_read(spark, table(spark, sf_dir, "documents")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), n=5, numerator=75, denominator=100)


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.references(docs))


def op6_distinct_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_spread_lines(table(spark, sf_dir, "documents"))


def op7_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wordbpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sstable.store_and_read(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.is_held_out())
    model = language.train(docs.where("not held_out"))
    return language.identify(docs, model, carry=["doc_id", "held_out"])


def op11_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the row with the page's number."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return host_reputation.judge(pages, labels, host_reputation.RULES).withColumn("good_bound", F.round("good_bound", 6))


def op12_pivotal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents"), min_chars=6)
    return spelling.variants(spelling.vocabulary(spelling.drop_some(found, every=199), min_chars=6, min_count=5))


def op13_persistent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.audit(dialogue.damage(table(spark, sf_dir, "conversations")), dropped="dropped")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_crf_quality, op2_block_rules_html, op3_media_archives, op4_ngram_jaccard_join, op5_distribution_divergence, op6_distinct_site_lines, op7_word_table_bpe, op8_sorted_string_table, op9_retrieval_packing, op10_language_mixture, op11_host_reputation, op12_pivotal_spelling, op13_persistent_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op6_distinct_site_lines": line_dedup.SQL, "op11_host_reputation": host_reputation.SQL, "op12_pivotal_spelling": spelling.SQL, "op13_persistent_audit": dialogue.SQL}
