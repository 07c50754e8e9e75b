"""The operators' queries with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import classifier, jaccard, licenses, line_dedup, media, mixing, pieces, quality_rules, secrets, substrings
from larkspur.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the current policy."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("ledger")
    base_failed = ~quality_rules.passes(["too_few_words", "repeated_windows"], m["fail_bits"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = ~base_failed & quality_rules.passes(quality_rules.CURRENT, m["fail_bits"])
    return rows.select("doc_id", *[m[c].alias(c) for c in names], base_failed.alias("base_failed"), kept.alias("kept"), m["fail_bits"].alias("fail_bits"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.plan_mix(table(spark, sf_dir, "documents")).drop("source")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of near documents."""
    return jaccard.link(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has too."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality scores."""
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts, as digests."""
    return pieces.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices by document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to be removed from each document."""
    return line_dedup.removals(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as lossless WebP and read back."""
    return media.store_texts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_secrets, op4_jaccard_join, op5_substring_dedup, op6_quality_classifier, op7_sentencepiece, op8_licenses, op9_line_dedup, op10_media)}
