"""From raw documents to token ids: five stages, each over all that the one before kept.

1. ``quality_rules``: documents that the current policy rejects go.
2. ``line_dedup``: lines that repeat an earlier line go; a document without a line left goes too.
3. ``ngram_jaccard_join``: of each component of near documents, the one with the smallest id stays.
4. ``mixing``: sources are brought to their target weights; documents are repeated, left out,
   or (one a source) taken in part.
5. ``sentencepiece``: texts become ids, and are decoded again.

Stages 1 to 4 return the columns of documents; ``n_chars`` follows the text where a stage changes
it.

Defined results: null and empty texts fail stage 1 (too few words) and go there; a null source is a source of its own;
a null id stays through stages 1 to 4, links with nothing and loses no line. Ids are expected to be unique in the first
stage's input; rows that share one are one document to stages 2 and 3 and are taken alike by stage 4. Ties go
by id. Long texts are taken whole by every stage. An empty table gives an empty result. Extra columns, also
ones named like an operator's own results, pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard, line_dedup, mixing, pieces, quality_rules
from larkspur.llm.common import stored, table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality_rules.apply_policy(quality_rules.ledger(docs, out_col="__ledger"), ledger_col="__ledger")
    return kept.select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.remove_lines(docs)).select(*docs.columns)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix(docs)).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", join_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: The pieces of a tokenizer can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
