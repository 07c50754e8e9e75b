"""The registered queries: their columns, and their SQL on a table with nulls, ties and odd texts."""

import duckdb
import pytest

from larkspur.llm import oracle, queries
from tests.llm.test_operators import SCHEMA, corpus

COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_mixing": "doc_id size source_size target taken",
    "op3_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_jaccard_join": "doc_id n_shingles component_id",
    "op5_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op6_quality_classifier": "doc_id held_out score predicted",
    "op7_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_licenses": "doc_id n_matches licenses spans",
    "op9_line_dedup": "doc_id n_lines n_removed removed_lines",
    "op10_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = corpus(21, 80)
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2, 0) for r in rows], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == [r[0] for r in corpus(21, 80)]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, folder)
    names = ", ".join(df.columns)
    want = con.execute(f"SELECT {names} FROM ({oracle.ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
