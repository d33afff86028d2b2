"""Registered queries return the contract's columns over the whole table."""

import oracle
import pytest

from panelmill.llm import registry

COLUMNS = {
    "op1": "doc_id item_id",
    "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4": "doc_id n_shingles component_id kept",
    "op5": "page_id host path rule verdict",
    "op6": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "doc_id n_words n_removed kept_sha256",
    "op9": "page_id url text n_chars",
    "op10": "doc_id held_out score predicted",
    "op11": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13": "word form root n n_near form_n",
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_columns_and_rows(spark, sf, name):
    out = registry.queries()[name](spark, sf)
    kind = name.split("_")[0]
    assert set(COLUMNS[kind].split()) <= set(out.columns)
    if kind not in ("op1", "op11", "op13"):
        table = "pages" if kind in ("op5", "op9") else "documents"
        assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert oracle.difference(registry.queries()[name](spark, sf), oracle.duck(sf), registry.oracle_sql()[name]) == ""
