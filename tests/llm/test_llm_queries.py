"""The queries of the operators: columns and types of their contracts, and DuckDB where SQL expresses them."""

from __future__ import annotations

import duckdb
import pytest

from palimpsest.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels embeddings conversations".split()
COLUMNS = {
    "op1_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op2_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_multiset_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_mixing": "doc_id bigint, source string, lang string, topic string, n_tokens bigint, weight double, probability double, kept boolean",
    "op11_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}
#: Tables with a row for each row of the result; other queries have one for each document, and the last two none of that kind.
OF = {"op1_url_filter": "pages", "op11_vector_codes": "embeddings", "op12_chat_format": None, "op13_collocations": None}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in found.dtypes) == COLUMNS[name]
    rows = sorted(map(tuple, found.collect()), key=repr)
    of = OF.get(name, "documents")
    assert not of or len(rows) == spark.read.parquet(f"{SF}/{of}.parquet").count()
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(f"select {', '.join(found.columns)} from ({queries.SQL[name]})").fetchall()
        assert rows == sorted(want, key=repr)
