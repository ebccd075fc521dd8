"""The corpus queries on the smallest tables: against SQL where there is some, for shape otherwise."""

import pytest
from compare import connect, difference

from paceline.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_language_mixture": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op4_sampled_segmentations": ["doc_id", "sample", "n_pieces", "ids_crc32"],
    "op5_winnowing_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op7_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op8_warc_round_trip": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op10_pii_spans": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12_benchmark_contamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    key = df.columns[0]
    if key == "word":  # not a row for each row of a table; held against SQL
        assert df.count() > 0
        return
    table = {"doc_id": "documents", "vec_id": "embeddings", "page_id": "pages"}[key]
    want = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in df.select(key).collect()} == want


def test_segmentations_are_given_whole(spark, sf_dir):
    rows = QUERIES["op4_sampled_segmentations"](spark, sf_dir).selectExpr("sample", "n_pieces", "ids").collect()
    assert {r["sample"] for r in rows} == {0, 1, 2, 3}
    assert all(len(r["ids"]) == r["n_pieces"] for r in rows)
