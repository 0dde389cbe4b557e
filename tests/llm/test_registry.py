"""The registered queries over small tables: columns, types, laws and orders as their users expect them."""

from __future__ import annotations

import random

import pytest

from scoreloom.llm import registry

from ..compare import connect, difference
from .fixtures import documents, rows

COLUMNS = {
    "op1_near_duplicates": "doc_id bigint, class_id bigint, kept boolean",
    "op2_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op5_licence_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_multiprobe_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_repeated_strings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_minimax_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op11_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out, rng = str(tmp_path_factory.mktemp("tables")), random.Random(1)
    documents(spark).write.parquet(f"{out}/documents.parquet")
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(80)] + [(80, None), (None, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{out}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<article><p>One of the two.</p></article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    spark.createDataFrame([(k, 1, k % 5 == 0 and 1 or 0) for k in range(40)] + [(3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    turns = [(k // 4, k % 4, ["user", "assistant"][k % 2], f"Turn {k}.") for k in range(40)] + [(99, None, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return out


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_columns_and_rows(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    types = dict(df.dtypes)
    assert [(c.split()[0], c.split()[1]) for c in COLUMNS[name].split(", ")] == [(c, types[c]) for c in df.columns[: COLUMNS[name].count(",") + 1]]
    got = df.collect()
    if "doc_id" in types:
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got if r["doc_id"] is not None) == sorted((False, i) for i, *_ in rows() if i is not None)
        assert len(got) == len(rows())
    if name == "op6_multiprobe_search":
        assert {r["query_id"] for r in got} == {0, 20, 40, 60} and all(r["query_id"] != r["vec_id"] for r in got)
    if name == "op8_minimax_shards":
        assert {r["law"] for r in got} == {"bytes"} and all(0 <= r["shard"] < 8 and r["grown_shard"] is None for r in got)
    if name == "op9_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    tables = "/root/testdata/sf0.001"
    assert difference(registry.QUERIES[name](spark, tables), connect(tables), registry.ORACLE_SQL[name]) is None
