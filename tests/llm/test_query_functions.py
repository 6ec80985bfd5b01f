"""Every query of the subpackage runs over the smallest tables: its columns, their types, and what the contract says of them."""

import hashlib
import os
import zlib

import pytest

from leafmill import llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
COLUMNS = {
    "op1_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_line_dedup": "doc_id bigint, n_lines bigint, n_cut bigint, n_left bigint, n_chars_cut bigint, text_sha256 string",
    "op5_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def check_op1(r, text):
    data = text.encode()
    padded = data + bytes(-len(data) % 64 if data else 64)
    return (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def check_op8(r, _):
    return r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


CHECKS = {
    "op1_media": check_op1,
    "op4_line_dedup": lambda r, t: r.n_lines == t.count("\n") + 1 == r.n_cut + r.n_left and (r.n_chars_cut > 0 or r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()),
    "op6_pii": lambda r, _: len([s for s in r.spans.split(",") if s and not s.startswith("term")]) == r.n_email + r.n_ip + r.n_card + r.n_phone,
    "op8_toxicity": check_op8,
    "op9_simhash": lambda r, _: len(r.fingerprint) == 16 and r.component_id <= r.doc_id,
    "op10_secrets": lambda r, _: len([s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]) == r.n_assign + r.n_access + r.n_hex,
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_rows_of_a_query(spark, texts, name):
    df = llm.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in (x.split(" ")[0] for x in COLUMNS[name].split(", "))} == dict(x.split(" ") for x in COLUMNS[name].split(", "))
    rows = df.collect()
    if "doc_id" in kinds:
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name in CHECKS:
        assert [r for r in rows if not CHECKS[name](r, texts[r.doc_id])] == []
    if name == "op5_token_files":
        at = 0
        for r in sorted(rows):
            assert r.start == at and r.n_tokens >= 1
            at += r.n_tokens
