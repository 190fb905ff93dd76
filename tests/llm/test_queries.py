"""The registered queries over a whole small table against plain versions."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_op1(spark, docs):
    largest = {t: max(i for i, u in docs.items() if u == t) for t in set(docs.values())}
    for r in rows(spark, "op1_exact_dedup"):
        t = docs[r["doc_id"]]
        assert r["keep_id"] == largest[t] and r["kept"] == (r["doc_id"] == largest[t]) and r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_op2(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(spark, "op2_exact_topk")]
    assert sorted(got) == sorted(brute.exact_top_k(vectors, [i for i, _ in vectors if i % 20 == 0], 20))


def test_op3(spark, docs):
    library, pieces = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), brute.groups([(r["doc_id"], r) for r in rows(spark, "op3_packing")])
    for i, t in docs.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_op4_and_op6(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = {i: library.encode(t) for i, t in docs.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in rows(spark, "op6_token_counts")}
    for r in rows(spark, "op4_piece_encoding"):
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == counts[r["doc_id"]] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_op5(spark, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, "op5_substring_dedup")}
    assert got == brute.substring_dedup(list(docs.items()))


def test_op7(spark, docs):
    fps = {i: brute.fingerprint(t) for i, t in docs.items()}
    groups = brute.components(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op7_simhash")} == {i: (f"{f:016x}", groups[i]) for i, f in fps.items()}


def test_op8_op9_op10_cover_every_row(spark, docs):
    assert len(rows(spark, "op8_html_extraction")) == pq.read_metadata(f"{SF}/pages.parquet").num_rows
    assert {r["doc_id"] for r in rows(spark, "op9_toxicity")} == {r["doc_id"] for r in rows(spark, "op10_language")} == set(docs)
