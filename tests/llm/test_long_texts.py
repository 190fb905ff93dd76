"""Texts of a million letters and more, beside short ones, through the operators that read documents."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece

from tests.llm import brute
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.language_id import identify_language
from tidemark.llm.packing import pack_documents
from tidemark.llm.piece_encoding import encode
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.spelling_variants import spelling_variants
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.token_counts import token_counts
from tidemark.llm.toxicity import grade_toxicity

LONG = " ".join(f"w{i * i % 9973} Straße" for i in range(90_000))
TEXTS = [LONG, LONG[:-1] + "x", LONG, "short one", "", None, "a" * 1_000_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string").repartition(3)


def test_exact_copies(docs):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup(docs).collect()}
    assert len(LONG) > 1_000_000 and {i: g[:2] for i, g in got.items()} == {0: (2, 2), 2: (2, 2), 1: (1, 1), 3: (3, 1), 4: (5, 2), 5: (5, 2), 6: (6, 1)}
    assert all(got[i][2] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS))


def test_pieces_and_counts(docs):
    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {i: library.encode(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, path).collect()} == {i: len(x) for i, x in want.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in encode(docs, path).collect()} == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}


def test_fingerprints(docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(docs).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: f"{brute.fingerprint(t):016x}" for i, t in enumerate(TEXTS)} and got[0][1] == got[1][1] == got[2][1] == 0


def test_repeated_passages(docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(docs, length=20).collect()}
    assert got == brute.substring_dedup(list(enumerate(TEXTS)))


def test_words_languages_and_grades(docs, spark):
    words = {r["word"]: r["n"] for r in spelling_variants(docs, every=0).collect()}
    assert words["straße"] == 3 * 90_000 - 1 + LONG[:-1].endswith("Straße")
    assert {r["doc_id"] for r in identify_language(docs).collect()} == set(range(len(TEXTS)))
    labels = spark.createDataFrame([(0, 1), (3, 0), (6, 0)], "doc_id bigint, toxic int")
    assert all(r["severity"] >= 0 for r in grade_toxicity(docs, labels).collect())


def test_windows_of_long_documents(docs):
    pieces = pack_documents(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    held = brute.groups([(r["doc_id"], r["length"]) for r in pieces])
    totals = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(held) == set(range(len(TEXTS))) and all(sum(held[i]) == totals[i] and max(held[i]) <= 2048 for i in held)
