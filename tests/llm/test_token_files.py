import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import simple8b
from tidemark.llm.queries import QUERIES, tokenizer_file
from tidemark.llm.token_files import read_token_files, token_files, write_token_files
from tidemark.llm.word_pieces import word_encoder

PATH = tokenizer_file("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 61, 239, 240, 241, 1023, 1024, 1025, 40_000])
@pytest.mark.parametrize("bound", [1, 2, 17, 49_408, 2**31, 2**60 - 1, 2**64 - 1])
def test_segments_come_back_whole_and_in_part(n, bound):
    values = np.random.default_rng(n).integers(0, bound, n, dtype=np.uint64)
    segment = simple8b.encode(values)
    assert (simple8b.decode(segment) == values).all() and simple8b.size(segment) == len(simple8b.decode(segment)) == n
    assert (simple8b.decode(segment, n // 3, n // 3 + 1500) == values[n // 3 : n // 3 + 1500]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(2**59, 2**64 - 1)), max_size=400), st.integers(1, 70))
def test_any_mix_of_widths_and_any_block(values, block):
    assert simple8b.decode(simple8b.encode(np.array(values, np.uint64), block)).tolist() == values


def test_words_are_filled():
    assert len(simple8b.encode(np.full(6000, 30_000, np.uint64), 60_000)) < 6000 / 4 * 8 + 100
    assert len(simple8b.encode(np.zeros(2400, np.uint64), 2400)) == len(simple8b.encode(np.zeros(0, np.uint64))) + 8 * 11
    with pytest.raises(ValueError):
        simple8b.decode(b"\0" * 100)


def odd_texts():
    rng = random.Random(7)
    parts = ["a", "B", "é", "É", "'s", "'S", "''t", "'", "ll", "<|endoftext|>", "<|", "|>", "<|StartOfText|>", " ", "\t", " ", "\x1c", "\x85", "　", "İ", "ſ", "ß", "ẞ", "Σ", "日本", "7", "½", "_", "!!",
             "é", "́", "😀", "\x00", "\x0b", "ª", "µ", "×", "į", "Hello", "tion"]
    return ["", " ", None, "word " * 300, "x" * 3000, "!" * 700, " " * 50_000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(800)]


def test_encoder_equals_the_library():
    library, encode = Tokenizer.from_file(PATH), word_encoder(PATH)
    for t in odd_texts():
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def want(docs):
    library, out, start = Tokenizer.from_file(PATH), {}, 0
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_odd_rows(spark):
    docs = [(i * 7919 % 1009 - 300 if i else None, t, "x", 1) for i, t in enumerate(odd_texts())]
    got = token_files(spark.createDataFrame(docs, "doc_id bigint, text string, part string, start int").repartition(5), PATH).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want([d[:2] for d in docs]) and len(got) == len(docs)


def test_repeated_ids_long_texts_and_no_rows(spark, tmp_path):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (0, long), (2, None)], "doc_id bigint, text string")
    path = str(tmp_path / "ids")
    write_token_files(docs, PATH, path)
    rows = read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [0, 1, 1, 1, 2] and [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert rows[0]["ids"] == [*Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids, 1] and rows[4]["ids"] == [1]
    assert token_files(docs.limit(0), PATH).count() == 0


def test_query_over_the_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op11_token_files"](spark, SF).collect()} == want(docs)
