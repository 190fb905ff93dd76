import random

import pyarrow.parquet as pq
import pytest

from tests.llm import brute
from tidemark.llm.queries import QUERIES
from tidemark.llm.spelling_variants import near_pairs, spelling_variants

SF = "/root/testdata/sf0.001"


def table(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("crowd", [0, 2, 64])
def test_all_pairs_one_edit_apart_are_found(spark, crowd):
    rng = random.Random(crowd)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(600)} | {"", "a" * 400, "a" * 401, "a" * 200 + "b" + "a" * 199}
    got = [tuple(r) for r in near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), crowd).collect()]
    letters, want = "abé", set()
    for w in words:
        edits = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        want |= {(w, x) for x in edits & words if (len(w), w) < (len(x), x)}
    assert len(got) == len(set(got)) and set(got) == want


def odd_docs():
    rng = random.Random(5)
    words = ["colour", "color", "colours", "COLOUR", "cölour", "grey-green", "naïve", "naÏve", "straße", "aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷×÷××", "日本colours", "x" * 5000, "x" * 5001]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(60)]
    return [*docs, (None, "colour " * 30), (None, None), (3, "colour\tcolour"), (3, "colour\tcolour"), (61, ""), (62, "colour" * 50_000)]


@pytest.mark.parametrize("every", [0, 3, 199])
def test_odd_rows(spark, every):
    docs = odd_docs()
    frame = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id bigint, text string, word string, n int").repartition(3)
    rows = spelling_variants(frame, every=every).collect()
    assert table(rows) == brute.spelling_variants(docs, every) and len(rows) == len(table(rows))
    assert spelling_variants(frame.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    docs = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdhg " * 125 + "abcihg " * 625 + "zzcihg " * 5)]
    got = table(spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string"), every=0).collect())
    assert {w: got[w][1] for w in got} == {"abcdef": "abcihg", "abcdeg": "abcihg", "abcdhg": "abcihg", "abcihg": "abcihg", "zzcihg": "zzcihg"}


def test_query_over_the_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert table(QUERIES["op12_spelling_variants"](spark, SF).collect()) == brute.spelling_variants(docs)
