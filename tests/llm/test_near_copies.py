import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from tidemark.llm.near_copies import band_keys, drop_near_copies, near_copy_groups, shingle_set, similar_forest

SCHEMA = "doc_id bigint, text string, lang string"


def jaccard(a, b):
    x, y = shingle_set(a or "", 5), shingle_set(b or "", 5)
    same = len(np.intersect1d(x, y))
    return same / max(1, len(x) + len(y) - same)


def planted(n=40, seed=1):
    """Pairs of texts of 200 words, the second with words changed, at a similarity of 0.8 to 0.96."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(words)
        for k in rng.sample(range(0, 200, 8), 1 + i % 4):
            other[k] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return rows


def test_pipeline_stage_drops_near_copies_that_fingerprints_miss(spark):
    rows = planted()
    assert all(jaccard(rows[i][1], rows[i + 1][1]) >= 0.8 for i in range(0, len(rows), 2))
    fps = {i: brute.fingerprint(t) for i, t in rows}
    assert len(set(brute.components(fps).values())) > len(rows) / 2  # a radius of three leaves some
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(range(0, len(rows), 2))


@pytest.mark.parametrize("chunk", [500, 1 << 20])
def test_groups_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr("tidemark.llm.near_copies.CHUNK", chunk)  # of 500 shingles: the group of ten below is dealt out
    rows = planted(15, 2) + [(100 + i, " ".join([f"a{k}" for k in range(200)][: 200 - i])) for i in range(10)]
    rows += [(200, None), (201, ""), (202, "two words"), (203, "Two  WORDS")]
    root = brute.near_groups(dict(rows))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA).repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copy_groups(docs).collect()} == root
    assert root[109] == 100 and root[201] == 200 and root[203] == 202


def test_forest_confirms_the_threshold():
    base = np.arange(10, dtype=np.uint64)
    assert similar_forest([base, base[:8], base[:7]], 0.8) == [(1, 0), (2, 0)]  # 0.8, then 7 of 8
    assert similar_forest([base, base[:7]], 0.8) == []
    far = base + np.uint64(50)
    assert similar_forest([base, far, base[:9], far[:9]], 0.8, ["x", "x", "y", "z"]) == [(2, 0), (3, 0)]  # what is linked already brings both
    assert band_keys(base[:0]) == []


def test_pipeline_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    ids = sorted(left)
    assert 100 < len(ids) < docs.count()
    assert not [(a, b) for i, a in enumerate(ids) for b in ids[:i] if jaccard(left[a], left[b]) >= 0.8]


def test_rows_and_not_ids_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en"), (1, a, "en"), (1, b, None), (None, a + " x", "de"), (None, "other text", "de"), (None, None, "fr"), (7, "", "fr"), (8, "w " * 100_000, "fr")]
    docs = spark.createDataFrame([(*r, "c", 5) for r in rows], SCHEMA + ", class string, size int")
    out = sorted(((r["doc_id"], (r["text"] or "")[:5], r["lang"]) for r in drop_near_copies(docs).collect()), key=str)
    assert out == sorted([(1, a[:5], "en"), (1, b[:5], None), (None, "other", "de"), (7, "", "fr"), (8, "w w w", "fr")], key=str)
    assert drop_near_copies(docs).columns == docs.columns and drop_near_copies(docs.limit(0)).count() == 0 and near_copy_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [2000, 1 << 20])
def test_one_large_group(spark, monkeypatch, chunk):
    """Near copies of one text, each with words changed, some too far from it, over several chunks."""
    monkeypatch.setattr("tidemark.llm.near_copies.CHUNK", chunk)
    rng, base = random.Random(4), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(0, 120, 5), 1 + (i % 3 == 0) + 6 * (i % 25 == 0)):
            words[k] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(docs).collect()}
    assert got == brute.near_groups(dict(rows)) and 1 < len(set(got.values())) < 20
