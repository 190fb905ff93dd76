import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm.exact_dedup import drop_exact_copies, exact_dedup
from tidemark.llm.packing import best_fit_plan, byte_level_encoder, pack_documents
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.topk_search import exact_top_k

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_against_brute_force(spark, keep):
    rng = random.Random(7)
    texts = ["hot " * 50, "", None, *(f"prefix that all share in their first letters {i % 40}" for i in range(200))]
    rows = [(i, texts[0] if rng.random() < 0.4 else rng.choice(texts), "k", "e") for i in range(1500)]
    rows += [(3, rows[3][1], "k", "e"), (None, texts[0], "k", "e"), (None, "alone", "k", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, edge string").repartition(5)
    got = exact_dedup(docs, keep).collect()
    groups = brute.groups([(t or "", i) for i, t, _, _ in rows])
    worst = lambda i: (i is None, i or 0) if keep == "largest" else (i is not None, i or 0)
    best = {t: sorted(ids, key=lambda i: (i is None, -(i or 0)) if keep == "largest" else worst(i))[0] for t, ids in groups.items()}
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = by_sha[r["text_sha256"]]
        assert r["keep_id"] == best[t] and r["group_size"] == len(groups[t]) and (not r["kept"] or r["doc_id"] == best[t])
    left = drop_exact_copies(docs, keep)
    assert left.columns == docs.columns
    assert sorted((r["text"] or "", r["doc_id"] or -1) for r in left.collect()) == sorted((t, best[t] or -1) for t in groups)
    assert exact_dedup(docs.limit(0)).count() == 0 and drop_exact_copies(docs.limit(0)).count() == 0


def test_one_text_over_all_partitions(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'same' as text")
    got = exact_dedup(docs, "largest").collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(2999, 3000)} and sum(r["kept"] for r in got) == 1
    assert [r["doc_id"] for r in drop_exact_copies(docs, "largest").collect()] == [2999]


def test_exact_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)]  # ties beyond k
    rows = [(i, v, 0) for i, v in vectors] + [(5000, None, 0), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (5002, [float("nan")] * 6, 0), (None, vectors[1][1], 0), (5003, [float("inf")] * 6, 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(4)
    queries = frame.filter("vec_id % 20 = 0")
    as_float = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    want = brute.exact_top_k(as_float, [i for i, _ in vectors if i % 20 == 0], 20)
    for block in (4096, 7):
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_top_k(queries, frame, block=block).collect()]
        assert sorted(got) == sorted(want)
    few = exact_top_k(frame.filter("vec_id = 0"), frame.filter("vec_id < 3"), k=20)
    assert [(r["rank"], r["query_id"]) for r in few.orderBy("rank").collect()] == [(1, 0), (2, 0)]
    assert exact_top_k(queries.limit(0), frame).count() == 0 and exact_top_k(queries, frame.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    frame = spark.createDataFrame([(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [-3e5, 7.0]), (3, [3e5, 3.0])], "vec_id bigint, embedding array<double>")
    got = exact_top_k(frame.filter("vec_id = 0"), frame, k=2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, (64 * 300000) ** 2 + 64 * 192), (1, (64 * 300000) ** 2 + 64 * 128)]


def naive_best_fit(lengths, capacity):
    open_ = []
    for n in sorted(lengths, reverse=True):
        fit = min((w for w in open_ if w[0] >= n), default=None, key=lambda w: w[0])
        if fit is None:
            fit = [capacity]
            open_.append(fit)
        fit[0] -= n
    return sorted(w[0] for w in open_)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, placed = {}, 0
    for length, rank, pieces, window, each, offset in best_fit_plan(counts, 20):
        for k in range(pieces):
            w = window + k // each
            assert fill.get(w, 0) == offset + k % each * length
            fill[w] = fill.get(w, 0) + length
            placed += 1
        assert rank < counts[length]
    assert placed == len(lengths) and sorted(20 - f for f in fill.values()) == naive_best_fit(lengths, 20)


def test_pieces_hold_every_token_once(spark):
    rng = random.Random(5)
    texts = ["", None, "<|endoftext|> a", "x " * 5000, *(" ".join(rng.choice(["ab", "über", "日本", "\n\n", "it's", "12"]) for _ in range(rng.randrange(900))) for _ in range(120))]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "no id", 1), (4, texts[4], 1)], "doc_id bigint, text string, length int").repartition(3)
    rows = pack_documents(docs, PATH, with_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    got = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["length"] == len(ids) <= 2048 and r["ids_crc32"] == zlib.crc32(r["ids"])
        got.setdefault(r["doc_id"], []).append((r["start"], ids))
        if r["doc_id"] is not None:
            assert r["doc_tokens"] == len(want[r["doc_id"]])
    for i, ids in want.items():
        pieces = sorted(got[i])
        assert [x for _, p in pieces[:: 2 if i == 4 else 1] for x in p] == ids
    windows = brute.groups([(r["sequence_id"], (r["offset"], r["length"])) for r in rows])
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert sorted(windows) == list(range(len(windows)))
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_encoder_equals_the_library():
    library, encode = Tokenizer.from_file(PATH), byte_level_encoder(PATH)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(" aZé日\t\n\r'😀1.,<|endoftext|>  ") for _ in range(rng.randrange(50)))
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_encoder_on_long_runs(spark):
    library, encode = Tokenizer.from_file(PATH), byte_level_encoder(PATH)
    space = " " * 12_000
    for t in (space, space + "a", "a" + space + "<|endoftext|>b", f"a\n{space}\n", space + "\u3000x" + "\n" * 11_000 + "'s", "x" * 30_000, "\x1c" * 11_000 + "y"):
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    for t in (" " * 1_000_000, "word " + "\n" * 1_000_000 + "word"):
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "ab " * 200_000)], "doc_id bigint, text string")
    totals = {r["doc_id"]: r["doc_tokens"] for r in pack_documents(docs, PATH).collect()}
    assert totals == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in ((1, " " * 1_000_000), (2, "ab " * 200_000))}


def test_huge_components_rank_without_an_error(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 0.0]), (2, [2.0, 1.0]), (3, [1e12, 5.0]), (4, [4e9, -4e9])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_top_k(frame, frame, k=4).collect()}
    whole = {i: [max(-(2**62), min(2**62, int(np.floor(np.clip(64 * x, -(2.0**62), 2.0**62))))) for x in v] for i, v in rows}
    for q in whole:
        scores = sorted((-max(1 - 2**62, min(2**62 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)
        assert [got[q, r + 1] for r in range(4)] == [(i, -s) for s, i in scores]


def test_many_blocks_leave_no_broadcast_and_a_flat_plan(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    made, gone = [], []
    make, destroy = spark.sparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: made.append(1) or make(v))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(1) or destroy(self, *a))
    frame = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(12)], "vec_id bigint, embedding array<double>").coalesce(1)
    out = exact_top_k(frame, frame, k=2, block=1)
    assert len(made) == len(gone) == 12 and out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1 and out.count() == 24
