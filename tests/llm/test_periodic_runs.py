import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm import brute
from tidemark.llm import periodic_runs as P
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def made(seed):
    rng, out = random.Random(seed), []
    size = rng.choice([5, 50, 300, 900])
    while len(out) < size:
        letters = rng.choice([2, 3, 50])
        q = rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 40, 64, 100])
        root = [rng.randrange(letters) for _ in range(q)]
        root = root[: q // 2] * 2 if rng.random() < 0.3 and q % 2 == 0 else root
        out += [root[i % len(root)] for i in range(int(q * rng.choice([1, 2, 3.5, 4, 4.1, 5, 9])) + rng.randrange(4))]
    return out


def found(words):
    codes, spans = np.array(words, np.int32), {}
    every = P.short_fragments(codes)
    for t in P.tiles(codes):
        every += P.solve_tile(np.frombuffer(t["codes"], "<i4"), max(t["lo"] - 1, 0) << t["octave"], list(range(t["lo"], t["hi"] + 1)), t["octave"])
    for q, lo, hi in sorted(every):
        own = spans.setdefault(q, [])
        if own and lo <= own[-1][1]:
            own[-1][1] = max(own[-1][1], hi)
        else:
            own.append([lo, hi])
    return sorted((lo, q, hi - lo + q) for q, own in spans.items() for lo, hi in own if hi - lo + q >= max(6, 4 * q))


@pytest.mark.parametrize("tile", [1, 64, 4096])
def test_runs_equal_a_plain_search(monkeypatch, tile):
    monkeypatch.setattr(P, "TILE", tile)
    for seed in range(150):
        words = made(seed)
        assert found(words) == brute.runs(words), seed


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert P.z_function(s, 40) == want and P.z_function(s, 3) == want[:3]


def result(rows):
    return {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in rows}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "TILE", 64)
    texts = [None, "", " ", "a", "a " * 6, " a\x0ba\x1ca\ta a a a", "é 日本 " * 9 + "é", "x y　z " * 12, "w" * 100_000]
    texts += [" ".join(map(str, made(1000 + i))) for i in range(120)]
    docs = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*d, "k", 5) for d in docs], "doc_id bigint, text string, row string, period int").repartition(3)
    rows = P.periodic_runs(frame).collect()
    assert len(rows) == len(docs) and result(rows) == {i: brute.periodic_runs(i, t) for i, t in docs}
    assert P.periodic_runs(frame.limit(0)).count() == 0
    twice = P.periodic_runs(frame.limit(40).unionByName(frame.limit(40))).collect()
    assert len(twice) == 80 and len({r for r in twice}) == 40


def test_very_long_texts(spark):
    root = [f"w{i * i % 9973}" for i in range(9973)]
    texts = [" ".join(root[i % 9973] for i in range(45_000)), "same " * 300_000, " ".join(f"u{i}" for i in range(200_000))]
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    got = sorted((r["n_runs"], r["start"] or 0, r["length"] or 0, r["period"] or 0) for r in P.periodic_runs(frame).collect())
    n = len(brute.runs(root))
    assert n == 0 and got == [(0, 0, 0, 0), (1, 0, 45_000, 9973), (1, 0, 300_000, 1)]


def test_query_over_the_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert result(QUERIES["op13_periodic_runs"](spark, SF).collect()) == {i: brute.periodic_runs(i, t) for i, t in docs}
