import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm import brute
from tidemark.llm.simhash import connected, fingerprint, forests, lanes_within, planes_of, simhash_groups
from tidemark.llm.substring_dedup import LENGTH, SETTLED, WINDOW, _passages, anchors_of, drop_repeated_passages, matching_spans, repeated_windows, substring_dedup, words_of

SCHEMA = "doc_id bigint, text string, lang string, d string, t int, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", 1, None) for i, t in rows], SCHEMA)


def some_texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    line = [rng.choice(vocabulary) for _ in range(15)]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 21, 80]))]
        for _ in range(rng.randrange(3)):
            at, a = rng.randrange(len(words) + 1), rng.randrange(40)
            words[at:at] = passage[a : a + rng.randrange(15, 40)] if rng.random() < 0.6 else line
        if rng.random() < 0.15:
            words += ["ha"] * 50
        out.append(" ".join(words))
        if rng.random() < 0.2:
            out.append(out[rng.randrange(len(out))])
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_against_brute_force(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr("tidemark.llm.substring_dedup.LEAST_HOT", 2)
    if seed == 2:
        monkeypatch.setattr("tidemark.llm.substring_dedup.CROWD", 3)
    rows = some_texts(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(frame(spark, rows).repartition(3)).collect()}
    assert got == brute.substring_dedup(rows)
    assert sum(x[1] for x in got.values()) > 100


def test_substring_dedup_odd_rows(spark):
    assert substring_dedup(frame(spark, [])).count() == 0
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "\x0b\x0c " + long[:500]), (5, "é b " * 30)]
    got = substring_dedup(frame(spark, rows)).collect()
    by = {r["doc_id"]: r["n_removed"] for r in got}
    assert len(got) == 7 and by[1] == by[2] == 0
    assert [r["n_removed"] for r in got if r["doc_id"] == 3] == [40_000, 40_000]  # the row without an id comes first
    assert by[None] == 0 and by[4] > 50 and by[5] > 0


def test_drop_repeated_passages_keeps_columns_and_clean_texts(spark):
    p = " ".join(f"p{i}" for i in range(30))
    docs = frame(spark, [(1, f"a\n b {p}"), (2, f"c  d\n{p} e"), (3, None)])
    out = {r["doc_id"]: r for r in drop_repeated_passages(docs).collect()}
    assert out[1]["text"] == f"a\n b {p}" and out[2]["text"] == "c  d\ne" and out[3]["text"] is None
    assert drop_repeated_passages(docs).columns == docs.columns


@pytest.mark.parametrize("operator", [substring_dedup, drop_repeated_passages])
def test_texts_are_shuffled_once_for_both_joins(spark, operator):
    p = " ".join(f"p{i}" for i in range(30))
    # Other words before and after, so that the passage's contexts differ and shards are needed: both joins have rows.
    docs = frame(spark, [(i, " ".join([*[f"a{i}_{j}" for j in range(20)], p, *[f"b{i}_{j}" for j in range(20)]])) for i in range(40)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = operator(docs)
        assert out.count() == 40 and len(out.collect()) == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1, final


def test_drop_repeated_passages_with_columns_of_any_name_and_place(spark):
    p = " ".join(f"p{i}" for i in range(30))
    rows = [("x", 7, f"a {p} b", 1, {"k": [1]}, f"a {p} b", 2), ("y", 8, f"c {p} d", None, None, "z", 3), (None, 9, None, 2, {}, None, 4), ("w", 0, "", 2, {}, "", None)]
    docs = spark.createDataFrame(rows, "gone string, n_chars int, text string, d int, rest map<string, array<int>>, row string, doc_id int")
    out = drop_repeated_passages(docs)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    want = [("x", len(rows[0][2]), *rows[0][2:]), ("y", 3, "c\nd", *rows[1][3:]), (None, None, *rows[2][2:]), ("w", 0, *rows[3][2:])]
    assert {tuple(map(str, r)) for r in out.collect()} == {tuple(map(str, r)) for r in want}
    assert drop_repeated_passages(docs.select("text", "doc_id")).columns == ["text", "doc_id"]


def test_automaton_keeps_earliest_places():
    a = list(range(25))
    found = set(repeated_windows([(1, 0, a), (1, 30, a), (2, 5, [99, *a[3:24], 98])], 20))
    assert found == {(1, i) for i in range(6)} | {(2, 1), (2, 2)}


def test_matching_spans_streams_documents_past_shards(spark):
    p = " ".join(f"p{i}" for i in range(50))
    docs = frame(spark, [(1, f"a b {p} c"), (2, "a b c"), (3, " ".join(p.split()[10:40]))])
    refs = frame(spark, [(10, p), (11, "zz " * 30), (12, None)])
    got = {(r["doc_id"], r["start"], r["words"]) for r in matching_spans(docs, refs, LENGTH, shard_words=20).collect()}
    assert got == {(1, 2, 50), (3, 0, 30)}


def test_fingerprints_and_groups_against_brute_force(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(9001, None), (9002, " \t"), (9003, "One two"), (9004, "one TWO"), (9005, "ÀB c")]
    fps = {i: brute.fingerprint(t) for i, t in rows}
    got = simhash_groups(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.components(fps)


def test_empty_and_odd_rows(spark):
    assert simhash_groups(frame(spark, [])).count() == 0
    got = simhash_groups(frame(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "quite another text it is")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(400)], np.uint64)
    fps = np.unique(base[rng.integers(0, 40, 400)] ^ flips)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    bits = np.unpackbits(lanes_within(planes_of(fps), fps, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    assert (bits.astype(bool) == near).all()
    for sizes in ([len(fps)], [3, 7, 8, 9, 40, 64, 65]):
        groups = np.repeat(np.arange(len(sizes)), sizes)[: len(fps)]
        part = fps[: len(groups)]
        a, b = forests(part, groups, radius)
        assert len(a) < max(1, len(part))
        got = {int(x): int(x) for x in part}

        def find(x, got=got):
            return x if got[x] == x else find(got[x])

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            got[max(x, y)] = min(x, y)
        for g in np.unique(groups):
            own = part[groups == g]
            for i, r in brute.components(dict(enumerate(own.tolist())), radius).items():
                assert find(int(own[i])) == int(own[r])


def test_star_contraction_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id as a", "id - 1 as b").union(spark.createDataFrame([(500, 501), (501, 502)], "a bigint, b bigint"))
    roots = {r["node"]: r["root"] for r in connected(links).collect()}
    assert all(roots[i] == 0 for i in range(1, 200)) and roots[502] == roots[501] == 500


def test_fingerprint_of_few_words():
    assert fingerprint("") == 0 and fingerprint("a b") == brute.fingerprint("a b")


@pytest.mark.parametrize("in_order", [True, False])
def test_a_common_line_sends_few_rows(monkeypatch, in_order):
    """A line in every document of a task, over several pieces: its windows go on once, or as often as the logarithm of the documents."""
    monkeypatch.setattr("tidemark.llm.substring_dedup.BATCH_BYTES", 20_000)
    line = " ".join(f"line{i}" for i in range(22))
    texts = [f"{' '.join(f'a{i}b{k}' for k in range(30))} {line} {' '.join(f'c{i}d{k}' for k in range(30))}" for i in range(400)]
    ids = list(range(400)) if in_order else random.Random(1).sample(range(400), 400)
    opened = []
    for text in texts:
        words = words_of([text.encode()])
        opened.append([{"pos": int(p), "crowded": True} for p in anchors_of(words).places])
    batch = pa.RecordBatch.from_pydict({"d": ids, "t": [0] * 400, "opened": opened, "text": texts})
    rows = [r for out in _passages(LENGTH)(iter([batch])) for r in out.to_pylist()]
    routes = brute.groups([(r["route"], r["start"]) for r in rows if r["kind"] == WINDOW])
    assert max(map(len, routes.values())) <= (1 if in_order else 20)
    assert sum(r["kind"] == SETTLED for r in rows) >= 3 * 380
