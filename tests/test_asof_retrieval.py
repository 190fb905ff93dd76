import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, retrieval, series


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_last_nearest_and_sums_equal_plain_ones(spark, width):
    rng = random.Random(width)
    left = [(rng.choice("ab"), rng.randrange(-50, 250), i) for i in range(120)] + [("c", 5, 500), ("a", None, 501)]
    right = [(rng.choice("ab"), rng.randrange(0, 200), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "k string, at bigint, id int"), spark.createDataFrame(right, "k string, at bigint, x int")
    own = {k: sorted((t, x) for kk, t, x in right if kk == k) for k in "abc"}
    for at_once in (True, False):
        got = {r["id"]: r["hit"] and tuple(r["hit"]) for r in asof.last_before(a, b, ["k"], width, "x", at_once).collect()}
        for k, t, i in left:
            n = 0 if t is None else bisect.bisect_right(own[k], (t, 10**9)) if at_once else bisect.bisect_left(own[k], (t, -1))
            assert got[i] == (own[k][n - 1] if n else None)
    near = {r["id"]: (r["hit"] and r["hit"]["x"], r["gap"]) for r in asof.nearest(a, b, ["k"], width, "x").collect()}
    for k, t, i in left:
        best = min(((abs(u - t), x) for u, x in own[k]), default=None) if t is not None else None
        assert near[i] == ((best[1], best[0]) if best else (None, None))
    spans = [(i, rng.choice([None, rng.randrange(0, 200)]), rng.choice([None, rng.randrange(0, 200)])) for i in range(40)]
    got = {r["i"]: (r["n"], r["x"]) for r in asof.within(spark.createDataFrame(spans, "i int, start bigint, due bigint"), b, ["x"], width).collect()}
    for i, s, e in spans:
        inside = [x for _, t, x in right if (s is None or t >= s) and (e is None or t <= e)]
        assert got[i] == (len(inside), sum(inside))


def test_no_loops_in_the_plans(spark):
    times = spark.range(50).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("label"), F.timestamp_seconds(F.col("id") * 86_400).alias("at"))
    segs = spark.range(5).select(F.timestamp_seconds(F.col("id") * 864_000).alias("start"), F.timestamp_seconds(F.col("id") * 864_000 + 864_000).alias("end"), F.lit("growth").alias("stage"), F.lit(0.5).alias("confidence"))
    rows = times.select(F.col("at").alias("ts"), F.lit(1).alias("churn"))
    spans = segs.select("start", F.col("end").alias("due"), F.col("start").cast("string").alias("span"))
    for out in (series.stage_at(times, segs), series.within_spans(rows, spans)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["n"] for r in series.within_spans(rows, spans).collect()} == {11, 10}


def test_anchors_prefer_series_and_fall_back(spark):
    points = [("2024-01-10", "reverts", "up", 3.0), ("2024-01-12", "authors", "up", 2.0), ("2024-06-01", "files", "down", 1.5), ("2024-09-01", "churn", "down", 1.0)]
    events = [("v1", "release", "2024-01-09", "growth", 0.7), ("sec", "security", "2024-01-09", "maturity", 0.6), ("v2", "release", "2024-06-11", "growth", 0.7), ("v3", "release", "2024-09-02", "growth", 0.7), ("v4", "release", "2025-03-01", "growth", 0.7)]
    p = spark.createDataFrame(points, "at string, series string, direction string, magnitude double").withColumn("at", F.to_timestamp("at"))
    e = spark.createDataFrame(events, "label string, kind string, at string, stage string, confidence double").withColumn("at", F.to_timestamp("at"))
    got = {r["label"]: (r["series"], r["gap_days"], r["stage"], r["confidence"]) for r in series.anchors(e, p).collect()}
    assert got["v1"][:3] == ("authors", 3.0, "growth") and got["sec"][:3] == ("reverts", 1.0, "disturbance") and got["v2"][:3] == ("files", 10.0, "growth")
    assert got["v3"][:3] == ("churn", 1.0, "consolidation") and got["v4"] == (None, None, "growth", pytest.approx(0.595))
    assert got["v1"][3] == pytest.approx(0.7 + 0.08 + 0.12 * (1 - 3 / 45))


def test_basins_without_months_take_the_next_three(spark):
    samples = spark.createDataFrame([("2024-05", 1.0), ("2024-06", 3.0), ("2024-07", 5.0), ("2024-09", 7.0)], "month string, activity double")
    segs = spark.createDataFrame([("a", "2024-01-01", "2024-02-01"), ("b", "2024-06-10", "2024-07-01"), ("c", "2025-01-01", "2025-02-01")], "stage string, start string, end string")
    segs = segs.withColumns({c: F.to_timestamp(c) for c in ("start", "end")})
    assert {r["stage"]: (r["months"], r["mean_activity"], r["occupancy"]) for r in series.basins(samples, segs).collect()} == {"a": (3, 3.0, 0.75), "b": (2, 4.0, 0.5)}


def test_chunks_end_at_definitions_and_hold_all_lines():
    lines = ["def a():"] + ["x" * 60] * 30 + ["", "y" * 5000, "class B:", "  z"]
    spans = list(retrieval.line_spans(lines, 700, 80))
    assert spans[0][0] == 1 and spans[-1][1] == len(lines) and all(b[0] <= a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))
    assert list(retrieval.line_spans([], 700)) == [] and list(retrieval.line_spans(["a"], 700)) == [(1, 1)]
    body = ["w" * 99] * 7 + ["def next():"] + ["w" * 99] * 3
    assert list(retrieval.line_spans(body, 700, 80))[0] == (1, 8)


@pytest.mark.parametrize("block", [64, 1024])
def test_search_is_exact(spark, block):
    rng = np.random.default_rng(block)
    items = [(f"i{k}", rng.integers(-3, 4, 64).tolist()) for k in range(300)]
    items += [(f"j{k}", items[k][1]) for k in range(40)]
    queries = [(f"q{k}", rng.integers(-3, 4, 64).tolist()) for k in range(150)] + [("same", items[0][1])]
    out = retrieval.nearest(spark.createDataFrame(queries, "query_id string, v array<bigint>"), spark.createDataFrame(items, "id string, v array<bigint>").repartition(5), 7, block)
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in out.collect()}
    for q, v in queries:
        want = sorted((-float(np.dot(v, w) / np.sqrt(float(np.dot(v, v)) * float(np.dot(w, w)))), i) for i, w in items)[:7]
        assert [got[q, k + 1] for k in range(7)] == [(i, -s) for s, i in want]


def test_chunks_outside_the_clade_count_less(spark):
    files = spark.createDataFrame([("a/x.py", "alpha beta gamma"), ("b/y.py", "alpha beta gamma"), ("c/empty", ""), ("c/none", None), ("c/white", " \n ")], "path string, text string")
    chunks = retrieval.line_chunks(files)
    assert {r["path"] for r in chunks.collect()} == {"a/x.py", "b/y.py"}
    members = spark.createDataFrame([("q", "b/y.py")], "query_id string, path string")
    got = retrieval.retrieve(chunks, spark.createDataFrame([("q", "alpha beta")], "query_id string, text string"), 2, members).orderBy("rank").collect()
    assert [r["path"] for r in got] == ["b/y.py", "a/x.py"] and got[1]["score"] / got[0]["score"] < 0.7
