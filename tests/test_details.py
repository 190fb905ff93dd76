import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import metrics, risk, series, texts
from tidemark.plans import QUERIES


def _plain_kmeans(v, seeds, rounds=15):
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    c = unit(seeds)
    for _ in range(rounds):
        own = (unit(v) @ c.T).argmax(axis=1)
        c = unit(np.array([v[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))]))
    return own


def test_kmeans_rounds_equal_the_plain_version(spark):
    d = "/root/testdata/sf0.001"
    e = pd.read_parquet(f"{d}/embeddings.parquet").sort_values("vec_id")
    firsts = e.groupby("label").first()
    own = _plain_kmeans(np.array(e["embedding"].tolist(), float), np.array(firsts["embedding"].tolist(), float))
    want = dict(zip(e["vec_id"], firsts.index.to_numpy()[own]))
    assert {r["id"]: r["cluster"] for r in QUERIES["kmeans_rounds"](spark, d).collect()} == want


def test_kmeans_keeps_an_empty_cluster_and_breaks_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])], "id bigint, v array<double>")
    seeds = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "cluster bigint, c array<double>")
    best, cents = texts.kmeans(v, seeds, 3)
    assert {r["id"]: r["cluster"] for r in best.collect()} == {1: 0, 2: 0, 3: 1}
    assert {r["cluster"]: r["c"] for r in cents.collect()}[3] == [-1.0, 0.0]
    got = texts.soft_confidence(v.filter("id = 1"), seeds.filter("cluster < 2")).first()
    assert got["cluster"] == 0 and abs(got["confidence"] - 1.0) < 1e-9
    alone = texts.soft_confidence(v.filter("id = 1"), seeds.filter("cluster = 3")).first()
    assert alone["confidence"] == 0.0


def test_hot_files_by_ending(spark):
    df = spark.createDataFrame([("a.py",), ("a.py",), ("b.MD",), ("c.go",)], "path string")
    assert [tuple(r) for r in metrics.hot_files(df, endings=(".py", ".md")).collect()] == [("a.py", 2), ("b.MD", 1)]


def test_baseline_gate_warns_and_passes(spark):
    stable = spark.createDataFrame([(0.9,)], "code_stability double")
    calm = spark.createDataFrame([(0.1,)], "fatigue double")
    many = spark.range(13).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("path"), F.lit(0.9).alias("severity"))
    assert tuple(risk.gate(stable, many, calm, baseline=True).first()) == (True, "", "baseline", 13)
    assert tuple(risk.gate(stable, many.limit(12), calm, baseline=True).first()) == (True, "", "", 12)
    assert tuple(risk.gate(stable, many, calm).first()) == (False, "new_p0", "", 13)


def test_bounds_of_changepoints_and_spans(spark):
    rows = [("r", "reverts", "2024-05-01", "up", 2.0), ("r", "authors", "2024-07-01", "down", 1.5), ("r", "churn", "2024-09-01", "down", 1.0), ("r", "commits", "2024-11-01", "up", 0.5)]
    points = spark.createDataFrame(rows, "repo string, id string, t string, direction string, magnitude double").withColumn("t", F.to_date("t"))
    bounds = series.changepoint_bounds(points, most=3)
    spans = spark.createDataFrame([("r", "2024-01-01", "2025-01-01")], "repo string, first string, last string").select("repo", F.to_timestamp("first").alias("first"), F.to_timestamp("last").alias("last"))
    got = [(r["stage"], str(r["start"])[:10], str(r["end"])[:10]) for r in series.segments(bounds, spans=spans).orderBy("start").collect()]
    assert got == [
        ("pioneer", "2024-01-01", "2024-05-01"), ("disturbance", "2024-05-01", "2024-07-01"),
        ("decline", "2024-07-01", "2024-09-01"), ("consolidation", "2024-09-01", "2025-01-01"),
    ]


def test_weak_changes_of_reverts_are_left_out(spark):
    rows = [("reverts", i, 0.0 if i < 8 else 0.2) for i in range(16)] + [("n_commits", i, 1.0 if i < 8 else 9.0) for i in range(16)]
    df = spark.createDataFrame(rows, "id string, t int, x double")
    got = series.changepoints(df, lambda v: [2, 8, 14]).collect()
    assert [(r["id"], r["index"]) for r in got] == [("n_commits", 8)]


def test_file_episodes(spark):
    df = spark.createDataFrame([("p", i, i, 10, "c1" if i < 4 else None) for i in range(7)], "path string, ts int, sha int, churn int, clade string")
    got = [tuple(r) for r in series.file_episodes(df).orderBy("episode").select("touches", "churn", "first_sha", "last_sha", "clade").collect()]
    # The last touch's clade is null in the first group, where the first one's stands in.
    assert got[0][:4] == (5, 50, 0, 4) and got[0][4] == "c1" and got[1] == (2, 20, 5, 6, None)
