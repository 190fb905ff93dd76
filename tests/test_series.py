import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import series


def test_steps_and_rises(spark):
    step = np.array([1.0] * 8 + [20.0] * 8)
    assert 5 <= series.binary_segmentation(step)[0] <= 11 and series.binary_segmentation(np.ones(20)) == []
    assert series.cusum(np.array([1.0, 2, 1])) == []
    late = np.array([0.0] * 12 + [9.0, 9.0])
    assert all(3 <= i <= 11 for i in series.cusum(late, 0.1)) and (np.diff(series.cusum(np.tile([0.0, 5.0], 12), 0.05)) >= 3).all()
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(step)] + [("flat", i, 3.0) for i in range(16)], "id string, t int, x double")
    got = series.changepoints(df).collect()
    assert {r["id"] for r in got} == {"s"} and all(r["direction"] == "up" for r in got)
    up = spark.createDataFrame([("u", i, float(i)) for i in range(1, 9)] + [("e", i, 1.0) for i in range(8)], "id string, t int, x double")
    tests = {r["id"]: r for r in series.with_trend_labels(series.mann_kendall(up)).collect()}
    assert tests["u"]["s"] == 28 and tests["u"]["tau"] == 1.0 and tests["u"]["trend"] == "rising" and tests["e"]["trend"] == "flat"
    z = 27 / math.sqrt(8 * 7 * 21 / 18)
    assert math.isclose(tests["u"]["p"], math.erfc(z / math.sqrt(2)), rel_tol=1e-9)


def test_storms_are_greedy(spark):
    days = [0, 5, 13, 15, 16, 60, 61, 90]
    df = spark.createDataFrame([("r", d) for d in days], "repo string, d int").select("repo", F.timestamp_seconds(F.col("d") * 86400).alias("ts"))
    got = series.storms(df).collect()
    assert [(r["n"], round(r["confidence"], 2)) for r in got] == [(3, 0.7)]


def test_segments_merge_near_bounds(spark):
    rows = [("r", "2024-01-01", "growth", 0.5), ("r", "2024-01-08", "maturity", 0.8), ("r", "2024-03-01", "decline", 0.6)]
    df = spark.createDataFrame(rows, "repo string, at string, stage string, confidence double").withColumn("at", F.to_timestamp("at"))
    got = [(r["stage"], str(r["start"])[:10], str(r["end"])[:10]) for r in series.segments(df).orderBy("start").collect()]
    assert got == [("maturity", "2024-01-08", "2024-03-01"), ("decline", "2024-03-01", "2024-03-02")]


def test_z_scores(spark):
    got = series.z_scores(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double"), "a", "b").collect()
    assert math.isclose(sum(r["z_a"] for r in got), 0, abs_tol=1e-12) and all(r["z_b"] == 0 for r in got)


def test_week_keys(spark):
    df = spark.createDataFrame([("2021-01-03",), ("2024-12-30",)], "d string").select(F.to_timestamp("d").alias("ts"))
    assert [tuple(r) for r in df.select(series.week_key(F.col("ts")), series.week_month(F.col("ts"))).collect()] == [("2020-W53", "2020-12"), ("2025-W01", "2024-12")]


def test_nearest_within(spark):
    d = lambda xs, *names: spark.createDataFrame(xs, ", ".join(f"{n} string" for n in names)).withColumn("at", F.to_date("at"))
    got = {r["label"]: r["gap"] for r in series.nearest_within(d([("x", "2024-03-01"), ("y", "2023-01-01")], "label", "at"), d([("2024-02-20",), ("2024-04-14",), ("2025-01-01",)], "at")).collect()}
    assert got == {"x": 10, "y": None}
