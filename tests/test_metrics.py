import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.ordering import early, k_window, recent_third, with_seq
from tidemark.operators import coupling, metrics, taxonomy


@pytest.fixture(scope="module")
def log(spark):
    """Pair (a, b) three times, one commit over forty files that is not coupled, one revert."""
    rows = [(1, "x", 10, 2, False, ["a", "b"]), (2, "x", 20, 0, False, ["a", "b"]), (3, "y", 5, 5, True, ["a", "b", "c"]), (4, "y", 900, 0, False, [f"f{i}" for i in range(40)]), (5, "z", 1, 1, False, ["c"])]
    raw = spark.createDataFrame(rows, "sha bigint, author string, insertions bigint, deletions bigint, is_revert boolean, paths array<string>")
    ts = F.timestamp_seconds(F.col("sha") * 86400)
    commits = raw.select("sha", "author", F.col("author").alias("email"), ts.alias("ts"), F.lit("work").alias("subject"), "is_revert", F.size("paths").alias("n_files"), "insertions", "deletions", (F.col("insertions") + F.col("deletions")).alias("churn"))
    files = raw.select("sha", F.explode("paths").alias("path")).withColumn("clade", F.upper(F.substring("path", 1, 1))).withColumn("layer", F.lit("core"))
    return commits, files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_large_commits_are_counted_not_coupled(log):
    commits, files = log
    assert rows(coupling.cochange_edges(files, commits, 1)) == [("a", "b", 3), ("a", "c", 1), ("b", "c", 1)]
    assert rows(coupling.split_large(commits)[1]) == [(1,)]
    assert rows(coupling.sum_of_coupling(coupling.cochange_edges(files, commits))) == [("a", 3), ("b", 3)]


def test_bundle(log):
    commits, files = log
    b = metrics.metric_bundle(commits, files, F.col("path") == "c").first()
    assert b["commit_count"] == 5 and b["revert_count"] == 1 and b["churn_total"] == 944 and b["dependency_change_commits"] == 2
    counts = [3, 3, 2] + [1] * 40
    p = [c / 48 for c in counts]
    assert math.isclose(b["file_touch_entropy"], -sum(x * math.log2(x + 1e-12) for x in p), rel_tol=1e-9)
    assert math.isclose(b["code_stability"], 1 / (1 + 0.002 * 944 / 5 + 3 / 5 + 0.5 * 3 / 5), rel_tol=1e-9)


def test_empty_log(log):
    commits, files = log
    b = metrics.metric_bundle(commits.limit(0), files.limit(0), F.lit(True)).first()
    assert b["commit_count"] == 0 and b["code_stability"] == 1.0
    assert coupling.cochange_edges(files.limit(0), commits).count() == 0


def test_allocations_never_exceed_totals(log):
    commits, files = log
    per = metrics.allocations(files, commits).groupBy("sha").agg(F.sum("insertions").alias("i")).join(commits, "sha")
    assert per.filter("i > insertions or i <= insertions - n_files").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 60), st.integers(1, 9))
def test_windows_hold_every_row_once(spark, n, k):
    df = spark.range(n).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1000003)))
    got = with_seq(df, "x", "id", total="n").select("x", "id", "seq", k_window(F.col("seq"), F.col("n"), k).alias("w"), early(F.col("seq"), F.col("n")).alias("e"), recent_third(F.col("seq"), F.col("n")).alias("r")).collect()
    order = sorted((r["x"], r["id"]) for r in got)
    assert [order.index((r["x"], r["id"])) for r in got] == [r["seq"] for r in got]
    assert all(r["w"] == min(k - 1, r["seq"] // max(1, n // k)) for r in got)
    assert sum(r["e"] for r in got) == max(1, n // 2) and sum(r["r"] for r in got) == max(1, n // 3)


def test_offboarding_and_owners(log):
    commits, files = log
    got = {r["removed"]: r for r in coupling.offboarding(files, commits, hot=3).collect()}
    assert 0 < got[1]["drop"] < got[2]["drop"] <= got[3]["drop"] == 1.0 and got[3]["uncovered"] == 3


def test_clades(spark, log):
    commits, files = log
    agg = {r["clade"]: r for r in taxonomy.clade_aggregates(metrics.allocations(files, commits), files).collect()}
    assert agg["F"]["n_files"] == 40 and agg["A"]["touches"] == 3
    unknown = taxonomy.clade_of(files.select("sha", "path"), spark.createDataFrame([("a", "A")], "path string, clade string"))
    assert {r["clade"] for r in unknown.collect()} == {"A", "clade_unknown"}
    stages = taxonomy.clade_stage(spark.createDataFrame([(1000, 9, 0.0, 5), (10, 9, 0.0, 5), (10, 2, 0.0, 5), (10, 9, 0.5, 5)], "churn int, touches int, revert_frac double, n_files int"))
    assert [r["stage"] for r in stages.collect()] == ["growth", "maturity", "pioneer", "disturbance"]
    crowded = taxonomy.niches(spark.createDataFrame([("u", 45, "utility"), ("c", 100, "core"), ("d", 60, "core")], "clade string, n_files int, top_layer string"))
    assert {r["clade"] for r in crowded.collect() if r["crowded"]} == {"u", "c"}


def test_votes_move_files(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("a", "c", 4), ("d", "b", 1)], "a string, b string, weight int")
    clade = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Y"), ("d", "Z")], "path string, clade string")
    touches = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 10)], "path string, touches int")
    got = dict(rows(taxonomy.cochange_votes(edges, clade, touches)))
    assert got["a"] == "Y" and got["d"] == "Z"
