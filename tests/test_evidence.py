import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence

LOG = "repo string, n int, n_edges int, n_strong int, top_weight int, filtered int, n_hot int, hot_score double, has_complexity boolean, n_authors int, mastery_drop double, stability double"


def test_signals_and_their_order(spark):
    logs = spark.createDataFrame([("a", 80, 20, 8, 5, 0, 5, 0.9, True, 5, 0.5, 0.8), ("b", 5, None, None, None, None, 0, None, None, None, None, 0.5), ("c", 60, 0, 0, 0, 60, 3, None, None, 1, 0.0, None)], LOG)
    got = {(r["repo"], r["signal"]): r for r in evidence.signal_scores(logs, "repo").collect()}
    assert got["a", "change_coupling"]["confidence"] == 0.95 and got["a", "change_coupling"]["reliability"] == "high" and got["a", "change_coupling"]["hero"] == 1
    assert got["a", "hotspot_churn_complexity"]["hero"] == 2 and got["a", "offboarding_risk"]["hero"] == 3 and got["a", "code_stability"]["hero"] is None
    assert {s for r, s in got if r == "b"} == {"code_stability"} and got["b", "code_stability"]["reliability"] == "insufficient"
    assert got["c", "change_coupling"]["confidence"] == pytest.approx(0.25 + 0.25 * 0.75) and {s for r, s in got if r == "c"} == {"change_coupling", "hotspot_churn_complexity", "offboarding_risk"}
    assert evidence.signal_scores(logs.limit(0), "repo").count() == 0


def test_all_laws_have_a_claim(spark):
    logs = spark.createDataFrame([("a", 100), ("b", 10), ("c", 30)], "repo string, n int")
    tests = spark.createDataFrame([("a", "churn_rate", 8, 0.01), ("a", "work_rate", 8, 0.4), ("a", "file_growth", 3, 0.01), ("b", "churn_rate", 8, 0.01)], "repo string, series string, n int, p double")
    support = spark.createDataFrame([("a", law, "support") for law in evidence.LAWS] + [("b", "continuing_change", "support"), ("c", "continuing_change", "contradict")], "repo string, law string, label string")
    got = {(r["repo"], r["id"]): r for r in evidence.hypothesis_panel(logs, tests, support, "repo").collect()}
    assert len(got) == 24
    change = got["a", "H-continuing_change"]
    base = 0.8 + 0.001 * 20
    assert change["verdict"] == "support" and change["confidence"] == pytest.approx(0.4 * base + 0.6 * base * 0.99, abs=1e-4) and change["method"].startswith("mann")
    assert got["a", "H-self_regulation"]["verdict"] == "weak" and got["a", "H-continuing_growth"]["confidence"] == 0.25 and got["a", "H-declining_quality"]["method"] == "proxy_only"
    assert got["b", "H-continuing_change"]["verdict"] == "insufficient" and got["b", "H-continuing_change"]["confidence"] <= 0.3 and got["c", "H-continuing_change"]["verdict"] == "contradict"
    stages = {r["claim"]: (r["verdict"], r["confidence"]) for r in evidence.stage_hypothesis(spark.createDataFrame([(100, "growth"), (10, "decline"), (9, None)], "n int, stage string")).collect()}
    assert stages == {"The repository is in stage growth": ("weak", round(base * 0.7, 4)), "The repository is in stage decline": ("insufficient", 0.175)}


def test_drift_of_clades_and_neutral_churn(spark):
    v = spark.createDataFrame([(1, 0, 1.0, True), (2, 0, 1.0, False), (3, 1, 1.0, True), (4, 2, 1.0, False), (5, 0, 1.0, True)], "id int, idx int, val double, early boolean")
    members = spark.createDataFrame([(1, "same"), (2, "same"), (3, "moved"), (4, "moved"), (5, "half"), (5, "half"), (9, "none")], "id int, clade string")
    assert {r["clade"]: r["drift"] for r in evidence.clade_drift(v, members).collect()} == {"same": 0.0, "moved": 1.0, "half": 0.0, "none": 0.0}
    churn = spark.createDataFrame([(True, 10), (False, 30)], "early boolean, churn int")
    one = evidence.neutral_churn(churn, v.filter("id <= 2")).first()
    assert one["drift"] == 0 and one["neutral_churn"] == 1.0
    assert evidence.neutral_churn(churn.limit(0), v.filter("id <= 2")).first()["neutral_churn"] == 0


def test_states_have_all_seven_coordinates(spark):
    samples = spark.createDataFrame([("2024-01", 1.0), ("2024-02", 2.0)], "month string, activity double")
    rows = evidence.state_trajectory(samples, spark.createDataFrame([(0.4,)], "score double"), spark.createDataFrame([(2.0,), (4.0,)], "delta double")).collect()
    assert [(r["selection"], r["typed_heat"]) for r in rows] == [(0.4, 3.0)] * 2
    none = evidence.state_trajectory(samples, samples.limit(0).select(F.lit(0.1).alias("score")), samples.limit(0).select(F.lit(0.1).alias("delta"))).first()
    assert (none["selection"], none["typed_heat"]) == (0.0, 0.0)
