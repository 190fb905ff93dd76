from tidemark.operators import objectives, trees


def test_specs(spark):
    specs = ["debt", " Raise_Stability ", "risk", "path", "refactor", "tests", "pass_tests+cov", "metric:a.b:max:0.5", "metric:a.b", "metric:", "metric:x:down:no", "anything", "", None]
    got = {r["spec"]: tuple(r)[1:] for r in objectives.parsed(spark.createDataFrame([(s,) for s in specs], "spec string")).collect()}
    assert got["debt"] == ("reduce_debt", "debt.score", False, None, False) and got[" Raise_Stability "] == ("raise_stability", "stability.composite", True, None, False)
    assert got["risk"][:2] == ("reduce_risk", "risk.count") and got["path"][0] == "stabilize_path" and got["tests"] == ("pass_tests", "tests.score", True, None, False) and got["pass_tests+cov"][-1]
    assert got["metric:a.b:max:0.5"] == ("custom", "a.b", True, 0.5, False) and got["metric:a.b"] == ("custom", "a.b", False, None, False) and got["metric:"][1] == "debt.score" and got["metric:x:down:no"][3] is None
    assert got["anything"] == got[""] == got[None] == got["refactor"] == ("follow_refactor", "debt.score", False, None, False)


def test_runs_against_the_run_before(spark):
    rows = [("a", 1, "debt.score", 0.5), ("a", 2, "debt.score", 0.4), ("a", 3, "debt.score", 0.4), ("a", 5, "debt.score", 0.1), ("b", 1, "debt.score", 0.9), ("a", 5, "stability.composite", 0.1), ("a", 2, "stability.composite", 0.9), ("a", 9, "other", 1.0)]
    signals = spark.createDataFrame(rows, "repo string, run int, metric string, value double")
    worse = spark.createDataFrame([("a", 2, 1), ("a", 5, 9)], "repo string, run int, n int")
    wanted = objectives.parsed(spark.createDataFrame([("debt",), ("metric:debt.score:min:0.4",)], "spec string"))
    got = {(r["repo"], r["run"], r["spec"]): r for r in objectives.scored(wanted, signals, worse, "repo").collect()}
    assert len(got) == 12 and [got["a", n, "debt"]["note"] for n in (1, 2, 3, 5, 9)] == ["baseline", "improved", "not improved", "improved, constraints failed", "improved"]
    assert got["a", 2, "debt"]["delta"] == -0.1 and got["a", 9, "debt"]["value"] == 0 and got["b", 1, "debt"]["previous"] is None
    assert [got["a", n, "metric:debt.score:min:0.4"]["reached"] for n in (1, 2, 5)] == [False, True, True] and not got["a", 2, "debt"]["reached"]
    strict = {r["run"]: r["constraints_ok"] for r in objectives.scored(wanted.limit(1), signals.filter("repo = 'a'"), worse, "repo", least_stability=0.5).collect()}
    assert strict == {1: False, 2: True, 3: False, 5: False, 9: False}
    assert objectives.scored(wanted, signals.limit(0), worse, "repo").count() == 0


def test_flags_of_changes(spark):
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "b"), ("d", "b")], "id string, parent string")
    leaves = spark.createDataFrame([("a", "x"), ("c", "y"), ("d", "y")], "id string, state string")
    got = {r["id"]: (r["reconstructed"], r["change"]) for r in trees.parsimony_flags(tree, leaves).collect()}
    assert got == {"r": ("x", False), "a": ("x", False), "b": ("y", True), "c": ("y", False), "d": ("y", False)}
    coded = leaves.union(spark.createDataFrame([("b", "x"), ("r", "x")], "id string, state string"))
    assert {r["id"] for r in trees.parsimony_flags(tree, coded).filter("change").collect()} == {"c", "d"}
