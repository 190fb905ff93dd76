from pyspark.sql import functions as F

from tidemark.operators import graph, reviews, risk


def small(spark):
    nodes = spark.createDataFrame([("a", "path", "alpha", None, 1), ("b", "commit", "beta", None, 2), ("c", "path", "gamma", None, 3), ("d", "frame", "delta", None, 4), ("e", "path", "alpha two", None, 5)], "id string, kind string, label string, text string, seq int")
    edges = spark.createDataFrame([("b", "a", "touches"), ("b", "c", "touches"), ("b", "c", "cites"), ("c", "d", "cites"), ("d", "e", "cites"), ("e", "e", "next"), ("a", "zz", "touches")], "source string, target string, rel string")
    return nodes, edges


def test_expansion_says_how_it_came(spark):
    nodes, edges = small(spark)
    seed = spark.createDataFrame([("a",), ("nowhere",)], "id string")
    got = lambda **k: {r["id"]: tuple(r)[1:] for r in graph.expand(nodes, edges, seed, **k).collect()}
    assert got(depth=9) == {"a": (0, None, None), "b": (1, "a", "touches"), "c": (2, "b", "cites"), "d": (3, "c", "cites"), "e": (4, "d", "cites")}
    assert set(got(depth=2)) == {"a", "b", "c"} and set(got(depth=9, directed=True)) == {"a"}
    assert got(depth=9, rels=["touches"]) == {"a": (0, None, None), "b": (1, "a", "touches"), "c": (2, "b", "touches")}
    assert set(got(depth=9, kinds=["path"])) == {"a"} and set(got(depth=9, family="taxon")) == {"a", "b", "c"}
    n, e = graph.induced(nodes, edges, spark.createDataFrame([("b",), ("c",), ("b",)], "id string"))
    assert {r["id"] for r in n.collect()} == {"b", "c"} and sorted(tuple(r) for r in e.collect()) == [("b", "c", "cites"), ("b", "c", "touches")]


def test_search_lends_its_neighbors(spark):
    nodes, edges = small(spark)
    got = {r["id"]: r["score"] for r in graph.search_near(nodes, edges, ["alpha"], 1).collect()}
    assert got["a"] == got["e"] and abs(got["a"] - (1.2 + 0.4)) < 1e-12 and got["b"] == got["d"] == 0.2 and "c" not in got
    assert graph.search_near(nodes, edges, ["nothing"]).count() == 0


def test_questions_of_several_modes(spark):
    nodes, edges = small(spark)
    state = spark.createDataFrame([("growth", 0.1, 3)], "stage string, debt double, risks int")
    later = spark.createDataFrame([("decline", 0.9, 9)], "stage string, debt double, risks int")
    out = reviews.query_context(nodes, edges, search=["alpha"], traverse=spark.createDataFrame([("a",)], "id string"), previous=(nodes.filter("id <> 'd'"), state, later), depth=1).collect()
    assert {r["mode"] for r in out} == {"search", "traverse", "delta"} and {r["id"] for r in out if r["mode"] == "traverse"} == {"a", "b"}
    assert all(0 < r["score"] <= 1.2 for r in out)


def test_gates_with_test_runs(spark):
    gates = spark.createDataFrame([(i, i != "bad", "" if i != "bad" else "stability", "w") for i in ("none", "ok", "failed", "less", "missing", "bad")], "run string, passed boolean, failures string, warnings string")
    tests = spark.createDataFrame([("ok", True, 0.8, 0.8), ("failed", False, 0.9, None), ("less", True, 0.7, 0.8), ("missing", True, None, 0.8), ("bad", None, 0.8, 0.1)], "run string, ok boolean, coverage double, previous_coverage double")
    got = {r["run"]: (r["passed"], r["failures"]) for r in risk.gate_with_tests(gates, tests, "run", require_coverage=True).collect()}
    assert got == {"none": (True, ""), "ok": (True, ""), "failed": (False, "tests"), "less": (False, "coverage"), "missing": (False, "coverage_missing"), "bad": (False, "stability,tests")}
    one = risk.gate_with_tests(gates.filter("run = 'ok'").drop("run"), tests.filter("run = 'less'").drop("run")).first()
    assert (one["passed"], one["failures"], one["warnings"]) == (False, "coverage", "w")
    assert risk.gate_with_tests(gates, tests.withColumn("coverage", F.lit(None).cast("double")), "run").filter("run = 'missing'").first()["passed"]
