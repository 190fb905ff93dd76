import json

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import reports, risk
from tidemark.sources import logs


def test_traces_are_appended_and_read_again(spark, tmp_path):
    path = str(tmp_path / "traces")
    rows = spark.createDataFrame([("d1", "decision", ["a.py"], None), ("d2", "round", [], "ok")], "id string, kind string, paths array<string>, outcome string").withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    logs.append_traces(rows.limit(1), path)
    logs.append_traces(rows.filter("id = 'd2'"), path)
    got = {r["id"]: (r["kind"], r["paths"], r["outcome"]) for r in logs.traces(spark, path).collect()}
    assert got == {"d1": ("decision", ["a.py"], None), "d2": ("round", [], "ok")}


def test_reports_are_replaced(spark, tmp_path):
    path = str(tmp_path / "report")
    logs.write_report({"a": spark.range(3), "b": spark.range(2)}, path)
    logs.write_report({"a": spark.range(5)}, path)
    assert spark.read.parquet(f"{path}/a").count() == 5 and spark.read.parquet(f"{path}/b").count() == 2


def test_graphs_are_exported_with_axes(spark):
    nodes = spark.createDataFrame([("c1", "commit", 0), ("c2", "commit", 1), ("p", "path", 7)], "id string, kind string, seq int")
    edges = spark.createDataFrame([("c1", "c2", "parent_of"), ("c2", "p", "touches")], "source string, target string, rel string")
    n, e = logs.export_graph(nodes, edges)
    assert {r["id"]: (r["x"], r["y"]) for r in n.collect()} == {"c1": (0, 1), "c2": (1, 1), "p": (7, 2)} and {r["tag"] for r in e.collect()} == {"tree", "merge"}


def test_advisories_milestones_packages_and_tags(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"ghsa_id": "G1", "severity": "HIGH", "published_at": "2024-01-01T00:00:00Z"}, {"ghsa_id": "G2", "severity": None, "published_at": None}]))
    got = {r["label"]: (r["kind"], r["stage"], r["confidence"]) for r in logs.advisories(spark, str(tmp_path / "a.json")).collect()}
    assert got == {"G1": ("security", "disturbance", 0.92), "G2": ("security", "disturbance", 0.8)}
    (tmp_path / "m.json").write_text(json.dumps([{"title": "v1", "created_at": "2024-01-01T00:00:00Z", "due_on": None}]))
    assert tuple(logs.milestones(spark, str(tmp_path / "m.json")).select("span", "due").first()) == ("v1", None)
    manifests = spark.createDataFrame([("x/package.json", '{"dependencies": {"left": "1"}, "devDependencies": {"right": "2"}}'), ("requirements.txt", "Flask==2\n# no\n"), ("go.mod", "require host.io/a/b v1.2.3\n"), ("Cargo.toml", 'serde = "1"\n[deps]\n')], "path string, text string")
    assert {tuple(r) for r in logs.packages(manifests).collect()} == {("x/package.json", "left"), ("x/package.json", "right"), ("requirements.txt", "flask"), ("go.mod", "host.io/a/b"), ("Cargo.toml", "serde")}


def test_whole_source_files(spark, tmp_path):
    (tmp_path / "big.py").write_text("x = 1\n" * 100_000)
    assert logs.source_files(spark, str(tmp_path)).select(F.length("text")).first()[0] == 600_000 and logs.source_files(spark, str(tmp_path), most=10).select(F.length("text")).first()[0] == 10


def test_hotspot_points(spark):
    hot = spark.createDataFrame([(f"f{i}", 10 * i, 8 * i, i / 20) for i in range(1, 12)], "path string, touches int, complexity int, score double")
    degree = spark.createDataFrame([("f11", 40)], "path string, degree int")
    got = {r["path"]: r["severity"] for r in risk.hotspot_points(hot.select("path", "touches"), degree, F.lit(110), hot).collect()}
    assert set(got) == {f"f{i}" for i in range(4, 12)} and got["f11"] == 1.0
    import math

    assert abs(got["f4"] - (0.25 + 0.35 * math.log1p(40) / math.log1p(110) + 0.25 * min(1, 1.4 * 0.2 + 32 / 80))) < 1e-9


def test_tokens_of_questions(spark):
    row = spark.createDataFrame([("Who broke SRC/app.py in frame:H-1, a b?",)], "q string").select(T.graph_tokens(F.col("q")).alias("t")).first()
    assert row["t"] == ["who", "broke", "src/app.py", "in", "frame:h-1"]


def history(spark):
    rows = [(i, f"a{i % 3}", f"2023-{1 + i // 4:02d}-{1 + 7 * (i % 4):02d}", i % 9 == 0, 2, 10 + i % 7) for i in range(48)]
    commits = spark.createDataFrame(rows, "sha bigint, email string, day string, is_revert boolean, n_files bigint, churn bigint").withColumn("ts", F.to_timestamp("day")).withColumns({"author": F.col("email"), "insertions": F.col("churn"), "deletions": F.lit(0).cast("bigint"), "subject": F.lit("work")})
    return commits, spark.createDataFrame([(i, f"f{(i + k) % 5}", "k", "core", 5, 0) for i in range(48) for k in range(2)], "sha bigint, path string, clade string, layer string, insertions bigint, deletions bigint")


def test_reports_of_dynamics_and_ecology(spark):
    commits, files = history(spark)
    events = spark.createDataFrame([("v1", "2023-06-10")], "label string, at string").withColumn("at", F.to_timestamp("at"))
    segs = spark.createDataFrame([("2023-01-01", "2023-06-30", "growth", 0.7), ("2023-07-01", "2023-12-31", "maturity", 0.6)], "start string, end string, stage string, confidence double").withColumns({c: F.to_timestamp(c) for c in ("start", "end")})
    d = reports.dynamics(commits, events, segs)
    assert d["state_samples"].count() == 12 and {r["stage"]: r["months"] for r in d["basins"].collect()} == {"growth": 6, "maturity": 6} and d["impulse_responses"].first()["month"] == "2023-06"
    e = reports.ecology(commits, files)
    assert set(e) == {"stages", "growth", "trends", "changepoints"} and {r["id"] for r in e["trends"].collect()} == {"commits", "churn"} and e["stages"].count() == 5 and e["changepoints"].count() >= 0
