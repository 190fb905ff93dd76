import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators.risk import selection_pressure
from tidemark.sources import logs
from tidemark.streaming import jobs


def test_commit_log(spark, tmp_path):
    rec = ["\x1f".join(["aaaaaaa1", "bbbbbbb2 ccccccc3", "Ann", "a@x", "2024-01-02T23:30:00+05:00", "Revert \"x\"", "This reverts commit ddddddd4.\n"]), "short\x1fx", "\x1f".join(["eeeeeee5", "", "Bo", "b@x", "2023-01-01T00:00:00Z", "work", ""])]
    (tmp_path / "log.txt").write_text("\x1e".join(rec) + "\x1e")
    rows = logs.commit_log(spark, str(tmp_path / "log.txt")).orderBy("sha").collect()
    assert [(r["sha"], r["parents"], r["is_revert"], r["reverts_sha"]) for r in rows] == [("aaaaaaa1", ["bbbbbbb2", "ccccccc3"], True, "ddddddd4"), ("eeeeeee5", [], False, None)]
    assert rows[0]["ts_local"].hour == 23 and rows[0]["ts"].hour == 18
    assert logs.commit_log(spark, str(tmp_path / "log.txt"), since="2023-06-01").count() == 1


def test_change_stats(spark):
    df = spark.createDataFrame([("a", "3\t1\tsrc/{x => y}/f.py"), ("a", "-\t-\tlogo.png"), ("a", "noise")], "sha string, value string")
    assert sorted(tuple(r) for r in logs.change_stats(df).collect()) == [("a", "logo.png", None, 0, 0), ("a", "src/y/f.py", "src/x/f.py", 3, 1)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"number": 1, "title": "Reopen it", "state": "open", "labels": [{"name": "Bug"}]}, {"number": 2, "title": "x", "state": "closed", "pull_request": {"url": "u"}, "merged_at": "2024-01-01T00:00:00Z"}]))
    one = selection_pressure(logs.issues(spark, str(tmp_path / "i.json"))).first()
    assert (one["open"], one["closed"], one["bugs"], one["pulls"], one["merged"]) == (1, 0, 1, 1, 1) and abs(one["score"] - 0.9) < 1e-12
    (tmp_path / "t.jsonl").write_text('{"id": "d1", "kind": "decision", "at": "2024-01-01T00:00:00Z"}\nnot json\n')
    assert [r["id"] for r in logs.traces(spark, str(tmp_path / "t.jsonl")).collect()] == ["d1"]
    (tmp_path / "tags").write_text("v1.0.0|2024-01-01T00:00:00Z|first\nv1.0.1|2024-02-01T00:00:00Z|security fix\n")
    assert [r["kind"] for r in logs.tags(spark, str(tmp_path / "tags")).orderBy("label").collect()] == ["major_release", "security"]


def test_files_and_packages(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("print(1)")
    (tmp_path / "node_modules/b.js").write_text("x")
    assert [r["text"] for r in logs.source_files(spark, str(tmp_path)).collect()] == ["print(1)"]
    m = spark.createDataFrame([("x/requirements.txt", "Flask==1\n# no\nnumpy>=2"), ("x/package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}'), ("x/go.mod", "require (\n\tgithub.com/a/b v1.2\n)")], "path string, text string")
    assert {r["package"] for r in logs.packages(m).collect()} == {"flask", "numpy", "react", "vite", "github.com/a/b"}


def test_trace_replay_drops_repeats(spark, tmp_path):
    row = {"id": "d1", "kind": "decision", "at": "2024-01-01T00:00:00Z", "paths": ["a"], "frames": [], "outcome": "ok"}
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.json").write_text(json.dumps(row) + "\n")
    stream = spark.readStream.schema(logs.TRACES).json(str(tmp_path / "in"))
    got = []
    run = jobs.replay(stream, lambda nodes, edges: got.extend((nodes.count(), edges.count()) for _ in range(1))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(n for n, _ in got) == 1 and sum(e for _, e in got) == 1


def test_weekly_batch_equals_calendar_weeks(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0), 1.0), (datetime(2024, 1, 7, 23, 59), 2.0), (datetime(2024, 1, 8, 0, 0), 4.0)], "ts timestamp, churn double")
    got = jobs.weekly(df).select(F.date_format("week", "yyyy-MM-dd").alias("w"), "n", "churn").orderBy("w").collect()
    assert [tuple(r) for r in got] == [("2024-01-01", 2, 3.0), ("2024-01-08", 1, 4.0)]
