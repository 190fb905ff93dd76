from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import lineage, reports, series, traces
from tidemark.plans import QUERIES, SQL


def test_rename_chains_end_at_the_last_name(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "old string, new string")
    assert {x["path"]: x["name"] for x in lineage.final_names(r).collect()} == {"a": "c", "b": "c", "x": "y"}
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "z")], "sha int, path string")
    commits = spark.createDataFrame([(i, datetime(2024, 1, i)) for i in range(1, 5)], "sha int, ts timestamp")
    got = {x["name"]: x for x in lineage.lineages(files, commits, r).collect()}
    assert (got["c"]["touches"], got["c"]["first"], got["c"]["last"], got["c"]["prior"]) == (3, 1, 3, ["a", "b"]) and got["z"]["prior"] == []


def test_parents_by_prefix(spark):
    c = spark.createDataFrame([("abcdef1234",), ("ffffff0000",)], "sha string")
    links = spark.createDataFrame([("x", "abcdef1"), ("y", "ffffff0000"), ("z", "nothing")], "sha string, named string")
    assert {r["sha"]: r["parent"] for r in lineage.resolve_parents(links, c).collect()} == {"x": "abcdef1234", "y": "ffffff0000", "z": None}


def test_logs_notes_and_scores(spark):
    logs = spark.createDataFrame([("r", True, "== 12 passed, 1 failed ==\nTOTAL 100 20 80%")], "run string, ok boolean, text string")
    got = traces.test_score(logs).first()
    assert (got["passed"], got["failed"], got["coverage"]) == (12, 1, 0.8) and abs(got["score"] - (1 + 0.24 - 0.1 + 0.8)) < 1e-9
    notes = spark.createDataFrame([("o", 1, "a  b"), ("o", 2, "A b"), ("o", 3, " ")], "owner string, at int, text string")
    assert [r["text"] for r in traces.compact_notes(notes).collect()] == ["a b"]
    one = spark.range(1)
    assert one.select(traces.hypothesis_confidence(F.lit(80), F.lit(0.0)).alias("x")).first()["x"] == 0.8
    assert abs(one.select(traces.memory_score(F.lit(0.0), F.lit(0.5), F.lit(1.0), F.lit(True), F.lit(True)).alias("x")).first()["x"] - 0.5 * 1.25 * 1.05) < 1e-12


def test_outcomes(spark):
    df = spark.createDataFrame([(True, True, True, False), (True, True, False, False), (False, False, False, False), (True, True, True, True), (False, True, False, False)], "a boolean, p boolean, i boolean, r boolean")
    got = [r["o"] for r in df.select(traces.round_outcome(F.col("a"), F.col("p"), F.col("i"), F.col("r")).alias("o")).collect()]
    assert got == ["improved", "accepted_no_delta", "no_apply", "rolled_back", "none"]


def test_calibrated_stages_and_frames(spark):
    ts = lambda c: F.to_timestamp(c)
    seg = spark.createDataFrame([("2024-01-01", "2024-06-01", "growth", 0.7)], "start string, end string, stage string, confidence double").withColumns({"start": ts("start"), "end": ts("end")})
    anchors = spark.createDataFrame([("2024-07-01", "maturity", 0.8)], "at string, stage string, confidence double").withColumn("at", ts("at"))
    at = lambda d, r=0.0: tuple(reports.calibrated_stage(seg, anchors, F.to_timestamp(F.lit(d)), F.lit("decline"), F.lit(r)).first())
    assert at("2024-03-01") == ("growth", "segment") and at("2024-08-01") == ("maturity", "anchor") and at("2030-01-01") == ("decline", "heuristic") and at("2024-03-01", 0.5) == ("disturbance", "reverts")
    commits = spark.createDataFrame([("abcdef123", "K1"), ("zzz", "K2")], "sha string, clade string")
    frames = spark.createDataFrame([("f1", "about abcdef1", []), ("f2", "none", ["K2"])], "id string, claim string, clades array<string>")
    assert {tuple(r) for r in reports.frames_of_commits(commits, frames).collect()} == {("abcdef123", "f1"), ("zzz", "f2")}


def test_chains_are_left_out_of_drawings(spark):
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("d", "b")], "id string, parent string")
    kinds = spark.createDataFrame([(x, "k") for x in "rabcd"], "id string, kind string")
    assert {r["id"] for r in lineage.collapse_chains(tree, kinds).collect() if r["hidden"]} == {"a"}


def test_sql_functions_and_reports(spark):
    T.register(spark)
    row = spark.sql("select layer_of('src/tests/a') as l, layer_of('zz') as o, tokenize('Ab abc_d') as t, soft_inv(1.0, 1.0) as s, hash_sign('x') as g, hash_idx('x', 64) as i").first()
    want = spark.range(1).select(T.hash_sign(F.lit("x")).alias("g"), T.hash_index(F.lit("x")).alias("i")).first()
    assert (row["l"], row["o"], row["t"], row["s"]) == ("tests", "other", ["abc_d"], 0.5) and (row["g"], row["i"]) == (want["g"], want["i"])
    ev = spark.createDataFrame([("s", 20, [1.0, 0.6]), ("t", 3, [1.0])], "signal string, n int, parts array<double>")
    assert {r["signal"]: r["grade"] for r in reports.signal_confidence(ev).collect()} == {"s": "high", "t": "insufficient"}


def test_every_query_is_named_once_and_checked():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 80


def test_stream_finds_the_same_storms_as_the_batch(spark):
    sf = "/root/testdata/sf0.001"
    batch = series.storms(spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("repo"), F.col("ts").cast("timestamp").alias("ts")))
    want = sorted((r["repo"], r["n"]) for r in batch.collect())
    assert want and sorted((r["repo"], r["n"]) for r in QUERIES["storm_stream"](spark, sf).collect()) == want
