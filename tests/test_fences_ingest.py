import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fences
from tidemark.operators.graph import FAMILY_KINDS
from tidemark.streaming import ingest


def test_fences_widen_and_refuse(spark):
    edges = [("a.py", f"n{i:02d}.py", i + 1) for i in range(15)] + [("x/y.py", "a.py", 2), ("lone.py", "other.py", 1)]
    edits = [("e1", "a.py"), ("e1", "n14.py"), ("e2", "x/y.py"), ("e3", "none.py"), ("e4", "lone.py")]
    fence = [("e1", "n13.py"), ("e1", "a.py"), ("e4", "other.py")]
    risks = [("r1", "x", "hotspot_blast", 0.9), ("r2", "x/y.py/deep", "bus_factor", 2.9), ("r3", "zzz", "bus_factor", 9.0), ("r4", None, "smell", 1.0), ("r5", "", "smell", 1.0)]
    out = fences.fence_previews(
        spark.createDataFrame(edits, "edit string, path string"), spark.createDataFrame(edges, "a string, b string, weight int"), spark.createDataFrame(fence, "edit string, path string"),
        spark.createDataFrame(risks, "id string, path string, kind string, severity double"), spark.createDataFrame([("x/y.py", "blast.py", 0.5)], "path string, neighbor string, score double"),
    )
    got = {r["edit"]: r for r in out.collect()}
    # Twelve neighbors of a.py, those from n03 on; n14's only neighbor is a.py itself.
    assert got["e1"]["n_neighbors"] == 13 and got["e1"]["added"] == [f"n{i:02d}.py" for i in range(12, 6, -1)] and got["e1"]["refuse"] and got["e1"]["blast"] == 15
    assert got["e1"]["fence"] == ["a.py", "n13.py", *got["e1"]["added"]]
    assert got["e2"]["added"] == ["a.py", "x", "blast.py"] and got["e2"]["blast"] == pytest.approx(8.7) and not got["e2"]["refuse"] and got["e2"]["risk_ids"] == ["r1", "r2"]
    assert got["e3"]["fence"] == ["none.py"] and got["e3"]["blast"] == 0 and got["e4"]["added"] == [] and got["e4"]["fence"] == ["other.py"]


def pack_graph(spark):
    nodes = [("path:a", "path", "a.py", None, None), ("frame:1", "frame", "claim", None, None), ("d1", "decision", "last", 1.0, None), ("old", "decision", "closed", 1.0, "2020"), ("c1", "commit", "c", None, None), ("p1", "pivot", "propose", None, None),
             ("p2", "pivot", "verify", None, None), ("q1", "proposal", "q", None, None), ("rec", "record", "a falsifier", None, None), ("lone", "path", "far", None, None)] + [(f"frame:x{i}", "frame", "x", None, None) for i in range(20)]
    edges = [("c1", "path:a", "touches"), ("d1", "frame:1", "allowed_because"), ("d1", "path:a", "focuses"), ("q1", "p1", "joins"), ("old", "path:a", "overridden"), ("d1", "lone", "overridden")]
    return spark.createDataFrame(nodes, "id string, kind string, label string, age_hours double, valid_to string").withColumn("text", F.lit(None).cast("string")), spark.createDataFrame(edges, "source string, target string, rel string")


def test_coalition_packs(spark):
    nodes, edges = pack_graph(spark)
    hits = spark.createDataFrame([("d1", 0.9), ("old", 0.8), ("nowhere", 0.7)], "id string, score double")
    pack = fences.coalition_pack(nodes, edges, hits, path="a.py", frames=["1"], last="d1").orderBy("place").collect()
    ids = [r["id"] for r in pack]
    assert len(ids) == len(set(ids)) == 12 and ids[:2] == ["d1", "path:a"] and "old" not in ids and {"frame:1", "c1"} <= set(ids) and [r["place"] for r in pack] == list(range(1, 13))
    summary = fences.pack_summary(spark.createDataFrame(pack), edges, nodes).first()
    assert summary["stance"] == "support" and summary["decisions"] == ["d1"] and "d1" in summary["allowed_because"] and "lone" in summary["overridden"]
    few = nodes.filter("kind <> 'frame'")
    small = {r["id"]: r["source"] for r in fences.coalition_pack(few, edges, path="a.py").collect()}
    assert small["p1"] == small["q1"] == "propose" and small["rec"] == "knowledge" and "p2" not in small
    none = fences.coalition_pack(few.filter("kind = 'commit'"), edges, path="zzz")
    assert none.count() == 0 and fences.pack_summary(none, edges, nodes).first()["stance"] == "insufficient"


def traces(path, first, n):
    kinds = [k for ks in FAMILY_KINDS.values() for k in ks if k != "run"]
    begin = datetime(2024, 1, 1)
    with open(path, "w") as f:
        for i in range(first, first + n):
            refs = [{"id": f"path:{i % 3}", "kind": "path", "rel": "touches"}, {"id": f"t{i - 1}", "kind": "context", "rel": "precedes"}]
            f.write(json.dumps({"id": f"t{i}", "kind": kinds[i % len(kinds)], "at": (begin + timedelta(hours=i)).isoformat(), "run": f"r{i % 2}" if i % 7 else None, "label": f"l{i}", "refs": refs}) + "\n")


def rows(graph):
    return [sorted(map(tuple, df.collect()), key=str) for df in graph]


def test_a_killed_batch_runs_again_to_the_same_graph(spark, tmp_path):
    source = tmp_path / "traces"
    source.mkdir()
    for k in range(4):
        traces(source / f"{k}.json", 20 * k, 20)
    stream = lambda: spark.readStream.schema(ingest.TRACE).option("maxFilesPerTrigger", 1).json(str(source))
    ingest.start(stream(), str(tmp_path / "plain")).awaitTermination()
    want = rows(ingest.read_graph(spark, str(tmp_path / "plain")))

    def dies(df, k, path):
        if k == 2:
            ingest.projected(df)[0].write.mode("overwrite").parquet(f"{path}/nodes/batch={k}")
            raise RuntimeError("killed between nodes and edges")
        ingest.write_batch(df, k, path)

    path = str(tmp_path / "broken")
    with pytest.raises(Exception, match="killed"):
        ingest.start(stream(), path, dies).awaitTermination()
    ingest.start(stream(), path).awaitTermination()
    assert rows(ingest.read_graph(spark, path)) == want
    ingest.write_batch(spark.read.schema(ingest.TRACE).json(f"file://{source}/1.json"), 9, path)  # rows that come twice
    assert rows(ingest.read_graph(spark, path)) == want
    ingest.compact(spark, path, str(tmp_path / "small"))
    assert rows(ingest.read_graph(spark, str(tmp_path / "small"))) == want
    kinds = {r[1] for r in want[0]}
    assert kinds == {k for ks in FAMILY_KINDS.values() for k in ks}
    batch = ingest.projected(spark.read.schema(ingest.TRACE).json(str(source)))
    assert {r[2] for r in want[1]} == {r["rel"] for r in batch[1].select("rel").distinct().collect()} | {"next"}


def test_odd_traces(spark):
    odd = spark.createDataFrame([(None, "tool", None, "r", None, None, None), ("a", None, None, None, None, None, [(None, "x", "y"), ("b", "path", "touches")])], ingest.TRACE)
    nodes, edges = ingest.projected(odd)
    assert {(r["id"], r["kind"]) for r in nodes.collect()} == {("a", "context"), ("b", "path")} and [tuple(r) for r in edges.collect()] == [("a", "b", "touches")]
