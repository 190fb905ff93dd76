import pytest
from pyspark.sql import functions as F

from tidemark.operators import records
from tidemark.plans.record_queries import INPUTS

#: One small row of each table.
COLUMNS = {
    "clades": "clade string, label string, layer string", "path_types": "path string, clade string, code_type string", "allocations": "sha string, path string, clade string, at timestamp", "lineages": "path string, clade string, last_sha string, fitness double",
    "events": "kind string, label string, at timestamp, confidence double", "anchors": "kind string, label string, at timestamp, stage string, confidence double, series string, cp_at timestamp, direction string", "changepoints": "series string, at timestamp, direction string",
    "segments": "stage string, at timestamp, confidence double", "hypotheses": "id string, claim string, verdict string, confidence double", "experiments": "id string, claim string, branch string", "failure_points": "id string, path string, clade string, title string, severity double",
    "drift": "clade string, drift double", "signals": "name string, confidence double", "debt": "path string", "coupling": "a string, b string", "samples": "month string, at timestamp", "impulses": "kind string, label string, at timestamp, confidence double",
    "basins": "stage string, at timestamp, occupancy double", "episodes": "path string, clade string, first_sha string, last_sha string, at timestamp", "issues": "number int, title string, at timestamp", "pulls": "number int, title string, at timestamp",
    "report_deltas": "item string, direction string", "blast": "path string, score double", "symbols": "qualname string, path string", "cst": "path string, node string, window int", "cst_windows": "window int, at timestamp", "gene_flow": "a string, b string",
    "transfers": "sha string", "clones": "id string, path string", "forks": "hash string, path string", "reticulation": "a string, b string", "stage": "stage string, method string, confidence double", "branch_trends": "type_key string, trend string, churn int",
}


@pytest.fixture
def tables(spark):
    t = lambda day: F.to_timestamp(F.lit(day))
    values = {
        "clade": "k", "label": "v1", "layer": "core", "path": "a.py", "code_type": "ui/form", "sha": "0123456789abcdef", "last_sha": "s2", "first_sha": "s1", "fitness": 0.4, "kind": "release", "confidence": 0.7, "stage": "growth", "series": "churn", "direction": "up",
        "id": "x", "claim": "It grows", "verdict": "support", "branch": "ui/form", "title": "hot", "severity": 0.9, "drift": 0.1, "name": "selection_pressure", "a": "a.py", "b": "b.py", "month": "2024-01", "occupancy": 0.5, "number": 7, "item": "debt", "score": 0.3,
        "qualname": "f", "node": "call", "window": 1, "hash": "h", "method": "event", "type_key": "ui/form", "trend": "heating", "churn": 9,
    }
    out = {}
    for name, schema in COLUMNS.items():
        fields = [c.split() for c in schema.split(", ")]
        out[name] = spark.range(1).select(*[(t("2024-01-05") if kind == "timestamp" else F.lit(values[c]).cast(kind)).alias(c) for c, kind in fields])
    out["gene_flow"] = out["gene_flow"].withColumns({"a": F.lit("k"), "b": F.lit("k")})
    out["report_deltas"] = out["report_deltas"].withColumn("direction", F.lit("worsened"))
    return out


def test_the_tables_are_those_of_the_queries():
    assert set(records.KINDS) | {"stage", "branch_trends"} == set(INPUTS) == set(COLUMNS)


def test_all_kinds_ids_and_links(tables):
    rows = {r["id"]: r for r in records.records(tables).collect()}
    assert len(rows) == len(records.KINDS) + 1
    kinds = {r["kind"] for r in rows.values()}
    assert kinds == {k.kind for k in records.KINDS.values()} | {"trajectory"} and len(kinds) == 27
    assert {"delta:0123456789:a.py", "event:release:v1:2024-01-05", "cp:churn:2024-01-05:up", "anchor:v1:growth", "hgt:0123456789abcdef", "issue:7:hot", "pr:7:hot", "state:2024-01", "delta:worsened:debt"} <= set(rows)
    assert [tuple(x) for x in rows["anchor:v1:growth"]["links"]] == [("event:release:v1:2024-01-05", "lifecycle_event", "supports"), ("cp:churn:2024-01-05:up", "changepoint", "supports")]
    assert [x["record_id"] for x in rows["sym:f"]["links"]] == ["lineage:a.py", "blast:a.py"] and rows["trajectory:global"]["tags"] == ["dynamics", "trajectory", "insufficient"]
    for r in rows.values():  # every link leads to a record of its kind, b.py's lineage apart
        assert all(x["record_id"] == "lineage:b.py" or rows[x["record_id"]]["kind"] == x["kind"] for x in r["links"]), r


def test_missing_parts_make_no_links_and_long_ids_are_cut(spark):
    alloc = spark.createDataFrame([("s", "p" * 300, None), (None, "q", "")], "sha string, path string, clade string").withColumn("at", F.lit(None).cast("timestamp"))
    rows = records.records({"allocations": alloc}).collect()
    assert [len(r["id"]) for r in rows] == [160, len("delta:q")] and all(r["links"] == [] for r in rows)


def test_nine_kinds_of_frames(tables):
    ledger = records.records(tables)
    frames = {r["id"]: r for r in records.claim_frames(tables, ledger).collect()}
    assert [f["id"] for f in sorted(frames.values(), key=lambda r: r["place"])] == ["frame:stage", "frame:basin", "frame:x", "frame:exp:x", "frame:risk:x", "frame:branch:ui/form", "frame:response:v1", "frame:delta:report", "frame:selection"]
    seen = lambda i: [(e["record_id"], e["role"]) for e in frames[i]["evidence"]]
    assert seen("frame:risk:x") == [("fp:x:a.py", "supports"), ("lineage:a.py", "context"), ("clade:k", "context"), ("blast:a.py", "measures"), ("sym:f", "context"), ("cst:a.py:call:1", "measures")]
    assert seen("frame:stage")[:3] == [("anchor:v1:growth", "supports"), ("seg:growth:2024-01-05", "supports"), ("trajectory:global", "measures")]
    assert frames["frame:stage"]["stance"] == "support" and frames["frame:basin"]["stance"] == "insufficient" and frames["frame:risk:x"]["confidence"] == 0.6
    assert seen("frame:branch:ui/form") == [("code_type:a.py", "supports"), ("clade:k", "supports"), ("delta:0123456789:a.py", "supports")] and frames["frame:branch:ui/form"]["confidence"] == 0.55
    assert seen("frame:exp:x") == [("exp:x", "measures"), ("code_type:a.py", "context")] and frames["frame:delta:report"]["stance"] == "risk"
    assert seen("frame:selection") == [("signal:selection_pressure", "supports"), ("issue:7:hot", "context")] and frames["frame:selection"]["stance"] == "risk"


def test_evidence_and_frames_are_bounded_and_distinct(tables, spark):
    tables["symbols"] = spark.range(40).select(F.concat(F.lit("f"), "id").alias("qualname"), F.lit("a.py").alias("path"))
    tables["failure_points"] = spark.range(80).select(F.concat(F.lit("r"), F.floor(F.col("id") / 2)).alias("id"), F.lit("a.py").alias("path"), F.lit("k").alias("clade"), F.lit(None).cast("string").alias("title"), F.lit(0.1).alias("severity"))
    tables["hypotheses"] = spark.createDataFrame([("lehman_1", "l", None, None), ("stage_1", "s", "weak", 0.2)], "id string, claim string, verdict string, confidence double")
    out = records.claim_frames(tables, records.records(tables)).collect()
    assert len(out) == len({r["id"] for r in out}) == 49 and all(len(r["evidence"]) <= 10 or r["id"] == "frame:stage" for r in out)
    by = {r["id"]: r for r in out}
    assert by["frame:risk:r3"]["claim"] == "r3" and by["frame:risk:r3"]["confidence"] == 0.45 and by["frame:lehman_1"]["stance"] == "open"
    assert {e["kind"] for e in by["frame:lehman_1"]["evidence"]} == {"hypothesis", "changepoint"} and {e["kind"] for e in by["frame:stage_1"]["evidence"]} == {"hypothesis", "stage_segment", "lifecycle_event"}
    assert len(records.claim_frames(tables, records.records(tables), 5).collect()) == 5


def test_path_packs_hold_a_paths_records(tables):
    ledger = records.records(tables)
    packs = {r["path"]: r for r in records.path_packs(ledger, records.claim_frames(tables, ledger)).collect()}
    a = packs["a.py"]
    assert a["clade"] == "k" and a["lineage"] == ["lineage:a.py"] and a["blast"] == ["blast:a.py"] and a["symbols"] == ["sym:f"] and a["deltas"] == ["delta:0123456789:a.py"] and a["risks"] == ["fp:x:a.py"]
    assert set(a["graph_links"]) == {"couple:a.py:b.py", "ret:a.py:b.py", "clone:x", "fork:h"} and set(a["timeline"]) == {"delta:0123456789:a.py", "episode:a.py:s1:s2"}
    assert set(packs["b.py"]["graph_links"]) == {"couple:a.py:b.py", "ret:a.py:b.py"} and packs["b.py"]["clade"] is None
    assert {"frame:risk:x", "frame:exp:x", "frame:branch:ui/form"} <= set(a["frames"])


def test_empty_tables(tables):
    none = {k: v.limit(0) for k, v in tables.items()}
    ledger = records.records(none)
    assert ledger.count() == 0 and records.claim_frames(none, ledger).count() == 0 and records.path_packs(ledger).count() == 0


def test_records_by_path_tag_and_time(tables):
    ledger = records.records(tables)
    ids = lambda **k: {r["id"] for r in records.select_records(ledger, **k).collect()}
    assert ids(tag="genetics") == {"flow:k:k", "hgt:0123456789abcdef", "clone:x", "fork:h", "ret:a.py:b.py"} and ids(clade="micro") == {"sym:f", "cst:a.py:call:1", "cstwin:1"}
    assert ids(clade="k", kinds=["lineage", "clade"]) == {"clade:k", "lineage:a.py"} and "delta:0123456789:a.py" in ids(path="a.py") and "lineage:a.py" in ids(since="2025-01-01") and "delta:0123456789:a.py" not in ids(since="2025-01-01")
    assert len(ids()) == len(records.KINDS) + 1


def test_frames_by_key_and_focus(tables, spark):
    ledger = records.records(tables)
    frames = records.claim_frames(tables, ledger)
    keys = spark.createDataFrame([("frame:stage",), ("exp:x",), ("response",), ("nothing",)], "key string")
    assert {r["key"]: r["id"] for r in records.find_frames(frames, keys).collect()} == {"frame:stage": "frame:stage", "exp:x": "frame:exp:x", "response": "frame:response:v1"}
    assert {r["id"] for r in records.frames_on(frames, ledger, path="a.py").collect()} == {"frame:risk:x", "frame:exp:x", "frame:branch:ui/form"}
    assert records.frames_on(frames, ledger, path="nowhere").count() == frames.count() and records.frames_on(frames, ledger, path="nowhere", most=2).count() == 2
    assert records.find_frames(frames.limit(0), keys).count() == 0
