"""Crossings, reflections, experiments, checks and labels, on small tables and against a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import labels, reviews, risk
from tidemark.plans import QUERIES

D = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_crossings_of_empty_and_null_states(spark):
    none = spark.createDataFrame([], "id string, kind string, label string")
    one = spark.createDataFrame([("t1", "type", "a"), ("t2", "type", None), ("f1", "frame", "support")], "id string, kind string, label string")
    two = spark.createDataFrame([("t1", "type", "b"), ("t2", "type", None), ("f1", "frame", "")], "id string, kind string, label string")
    null = spark.createDataFrame([(None, None, None)], "stage string, debt double, risks int")
    state = spark.createDataFrame([("growth", 0.5, 3)], "stage string, debt double, risks int")
    later = spark.createDataFrame([("growth", 0.9, 3)], "stage string, debt double, risks int")
    assert _rows(reviews.delta_events(none, one, null, state)) == [("nodes_added", "delta:nodes", 0.075), ("type_added", "t1", 0.45), ("type_added", "t2", 0.45)]
    assert _rows(reviews.delta_events(one, none, state, null))[0] == ("nodes_removed", "delta:nodes", 0.075)
    assert _rows(reviews.delta_events(one, two, state, later)) == [("debt_crossed", "context:debt", 1.0), ("type_changed", "t1", 0.55)]
    assert _rows(reviews.delta_events(none, none, null, null)) == []


def test_reflections_of_failed_rounds_are_merged_once(spark):
    rounds = spark.createDataFrame([(1, False, None, ["f"]), (2, True, "Rollback of all", []), (3, None, None, ["g"]), (4, True, "fine", None)], "index bigint, verify_ok boolean, notes string, frames array<string>")
    nodes, edges = reviews.failure_reflections(rounds)
    assert _rows(edges) == [("reflect:fail:1", "decision:1", "overridden"), ("reflect:fail:1", "frame:f", "falsified_by"), ("reflect:fail:2", "decision:2", "overridden")]
    assert {r["id"]: r["text"] for r in nodes.collect() if r["kind"] == "reflection"} == {"reflect:fail:1": "verify/rollback failure", "reflect:fail:2": "Rollback of all"}
    host = nodes.filter("id = 'decision:1'"), edges.filter("false")
    once = reviews.merge_reflections(host, (nodes, edges))
    again = reviews.merge_reflections(once, (nodes, edges))
    for got in (once, again):
        assert sorted(r["id"] for r in got[0].collect()) == ["decision:1", "decision:2", "frame:f", "reflect:fail:1", "reflect:fail:2"]
        assert got[1].count() == 3


def test_experiments_fall_back_to_watching(spark):
    empty = lambda s: spark.createDataFrame([], s)
    calm = (empty("type_key string, trend string, delta bigint"), empty("id string, trend string"), spark.createDataFrame([("maturity",)], "stage string"), empty("id string, magnitude double"), empty("kind string, label string, at timestamp"))
    assert _rows(reviews.next_experiments(*calm)) == [(1, "baseline_monitor", None)]
    hot = spark.createDataFrame([(k, "heating", n) for k, n in (("a", 5), ("b", 9), ("c", 9), ("d", 1))], "type_key string, trend string, delta bigint")
    assert _rows(reviews.next_experiments(hot, *calm[1:])) == [(1, "heat_1", "b"), (2, "heat_2", "c"), (3, "heat_3", "a")]


def test_checks_without_any_evidence(spark):
    empty = lambda s: spark.createDataFrame([], s)
    got = reviews.dynamics_checks(empty("month string"), empty("kind string, at timestamp, path string"), empty("id string"), empty("kind string, label string"), empty("id string"), empty("stage string"))
    assert {(r["case"], r["check"]) for r in got.filter("ok").collect()} == {("trajectory", "pack_schema")} and got.count() == 15


def test_scores_that_are_null_make_no_point(spark):
    cols = "repo string, prod_touches int, test_touches int, dependency_rate double, fragility double, mastery_drop double, fatigue double, load_index double, pressure double"
    got = risk.log_points(spark.createDataFrame([("a", None, 0, None, None, None, None, None, None), ("b", 21, 5, 0.5, 0.4, 0.35, 0.9, 0.5, 0.3)], cols), "repo")
    assert {(r["repo"], r["kind"], round(r["severity"], 6)) for r in got.collect()} == {
        ("b", "test_gap", 0.7), ("b", "dependency_shock", 1.0), ("b", "dependency_fragility", 0.75), ("b", "offboarding_risk", 0.75), ("b", "sprint_fatigue", 1.0), ("b", "cognitive_load", 0.85)
    }


def test_file_words_with_and_without_limits(spark):
    files = spark.createDataFrame([("src/AppMain.py", "# say hello\nrun_it(foo)\n  // twice more"), ("x", None)], "path string, text string")
    types = spark.createDataFrame([("src/AppMain.py", ["code", "main"])], "path string, type_path array<string>")
    got = dict(map(tuple, labels.file_documents(files, types).collect()))
    assert got["src/AppMain.py"] == "file src AppMain.py type code main modules src app main py symbols say hello run_it foo twice more notes say hello twice more"
    assert got["x"].split() == ["file", "x", "type", "modules", "symbols", "notes"]
    assert dict(map(tuple, labels.file_documents(files, types, 2, 1).collect()))["src/AppMain.py"].endswith("symbols say hello notes say")


def test_guidance_without_evidence_layer_or_label(spark):
    clades = spark.createDataFrame([("a", None, None, None), ("b", "B", "docs", ""), ("c", "C", "odd", "x/y")], "clade string, label string, layer string, code_type string")
    said = spark.createDataFrame([("b", "an Assert"), ("b", None), ("c", "see the README")], "clade string, text string")
    got = {r["clade"]: (r["label"], r["role"], r["layer"]) for r in labels.guidance(clades, said).collect()}
    assert got["a"] == ("other:a", labels.ROLES["other"], "other")
    assert got["b"] == ("tests:B", labels.TESTED + " [rag:2 chunks]", "tests")
    assert got["c"] == ("docs:x/y", labels.ROLES["other"] + "; typed as x/y [rag:1 chunks]", "docs")


def test_niche_labels_equal_a_plain_version(spark):
    docs = pd.read_parquet(f"{D}/documents.parquet")[["doc_id", "source", "text"]].fillna({"text": ""})
    word = re.compile("[a-z_][a-z0-9_]{2,}")
    split = {i: word.findall(t.lower()) for i, t in zip(docs["doc_id"], docs["text"])}
    every = sorted({w for ws in split.values() for w in ws})
    w = spark.createDataFrame([(x,) for x in every], "w string").select("w", T.hash_index(F.col("w"), 64).alias("i"), T.hash_sign(F.col("w")).alias("s"))
    place = {r["w"]: (r["i"], r["s"]) for r in w.collect()}

    def vector(words):
        v = np.zeros(64)
        for x in words:
            v[place[x][0]] += place[x][1]
        n = np.linalg.norm(v)
        return v / n if n else v

    held = defaultdict(list)
    for i, s in zip(docs["doc_id"], docs["source"]):
        held[s].append(i)
    want = {}
    for niche, ids in held.items():
        counts = Counter(x for i in ids for x in split[i])
        terms = [t for t, _n in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:24] if t not in labels.STOP][:12]
        phrases = terms[:10] + ["/".join(terms[:2]), "/".join(terms[:3])]
        full = [v for v in (vector(split[i]) for i in ids) if v.any()]
        mean = np.mean(full, axis=0)
        scores = [round(float(vector(word.findall(p)) @ mean / np.linalg.norm(mean)), 9) for p in phrases]
        want[niche] = phrases[int(np.argmax(scores))], max(scores)
    got = {r["niche"]: (r["label"], r["score"]) for r in QUERIES["niche_labels"](spark, D).collect()}
    assert got.keys() == want.keys()
    for niche, (label, score) in want.items():
        assert abs(got[niche][1] - score) < 1e-6, niche
        assert got[niche][0] == label, niche
