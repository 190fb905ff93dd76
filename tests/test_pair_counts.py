import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coupling
from tidemark.operators.graph import cut


@pytest.fixture
def small_runs(monkeypatch):
    """Runs and tasks so small that keys are cut into runs and pairs into rounds."""
    for name, value in (("RUN", 16), ("HELD", 500), ("ROUND", 2)):
        monkeypatch.setattr(coupling, name, value)


def held(items):
    sets = {}
    for k, v in items:
        if k is not None and v is not None:
            sets.setdefault(k, set()).add(v)
    return Counter(p for s in sets.values() for p in combinations(sorted(s), 2))


def test_pair_counts_equal_all_pairs(spark, small_runs):
    rng = random.Random(5)
    items = [(f"k{k}", f"p{rng.randrange(40):03}") for k in range(60) for _ in range(rng.randrange(0, 9))]
    items += [("hot", f"p{i:03}") for i in range(90)] + [(f"h{k}", f"é{i}") for k in range(3) for i in range(33)] + [(None, "p001"), ("k1", None)]
    frame, want = spark.createDataFrame(items, "k string, v string"), held(items)
    assert {(r["a"], r["b"]): r["n"] for r in coupling.pair_counts(frame, "k", "v").collect()} == dict(want)
    assert {(r["a"], r["b"]): r["n"] for r in coupling.pair_counts(frame, "k", "v", 2).collect()} == {p: n for p, n in want.items() if n >= 2}
    assert {r["v"]: r["n"] for r in coupling.partner_counts(frame, "k", "v").collect()} == dict(Counter(x for p in want for x in p))
    assert coupling.pair_counts(frame.limit(0), "k", "v").count() == 0 and coupling.partner_counts(frame.limit(0), "k", "v").count() == 0


def test_one_file_of_many_tickets_is_summed_over_what_a_task_holds(spark, small_runs):
    items = [(k, v) for k in range(700) for v in ("a", f"b{k % 3}", f"c{k}")]
    got = {(r["a"], r["b"]): r["n"] for r in coupling.pair_counts(spark.createDataFrame(items, "k int, v string"), "k", "v", 2).collect()}
    assert got == {p: n for p, n in held(items).items() if n >= 2} and got["a", "b0"] == 234


def test_cut_leaves_no_shuffle_files(spark):
    known = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = known()
    rows = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert known() <= before and rows.count() == 7


def test_path_packs_shuffle_their_records_once(spark):
    from tidemark.operators import records

    rows = spark.createDataFrame([("a:1", "symbol", None, "p", "k", []), ("b", "signal", None, None, "k", [])], f"id string, kind string, at timestamp, path string, clade string, links {records._LINKS}")
    packs = records.path_packs(rows)
    assert [(r["path"], r["clade"], r["symbols"]) for r in packs.collect()] == [("p", "k", ["a:1"])]
    plan = packs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(path") <= 2
