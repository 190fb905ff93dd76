import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees


def forest(rng, n, kind):
    """(id, parent) of a random forest; ids in no useful order."""
    names = [f"n{i:05d}" for i in rng.sample(range(n * 3), n)]
    up = []
    for i in range(n):
        if i == 0 or (kind == "forest" and rng.random() < 0.1):
            up.append(None)
        elif kind == "chain" or (kind == "comb" and i % 2):
            up.append(names[i - 1] if kind == "chain" or i < 2 else names[i - 2])
        elif kind == "comb":
            up.append(names[i - 1])
        else:
            up.append(names[rng.randrange(max(0, i - 5), i) if kind == "deep" else rng.randrange(i)])
    return list(zip(names, up, strict=True))


def plain_tour(rows, order=None, shown=None):
    kids = {}
    for i, p in rows:
        kids.setdefault(p, []).append(i)
    out = {}
    for root in kids.get(None, []):
        seen, stack = [], [(root, 0)]
        while stack:
            i, d = stack.pop()
            seen.append((i, d))
            stack += [(k, d + 1) for k in sorted(kids.get(i, []), key=lambda k: ((order or {}).get(k, 0), k), reverse=True)]
        below = {}
        for i, _ in reversed(seen):
            below[i] = 1 + sum(below[k] for k in kids.get(i, []))
        n = 0
        for place, (i, d) in enumerate(seen):
            out[i] = (root, d, place, below[i], n)
            n += shown is None or shown[i]
    return out


def plain_fitch(rows, states):
    kids, parent, sets, steps, got = {}, dict(rows), {}, {}, {}
    for i, p in rows:
        kids.setdefault(p, []).append(i)
    order = list(kids.get(None, []))
    for i in order:
        order += kids.get(i, [])
    for i in reversed(order):
        known = [sets[k] for k in kids.get(i, []) if sets[k]]
        own = {states[i]} if states.get(i) else set()
        common = reduce(set.intersection, known) if known else own
        sets[i], steps[i] = (common, 0) if common or not known else (set.union(*known), 1)
    for i in order:
        if not sets[i]:
            got[i] = states.get(i) or "?"
        elif got.get(parent[i]) in sets[i]:
            got[i] = got[parent[i]]
        else:
            got[i] = states[i] if states.get(i) in sets[i] else min(sets[i])
    return {i: (tuple(sorted(sets[i])), steps[i], got[i]) for i in order}


def shift(rows, k):
    return [(f"{k}.{i}", p and f"{k}.{p}") for i, p in rows]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 3)


def test_places_ranks_and_visible_ancestors(spark):
    rng, rows = random.Random(3), []
    for k, kind in enumerate(("forest", "bush", "deep", "chain", "comb") * 6):
        rows += shift(forest(rng, rng.randrange(1, 40), kind), k)
    order = {i: rng.randrange(3) for i, _ in rows}
    hidden = {i: rng.random() < 0.4 for i, _ in rows}
    frame = spark.createDataFrame([(i, p, order[i], hidden[i]) for i, p in rows], "id string, parent string, o int, hidden boolean")
    want = plain_tour(rows, order, {i: not h for i, h in hidden.items()})
    got = {r["id"]: (r["root"], r["depth"], r["place"], r["size"], r["marked"]) for r in trees.tour(frame.withColumn("shown", ~F.col("hidden")), "o", "shown").collect()}
    assert got == want
    ranks = {r["id"]: (r["root"], r["generation"], r["rank"], r["size"]) for r in trees.tree_ranks(frame, "o").collect()}
    assert ranks == {i: (w[0], w[1], None if hidden[i] else w[4], w[3]) for i, w in want.items()}
    parent = dict(rows)

    def seen(i):
        i = parent[i]
        while i is not None and hidden[i]:
            i = parent[i]
        return i

    assert {r["id"]: r["ancestor"] for r in trees.visible_ancestors(frame).collect()} == {i: seen(i) for i in parent}


def test_parsimony_of_200_random_trees(spark, small_blocks):
    rng, rows, states = random.Random(4), [], {}
    for k, kind in enumerate(("forest", "bush", "deep", "chain", "comb") * 40):
        own = shift(forest(rng, rng.randrange(1, 60), kind), k)
        letters = "abcdef"[: rng.randrange(1, 7)]
        states |= {i: rng.choice(letters) for i, _ in own if rng.random() < rng.choice([0.2, 0.6, 1.0])}
        rows += own
    tree = spark.createDataFrame(rows, "id string, parent string")
    out = trees.fitch(tree, spark.createDataFrame(list(states.items()), "id string, state string")).collect()
    assert {r["id"]: (tuple(r["set"]), r["steps"], r["state"]) for r in out} == plain_fitch(rows, states)
    changes = {(r["parent"], r["id"]) for r in trees.change_edges(spark.createDataFrame(out)).collect()}
    got = {r["id"]: r["state"] for r in out}
    assert changes == {(p, i) for i, p in rows if p and got[p] != got[i] and "?" not in (got[p], got[i])}


@pytest.mark.parametrize("kind", ["chain", "comb"])
def test_ten_thousand_nodes_deep_in_few_rounds(spark, monkeypatch, kind):
    rng = random.Random(5)
    rows = forest(rng, 10_000, kind)
    states = {i: rng.choice("abc") for i, _ in rows}
    written, cut = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda df, name: written.append(name) or cut(df, name))
    monkeypatch.setattr(trees, "BLOCK", 500)
    out = trees.fitch(spark.createDataFrame(rows, "id string, parent string"), spark.createDataFrame(list(states.items()), "id string, state string"))
    assert {r["id"]: (tuple(r["set"]), r["steps"], r["state"]) for r in out.collect()} == plain_fitch(rows, states)
    assert len(written) < 40


def test_depths_of_types_and_empty_trees(spark):
    rows = [("r", None), ("a", "r"), ("b", "r"), ("c", "b"), ("d", "b")]
    types = [("a", "ui/form"), ("c", "ui/form/x"), ("d", "ui/list"), ("b", "")]
    frame = spark.createDataFrame(rows, "id string, parent string")
    out = {(r["depth"], r["id"]): (r["set"], r["state"]) for r in trees.fitch_by_depth(frame, spark.createDataFrame(types, "id string, type string")).collect()}
    assert out[1, "r"] == (["ui"], "ui") and out[2, "b"] == (["ui/form", "ui/list"], "ui/form") and out[2, "r"] == (["ui/form"], "ui/form")
    assert out[3, "c"] == (["ui/form/x"], "ui/form/x") and out[3, "a"] == ([], "?") and {d for d, _ in out} == {1, 2, 3}
    none = frame.limit(0)
    assert trees.fitch(none, none.select("id", F.lit("x").alias("state"))).count() == trees.tour(none).count() == 0


def test_hidden_nodes_are_those_of_one_line(spark):
    rows = [("r", None, "x"), ("a", "r", "x"), ("b", "a", "x"), ("c", "b", "y"), ("d", "c", "y"), ("e", "c", "y"), ("f", "d", None), ("g", "f", "z")]
    frame = spark.createDataFrame(rows, "id string, parent string, clade string")
    extra = spark.createDataFrame([("f", "e")], "id string, parent string")
    hidden = lambda **k: {r["id"] for r in trees.unary_hidden(frame, **k).filter("hidden").collect()}
    assert hidden() == {"a", "b", "d", "f"} and hidden(group="clade") == {"a", "f"} and hidden(extra=extra, group="clade") == {"a"}
