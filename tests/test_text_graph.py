from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph, ontology, risk, texts, trees


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names)).select(expr.alias("x")).first()["x"]


def test_renames_tickets_intents_releases(spark):
    p = F.col("p")
    for given, want in [("src/{a => b}/x.py", ("src/b/x.py", "src/a/x.py")), ("a.py => b.py", ("b.py", "a.py")), ("src/{ => new}/x", ("src/new/x", "src/x")), ("plain", ("plain", None))]:
        assert (one(spark, T.renamed(p)[0], p=given), one(spark, T.renamed(p)[1], p=given)) == want
    assert one(spark, T.tickets(F.col("s"), F.col("b")), s="fix #42", b="see JIRA-7, ABC-12 and #42") == ["#42", "#7", "ABC-12"]
    kind = lambda s, n=1: one(spark, T.intent(F.col("s"), F.lit(n)), s=s)
    assert kind("feat(api)!: x")["kind"] == "feat" and kind("style: x")["kind"] == "chore" and kind("Fix crash")["confidence"] == 0.75
    assert kind("we resolve an error")["kind"] == "fix" and kind("")["stance"] == "insufficient" and kind("x", 2)["kind"] == "merge"
    rel = lambda s: one(spark, T.release_kind(F.col("s"), F.lit("")), s=s)
    assert [rel(s)["kind"] for s in ("v2.0.0", "v1.3.0", "v1.3.4", "nightly", "cve fix 1.0.0")] == ["major_release", "minor_release", "patch_release", "release", "security"]
    assert one(spark, T.is_revert(F.col("s"), F.col("b")), s='Revert "x"', b="") and one(spark, T.reverted_sha(F.col("s"), F.col("b")), s="undo", b="This reverts commit abcdef1234.") == "abcdef1234"


def test_debt_patterns_and_complexity(spark):
    lines = "ok\n# FIXME now\n@deprecated since 2\nthis will be removed\nTODO: fix it\ntodo later"
    got = texts.debt_items(spark.createDataFrame([("a.py", lines)], "path string, text string")).orderBy("line").collect()
    assert [(r["line"], r["kind"], r["severity"]) for r in got] == [(2, "todo_debt", "med"), (3, "deprecation", "high"), (4, "deprecation", "med"), (5, "todo_debt", "med")]
    assert one(spark, T.complexity(F.col("t")), t="if a and b: # or not\n  for x in y: pass // while\n/* case */ z ? 1 : 2") == 5


def test_symbols_and_stems(spark):
    src = "class Foo(Bar):\n    async def get_user2(self):\n        pass\n"
    got = texts.symbols(spark.createDataFrame([("a.py", "python", src)], "path string, lang string, text string")).collect()
    assert {(r["name"], r["kind"], r["line"], r["stem"]) for r in got} == {("Foo", "class", 1, "foo"), ("get_user2", "function", 2, "user")}


def test_chunks_hold_the_text(spark):
    text = "".join(f"line {i} of a longer file\n" for i in range(200))
    got = texts.chunks(spark.createDataFrame([("a", text)], "path string, text string")).orderBy("index").collect()
    assert got[0]["start"] == 0 and all(text[r["start"] :].startswith(r["text"]) for r in got) and all(b["start"] <= a["start"] + len(a["text"]) for a, b in zip(got, got[1:], strict=False))


def test_chunks_as_a_table_function(spark):
    texts.register_tables(spark)
    got = spark.sql("select start, length(chunk) as n from chunk_text(repeat('a', 1000))").collect()
    assert [tuple(r) for r in got] == [(0, 700), (620, 380)]


def test_similar_pairs_lose_no_link(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("a", " ".join(words)), ("b", " ".join(words)), ("c", " ".join(words[:58])), ("d", " ".join(words[30:])), ("e", "short")]
    pairs, members = texts.similar_pairs(spark.createDataFrame(rows, "path string, text string"))
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [("a", "c")]
    assert {r["path"]: r["class"] for r in members.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_alleles_and_clones(spark):
    s = spark.createDataFrame([("user", "a", [1.0, 0.0]), ("user", "b", [1.0, 0.0]), ("user", "c", [0.0, 1.0])], "stem string, path string, v array<double>")
    assert {(r["a"], r["b"]): r["kind"] for r in texts.alleles(s).collect()} == {("a", "b"): "exact_clone", ("a", "c"): "mutant_allele", ("b", "c"): "mutant_allele"}
    f = spark.createDataFrame([(w, p, "h1") for w in range(4) for p in "ab"] + [(3, p, "h2") for p in "ab"] + [(0, p, "h3") for p in "ab"], "win int, path string, fingerprint string")
    assert {r["fingerprint"]: r["pattern"] for r in texts.clone_patterns(f).collect()} == {"h1": "consistent", "h2": "late", "h3": "short_lived"}


def test_path_types(spark):
    arch = "architecture"
    gold = [
        ("src/api/routes/users.py", [arch, "api"]), ("src/api/handlers/orders.py", [arch, "api", "handler"]), ("src/data/models/user.py", [arch, "data", "model"]), ("src/data/repository/user_repo.py", [arch, "data"]),
        ("src/ui/components/UserCard.tsx", [arch, "ui", "component"]), ("src/security/auth/login.py", [arch, "security"]), ("tests/unit/test_users.py", ["verification", "unit"]), ("tests/e2e/test_checkout.py", ["verification"]),
        ("docs/ARCHITECTURE.md", ["knowledge"]), (".github/workflows/ci.yml", [arch, "infra"]), ("scripts/build.sh", ["tooling"]), ("src/utils/parse_json.py", ["utility"]), ("src/ml/embeddings/encoder.py", [arch, "ml"]),
        ("src/infra/deploy/helm/values.yaml", [arch, "infra"]), ("zzz/q", ["unknown"]), ("", ["unknown"]), ("日本/é", ["unknown"]),
    ]
    g = spark.createDataFrame([*gold, (None, ["unknown"])], "path string, expected array<string>")
    types = ontology.path_types(g)
    assert tuple(ontology.gold_accuracy(types, g.filter("path is not null")).first()) == (17, 17)
    seeds = {r["path"]: r["s"] for r in types.select("path", ontology.breakout_seed(F.col("path"), F.col("type_path"), F.col("confidence")).alias("s")).collect()}
    assert seeds["zzz/q"] == "dir:zzz" and seeds["src/api/handlers/orders.py"] == "type:architecture/api/handler|dir:src" and seeds["src/utils/parse_json.py"] == "type:utility/parsing|dir:src"
    assert ("architecture/api", 2, 4) in ontology.outline() and max(d for _, d, _ in ontology.outline()) == 3
    own = {"x": {"words": ["zzz"], "kinds": {"y": {"words": ["qqqq"]}}}}
    assert {r["path"]: r["type_path"] for r in ontology.path_types(spark.createDataFrame([("zzz/aqqqqb",), ("zzz/b",)], "path string"), own).collect()} == {"zzz/aqqqqb": ["x", "y"], "zzz/b": ["x"]}


def test_cycles_and_paths(spark):
    e = spark.createDataFrame([("a", "b", "parent_of"), ("b", "a", "parent_of"), ("b", "c", "touches")], "source string, target string, rel string")
    start = spark.createDataFrame([("a",)], "id string")
    assert graph.ancestors(e, start).count() == 2
    assert {r["id"]: r["path"] for r in graph.shortest_paths(e, start, spark.createDataFrame([("c",), ("b",)], "id string")).collect()} == {"b": ["a", "b"], "c": ["a", "b", "c"]}
    assert {r["id"] for r in graph.joined_paths(e, start, spark.createDataFrame([("c",)], "id string")).collect()} == {"a", "b", "c"}


def test_build_merges_and_rejects(spark):
    n = spark.createDataFrame([("a", "commit", None, "x", 1), ("a", "commit", "L", "longer", 2), ("b", "path", "B", None, 1)], "id string, kind string, label string, text string, seq int")
    e = spark.createDataFrame([("a", "b", "touches"), ("a", "b", "touches"), ("a", "zz", "touches")], "source string, target string, rel string")
    nodes, edges = graph.build(n, e)
    assert {r["id"]: r["text"] for r in nodes.collect()} == {"a": "longer", "b": None} and edges.count() == 1
    assert {r["kind"]: r["family"] for r in graph.kinds(nodes).collect()} == {"commit": "taxon", "path": "taxon"}


def test_parsimony(spark):
    tree = spark.createDataFrame([("r", None), ("x", "r"), ("y", "r"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "id string, parent string")
    for states, want in (("AABB", 1), ("AAAA", 0), ("ABAB", 2)):
        leaves = spark.createDataFrame(list(zip("abcd", states, strict=True)), "id string, state string")
        got = trees.fitch(tree, leaves)
        assert got.agg(F.sum("steps")).first()[0] == want and got.count() == 7
        idx = graph.consistency(leaves, F.lit(want)).first()
        assert 0 <= idx["ci"] <= 1 and 0 <= idx["ri"] <= 1 and (want != 2 or idx["ci"] < 1)
    assert graph.newick(tree).first()["text"] == "((a,b)x,(c,d)y)r;"


def test_spreading_keeps_the_total(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r")], "source string, target string, rel string")
    got = graph.spreading(e, spark.createDataFrame([("a", 1.0)], "id string, value double"))
    assert abs(got.agg(F.sum("value")).first()[0] - 1) < 1e-12


def test_plans_gates_and_suites(spark):
    r = spark.createDataFrame([("revert_surface", "a", 0.9), ("revert_surface", "a", 0.5), ("low_fitness", "b", 0.5)], "kind string, path string, severity double")
    ranked = risk.rank_points(r)
    assert [(x["id"], x["kind"], x["priority"]) for x in ranked.collect()] == [("W1", "revert_surface", "P0"), ("W2", "low_fitness", "P2")]
    steps = {x["kind"]: x for x in risk.plan_steps(ranked).collect()}
    assert steps["low_fitness"]["depends_on"] == "W1" and steps["revert_surface"]["depends_on"] is None
    assert risk.new_critical(ranked, ranked.limit(0)).count() == 1 and risk.new_critical(ranked, ranked).count() == 0
    suites = spark.createDataFrame([("a", 0.25, 0.8), ("b", 0.25, None), ("c", 0.5, 0.5)], "suite string, weight double, score double")
    assert abs(risk.combine_suites(suites).first()["combined"] - 0.6) < 1e-12
    assert risk.smells(spark.createDataFrame([("a", 6)], "path string, touches int"), spark.createDataFrame([(10, 20, 1, 0, 2)], "n int, feature_commits int, test_touches int, utility_touches int, revert_files int")).count() == 3


def test_cycles_have_no_generation(spark):
    """Two commits that name each other as parents, one that follows them, and a chain of its own with a second parent."""
    nodes = spark.createDataFrame([(i,) for i in "abcxyz"], "id string")
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("y", "x"), ("z", "y")], "id string, parent string")
    got = {r["id"]: (r["root"], r["generation"]) for r in graph.generations(parents, nodes).collect()}
    assert got == {"a": (None, None), "b": (None, None), "c": (None, None), "x": ("x", 0), "y": ("x", 1), "z": ("x", 2)}
    every = parents.union(spark.createDataFrame([("z", "x")], "id string, parent string"))
    assert {r["id"]: r["generation"] for r in graph.least_generations(every, nodes).collect()} == {"a": None, "b": None, "c": None, "x": 0, "y": 1, "z": 1}


def test_a_hot_key_makes_small_arrays_and_all_pairs(spark):
    from tidemark.operators import coupling

    items = spark.range(300).selectExpr("'hot' as k", "id as v").union(spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 1), (None, 3)], "k string, v bigint"))
    pairs = coupling.pairs_within(items, "k", "v")
    got = {(r["k"], r["a"], r["b"]) for r in pairs.collect()}
    assert pairs.count() == len(got) == 300 * 299 // 2 + 1 and ("x", 1, 2) in got and all(a < b for _, a, b in got)
