import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.operators import reticulation, wordvectors

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[A-Za-z_]\w*|<=|>=|==|!=|&&|\|\||[(){}\[\];]|[^\W\d_]")


def plain_parts(text):
    found = [t for t in TOKEN.findall(text or "") if t not in ("<=", ">=")]
    found = [re.sub(r"\d+$", "", t.lower())[:24] if t[0].isalpha() or t[0] == "_" else t for t in found]
    return found if len(found) < 8 else ["|".join(found[i : i + 3]) for i in range(len(found) - 2)]


def all_pairs(sets, least):
    names = sorted(sets)
    out = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = sets[a], sets[b]
            if least * max(len(x), len(y)) <= min(len(x), len(y)) and (s := len(x & y) / max(1, len(x | y))) >= least:
                out[a, b] = s
    return out


def test_similar_structures_recall_on_a_whole_table(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "source", "text"]).to_pylist()
    files = spark.createDataFrame([(f"{r['source']}/{r['doc_id']}", r["text"]) for r in rows], "path string, text string")
    pairs, members = reticulation.similar_structures(files)
    classes = {r["class"] for r in members.collect()}
    sets = {p: set(plain_parts(t)) for p, t in ((f"{r['source']}/{r['doc_id']}", r["text"]) for r in rows) if p in classes}
    want, got = all_pairs({p: s for p, s in sets.items() if s}, 0.25), {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
    assert set(got) <= set(want) and all(abs(want[p] - s) < 1e-9 for p, s in got.items())
    assert len(got) >= 0.9 * len(want) and {p for p, s in want.items() if s >= 0.55} <= set(got)


def test_recall_near_the_limit(spark):
    rng, files = random.Random(1), []
    for k in range(250):  # pairs that share a share of their tokens, so that similarities lie about the limit
        base = [f"w{rng.randrange(10**6)}x" for _ in range(60)]
        keep = rng.randrange(20, 45)
        files += [(f"d{k}/a", " ".join(base)), (f"e{k}/b", " ".join(base[:keep] + [f"z{rng.randrange(10**6)}y" for _ in range(60 - keep)]))]
    pairs, _ = reticulation.similar_structures(spark.createDataFrame(files, "path string, text string"))
    want = all_pairs({p: set(plain_parts(t)) for p, t in files}, 0.25)
    assert len(want) > 80 and pairs.count() >= 0.85 * len(want)


def test_fingerprints_and_edges_of_odd_files(spark):
    code = "def f(x1, y22): return (x1 == y22) && g(x1)\n" * 3
    files = [("a/one.py", code), ("b/two.py", code.replace("x1", "x7")), ("a/three.py", code), ("c/none", None), ("c/empty", ""), ("d/short", "a b"), ("e/short", "a  b"), ("f/é", "éa 日本 <= >= == 12")]
    frame = spark.createDataFrame([(p, t, 1) for p, t in files], "path string, text string, sha int")
    got = {r["path"]: r["parts"] for r in reticulation.fingerprints(frame).collect()}
    assert got == {p: plain_parts(t) for p, t in files}
    edges = {(r["a"], r["b"]): r["similarity"] for r in reticulation.reticulation_edges(frame).collect()}
    assert edges == {("a/one.py", "a/one.py"): 1.0, ("d/short", "d/short"): 1.0}
    assert reticulation.reticulation_edges(frame.limit(0)).count() == 0


def test_clades_are_named_by_words_and_neighbors(spark):
    members = spark.createDataFrame([("k", "src/api/user_api.py"), ("k", "src/api/order_api.py"), ("m", "docs/guide.md"), ("n", "zz/qq")], "clade string, path string")
    v = lambda *x: [*x, *[0] * (64 - len(x))]
    vectors = spark.createDataFrame([("api", v(5, 1)), ("user", v(0, 3)), ("rest", v(5, 2)), ("churn_low", v(5, 1)), ("order", v(0, 3, 1)), ("docs", v(0, 0, 7)), ("guide", v(0, 0, 7, 1))], "id string, v array<bigint>")
    got = {r["clade"]: r["label"] for r in wordvectors.clade_labels(members, vectors).collect()}
    # "api" is followed by its second neighbor, as the first is a commit size; then come the next words of the path.
    assert got["k"] == "api/rest/order/user" and got["m"] == "docs/guide/guide/order" and "n" not in got


def test_terms_keep_their_strongest_contexts(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))) for i in range(20)], "id int, text string")
    vectors = {r["id"]: r["v"] for r in wordvectors.term_vectors(rows).collect()}
    assert set(vectors) == {"alpha", "beta", "gamma", "delta"} and all(len(v) == 64 and sum(map(abs, v)) > 0 for v in vectors.values())
    near = wordvectors.neighbors(wordvectors.term_vectors(rows), wordvectors.leading_terms(rows, 2)).collect()
    assert len(near) == 6 and all(r["term"] != r["neighbor"] for r in near)
    model = wordvectors.model_vectors(wordvectors.skipgram(rows, size=8))
    assert model.count() == 4 and model.select(F.size("v")).first()[0] == 8


def test_cohesion_counts_every_pair(spark):
    from tidemark.operators.texts import cohesion

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (4, [0.0, 1.0])], "id int, v array<double>")
    clusters = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id int, cluster string")
    got = {r["cluster"]: (r["size"], round(r["cohesion"], 9)) for r in cohesion(vectors, clusters).collect()}
    assert got == {"a": (3, round(1 / 3, 9)), "b": (1, 0.0)}


def test_symbols_as_a_table_function(spark):
    from tidemark.operators.texts import register_tables

    register_tables(spark)
    got = spark.sql("SELECT * FROM symbols('python', 'class A:\n  async def b(x):\n    pass\n') UNION ALL SELECT * FROM symbols('cobol', 'def c()') UNION ALL SELECT * FROM symbols('go', NULL)").collect()
    assert [tuple(r) for r in got] == [("A", "class", 1), ("b", "function", 2)]
