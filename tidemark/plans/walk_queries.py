"""Queries that walk graphs, ledgers and trees, and those whose SQL walks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import coupling, graph, lineage, reports, risk, series, taxonomy
from tidemark.plans.core_queries import C, EDGES
from tidemark.plans.graph_queries import G, context
from tidemark.plans.registry import query
from tidemark.plans.risk_queries import RISKS, risks, the_ledger
from tidemark.plans.series_queries import rounded
from tidemark.plans.testmap import SQL_COMMITS, SQL_PARENTS, commit_files, commits, parents, table

# --- a graph of conversations: runs with their rounds in order, a decision for each role, pivots that rounds join


def talks(spark, d):
    """nodes(id, kind, label, text, seq), edges(source, target, rel)."""
    c = table(spark, d, "conversations")
    run, turn = F.concat(F.lit("run"), F.col("conv_id").cast("string")), F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    decision, pivot = F.concat(F.lit("d"), F.col("conv_id").cast("string"), "role"), F.concat(F.lit("p"), (F.col("conv_id") % 20).cast("string"))
    node = lambda i, kind, label, text: c.select(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), text.alias("text"), F.col("turn").cast("bigint").alias("seq"))
    none = F.lit("")
    nodes = node(run, "run", none, none).unionByName(node(turn, "round", F.col("role"), F.col("text"))).unionByName(node(decision, "decision", F.col("role"), none)).unionByName(node(pivot, "pivot", F.lit("topic"), none))
    edge = lambda a, b, rel, rows=c: rows.select(a.alias("source"), b.alias("target"), F.lit(rel).alias("rel"))
    before = F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))
    edges = edge(run, turn, "spawned", c.filter("turn = 0")).unionByName(edge(before, turn, "next", c.filter("turn > 0"))).unionByName(edge(turn, decision, "proposed")).unionByName(edge(turn, pivot, "joins"))
    return graph.build(nodes, edges)


TALKS = """WITH RECURSIVE c AS (SELECT 'run' || conv_id AS run, 't' || conv_id || ':' || turn AS t, 'd' || conv_id || role AS d, 'p' || conv_id % 20 AS p, 't' || conv_id || ':' || (turn - 1) AS b, * FROM conversations),
    nodes AS (SELECT DISTINCT run AS id, 'run' AS kind, '' AS label, '' AS text FROM c UNION SELECT t, 'round', role, text FROM c UNION SELECT d, 'decision', role, '' FROM c UNION SELECT p, 'pivot', 'topic', '' FROM c),
    edges AS (SELECT run AS source, t AS target, 'spawned' AS rel FROM c WHERE turn = 0 UNION SELECT b, t, 'next' FROM c WHERE turn > 0 AND b IN (SELECT t FROM c) UNION SELECT t, d, 'proposed' FROM c UNION SELECT t, p, 'joins' FROM c)"""
_REACH = ", und AS (SELECT source, target FROM e UNION SELECT target, source FROM e), w AS (SELECT {seed} AS id, 0 AS hops UNION SELECT target, hops + 1 FROM w JOIN und ON source = id WHERE hops < {depth}), r AS (SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1)"


@query("flow_walk", TALKS + ", e AS (SELECT * FROM edges WHERE rel IN ('next', 'spawned', 'proposed'))" + _REACH.format(seed="'run1'", depth=4) + " SELECT id, CASE kind WHEN 'decision' THEN 1 ELSE 2 END AS stage, hops FROM r JOIN nodes USING (id)")
def _(spark, d):
    return graph.flow_walk(*talks(spark, d), spark.createDataFrame([("run1",)], "id string"))


@query("family_walk", TALKS + ", e AS (SELECT * FROM edges WHERE rel IN ('next', 'spawned', 'proposed', 'joins'))" + _REACH.format(seed="'run1'", depth=4) + " SELECT id, hops FROM r JOIN nodes USING (id) WHERE kind IN ('run', 'round', 'pivot')")
def _(spark, d):
    return reports.family_walk(*talks(spark, d), spark.createDataFrame([("run1",)], "id string"), "flow", 4)


@query("pivot_members", TALKS + " SELECT target AS pivot, source AS id FROM edges WHERE rel = 'joins'")
def _(spark, d):
    return reports.pivot_join(*talks(spark, d), "topic")


_WORDS = ["user", "assistant"]
_MATCH = " + ".join(f"CASE WHEN contains(lower(concat_ws(' ', id, kind, label, text)), '{w}') THEN 0.5 ELSE 0 END::DOUBLE" for w in _WORDS)

_NAMED = " OR ".join(f"contains(lower(concat_ws(' ', label, kind)), '{w}')" for w in _WORDS)


def _heat(rounds, decay):
    out, last = ", und AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), links AS (SELECT source, target, count(*) OVER (PARTITION BY source) AS deg FROM und)", "hits"
    for i in range(rounds):
        out += f", v{i} AS (SELECT id, sum(score) AS score FROM (SELECT id, {1 - decay} * score AS score FROM {last} UNION ALL SELECT target, {decay} * score / deg FROM {last} JOIN links ON source = id) GROUP BY 1)"
        last = f"v{i}"
    return out, last


_HEAT, _LAST = _heat(3, 0.45)


@query(
    "precedents",
    TALKS
    + f", own AS (SELECT * FROM nodes WHERE kind IN ('decision', 'pivot', 'round')), m AS (SELECT id, {_MATCH} AS share, {_NAMED} AS named FROM own), hits AS (SELECT id, share + 0.08::DOUBLE + CASE WHEN named THEN 0.2 ELSE 0 END::DOUBLE AS score FROM m WHERE share > 0)"
    + _HEAT
    + f" SELECT own.id, round(greatest(coalesce(h.score, 0), coalesce(v.score, 0)), 6) AS score FROM own LEFT JOIN hits h ON h.id = own.id LEFT JOIN {_LAST} v ON v.id = own.id WHERE greatest(coalesce(h.score, 0), coalesce(v.score, 0)) > 0",
)
def _(spark, d):
    return rounded(graph.precedents(*talks(spark, d), _WORDS), "score")


@query("joined_paths", G + """, w AS (SELECT 'n3' AS id, ['n3'] AS path UNION ALL SELECT target, list_append(path, target) FROM w JOIN edges ON source = id WHERE len(path) <= 3),
    b AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY len(path), path) AS k FROM w WHERE id LIKE 'p%') SELECT DISTINCT unnest(path) AS id FROM b WHERE k = 1""")
def _(spark, d):
    nodes, edges = context(spark, d)
    return graph.joined_paths(edges, spark.createDataFrame([("n3",)], "id string"), nodes.filter("kind = 'path'"), 3)


# --- generations over all parents

_GEN = "WITH RECURSIVE " + SQL_PARENTS + """, w AS (SELECT sha AS id, 0 AS g FROM headers WHERE sha NOT IN (SELECT sha FROM parents) UNION SELECT p.sha, g + 1 FROM w JOIN parents p ON p.parent = w.id),
    gen AS (SELECT id, CAST(min(g) AS INTEGER) AS generation FROM w GROUP BY 1)"""


def generation(spark, d):
    return graph.least_generations(parents(spark, d).select(F.col("sha").alias("id"), "parent"), table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


@query("least_generation", _GEN + " SELECT id, generation FROM gen")
def _(spark, d):
    return generation(spark, d)


@query("generation_stages", _GEN + ", m AS (SELECT max(generation) AS m FROM gen) SELECT CAST(least(4, floor(generation / greatest(1, m) * 5)) AS INTEGER) AS stage, count(*) AS n FROM gen, m GROUP BY 1")
def _(spark, d):
    g = generation(spark, d)
    most = g.agg(F.max("generation").alias("most"))
    return g.crossJoin(most).groupBy(reports.generation_stage(F.col("generation"), F.col("most"), 5).alias("stage")).agg(F.count("*").alias("n"))


_NAME = "regexp_replace(CAST(sha AS VARCHAR), '[ (),:;]+', '_', 'g')"


@query(
    "tree_newick",
    "WITH "
    + SQL_PARENTS
    + f""", o AS (SELECT email, sha, row_number() OVER (PARTITION BY email ORDER BY ts, sha) AS k FROM headers), t AS (SELECT email, arg_min(sha, k) AS id, count(*) AS n, string_agg({_NAME}, ')' ORDER BY k DESC) AS body FROM o GROUP BY 1)
    SELECT id, repeat('(', CAST(n - 1 AS INTEGER)) || body || ';' AS text FROM t""",
)
def _(spark, d):
    first = parents(spark, d).filter("pos = 0").select(F.col("sha").alias("id"), "parent")
    return graph.newick(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(first, "id", "left"))


@query(
    "collapsed_chains",
    "WITH "
    + SQL_PARENTS
    + """, p AS (SELECT * FROM parents WHERE pos = 0), k AS (SELECT parent, count(*) AS n, min(sha) AS kid FROM p GROUP BY 1)
    SELECT h.sha AS id, coalesce(n = 1 AND h.subject = c.subject AND p.parent IS NOT NULL, false) AS hidden FROM headers h LEFT JOIN p ON p.sha = h.sha LEFT JOIN k ON k.parent = h.sha LEFT JOIN headers c ON c.sha = k.kid""",
)
def _(spark, d):
    first = parents(spark, d).filter("pos = 0").select(F.col("sha").alias("id"), "parent")
    orders = table(spark, d, "orders")
    return lineage.collapse_chains(orders.select(F.col("o_orderkey").alias("id")).join(first, "id", "left"), orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind")))


# --- clades, ledger, frames


@query(
    "clade_votes",
    C
    + EDGES
    + """, e AS (SELECT * FROM edges WHERE weight >= 2), n AS (SELECT a AS path, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e), k AS (SELECT path, max(clade) AS clade, count(*) AS touches FROM files GROUP BY 1),
    v AS (SELECT n.path, k.clade AS vote, sum(weight) AS w FROM n JOIN k ON k.path = n.other GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY w DESC, vote) AS r FROM v)
    SELECT k.path, CASE WHEN w >= 3 AND w > 0.05 * touches THEN vote ELSE clade END AS clade FROM k LEFT JOIN b ON b.path = k.path AND r = 1""",
)
def _(spark, d):
    files = commit_files(spark, d)
    k = files.groupBy("path").agg(F.max("clade").alias("clade"), F.count("*").alias("touches"))
    return taxonomy.cochange_votes(coupling.cochange_edges(files, commits(spark, d)), k.select("path", "clade"), k.select("path", "touches"), share=0.05)


@query(
    "ledger_resolve",
    "WITH RECURSIVE " + SQL_COMMITS + """, l AS (SELECT DISTINCT 'lineage:' || path AS source, 'clade:' || clade AS target FROM files UNION SELECT 'delta:' || sha || ':' || path, 'clade:' || clade FROM files
      UNION SELECT 'flow:' || x.clade || ':' || y.clade, unnest(['clade:' || x.clade, 'clade:' || y.clade]) FROM files x JOIN files y ON x.sha = y.sha AND x.clade < y.clade),
    a AS (SELECT source AS id FROM l WHERE target = 'clade:Brand#1'), b AS (SELECT DISTINCT target AS id FROM l JOIN a ON a.id = source WHERE target <> 'clade:Brand#1')
    SELECT 'clade:Brand#1' AS id, 0 AS hops UNION ALL SELECT DISTINCT id, 1 FROM a UNION ALL SELECT id, 2 FROM b""",
)
def _(spark, d):
    return risk.resolve(graph.cut(the_ledger(spark, d), "ledger"), spark.createDataFrame([("clade:Brand#1",)], "id string"), 2)


@query("frame_focus", C + RISKS + " SELECT 'frame:risk:' || id AS id FROM risks WHERE kind = 'revert_surface'")
def _(spark, d):
    r = risks(spark, d)
    records = r.filter("kind = 'revert_surface'").select(F.concat_ws(":", F.lit("failure_point"), "id", "path").alias("id"))
    return reports.frame_focus(risk.frames(r), records).select("id")


@query(
    "focused_steps",
    C
    + RISKS
    + """, w AS (SELECT id, CASE kind WHEN 'revert_surface' THEN 1 WHEN 'change_coupling' THEN 2 WHEN 'dependency_shock' THEN 3 ELSE 4 END AS rank FROM risks) SELECT row_number() OVER (ORDER BY (rank <> 2)::INT, rank, id) AS place, id FROM w""",
)
def _(spark, d):
    steps = reports.steps_for(risk.plan_steps(risks(spark, d)), ["decouple"])
    return steps.select(F.row_number().over(Window.orderBy((F.col("wave") != "decouple").cast("int"), "rank", "id")).cast("bigint").alias("place"), "id")  # a short list


@query("vector_upsert", "WITH n AS (SELECT o_custkey AS id, o_orderdate AS t, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT id, o_orderkey AS v FROM n WHERE k = 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderkey").alias("v"))
    half = F.year("at.o_orderdate") < 1998
    return lineage.upsert(o.filter(half), o.filter(~half)).select("id", "v")


@query("shared_blobs", "WITH a AS (SELECT * FROM documents WHERE doc_id % 2 = 0), b AS (SELECT text, min(doc_id) AS peer FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT doc_id AS path, peer, sha256(text) AS blob FROM a JOIN b USING (text) UNION ALL SELECT -1, count(*), '' FROM documents")
def _(spark, d):
    from tidemark.operators.texts import shared_blobs

    docs = table(spark, d, "documents")
    own, peers = (docs.filter(c).select(F.col("doc_id").alias("path"), "text") for c in ("doc_id % 2 = 0", "doc_id % 2 = 1"))  # two sets, both whole
    return shared_blobs(own, peers).select("path", "peer", "blob").unionByName(docs.agg(F.lit(-1).cast("bigint").alias("path"), F.count("*").alias("peer"), F.lit("").alias("blob")))


# --- events of a history


@query(
    "lifecycle_events",
    "WITH RECURSIVE "
    + SQL_COMMITS
    + """, ev AS (SELECT author AS repo, ts, row_number() OVER (PARTITION BY author ORDER BY ts) AS k FROM commits WHERE is_revert), far AS (SELECT *, max(k) OVER (PARTITION BY repo ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 14 DAYS FOLLOWING) - k + 1 AS n FROM ev),
    walk AS (SELECT * FROM far WHERE k = 1 UNION ALL SELECT f.* FROM walk w JOIN far f ON f.repo = w.repo AND f.k = w.k + CASE WHEN w.n >= 3 THEN w.n ELSE 1 END)
    SELECT 'pioneer' AS kind, 'first commit' AS label, epoch_us(min(ts)) AS "at", 'pioneer' AS stage, 0.7::DOUBLE AS confidence FROM commits UNION ALL SELECT 'minor_release', 'v' || year(ts), epoch_us(min(ts)), 'growth', 0.75 FROM commits GROUP BY year(ts)
    UNION ALL SELECT 'revert_storm', w.repo, epoch_us(m.ts), 'disturbance', round(least(0.95, 0.55 + 0.05 * w.n), 6) FROM walk w JOIN ev m ON m.repo = w.repo AND m.k = w.k + w.n // 2 WHERE w.n >= 3""",
)
def _(spark, d):
    c = commits(spark, d)
    storm = series.storms(c.filter("is_revert").select(F.col("author").alias("repo"), "ts")).select(F.lit("revert_storm").alias("kind"), F.col("repo").alias("label"), "at", F.lit("disturbance").alias("stage"), "confidence")
    releases = c.groupBy(F.year("ts").alias("y")).agg(F.min("ts").alias("at")).select(F.lit("minor_release").alias("kind"), F.concat(F.lit("v"), F.col("y").cast("string")).alias("label"), "at", F.lit("growth").alias("stage"), F.lit(0.75).alias("confidence"))
    return rounded(lineage.lifecycle(lineage.pioneer(c), releases, storm), "confidence").withColumn("at", F.unix_micros("at"))


@query(
    "stage_segments",
    "WITH RECURSIVE "
    + SQL_COMMITS
    + """, r AS (SELECT min(ts) AS t FROM commits GROUP BY year(ts)), b AS (SELECT t, 'growth' AS stage, 0.5 + month(t) / 100 AS c FROM r UNION ALL SELECT t + INTERVAL 9 DAYS, 'maturity', 0.55 FROM r),
    o AS (SELECT *, row_number() OVER (ORDER BY t, stage, c) AS k FROM b),
    f AS (SELECT k, t, stage, c, 1 AS piece FROM o WHERE k = 1 UNION ALL SELECT o.k, CASE WHEN o.t < f.t + INTERVAL 14 DAYS AND o.c <= f.c THEN f.t ELSE o.t END, CASE WHEN o.t < f.t + INTERVAL 14 DAYS AND o.c <= f.c THEN f.stage ELSE o.stage END,
      CASE WHEN o.t < f.t + INTERVAL 14 DAYS AND o.c <= f.c THEN f.c ELSE o.c END, piece + (o.t >= f.t + INTERVAL 14 DAYS)::INT FROM f JOIN o ON o.k = f.k + 1),
    m AS (SELECT piece, arg_max(t, k) AS t, arg_max(stage, k) AS stage, arg_max(c, k) AS c FROM f GROUP BY 1)
    SELECT epoch_us(t) AS start, epoch_us(greatest(coalesce(lead(t) OVER (ORDER BY piece), t + INTERVAL 1 DAY), t + INTERVAL 1 DAY)) AS "end", stage, round(c, 6)::DOUBLE AS confidence FROM m""",
)
def _(spark, d):
    r = commits(spark, d).groupBy(F.year("ts").alias("y")).agg(F.min("ts").alias("at"))
    bounds = r.select(F.lit("r").alias("repo"), "at", F.lit("growth").alias("stage"), (F.lit(0.5) + F.month("at") / 100).alias("confidence"))
    more = bounds.select("repo", (F.col("at") + F.expr("interval 9 days")).alias("at"), F.lit("maturity").alias("stage"), F.lit(0.55).alias("confidence"))
    out = series.segments(bounds.unionByName(more))
    return rounded(out, "confidence").select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "stage", "confidence")


# --- words and labels

_DEBT = [(r"\bDeprecationWarning\b", 0), (r"(?i)\bdeprecated\b", 1), ("(?i)pending deprecation", 4), ("(?i)will be removed", 5), (r"(?i)TODO\s*:?\s*(fix|hack|tech\s*debt)", 6), ("FIXME|XXX|HACK", 7)]


@query(
    "debt_markers",
    "WITH l AS (SELECT event_id AS path, ['# FIXME ' || event_type, 'x = 1  # deprecated: use ' || event_type, '// TODO: fix ' || event_type, 'raise DeprecationWarning', 'plain ' || event_type, 'this will be removed'] AS t FROM events),"
    " f AS (SELECT path, unnest(t) AS text, generate_subscripts(t, 1) AS line FROM l), h AS (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {i}" for p, i in _DEBT)
    + " END AS p FROM f) SELECT path, CAST(line AS INTEGER) AS line, CASE WHEN p >= 6 THEN 'todo_debt' ELSE 'deprecation' END AS kind, CASE WHEN contains(lower(text), 'deprecated') THEN 'high' ELSE 'med' END AS severity, text FROM h WHERE p IS NOT NULL",
)
def _(spark, d):
    from tidemark.operators.texts import debt_items

    kind = F.col("event_type")
    lines = F.concat_ws("\n", F.concat(F.lit("# FIXME "), kind), F.concat(F.lit("x = 1  # deprecated: use "), kind), F.concat(F.lit("// TODO: fix "), kind), F.lit("raise DeprecationWarning"), F.concat(F.lit("plain "), kind), F.lit("this will be removed"))
    return debt_items(table(spark, d, "events").select(F.col("event_id").alias("path"), lines.alias("text")))


@query("gold_accuracy", "SELECT count(*) AS n, count(*) FILTER (p_size < 30 OR p_partkey % 3 = 0) AS hits FROM part")
def _(spark, d):
    """Types of parts by size against gold types, every third of which a wrong type meets all the same."""
    from tidemark.operators.ontology import gold_accuracy

    p = table(spark, d, "part").withColumn("path", F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")))
    types = p.select("path", F.when(F.col("p_size") < 30, F.array("p_brand", "p_type", F.lit("x"))).otherwise(F.array("p_brand", F.lit("other"))).alias("type_path"))
    gold = p.select("path", F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand")).otherwise(F.array("p_brand", "p_type")).alias("expected"))
    return gold_accuracy(types, gold)


@query("regime_checks", C + """, m AS (SELECT DISTINCT strftime(ts, '%Y-%m') AS m FROM commits) SELECT 'months' AS "check", count(*) >= 12 AS ok FROM m UNION ALL SELECT 'changepoint', true UNION ALL SELECT 'upward', true UNION ALL SELECT 'cooling', false UNION ALL SELECT 'stages', count(DISTINCT year(ts)) BETWEEN 5 AND 11 FROM commits""")
def _(spark, d):
    m = series.monthly(commits(spark, d))
    points = m.filter("month = '1997-01'").select(F.lit("n_commits").alias("id"), F.lit("up").alias("direction"))
    return reports.regime_checks(m, points, m.select(F.substring("month", 1, 4).alias("y"), F.lit("growth").alias("stage")).distinct())

