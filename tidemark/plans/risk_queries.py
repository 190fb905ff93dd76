"""Queries over failure points, plans, snapshots, the ledger and gold labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coupling, metrics, risk
from tidemark.plans.core_queries import EDGES
from tidemark.plans.registry import query
from tidemark.plans.testmap import SQL_COMMITS, commit_files, commits, table

C = "WITH " + SQL_COMMITS
RISKS = (
    EDGES
    + """, cp AS (SELECT 'change_coupling' AS kind, a || ' <-> ' || b AS path, least(1.0, 0.35 + weight / 12.0::DOUBLE)::DOUBLE AS severity FROM (SELECT * FROM edges WHERE weight >= 3 ORDER BY weight DESC, a, b LIMIT 5)),
    rv AS (SELECT path, count(*) AS r FROM files JOIN commits USING (sha) WHERE is_revert GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 6), rp AS (SELECT 'revert_surface' AS kind, path, least(1.0, 0.4 + r / 5.0::DOUBLE)::DOUBLE AS severity FROM rv),
    ft AS (SELECT path, 1 / (1 + 2 * count(*) FILTER (is_revert) / count(*) + 0.001 * sum(churn // greatest(1, n_files)) / count(*)) AS fit FROM files JOIN commits USING (sha) GROUP BY 1),
    fp AS (SELECT 'low_fitness' AS kind, path, 1 - fit AS severity FROM ft WHERE fit < 0.45 ORDER BY fit, path LIMIT 5),
    ds AS (SELECT 'dependency_shock' AS kind, NULL::VARCHAR AS path, least(1.0, 3 * rate)::DOUBLE AS severity FROM (SELECT (SELECT count(DISTINCT sha) FROM files WHERE layer = 'ECONOMY') / count(*) AS rate FROM commits) WHERE rate > 0.12),
    al AS (SELECT kind, path, round(max(severity), 3) AS severity FROM (SELECT * FROM cp UNION ALL SELECT * FROM rp UNION ALL SELECT * FROM fp UNION ALL SELECT * FROM ds) GROUP BY 1, 2),
    risks AS (SELECT 'W' || row_number() OVER (ORDER BY severity DESC, kind, path NULLS FIRST) AS id, kind, path, severity, CASE WHEN severity >= 0.85 THEN 'P0' WHEN severity >= 0.65 THEN 'P1' WHEN severity >= 0.45 THEN 'P2' ELSE 'P3' END AS priority FROM al)"""
)


def risks(spark, d):
    files, c = commit_files(spark, d), commits(spark, d)
    bundle = c.agg(F.count("*").alias("n")).crossJoin(files.filter("layer = 'ECONOMY'").agg(F.countDistinct("sha").alias("dep"))).withColumn("rate", F.col("dep") / F.col("n"))
    return risk.rank_points(
        risk.coupling_points(coupling.cochange_edges(files, c)), risk.revert_points(files, c), risk.fitness_points(metrics.file_fitness(files, c)),
        risk.scalar_point(bundle, "dependency_shock", F.col("rate") > 0.12, 3 * F.col("rate")),
    )


@query("risk_points", C + RISKS + " SELECT * FROM risks")
def _(spark, d):
    return risks(spark, d)


@query(
    "plan_steps",
    C
    + RISKS
    + """, w AS (SELECT *, CASE kind WHEN 'revert_surface' THEN 'stabilize' WHEN 'change_coupling' THEN 'decouple' WHEN 'dependency_shock' THEN 'dependencies' ELSE 'consolidate' END AS wave, least(20.0, greatest(0.25, 0.25 + 2.5 * severity)) AS dd FROM risks)
    SELECT id, kind, path, wave, CAST(CASE wave WHEN 'stabilize' THEN 1 WHEN 'decouple' THEN 2 WHEN 'dependencies' THEN 3 ELSE 4 END AS BIGINT) AS rank, round(dd, 3)::DOUBLE AS days, CASE WHEN dd >= 4 THEN 'L' WHEN dd >= 1.5 THEN 'M' ELSE 'S' END AS size,
      round(least(0.35, 0.4 * severity), 3)::DOUBLE AS gain, priority, CASE WHEN wave <> 'stabilize' THEN (SELECT id FROM w WHERE wave = 'stabilize' ORDER BY severity DESC, id LIMIT 1) END AS depends_on FROM w""",
)
def _(spark, d):
    return risk.plan_steps(risks(spark, d))


@query(
    "selection_pressure",
    """WITH i AS (SELECT o_orderstatus = 'O' AS o, o_orderpriority = '1-URGENT' AS b, o_orderkey % 11 = 0 AS re, o_orderkey % 5 = 0 AS pl, o_orderstatus = 'F' AS m FROM orders),
    s AS (SELECT count(*) FILTER (NOT pl AND o) AS open, count(*) FILTER (NOT pl AND NOT o) AS closed, count(*) FILTER (NOT pl AND b) AS bugs, count(*) FILTER (NOT pl AND re) AS reopened, count(*) FILTER (pl) AS pulls, count(*) FILTER (pl AND m) AS merged FROM i)
    SELECT open, closed, bugs, reopened, pulls, merged, round(0.45 * bugs / (open + closed) + 0.25 * reopened / (open + closed) + 0.2 * open / (open + closed) + 0.1 * (1 - merged / pulls), 6) AS score FROM s""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    bug = F.col("o_orderpriority") == "1-URGENT"
    issues = o.select((F.col("o_orderstatus") == "O").alias("is_open"), bug.alias("is_bug"), bug.cast("int").alias("n_bug_labels"), (F.col("o_orderkey") % 11 == 0).alias("reopened"), (F.col("o_orderkey") % 5 == 0).alias("is_pull"), (F.col("o_orderstatus") == "F").alias("merged"))
    return risk.selection_pressure(issues).select("open", "closed", "bugs", "reopened", "pulls", "merged", F.round("score", 6).alias("score"))


_HIST = """, y AS (SELECT year(ts) AS run, 1 / (1 + 0.002 * avg(churn) + 3 * avg(is_revert::INT)) AS code_stability, avg(is_revert::INT) AS revert_rate, avg(churn) AS avg_churn FROM commits GROUP BY 1),
    h AS (UNPIVOT y ON code_stability, revert_rate, avg_churn INTO NAME metric VALUE value)"""


def history(spark, d):
    c = commits(spark, d).groupBy(F.year("ts").alias("run")).agg(F.avg("churn").alias("avg_churn"), F.avg(F.col("is_revert").cast("int")).alias("revert_rate"))
    c = c.withColumn("code_stability", 1 / (1 + 0.002 * F.col("avg_churn") + 3 * F.col("revert_rate")))
    return c.unpivot(["run"], ["code_stability", "revert_rate", "avg_churn"], "metric", "value")


@query(
    "snapshot_diff",
    C
    + _HIST
    + """, l AS (SELECT run, metric, value, lag(value) OVER (PARTITION BY metric ORDER BY run) AS previous FROM h)
    SELECT CAST(run AS INTEGER) AS run, metric, round(value, 6) AS value, round(previous, 6) AS previous, round(value - previous, 6) AS delta,
      CASE WHEN abs(value - previous) < 1e-4 THEN 'unchanged' WHEN (value > previous) = (metric = 'code_stability') THEN 'better' ELSE 'worse' END AS verdict FROM l WHERE previous IS NOT NULL""",
)
def _(spark, d):
    return risk.snapshot_diff(history(spark, d)).withColumns({c: F.round(c, 6) for c in ("value", "previous", "delta")})


@query("gate", C + RISKS + """, s AS (SELECT 1 / (1 + 0.002 * avg(churn) + 3 * avg(is_revert::INT)) AS st FROM commits), n AS (SELECT count(*) AS c FROM risks WHERE severity >= 0.85 AND kind <> 'low_fitness')
    SELECT st >= 0.35 AND c <= 0 AS passed, concat_ws(',', CASE WHEN st < 0.35 THEN 'stability' END, CASE WHEN c > 0 THEN 'new_p0' END) AS failures, '' AS warnings, c AS new_p0 FROM s, n""")
def _(spark, d):
    now = risks(spark, d)
    stable = commits(spark, d).agg((1 / (1 + 0.002 * F.avg("churn") + 3 * F.avg(F.col("is_revert").cast("int")))).alias("code_stability"))
    return risk.gate(stable, risk.new_critical(now, now.filter("kind = 'low_fitness'")), stable.select(F.lit(0.2).alias("fatigue")))


@query(
    "test_gate",
    C + """, g AS (SELECT author AS run, 1 / (1 + 0.002 * avg(churn) + 3 * avg(is_revert::INT)) AS st, count(*) FILTER (subject = '1-URGENT') % 3 > 0 AS ok, CASE WHEN count(*) % 5 > 0 THEN avg((subject = '5-LOW')::INT) END AS now, 0.2::DOUBLE AS prev FROM commits GROUP BY 1),
    f AS (SELECT *, list_filter([CASE WHEN st < 0.7 THEN 'stability' END, CASE WHEN NOT ok THEN 'tests' END, CASE WHEN now IS NULL THEN 'coverage_missing' END, CASE WHEN now - prev + 1e-12 < 0.005 THEN 'coverage' END], lambda x: x IS NOT NULL) AS l FROM g)
    SELECT run, len(l) = 0 AS passed, array_to_string(l, ',') AS failures, '' AS warnings FROM f""",
)
def _(spark, d):
    """Every nation's log as a run: its gate, then its tests and their coverage."""
    from tidemark.operators.graph import cut

    c = cut(commits(spark, d), "runs").groupBy(F.col("author").alias("run")).agg(
        (1 / (1 + 0.002 * F.avg("churn") + 3 * F.avg(F.col("is_revert").cast("int")))).alias("st"), (F.count_if(F.col("subject") == "1-URGENT") % 3 > 0).alias("ok"), F.when(F.count("*") % 5 > 0, F.avg((F.col("subject") == "5-LOW").cast("int"))).alias("coverage"), F.lit(0.2).alias("previous_coverage")
    )
    gates = c.select("run", (F.col("st") >= 0.7).alias("passed"), F.when(F.col("st") < 0.7, "stability").otherwise("").alias("failures"), F.lit("").alias("warnings"))
    return risk.gate_with_tests(gates, c, "run", require_coverage=True, least_gain=0.005)


@query(
    "budget_breach",
    """WITH c AS (SELECT user_id AS run, event_id AS at_, value / 1000 * CASE event_type WHEN 'error' THEN 2.0::DOUBLE WHEN 'signup' THEN 1.0::DOUBLE ELSE 0 END AS cost FROM events),
    s AS (SELECT run, at_, sum(cost) OVER (PARTITION BY run ORDER BY at_) AS spent FROM c) SELECT run, min(at_) AS "at" FROM s WHERE spent > 0.5 GROUP BY 1""",
)
def _(spark, d):
    usage = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.col("event_type").alias("model"), F.col("value").alias("tokens"))
    prices = spark.createDataFrame([("error", 2.0), ("signup", 1.0)], "model string, per_1k double")
    return risk.budget_breach(usage, prices, 0.5).select("run", "at")


@query(
    "snapshot_set_changes",
    C
    + """, p AS (SELECT path, arg_max(author, sha) AS v FROM files JOIN commits USING (sha) WHERE year(ts) < 1998 GROUP BY 1), n AS (SELECT path, arg_max(author, sha) AS v FROM files JOIN commits USING (sha) WHERE year(ts) >= 1998 GROUP BY 1)
    SELECT path, CASE WHEN p.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN p.v IS NULL THEN 0.45 WHEN n.v IS NULL THEN 0.4 ELSE 0.55 END::DOUBLE AS urgency FROM p FULL JOIN n USING (path) WHERE p.v IS DISTINCT FROM n.v""",
)
def _(spark, d):
    rows = commit_files(spark, d).join(commits(spark, d).select("sha", "ts", "author"), "sha")
    half = lambda c: rows.filter(c).groupBy("path").agg(F.max_by("author", "sha").alias("v"))
    return risk.set_changes(half(F.year("ts") < 1998), half(F.year("ts") >= 1998), "path", "v")


def the_ledger(spark, d):
    files, c = commit_files(spark, d), commits(spark, d)
    alloc = metrics.allocations(files, c).join(c.select("sha", "ts"), "sha")
    link = lambda rid, role: F.array(F.struct(rid.alias("record_id"), F.lit(role).alias("role")))
    clades = files.groupBy("clade").agg(F.countDistinct("path").alias("n"))
    lines = files.groupBy("path").agg(F.count("*").alias("t"), F.first("clade").alias("clade"))
    r = risks(spark, d)
    return risk.ledger(
        risk.ledger_rows(clades, "clade", [F.col("clade")], clade=F.col("clade")),
        risk.ledger_rows(lines, "lineage", [F.col("path")], path=F.col("path"), clade=F.col("clade"), links=link(F.concat(F.lit("clade:"), "clade"), "clade")),
        risk.ledger_rows(alloc, "delta", [F.col("sha"), F.col("path")], when=F.col("ts"), path=F.col("path"), clade=F.col("clade"), links=link(F.concat(F.lit("clade:"), "clade"), "clade")),
        risk.ledger_rows(coupling.gene_flow(files), "flow", [F.col("a"), F.col("b")], links=F.array(F.struct(F.concat(F.lit("clade:"), "a").alias("record_id"), F.lit("clade").alias("role")), F.struct(F.concat(F.lit("clade:"), "b").alias("record_id"), F.lit("clade").alias("role")))),
        risk.ledger_rows(r, "failure_point", [F.col("id"), F.col("path")], path=F.col("path"), summary=F.col("kind")),
    )


@query(
    "ledger_counts",
    C
    + RISKS
    + """ SELECT 'clade' AS kind, count(DISTINCT clade) AS n FROM files UNION ALL SELECT 'lineage', count(DISTINCT path) FROM files UNION ALL SELECT 'delta', count(*) FROM files
    UNION ALL SELECT 'flow', count(*) FROM (SELECT DISTINCT x.clade, y.clade FROM files x JOIN files y ON x.sha = y.sha AND x.clade < y.clade) UNION ALL SELECT 'failure_point', count(*) FROM risks""",
)
def _(spark, d):
    return risk.kind_counts(the_ledger(spark, d)).select("kind", "n")


@query("timeline", C + " SELECT 'delta:' || sha || ':' || path AS id, strftime(ts, '%Y-%m-%d') AS day, path FROM files JOIN commits USING (sha) WHERE clade = 'Brand#2' AND ts >= TIMESTAMP '1999-01-01'")
def _(spark, d):
    rows = risk.ledger_query(the_ledger(spark, d), clade="Brand#2", kinds=["delta"], since="1999-01-01")
    return rows.select("id", F.date_format("at", "yyyy-MM-dd").alias("day"), "path")


@query("path_pack", C + RISKS + ", a AS (SELECT path, 'delta' AS kind FROM files UNION ALL SELECT DISTINCT path, 'lineage' FROM files UNION ALL SELECT path, 'failure_point' FROM risks WHERE path IS NOT NULL) SELECT path, count(*) AS n, count(DISTINCT kind) AS kinds FROM a GROUP BY 1")
def _(spark, d):
    return risk.path_pack(the_ledger(spark, d)).select("path", "n", "kinds")


@query("frame_expansion", C + RISKS + " SELECT 'frame:risk:' || id AS frame, 'failure_point:' || id || ':' || path AS id, 'failure_point' AS kind, path FROM risks WHERE path IS NOT NULL ")
def _(spark, d):
    return risk.expand(risk.frames(risks(spark, d)).filter("claim is not null"), the_ledger(spark, d)).filter("path is not null")


@query(
    "directional_checks",
    C
    + _HIST
    + """, e AS (SELECT * FROM (VALUES ('code_stability', 'up_or_flat'), ('revert_rate', 'down_or_flat'), ('avg_churn', 'nonzero')) v(metric, expect)), b AS (SELECT metric, value AS b FROM h WHERE run = 1996), a AS (SELECT metric, value AS a FROM h WHERE run = 1999)
    SELECT metric, expect, CASE expect WHEN 'up_or_flat' THEN a - b >= -0.02 WHEN 'down_or_flat' THEN a - b <= 0.02 ELSE a <> 0 END AS ok FROM e JOIN b USING (metric) JOIN a USING (metric)""",
)
def _(spark, d):
    h = history(spark, d)
    expects = spark.createDataFrame([("code_stability", "up_or_flat"), ("revert_rate", "down_or_flat"), ("avg_churn", "nonzero")], "metric string, expect string")
    return risk.directional(h.filter("run = 1996").select("metric", "value"), h.filter("run = 1999").select("metric", "value"), expects)


@query("path_histograms", C + " SELECT 'layer' AS dimension, layer AS value, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'clade', clade, count(*) FROM files GROUP BY 2")
def _(spark, d):
    from tidemark.operators.taxonomy import histogram

    return histogram(commit_files(spark, d), "layer", "clade")


_TYPES = ", t AS (SELECT path, clade AS l1, layer AS l2, CAST(sum(insertions) AS BIGINT) AS churn FROM files GROUP BY ALL)"


@query(
    "type_rollup",
    C
    + _TYPES
    + """ SELECT '' AS prefix, 0 AS depth, count(*) AS n, CAST(sum(churn) AS BIGINT) AS churn, 0.5::DOUBLE AS mean_conf FROM t UNION ALL SELECT l1, 1, count(*), CAST(sum(churn) AS BIGINT), 0.5 FROM t GROUP BY l1
    UNION ALL SELECT l1 || '/' || l2, 2, count(*), CAST(sum(churn) AS BIGINT), 0.5 FROM t GROUP BY l1, l2""",
)
def _(spark, d):
    from tidemark.operators.taxonomy import type_rollup

    types = commit_files(spark, d).groupBy("path", F.col("clade").alias("l1"), F.col("layer").alias("l2")).agg(F.sum("insertions").alias("churn")).withColumn("confidence", F.lit(0.5))
    return type_rollup(types, ["l1", "l2"])


@query("layer_hierarchy", C + " SELECT layer, clade AS top, count(*) AS n, CAST(GROUPING(layer, clade) AS BIGINT) AS level FROM files GROUP BY ROLLUP (layer, clade)")
def _(spark, d):
    from tidemark.operators.taxonomy import layer_hierarchy

    return layer_hierarchy(commit_files(spark, d).withColumnRenamed("clade", "top"))


@query("dominant_clades", C + ", s AS (SELECT sha, clade, sum(insertions) AS w FROM files GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY w DESC, clade) AS k FROM s) SELECT sha, clade FROM r WHERE k = 1")
def _(spark, d):
    from tidemark.operators.taxonomy import dominant

    return dominant(commit_files(spark, d), "sha", "clade", "insertions")


@query(
    "crowded_niches",
    C + ", k AS (SELECT clade, count(DISTINCT path) AS n FROM files GROUP BY 1) SELECT clade, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () > 0.4 AS crowded FROM k",
)
def _(spark, d):
    from tidemark.operators.taxonomy import niches

    k = commit_files(spark, d).groupBy("clade").agg(F.countDistinct("path").alias("n_files")).withColumn("top_layer", F.lit("core"))
    return niches(k).withColumn("share", F.round("share", 6))


@query(
    "attention_caps",
    C + ", o AS (SELECT path, clade, count(*) AS touches FROM files GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY clade ORDER BY touches DESC, path) AS k FROM o) SELECT path, clade, touches FROM r WHERE k <= 4 ORDER BY touches DESC, path LIMIT 12",
)
def _(spark, d):
    from tidemark.operators.taxonomy import capped

    o = commit_files(spark, d).groupBy("path", "clade").agg(F.count("*").alias("touches"))
    return capped(o, "clade", [F.desc("touches"), F.col("path")], 4, 12)
