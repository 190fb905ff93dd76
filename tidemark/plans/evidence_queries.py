"""Queries over signals, hypotheses, drift and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coupling, evidence, objectives, series, texts
from tidemark.operators.graph import cut
from tidemark.plans.core_queries import EDGES, C
from tidemark.plans.registry import query
from tidemark.plans.series_queries import _MK, _P, _Z, MONTHS, SAMPLES, _monthly_long, rounded
from tidemark.plans.testmap import commit_files, commits, table
from tidemark.plans.text_queries import _EMB


@query(
    "signal_scores",
    C
    + EDGES
    + """, au AS (SELECT author AS repo, count(*) AS n, count(*) FILTER (n_files > 12 OR churn > 2500) AS filtered, 1 / (1 + 0.002 * avg(churn) + 3 * avg(is_revert::INT)) AS stability, count(DISTINCT email) AS n_authors FROM commits GROUP BY 1),
    ed AS (SELECT repo, count(*) AS n_edges, count(*) FILTER (weight >= 3) AS n_strong, max(weight) AS top FROM (SELECT c.author AS repo, x.path AS a, y.path AS b, count(*) AS weight FROM files x JOIN files y ON x.sha = y.sha AND x.path < y.path JOIN commits c ON c.sha = x.sha WHERE x.sha IN (SELECT sha FROM small) GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1),
    ow AS (SELECT repo, max(k) AS most FROM (SELECT author AS repo, email, count(*) AS k FROM commits GROUP BY 1, 2) GROUP BY 1),
    lo AS (SELECT au.*, n_edges, coalesce(n_strong, 0) AS n_strong, top, CASE WHEN n > 500 THEN 5 ELSE 0 END AS n_hot, most / n AS score, n % 2 = 0 AS cx FROM au LEFT JOIN ed USING (repo) JOIN ow USING (repo)),
    si AS (SELECT repo, n, 'change_coupling' AS signal, top::DOUBLE AS value, round(least(0.95::DOUBLE, 0.25 + 0.35 * least(1.0::DOUBLE, n_strong / 8) + 0.25 * least(1.0::DOUBLE, n / 80) + 0.15 * (1 - least(1.0::DOUBLE, filtered / greatest(1, n)))), 4) AS confidence, n_edges AS n_evidence, 1 AS o FROM lo WHERE n_edges IS NOT NULL
      UNION ALL SELECT repo, n, 'hotspot_churn_complexity', score, round(least(0.95::DOUBLE, 0.3 + 0.3 * least(1.0::DOUBLE, n / 60) + 0.25 * CASE WHEN cx THEN 1.0 ELSE 0.35 END + 0.15 * least(1.0::DOUBLE, 2 * score)), 4), n_hot, 2 FROM lo WHERE n_hot > 0
      UNION ALL SELECT repo, n, 'offboarding_risk', score, round(least(0.95::DOUBLE, 0.25 + 0.3 * least(1.0::DOUBLE, n_authors / 5) + 0.25 * least(1.0::DOUBLE, n / 60) + 0.2 * least(1.0::DOUBLE, score)), 4), n_authors, 3 FROM lo
      UNION ALL SELECT repo, n, 'code_stability', stability, round(least(0.9::DOUBLE, 0.2 + 0.5 * least(1.0::DOUBLE, n / 80) + 0.2 * stability), 4), n, NULL FROM lo)
    SELECT repo, signal, round(value, 6) AS value, confidence::DOUBLE AS confidence, CASE WHEN n < 10 THEN 'insufficient' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS reliability, n_evidence,
      CASE WHEN o IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY repo ORDER BY (o IS NULL), confidence * (0.5 + abs(value)) DESC, o) AS INTEGER) END AS hero FROM si""",
)
def _(spark, d):
    """Signals of every nation's log."""
    from tidemark.operators.repos import analyze

    c = cut(commits(spark, d).withColumnsRenamed({"author": "repo"}), "logs")
    files = commit_files(spark, d).join(c.select("sha", "repo"), "sha")
    edges = analyze(files, c, "coupling")["coupling"].groupBy("repo").agg(F.count("*").alias("n_edges"), F.count_if(F.col("weight") >= 3).alias("n_strong"), F.max("weight").alias("top_weight"))
    n = c.groupBy("repo").agg(F.count("*").alias("n"), F.count_if((F.col("n_files") > coupling.MAX_FILES) | (F.col("churn") > coupling.MAX_CHURN)).alias("filtered"), (1 / (1 + 0.002 * F.avg("churn") + 3 * F.avg(F.col("is_revert").cast("int")))).alias("stability"), F.countDistinct("email").alias("n_authors"))
    most = c.groupBy("repo", "email").agg(F.count("*").alias("k")).groupBy("repo").agg(F.max("k").alias("most"))
    logs = n.join(edges, "repo", "left").join(most, "repo").fillna(0, ["n_strong"])
    logs = logs.withColumns({"n_hot": F.when(F.col("n") > 500, 5).otherwise(0), "hot_score": F.col("most") / F.col("n"), "mastery_drop": F.col("most") / F.col("n"), "has_complexity": F.col("n") % 2 == 0})
    return evidence.signal_scores(logs, "repo").withColumn("value", F.round("value", 6))


_LAWS = ", ".join(f"('{k}', '{s}', '{t}')" for k, (s, t) in evidence.LAWS.items())


@query(
    "hypothesis_panel",
    C
    + MONTHS
    + _MK
    + _P
    + f""", te AS (SELECT CASE id WHEN 'churn' THEN 'churn_rate' ELSE 'work_rate' END AS series, n, p, trend FROM labels), nc AS (SELECT count(*) AS n FROM commits),
    la AS (SELECT l.*, CASE WHEN trend = 'rising' THEN 'support' WHEN trend = 'falling' THEN 'contradict' WHEN trend = 'flat' THEN 'weak' END AS label, te.n AS w, p FROM (VALUES {_LAWS}) l(law, series, claim) LEFT JOIN te USING (series)),
    ba AS (SELECT la.*, nc.n, CASE WHEN nc.n < 8 THEN 0.15 WHEN nc.n < 20 THEN 0.35 WHEN nc.n < 80 THEN 0.55 + 0.25 * (nc.n - 20) / 60 ELSE least(0.95, 0.8 + 0.001 * (nc.n - 80)) END::DOUBLE AS base FROM la, nc)
    SELECT 'H-' || law AS id, claim, CASE WHEN n < 12 THEN 'insufficient' WHEN label = 'support' AND p >= 0.05 THEN 'weak' WHEN label IN ('support', 'contradict') THEN label ELSE 'weak' END AS verdict,
      round(CASE WHEN p IS NULL OR w < 4 THEN least(base, 0.25) ELSE least(0.95, 0.4 * base + 0.6 * base * greatest(0, 1 - least(1.0, p))) END, 3)::DOUBLE AS confidence, CASE WHEN p IS NULL THEN 'proxy_only' ELSE 'mann_kendall_windows+proxy' END AS method, n FROM ba""",
)
def _(spark, d):
    """All eight laws on the trends of monthly commits and churn; the two series without a test leave their laws to the proxies."""
    t = series.with_trend_labels(series.mann_kendall(_monthly_long(spark, d)))
    tests = cut(t.select(F.when(F.col("id") == "churn", "churn_rate").otherwise("work_rate").alias("series"), "n", "p", "trend"), "tests")
    labels = spark.createDataFrame([(k, s) for k, (s, _t) in evidence.LAWS.items()], "law string, series string").join(tests, "series", "left")
    label = F.when(F.col("trend") == "rising", "support").when(F.col("trend") == "falling", "contradict").when(F.col("trend") == "flat", "weak")
    logs = commits(spark, d).agg(F.count("*").alias("n"))
    # The normal tail is approximated in the SQL, to seven digits.
    return evidence.hypothesis_panel(logs.withColumn("k", F.lit(1)), tests.withColumn("k", F.lit(1)), labels.select(F.lit(1).alias("k"), "law", label.alias("label")), "k").drop("k").withColumn("confidence", F.round("confidence", 3))


_DOCS = """WITH r AS (SELECT doc_id AS id, text FROM documents), h AS (SELECT doc_id AS id, source AS clade, doc_id * 2 <= (SELECT max(doc_id) FROM documents) AS early, n_chars AS churn FROM documents)"""
_UNIT = _EMB + ", u AS (SELECT e.*, val / sqrt(sum(val * val) OVER (PARTITION BY id)) AS x FROM e)"


def _halves(spark, d):
    docs = table(spark, d, "documents")
    last = docs.agg(F.max("doc_id").alias("_m"))
    rows = cut(docs.crossJoin(F.broadcast(last)).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("clade"), (F.col("doc_id") * 2 <= F.col("_m")).alias("early"), F.col("n_chars").alias("churn")), "halves")
    return rows, texts.unit(texts.hash_embedding(rows.select("id", "text"))).join(rows.select("id", "early"), "id")


@query(
    "clade_drift",
    _DOCS
    + _UNIT
    + """, n AS (SELECT clade, early, count(DISTINCT id) AS n FROM h WHERE id IN (SELECT id FROM u) GROUP BY 1, 2), m AS (SELECT clade, early, idx, sum(x) / max(n) AS x FROM u JOIN h USING (id) JOIN n USING (clade, early) GROUP BY 1, 2, 3),
    j AS (SELECT coalesce(p.clade, q.clade) AS clade, coalesce(p.x, 0) AS p, coalesce(q.x, 0) AS q FROM (SELECT * FROM m WHERE early) p FULL JOIN (SELECT * FROM m WHERE NOT early) q ON p.clade = q.clade AND p.idx = q.idx),
    s AS (SELECT clade, sum(p * q) AS d, sum(p * p) AS a, sum(q * q) AS b FROM j GROUP BY 1)
    SELECT c.clade, round(CASE WHEN a > 0 AND b > 0 THEN 1 - d / sqrt(a * b) ELSE 0 END, 6) AS drift FROM (SELECT DISTINCT clade FROM h) c LEFT JOIN s ON s.clade IS NOT DISTINCT FROM c.clade""",
)
def _(spark, d):
    """Drift of every source of documents between the first and the second half of the ids."""
    rows, v = _halves(spark, d)
    return rounded(evidence.clade_drift(v, rows.select("id", "clade")), "drift")


@query(
    "neutral_churn",
    _DOCS
    + _UNIT
    + """, m AS (SELECT early, idx, sum(x) / (SELECT count(DISTINCT id) FROM u JOIN h k USING (id) WHERE k.early = h.early) AS x FROM u JOIN h USING (id) GROUP BY 1, 2),
    j AS (SELECT coalesce(p.x, 0) AS p, coalesce(q.x, 0) AS q FROM (SELECT * FROM m WHERE early) p FULL JOIN (SELECT * FROM m WHERE NOT early) q USING (idx)), g AS (SELECT 1 - sum(p * q) / sqrt(sum(p * p) * sum(q * q)) AS drift FROM j),
    cs AS (SELECT sum(churn) FILTER (early) AS e, sum(churn) FILTER (NOT early) AS l FROM h) SELECT round(drift, 6) AS drift, round(greatest(0, least(1.0::DOUBLE, (l / e - 1) * 0.5 * (1 - drift))), 6)::DOUBLE AS neutral_churn FROM g, cs""",
)
def _(spark, d):
    rows, v = _halves(spark, d)
    return rounded(evidence.neutral_churn(rows, v), "drift", "neutral_churn")


@query(
    "state_trajectory",
    C
    + SAMPLES
    + f""", he AS (SELECT layer, sum(insertions) FILTER (sha % 2 = 0) - sum(insertions) FILTER (sha % 2 = 1) AS delta FROM files GROUP BY 1)
    SELECT month, {_Z}, round((SELECT avg(is_revert::INT) FROM commits), 6) AS selection, round((SELECT avg(delta) FROM he), 6) AS typed_heat FROM base""",
)
def _(spark, d):
    c = cut(commits(spark, d), "commits")
    heat = commit_files(spark, d).groupBy("layer").agg((F.sum(F.when(F.col("sha") % 2 == 0, F.col("insertions"))) - F.sum(F.when(F.col("sha") % 2 == 1, F.col("insertions")))).alias("delta"))
    out = evidence.state_trajectory(series.state_samples(series.monthly(c), series.monthly_load(c)), c.agg(F.avg(F.col("is_revert").cast("int")).alias("score")), heat)
    keep = [x for x in out.columns if x.startswith("z_")] + ["selection", "typed_heat"]
    return rounded(out.select("month", *keep), *keep)


_SPECS = ["debt", "raise_stability", "metric:churn.mean:min:60", "metric:churn.mean:MAX", "metric", "tests", "Coverage", "", "metric:absent:up:1"]


@query(
    "objective_runs",
    C
    + """, y AS (SELECT author AS repo, year(ts) AS run, avg(churn) AS churn, avg(is_revert::INT) AS debt, 1 / (1 + 0.002 * avg(churn) + 3 * avg(is_revert::INT)) AS st, count(*) % 6 AS worse FROM commits GROUP BY 1, 2),
    o AS (SELECT * FROM (VALUES ('debt', 'debt.score', false, NULL), ('raise_stability', 'stability.composite', true, NULL), ('metric:churn.mean:min:60', 'churn.mean', false, 60.0), ('metric:churn.mean:MAX', 'churn.mean', true, NULL), ('metric', 'debt.score', false, NULL),
      ('tests', 'tests.score', true, NULL), ('Coverage', 'tests.score', true, NULL), ('', 'debt.score', false, NULL), ('metric:absent:up:1', 'absent', true, 1.0)) v(spec, metric, higher, target)),
    s AS (SELECT repo, run, spec, higher, target, worse, st, CASE metric WHEN 'debt.score' THEN debt WHEN 'stability.composite' THEN st WHEN 'churn.mean' THEN churn ELSE 0 END AS value FROM y, o),
    l AS (SELECT *, lag(value) OVER (PARTITION BY repo, spec ORDER BY run) AS previous, value - lag(value) OVER (PARTITION BY repo, spec ORDER BY run) AS delta FROM s),
    i AS (SELECT *, coalesce(abs(delta) >= 1e-9 AND CASE WHEN higher THEN delta > 0 ELSE delta < 0 END, false) AS improved, st >= 0.6 AND worse <= 3 AS held FROM l)
    SELECT repo, CAST(run AS INTEGER) AS run, spec, round(value, 6) AS value, round(delta, 6) AS delta, improved, coalesce(CASE WHEN higher THEN value >= target ELSE value <= target END, false) AS reached, held AS constraints_ok,
      CASE WHEN previous IS NULL THEN 'baseline' WHEN improved AND held THEN 'improved' WHEN improved THEN 'improved, constraints failed' ELSE 'not improved' END AS note FROM i""",
)
def _(spark, d):
    """Objectives by their specs, over every nation's years as runs."""
    y = cut(commits(spark, d).groupBy(F.col("author").alias("repo"), F.year("ts").alias("run")).agg(F.avg("churn").alias("churn"), F.avg(F.col("is_revert").cast("int")).alias("debt"), (F.count("*") % 6).alias("n")), "years")
    y = y.withColumn("st", 1 / (1 + 0.002 * F.col("churn") + 3 * F.col("debt")))
    signals = y.select("repo", "run", F.stack(F.lit(3), F.lit("churn.mean"), F.col("churn"), F.lit("debt.score"), F.col("debt"), F.lit("stability.composite"), F.col("st")).alias("metric", "value"))
    wanted = objectives.parsed(spark.createDataFrame([(x,) for x in _SPECS], "spec string"))
    return rounded(objectives.scored(wanted, signals, y, "repo", least_stability=0.6).drop("previous"), "value", "delta")
