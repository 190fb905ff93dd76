"""Queries over scores, checks and reports that combine other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph, metrics, reports, risk, series, taxonomy, traces
from tidemark.plans.core_queries import C, SEQ
from tidemark.plans.registry import query
from tidemark.plans.series_queries import _P, MONTHS, rounded
from tidemark.plans.testmap import commit_files, commits, table

PATHS = """p AS (SELECT p_partkey AS k, p_brand || '/' || CASE p_partkey % 8 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'tests/b.ts' WHEN 2 THEN 'package.json' WHEN 3 THEN 'docs/README.md' WHEN 4 THEN 'go.sum' WHEN 5 THEN 'lib/c_test.rs' WHEN 6 THEN 'Makefile' ELSE 'x.ZIG' END AS path FROM part)"""


def paths(spark, d):
    names = ("src/a.py", "tests/b.ts", "package.json", "docs/README.md", "go.sum", "lib/c_test.rs", "Makefile", "x.ZIG")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat("p_brand", F.lit("/"), name).alias("path"))


@query(
    "path_flags",
    f"""WITH {PATHS} SELECT k, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN '' THEN 'unknown' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'docs' WHEN 'json' THEN 'config' WHEN 'rs' THEN 'rust' ELSE lower(regexp_extract(path, '\\.([^./]+)$', 1)) END AS language,
    regexp_matches(path, '(package\\.json|go\\.sum)$') AS manifest, regexp_matches(path, '(^|/)tests?(/|$)|_test\\.|spec\\.') AS test FROM p""",
)
def _(spark, d):
    p = F.col("path")
    return paths(spark, d).select("k", T.language_of(p).alias("language"), p.rlike(T.DEPENDENCY_FILE).alias("manifest"), p.rlike(T.TEST_PATH).alias("test"))


@query(
    "impasse_kinds",
    """WITH e AS (SELECT event_type, value, event_id, CASE WHEN event_type = 'error' THEN 'rolled_back' WHEN value > 100 THEN 'accepted_no_delta' ELSE 'none' END AS outcome FROM events)
    SELECT CASE WHEN event_id % 17 = 0 THEN 'insufficient' WHEN event_id % 13 = 0 THEN 'verify_fail' WHEN event_id % 11 = 0 THEN 'fence_refuse' WHEN outcome = 'accepted_no_delta' THEN 'accepted_no_gain' WHEN event_id % 7 = 0 THEN 'path_tie' END AS impasse, count(*) AS n FROM e GROUP BY 1""",
)
def _(spark, d):
    i = F.col("event_id")
    outcome = F.when(F.col("event_type") == "error", "rolled_back").when(F.col("value") > 100, "accepted_no_delta").otherwise("none")
    kind = traces.impasse(i % 17 == 0, i % 13 == 0, i % 11 == 0, outcome, i % 7 == 0)
    return table(spark, d, "events").groupBy(kind.alias("impasse")).agg(F.count("*").alias("n"))


_STAGES = "CASE WHEN o_orderstatus = 'F' THEN 'maturity' WHEN o_orderstatus = 'P' THEN 'disturbance' ELSE 'growth' END"


@query(
    "majority_stages",
    f"""WITH t AS (SELECT p_brand AS l1, p_type AS l2, CASE WHEN p_size < 20 THEN 'pioneer' WHEN p_size < 40 THEN 'growth' ELSE 'maturity' END AS stage FROM part),
    x AS (SELECT l1 AS prefix, stage FROM t UNION ALL SELECT l1 || '/' || l2, stage FROM t), c AS (SELECT prefix, stage, count(*) AS n FROM x GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, stage) AS k, sum(n) OVER (PARTITION BY prefix) AS total FROM c) SELECT prefix, stage, round(n / total, 6) AS share FROM r WHERE k = 1""",
)
def _(spark, d):
    size = F.col("p_size")
    t = table(spark, d, "part").select(F.col("p_brand").alias("l1"), F.col("p_type").alias("l2"), F.when(size < 20, "pioneer").when(size < 40, "growth").otherwise("maturity").alias("stage"))
    return rounded(taxonomy.majority_stage(t, ["l1", "l2"], "stage"), "share")


@query(
    "debt_scores",
    """WITH c AS (SELECT source, count(*) FILTER (contains(lower(text), 'license')) AS dep, count(*) FILTER (contains(text, '!')) AS todo, count(DISTINCT lang) AS mistakes FROM documents GROUP BY 1)
    SELECT source, round(0.45 * ln(1 + dep) / ln(81) + 0.25 * ln(1 + todo) / ln(41) + 0.3 * least(1.0, mistakes / 4), 6)::DOUBLE AS score FROM c""",
)
def _(spark, d):
    from tidemark.operators.texts import debt_score

    per = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.lower("text").contains("license")).alias("dep"), F.count_if(F.col("text").contains("!")).alias("todo"), F.countDistinct("lang").alias("mistakes"))
    return per.select("source", F.round(debt_score(F.col("dep"), F.col("todo"), F.col("mistakes")), 6).alias("score"))


_BUNDLE = """, tt AS (SELECT count(*) AS n FROM files GROUP BY path), en AS (SELECT -sum(n / s * log2(n / s + 1e-12)) AS ent, max(n) AS top FROM tt, (SELECT sum(n)::DOUBLE AS s FROM tt)),
    mm AS (SELECT avg(churn) FILTER (seq >= n - greatest(1, n // 3)) AS r, coalesce(avg(churn) FILTER (seq < n - greatest(1, n // 3)), 0) AS o FROM placed),
    bb AS (SELECT count(*) AS n, avg(is_revert::INT) AS revert_rate, avg(churn) AS churn, (SELECT count(DISTINCT sha) FROM files WHERE layer = 'ECONOMY') / count(*) AS dependency_rate FROM commits),
    bundle AS (SELECT *, (r - o) / (o + 1) AS momentum, 1 / (1 + 0.002 * churn + 3 * revert_rate + 0.5 * top / n) AS stability FROM bb, mm, en)"""


def bundle(spark, d):
    return metrics.metric_bundle(commits(spark, d), commit_files(spark, d), F.col("layer") == "ECONOMY")


@query(
    "stability_parts",
    C
    + SEQ
    + _BUNDLE
    + """, u AS (SELECT avg((layer = 'PROMO')::INT) AS u FROM files), v AS (SELECT 1 / (1 + 2.2 * (0.9 * top / n + 0.5 * u + 0.4 * 0.3)) AS a, 1 / (1 + 4 * revert_rate) AS b, 1 / (1 + 3.5 * dependency_rate) AS c, 1 / (1 + 2.5 * 0.25) AS e, 1 - exp(-2.2 * 0.5) AS t FROM bundle, u)
    SELECT round(a, 6) AS structural, round(b, 6) AS behavioral, round(c, 6) AS dependency, round(e, 6)::DOUBLE AS rhythm, round(t, 6) AS test, round(0.25 * a + 0.25 * b + 0.15 * c + 0.15 * e + 0.2 * t, 6) AS composite FROM v""",
)
def _(spark, d):
    files = commit_files(spark, d)
    one = bundle(spark, d).crossJoin(metrics.touch_counts(files).agg(F.max("touches").alias("top"))).crossJoin(files.agg(F.avg((F.col("layer") == "PROMO").cast("int")).alias("u")))
    out = metrics.stability_v2(one, F.lit(0.5), F.col("top") / F.col("commit_count"), F.col("u"), F.lit(0.3))
    return out.select(*[F.round(c, 6).alias(c) for c in ("structural", "behavioral", "dependency", "rhythm", "test", "composite")])


@query(
    "fragility_scores",
    """WITH s AS (SELECT s_nationkey AS nation, count(*) AS packages, avg((s_acctbal < 0)::INT) AS rate, count(*) FILTER (s_acctbal < -500) AS abandoned, max(s_suppkey % 12) AS depth, bool_or(s_suppkey % 9 = 0) AS locked FROM supplier GROUP BY 1)
    SELECT nation, round(least(1.0, 0.35 * least(1.0, 4 * rate) + 0.35 * least(1.0, depth / 10) + 0.15 * CASE WHEN locked THEN 0 ELSE 0.8 END + 0.15 * least(1.0, abandoned / 3) + 0.1 * least(1.0, packages / 80)), 6)::DOUBLE AS fragility FROM s""",
)
def _(spark, d):
    """Suppliers stand for packages, nations for repositories."""
    s = table(spark, d, "supplier")
    per = s.groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count("*").alias("packages"), F.avg((F.col("s_acctbal") < 0).cast("int")).alias("rate"), F.count_if(F.col("s_acctbal") < -500).alias("abandoned"), F.max(F.col("s_suppkey") % 12).alias("depth"), F.bool_or(F.col("s_suppkey") % 9 == 0).alias("locked")
    )
    return per.select("nation", F.round(risk.fragility(*map(F.col, ("rate", "depth", "locked", "abandoned", "packages"))), 6).alias("fragility"))


@query(
    "law_proxies",
    C
    + SEQ
    + _BUNDLE
    + """, gf AS (SELECT path, bool_or(seq < greatest(1, n // 2)) AS e FROM files JOIN placed USING (sha) GROUP BY 1), g AS (SELECT count(*) FILTER (NOT e) / count(*) AS g FROM gf),
    w AS (SELECT count(*) AS c FROM placed GROUP BY least(5, seq // greatest(1, n // 6))), sr AS (SELECT greatest(0.0, least(1.0, 1 - stddev_pop(c) / avg(c))) AS sr FROM w),
    au AS (SELECT count(*) AS c FROM commits GROUP BY author), os AS (SELECT least(1.0, -sum(c / s * log2(c / s + 1e-12)) / log2(greatest(2, count(*)))) AS os FROM au, (SELECT sum(c)::DOUBLE AS s FROM au))
    SELECT round(least(1.0, churn / 200), 6)::DOUBLE AS continuing_change, round(least(1.0, ent / 6), 6)::DOUBLE AS increasing_complexity, round(g, 6) AS continuing_growth, round(least(1.0, 2.5 * revert_rate + 0.5 * (1 - stability)), 6)::DOUBLE AS declining_quality,
      round(1 - g, 6) AS conservation_of_familiarity, round(least(1.0, abs(momentum) / 2), 6)::DOUBLE AS feedback_volatility, round(sr, 6)::DOUBLE AS self_regulation, round(os, 6)::DOUBLE AS organisational_stability FROM bundle, g, sr, os""",
)
def _(spark, d):
    out = traces.laws(commits(spark, d), commit_files(spark, d), bundle(spark, d))
    return rounded(out, *out.columns)


_MK4 = """, s AS (SELECT 'churn_rate' AS id, row_number() OVER (ORDER BY month) AS t, churn::DOUBLE AS x FROM months UNION ALL SELECT 'work_rate', row_number() OVER (ORDER BY month), n_commits::DOUBLE FROM months UNION ALL SELECT 'revert_rate', row_number() OVER (ORDER BY month), n_reverts::DOUBLE FROM months),
    p AS (SELECT a.id, sign(b.x - a.x) AS sg, (b.x - a.x) / (b.t - a.t) AS sl FROM s a JOIN s b ON a.id = b.id AND a.t < b.t), mk AS (SELECT id, CAST(sum(sg) AS BIGINT) AS s, count(*) AS m, list_sort(list(sl)) AS sls FROM p GROUP BY 1)"""


@query(
    "law_verdicts",
    C
    + MONTHS
    + _MK4
    + _P
    + """, b AS (SELECT max(trend) FILTER (id = 'churn_rate') AS c, max(trend) FILTER (id = 'revert_rate') AS r, max(trend) FILTER (id = 'work_rate') AS w FROM labels)
    SELECT 'continuing_change' AS law, CASE c WHEN 'rising' THEN 'support' WHEN 'flat' THEN 'weak' ELSE 'contradict' END AS verdict FROM b UNION ALL SELECT 'declining_quality', CASE r WHEN 'rising' THEN 'support' WHEN 'flat' THEN 'weak' ELSE 'contradict' END FROM b
    UNION ALL SELECT unnest(['self_regulation', 'organisational_stability']), CASE w WHEN 'flat' THEN 'support' ELSE 'contradict' END FROM b UNION ALL SELECT 'increasing_complexity', CASE c WHEN 'rising' THEN 'support' ELSE 'weak' END FROM b
    UNION ALL SELECT 'conservation_of_familiarity', 'support' UNION ALL SELECT 'feedback_system', 'weak'""",
)
def _(spark, d):
    from pyspark.sql import Window

    m = series.monthly(commits(spark, d)).withColumn("t", F.row_number().over(Window.orderBy("month")))  # months: few rows
    long = m.select("t", F.stack(F.lit(3), F.lit("churn_rate"), F.col("churn").cast("double"), F.lit("work_rate"), F.col("n_commits").cast("double"), F.lit("revert_rate"), F.col("n_reverts").cast("double")).alias("id", "x"))
    return traces.law_support(series.with_trend_labels(series.mann_kendall(long)))


@query(
    "commit_analysis",
    C
    + """, rk AS (SELECT p_brand AS clade, max(p_size) / 50.0::DOUBLE AS risk FROM part GROUP BY 1), db AS (SELECT p_brand AS clade, avg((p_type = 'PROMO')::INT) AS debt FROM part GROUP BY 1), k AS (SELECT sha, min(clade) AS clade FROM files GROUP BY 1)
    SELECT sha, round(0.45 * coalesce(risk, 0) + 0.35 * coalesce(debt, 0) + 0.2 * churn / (SELECT greatest(1, max(churn)) FROM commits JOIN k USING (sha)), 6) AS score FROM commits JOIN k USING (sha) LEFT JOIN rk USING (clade) LEFT JOIN db USING (clade)""",
)
def _(spark, d):
    from tidemark.operators.lineage import commit_scores

    part = table(spark, d, "part")
    c = commits(spark, d).select("sha", "churn").join(commit_files(spark, d).groupBy("sha").agg(F.min("clade").alias("clade")), "sha")
    r = part.groupBy(F.col("p_brand").alias("clade")).agg((F.max("p_size") / 50).alias("risk"))
    b = part.groupBy(F.col("p_brand").alias("clade")).agg(F.avg((F.col("p_type") == "PROMO").cast("int")).alias("debt"))
    return rounded(commit_scores(c, r, b), "score")


@query(
    "surfaced_events",
    """WITH e AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 0.55 WHEN 'signup' THEN 0.45 ELSE 0.4 END AS urgency, least(1.0, value / 200) AS confidence FROM events)
    SELECT id, round(urgency * (0.5 + 0.5 * confidence), 6)::DOUBLE AS rank_score FROM e ORDER BY urgency * (0.5 + 0.5 * confidence) DESC, id LIMIT 8""",
)
def _(spark, d):
    u = F.when(F.col("event_type") == "error", 0.55).when(F.col("event_type") == "signup", 0.45).otherwise(0.4)
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), u.alias("urgency"), F.least(F.lit(1.0), F.col("value") / 200).alias("confidence"))
    return rounded(risk.surface(e).select("id", "rank_score"), "rank_score")


@query(
    "test_scores",
    """WITH t AS (SELECT o_orderkey AS run, o_orderstatus <> 'P' AS ok, o_custkey % 90 AS p, o_custkey % 4 AS f, o_custkey % 101 AS c FROM orders)
    SELECT run, CAST(p AS INTEGER) AS passed, CAST(f AS INTEGER) AS failed, round(c / 100, 6) AS coverage, round(ok::INT + 0.02 * least(p, 50) - 0.1 * f + c / 100, 6) AS score FROM t""",
)
def _(spark, d):
    """Orders stand for test logs."""
    k = F.col("o_custkey")
    text = F.concat_ws(" ", (k % 90).cast("string"), F.lit("passed,"), (k % 4).cast("string"), F.lit("failed in 1s TOTAL 120 4"), F.concat((k % 101).cast("string"), F.lit("%")))
    logs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") != "P").alias("ok"), text.alias("text"))
    return rounded(traces.test_score(logs), "coverage", "score")


@query(
    "memory_scores",
    """WITH m AS (SELECT event_id AS id, epoch_us(ts) AS t, value, user_id FROM events), n AS (SELECT max(t) AS now FROM m)
    SELECT id, round(exp(-(now - t) / 3.6e9 / 24) * greatest(0.0, value / 200 - 0.1) * 0.5 * CASE WHEN user_id % 2 = 0 THEN 1.25 ELSE 1 END * CASE WHEN user_id % 3 = 0 THEN 1.05 ELSE 1 END, 6)::DOUBLE AS score, round(1 / (1 + (now - t) / 3.6e9 / 24), 6) AS decay FROM m, n""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.crossJoin(e.agg(F.max("ts").alias("now")))
    age = (F.unix_micros("now") - F.unix_micros("ts")) / 3.6e9
    score = traces.memory_score(age, F.col("value") / 200 - 0.1, F.lit(0.5), F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0)
    return rounded(e.select(F.col("event_id").alias("id"), score.alias("score"), T.age_decay(F.col("ts"), F.col("now")).alias("decay")), "score", "decay")


@query(
    "code_smells",
    C
    + """, t AS (SELECT max(k) AS top FROM (SELECT count(*) AS k FROM files GROUP BY path)), o AS (SELECT count(*) AS n, count(*) FILTER (subject LIKE '%HIGH%') AS fc FROM commits), l AS (SELECT count(*) FILTER (layer = 'MEDIUM') AS tt, count(*) FILTER (layer = 'PROMO') AS ut FROM files),
    rf AS (SELECT count(*) AS rf FROM (SELECT path FROM files JOIN commits USING (sha) WHERE is_revert GROUP BY 1 HAVING count(*) >= 2)), a AS (SELECT * FROM t, o, l, rf)
    SELECT 'hotspot_gravity' AS smell, 'high' AS severity FROM a WHERE top >= greatest(5.0, 0.2 * n) UNION ALL SELECT 'test_lag', 'high' FROM a WHERE fc > 10 AND tt < 0.3 * fc UNION ALL SELECT 'utility_sink', 'med' FROM a WHERE ut > greatest(10.0, 0.25 * n) UNION ALL SELECT 'repeated_revert_surface', 'high' FROM a WHERE rf >= 2""",
)
def _(spark, d):
    files, c = commit_files(spark, d), commits(spark, d)
    one = c.agg(F.count("*").alias("n"), F.count_if(F.col("subject").contains("HIGH")).alias("feature_commits")).crossJoin(files.agg(F.count_if(F.col("layer") == "MEDIUM").alias("test_touches"), F.count_if(F.col("layer") == "PROMO").alias("utility_touches")))
    again = files.join(c.filter("is_revert").select("sha"), "sha", "left_semi").groupBy("path").count().filter("count >= 2").agg(F.count("*").alias("revert_files"))
    return risk.smells(metrics.touch_counts(files), one.crossJoin(again))


@query("suite_scores", "WITH s AS (SELECT event_type AS suite, count(DISTINCT user_id)::DOUBLE AS weight, CASE WHEN event_type <> 'signup' THEN avg(value) END AS score FROM events GROUP BY 1) SELECT round(sum(weight * score) / sum(weight) FILTER (score IS NOT NULL), 6) AS combined, count(score) AS suites FROM s")
def _(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("suite")).agg(F.countDistinct("user_id").cast("double").alias("weight"), F.avg("value").alias("score"))
    return rounded(risk.combine_suites(s.withColumn("score", F.when(F.col("suite") != "signup", F.col("score")))), "combined")


@query(
    "clade_stages",
    C
    + """, k AS (SELECT clade, count(*) AS touches, CAST(sum(f.insertions + f.deletions) AS BIGINT) AS churn, avg(is_revert::INT) AS rf, count(DISTINCT path) AS n_files FROM files f JOIN commits USING (sha) GROUP BY 1)
    SELECT clade, CASE WHEN touches < 3 OR n_files <= 2 THEN 'pioneer' WHEN rf > 0.15 THEN 'disturbance' WHEN churn > 800 THEN 'growth' WHEN churn < 120 THEN 'maturity' ELSE 'consolidation' END AS stage FROM k""",
)
def _(spark, d):
    rows = commit_files(spark, d).join(commits(spark, d).select("sha", "is_revert"), "sha")
    k = rows.groupBy("clade").agg(F.count("*").alias("touches"), F.sum(F.col("insertions") + F.col("deletions")).alias("churn"), F.avg(F.col("is_revert").cast("int")).alias("revert_frac"), F.countDistinct("path").alias("n_files"))
    return taxonomy.clade_stage(k).select("clade", "stage")


@query("path_clades", "SELECT coalesce(n_name, 'clade_unknown') AS clade, count(*) AS n FROM orders LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3) ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    known = table(spark, d, "customer").join(table(spark, d, "nation").filter("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("path"), F.col("n_name").alias("clade"))
    return taxonomy.clade_of(table(spark, d, "orders").select(F.col("o_custkey").alias("path")), known).groupBy("clade").agg(F.count("*").alias("n"))


@query(
    "objective_scores",
    C
    + """, y AS (SELECT year(ts) AS run, avg(churn) AS avg_churn, avg(is_revert::INT) AS revert_rate FROM commits GROUP BY 1), h AS (UNPIVOT y ON avg_churn, revert_rate INTO NAME metric VALUE value),
    l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY run) AS p FROM h), v AS (SELECT * FROM l WHERE run = 1998)
    SELECT objective, coalesce((abs(value - p) >= 1e-4 AND value < p) OR (target IS NOT NULL AND value >= target), false) AS ok FROM (VALUES ('less churn', 'avg_churn', NULL), ('fewer reverts', 'revert_rate', NULL), ('much churn', 'avg_churn', 1.0), ('none', 'absent', 1.0)) o(objective, metric, target) LEFT JOIN v USING (metric)""",
)
def _(spark, d):
    from tidemark.plans.risk_queries import history

    wanted = spark.createDataFrame([("less churn", "avg_churn", None), ("fewer reverts", "revert_rate", None), ("much churn", "avg_churn", 1.0), ("none", "absent", 1.0)], "objective string, metric string, target double")
    return traces.objective_score(risk.snapshot_diff(history(spark, d)).filter("run = 1998"), wanted)


@query("open_windows", "WITH w AS (SELECT o_orderkey AS id, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders) SELECT id FROM w WHERE v IS NULL")
def _(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("valid_from"))
    return graph.open_nodes(graph.close_windows(nodes)).select("id")


@query(
    "priorities",
    C
    + SEQ
    + _BUNDLE
    + """, y AS (SELECT [CASE WHEN revert_rate > 0.1 THEN 'stabilize reverts' END, CASE WHEN 0.5 > 0.4 THEN 'pay down debt' END, CASE WHEN dependency_rate > 0.15 THEN 'audit dependencies' END, CASE WHEN 0.1 > 0.35 THEN 'document drift' END, 'protect boundaries'] AS l0 FROM bundle), x AS (SELECT [v FOR v IN l0 IF v IS NOT NULL] AS l FROM y)
    SELECT CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS rank, unnest(l) AS priority FROM x""",
)
def _(spark, d):
    return reports.priorities(bundle(spark, d).select("revert_rate", "dependency_rate", F.lit(0.5).alias("debt"), F.lit(0.1).alias("drift"), F.lit("growth").alias("stage")))


@query("sprint_report", "SELECT CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS span, count(*) AS n, round(sum(value), 4) AS churn, count(*) FILTER (event_type = 'error') AS n_reverts FROM events GROUP BY 1")
def _(spark, d):
    from tidemark.plans.series_queries import events

    return reports.sprint_report(events(spark, d)).withColumn("churn", F.round("churn", 4))


@query(
    "sprint_milestones",
    C
    + """, sp AS (SELECT 'y' || y AS span, make_timestamp(y, 1, 1, 0, 0, 0) AS start, make_timestamp(y, 6, 30, 0, 0, 0) AS due FROM (SELECT DISTINCT year(ts) AS y FROM commits))
    SELECT span, count(ts) AS n, CAST(coalesce(sum(churn), 0) AS BIGINT) AS churn, count(*) FILTER (is_revert) AS n_reverts FROM sp LEFT JOIN commits ON ts >= start AND ts <= due GROUP BY 1""",
)
def _(spark, d):
    c = commits(spark, d)
    y = c.select(F.year("ts").cast("string").alias("y")).distinct()
    spans = y.select(F.concat(F.lit("y"), "y").alias("span"), F.to_timestamp(F.concat("y", F.lit("-01-01"))).alias("start"), F.to_timestamp(F.concat("y", F.lit("-06-30"))).alias("due"))
    return reports.sprint_report(c, spans)


@query(
    "clade_dashboard",
    """WITH k AS (SELECT DISTINCT p_brand AS clade FROM part), dr AS (SELECT p_brand AS clade, avg(p_size / 100) AS drift FROM part WHERE p_size > 10 GROUP BY 1), rk AS (SELECT p_brand AS clade, max(p_retailprice / 3000) AS risk FROM part GROUP BY 1),
    h AS (SELECT p_brand AS clade, sum(CASE WHEN p_type = 'PROMO' THEN 3 ELSE 1 END) AS hits FROM part WHERE p_size > 45 GROUP BY 1)
    SELECT clade, round(coalesce(drift, 0), 6)::DOUBLE AS drift, round(coalesce(risk, 0), 6)::DOUBLE AS risk, round(coalesce(hits / (SELECT max(hits) FROM h), 0), 6)::DOUBLE AS debt FROM k LEFT JOIN dr USING (clade) LEFT JOIN rk USING (clade) LEFT JOIN h USING (clade)""",
)
def _(spark, d):
    p = table(spark, d, "part").withColumn("clade", F.col("p_brand"))
    drift = p.filter("p_size > 10").select("clade", (F.col("p_size") / 100).alias("drift"))
    debt = p.filter("p_size > 45").select("clade", F.when(F.col("p_type") == "PROMO", 3).otherwise(1).alias("weight"))
    return rounded(reports.dashboard(p, drift, p.select("clade", (F.col("p_retailprice") / 3000).alias("severity")), debt), "drift", "risk", "debt")


@query(
    "repositories",
    C
    + """, t AS (SELECT author AS repo, path, count(*) AS t FROM files JOIN commits USING (sha) GROUP BY 1, 2), e AS (SELECT repo, -sum(t / s * log2(t / s + 1e-12)) AS ent, max(t) AS top FROM (SELECT *, sum(t) OVER (PARTITION BY repo)::DOUBLE AS s FROM t) GROUP BY 1),
    b AS (SELECT author AS repo, count(*) AS commit_count, count(*) FILTER (is_revert) AS revert_count, CAST(sum(churn) AS BIGINT) AS churn_total, count(DISTINCT email) AS n_authors FROM commits GROUP BY 1)
    SELECT b.*, round(ent, 6) AS file_touch_entropy, round(1 / (1 + 0.002 * churn_total / commit_count + 3 * revert_count / commit_count + 0.5 * top / commit_count), 6) AS code_stability FROM b JOIN e USING (repo)""",
)
def _(spark, d):
    """Nations stand for repositories, customers for their authors."""
    c = commits(spark, d).withColumn("repo", F.col("author")).withColumn("author", F.col("email"))
    return rounded(reports.repositories(c, commit_files(spark, d).join(c.select("sha", "repo"), "sha")), "file_touch_entropy", "code_stability")


@query(
    "tool_findings",
    """WITH t AS (SELECT conv_id, turn, ['grep', 'web_search', 'rag_query', 'morpheme_scan', 'provenance_hint', 'file_read', 'graph_search', 'other'][turn % 8 + 1] AS name, length(text) AS n FROM conversations)
    SELECT conv_id, turn, CASE name WHEN 'grep' THEN 'grep:' || n || ' hits' WHEN 'web_search' THEN 'web:' || n || ' results' WHEN 'rag_query' THEN 'rag:' || n || ' chunks' WHEN 'morpheme_scan' THEN 'morphemes' WHEN 'provenance_hint' THEN 'frames:' || n WHEN 'file_read' THEN 'read:' || n || ' chars' WHEN 'graph_search' THEN 'graph:' || n || ' hits' END AS line FROM t""",
)
def _(spark, d):
    names = F.array(*map(F.lit, ("grep", "web_search", "rag_query", "morpheme_scan", "provenance_hint", "file_read", "graph_search", "other")))
    return table(spark, d, "conversations").select("conv_id", "turn", traces.tool_findings(F.element_at(names, (F.col("turn") % 8 + 1).cast("int")), F.length("text"), F.lit(None).cast("string")).alias("line"))


@query(
    "json_values",
    "SELECT conv_id, turn, role AS got, 'none' AS missing, year(DATE '2024-05-01') * 12 + CAST(turn AS INTEGER) % 12 AS month FROM conversations",
)
def _(spark, d):
    rows = table(spark, d, "conversations").withColumn("body", F.to_json(F.struct(F.struct("role").alias("meta"))))
    month = F.concat(F.lit("2024-"), F.lpad((F.col("turn") % 12 + 1).cast("string"), 2, "0"))
    return rows.select("conv_id", "turn", T.json_get(F.col("body"), "meta.role").alias("got"), T.json_get(F.col("body"), "meta.absent", "none").alias("missing"), T.month_ordinal(month).alias("month"))


@query(
    "pack_violations",
    "SELECT o_orderkey AS id, 'frames' AS key, 'type' AS problem FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'path', 'missing' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, unnest(['frames', 'path', 'score']), 'missing' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0",
)
def _(spark, d):
    k = F.col("o_orderkey")
    path = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit('"path": "a/b", '))
    body = F.concat(F.lit("{"), path, F.when(k % 3 == 0, F.lit('"frames": "none", ')).otherwise(F.lit('"frames": [1, 2], ')), F.lit('"score": 0.5}'))
    broken = (k % 3 != 0) & (k % 5 != 0) & (k % 7 == 0)
    packs = table(spark, d, "orders").select(k.alias("id"), F.when(broken, "{not json").otherwise(body).alias("body"))
    return traces.pack_violations(packs, {"frames": "array", "path": "string", "score": "number"})


@query(
    "morpheme_weights",
    """WITH o AS (SELECT * FROM (VALUES ('the', 'core', 1), ('and', 'core', 2), ('water', 'flow', 3), ('house', 'place', 2)) v(stem, domain, level)), t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}')) AS stem FROM documents)
    SELECT stem, domain, count(*) AS n, round(count(*) * (2 + 0.15 * max(level)), 6)::DOUBLE AS weight FROM t JOIN o USING (stem) GROUP BY 1, 2""",
)
def _(spark, d):
    from tidemark.operators.texts import morpheme_weights

    stems = spark.createDataFrame([("the", "core", 1), ("and", "core", 2), ("water", "flow", 3), ("house", "place", 2)], "stem string, domain string, level int")
    return rounded(morpheme_weights(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), stems), "weight")
