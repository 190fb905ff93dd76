"""Queries over episodes, responses by coordinate, baseline gates, clusters and attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reports, risk, series, texts
from tidemark.plans.core_queries import C
from tidemark.plans.graph_queries import G, context
from tidemark.plans.registry import query
from tidemark.plans.risk_queries import RISKS, risks
from tidemark.plans.series_queries import MONTHS, RELEASES, releases, rounded
from tidemark.plans.testmap import commit_files, commits, table
from tidemark.plans.text_queries import _DOT


@query(
    "file_episodes",
    C
    + """, k AS (SELECT path, sha, ts, f.insertions + f.deletions AS churn, clade, row_number() OVER (PARTITION BY path ORDER BY ts, sha) AS k FROM files f JOIN commits USING (sha))
    SELECT path, (k - 1) // 5 AS episode, count(*) AS touches, CAST(sum(churn) AS BIGINT) AS churn, arg_min(sha, k) AS first_sha, arg_max(sha, k) AS last_sha, arg_max(clade, k) AS clade FROM k GROUP BY 1, 2""",
)
def _(spark, d):
    rows = commit_files(spark, d).join(commits(spark, d).select("sha", "ts"), "sha")
    return series.file_episodes(rows.select("path", "ts", "sha", (F.col("insertions") + F.col("deletions")).alias("churn"), "clade"))


_PARTS = ("n_commits", "n_authors", "churn")


@query(
    "dominant_impulse",
    C
    + MONTHS
    + RELEASES
    + ", z AS ("
    + " UNION ALL ".join(f"SELECT month, {i} AS o, 'z_{c}' AS coordinate, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x FROM months" for i, c in enumerate(_PARTS))
    + """), k AS (SELECT month, o, coordinate, avg(x) OVER b AS pre, avg(x) OVER a AS post, count(*) OVER b AS n_pre, count(*) OVER a AS n_post FROM z
      WINDOW b AS (PARTITION BY o ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY o ORDER BY month ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    j AS (SELECT label, k.*, row_number() OVER (PARTITION BY label, o ORDER BY abs(datediff('month', strptime(month || '-01', '%Y-%m-%d'), date_trunc('month', at_))), month) AS r FROM rel, k),
    t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(post - pre) DESC, o) AS best FROM j WHERE r = 1 AND n_pre > 0)
    SELECT label, coordinate, round(post - pre, 6) AS response, round(least(0.9, 0.35 + 0.1 * n_pre + 0.1 * n_post), 6)::DOUBLE AS confidence FROM t WHERE best = 1""",
)
def _(spark, d):
    samples = series.z_scores(series.monthly(commits(spark, d)), *_PARTS)
    return rounded(series.dominant_responses(samples, releases(spark, d), *[f"z_{c}" for c in _PARTS]), "response", "confidence")


@query(
    "stage_spans",
    C
    + RELEASES
    + """, s AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM commits), b AS (SELECT at_ FROM rel WHERE label <> (SELECT min(label) FROM rel)),
    o AS (SELECT at_, lead(at_) OVER (ORDER BY at_) AS nxt FROM b)
    SELECT epoch_us(at_) AS start, epoch_us(coalesce(nxt, CASE WHEN t1 > at_ THEN t1 ELSE at_ + INTERVAL 1 DAY END)) AS "end", 'growth' AS stage, 0.75::DOUBLE AS confidence FROM o, s
    UNION ALL SELECT epoch_us(t0), epoch_us(f), 'pioneer', 0.55 FROM s, (SELECT min(at_) AS f FROM b) WHERE f > t0 + INTERVAL 7 DAYS""",
)
def _(spark, d):
    c, all_of = commits(spark, d), releases(spark, d)
    later = all_of.join(all_of.agg(F.min("label").alias("_first")), F.col("label") != F.col("_first"))
    bounds = later.select(F.lit("r").alias("repo"), "at", F.lit("growth").alias("stage"), F.lit(0.75).alias("confidence"))
    spans = c.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).withColumn("repo", F.lit("r"))
    return series.segments(bounds, spans=spans).select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "stage", "confidence")


@query(
    "gate_baseline",
    C
    + RISKS
    + """, s AS (SELECT 1 / (1 + 0.002 * avg(churn) + 3 * avg(is_revert::INT)) AS st FROM commits), n AS (SELECT count(*) AS c FROM risks WHERE severity >= 0.85)
    SELECT st >= 0.35 AS passed, CASE WHEN st < 0.35 THEN 'stability' ELSE '' END AS failures, CASE WHEN c > 12 THEN 'baseline' ELSE '' END AS warnings, c AS new_p0 FROM s, n""",
)
def _(spark, d):
    stable = commits(spark, d).agg((1 / (1 + 0.002 * F.avg("churn") + 3 * F.avg(F.col("is_revert").cast("int")))).alias("code_stability"))
    return risk.gate(stable, risks(spark, d).filter("severity >= 0.85"), stable.select(F.lit(0.2).alias("fatigue")), baseline=True)


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.groupBy(F.col("label").alias("cluster")).agg(F.min_by("embedding", "vec_id").alias("c"))


@query("kmeans_rounds")
def _(spark, d):
    return texts.kmeans(*_vectors(spark, d))[0]


@query(
    "cluster_confidence",
    f"""WITH c AS (SELECT label AS cluster, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY 1),
    s AS (SELECT vec_id AS id, cluster, {_DOT.format(a="embedding", b="c")} / sqrt({_DOT.format(a="embedding", b="embedding")} * {_DOT.format(a="c", b="c")}) AS score FROM embeddings, c),
    r AS (SELECT id, cluster, score, coalesce(lead(score) OVER w, 0) AS second, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, cluster))
    SELECT id, cluster, round(greatest(0, least(1, 0.55 * score + 0.45 * (score - second + 0.2))), 6)::DOUBLE AS confidence FROM r WHERE k = 1""",
)
def _(spark, d):
    return rounded(texts.soft_confidence(*_vectors(spark, d)), "confidence")


@query(
    "cluster_cohesion",
    f"""WITH v AS (SELECT vec_id, label AS cluster, [CAST(x AS DOUBLE) / sqrt({_DOT.format(a="embedding", b="embedding")}) FOR x IN embedding] AS u FROM embeddings)
    SELECT a.cluster, (SELECT count(*) FROM v WHERE cluster = a.cluster) AS size, round(avg({_DOT.format(a="a.u", b="b.u")}), 6) AS cohesion FROM v a JOIN v b ON a.cluster = b.cluster AND a.vec_id < b.vec_id GROUP BY 1""",
)
def _(spark, d):
    """The labels of vectors as clusters; the SQL makes all pairs."""
    e = table(spark, d, "embeddings")
    return rounded(texts.cohesion(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))), "cohesion")


def _attention_sql(rounds):
    out, last = G + ", und AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), links AS (SELECT source, target, count(*) OVER (PARTITION BY source) AS deg FROM und), v0 AS (SELECT 'n3' AS id, 1.0::DOUBLE AS value UNION ALL SELECT 'p7', 1.2)", "v0"
    for i in range(1, rounds + 1):
        out += f", v{i} AS (SELECT id, sum(value) AS value FROM (SELECT id, 0.5 * value AS value FROM {last} UNION ALL SELECT target, 0.5 * value / deg FROM {last} JOIN links ON source = id) GROUP BY 1)"
        last = f"v{i}"
    return out + f""", ages AS (SELECT 'o' || o_orderkey AS id, 24 * datediff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS h FROM orders),
    s AS (SELECT id, kind, CASE kind WHEN 'context' THEN 'context' ELSE 'taxon' END AS family, round(value * coalesce(1 / (1 + h / 24), 1), 9) AS attention FROM {last} JOIN nodes USING (id) LEFT JOIN ages USING (id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY attention DESC, id) AS r FROM s) SELECT id, kind, family, attention FROM k WHERE r <= 4 ORDER BY attention DESC, id LIMIT 12"""


@query("attention_rank", _attention_sql(3))
def _(spark, d):
    nodes, edges = context(spark, d)
    orders = table(spark, d, "orders")
    hours = 24 * F.datediff(F.col("_now"), F.col("o_orderdate"))
    ages = orders.crossJoin(orders.agg(F.max("o_orderdate").alias("_now"))).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), hours.alias("age_hours"))
    seeds = spark.createDataFrame([("n3", 1.0), ("p7", 1.2)], "id string, value double")
    return reports.attention_rank(nodes.select("id", "kind").join(ages, "id", "left"), edges, seeds)
