"""Queries over commits and the files they touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coupling, metrics
from tidemark.plans.registry import query
from tidemark.plans.testmap import SQL_COMMITS, SQL_FILES, SQL_HEADERS, commit_files, commit_headers, commits, table

C = "WITH " + SQL_COMMITS
SEQ = ", placed AS (SELECT *, row_number() OVER (ORDER BY ts, sha) - 1 AS seq, count(*) OVER () AS n FROM commits)"
SMALL = ", small AS (SELECT sha FROM commits WHERE n_files <= 12 AND churn <= 2500)"
EDGES = SMALL + """, edges AS (
  SELECT x.path AS a, y.path AS b, count(*) AS weight FROM files x JOIN files y ON x.sha = y.sha AND x.path < y.path
  WHERE x.sha IN (SELECT sha FROM small) GROUP BY 1, 2)"""


@query("cochange_edges", C + EDGES + " SELECT * FROM edges WHERE weight >= 2")
def _(spark, d):
    return coupling.cochange_edges(commit_files(spark, d), commits(spark, d))


@query("filtered_large_commits", C + " SELECT count(*) FILTER (n_files > 12 OR churn > 2500) AS filtered_large_commits FROM commits")
def _(spark, d):
    return coupling.split_large(commits(spark, d))[1]


@query(
    "sum_of_coupling",
    C + EDGES + ", e AS (SELECT * FROM edges WHERE weight >= 2) SELECT path, CAST(sum(weight) AS BIGINT) AS coupling FROM (SELECT a AS path, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY 1",
)
def _(spark, d):
    return coupling.sum_of_coupling(coupling.cochange_edges(commit_files(spark, d), commits(spark, d)))


@query(
    "ticket_coupling",
    C
    + """, f AS (SELECT DISTINCT CAST(email AS VARCHAR) AS ticket, path FROM files JOIN commits USING (sha))
    SELECT x.path AS a, y.path AS b, count(*) AS weight FROM f x JOIN f y ON x.ticket = y.ticket AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(spark, d):
    tickets = commit_headers(spark, d).select("sha", F.col("email").cast("string").alias("ticket"))
    return coupling.ticket_edges(commit_files(spark, d), tickets, 2)


@query(
    "blast_radius",
    "WITH " + SQL_FILES + """
    SELECT x.path, count(DISTINCT y.path) AS degree, least(1.0, count(DISTINCT y.path) / 40.0::DOUBLE)::DOUBLE AS score FROM files x JOIN files y ON x.sha = y.sha AND x.path <> y.path GROUP BY 1""",
)
def _(spark, d):
    return coupling.blast_radius(commit_files(spark, d))


@query(
    "coupled_neighbors",
    C
    + EDGES
    + """, e AS (SELECT * FROM edges WHERE weight >= 2), w AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e),
    edit AS (SELECT DISTINCT path FROM files WHERE clade = 'Brand#1')
    SELECT b AS neighbor, max(weight) AS weight FROM w WHERE a IN (SELECT path FROM edit) AND b NOT IN (SELECT path FROM edit) GROUP BY 1""",
)
def _(spark, d):
    files = commit_files(spark, d)
    return coupling.coupled_neighbors(coupling.cochange_edges(files, commits(spark, d)), files.filter("clade = 'Brand#1'").select("path").distinct())


@query("touch_counts", "WITH " + SQL_FILES + " SELECT path, count(*) AS touches FROM files GROUP BY 1")
def _(spark, d):
    return metrics.touch_counts(commit_files(spark, d))


@query("author_counts", "WITH " + SQL_HEADERS + " SELECT author, count(*) AS n_commits FROM headers GROUP BY 1")
def _(spark, d):
    return metrics.author_counts(commit_headers(spark, d))


@query("hot_files", "WITH " + SQL_FILES + " SELECT path, count(*) AS touches FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, d):
    return metrics.hot_files(commit_files(spark, d))


@query(
    "touch_entropy",
    "WITH " + SQL_FILES + ", t AS (SELECT count(*) AS n FROM files GROUP BY path) SELECT round(-sum(n / s * log2(n / s + 1e-12)), 6) AS entropy FROM t, (SELECT sum(n)::DOUBLE AS s FROM t)",
)
def _(spark, d):
    return metrics.entropy(metrics.touch_counts(commit_files(spark, d)), "touches").select(F.round("entropy", 6).alias("entropy"))


@query(
    "metric_bundle",
    C
    + SEQ
    + """, t AS (SELECT count(*) AS n FROM files GROUP BY path),
    e AS (SELECT -sum(n / s * log2(n / s + 1e-12)) AS ent, max(n) AS top FROM t, (SELECT sum(n)::DOUBLE AS s FROM t)),
    m AS (SELECT avg(churn) FILTER (seq >= n - greatest(1, n // 3)) AS r, coalesce(avg(churn) FILTER (seq < n - greatest(1, n // 3)), 0) AS o,
                 avg(is_revert::INT) FILTER (seq >= n - greatest(1, n // 3)) AS rr, coalesce(avg(is_revert::INT) FILTER (seq < n - greatest(1, n // 3)), 0) AS ro FROM placed),
    b AS (SELECT count(*) AS commit_count, count(*) FILTER (is_revert) AS revert_count, CAST(sum(churn) AS BIGINT) AS churn_total, count(DISTINCT author) AS n_authors FROM commits),
    d AS (SELECT count(DISTINCT sha) AS dep FROM files WHERE layer = 'ECONOMY')
    SELECT commit_count, revert_count, churn_total, n_authors, dep AS dependency_change_commits, round(ent, 6) AS file_touch_entropy,
           round((r - o) / (o + 1), 6) AS momentum, round(ro - rr + 0.1 * (o - r) / (o + 1), 6) AS improvement_trend,
           round(revert_count / commit_count, 6) AS revert_rate, round(churn_total / commit_count, 6) AS avg_churn_per_commit, round(dep / commit_count, 6) AS dependency_rate,
           round(1 / (1 + 0.002 * churn_total / commit_count + 3 * revert_count / commit_count + 0.5 * top / commit_count), 6) AS code_stability
    FROM b, d, e, m""",
)
def _(spark, d):
    out = metrics.metric_bundle(commits(spark, d), commit_files(spark, d), F.col("layer") == "ECONOMY")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "change_timeline",
    C
    + """, s AS (SELECT epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM commits),
    b AS (SELECT CAST(least(11, floor((epoch_us(ts) - t0) / (greatest(1, t1 - t0) / 12.0::DOUBLE))) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(churn) AS BIGINT) AS c, count(*) FILTER (is_revert) AS r FROM commits, s GROUP BY 1)
    SELECT range AS bucket, coalesce(n, 0) AS n_commits, coalesce(c, 0) AS churn, coalesce(r, 0) AS n_reverts FROM range(12) LEFT JOIN b ON range = bucket""",
)
def _(spark, d):
    return metrics.change_timeline(commits(spark, d))


@query(
    "file_fitness",
    C
    + """, p AS (SELECT path, count(*) AS touches, count(*) FILTER (is_revert) AS n_reverts, CAST(sum(churn // greatest(1, n_files)) AS BIGINT) AS churn_share
             FROM files JOIN commits USING (sha) GROUP BY 1)
    SELECT *, round(1 / (1 + 2 * n_reverts / touches + 0.001 * churn_share / touches), 6) AS fitness FROM p""",
)
def _(spark, d):
    return metrics.file_fitness(commit_files(spark, d), commits(spark, d)).withColumn("fitness", F.round("fitness", 6))


_ALLOC = ", alloc AS (SELECT f.sha, path, clade, c.insertions // greatest(1, n_files) AS insertions, c.deletions // greatest(1, n_files) AS deletions FROM files f JOIN commits c USING (sha))"


@query("allocations", C + _ALLOC + " SELECT * FROM alloc")
def _(spark, d):
    return metrics.allocations(commit_files(spark, d), commits(spark, d))


@query(
    "clade_aggregates",
    C
    + _ALLOC
    + """, k AS (SELECT clade, count(*) AS touches, CAST(sum(insertions + deletions) AS BIGINT) AS churn, count(DISTINCT path) AS n_files FROM alloc GROUP BY 1),
    l AS (SELECT clade, layer, row_number() OVER (PARTITION BY clade ORDER BY count(DISTINCT path) DESC, layer) AS r FROM files GROUP BY 1, 2)
    SELECT k.*, layer AS top_layer FROM k JOIN l USING (clade) WHERE r = 1""",
)
def _(spark, d):
    from tidemark.operators.taxonomy import clade_aggregates

    files = commit_files(spark, d)
    return clade_aggregates(metrics.allocations(files, commits(spark, d)), files)


@query(
    "gene_flow",
    "WITH " + SQL_FILES + """, k AS (SELECT DISTINCT sha, clade FROM files), p AS (SELECT x.clade AS a, y.clade AS b, count(*) AS weight FROM k x JOIN k y ON x.sha = y.sha AND x.clade < y.clade GROUP BY 1, 2)
    SELECT *, CASE WHEN weight >= 5 THEN 'merge_bridge' ELSE 'cochange' END AS kind FROM p""",
)
def _(spark, d):
    return coupling.gene_flow(commit_files(spark, d))


@query(
    "transfer_suspects",
    C + ", k AS (SELECT sha, count(DISTINCT clade) AS n_clades FROM files GROUP BY 1) SELECT sha, n_clades, n_files, churn FROM commits JOIN k USING (sha) WHERE n_clades >= 2 AND n_files >= 8 AND churn > 400",
)
def _(spark, d):
    return coupling.transfer_suspects(commit_files(spark, d), commits(spark, d))


@query(
    "offboarding",
    C
    + """, t AS (SELECT path, author, count(*) AS t FROM files JOIN commits USING (sha) GROUP BY 1, 2),
    top AS (SELECT path FROM t GROUP BY 1 ORDER BY sum(t) DESC, path LIMIT 15),
    a AS (SELECT author, row_number() OVER (ORDER BY count(*) DESC, author) AS rank FROM commits GROUP BY 1),
    p AS (SELECT removed, path, sum(t) AS all_, coalesce(sum(t) FILTER (rank > removed), 0) AS left_ FROM t JOIN a USING (author), (SELECT unnest([1, 2, 3]) AS removed) WHERE path IN (SELECT path FROM top) GROUP BY 1, 2)
    SELECT removed, round(1 - sum(left_) / sum(all_), 6) AS drop, count(*) FILTER (left_ = 0) AS uncovered FROM p GROUP BY 1""",
)
def _(spark, d):
    return coupling.offboarding(commit_files(spark, d), commits(spark, d)).withColumn("drop", F.round("drop", 6))


@query(
    "single_owner_hot",
    "WITH o AS (SELECT o_custkey AS path, count(*) AS touches, count(DISTINCT o_orderpriority) AS owners FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100000) SELECT path, touches FROM o WHERE owners = 1",
)
def _(spark, d):
    """Customers stand for files and priorities for authors, as every part is on orders of many."""
    o = table(spark, d, "orders")
    return coupling.single_owner_hot(o.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("path")), o.select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("author")), hot=100000)


@query(
    "stage_windows",
    C
    + SEQ
    + """, w AS (SELECT CAST(least(4, seq // greatest(1, n // 5)) AS BIGINT) AS win, count(*) AS n_commits, avg(churn) AS c, avg(is_revert::INT) AS r, max(n) AS n FROM placed GROUP BY 1)
    SELECT win, n_commits, round(c, 6) AS avg_churn, round(r, 6) AS revert_rate,
      CASE WHEN r > 0.15 OR c > 400 THEN 'disturbance' WHEN win = 0 AND n < 40 THEN 'pioneer' WHEN c > 120 AND r < 0.08 THEN 'growth'
           WHEN c < 40 AND r < 0.05 THEN 'maturity' WHEN c < 15 AND win = 4 THEN 'decline' ELSE 'growth' END AS stage FROM w""",
)
def _(spark, d):
    out = metrics.stage_windows(commits(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_churn", "revert_rate")})


_FIRST = SEQ + ", w AS (SELECT sha, CAST(least(7, seq // greatest(1, n // 8)) AS BIGINT) AS win FROM placed), f1 AS (SELECT path, min(win) AS win FROM files JOIN w USING (sha) GROUP BY 1), nf AS (SELECT range AS win, count(path) AS new_files FROM range(8) LEFT JOIN f1 ON range = win GROUP BY 1)"


@query("new_file_windows", C + _FIRST + " SELECT win, new_files, CAST(sum(new_files) OVER (ORDER BY win) AS BIGINT) AS total_files FROM nf")
def _(spark, d):
    return metrics.new_file_windows(commit_files(spark, d), commits(spark, d))


@query(
    "file_growth",
    C + SEQ + ", f AS (SELECT path, bool_or(seq < greatest(1, n // 2)) AS e FROM files JOIN placed USING (sha) GROUP BY 1) SELECT count(*) FILTER (NOT e) AS new_files, count(*) AS all_files, round(count(*) FILTER (NOT e) / count(*), 6) AS growth FROM f",
)
def _(spark, d):
    return metrics.file_growth(commit_files(spark, d), commits(spark, d)).withColumn("growth", F.round("growth", 6))


@query(
    "hotspots",
    "WITH " + SQL_FILES + """, t AS (SELECT path, count(*) AS touches FROM files GROUP BY 1), x AS (SELECT path, max(p_size)::BIGINT AS cx FROM (SELECT p_brand || '/' || p_type || '/' || p_name || '-' || p_partkey AS path, p_size FROM part) GROUP BY 1)
    SELECT path, touches, cx AS complexity, round(touches / (SELECT max(touches) FROM t) * cx / (cx + 20), 6) AS score FROM t JOIN x USING (path)""",
)
def _(spark, d):
    cx = table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("bigint").alias("complexity"))
    return metrics.hotspots(metrics.touch_counts(commit_files(spark, d)), cx).withColumn("score", F.round("score", 6))


@query(
    "cognitive_load",
    C
    + """, s AS (SELECT avg(k - 1) AS switches FROM (SELECT count(DISTINCT clade) AS k FROM files GROUP BY sha)),
    n AS (SELECT count(*) AS n FROM files GROUP BY clade), a AS (SELECT -sum(n / s * log2(n / s + 1e-12)) AS attention FROM n, (SELECT sum(n)::DOUBLE AS s FROM n)),
    g AS (SELECT x.path FROM files x JOIN files y ON x.sha = y.sha AND x.path <> y.path GROUP BY 1 HAVING count(DISTINCT y.path) >= 3),
    o AS (SELECT path, count(DISTINCT author) AS owners FROM files JOIN commits USING (sha) GROUP BY 1),
    l AS (SELECT coalesce(avg((owners = 1)::INT), 0) AS lone FROM g JOIN o USING (path)), u AS (SELECT avg((layer = 'PROMO')::INT) AS utility FROM files)
    SELECT round(switches, 6) AS switches, round(attention, 6) AS attention, round(lone, 6) AS lone, round(utility, 6) AS utility,
           round(0.3 * least(1.0, switches / 3) + 0.25 * least(1.0, attention / 5) + 0.25 * lone + 0.2 * utility, 6) AS load_index FROM s, a, l, u""",
)
def _(spark, d):
    out = coupling.cognitive_load(commit_files(spark, d), commits(spark, d), F.col("layer") == "PROMO")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
