"""Queries over time series: events for weeks, orders for months."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.plans.registry import query
from tidemark.plans.testmap import SQL_COMMITS, commit_files, commits, table

C = "WITH " + SQL_COMMITS
MONTHS = """, months AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n_commits, count(DISTINCT email) AS n_authors, count(*) FILTER (is_revert) AS n_reverts, CAST(sum(churn) AS BIGINT) AS churn FROM commits GROUP BY 1)"""
EVENTS = "WITH ev AS (SELECT event_id AS sha, ts, value AS churn, event_type = 'error' AS is_revert, user_id FROM events)"
WEEK = "CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0')"
RELEASES = """, firsts AS (SELECT year(ts) AS y, min(ts) AS at_ FROM commits GROUP BY 1), rel AS (SELECT 'v' || y AS label, at_ FROM firsts)"""


#: Runs of three or more within 14 days of their first: from each place the walk goes on behind the run, or to the next one.
STORMS = """WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS repo, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = 'error'),
    far AS (SELECT *, max(k) OVER (PARTITION BY repo ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 14 DAYS FOLLOWING) - k + 1 AS n FROM ev),
    walk AS (SELECT * FROM far WHERE k = 1 UNION ALL SELECT f.* FROM walk w JOIN far f ON f.repo = w.repo AND f.k = w.k + CASE WHEN w.n >= 3 THEN w.n ELSE 1 END),
    storms AS (SELECT repo, ts, k, n FROM walk WHERE n >= 3)"""


def events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("sha"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("churn"), (F.col("event_type") == "error").alias("is_revert"), "user_id")


def releases(spark, d):
    """The first commit of each year stands for a release."""
    return commits(spark, d).groupBy(F.year("ts").alias("y")).agg(F.min("ts").alias("at")).select(F.concat(F.lit("v"), F.col("y").cast("string")).alias("label"), "at")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("weekly_rhythm", EVENTS + f" SELECT {WEEK} AS week, count(*) AS n, round(sum(churn), 4) AS churn, round(sum(churn) / count(*), 4) AS intensity FROM ev GROUP BY 1")
def _(spark, d):
    return series.weekly(events(spark, d)).withColumns({c: F.round(c, 4) for c in ("churn", "intensity")})


@query("monthly_activity", C + MONTHS + " SELECT * FROM months")
def _(spark, d):
    return series.monthly(commits(spark, d))


@query(
    "fatigue_score",
    EVENTS
    + f""", b AS (SELECT avg((hour(ts) < 9 OR hour(ts) >= 18)::INT) AS ah, avg((dayofweek(ts) IN (0, 6))::INT) AS we FROM ev),
    p AS (SELECT row_number() OVER (PARTITION BY {WEEK} ORDER BY ts, sha) AS k, count(*) OVER (PARTITION BY {WEEK}) AS n FROM ev),
    l AS (SELECT coalesce(avg((k > n - greatest(1, floor(n * 0.2)))::INT), 0) AS wend FROM p WHERE n >= 5),
    w AS (SELECT {WEEK} AS week, sum(churn) / count(*) AS x FROM ev GROUP BY 1),
    s AS (SELECT x, row_number() OVER (ORDER BY week) AS k, count(*) OVER () AS w, lead(x) OVER (ORDER BY week) AS nxt FROM w),
    m AS (SELECT list_sort(list(x))[count(*) // 2 + 1] AS mid FROM w),
    t AS (SELECT avg(x) FILTER (k > w - greatest(1, w // 3)) AS r, coalesce(avg(x) FILTER (k <= w - greatest(1, w // 3)), 0) AS o,
                 count(*) FILTER (x >= 1.25 * mid AND nxt IS NOT NULL) AS peaks, count(*) FILTER (x >= 1.25 * mid AND nxt <= 0.75 * mid) AS rests FROM s, m),
    u AS (SELECT ah, we, wend, greatest(0.0, (r - o) / (o + 1)) AS creep, CASE WHEN peaks = 0 THEN 1.0 ELSE rests / peaks END AS rec FROM b, l, t)
    SELECT round(ah, 6) AS after_hours, round(we, 6) AS weekend, round(wend, 6) AS week_end, round(creep, 6) AS creep, round(rec, 6)::DOUBLE AS recovery,
           round(least(1.0, 0.35 * ah + 0.2 * we + 0.25 * least(1.0, creep) + 0.1 * (1 - rec) + 0.1 * wend), 6)::DOUBLE AS fatigue FROM u""",
)
def _(spark, d):
    out = series.fatigue(events(spark, d))
    return rounded(out, *out.columns)


_Z = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () < 1e-9 THEN 0 ELSE round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) END::DOUBLE AS z_{c}" for c in ("activity", "authors", "churn", "instability", "load"))
SAMPLES = (
    MONTHS
    + """, wk AS (SELECT date_trunc('week', ts) AS monday, sum(churn) / count(*) AS x FROM commits GROUP BY 1), ld AS (SELECT strftime(monday, '%Y-%m') AS month, max(x) AS load FROM wk GROUP BY 1),
    base AS (SELECT month, n_commits::DOUBLE AS activity, n_authors::DOUBLE AS authors, churn::DOUBLE AS churn, n_reverts / n_commits AS instability, coalesce(load, 0) AS load FROM months LEFT JOIN ld USING (month))"""
)


@query("state_samples", C + SAMPLES + f" SELECT month, {_Z} FROM base")
def _(spark, d):
    c = commits(spark, d)
    out = series.state_samples(series.monthly(c), series.monthly_load(c))
    return rounded(out.select("month", *[x for x in out.columns if x.startswith("z_")]), *[x for x in out.columns if x.startswith("z_")])


@query(
    "impulse_response",
    C
    + MONTHS
    + RELEASES
    + """, k AS (SELECT month, avg(n_commits) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pre, avg(n_commits) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS post,
                 count(*) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n_pre, count(*) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n_post FROM months),
    j AS (SELECT label, k.*, row_number() OVER (PARTITION BY label ORDER BY abs(datediff('month', strptime(month || '-01', '%Y-%m-%d'), date_trunc('month', at_))), month) AS r FROM rel, k)
    SELECT label, month, round(pre, 6) AS pre, round(post, 6) AS post, round(post - pre, 6) AS response, round(least(0.9, 0.35 + 0.1 * n_pre + 0.1 * n_post), 6)::DOUBLE AS confidence FROM j WHERE r = 1 AND n_pre > 0""",
)
def _(spark, d):
    out = series.impulse_responses(series.monthly(commits(spark, d)), releases(spark, d), "n_commits")
    return rounded(out, "pre", "post", "response", "confidence")


_MK = """, s AS (SELECT 'commits' AS id, row_number() OVER (ORDER BY month) AS t, n_commits::DOUBLE AS x FROM months UNION ALL SELECT 'churn', row_number() OVER (ORDER BY month), churn::DOUBLE FROM months),
    p AS (SELECT a.id, sign(b.x - a.x) AS sg, (b.x - a.x) / (b.t - a.t) AS sl FROM s a JOIN s b ON a.id = b.id AND a.t < b.t),
    mk AS (SELECT id, CAST(sum(sg) AS BIGINT) AS s, count(*) AS m, list_sort(list(sl)) AS sls FROM p GROUP BY 1)"""


def _monthly_long(spark, d):
    from pyspark.sql import Window

    m = series.monthly(commits(spark, d)).withColumn("t", F.row_number().over(Window.orderBy("month")))  # months: few rows
    return m.select("t", F.stack(F.lit(2), F.lit("commits"), F.col("n_commits").cast("double"), F.lit("churn"), F.col("churn").cast("double")).alias("id", "x"))


@query("mann_kendall", C + MONTHS + _MK + " SELECT id, (SELECT count(*) FROM months) AS n, s, round(s / m, 6) AS tau, round(sls[m // 2 + 1], 6) AS slope FROM mk")
def _(spark, d):
    return rounded(series.mann_kendall(_monthly_long(spark, d)), "tau", "slope")


# Abramowitz and Stegun's formula 7.1.26 for erfc, good to 1.5e-7 (fixed values).
_P = """, z AS (SELECT mk.*, n, CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18) ELSE 0 END AS z FROM mk, (SELECT count(*) AS n FROM months)),
    u AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS w FROM z),
    tests AS (SELECT id, n, s, w * (0.254829592 + w * (-0.284496736 + w * (1.421413741 + w * (-1.453152027 + w * 1.061405429)))) * exp(-x * x) AS p, sls[m // 2 + 1] AS slope, s / m AS tau FROM u),
    labels AS (SELECT *, CASE WHEN p >= 0.05 THEN 'flat' WHEN s > 0 THEN 'rising' ELSE 'falling' END AS trend FROM tests)"""


@query("trend_labels", C + MONTHS + _MK + _P + " SELECT id, n, s, round(tau, 6) AS tau, round(slope, 6) AS slope, round(p, 5) AS p, trend FROM labels")
def _(spark, d):
    return rounded(series.with_trend_labels(series.mann_kendall(_monthly_long(spark, d))), "tau", "slope").withColumn("p", F.round("p", 5))


@query("changepoints")
def _(spark, d):
    m = series.monthly(commits(spark, d)).withColumn("ts", F.to_date("month", "yyyy-MM"))
    kinds = ("n_commits", "n_authors", "churn", "n_reverts")
    long = m.select(F.col("ts").alias("t"), F.stack(F.lit(4), *[x for c in kinds for x in (F.lit("reverts" if c == "n_reverts" else c), F.col(c).cast("double"))]).alias("id", "x"))
    return series.changepoints(long)


@query(
    "revert_storms",
    STORMS
    + """ SELECT s.repo, epoch_us(s.ts) AS first, epoch_us(l.ts) AS last, epoch_us(m.ts) AS "at", s.n, round(least(0.95, 0.55 + 0.05 * s.n), 6)::DOUBLE AS confidence
    FROM storms s JOIN ev l ON l.repo = s.repo AND l.k = s.k + s.n - 1 JOIN ev m ON m.repo = s.repo AND m.k = s.k + s.n // 2""",
)
def _(spark, d):
    e = events(spark, d).filter("is_revert").select(F.col("user_id").cast("string").alias("repo"), "ts")
    return rounded(series.storms(e), "confidence").withColumns({c: F.unix_micros(c) for c in ("first", "last", "at")})


@query(
    "nearest_changepoint",
    C
    + MONTHS
    + RELEASES
    + """, cp AS (SELECT CAST(strptime(month || '-01', '%Y-%m-%d') AS DATE) AS at_ FROM months WHERE n_commits > (SELECT avg(n_commits) + stddev_pop(n_commits) FROM months)),
    j AS (SELECT label, cp.at_ AS point, abs(datediff('day', CAST(rel.at_ AS DATE), cp.at_)) AS gap, row_number() OVER (PARTITION BY label ORDER BY abs(datediff('day', CAST(rel.at_ AS DATE), cp.at_)), cp.at_) AS r FROM rel, cp WHERE abs(datediff('day', CAST(rel.at_ AS DATE), cp.at_)) <= 45)
    SELECT rel.label, CAST(point AS VARCHAR) AS point, CAST(gap AS INTEGER) AS gap FROM rel LEFT JOIN (SELECT * FROM j WHERE r = 1) j ON j.label = rel.label""",
)
def _(spark, d):
    m = series.monthly(commits(spark, d))
    high = m.crossJoin(F.broadcast(m.agg((F.avg("n_commits") + F.stddev_pop("n_commits")).alias("_h")))).filter(F.col("n_commits") > F.col("_h")).select(F.to_date("month", "yyyy-MM").alias("at"))
    return series.nearest_within(releases(spark, d), high).select("label", F.col("point").cast("string").alias("point"), "gap")


_SERIES = ("n_commits", "n_authors", "churn", "n_reverts")
_JUMPS = ", lv AS (" + " UNION ALL ".join(
    f"SELECT CAST(strptime(month || '-01', '%Y-%m-%d') AS TIMESTAMP) AS at_, '{c.removeprefix('n_')}' AS series, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM months" for c in _SERIES
) + """), cp AS (SELECT at_, series, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction, round(abs(z), 6) AS magnitude FROM lv WHERE abs(z) > 1),
    ra AS (SELECT *, row_number() OVER (ORDER BY magnitude DESC, at_, series) <= greatest(6, floor(count(*) OVER () / 3)) AS strong FROM cp),
    ev AS (SELECT label, 'release' AS kind, at_, 'growth' AS stage, 0.7::DOUBLE AS confidence FROM rel
      UNION ALL SELECT 'r' || year(ts) || '-' || quarter(ts), 'revert_storm', min(ts), 'maturity', 0.6::DOUBLE FROM commits WHERE is_revert GROUP BY 1)"""


@query(
    "event_anchors",
    C
    + MONTHS
    + RELEASES
    + _JUMPS
    + """, pr AS (SELECT label, ra.*, abs(epoch_us(ev.at_) - epoch_us(ra.at_)) AS gap, ra.strong AND series IN ('commits', 'churn', CASE WHEN kind = 'revert_storm' THEN 'reverts' ELSE 'authors' END) AS pref FROM ev, ra),
    be AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pref DESC, gap, magnitude DESC, series) AS r FROM pr WHERE gap <= 45 * 86400000000)
    SELECT ev.label, kind, series, direction, round(gap / 86400000000.0::DOUBLE, 6)::DOUBLE AS gap_days,
      CASE WHEN stage = 'growth' AND direction = 'down' AND series IN ('commits', 'churn') THEN 'consolidation' WHEN stage = 'maturity' AND direction = 'up' AND series = 'reverts' THEN 'disturbance' ELSE stage END AS stage,
      round(CASE WHEN gap IS NULL THEN confidence * 0.85 ELSE least(0.98, confidence + 0.08 + greatest(0, 0.12 * (1 - gap / 86400000000.0::DOUBLE / 45))) END, 6)::DOUBLE AS confidence
    FROM ev LEFT JOIN be ON be.label = ev.label AND r = 1""",
)
def _(spark, d):
    """Releases and first reverts of a quarter, tied to the months whose values lie a deviation from the mean."""
    from functools import reduce

    months = series.monthly(commits(spark, d))
    parts = []
    for c in _SERIES:
        stats = months.agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"))
        z = (F.col(c) - F.col("_m")) / F.col("_s")
        parts.append(months.crossJoin(F.broadcast(stats)).select(F.to_timestamp("month", "yyyy-MM").alias("at"), F.lit(c.removeprefix("n_")).alias("series"), z.alias("z")))
    jumps = reduce(lambda a, b: a.unionByName(b), parts).filter("abs(z) > 1")
    points = jumps.select("at", "series", F.when(F.col("z") > 0, "up").otherwise("down").alias("direction"), F.round(F.abs("z"), 6).alias("magnitude"))
    storms = commits(spark, d).filter("is_revert").groupBy(F.concat(F.lit("r"), F.year("ts").cast("string"), F.lit("-"), F.quarter("ts").cast("string")).alias("label")).agg(F.min("ts").alias("at"))
    rows = releases(spark, d).select("label", F.lit("release").alias("kind"), "at", F.lit("growth").alias("stage"), F.lit(0.7).alias("confidence")).unionByName(
        storms.select("label", F.lit("revert_storm").alias("kind"), "at", F.lit("maturity").alias("stage"), F.lit(0.6).alias("confidence"))
    )
    return rounded(series.anchors(rows, points).drop("at"), "gap_days", "confidence")


@query(
    "changepoint_hit_rate",
    C
    + MONTHS
    + RELEASES
    + """, cp AS (SELECT CAST(strptime(month || '-01', '%Y-%m-%d') AS DATE) AS at_ FROM months),
    h AS (SELECT at_, exists(SELECT 1 FROM rel WHERE abs(datediff('day', CAST(rel.at_ AS DATE), cp.at_)) <= 45) AS hit FROM cp)
    SELECT count(*) AS points, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM h""",
)
def _(spark, d):
    points = series.monthly(commits(spark, d)).select(F.to_date("month", "yyyy-MM").alias("at"))
    return rounded(series.hit_rate(points, releases(spark, d).select("at")), "rate")


_SPANS = [("all", None, None), ("early", None, "1996-06-30"), ("mid", "1996-07-01", "1998-12-31"), ("late", "1999-01-01", None)]


@query(
    "sprint_windows",
    C
    + """, sp AS (SELECT * FROM (VALUES ('all', NULL::TIMESTAMP, NULL::TIMESTAMP), ('early', NULL, TIMESTAMP '1996-06-30'), ('mid', TIMESTAMP '1996-07-01', TIMESTAMP '1998-12-31'), ('late', TIMESTAMP '1999-01-01', NULL)) v(span, start, due))
    SELECT span, count(ts) AS n, CAST(coalesce(sum(churn), 0) AS BIGINT) AS churn FROM sp LEFT JOIN commits ON (start IS NULL OR ts >= start) AND (due IS NULL OR ts <= due) GROUP BY 1""",
)
def _(spark, d):
    spans = spark.createDataFrame(_SPANS, "span string, start string, due string").select("span", F.col("start").cast("timestamp").alias("start"), F.col("due").cast("timestamp").alias("due"))
    return series.within_spans(commits(spark, d), spans)


_SEG = [("1995-01-01", "1996-07-01", "pioneer", 0.6), ("1996-07-01", "1998-06-01", "growth", 0.7), ("1998-06-01", "2000-01-01", "maturity", 0.5)]
_SEG_SQL = ", segs AS (SELECT * FROM (VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}', '{s}', {c}::DOUBLE)" for a, b, s, c in _SEG) + ') v(start, "end", stage, confidence))'


def segs(spark):
    out = spark.createDataFrame(_SEG, "start string, end string, stage string, confidence double")
    return out.withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})


@query(
    "stage_at",
    C
    + RELEASES
    + _SEG_SQL
    + """, j AS (SELECT label, stage, CASE WHEN at_ < "end" THEN confidence ELSE confidence * 0.9 END AS confidence, row_number() OVER (PARTITION BY label ORDER BY (at_ < "end") DESC, start DESC) AS r FROM rel LEFT JOIN segs ON at_ >= start)
    SELECT label, stage, round(confidence, 6) AS confidence FROM j WHERE r = 1""",
)
def _(spark, d):
    return rounded(series.stage_at(releases(spark, d), segs(spark)), "confidence")


@query(
    "regime_basins",
    C
    + SAMPLES
    + _SEG_SQL
    + """ SELECT stage, count(*) AS months, round(count(*) / (SELECT count(*) FROM base), 6) AS occupancy, round(avg(activity), 6) AS mean_activity
    FROM segs JOIN base ON month >= strftime(start, '%Y-%m') AND month <= strftime("end", '%Y-%m') GROUP BY stage""",
)
def _(spark, d):
    c = commits(spark, d)
    return rounded(series.basins(series.state_samples(series.monthly(c), series.monthly_load(c)), segs(spark)).drop("start"), "occupancy", "mean_activity")


@query(
    "path_episodes",
    """WITH k AS (SELECT conv_id AS path, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1) // 5 AS episode, role FROM conversations)
    SELECT path, episode, count(*) AS touches, arg_min(role, turn) AS first, arg_max(role, turn) AS last FROM k GROUP BY 1, 2""",
)
def _(spark, d):
    return series.path_episodes(table(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("pos"), F.col("role").alias("item")))


@query(
    "branch_trends",
    C
    + """, sq AS (SELECT sha, row_number() OVER (ORDER BY ts, sha) - 1 < greatest(1, count(*) OVER () // 2) AS early FROM commits),
    a AS (SELECT f.sha, layer AS type_key, (c.insertions // greatest(1, n_files)) + (c.deletions // greatest(1, n_files)) AS churn FROM files f JOIN commits c USING (sha)),
    h AS (SELECT type_key, CAST(coalesce(sum(churn) FILTER (early), 0) AS BIGINT) AS early, CAST(coalesce(sum(churn) FILTER (NOT early), 0) AS BIGINT) AS late FROM a JOIN sq USING (sha) GROUP BY 1)
    SELECT *, late - early AS delta, CASE WHEN late - early > greatest(20.0, 0.25 * (early + 1)) THEN 'heating' WHEN late - early < -greatest(20.0, 0.25 * (early + 1)) THEN 'cooling' ELSE 'steady' END AS trend FROM h""",
)
def _(spark, d):
    from tidemark.functions.ordering import early, with_seq
    from tidemark.operators.metrics import allocations
    from tidemark.operators.taxonomy import branch_trends

    files, c = commit_files(spark, d), commits(spark, d)
    half = with_seq(c.select("sha", "ts"), "ts", "sha", total="n").select("sha", early(F.col("seq"), F.col("n")).alias("early"))
    rows = allocations(files, c).join(files.select("sha", "path", F.col("layer").alias("type_key")), ["sha", "path"]).join(half, "sha")
    return branch_trends(rows.select("type_key", "early", (F.col("insertions") + F.col("deletions")).alias("churn")))
