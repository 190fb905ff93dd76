"""Queries over lineages, snapshots, traces and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import coupling, lineage, traces
from tidemark.plans.core_queries import C, SEQ
from tidemark.operators.reports import THEMES
from tidemark.plans.registry import query
from tidemark.plans.series_queries import _MK, _P, MONTHS
from tidemark.plans.testmap import SQL_PARENTS, commit_files, commits, parents, table
from tidemark.plans.text_queries import _EMB

PART = "p_brand || '/' || p_type || '/' || p_name || '-' || p_partkey"


def part_paths(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("path"))


@query(
    "lineage",
    C.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", pp AS (SELECT p_partkey AS k, {PART} AS path FROM part), rn AS (SELECT a.path AS old, b.path AS new FROM pp a JOIN pp b ON b.k = a.k + 1 WHERE a.k % 5 IN (0, 1)),
    w AS (SELECT old AS path, new AS name, 1 AS n FROM rn UNION ALL SELECT w.path, rn.new, n + 1 FROM w JOIN rn ON rn.old = w.name), f AS (SELECT path, arg_max(name, n) AS name FROM w GROUP BY 1),
    r AS (SELECT coalesce(name, path) AS name, path, sha, ts FROM files JOIN commits USING (sha) LEFT JOIN f USING (path))
    SELECT name, count(*) AS touches, arg_min(sha, (ts, sha)) AS first, arg_max(sha, (ts, sha)) AS last, count(DISTINCT path) FILTER (path <> name) AS n_prior FROM r GROUP BY 1""",
)
def _(spark, d):
    p = part_paths(spark, d)
    old, new = p.filter(F.col("p_partkey") % 5 < 2), p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("path").alias("new"))
    renames = old.join(new, "p_partkey").select(F.col("path").alias("old"), "new")
    return lineage.lineages(commit_files(spark, d), commits(spark, d), renames).select("name", "touches", "first", "last", F.size("prior").cast("bigint").alias("n_prior"))


@query(
    "parent_resolution",
    "WITH "
    + SQL_PARENTS
    + """, c AS (SELECT sha, md5(CAST(sha AS VARCHAR)) AS h FROM headers), l AS (SELECT a.h AS sha, CASE WHEN p.sha % 2 = 0 THEN b.h ELSE substr(b.h, 1, 7) END AS named FROM parents p JOIN c a ON a.sha = p.sha JOIN c b ON b.sha = p.parent WHERE pos = 0),
    s AS (SELECT substr(h, 1, 7) AS p, min(h) AS h FROM c GROUP BY 1) SELECT l.sha, CASE WHEN length(named) > 7 THEN named ELSE s.h END AS parent FROM l JOIN s ON s.p = substr(named, 1, 7)""",
)
def _(spark, d):
    md = lambda c: F.md5(F.col(c).cast("string"))
    links = parents(spark, d).filter("pos = 0").select(md("sha").alias("sha"), F.when(F.col("sha") % 2 == 0, md("parent")).otherwise(F.substring(md("parent"), 1, 7)).alias("named"))
    return lineage.resolve_parents(links, table(spark, d, "orders").select(md("o_orderkey").alias("sha")))


_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}'))"


@query(
    "snapshot_similarity",
    f"""WITH t AS (SELECT conv_id, turn, {_TOK} AS items FROM conversations), p AS (SELECT a.conv_id || ':' || a.turn AS path, a.items AS a, b.items AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT path, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS similarity FROM p""",
)
def _(spark, d):
    """Every turn of a conversation is a snapshot; it is compared with the next one."""
    said = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.tokenize(F.col("text"))).alias("items"))
    path = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string")).alias("path")
    snaps = said.select(path(F.col("turn")), F.lit(0).alias("snap"), "items").unionByName(said.select(path(F.col("turn") - 1), F.lit(1).alias("snap"), "items"))
    return lineage.snapshot_similarity(snaps).withColumn("similarity", F.round("similarity", 6))


@query(
    "evidence_overlap",
    f"""WITH t AS (SELECT conv_id, turn, {_TOK} AS items FROM conversations) SELECT a.conv_id, a.turn, round(len(list_intersect(a.items, b.items)) / greatest(1, least(len(a.items), len(b.items))), 6) AS share,
    len(list_intersect(a.items, b.items)) / greatest(1, least(len(a.items), len(b.items))) >= 0.08 AS faithful FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def _(spark, d):
    """What each turn says against the turn before it."""
    t = table(spark, d, "conversations").select("conv_id", "turn", T.tokenize(F.col("text")).alias("items"))
    j = t.select("conv_id", "turn", F.col("items").alias("a")).join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("items").alias("b")), ["conv_id", "turn"])
    share = traces.overlap(F.col("a"), F.col("b"))
    return j.select("conv_id", "turn", F.round(share, 6).alias("share"), (share >= 0.08).alias("faithful"))


@query(
    "pair_change",
    C
    + SEQ
    + """, h AS (SELECT sha, seq < greatest(1, n // 2) AS early FROM placed WHERE n_files <= 12 AND churn <= 2500), e AS (SELECT early, x.path AS a, y.path AS b, count(*) AS w FROM files x JOIN files y ON x.sha = y.sha AND x.path < y.path JOIN h ON h.sha = x.sha GROUP BY 1, 2, 3 HAVING count(*) >= 2)
    SELECT a, b, CAST(coalesce(max(w) FILTER (early), 0) AS BIGINT) AS before, CAST(coalesce(max(w) FILTER (NOT early), 0) AS BIGINT) AS after FROM e GROUP BY 1, 2""",
)
def _(spark, d):
    from tidemark.functions.ordering import early, with_seq

    files, c = commit_files(spark, d), commits(spark, d)
    placed = with_seq(c.select("sha", "ts"), "ts", "sha", total="n").select("sha", early(F.col("seq"), F.col("n")).alias("early"))
    half = lambda cond: coupling.cochange_edges(files, c.join(placed.filter(cond), "sha", "left_semi"))
    return lineage.pair_change(half("early"), half("not early"))


@query(
    "commit_divisions",
    C + ", s AS (SELECT sha, CASE WHEN clade < 'Brand#2' THEN layer ELSE clade END AS division, sum(greatest(1, insertions + deletions)) AS w FROM files GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY w DESC, division) AS k FROM s) SELECT sha, division FROM r WHERE k = 1",
)
def _(spark, d):
    files = commit_files(spark, d)
    types = files.filter("clade < 'Brand#2'").select("path", F.col("layer").alias("type")).distinct()
    return lineage.divisions(files.drop("layer"), types)


@query(
    "run_outcomes",
    """WITH o AS (SELECT user_id AS run, CASE WHEN event_type = 'error' THEN 'rolled_back' WHEN value > 100 AND event_id % 3 = 0 THEN 'improved' WHEN value > 100 THEN 'accepted_no_delta' WHEN event_id % 2 = 0 THEN 'no_apply' ELSE 'none' END AS outcome FROM events),
    r AS (SELECT run, outcome, list_position(['none', 'no_apply', 'rolled_back', 'accepted_no_delta', 'improved'], outcome) AS k FROM o) SELECT run, arg_max(outcome, k) AS outcome, count(*) AS rounds FROM r GROUP BY 1""",
)
def _(spark, d):
    e = table(spark, d, "events")
    out = traces.round_outcome(F.col("value") > 100, F.col("event_id") % 2 != 0, F.col("event_id") % 3 == 0, F.col("event_type") == "error")
    return traces.best_outcomes(e.select(F.col("user_id").alias("run"), out.alias("outcome")))


@query("preferences", "SELECT user_id, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    e = table(spark, d, "events").select(F.array(F.col("user_id").cast("string")).alias("paths"), F.array(F.lit("f")).alias("frames"), F.col("event_type").alias("outcome"))
    return traces.preferences(e).select(F.element_at("paths", 1).cast("bigint").alias("user_id"), "outcome", "n")


@query("owner_conflicts", "SELECT event_type, list_sort(list(DISTINCT user_id % 5))[1] AS first, count(DISTINCT user_id % 5) AS n FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 5) > 1")
def _(spark, d):
    f = table(spark, d, "events").select((F.col("user_id") % 5).alias("kernel"), F.col("event_type").alias("path"))
    return traces.conflicts(f).select(F.col("path").alias("event_type"), F.element_at("owners", 1).alias("first"), F.size("owners").cast("bigint").alias("n"))


@query(
    "compact_notes",
    r"""WITH n AS (SELECT source, doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, lower(substr(text, 1, 80)) ORDER BY doc_id) AS k FROM n WHERE text <> '')
    SELECT source AS owner, doc_id AS "at", sha256(text) AS text FROM r WHERE k = 1""",
)
def _(spark, d):
    notes = table(spark, d, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("at"), "text")
    return traces.compact_notes(notes).withColumn("text", F.sha2("text", 256))


@query(
    "hypotheses",
    C
    + MONTHS
    + _MK
    + _P
    + """, c AS (SELECT * FROM (VALUES ('growth continues', 'commits', 'rising'), ('change continues', 'churn', 'rising')) v(claim, id, expects))
    SELECT claim, CASE WHEN n < 12 THEN 'insufficient' WHEN trend = expects THEN 'support' WHEN trend = 'flat' THEN 'weak' ELSE 'contradict' END AS verdict,
      round(CASE WHEN n < 8 THEN 0.15 WHEN n < 20 THEN 0.35 WHEN n < 80 THEN 0.55 + 0.25 * (n - 20) / 60 ELSE least(0.95, 0.8 + 0.001 * (n - 80)) END * (0.4 + 0.6 * (1 - p)), 4)::DOUBLE AS confidence FROM c JOIN labels USING (id)""",
)
def _(spark, d):
    from tidemark.operators.series import mann_kendall, with_trend_labels
    from tidemark.plans.series_queries import _monthly_long

    claims = spark.createDataFrame([("growth continues", "commits", "rising"), ("change continues", "churn", "rising")], "claim string, id string, expects string")
    return traces.hypotheses(with_trend_labels(mann_kendall(_monthly_long(spark, d))), claims).withColumn("confidence", F.round("confidence", 4))


@query("evolution_corpus", """WITH w AS (SELECT doc_id AS sha, list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}'), [CASE WHEN n_chars > 400 THEN 'churn_high' WHEN n_chars > 50 THEN 'churn_mid' ELSE 'churn_low' END])) AS words FROM documents)
  SELECT sha, CAST(len(words) AS INTEGER) AS n FROM w WHERE len(words) >= 2""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sha"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("subject"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("body"), F.col("n_chars").alias("churn"), F.lit(False).alias("is_revert"), F.lit(None).cast("array<string>").alias("path_words"))
    return traces.evolution_corpus(docs).select("sha", F.size("words").alias("n"))


_THEMES = " UNION ALL ".join(f"SELECT {-1 - i}, '{words}'" for i, words in enumerate(THEMES.values()))
_THEME_NAMES = ", ".join(f"({-1 - i}, '{name}')" for i, name in enumerate(THEMES))


@query(
    "themes",
    "WITH r AS (SELECT conv_id * 1000 + turn AS id, concat_ws(' ', role, text) AS text FROM conversations UNION ALL " + _THEMES + ")"
    + _EMB
    + f""", u AS (SELECT id, idx, val / sqrt(sum(val * val) OVER (PARTITION BY id)) AS x FROM e), n AS (SELECT * FROM (VALUES {_THEME_NAMES}) v(k, theme)),
    s AS (SELECT a.id, theme, round(sum(a.x * b.x), 9) AS score FROM u a JOIN u b ON a.idx = b.idx AND a.id >= 0 AND b.id < 0 JOIN n ON n.k = b.id GROUP BY 1, 2),
    b AS (SELECT id, theme, row_number() OVER (PARTITION BY id ORDER BY score DESC, theme) AS k FROM s WHERE score > 0), own AS (SELECT r.id % 1000 AS bucket, coalesce(theme, 'chore') AS theme FROM r LEFT JOIN b ON b.id = r.id AND b.k = 1 WHERE r.id >= 0)
    SELECT bucket, theme, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY bucket), 6) AS share FROM own GROUP BY 1, 2""",
)
def _(spark, d):
    from tidemark.operators.reports import theme_shares, themes

    e = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws(" ", "role", "text").alias("text"))
    return theme_shares(themes(e).select((F.col("id") % 1000).alias("bucket"), "theme")).withColumn("share", F.round("share", 6))


@query("event_themes", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'fix' ELSE NULL END AS theme FROM events WHERE event_type = 'error'")
def _(spark, d):
    from tidemark.operators.reports import themes

    e = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"))
    return themes(e).select("id", "theme")


_PHY = (
    C
    + SEQ
    + """, w AS (SELECT least(4, seq // greatest(1, n // 5)) AS win, avg(churn) AS c, avg(is_revert::INT) AS r, max(n) AS n FROM placed GROUP BY 1),
    lw AS (SELECT CASE WHEN r > 0.15 OR c > 400 THEN 'disturbance' WHEN win = 0 AND n < 40 THEN 'pioneer' WHEN c > 120 AND r < 0.08 THEN 'growth' WHEN c < 40 AND r < 0.05 THEN 'maturity' WHEN c < 15 AND win = 4 THEN 'decline' ELSE 'growth' END AS window_stage FROM w ORDER BY win DESC LIMIT 1),
    m AS (SELECT avg(churn) FILTER (seq >= n - greatest(1, n // 3)) AS r, coalesce(avg(churn) FILTER (seq < n - greatest(1, n // 3)), 0) AS o, avg(is_revert::INT) FILTER (seq >= n - greatest(1, n // 3)) AS rr, coalesce(avg(is_revert::INT) FILTER (seq < n - greatest(1, n // 3)), 0) AS ro FROM placed),
    b AS (SELECT count(*) AS commit_count, avg(is_revert::INT) AS rate, 1 / (1 + 0.002 * avg(churn) + 3 * avg(is_revert::INT) + 0.5 * (SELECT max(n) FROM (SELECT count(*) AS n FROM files GROUP BY path)) / count(*)) AS st FROM commits)
    SELECT commit_count, window_stage, CASE WHEN rate > 0.12 THEN 'disturbance' WHEN st > 0.75 AND (r - o) / (o + 1) < 0.2 THEN 'maturity' WHEN (r - o) / (o + 1) > 0.8 AND ro - rr + 0.1 * (o - r) / (o + 1) < 0 THEN 'growth'
      WHEN ro - rr + 0.1 * (o - r) / (o + 1) > 0.15 THEN 'consolidation' ELSE window_stage END AS current_stage FROM b, m, lw"""
)


@query("phylogeny_report", _PHY)
def _(spark, d):
    from tidemark.operators.reports import phylogeny

    return phylogeny(commits(spark, d), commit_files(spark, d), F.col("layer") == "ECONOMY")


@query("expectation_rates", "SELECT event_type AS \"case\", 2 AS n, CAST(1 + max((user_id = 3)::INT) AS BIGINT) AS passed, (1 + max((user_id = 3)::INT)) / 2.0::DOUBLE AS rate FROM events GROUP BY 1")
def _(spark, d):
    from tidemark.operators.reports import expectations

    e = table(spark, d, "events").select(F.col("event_type").alias("case"), F.col("user_id").alias("kind"))
    cases = e.select("case").distinct()
    spec = cases.select("case", F.explode(F.array(F.struct(F.lit(3).cast("bigint").alias("kind"), F.lit(True).alias("present")), F.struct(F.lit(-1).cast("bigint").alias("kind"), F.lit(False).alias("present")))).alias("s")).select("case", "s.*")
    return expectations(e, spec)
