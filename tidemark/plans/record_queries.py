"""The ledger of all record kinds, its claim frames and path packs, over results derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coupling, records
from tidemark.operators.graph import cut
from tidemark.plans.core_queries import EDGES, C
from tidemark.plans.registry import query
from tidemark.plans.testmap import commit_files, commits, table

#: Results that records are made of, as queries both engines read. The tables stand in braces.
INPUTS = {
    "clades": "SELECT clade, clade AS label, max(layer) AS layer, max(layer) AS code_type, count(DISTINCT path) AS n_files FROM {files} GROUP BY clade",
    "path_types": "SELECT DISTINCT path, clade, layer AS code_type FROM {files}",
    "allocations": "SELECT f.sha, f.path, f.clade, f.insertions, f.deletions, c.ts AS at_ FROM {files} f JOIN {commits} c ON f.sha = c.sha",
    "lineages": "SELECT path, max(clade) AS clade, min(sha) AS first_sha, max(sha) AS last_sha, count(*) / 50.0 AS fitness FROM {files} GROUP BY path",
    "events": "SELECT 'release' AS kind, 'v' || year(ts) AS label, min(ts) AS at_, 'growth' AS stage, 0.7 AS confidence FROM {commits} GROUP BY year(ts)",
    "changepoints": "SELECT 'churn' AS series, CASE WHEN year(ts) % 2 = 0 THEN 'up' ELSE 'down' END AS direction, max(ts) AS at_, sum(churn) AS magnitude FROM {commits} GROUP BY year(ts)",
    "anchors": "SELECT 'release' AS kind, 'v' || year(ts) AS label, min(ts) AS at_, 'growth' AS stage, 0.8 AS confidence, 'churn' AS series, max(ts) AS cp_at, CASE WHEN year(ts) % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM {commits} GROUP BY year(ts) HAVING year(ts) <> 1996",
    "segments": "SELECT CASE WHEN year(ts) < 1995 THEN 'pioneer' ELSE 'growth' END AS stage, min(ts) AS at_, max(ts) AS end_at, 0.6 AS confidence FROM {commits} GROUP BY year(ts)",
    "hypotheses": "SELECT CASE WHEN clade < 'Brand#2' THEN 'lehman_' ELSE 'stage_' END || clade AS id, clade || ' grows' AS claim, CASE WHEN count(*) > 2000 THEN 'support' ELSE 'weak' END AS verdict, 0.5 AS confidence FROM {files} GROUP BY clade",
    "experiments": "SELECT 'watch_' || layer AS id, layer || ' keeps growing' AS claim, layer AS branch FROM {files} GROUP BY layer",
    "failure_points": "SELECT 'hot-' || path AS id, path, max(clade) AS clade, 'hotspot' AS kind, path || ' is hot' AS title, count(*) / 40.0 AS severity FROM {files} GROUP BY path HAVING count(*) >= 40",
    "drift": "SELECT clade, count(DISTINCT path) / 500.0 AS drift FROM {files} GROUP BY clade",
    "signals": "SELECT 'churn_' || layer AS name, 0.5 AS confidence FROM {files} GROUP BY layer UNION ALL SELECT 'selection_pressure', count(*) / 100000.0 FROM {commits}",
    "debt": "SELECT path, sum(deletions) AS score FROM {files} GROUP BY path HAVING sum(deletions) > 300",
    "coupling": "SELECT a, b, weight FROM {edges} WHERE weight >= 2",
    "samples": "SELECT CAST(year(ts) * 100 + month(ts) AS CHAR(6)) AS month, min(ts) AS at_, count(*) AS activity FROM {commits} GROUP BY year(ts) * 100 + month(ts)",
    "impulses": "SELECT 'release' AS kind, 'v' || year(ts) AS label, min(ts) AS at_, sum(churn) AS response, 0.5 AS confidence FROM {commits} GROUP BY year(ts)",
    "basins": "SELECT CASE WHEN year(ts) < 1995 THEN 'pioneer' ELSE 'growth' END AS stage, min(ts) AS at_, count(*) / 15000.0 AS occupancy FROM {commits} GROUP BY CASE WHEN year(ts) < 1995 THEN 'pioneer' ELSE 'growth' END",
    "episodes": "SELECT f.path, max(f.clade) AS clade, min(f.sha) AS first_sha, max(f.sha) AS last_sha, min(c.ts) AS at_ FROM {files} f JOIN {commits} c ON f.sha = c.sha GROUP BY f.path, f.sha % 2",
    "issues": "SELECT event_id AS number, event_type AS title, ts AS at_ FROM {events} WHERE event_type = 'error'",
    "pulls": "SELECT event_id AS number, event_type AS title, ts AS at_ FROM {events} WHERE event_type = 'purchase'",
    "report_deltas": "SELECT clade AS item, CASE WHEN sum(deletions) * 2 > sum(insertions) THEN 'worsened' ELSE 'improved' END AS direction FROM {files} GROUP BY clade",
    "blast": "SELECT path, count(*) / 40.0 AS score FROM (SELECT a AS path FROM {edges} WHERE weight >= 2 UNION ALL SELECT b FROM {edges} WHERE weight >= 2) e GROUP BY path",
    "symbols": "SELECT p_name || '-' || p_partkey AS qualname, p_brand || '/' || p_type || '/' || p_name || '-' || p_partkey AS path, 'function' AS kind FROM {part}",
    "cst": "SELECT path, 'call' AS node, sha % 4 AS window, sum(insertions) AS delta FROM {files} WHERE deletions > 0 GROUP BY path, sha % 4",
    "cst_windows": "SELECT year(ts) AS window, min(ts) AS at_ FROM {commits} GROUP BY year(ts)",
    "gene_flow": "SELECT x.clade AS a, y.clade AS b, sum(weight) AS weight FROM {edges} e JOIN (SELECT DISTINCT path, clade FROM {files}) x ON x.path = e.a JOIN (SELECT DISTINCT path, clade FROM {files}) y ON y.path = e.b WHERE weight >= 2 AND x.clade < y.clade GROUP BY x.clade, y.clade",
    "transfers": "SELECT sha FROM {commits} WHERE n_files > 6",
    "clones": "SELECT p_name AS id, min(p_brand || '/' || p_type || '/' || p_name || '-' || p_partkey) AS path FROM {part} GROUP BY p_name",
    "forks": "SELECT p_name || p_size AS hash, min(p_brand || '/' || p_type || '/' || p_name || '-' || p_partkey) AS path FROM {part} GROUP BY p_name || p_size HAVING count(*) > 1",
    "reticulation": "SELECT a, b, weight FROM {edges} WHERE weight >= 3",
    "stage": "SELECT 'growth' AS stage, CASE WHEN count(*) > 10 THEN 'event_changepoint' ELSE 'heuristic_fallback' END AS method, 0.6 AS confidence FROM {commits}",
    "branch_trends": "SELECT layer AS type_key, CASE WHEN sum(deletions) * 2 > sum(insertions) THEN 'cooling' WHEN count(*) > 9000 THEN 'heating' ELSE 'steady' END AS trend, sum(insertions + deletions) AS churn FROM {files} GROUP BY layer",
}


def results(spark, d):
    """The results by name; files, commits and pairs of files are written once."""
    files, c = cut(commit_files(spark, d), "files"), cut(commits(spark, d), "commits")
    given = {"files": files, "commits": c, "edges": cut(coupling.cochange_edges(files, c), "edges"), "part": table(spark, d, "part"), "events": table(spark, d, "events")}
    return {name: (lambda df: df.withColumnRenamed("at_", "at") if "at_" in df.columns else df)(spark.sql(sql, **{k: v for k, v in given.items() if "{" + k + "}" in sql})) for name, sql in INPUTS.items()}


_GIVEN = C + EDGES + "".join(f", i_{name} AS ({sql.format(files='files', commits='commits', edges='edges', part='part', events='events')})" for name, sql in INPUTS.items())
_DAY = "strftime({}, '%Y-%m-%d')"
_D, _CP = _DAY.format("at_"), _DAY.format("cp_at")
#: Per table: kind, id, path, clade, time and links (id;kind;role, one after the other) of its records.
_SOURCES = [
    ("clades", "clade", "'clade:' || clade", "NULL", "clade", "NULL", "[]"),
    ("path_types", "code_type", "'code_type:' || path", "path", "clade", "NULL", "['clade:' || clade || ';clade;context']"),
    ("allocations", "commit_delta", "'delta:' || substr(CAST(sha AS VARCHAR), 1, 10) || ':' || path", "path", "clade", "at_", "['clade:' || clade || ';clade;context']"),
    ("lineages", "lineage", "'lineage:' || path", "path", "clade", "NULL", "[]"),
    ("events", "lifecycle_event", f"'event:' || kind || ':' || label || ':' || {_D}", "NULL", "NULL", "at_", "[]"),
    ("anchors", "lifecycle_event", "'anchor:' || label || ':' || stage", "NULL", "NULL", "at_", f"['event:' || kind || ':' || label || ':' || {_D} || ';lifecycle_event;supports', 'cp:' || series || ':' || {_CP} || ':' || direction || ';changepoint;supports']"),
    ("changepoints", "changepoint", f"'cp:' || series || ':' || {_D} || ':' || direction", "NULL", "NULL", "at_", "[]"),
    ("segments", "stage_segment", f"'seg:' || stage || ':' || {_D}", "NULL", "NULL", "at_", "[]"),
    ("hypotheses", "hypothesis", "'hyp:' || id", "NULL", "NULL", "NULL", "[]"),
    ("experiments", "experiment", "'exp:' || id", "NULL", "NULL", "NULL", "[]"),
    ("failure_points", "failure_point", "'fp:' || id || ':' || path", "path", "clade", "NULL", "[]"),
    ("drift", "drift", "'drift:' || clade", "NULL", "clade", "NULL", "[]"),
    ("signals", "signal", "'signal:' || name", "NULL", "NULL", "NULL", "[]"),
    ("debt", "debt_item", "'debt:' || path", "path", "NULL", "NULL", "[]"),
    ("coupling", "coupling_edge", "'couple:' || a || ':' || b", "a", "NULL", "NULL", "['lineage:' || a || ';lineage;context', 'lineage:' || b || ';lineage;context']"),
    ("samples", "state_sample", "'state:' || month", "NULL", "NULL", "at_", "[]"),
    ("impulses", "impulse_response", f"'impulse:' || kind || ':' || label || ':' || {_D}", "NULL", "NULL", "at_", f"['event:' || kind || ':' || label || ':' || {_D} || ';lifecycle_event;context']"),
    ("basins", "regime_basin", f"'basin:' || stage || ':' || {_D}", "NULL", "NULL", "at_", "[]"),
    ("episodes", "path_episode", "'episode:' || path || ':' || first_sha || ':' || last_sha", "path", "clade", "at_", "['lineage:' || path || ';lineage;context']"),
    ("issues", "selection_item", "'issue:' || number || ':' || title", "NULL", "NULL", "at_", "[]"),
    ("pulls", "selection_item", "'pr:' || number || ':' || title", "NULL", "NULL", "at_", "[]"),
    ("report_deltas", "report_delta", "'delta:' || direction || ':' || item", "NULL", "NULL", "NULL", "[]"),
    ("blast", "blast_radius", "'blast:' || path", "path", "NULL", "NULL", "['lineage:' || path || ';lineage;context']"),
    ("symbols", "symbol", "'sym:' || qualname", "path", "NULL", "NULL", "['lineage:' || path || ';lineage;context', 'blast:' || path || ';blast_radius;measures']"),
    ("cst", "cst_delta", "'cst:' || path || ':' || node || ':' || \"window\"", "path", "NULL", "NULL", "['lineage:' || path || ';lineage;context']"),
    ("cst_windows", "cst_delta", "'cstwin:' || \"window\"", "NULL", "NULL", "at_", "[]"),
    ("gene_flow", "gene_flow", "'flow:' || a || ':' || b", "NULL", "a", "NULL", "['clade:' || a || ';clade;context', 'clade:' || b || ';clade;context']"),
    ("transfers", "gene_flow", "'hgt:' || sha", "NULL", "NULL", "NULL", "[]"),
    ("clones", "clone_link", "'clone:' || id", "path", "NULL", "NULL", "[]"),
    ("forks", "clone_link", "'fork:' || hash", "path", "NULL", "NULL", "[]"),
    ("reticulation", "reticulation", "'ret:' || a || ':' || b", "a", "NULL", "NULL", "['lineage:' || a || ';lineage;context', 'lineage:' || b || ';lineage;context']"),
]
_RECORDS = _GIVEN + ", rec AS (" + " UNION ALL ".join(
    f"SELECT substr({rid}, 1, 160) AS id, '{kind}' AS kind, CAST({path} AS VARCHAR) AS path, CAST({clade} AS VARCHAR) AS clade, CAST({when} AS TIMESTAMP) AS at_, CAST({links} AS VARCHAR[]) AS links FROM i_{name}"
    for name, kind, rid, path, clade, when, links in _SOURCES
) + """ UNION ALL SELECT 'trajectory:global', 'trajectory', NULL, NULL, min(at_), list_transform(list_sort(list_sort(list(month), 'DESC')[1:8]), lambda m: 'state:' || m || ';state_sample;measures') FROM i_samples)"""


@query("full_ledger", _RECORDS + " SELECT id, kind, path, clade, strftime(at_, '%Y-%m-%d') AS day, array_to_string(links, ',') AS links FROM rec")
def _(spark, d):
    rows = records.records(results(spark, d))
    links = F.array_join(F.transform("links", lambda x: F.concat_ws(";", x["record_id"], x["kind"], x["role"])), ",")
    return rows.select("id", "kind", "path", "clade", F.date_format("at", "yyyy-MM-dd").alias("day"), links.alias("links"))


_PACK = """, own AS (SELECT id, kind, at_, path FROM rec WHERE path IS NOT NULL AND path <> '' UNION SELECT id, kind, at_, substr(split_part(l, ';', 1), 9) FROM (SELECT id, kind, at_, unnest(links) AS l FROM rec WHERE kind IN ('coupling_edge', 'reticulation')) x),
    sl AS (SELECT *, CASE kind WHEN 'lineage' THEN 'lineage' WHEN 'code_type' THEN 'code_type' WHEN 'blast_radius' THEN 'blast' WHEN 'symbol' THEN 'symbols' WHEN 'cst_delta' THEN 'cst' WHEN 'path_episode' THEN 'episodes' WHEN 'commit_delta' THEN 'deltas' WHEN 'failure_point' THEN 'risks'
        WHEN 'gene_flow' THEN 'graph_links' WHEN 'clone_link' THEN 'graph_links' WHEN 'reticulation' THEN 'graph_links' WHEN 'coupling_edge' THEN 'graph_links' END AS slot FROM own),
    al AS (SELECT path, id, at_, slot FROM sl WHERE slot IS NOT NULL UNION ALL SELECT path, id, at_, 'timeline' FROM own WHERE at_ IS NOT NULL),
    ra AS (SELECT *, row_number() OVER (PARTITION BY path, slot ORDER BY at_ DESC NULLS LAST, id) AS k FROM al
      QUALIFY k <= CASE slot WHEN 'symbols' THEN 12 WHEN 'cst' THEN 8 WHEN 'episodes' THEN 8 WHEN 'deltas' THEN 20 WHEN 'timeline' THEN 20 WHEN 'risks' THEN 50 WHEN 'graph_links' THEN 10 ELSE 1 END),
    cl AS (SELECT path, coalesce(min(clade) FILTER (kind = 'lineage'), min(clade)) AS clade FROM rec WHERE path IS NOT NULL AND clade IS NOT NULL GROUP BY path)
    SELECT path, max(clade) AS clade, """ + ", ".join(f"coalesce(string_agg(id, ',' ORDER BY k) FILTER (slot = '{s}'), '') AS {s}" for s in ("lineage", "code_type", "blast", "symbols", "cst", "episodes", "deltas", "risks", "graph_links", "timeline")) + " FROM ra LEFT JOIN cl USING (path) GROUP BY path"


@query("path_packs", _RECORDS + _PACK)
def _(spark, d):
    packs = records.path_packs(records.records(results(spark, d)))
    return packs.select("path", "clade", *[F.array_join(c, ",").alias(c) for c in packs.columns if c not in ("path", "clade")])


_RISK_FRAMES = """, fp AS (SELECT 'frame:risk:' || id AS frame, id AS fid, path, clade, title, severity FROM i_failure_points),
    evd AS (SELECT substr(frame, 1, 120) AS frame, 0 AS rank, 'fp:' || fid || ':' || path AS rid FROM fp UNION ALL SELECT substr(frame, 1, 120), 1, 'lineage:' || path FROM fp UNION ALL SELECT substr(frame, 1, 120), 2, 'clade:' || clade FROM fp
      UNION ALL SELECT substr(frame, 1, 120), 3, 'blast:' || path FROM fp UNION ALL SELECT substr(frame, 1, 120), 4, rec.id FROM fp JOIN rec ON rec.path = fp.path AND kind = 'symbol' UNION ALL SELECT substr(frame, 1, 120), 5, rec.id FROM fp JOIN rec ON rec.path = fp.path AND kind = 'cst_delta'),
    kept AS (SELECT substr(frame, 1, 120) AS id, min(title) AS claim, CASE WHEN min(severity) >= 0.75 THEN 0.6 ELSE 0.45 END AS confidence FROM fp GROUP BY 1 ORDER BY 1 LIMIT 50),
    ek AS (SELECT frame, rank, rid, row_number() OVER (PARTITION BY frame ORDER BY rank, rid) AS k FROM (SELECT frame, rid, min(rank) AS rank FROM evd WHERE rid IN (SELECT id FROM rec) GROUP BY 1, 2) x QUALIFY k <= 10)
    SELECT row_number() OVER (ORDER BY id) AS place, id, claim, 'risk' AS stance, confidence::DOUBLE AS confidence, (SELECT string_agg(rid, ',' ORDER BY k) FROM ek WHERE frame = id) AS evidence FROM kept"""


@query("risk_frames", _RECORDS + _RISK_FRAMES)
def _(spark, d):
    """The frames of failure points alone, with what bears them out."""
    given = results(spark, d)
    ledger = records.records(given)
    kinds = ("failure_point", "lineage", "clade", "blast_radius", "symbol", "cst_delta")
    out = records.claim_frames({"failure_points": given["failure_points"]}, ledger.filter(F.col("kind").isin(*kinds)))
    return out.select(F.col("place").cast("bigint").alias("place"), "id", "claim", "stance", "confidence", F.array_join("evidence.record_id", ",").alias("evidence"))


@query("claim_frames")
def _(spark, d):
    """All nine kinds of frames."""
    given = results(spark, d)
    return records.claim_frames(given, records.records(given)).withColumn("evidence", F.array_join("evidence.record_id", ","))


@query(
    "tagged_records",
    _RECORDS + """ SELECT id, kind FROM rec WHERE kind IN ('lineage', 'commit_delta', 'regime_basin', 'path_episode', 'blast_radius') AND contains(coalesce(path, ''), 'ring') AND (at_ IS NULL OR (at_ >= TIMESTAMP '1995-01-01' AND at_ <= TIMESTAMP '1996-12-31'))
      UNION ALL SELECT id, kind FROM rec WHERE kind IN ('symbol', 'cst_delta') AND clade = 'Brand#1'
      UNION ALL SELECT id, kind FROM rec WHERE kind = 'path_episode' AND clade = 'Brand#2'""",
)
def _(spark, d):
    """Records on paths with a word in a span of years, those of a clade and a tag, and episodes of another clade."""
    rows = cut(records.records(results(spark, d)), "ledger")
    on_path = records.select_records(rows, path="ring", kinds=["lineage", "commit_delta", "regime_basin", "path_episode", "blast_radius"], since="1995-01-01", until="1996-12-31")
    tagged, episodes = records.select_records(rows, clade="Brand#1", tag="micro"), records.select_records(rows, clade="Brand#2", tag="episode")
    return on_path.unionByName(tagged).unionByName(episodes).select("id", "kind")
