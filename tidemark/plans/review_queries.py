"""Queries over crossings, reflections, experiments, checks, labels and reports in one call."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coupling, labels, reviews, risk, taxonomy
from tidemark.plans.core_queries import C
from tidemark.plans.registry import query
from tidemark.plans.risk_queries import RISKS, risks, the_ledger
from tidemark.plans.series_queries import rounded
from tidemark.plans.testmap import SQL_COMMITS, SQL_PARENTS, commit_files, commits, parents, table
from tidemark.plans.walk_queries import _MATCH, _NAMED, _REACH, _WORDS, TALKS, talks

_HALVES = """, r AS (SELECT path, sha, author, subject, year(ts) < 1998 AS old FROM files JOIN commits USING (sha)),
    p AS (SELECT path AS id, 'type' AS kind, arg_max(author, sha) AS label FROM r WHERE old GROUP BY 1 UNION ALL SELECT 'frame:' || author, 'frame', arg_max(subject, sha) FROM commits WHERE year(ts) < 1998 GROUP BY 1),
    n AS (SELECT path AS id, 'type' AS kind, arg_max(author, sha) AS label FROM r WHERE NOT old GROUP BY 1 UNION ALL SELECT 'frame:' || author, 'frame', arg_max(subject, sha) FROM commits WHERE year(ts) >= 1998 GROUP BY 1),
    b AS (SELECT p.kind AS pk, n.kind AS nk, p.label AS pl, n.label AS nl, coalesce(p.id, n.id) AS ref FROM p FULL JOIN n ON p.id = n.id),
    s AS (SELECT count(*) FILTER (is_revert AND year(ts) < 1998) AS r0, count(*) FILTER (is_revert AND year(ts) >= 1998) AS r1, count(*) FILTER (year(ts) < 1998) AS n0, count(*) FILTER (year(ts) >= 1998) AS n1 FROM commits)"""


@query(
    "delta_events",
    C
    + _HALVES
    + """ SELECT CASE WHEN pk IS NULL THEN 'type_added' WHEN nk IS NULL THEN 'type_removed' ELSE 'type_changed' END AS kind, ref, CASE WHEN pk IS NULL THEN 0.45 WHEN nk IS NULL THEN 0.4 ELSE 0.55 END::DOUBLE AS urgency FROM b WHERE 'type' IN (pk, nk) AND pl IS DISTINCT FROM nl
    UNION ALL SELECT 'stance_changed', ref, 0.7 FROM b WHERE pk = 'frame' AND nk = 'frame' AND pl <> nl UNION ALL SELECT 'nodes_added', 'delta:nodes', least(0.5, count(*) / 40) FROM b WHERE pk IS NULL HAVING count(*) >= 3
    UNION ALL SELECT 'nodes_removed', 'delta:nodes', least(0.45, count(*) / 40) FROM b WHERE nk IS NULL HAVING count(*) >= 3 UNION ALL SELECT 'stage_changed', 'window:ecology', 0.8
    UNION ALL SELECT 'debt_crossed', 'context:debt', round(least(1.0, 4 * abs(r1 / n1 + 0.1 - r0 / n0)), 6) FROM s WHERE abs(r1 / n1 + 0.1 - r0 / n0) >= 0.05 UNION ALL SELECT 'risk_count', 'context:risk', 0.6 FROM s WHERE r0 <> r1""",
)
def _(spark, d):
    c = commits(spark, d)
    rows = commit_files(spark, d).join(c.select("sha", "ts", "author"), "sha")
    old = F.year("ts") < 1998

    def half(when):
        types = rows.filter(when).groupBy(F.col("path").alias("id")).agg(F.lit("type").alias("kind"), F.max_by("author", "sha").alias("label"))
        return types.unionByName(c.filter(when).groupBy(F.concat(F.lit("frame:"), "author").alias("id")).agg(F.lit("frame").alias("kind"), F.max_by("subject", "sha").alias("label")))

    def state(when, stage, more):
        return c.filter(when).agg(F.lit(stage).alias("stage"), (F.avg(F.col("is_revert").cast("int")) + more).alias("debt"), F.count_if("is_revert").alias("risks"))

    return rounded(reviews.delta_events(half(old), half(~old), state(old, "growth", 0.0), state(~old, "maturity", 0.1)), "urgency")


@query("merged_findings", "SELECT role AS kernel, text AS finding, count(*) AS n, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY 1, 2")
def _(spark, d):
    c = table(spark, d, "conversations")
    return reviews.merge_findings(c.select(F.col("role").alias("kernel"), F.col("text").alias("finding"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")))


# --- reflections: orders are rounds, their customers' segments the frames a proposal rests on


def rounds(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    notes = F.when(k % 7 == 0, "Rolled back after a test").when(k % 5 == 0, F.lit(None)).otherwise("done")
    frames = F.when(k % 2 == 0, F.array("c_mktsegment")).otherwise(F.array(F.concat(F.lit("frame:"), "c_mktsegment"), "o_orderpriority"))
    return o.select(k.alias("index"), F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_orderstatus") != "P").alias("verify_ok"), notes.alias("notes"), frames.alias("frames"))


_ROUNDS = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus <> 'P' END AS ok, CASE WHEN o_orderkey % 7 = 0 THEN 'Rolled back after a test' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'done' END AS notes,
      CASE WHEN o_orderkey % 2 = 0 THEN [c_mktsegment] ELSE ['frame:' || c_mktsegment, o_orderpriority] END AS frames FROM orders JOIN customer ON o_custkey = c_custkey),
    f AS (SELECT * FROM o WHERE NOT ok OR k % 7 = 0), x AS (SELECT k, unnest(frames) AS f FROM f)"""


@query("reflection_edges", _ROUNDS + " SELECT 'reflect:fail:' || k AS source, 'decision:' || k AS target, 'overridden' AS rel FROM f UNION SELECT 'reflect:fail:' || k, CASE WHEN f LIKE 'frame:%' THEN f ELSE 'frame:' || f END, 'falsified_by' FROM x")
def _(spark, d):
    return reviews.failure_reflections(rounds(spark, d))[1]


@query(
    "merged_reflections",
    _ROUNDS
    + """, h AS (SELECT 'decision:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT 'reflect:fail:' || k AS id, 'reflection' AS kind FROM f UNION SELECT 'decision:' || k, 'decision' FROM f UNION SELECT CASE WHEN f LIKE 'frame:%' THEN f ELSE 'frame:' || f END, 'frame' FROM x)
    SELECT id, 'decision' AS kind FROM h UNION ALL SELECT * FROM m WHERE id NOT IN (SELECT id FROM h)""",
)
def _(spark, d):
    """The host knows the decisions of finished rounds."""
    none = F.lit(None)
    host = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        F.concat(F.lit("decision:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("decision").alias("kind"), F.lit("").alias("label"), F.lit("").alias("text"), F.col("o_orderkey").cast("bigint").alias("seq"), none.cast("double").alias("confidence")
    )  # a part of a graph, as a host's is
    edges = spark.createDataFrame([], "source string, target string, rel string")
    nodes, _edges = reviews.merge_reflections((host, edges), reviews.failure_reflections(rounds(spark, d)))
    return nodes.select("id", "kind").distinct()


@query("preference_edges", "WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT 'pref:' || user_id || event_type AS source, 'frame:' || event_type AS target, 'cites' AS rel, round(least(0.9, 0.4 + 0.1 * n), 6)::DOUBLE AS confidence FROM p")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    prefs = e.select(F.concat(F.lit("pref:"), F.col("user_id").cast("string"), "event_type").alias("id"), F.lit("prefer_fence").alias("rule"), F.lit("").alias("text"), "n", F.array("event_type").alias("frames"))
    nodes, edges = reviews.preference_graph(prefs)
    return rounded(edges.join(nodes.select(F.col("id").alias("source"), "confidence"), "source"), "confidence").select("source", "target", "rel", "confidence")


# --- experiments, checks


@query(
    "next_experiments",
    C
    + """, t AS (SELECT clade AS k, CAST(sum(CASE WHEN year(ts) < 1998 THEN f.insertions END) AS BIGINT) AS e, CAST(sum(CASE WHEN year(ts) >= 1998 THEN f.insertions END) AS BIGINT) AS l FROM files f JOIN commits USING (sha) GROUP BY 1),
    b AS (SELECT k, l - e AS dl, CASE WHEN l - e > greatest(20.0, 0.25 * (e + 1)) THEN 'heating' WHEN l - e < -greatest(20.0, 0.25 * (e + 1)) THEN 'cooling' ELSE 'steady' END AS trend FROM (SELECT k, coalesce(e, 0) AS e, coalesce(l, 0) AS l FROM t)),
    h AS (SELECT trend, k, row_number() OVER (PARTITION BY trend ORDER BY abs(dl) DESC, k) AS n FROM b),
    x AS (SELECT n AS o, 'heat_' || n AS id, k AS about FROM h WHERE trend = 'heating' AND n <= 3 UNION ALL SELECT 3 + n, 'cool_' || n, k FROM h WHERE trend = 'cooling' AND n <= 2 UNION ALL SELECT 6, 'lehman_quality', 'revert_rate' UNION ALL SELECT 7, 'stage_shift', 'growth'
      UNION ALL SELECT 8, 'changepoint_persist', arg_max(strftime(ts, '%Y-%m'), (churn, strftime(ts, '%Y-%m'))) FROM commits UNION ALL SELECT 10, 'event_anchor', arg_max(subject, (ts, subject)) FROM commits WHERE is_revert)
    SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS place, id, about FROM x ORDER BY o LIMIT 8""",
)
def _(spark, d):
    c = commits(spark, d)
    rows = commit_files(spark, d).join(c.select("sha", "ts"), "sha").select(F.col("clade").alias("type_key"), (F.year("ts") < 1998).alias("early"), F.col("insertions").alias("churn"))
    trends = spark.createDataFrame([("revert_rate", "rising"), ("churn_rate", "flat")], "id string, trend string")
    points = c.select(F.col("churn").alias("magnitude"), F.date_format("ts", "yyyy-MM").alias("id"))
    anchors = c.filter("is_revert").select(F.lit("revert_storm").alias("kind"), F.col("subject").alias("label"), F.col("ts").alias("at"))
    return reviews.next_experiments(taxonomy.branch_trends(rows), trends, spark.createDataFrame([("growth",)], "stage string"), points, anchors)


@query(
    "dynamics_checks",
    C
    + """, m AS (SELECT count(DISTINCT strftime(ts, '%Y-%m')) >= 8 AS e FROM commits), r AS (SELECT count(*) >= 1 AS v FROM commits WHERE is_revert)
    SELECT 'trajectory' AS "case", unnest(['real_months', 'trajectory_record', 'pack_schema', 'frames_present', 'timeline_dated']) AS "check", unnest([e, true, true, true, true]) AS ok FROM m
    UNION ALL SELECT 'impulse_major', unnest(['real_months', 'lifecycle_events', 'release_event', 'impulse_response', 'response_or_stage_frame']), unnest([e, true, true, v, true]) FROM m, r
    UNION ALL SELECT 'basin', unnest(['real_months', 'basin_or_segment', 'basin_or_stage_frame', 'stage_labeled', 'path_pack_ok']), unnest([e, false, true, true, true]) FROM m""",
)
def _(spark, d):
    c = commits(spark, d)
    months = c.select(F.date_format("ts", "yyyy-MM").alias("month")).distinct()
    none = F.lit(None).cast("string")
    records = months.select(F.lit("state_sample").alias("kind"), F.to_timestamp(F.concat("month", F.lit("-01"))).alias("at"), none.alias("path"))
    records = records.unionByName(c.filter("is_revert").select(F.lit("impulse_response").alias("kind"), F.col("ts").alias("at"), none.alias("path"))).unionByName(commit_files(spark, d).select(F.lit("delta").alias("kind"), F.lit(None).cast("timestamp").alias("at"), "path"))
    frames = spark.createDataFrame([("frame:stage",), ("frame:risk:W1",)], "id string")
    events = c.select(F.year("ts").alias("y")).distinct().select(F.lit("minor_release").alias("kind"), F.concat(F.lit("v"), F.col("y").cast("string")).alias("label"))
    return reviews.dynamics_checks(months, records, frames, events, spark.createDataFrame([], "id string"), spark.createDataFrame([("growth",)], "stage string"))


# --- risks and reports


@query(
    "log_risks",
    """WITH r AS (SELECT c_nationkey AS repo, count(*) FILTER (o_orderstatus <> 'P') AS prod, count(*) FILTER (o_orderpriority = '1-URGENT') AS test, avg((o_orderpriority = '2-HIGH')::INT) AS dep, avg((o_orderstatus = 'F')::INT) AS q FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    p AS (SELECT repo, 'test_gap' AS kind, '(repository)' AS path, 0.7 AS s FROM r WHERE prod > 20 AND test < 0.25 * prod UNION ALL SELECT repo, 'dependency_shock', '(manifests/lockfiles)', 3 * dep FROM r WHERE dep > 0.12 UNION ALL SELECT repo, 'dependency_fragility', '(supply chain)', 0.35 + q FROM r WHERE q >= 0.4
      UNION ALL SELECT repo, 'offboarding_risk', '(knowledge)', 0.4 + dep * 2 FROM r WHERE dep * 2 >= 0.35 UNION ALL SELECT repo, 'sprint_fatigue', '(work rhythm)', 0.4 + q FROM r WHERE q >= 0.45 UNION ALL SELECT repo, 'cognitive_load', '(attention / ownership)', 0.35 + (1 - q) FROM r WHERE 1 - q >= 0.5
      UNION ALL SELECT repo, 'selection_pressure', '(github issues/prs)', 0.4 + dep FROM r WHERE dep >= 0.35)
    SELECT repo, kind, path, round(least(1.0, s), 6)::DOUBLE AS severity FROM p""",
)
def _(spark, d):
    """Nations stand for repositories."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    share = lambda when: F.avg(when.cast("int"))
    r = o.groupBy(F.col("c_nationkey").alias("repo")).agg(
        F.count_if(F.col("o_orderstatus") != "P").alias("prod_touches"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("test_touches"), share(F.col("o_orderpriority") == "2-HIGH").alias("dependency_rate"), share(F.col("o_orderstatus") == "F").alias("fragility")
    )
    r = r.withColumns({"mastery_drop": F.col("dependency_rate") * 2, "fatigue": F.col("fragility"), "load_index": 1 - F.col("fragility"), "pressure": F.col("dependency_rate")})
    return rounded(risk.log_points(r, "repo"), "severity")


_SMELLS = [("hotspot_gravity", "high"), ("utility_sink", "med")]


@query(
    "owner_and_smell_risks",
    C
    + """, w AS (SELECT path, count(*) AS touches, count(DISTINCT email % 2) AS owners FROM files JOIN commits USING (sha) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10), a AS (SELECT 'bus_factor' AS kind, path, 0.55::DOUBLE AS severity FROM w WHERE owners = 1 UNION ALL SELECT 'hotspot_gravity', '(arch)', 0.75 UNION ALL SELECT 'utility_sink', '(arch)', 0.5)
    SELECT 'W' || row_number() OVER (ORDER BY severity DESC, kind, path) AS id, kind, path, severity, CASE WHEN severity >= 0.85 THEN 'P0' WHEN severity >= 0.65 THEN 'P1' ELSE 'P2' END AS priority FROM a""",
)
def _(spark, d):
    """Authors are told apart by the parity of their number alone, so that some hot files have one owner at small sizes."""
    one = commits(spark, d).withColumn("author", F.col("email") % 2)
    return risk.rank_points(risk.owner_points(coupling.single_owner_hot(commit_files(spark, d), one)), risk.smell_points(spark.createDataFrame(_SMELLS, "smell string, severity string")))


@query(
    "remediation_plan",
    C
    + RISKS
    + """, w AS (SELECT id, kind, severity, CASE kind WHEN 'revert_surface' THEN 'stabilize' WHEN 'change_coupling' THEN 'decouple' WHEN 'dependency_shock' THEN 'dependencies' ELSE 'consolidate' END AS wave FROM risks),
    g AS (SELECT id AS g FROM w WHERE wave = 'stabilize' ORDER BY severity DESC, id LIMIT 1)
    SELECT id, kind, wave, CASE WHEN wave <> 'stabilize' THEN (SELECT g FROM g) END AS depends_on FROM w UNION ALL SELECT 'DEB-' || k, k, 'contain', (SELECT g FROM g) FROM (VALUES ('hotspot_gravity'), ('utility_sink')) v(k)""",
)
def _(spark, d):
    return reviews.remediation(risks(spark, d), spark.createDataFrame(_SMELLS, "smell string, severity string")).select("id", "kind", "wave", "depends_on")


_DIV = """, sm AS (SELECT sha, layer AS division, sum(greatest(1, insertions + deletions)) AS w FROM files GROUP BY 1, 2), dv AS (SELECT sha, division FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY w DESC, division) AS k FROM sm) WHERE k = 1)"""


@query(
    "commit_model",
    C
    + ", "
    + SQL_PARENTS.replace("headers AS (", "headers2 AS (", 1)
    + _DIV
    + """, rk AS (SELECT p_brand AS clade, max(p_size) / 50.0::DOUBLE AS risk FROM part GROUP BY 1), db AS (SELECT p_brand AS clade, avg((p_type = 'PROMO')::INT) AS debt FROM part GROUP BY 1), k AS (SELECT sha, min(clade) AS clade FROM files GROUP BY 1), np AS (SELECT sha, count(*) AS n FROM parents GROUP BY 1)
    SELECT c.sha, CASE WHEN n > 1 THEN 'merge' ELSE 'unknown' END AS intent, dv.division, round(0.45 * coalesce(risk, 0) + 0.35 * coalesce(debt, 0) + 0.2 * churn / (SELECT greatest(1, max(churn)) FROM commits), 6) AS score, coalesce(n, 0) AS parents, coalesce(dv.division <> up.division, false) AS shift
    FROM commits c LEFT JOIN k ON k.sha = c.sha LEFT JOIN rk USING (clade) LEFT JOIN db USING (clade) LEFT JOIN dv ON dv.sha = c.sha LEFT JOIN np ON np.sha = c.sha LEFT JOIN parents p ON p.sha = c.sha AND p.pos = 0 LEFT JOIN dv up ON up.sha = p.parent""",
)
def _(spark, d):
    part = table(spark, d, "part")
    r = part.groupBy(F.col("p_brand").alias("clade")).agg((F.max("p_size") / 50).alias("risk"))
    b = part.groupBy(F.col("p_brand").alias("clade")).agg(F.avg((F.col("p_type") == "PROMO").cast("int")).alias("debt"))
    files = commit_files(spark, d)
    types = files.select("path", F.col("layer").alias("type")).distinct()
    return rounded(reviews.commit_model(commits(spark, d), parents(spark, d), files, types, r, b), "score")


@query(
    "context_query",
    TALKS
    + f", m AS (SELECT id, kind, {_MATCH} AS share, {_NAMED} AS named FROM nodes), e AS (SELECT * FROM edges WHERE rel IN ('next', 'spawned', 'proposed', 'joins'))"
    + _REACH.format(seed="'run1'", depth=4)
    + """ SELECT 'search' AS mode, id, round(share + CASE WHEN kind IN ('decision', 'round', 'pivot') THEN 0.08 ELSE 0 END + CASE WHEN named THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM m WHERE share > 0
    UNION ALL SELECT 'family', id, round(1 / (1 + hops), 6) FROM r JOIN nodes USING (id) WHERE kind IN ('run', 'round', 'pivot') UNION ALL SELECT 'pivot', source, 1 FROM edges WHERE rel = 'joins'""",
)
def _(spark, d):
    seeds = spark.createDataFrame([("run1",)], "id string")
    return rounded(reviews.query_context(*talks(spark, d), search=_WORDS, family=("flow", seeds), pivot="topic"), "score")


@query("ledger_question", "WITH " + SQL_COMMITS + " SELECT 'delta:' || sha || ':' || path AS id, path FROM files WHERE contains(path, 'ring') AND sha IN (SELECT sha FROM commits)")
def _(spark, d):
    return reviews.query_ledger(the_ledger(spark, d), risk.frames(risks(spark, d)), path="ring", kinds=["delta"]).select("id", "path")


# --- words and labels


def page_files(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("docs/page_"), F.col("doc_id").cast("string")).alias("path"), "text", "lang", "source", "doc_id")


_WORD = "[a-z_][a-z0-9_]{2,}"


@query(
    "file_documents",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    t AS (SELECT doc_id, string_agg(array_to_string(regexp_extract_all(lower(s), '{_WORD}'), ' '), ' ' ORDER BY i) AS notes FROM l WHERE regexp_matches(s, '^\\s*(#|//|\\*)') AND len(regexp_extract_all(lower(s), '{_WORD}')) > 0 GROUP BY 1)
    SELECT 'docs/page_' || doc_id AS path, trim('file docs page ' || doc_id || ' type prose ' || coalesce(lang, '') || ' modules docs page' || CASE WHEN doc_id < 0 THEN ' x' ELSE '' END || ' symbols ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}'), ' ') || ' notes ' || coalesce(notes, '')) AS text
    FROM documents LEFT JOIN t USING (doc_id)""",
)
def _(spark, d):
    files = page_files(spark, d)
    return labels.file_documents(files.select("path", "text"), files.select("path", F.array(F.lit("prose"), F.coalesce("lang", F.lit(""))).alias("type_path")))


_NTERMS = f"""WITH w AS (SELECT source AS niche, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM documents), c AS (SELECT niche, term, count(*) AS n FROM w GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY n DESC, term) AS r FROM c),
    z AS (SELECT niche, term, n, row_number() OVER (PARTITION BY niche ORDER BY n DESC, term) AS k FROM k WHERE r <= 24 AND length(term) > 2 AND term NOT IN ('src', 'lib', 'test', 'tests', 'file', 'modules', 'symbols', 'notes', 'churn_low', 'churn_mid', 'churn_high')) """


@query("niche_terms", _NTERMS + "SELECT niche, CAST(k AS INTEGER) AS k, term, n FROM z WHERE k <= 12")
def _(spark, d):
    return labels.niche_terms(page_files(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("niche"), "text"))


@query("niche_labels")
def _(spark, d):
    return labels.niche_labels(page_files(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("niche"), "text"))


@query(
    "relabelled_clades",
    """WITH m AS (SELECT p_brand AS clade, CASE WHEN p_size % 9 <> 0 THEN p_type END AS niche, p_size / 50 AS conf FROM part), w AS (SELECT clade, count(*) AS al, avg(conf) AS confidence FROM m GROUP BY 1),
    v AS (SELECT clade, niche, count(*) AS n, row_number() OVER (PARTITION BY clade ORDER BY count(*) DESC, niche) AS k FROM m WHERE niche IS NOT NULL GROUP BY 1, 2)
    SELECT w.clade, CASE WHEN coalesce(n / al, 0) >= 0.2 AND confidence >= 0.35 AND niche IS NOT NULL THEN 'niche ' || niche ELSE 'old ' || w.clade END AS label, niche, round(coalesce(n / al, 0), 6)::DOUBLE AS agreement, round(confidence, 6) AS confidence FROM w LEFT JOIN v ON v.clade = w.clade AND k = 1""",
)
def _(spark, d):
    p = table(spark, d, "part")
    m = p.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("clade"), F.when(F.col("p_size") % 9 != 0, F.col("p_type")).alias("niche"), (F.col("p_size") / 50).alias("confidence"))
    k = p.select(F.col("p_brand").alias("clade")).distinct().withColumn("label", F.concat(F.lit("old "), "clade"))
    names = p.select(F.col("p_type").alias("niche")).distinct().withColumn("label", F.concat(F.lit("niche "), "niche"))
    return rounded(labels.relabel(k, m, names, agreement=0.2), "agreement", "confidence")


@query(
    "clade_guidance",
    """WITH k AS (SELECT p_brand AS clade, CASE max(p_size) % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'utility' END AS layer, CASE WHEN min(p_partkey) % 2 = 0 THEN 'lib/' || p_brand END AS code_type FROM part GROUP BY 1),
    e AS (SELECT 'Brand#' || doc_id % 20 AS clade, count(*) AS n, bool_or(contains(lower(text), 'test') OR contains(lower(text), 'assert')) AS t, bool_or(contains(lower(text), 'readme') OR contains(lower(text), 'documentation')) AS o FROM documents GROUP BY 1),
    j AS (SELECT k.*, n, coalesce(t, false) AS t, CASE WHEN coalesce(t, false) THEN 'tests' WHEN coalesce(o, false) THEN 'docs' ELSE coalesce(layer, 'other') END AS ly FROM k LEFT JOIN e USING (clade))
    SELECT clade, ly || ':' || coalesce(code_type, clade) AS label, CASE WHEN t THEN 'verification belt — evidenced by test chunks' WHEN layer = 'core' THEN 'domain nucleus — protect boundaries' WHEN layer = 'utility' THEN 'shared substrate — watch overcrowding' ELSE 'evolutionary niche' END
      || CASE WHEN code_type IS NOT NULL THEN '; typed as ' || code_type ELSE '' END || CASE WHEN n > 0 THEN ' [rag:' || n || ' chunks]' ELSE '' END AS role, ly AS layer FROM j""",
)
def _(spark, d):
    b = F.col("p_brand")
    k = table(spark, d, "part").groupBy(b.alias("clade")).agg(F.max("p_size").alias("s"), F.min("p_partkey").alias("m"))
    k = k.select("clade", F.col("clade").alias("label"), F.when(F.col("s") % 3 == 0, "core").when(F.col("s") % 3 == 1, "utility").alias("layer"), F.when(F.col("m") % 2 == 0, F.concat(F.lit("lib/"), "clade")).alias("code_type"))
    e = table(spark, d, "documents").select(F.concat(F.lit("Brand#"), (F.col("doc_id") % 20).cast("string")).alias("clade"), "text")
    return labels.guidance(k, e)
