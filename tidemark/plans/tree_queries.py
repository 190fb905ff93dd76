"""Queries over a forest of commits (each order's parent is the nation's previous one for every tenth, else the customer's) and over clades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clusters, coupling, fences, trees
from tidemark.plans.core_queries import EDGES, C
from tidemark.plans.registry import query
from tidemark.plans.testmap import SQL_PARENTS, commit_files, commit_headers, commits, parents
from tidemark.plans.text_queries import _EMB


def commit_forest(spark, d) -> DataFrame:
    """(id, parent, subject) with the last of a commit's parents."""
    up = parents(spark, d).groupBy(F.col("sha").alias("id")).agg(F.max_by("parent", "pos").alias("parent"))
    return commit_headers(spark, d).select(F.col("sha").alias("id"), "subject").join(up, "id", "left").select("id", "parent", "subject")


_TREE = (
    "WITH RECURSIVE "
    + SQL_PARENTS
    + """, tree AS (SELECT sha AS id, coalesce(p1, p0) AS parent, subject FROM lags JOIN headers USING (sha)),
    kids AS (SELECT parent AS id, count(*) AS n, min(id) AS kid FROM tree WHERE parent IS NOT NULL GROUP BY 1),
    flags AS (SELECT t.id, t.parent, t.parent IS NOT NULL AND coalesce(kids.n, 0) = 1 AND coalesce(t.subject = u.subject AND t.subject = k.subject, false) AS hidden
              FROM tree t LEFT JOIN kids ON kids.id = t.id LEFT JOIN tree u ON u.id = t.parent LEFT JOIN tree k ON k.id = kids.kid)"""
)


@query(
    "tree_ranks",
    _TREE
    + """, w AS (SELECT id, id AS root, 0 AS generation, [id] AS line FROM tree WHERE parent IS NULL
           UNION ALL SELECT t.id, root, generation + 1, list_append(line, t.id) FROM w JOIN tree t ON t.parent = w.id),
    sizes AS (SELECT unnest(line) AS id, count(*) AS size FROM w GROUP BY 1),
    shown AS (SELECT w.id, row_number() OVER (PARTITION BY root ORDER BY line) - 1 AS rank FROM w JOIN flags USING (id) WHERE NOT hidden)
    SELECT w.id, root, CAST(generation AS BIGINT) AS generation, rank, size FROM w JOIN sizes USING (id) LEFT JOIN shown USING (id)""",
)
def _(spark, d):
    return trees.tree_ranks(trees.unary_hidden(commit_forest(spark, d), group="subject").drop("subject"))


@query(
    "visible_ancestors",
    _TREE
    + """, w AS (SELECT id, parent AS ancestor FROM flags UNION ALL SELECT w.id, f.parent FROM w JOIN flags f ON f.id = w.ancestor WHERE f.hidden)
    SELECT w.id, ancestor FROM w LEFT JOIN flags f ON f.id = w.ancestor WHERE ancestor IS NULL OR NOT f.hidden""",
)
def _(spark, d):
    return trees.visible_ancestors(trees.unary_hidden(commit_forest(spark, d), group="subject"))


@query("parsimony_states")
def _(spark, d):
    tree = commit_forest(spark, d)
    return trees.fitch(tree, tree.select("id", F.col("subject").alias("state")))


@query("parsimony_by_depth")
def _(spark, d):
    files = commit_files(spark, d).groupBy(F.col("sha").alias("id")).agg(F.min_by("path", "path").alias("path"))
    kind = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    return trees.fitch_by_depth(commit_forest(spark, d), files.select("id", kind.alias("type")))


@query("parsimony_flags")
def _(spark, d):
    """Commits whose type differs from their parent's, beside the type that parsimony gives each."""
    tree = commit_forest(spark, d)
    main = commit_files(spark, d).groupBy(F.col("sha").alias("id"), "layer").agg(F.sum("insertions").alias("w")).groupBy("id").agg(F.max(F.struct("w", "layer")).getField("layer").alias("state"))
    return trees.parsimony_flags(tree, main)


_FAM = "CASE WHEN starts_with({0}, 'type:') THEN regexp_extract({0}, '^type:([^|/]*)', 1) ELSE '' END"


@query(
    "clade_clusters",
    C
    + EDGES
    + """, p AS (SELECT path, CASE WHEN clade < 'Brand#15' THEN 'dir:' || clade ELSE 'type:' || layer || '/' || split_part(split_part(path, '/', 3), ' ', 1) END AS seed FROM (SELECT DISTINCT path, clade, layer FROM files)),
    k AS (SELECT path, count(*) AS touches FROM files GROUP BY 1),
    s AS (SELECT seed, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, seed) AS rank FROM p GROUP BY 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY path) AS k FROM p),
    r AS (SELECT seed AS id, seed || ' ' || string_agg(path, ' ' ORDER BY path) AS text FROM f WHERE k <= 20 GROUP BY seed)"""
    + _EMB
    + f""", u AS (SELECT id, idx, val / sqrt(sum(val * val) OVER (PARTITION BY id)) AS x FROM e),
    dots AS (SELECT a.id AS seed, b.id AS clade, sum(a.x * b.x) AS dot FROM u a JOIN u b USING (idx) WHERE b.id IN (SELECT seed FROM s WHERE rank <= 12) GROUP BY 1, 2),
    sc AS (SELECT o.seed, t.seed AS clade, t.rank, round(coalesce(dot, 0), 9) + CASE WHEN {_FAM.format("o.seed")} <> '' AND {_FAM.format("o.seed")} = {_FAM.format("t.seed")} THEN 0.15::DOUBLE ELSE 0 END AS score
           FROM s o JOIN s t ON o.rank > 12 AND t.rank <= 12 LEFT JOIN dots ON dots.seed = o.seed AND dots.clade = t.seed),
    seeds AS (SELECT seed, seed AS clade FROM s WHERE rank <= 12 UNION ALL SELECT seed, clade FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, rank) AS i FROM sc) WHERE i = 1),
    m AS (SELECT path, seed, clade FROM p JOIN seeds USING (seed)),
    n AS (SELECT a AS path, b AS other, weight FROM edges WHERE weight >= 2 UNION ALL SELECT b, a, weight FROM edges WHERE weight >= 2),
    v AS (SELECT n.path, o.clade AS vote, sum(weight) AS w FROM n JOIN m ON m.path = n.path JOIN m o ON o.path = n.other
          WHERE {_FAM.format("m.clade")} = '' OR {_FAM.format("o.clade")} = '' OR {_FAM.format("m.clade")} = {_FAM.format("o.clade")} GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY w DESC, vote) AS i FROM v),
    q AS (SELECT m.path, m.seed, CASE WHEN w >= 3 AND w > 0.05 * touches THEN vote ELSE m.clade END AS clade FROM m JOIN k ON k.path = m.path LEFT JOIN b ON b.path = m.path AND i = 1),
    br AS (SELECT *, CASE WHEN starts_with(seed, 'type:') THEN regexp_extract(seed, '^type:([^|/]*(/[^|/]*)?)', 1) ELSE 'unknown' END AS branch FROM q),
    g AS (SELECT clade, branch, count(*) AS n, sum(count(*)) OVER (PARTITION BY clade) AS a, row_number() OVER (PARTITION BY clade ORDER BY count(*) DESC, branch) AS i FROM br GROUP BY 1, 2),
    pe AS (SELECT *, row_number() OVER (ORDER BY clade, i) AS turn FROM g WHERE a >= 8 AND i > 1 AND n >= 3)
    SELECT path, CASE WHEN pe.turn IS NOT NULL THEN 'type:' || br.branch || '|split:' || substr(br.clade, 1, 24) ELSE br.clade END AS clade
    FROM br LEFT JOIN pe ON pe.clade = br.clade AND pe.branch = br.branch AND turn <= 12 - (SELECT count(DISTINCT clade) FROM q)""",
)
def _(spark, d):
    files = commit_files(spark, d)
    word = F.split(F.split("path", "/")[2], " ")[0]
    seed = F.when(F.col("clade") < "Brand#15", F.concat(F.lit("dir:"), "clade")).otherwise(F.concat(F.lit("type:"), "layer", F.lit("/"), word))
    paths = files.select("path", "clade", "layer").distinct().select("path", seed.alias("seed"))
    touches = files.groupBy("path").agg(F.count("*").alias("touches"))
    return clusters.clade_clusters(paths, coupling.cochange_edges(files, commits(spark, d)), touches, share=0.05)


@query(
    "fence_previews",
    C
    + EDGES
    + """, ed AS (SELECT DISTINCT sha AS edit, path FROM files WHERE sha % 20 = 0), fe AS (SELECT edit, min(path) AS path FROM ed GROUP BY 1),
    hot AS (SELECT path, count(*) AS t FROM files GROUP BY 1), ri AS (SELECT 'hot:' || path AS id, path AS at_, 'hotspot_blast' AS kind, t / (SELECT max(t) FROM hot) AS severity FROM hot WHERE t >= 0.75 * (SELECT max(t) FROM hot)
      UNION ALL SELECT 'clade:' || clade, clade, 'change_coupling', count(*) / (SELECT count(*) FROM files) * 30 FROM files GROUP BY clade),
    pa AS (SELECT DISTINCT path FROM ed), co AS (SELECT path, ri.* FROM pa JOIN ri ON at_ = path OR at_ = split_part(path, '/', 1)),
    bo AS (SELECT a AS path, b AS near, weight::DOUBLE AS w FROM edges WHERE weight >= 2 UNION ALL SELECT b, a, weight FROM edges WHERE weight >= 2 UNION ALL SELECT path, at_, severity FROM co),
    kn AS (SELECT path, near, max(w) AS w, row_number() OVER (PARTITION BY path ORDER BY max(w) DESC, near) AS k FROM bo WHERE path IN (FROM pa) AND path <> near GROUP BY 1, 2 QUALIFY k <= 12),
    dr AS (SELECT edit, near, max(w) AS w FROM ed JOIN kn USING (path) GROUP BY 1, 2), tot AS (SELECT edit, max(w) AS w, count(*) AS n FROM dr GROUP BY 1),
    gr AS (SELECT edit, max(severity) AS s, list_sort(list(DISTINCT id))[1:20] AS risk_ids FROM ed JOIN co USING (path) GROUP BY 1),
    ou AS (SELECT *, row_number() OVER (PARTITION BY edit ORDER BY w DESC, near) AS k FROM dr WHERE (edit, near) NOT IN (SELECT (edit, path) FROM ed) QUALIFY k <= 6),
    ad AS (SELECT edit, list(near ORDER BY k) AS added FROM ou GROUP BY 1)
    SELECT fe.edit, round(greatest(coalesce(w, 0), 3 * coalesce(s, 0)), 6)::DOUBLE AS blast, coalesce(n, 0) AS n_neighbors, array_to_string(coalesce(added, []), ',') AS added, array_to_string(list_concat([fe.path], coalesce(added, [])), ',') AS fence,
      array_to_string(coalesce(risk_ids, []), ',') AS risk_ids, greatest(coalesce(w, 0), 3 * coalesce(s, 0)) >= 8 AND coalesce(n, 0) >= 6 AS refuse
    FROM fe LEFT JOIN tot USING (edit) LEFT JOIN gr USING (edit) LEFT JOIN ad USING (edit)""",
)
def _(spark, d):
    """Every twentieth commit as an edit, fenced by its first file; hot files and clades are its risks."""
    files = commit_files(spark, d)
    edits = files.filter(F.col("sha") % 20 == 0).select(F.col("sha").alias("edit"), "path").distinct()
    hot = files.groupBy("path").agg(F.count("*").alias("t"))
    top = hot.agg(F.max("t").alias("m"))
    grave = hot.crossJoin(F.broadcast(top)).filter(F.col("t") >= 0.75 * F.col("m")).select(F.concat(F.lit("hot:"), "path").alias("id"), "path", F.lit("hotspot_blast").alias("kind"), (F.col("t") / F.col("m")).alias("severity"))
    every = files.agg(F.count("*").alias("m"))
    wide = files.groupBy("clade").agg(F.count("*").alias("t")).crossJoin(F.broadcast(every)).select(F.concat(F.lit("clade:"), "clade").alias("id"), F.col("clade").alias("path"), F.lit("change_coupling").alias("kind"), (F.col("t") / F.col("m") * 30).alias("severity"))
    out = fences.fence_previews(edits, coupling.cochange_edges(files, commits(spark, d)), edits.groupBy("edit").agg(F.min("path").alias("path")), grave.unionByName(wide))
    return out.withColumns({"blast": F.round("blast", 6), **{c: F.array_join(c, ",") for c in ("added", "fence", "risk_ids")}})
