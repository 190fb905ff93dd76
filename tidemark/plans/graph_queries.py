"""Queries over a graph of nations, customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.plans.registry import query
from tidemark.plans.testmap import SQL_PARENTS, parents, table


def context(spark, d):
    """nodes(id, kind, label, text, seq), edges(source, target, rel): customers belong to nations, place orders, which touch parts."""
    nation, customer, orders, lines, part = (table(spark, d, t) for t in ("nation", "customer", "orders", "lineitem", "part"))
    node = lambda df, prefix, key, kind, label: df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"), F.col(label).cast("string").alias("text"), F.col(key).cast("bigint").alias("seq"))
    nodes = node(nation, "n", "n_nationkey", "clade", "n_name").unionByName(node(customer, "c", "c_custkey", "context", "c_mktsegment")).unionByName(node(orders, "o", "o_orderkey", "commit", "o_orderpriority")).unionByName(node(part, "p", "p_partkey", "path", "p_name"))
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = (
        customer.select(key("n", "c_nationkey").alias("source"), key("c", "c_custkey").alias("target"), F.lit("contains").alias("rel"))
        .unionByName(orders.select(key("c", "o_custkey").alias("source"), key("o", "o_orderkey").alias("target"), F.lit("focuses").alias("rel")))
        .unionByName(lines.select(key("o", "l_orderkey").alias("source"), key("p", "l_partkey").alias("target"), F.lit("touches").alias("rel")))
    )
    return nodes, edges


G = """WITH RECURSIVE nodes AS (SELECT 'n' || n_nationkey AS id, 'clade' AS kind, n_name AS label FROM nation UNION ALL SELECT 'c' || c_custkey, 'context', c_mktsegment FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'commit', o_orderpriority FROM orders UNION ALL SELECT 'p' || p_partkey, 'path', p_name FROM part),
edges AS (SELECT 'n' || c_nationkey AS source, 'c' || c_custkey AS target, 'contains' AS rel FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey, 'focuses' FROM orders
  UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, 'touches' FROM lineitem)"""


@query("graph_edges", G + " SELECT rel, count(*) AS n FROM edges GROUP BY 1")
def _(spark, d):
    _nodes, edges = graph.build(*context(spark, d))
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


@query("graph_kinds", G + " SELECT kind, CASE kind WHEN 'context' THEN 'context' ELSE 'taxon' END AS family, count(*) AS n FROM nodes GROUP BY 1, 2")
def _(spark, d):
    return graph.kinds(graph.build(*context(spark, d))[0])


@query("family_slice", G + " SELECT source, target, rel FROM edges WHERE rel = 'touches'")
def _(spark, d):
    return graph.family_slice(*context(spark, d), "taxon")[1].distinct()


@query("graph_khop", G + ", w AS (SELECT 'n3' AS id, 0 AS hops UNION SELECT target, hops + 1 FROM w JOIN edges ON source = id WHERE hops < 3) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1")
def _(spark, d):
    _n, edges = context(spark, d)
    return graph.reach(edges, spark.createDataFrame([("n3",)], "id string"), 3)


@query(
    "graph_shortest_path",
    G
    + """, w AS (SELECT 'n3' AS id, ['n3'] AS path UNION ALL SELECT target, list_append(path, target) FROM w JOIN edges ON source = id WHERE len(path) <= 3),
    b AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY len(path), path) AS k FROM w WHERE id LIKE 'p%') SELECT id, array_to_string(path, '>') AS path FROM b WHERE k = 1""",
)
def _(spark, d):
    nodes, edges = context(spark, d)
    out = graph.shortest_paths(edges, spark.createDataFrame([("n3",)], "id string"), nodes.filter("kind = 'path'"), depth=3)
    return out.select("id", F.array_join("path", ">").alias("path"))


_P = "WITH RECURSIVE " + SQL_PARENTS


@query("ancestors", _P + ", top AS (SELECT max(sha) AS s FROM headers), w AS (SELECT s AS id, 0 AS hops FROM top UNION SELECT parent, hops + 1 FROM w JOIN parents ON sha = id WHERE hops < 6) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1")
def _(spark, d):
    p = parents(spark, d)
    edges = p.select(F.col("parent").alias("source"), F.col("sha").alias("target"), F.lit("parent_of").alias("rel"))
    return graph.ancestors(edges, table(spark, d, "orders").agg(F.max("o_orderkey").alias("id")), depth=6)


@query("generation", _P + ", w AS (SELECT sha AS id, sha AS root, 0 AS generation FROM headers WHERE sha NOT IN (SELECT sha FROM parents WHERE pos = 0) UNION ALL SELECT sha, root, generation + 1 FROM w JOIN parents ON parent = id AND pos = 0) SELECT id, root, CAST(generation AS BIGINT) AS generation FROM w")
def _(spark, d):
    first = parents(spark, d).filter("pos = 0").select(F.col("sha").alias("id"), "parent")
    return graph.generations(first, table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


@query("merge_commits", _P + " SELECT count(*) AS merges, (SELECT count(*) FROM headers) AS commits FROM parents WHERE pos = 1")
def _(spark, d):
    return parents(spark, d).agg(F.count_if(F.col("pos") == 1).alias("merges")).crossJoin(table(spark, d, "orders").agg(F.count("*").alias("commits")))


@query("observed_tree_length", _P + " SELECT count(*) FILTER (a.subject <> b.subject) AS steps, count(*) AS edges FROM parents p JOIN headers a ON a.sha = p.sha JOIN headers b ON b.sha = p.parent WHERE pos = 0")
def _(spark, d):
    orders = table(spark, d, "orders")
    first = parents(spark, d).filter("pos = 0").select("sha", "parent")
    tree = orders.select(F.col("o_orderkey").alias("id")).join(first.withColumnRenamed("sha", "id"), "id", "left")
    return graph.observed_length(tree, orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("state")))


def _spread_sql(rounds):
    out, last = G + ", und AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), links AS (SELECT source, target, count(*) OVER (PARTITION BY source) AS deg FROM und), v0 AS (SELECT 'n3' AS id, 1.0::DOUBLE AS value)", "v0"
    for i in range(1, rounds + 1):
        out += f", v{i} AS (SELECT id, sum(value) AS value FROM (SELECT id, 0.5 * value AS value FROM {last} UNION ALL SELECT target, 0.5 * value / deg FROM {last} JOIN links ON source = id) GROUP BY 1)"
        last = f"v{i}"
    return out + f" SELECT id, round(value, 9) AS value FROM {last}"


@query("spreading_rank", _spread_sql(4))
def _(spark, d):
    _n, edges = context(spark, d)
    return graph.spreading(edges, spark.createDataFrame([("n3", 1.0)], "id string, value double")).withColumn("value", F.round("value", 9))


@query("graph_search", G + " SELECT id, kind, CASE WHEN contains(lower(concat_ws(' ', id, kind, label)), 'cold') THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN contains(lower(concat_ws(' ', id, kind, label)), 'widget') THEN 0.5 ELSE 0 END::DOUBLE + 0.2::DOUBLE AS score FROM nodes WHERE contains(lower(label), 'cold') OR contains(lower(label), 'widget')")
def _(spark, d):
    return graph.search(context(spark, d)[0], ["cold", "widget"]).withColumn("score", F.round("score", 6))


@query("meeting_paths", G + """, a AS (SELECT 'n3' AS id, 0 AS hops UNION SELECT target, hops + 1 FROM a JOIN edges ON source = id WHERE hops < 2), b AS (SELECT 'p7' AS id, 0 AS hops UNION SELECT source, hops + 1 FROM b JOIN edges ON target = id WHERE hops < 2)
  SELECT id, CAST(x.h + y.h AS INTEGER) AS hops FROM (SELECT id, min(hops) AS h FROM a GROUP BY 1) x JOIN (SELECT id, min(hops) AS h FROM b GROUP BY 1) y USING (id)""")
def _(spark, d):
    edges = context(spark, d)[1]
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    return graph.meeting_paths(edges, one("n3"), one("p7"), 2)


@query("wavefront", G + """, w AS (SELECT 'c5' AS id, 0 AS hops UNION SELECT e.target, hops + 1 FROM w JOIN (SELECT source, target FROM edges UNION SELECT target, source FROM edges) e ON e.source = id WHERE hops < 2)
  SELECT id, round(0.4 / (1 + min(hops)), 6)::DOUBLE AS score FROM w GROUP BY 1""")
def _(spark, d):
    nodes, edges = context(spark, d)
    return graph.wavefront(edges, spark.createDataFrame([("c5",)], "id string"), nodes.limit(0).select("id", F.lit(0.0).alias("own")), 2).withColumn("score", F.round("score", 6))


@query("validity_windows", "SELECT o_orderkey AS id, o_custkey AS key, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS valid_to FROM orders")
def _(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("valid_from"))
    return graph.close_windows(nodes).select("id", "key", F.date_format(F.col("valid_to").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("valid_to"))


@query(
    "graph_expand",
    G
    + """, both_ AS (SELECT source, target, rel FROM edges UNION SELECT target, source, rel FROM edges), ok AS (SELECT b.* FROM both_ b JOIN nodes n ON n.id = target WHERE kind IN ('context', 'commit')),
    w AS (SELECT 'n3' AS id, 0 AS hops UNION SELECT target, hops + 1 FROM w JOIN ok ON source = id WHERE hops < 3), h AS (SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1),
    p AS (SELECT h.id, h.hops, ok.source AS parent, ok.rel AS via, row_number() OVER (PARTITION BY h.id ORDER BY ok.source, ok.rel) AS k FROM h JOIN ok ON ok.target = h.id JOIN h u ON u.id = ok.source AND u.hops = h.hops - 1)
    SELECT id, hops, parent, via FROM p WHERE k = 1 UNION ALL SELECT 'n3', 0, NULL, NULL""",
)
def _(spark, d):
    """What lies around a nation through customers and orders alone, and by which way."""
    nodes, edges = context(spark, d)
    return graph.expand(nodes, edges, spark.createDataFrame([("n3",)], "id string"), 3, kinds=["context", "commit"])


@query(
    "graph_search_near",
    G
    + """, se AS (SELECT id, CASE WHEN contains(b, 'cold') THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN contains(b, 'widget') THEN 0.5 ELSE 0 END::DOUBLE + 0.2::DOUBLE AS score FROM (SELECT id, lower(concat_ws(' ', id, kind, label)) AS b FROM nodes) WHERE contains(b, 'cold') OR contains(b, 'widget')),
    be AS (SELECT id FROM se ORDER BY score DESC, id LIMIT 16), und AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
    w AS (SELECT id, 0 AS hops FROM be UNION SELECT und.target, hops + 1 FROM w JOIN und ON und.source = w.id WHERE hops < 2), wv AS (SELECT w.id, 0.4::DOUBLE / (1 + min(hops)) + coalesce(max(se.score), 0) AS score FROM w LEFT JOIN se ON se.id = w.id GROUP BY 1)
    SELECT id, round(max(score), 6) AS score FROM (FROM se UNION ALL FROM wv) GROUP BY 1""",
)
def _(spark, d):
    nodes, edges = context(spark, d)
    return graph.search_near(nodes, edges, ["cold", "widget"]).withColumn("score", F.round("score", 6))
