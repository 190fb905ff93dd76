"""What an edit would draw in, and the small pack of graph nodes a decision is made on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.operators.graph import cut
from tidemark.operators.reports import attention_rank

#: Neighbors of a path that count, paths a fence is widened by, and the blast from which a wide edit is refused (fixed values).
NEIGHBORS, WIDEN, MOST_BLAST, SHOWN = 12, 6, 8.0, 20
#: Nodes of a pack, hits that are connected, pivots to propose at and nodes of each (fixed values).
PACK, CONNECTED, PROPOSED = 12, 8, 4
#: Risks that make their own path a neighbor of what lies below or above it (fixed values).
COUPLED_RISKS = ("hotspot_blast", "change_coupling")


def fence_previews(edits: DataFrame, edges: DataFrame, fence: DataFrame, risks: DataFrame, blast: DataFrame | None = None) -> DataFrame:
    """One row per edit (edit, path): blast, n_neighbors, added, fence, risk_ids, refuse.

    Neighbors come from co-changes (a, b, weight) on either side, from ``blast`` (path, neighbor, score) and from coupled risks (id, path, kind, severity) at
    other paths, the strongest of each, twelve to a path. The strongest not yet in the edit or its fence (edit, path) widen it, six at most. An edit's blast is
    its strongest neighbor or three times its gravest risk; it is refused at 8 or more with six neighbors or more. All edits at once.
    """
    edits = cut(edits.select("edit", "path").distinct(), "edits")
    both = edges.select(F.col("a").alias("path"), F.col("b").alias("near"), F.col("weight").cast("double").alias("w")).unionByName(edges.select(F.col("b").alias("path"), F.col("a").alias("near"), F.col("weight").cast("double").alias("w")))
    if blast is not None:
        both = both.unionByName(blast.select("path", F.col("neighbor").alias("near"), F.col("score").cast("double").alias("w")))
    # A risk concerns an edited path that is the same, above it or below it; those meet by the folders of either.
    above = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda i: F.array_join(F.slice(F.split(p, "/"), 1, i), "/"))
    graded = risks.filter("path IS NOT NULL AND path <> ''").select("id", F.col("path").alias("at"), "kind", F.coalesce("severity", F.lit(0.5)).cast("double").alias("severity"))
    paths = edits.select("path").distinct()
    below = paths.withColumn("at", F.explode(above(F.col("path")))).join(graded, "at")
    over = graded.withColumn("path", F.explode(above(F.col("at")))).filter("path <> at").join(paths, "path", "left_semi")
    concerned = cut(below.select("path", "at", "id", "kind", "severity").unionByName(over.select("path", "at", "id", "kind", "severity")), "concerned")
    both = both.unionByName(concerned.filter(F.col("kind").isin(*COUPLED_RISKS)).select("path", F.col("at").alias("near"), F.col("severity").alias("w")))
    known = both.join(paths, "path", "left_semi").filter("path <> near").groupBy("path", "near").agg(F.max("w").alias("w"))
    near = known.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("w"), "near"))).filter(F.col("_k") <= NEIGHBORS)
    drawn = cut(edits.join(near, "path").groupBy("edit", "near").agg(F.max("w").alias("w")), "drawn")
    totals = drawn.groupBy("edit").agg(F.max("w").alias("w"), F.count("*").alias("n"))
    grave = edits.join(concerned, "path").groupBy("edit").agg(F.max("severity").alias("s"), F.slice(F.array_sort(F.collect_set("id")), 1, SHOWN).alias("risk_ids"))
    inside = fence.select("edit", F.col("path").alias("near")).unionByName(edits.select("edit", F.col("path").alias("near")))
    outside = drawn.join(inside, ["edit", "near"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("edit").orderBy(F.desc("w"), "near"))).filter(F.col("k") <= WIDEN)
    added = outside.groupBy("edit").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "near"))), lambda x: x["near"]).alias("added"))
    own, held = (df.groupBy("edit").agg(F.array_sort(F.collect_set("path")).alias(name)) for df, name in ((edits, "paths"), (fence, "held")))
    rows = own.join(totals, "edit", "left").join(grave, "edit", "left").join(added, "edit", "left").join(held, "edit", "left")
    nothing = F.array().cast("array<string>")
    wide = F.concat(F.coalesce("held", nothing), F.coalesce("added", nothing))
    score = F.greatest(F.coalesce("w", F.lit(0.0)), 3 * F.coalesce("s", F.lit(0.0)))
    return rows.select(
        "edit", score.alias("blast"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_neighbors"), F.coalesce("added", nothing).alias("added"), F.when(F.size(wide) > 0, wide).otherwise(F.col("paths")).alias("fence"),
        F.coalesce("risk_ids", nothing).alias("risk_ids"), ((score >= MOST_BLAST) & (F.coalesce("n", F.lit(0)) >= WIDEN)).alias("refuse"),
    )


def attention_seeds(nodes: DataFrame, path: str | None = None, frames: list[str] | None = None, last: str | None = None) -> DataFrame:
    """(id, value): where attention starts: a path's nodes and cited frames at 1, the last decision at 1.2."""
    value = F.lit(None).cast("double")
    if path:
        value = F.coalesce(value, F.when((F.col("kind") == "path") & (F.contains("id", F.lit(path)) | (F.col("label") == path)), 1.0))
    if frames:
        value = F.coalesce(value, F.when(F.col("id").isin(*[f if f.startswith("frame:") else f"frame:{f}" for f in frames]), 1.0))
    if last:
        value = F.when(F.col("id") == last, 1.2).otherwise(value)
    return nodes.select("id", value.alias("value")).filter("value IS NOT NULL")


def coalition_pack(nodes: DataFrame, edges: DataFrame, hits: DataFrame | None = None, path: str | None = None, frames: list[str] | None = None, last: str | None = None, most: int = PACK) -> DataFrame:
    """(place, id, kind, family, source): at most twelve open nodes (id, kind, label, age_hours, valid_to) to decide on; none, if there is nothing to start from.

    Taken greedily: search hits (id, score), the path and what ranks high in attention, with the nodes that connect the first eight of these; then
    knowledge, by id; then pivots that propose, with four nodes each. Only lists of a dozen are ranked; the walks are those of ``graph``.
    """
    open_ = cut(graph.open_nodes(nodes), "open")
    links = cut(edges.join(open_.select(F.col("id").alias("source")), "source", "left_semi").join(open_.select(F.col("id").alias("target")), "target", "left_semi"), "links")
    cited = list(frames or [])
    wanted = []
    if hits is not None:
        found = hits.join(open_.select("id", "kind"), "id").orderBy(F.desc("score"), "id").limit(most)
        cited += [r["id"] for r in found.filter("kind = 'frame'").select("id").collect()]  # a dozen at most
        wanted.append(found.select("id", F.lit("hit").alias("source"), F.lit(0).alias("turn"), (-F.col("score")).alias("order")))
    seeds = attention_seeds(open_, path, cited, last)
    if path:
        wanted.append(open_.filter((F.col("kind") == "path") & ((F.col("label") == path) | (F.col("id") == path) | (F.col("id") == f"path:{path}"))).select("id", F.lit("path").alias("source"), F.lit(1).alias("turn"), F.lit(0.0).alias("order")))
    ranked = attention_rank(open_, links, seeds, limit=most)
    wanted.append(ranked.select("id", F.lit("attention").alias("source"), F.lit(2).alias("turn"), (-F.col("attention")).alias("order")))
    start = _in_turn(wanted, most)
    first = [r["id"] for r in start.orderBy("place").select("id").limit(CONNECTED).collect()]
    spark = nodes.sparkSession
    between = graph.shortest_paths(links, spark.createDataFrame([(i,) for i in first[:1]], "id string"), spark.createDataFrame([(i,) for i in first[1:]], "id string"), directed=False) if len(first) > 1 else None
    parts = [start.filter(F.col("place") <= CONNECTED).select("id", "source", F.lit(0).alias("turn"), F.col("place").cast("double").alias("order"))]
    if between is not None:
        joined = between.select(F.posexplode("path").alias("k", "id")).groupBy("id").agg(F.min("k").cast("double").alias("order"))
        parts.append(joined.select("id", F.lit("connection").alias("source"), F.lit(1).alias("turn"), "order"))
    known = open_.filter(graph.family_of(F.col("kind")) == "knowledge").orderBy("id").limit(most)
    parts.append(known.select("id", F.lit("knowledge").alias("source"), F.lit(2).alias("turn"), F.lit(0.0).alias("order")))
    pivots = open_.filter((F.col("kind") == "pivot") & (F.col("label") == "propose")).orderBy("id").limit(PROPOSED).select("id")
    around = links.join(pivots.withColumnRenamed("id", "target"), "target").filter(F.col("rel").isin("joins", "pivots")).select(F.col("target").alias("pivot"), F.col("source").alias("id"))
    around = around.withColumn("_k", F.row_number().over(Window.partitionBy("pivot").orderBy("id"))).filter(F.col("_k") <= PROPOSED).select("id")
    parts.append(pivots.unionByName(around).select("id", F.lit("propose").alias("source"), F.lit(3).alias("turn"), F.lit(0.0).alias("order")))
    return _in_turn(parts, most).join(open_.select("id", "kind"), "id").select("place", "id", "kind", graph.family_of(F.col("kind")).alias("family"), "source")


def _in_turn(parts: list[DataFrame], most: int) -> DataFrame:
    """(place, id, source) of the first ``most`` distinct ids of lists (id, source, turn, order), each at its first place."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("id").agg(F.min(F.struct("turn", "order", "source")).alias("s"))
    first = once.orderBy("s.turn", "s.order", "id").limit(most)
    return cut(first.select(F.row_number().over(Window.orderBy("s.turn", "s.order", "id")).alias("place"), "id", "s.source"), "pack")


def pack_summary(pack: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n, frames, decisions, falsifiers, allowed_because and overridden ids of a pack, and its stance."""
    own = pack.select("id")
    other = lambda rel: edges.filter(F.col("rel") == rel).join(own.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("x")).unionByName(edges.filter(F.col("rel") == rel).join(own.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("x")))
    ids = lambda df, name, k: df.agg(F.slice(F.array_sort(F.collect_set("x")), 1, k).alias(name))
    kinds = pack.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("kind") == "frame", F.col("id")))).alias("frames"), F.array_sort(F.collect_set(F.when(F.col("kind") == "decision", F.col("id")))).alias("decisions"))
    against = nodes.join(own, "id", "left_semi").filter("kind = 'record' AND lower(label) LIKE '%falsifier%'").select(F.coalesce("text", "id").alias("x"))
    for name, rows, k in (("allowed_because", other("allowed_because"), 8), ("overridden", other("overridden"), 8), ("falsifiers", against, 6)):
        kinds = kinds.crossJoin(F.broadcast(ids(rows, name, k)))  # single rows
    return kinds.withColumn("stance", F.when(F.col("n") > 0, "support").otherwise("insufficient"))
