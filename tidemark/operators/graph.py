"""A typed context graph as two tables, nodes(id, kind, label, text, seq) and edges(source, target, rel), and walks over it.

Walks are rounds of joins with a visited set; each round's rows are written to the shared folder, which cuts the plan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of node and relations by family (fixed values).
FAMILY_KINDS = {
    "taxon": ("commit", "type", "clade", "niche", "path"),
    "context": ("context", "window", "focus", "fence", "blast", "delta"),
    "knowledge": ("frame", "record", "policy", "authority", "claim"),
    "decision": ("decision", "proposal", "score", "reflection"),
    "pivot": ("pivot",),
    "flow": ("run", "round", "kernel", "subagent", "tool", "rag", "morpheme", "memory", "patch", "test"),
}
FAMILY_RELS = {
    "taxon": ("parent_of", "typed_as", "in_clade", "in_niche", "contains", "touches", "gene_flow"),
    "context": ("focuses", "in_window", "fenced_by", "blast_of"),
    "knowledge": ("cites", "allowed_by", "constrained_by", "falsified_by"),
    "decision": ("allowed_because", "overridden", "refused", "precedes", "scored", "proposed"),
    "pivot": ("pivots", "joins", "next_pivot"),
    "flow": ("next", "spawned", "invoked", "proposed", "scored", "retrieved", "reflects", "focuses", "next_pivot", "pivots"),
}
FLOW_STAGES = ("sense", "deliberate", "act", "verify")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one machine may use a temporary folder; a cluster may not."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's setting that removes a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Rows written to the folder all executors share (spark.checkpoint.dir) and read again.

    The shuffles that made them are removed at once, so those of one step at a time take disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/walk-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def family_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for fam, kinds in FAMILY_KINDS.items() for k in kinds for x in (k, fam)])
    return F.coalesce(table[kind], F.lit("context"))


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes merged by id (first label and kind by seq, longest text), edges distinct, both ends known."""
    first = lambda c: F.min(F.struct("seq", c)).getField(c)
    merged = nodes.groupBy("id").agg(first("kind").alias("kind"), first("label").alias("label"), F.max(F.struct(F.length("text").alias("n"), "text")).getField("text").alias("text"))
    known = merged.select("id")
    kept = edges.select("source", "target", "rel").distinct()
    kept = kept.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return merged, kept.select("source", "target", "rel")


def kinds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind", family_of(F.col("kind")).alias("family")).agg(F.count("*").alias("n"))


def family_slice(nodes: DataFrame, edges: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    own = nodes.filter(family_of(F.col("kind")) == family)
    ids = own.select("id")
    rels = edges.filter(F.col("rel").isin(*FAMILY_RELS[family]))
    return own, rels.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "rel")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in edges.columns if c not in ("source", "target")]))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(id, hops) within ``depth`` steps of the seeds (id): breadth first, each node at its least distance."""
    step = (edges if directed else undirected(edges)).select("source", "target").distinct()
    seen = cut(seeds.select("id").distinct().withColumn("hops", F.lit(0)), "seeds")
    frontier = seen
    for hop in range(1, depth + 1):
        new = frontier.join(step, frontier["id"] == step["source"]).select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, rels: list[str] | None = None, kinds: list[str] | None = None, family: str | None = None, directed: bool = False) -> DataFrame:
    """(id, hops, parent, via) of the nodes within ``depth`` steps of the seeds (id), and how each was come to first; of several ways the least parent, then relation.

    Walks over some relations only and through nodes of some kinds or one family only; seeds need not be of them.
    """
    links = edges if rels is None else edges.filter(F.col("rel").isin(*rels))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "rel")
    step = links.select("source", "target", "rel") if directed else links.select("source", "target", "rel").unionByName(back)
    allowed = nodes.filter(F.col("kind").isin(*kinds)) if kinds is not None else nodes
    allowed = allowed.filter(family_of(F.col("kind")) == family) if family else allowed
    step = cut(step.distinct().join(allowed.select(F.col("id").alias("target")), "target", "left_semi"), "steps")
    none = F.lit(None).cast("string")
    seen = cut(seeds.select("id").distinct().join(nodes.select("id"), "id", "left_semi").select("id", F.lit(0).alias("hops"), none.alias("parent"), none.alias("via")), "expand")
    frontier = seen
    for hop in range(1, depth + 1):
        ways = frontier.select(F.col("id").alias("source")).join(step, "source").groupBy(F.col("target").alias("id")).agg(F.min(F.struct(F.col("source").alias("parent"), F.col("rel").alias("via"))).alias("w"))
        frontier = cut(ways.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"), "w.parent", "w.via"), "expand")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) among some ids (id) alone."""
    own = ids.select("id").distinct()
    kept = edges.join(own.withColumnRenamed("id", "source"), "source", "left_semi").join(own.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(own, "id", "left_semi"), kept.select("source", "target", "rel")


def search_near(nodes: DataFrame, edges: DataFrame, tokens: list[str], depth: int = 2, first: int = 16) -> DataFrame:
    """(id, score): nodes that hold query words, and those near the best of these, each by the greater of its own score and what a wave from the hits lends it."""
    hits = search(nodes, tokens).select("id", "score")
    best = cut(hits.orderBy(F.desc("score"), "id").limit(first), "hits")
    wave = wavefront(edges, best.select("id"), hits.select("id", F.col("score").alias("own")), depth)
    both = hits.unionByName(wave.join(nodes.select("id"), "id", "left_semi").select("id", "score"))
    return both.groupBy("id").agg(F.max("score").alias("score"))


def ancestors(edges: DataFrame, starts: DataFrame, rel: str = "parent_of", depth: int = 64) -> DataFrame:
    """(id, hops) of what leads to the starts over one relation; cycles end where they meet what was seen."""
    back = edges.filter(F.col("rel") == rel).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return reach(back, starts, depth)


def descendants(edges: DataFrame, starts: DataFrame, rel: str = "parent_of", depth: int = 64) -> DataFrame:
    return reach(edges.filter(F.col("rel") == rel), starts, depth)


def generations(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root, generation) along first parents (id, parent), by pointer jumping: rounds grow with the log of the depth.

    What lies on a cycle or leads into one has no root and no generation: it still moves after as many rounds as would
    have taken any chain of that many nodes to its end.
    """
    left = max(1, nodes.count()).bit_length() + 1
    up = cut(nodes.select("id").join(parents.select("id", "parent"), "id", "left").select("id", F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("generation")), "jump")
    while True:
        top = up.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("generation").alias("more"))
        jumped = cut(up.join(top, "root").select("id", F.col("next").alias("root"), (F.col("generation") + F.col("more")).alias("generation"), (F.col("more") > 0).alias("moved")), "jump")
        left -= 1
        if not left or jumped.filter("moved").isEmpty():
            ends = lambda c: F.when(~F.col("moved"), F.col(c)).alias(c)
            return jumped.select("id", ends("root"), ends("generation"))
        up = jumped.drop("moved")


def least_generations(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, generation): least number of steps from a root over all parents (id, parent); none for what no root leads to.

    Breadth-first from the roots, so there are as many rounds as generations.
    """
    roots = nodes.select("id").join(parents.select("id"), "id", "left_anti")
    return nodes.select("id").join(reach(parents.select(F.col("parent").alias("source"), F.col("id").alias("target")), roots, 1 << 30).withColumnRenamed("hops", "generation"), "id", "left")


def shortest_paths(edges: DataFrame, source: DataFrame, targets: DataFrame, depth: int = 6, directed: bool = True) -> DataFrame:
    """(id, path): a shortest path from a source (id) to each target (id); of several the least in order."""
    step = (edges if directed else undirected(edges)).select("source", "target").distinct()
    seen = cut(source.select("id", F.array("id").alias("path")), "path")
    frontier = seen
    for _ in range(depth):
        new = frontier.join(step, frontier["id"] == step["source"]).select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
        frontier = cut(new.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti"), "path")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(targets.select("id"), "id", "left_semi")


def meeting_paths(edges: DataFrame, left: DataFrame, right: DataFrame, depth: int = 3) -> DataFrame:
    """(id, hops): nodes where walks from both sides meet, by the sum of both distances."""
    a, b = reach(edges, left, depth), reach(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), right, depth)
    return a.join(b.withColumnRenamed("hops", "other"), "id").select("id", (F.col("hops") + F.col("other")).alias("hops"))


def joined_paths(edges: DataFrame, source: DataFrame, targets: DataFrame, depth: int = 6) -> DataFrame:
    """Distinct nodes on the shortest paths to the targets."""
    return shortest_paths(edges, source, targets, depth).select(F.explode("path").alias("id")).distinct()


def wavefront(edges: DataFrame, seeds: DataFrame, scores: DataFrame, depth: int = 3) -> DataFrame:
    """(id, score): a node's own score (id, own) and .4 / (1 + hops) for its nearness to the seeds."""
    return reach(edges, seeds, depth, directed=False).join(scores, "id", "left").select("id", (F.coalesce("own", F.lit(0.0)) + 0.4 / (1 + F.col("hops"))).alias("score"))


def spreading(edges: DataFrame, seeds: DataFrame, rounds: int = 4, decay: float = 0.5) -> DataFrame:
    """(id, value): each round a node keeps 1 - decay of its value and shares the rest evenly with its neighbors."""
    step = undirected(edges).select("source", "target").distinct()
    degree = step.groupBy("source").agg(F.count("*").alias("deg"))
    links = cut(step.join(degree, "source"), "links")
    value = seeds.select("id", F.col("value").cast("double").alias("value"))
    for _ in range(rounds):
        given = value.join(links, value["id"] == links["source"]).select(F.col("target").alias("id"), (F.lit(decay) * F.col("value") / F.col("deg")).alias("value"))
        kept = value.select("id", (F.lit(1 - decay) * F.col("value")).alias("value"))
        value = cut(kept.unionByName(given).groupBy("id").agg(F.sum("value").alias("value")), "spread")
    return value


def search(nodes: DataFrame, tokens: list[str], flow_kinds: tuple[str, ...] = ("decision", "round", "pivot")) -> DataFrame:
    """(id, score): share of query words found in a node's text, a little for flow kinds and for words in its label or kind."""
    blob = F.lower(F.concat_ws(" ", "id", "kind", "label", "text"))
    share = sum((F.contains(blob, F.lit(t)).cast("double") for t in tokens), F.lit(0.0)) / max(1, len(tokens))
    named = sum((F.contains(F.lower(F.concat_ws(" ", "label", "kind")), F.lit(t)).cast("int") for t in tokens), F.lit(0)) > 0
    score = share + F.when(F.col("kind").isin(*flow_kinds), 0.08).otherwise(0.0) + F.when(named, 0.2).otherwise(0.0)
    return nodes.select("id", "kind", F.when(share > 0, score).otherwise(0.0).alias("score")).filter("score > 0")


def precedents(nodes: DataFrame, edges: DataFrame, tokens: list[str], limit: int | None = None) -> DataFrame:
    """(id, score): decision-like nodes by the greater of word overlap and what spreads to them from the matches."""
    hits = search(nodes.filter(F.col("kind").isin("decision", "reflection", "pivot", "round")), tokens)
    heat = spreading(edges, hits.select("id", F.col("score").alias("value")), 3, 0.45)
    own = nodes.filter(F.col("kind").isin("decision", "reflection", "pivot", "round")).select("id")
    out = own.join(hits.select("id", "score"), "id", "left").join(heat, "id", "left").select("id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("value", F.lit(0.0))).alias("score")).filter("score > 0")
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def flow_walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """(id, stage, seq) of flow nodes reached, with the rank of their stage."""
    rels = edges.filter(F.col("rel").isin(*FAMILY_RELS["flow"]))
    got = reach(rels, seeds, depth, directed=False).join(nodes, "id").filter(family_of(F.col("kind")).isin("flow", "decision", "pivot"))
    stage = F.when(F.col("kind").isin("rag", "memory", "morpheme"), 0).when(F.col("kind").isin("decision", "proposal", "kernel", "pivot"), 1).when(F.col("kind").isin("patch", "tool", "round", "run", "subagent"), 2).otherwise(3)
    return got.select("id", stage.alias("stage"), "hops")


def close_windows(nodes: DataFrame) -> DataFrame:
    """(id, key, valid_from, valid_to): each node is valid until the next of the same key begins."""
    return nodes.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from", "id")))


def open_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose window hasn't ended (valid_to null or empty)."""
    return nodes.filter(F.col("valid_to").isNull() | (F.col("valid_to").cast("string") == ""))


def observed_length(tree: DataFrame, states: DataFrame) -> DataFrame:
    """One row: edges of a coded tree whose ends differ."""
    up = states.select(F.col("id").alias("parent"), F.col("state").alias("above"))
    return tree.filter("parent is not null").join(states, "id").join(up, "parent").agg(F.count_if(F.col("state") != F.col("above")).alias("steps"), F.count("*").alias("edges"))


def consistency(states: DataFrame, steps: Column) -> DataFrame:
    """One row: m, g, consistency and retention index of leaf states for a number of steps."""
    counts = states.groupBy("state").agg(F.count("*").alias("n"))
    one = counts.agg((F.count("*") - 1).alias("m"), (F.sum("n") - F.max("n")).alias("g"))
    s = steps.cast("double")
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return one.select("m", "g", clamp(F.when(s > 0, F.col("m") / s).otherwise(1.0)).alias("ci"), clamp(F.when(F.col("g") > F.col("m"), (F.col("g") - s) / (F.col("g") - F.col("m"))).otherwise(1.0)).alias("ri"))


def newick(tree: DataFrame) -> DataFrame:
    """(id, text): each root's tree in Newick form, from the deepest level upwards; a round handles one level's rows alone."""
    from tidemark.functions.text import newick_name

    depth = generations(tree.filter("parent is not null"), tree.select("id")).select("id", F.col("generation").alias("depth"))
    levels = cut(tree.join(depth, "id").withColumn("name", newick_name(F.col("id").cast("string"))), "newick")
    top = int(levels.agg(F.max("depth")).first()[0] or 0)
    texts = levels.filter(F.col("depth") == top).withColumn("text", F.col("name"))
    for level in range(top, 0, -1):
        inner = cut(texts.groupBy("parent").agg(F.concat_ws(",", F.array_sort(F.collect_list("text"))).alias("kids")).withColumnRenamed("parent", "id"), "newick")
        above = levels.filter(F.col("depth") == level - 1).join(inner, "id", "left")
        texts = above.withColumn("text", F.when(F.col("kids").isNull(), F.col("name")).otherwise(F.concat(F.lit("("), "kids", F.lit(")"), "name")))
    return texts.select("id", F.concat("text", F.lit(";")).alias("text"))
