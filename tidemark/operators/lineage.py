"""Files through renames, parents by hash or prefix, lifecycle events, divisions of commits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import cut


def final_names(renames: DataFrame) -> DataFrame:
    """(path, name): where each renamed path ends, by pointer jumping; a cycle ends after as many rounds as halve it away."""
    step = cut(renames.groupBy(F.col("old").alias("path")).agg(F.max("new").alias("name")), "rename")
    for _ in range(40):
        nxt = step.select(F.col("path").alias("name"), F.col("name").alias("further"))
        jumped = cut(step.join(nxt, "name", "left").select("path", F.coalesce("further", "name").alias("name"), F.col("further").isNotNull().alias("moved")), "rename")
        if jumped.filter("moved").isEmpty():
            return jumped.drop("moved")
        step = jumped.drop("moved")
    return step


def lineages(files: DataFrame, commits: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, touches, first, last, prior): every file under its final name, with its first and last commit and former names."""
    names = final_names(renames)
    rows = files.select("sha", "path").join(commits.select("sha", "ts"), "sha").join(names, "path", "left").withColumn("name", F.coalesce("name", "path"))
    return rows.groupBy("name").agg(
        F.count("*").alias("touches"), F.min(F.struct("ts", "sha")).getField("sha").alias("first"), F.max(F.struct("ts", "sha")).getField("sha").alias("last"),
        F.array_sort(F.collect_set(F.when(F.col("path") != F.col("name"), F.col("path")))).alias("prior"),
    )


def resolve_parents(links: DataFrame, commits: DataFrame) -> DataFrame:
    """(sha, parent) of links (sha, named): the commit of that hash, else the least one of that seven-letter prefix."""
    full = commits.select(F.col("sha").alias("named"), F.col("sha").alias("_full"))
    short = commits.groupBy(F.substring("sha", 1, 7).alias("_p")).agg(F.min("sha").alias("_short"))
    out = links.join(full, "named", "left").withColumn("_p", F.substring("named", 1, 7)).join(short, "_p", "left")
    return out.select("sha", F.coalesce("_full", "_short").alias("parent"))


def snapshot_similarity(files: DataFrame) -> DataFrame:
    """(path, similarity) of files at two snapshots (path, snap 0 or 1, items): Jaccard of the same path's items."""
    pair = files.groupBy("path").agg(F.max(F.when(F.col("snap") == 0, F.col("items"))).alias("a"), F.max(F.when(F.col("snap") == 1, F.col("items"))).alias("b"))
    return pair.filter("a is not null and b is not null").select("path", (F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size(F.array_union("a", "b")))).alias("similarity"))


def divisions(files: DataFrame, types: DataFrame) -> DataFrame:
    """(sha, division): the type most of a commit's lines are in; a file's own type comes before its clade's."""
    rows = files.join(types, "path", "left").select("sha", F.coalesce("type", "clade").alias("division"), F.greatest(F.lit(1), F.col("insertions") + F.col("deletions")).alias("w"))
    sums = rows.groupBy("sha", "division").agg(F.sum("w").alias("w"))
    return sums.groupBy("sha").agg(F.min(F.struct((-F.col("w")).alias("m"), "division")).getField("division").alias("division"))


def lifecycle(*sources: DataFrame) -> DataFrame:
    """Events of all kinds in order: tags, storms, advisories, the first commit."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def pioneer(commits: DataFrame) -> DataFrame:
    return commits.agg(F.min("ts").alias("at")).select(F.lit("pioneer").alias("kind"), F.lit("first commit").alias("label"), "at", F.lit("pioneer").alias("stage"), F.lit(0.7).alias("confidence"))


def commit_scores(commits: DataFrame, risk: DataFrame, debt: DataFrame) -> DataFrame:
    """(sha, score): .45 risk + .35 debt + .2 churn over the most; risk and debt by clade of the commit (sha, clade, churn)."""
    top = commits.agg(F.greatest(F.lit(1), F.max("churn")).alias("_top"))
    j = commits.join(risk, "clade", "left").join(debt, "clade", "left").crossJoin(F.broadcast(top))
    return j.select("sha", (0.45 * F.coalesce("risk", F.lit(0.0)) + 0.35 * F.coalesce("debt", F.lit(0.0)) + 0.2 * F.col("churn") / F.col("_top")).alias("score"))


def pair_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(a, b, before, after): weights of pairs in two histories."""
    return before.select("a", "b", F.col("weight").alias("before")).join(after.select("a", "b", F.col("weight").alias("after")), ["a", "b"], "full").fillna(0, ["before", "after"])


def collapse_chains(tree: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, hidden): nodes with one child of their own kind and that child's only parent, which a drawing leaves out."""
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("n"), F.min("id").alias("kid"))
    own = tree.join(kinds, "id").join(kids, F.col("id") == F.col("_p"), "left").drop("_p")
    kid = kinds.select(F.col("id").alias("kid"), F.col("kind").alias("kid_kind"))
    hidden = (F.col("n") == 1) & (F.col("kind") == F.col("kid_kind")) & F.col("parent").isNotNull()
    return own.join(kid, "kid", "left").select("id", F.coalesce(hidden, F.lit(False)).alias("hidden"))


def upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """A vector table with new rows (id, at, ...): of one id the latest stays."""
    every = store.unionByName(rows)
    return every.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))).filter("_k = 1").drop("_k")
