"""Clades of files from seeds: the largest seeds stand, the others join the nearest, neighbors re-vote, mixed clades split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import cut
from tidemark.operators.texts import hash_embedding, unit

#: What a seed's likeness gains where both are of one type family (a fixed value).
FAMILY_BONUS = 0.15
#: Files whose paths describe a seed.
DESCRIBED_BY = 20


def type_family(seed: Column) -> Column:
    """First part of the type in a seed ``type:a/b|...``; empty for other seeds."""
    return F.when(F.startswith(seed, F.lit("type:")), F.regexp_extract(seed, r"^type:([^|/]*)", 1)).otherwise("")


def type_branch(seed: Column) -> Column:
    """First two parts of the type in a seed, ``unknown`` for other seeds."""
    return F.when(F.startswith(seed, F.lit("type:")), F.regexp_extract(seed, r"^type:([^|/]*(/[^|/]*)?)", 1)).otherwise("unknown")


def seed_ranks(paths: DataFrame) -> DataFrame:
    """(seed, n, rank): seeds by number of files, the smaller name first among equal ones. Seeds are few beside files."""
    sizes = paths.groupBy("seed").agg(F.count("*").alias("n"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "seed")))


def nearest_seed(paths: DataFrame, chosen: DataFrame, others: DataFrame) -> DataFrame:
    """(seed, clade): for each other seed the chosen one (seed, rank; a dozen) of the most similar hash vector.

    A seed is described by its name and its first paths; seeds of one type family are likelier by a fixed bonus.
    """
    first = paths.withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("path"))).filter(F.col("_k") <= DESCRIBED_BY)
    said = first.groupBy("seed").agg(F.concat_ws(" ", "seed", F.array_join(F.array_sort(F.collect_list("path")), " ")).alias("text"))
    v = cut(unit(hash_embedding(said.select(F.col("seed").alias("id"), "text"))), "seed-vectors")
    top = v.join(chosen, v["id"] == chosen["seed"]).select("idx", F.col("val").alias("w"), F.col("seed").alias("clade"))
    dots = others.select("seed").join(v, F.col("seed") == F.col("id")).join(F.broadcast(top), "idx").groupBy("seed", "clade").agg(F.sum(F.col("val") * F.col("w")).alias("dot"))
    dozen = [F.struct(F.lit(r["seed"]).alias("clade"), F.lit(r["rank"]).alias("rank")) for r in chosen.collect()]
    every = others.select("seed", F.explode(F.array(*dozen)).alias("c")).select("seed", "c.clade", "c.rank")
    family = type_family(F.col("seed"))
    bonus = F.when((family != "") & (family == type_family(F.col("clade"))), FAMILY_BONUS).otherwise(0.0)
    scored = every.join(dots, ["seed", "clade"], "left").withColumn("score", F.round(F.coalesce("dot", F.lit(0.0)), 9) + bonus)
    return scored.groupBy("seed").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "clade")).getField("clade").alias("clade"))


def family_votes(clade: DataFrame, edges: DataFrame, touches: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """One synchronous round of re-voting (path, clade) over co-changes (a, b, weight): files of different type families don't vote on each other."""
    ends = edges.select(F.col("a").alias("path"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("path"), F.col("a").alias("other"), "weight"))
    votes = ends.join(clade.select("path", "clade"), "path").join(clade.select(F.col("path").alias("other"), F.col("clade").alias("vote")), "other")
    mine, theirs = type_family(F.col("clade")), type_family(F.col("vote"))
    votes = votes.filter((mine == "") | (theirs == "") | (mine == theirs)).groupBy("path", "vote").agg(F.sum("weight").alias("w"))
    best = votes.groupBy("path").agg(F.min(F.struct((-F.col("w")).alias("m"), "vote")).alias("s")).select("path", F.col("s.vote").alias("vote"), (-F.col("s.m")).alias("w"))
    moved = (F.col("w") >= least) & (F.col("w") > share * F.col("touches"))
    return clade.join(best, "path", "left").join(touches, "path", "left").select("path", "seed", F.when(moved, F.col("vote")).otherwise(F.col("clade")).alias("clade"))


def split_mixed(clade: DataFrame, most: int = 12, least_files: int = 8, least_group: int = 3) -> DataFrame:
    """(path, clade): large clades that mix type branches keep the largest; others of three files or more become clades while there is room.

    Room is given by clade, then by size of the branch. Only counts per clade and branch are ranked.
    """
    rows = clade.withColumn("_branch", type_branch(F.col("seed")))
    groups = rows.groupBy("clade", "_branch").agg(F.count("*").alias("n"))
    own = Window.partitionBy("clade")
    groups = groups.withColumns({"all": F.sum("n").over(own), "k": F.row_number().over(own.orderBy(F.desc("n"), "_branch"))})
    room = most - clade.select("clade").distinct().count()
    peeled = groups.filter((F.col("all") >= least_files) & (F.col("k") > 1) & (F.col("n") >= least_group))
    peeled = peeled.withColumn("turn", F.row_number().over(Window.orderBy("clade", "k"))).filter(F.col("turn") <= room)
    named = F.concat(F.lit("type:"), "_branch", F.lit("|split:"), F.substring("clade", 1, 24))
    return rows.join(peeled.select("clade", "_branch", named.alias("_new")), ["clade", "_branch"], "left").select("path", F.coalesce("_new", "clade").alias("clade"))


def clade_clusters(paths: DataFrame, edges: DataFrame, touches: DataFrame, most: int = 12, least: int = 3, share: float = 0.3) -> DataFrame:
    """(path, clade): every path (path, seed) in one clade, of at most ``most``.

    The most common seeds are clades; the files of any other seed go to the nearest of these; then co-changes (a, b, weight) re-vote
    within a type family and mixed clades are split.
    """
    paths = cut(paths.select("path", "seed"), "paths")
    ranked = cut(seed_ranks(paths), "seeds")
    chosen, others = ranked.filter(F.col("rank") <= most), ranked.filter(F.col("rank") > most)
    joined = chosen.select("seed", F.col("seed").alias("clade"))
    if not others.isEmpty():
        joined = joined.unionByName(nearest_seed(paths, chosen, others))
    clade = cut(paths.join(joined, "seed").select("path", "seed", "clade"), "clades")
    return split_mixed(cut(family_votes(clade, edges, touches, least, share), "votes"), most)
