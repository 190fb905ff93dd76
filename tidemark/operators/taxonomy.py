"""Clades of files, what they hold, and hierarchies of path types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clade_aggregates(alloc: DataFrame, files: DataFrame) -> DataFrame:
    """(clade, touches, churn, n_files, top_layer): what a clade adds up to and the layer most of its files are in."""
    base = alloc.groupBy("clade").agg(F.count("*").alias("touches"), F.sum(F.col("insertions") + F.col("deletions")).alias("churn"), F.countDistinct("path").alias("n_files"))
    layers = files.select("clade", "layer", "path").distinct().groupBy("clade", "layer").agg(F.count("*").alias("n"))
    # The greatest count wins and of equal ones the first name: a minimum over (-count, name).
    top = layers.groupBy("clade").agg(F.min(F.struct((-F.col("n")).alias("m"), "layer")).alias("s")).select("clade", F.col("s.layer").alias("top_layer"))
    return base.join(top, "clade")


def clade_of(rows: DataFrame, path_clade: DataFrame) -> DataFrame:
    """Rows with the clade of their path, or ``clade_unknown``."""
    return rows.join(path_clade.select("path", F.col("clade").alias("_clade")), "path", "left").withColumn("clade", F.coalesce("_clade", F.lit("clade_unknown"))).drop("_clade")


def histogram(files: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n): one pass over grouping sets, one set per column."""
    kinds = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return files.select(F.explode(kinds).alias("k")).groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"))


def type_rollup(types: DataFrame, levels: list[str]) -> DataFrame:
    """Counts, churn and mean confidence at every prefix of the levels; a shorter type ends where its levels do.

    ``types``: path, the levels, churn, confidence. Returns (prefix, depth, n, churn, mean_conf).
    """
    parts = F.array_compact(F.array(*levels))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("_p")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("_p", 1, i), "/").alias("prefix")))
    rows = types.withColumn("_p", parts).select("churn", "confidence", F.explode(prefixes).alias("s"))
    return rows.groupBy("s.prefix", "s.depth").agg(F.count("*").alias("n"), F.sum("churn").alias("churn"), F.avg("confidence").alias("mean_conf"))


def layer_hierarchy(files: DataFrame) -> DataFrame:
    """(layer, top, n, level): counts by layer, by layer and top directory, and in all."""
    return files.rollup("layer", "top").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def majority_stage(types: DataFrame, levels: list[str], stage: str) -> DataFrame:
    """(prefix, stage, share): the most common stage below every prefix, and its share."""
    parts = F.array_compact(F.array(*levels))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", 1, i), "/"))
    counted = types.withColumn("_p", parts).select(F.explode(prefixes).alias("prefix"), F.col(stage).alias("stage")).groupBy("prefix", "stage").agg(F.count("*").alias("n"))
    return counted.groupBy("prefix").agg(F.min(F.struct((-F.col("n")).alias("m"), "stage")).alias("s"), F.sum("n").alias("all")).select("prefix", F.col("s.stage").alias("stage"), (-F.col("s.m") / F.col("all")).alias("share"))


def clade_stage(clades: DataFrame) -> DataFrame:
    """Clades (churn, touches, revert_frac, n_files) with the rule-based stage of each."""
    t, c = F.col("touches"), F.col("churn")
    stage = (
        F.when((t < 3) | (F.col("n_files") <= 2), "pioneer")
        .when(F.col("revert_frac") > 0.15, "disturbance")
        .when(c > 800, "growth")
        .when(c < 120, "maturity")
        .otherwise("consolidation")
    )
    return clades.withColumn("stage", stage)


def niches(clades: DataFrame) -> DataFrame:
    """(clade, share, crowded): a clade's share of all files; utility clades crowd over a quarter or 40 files, any over .4."""
    total = clades.agg(F.sum("n_files").alias("_all"))
    share = F.col("n_files") / F.col("_all")
    crowded = ((F.col("top_layer") == "utility") & ((share > 0.25) | (F.col("n_files") > 40))) | (share > 0.4)
    return clades.crossJoin(F.broadcast(total)).select("clade", share.alias("share"), crowded.alias("crowded"))


def branch_trends(touches: DataFrame) -> DataFrame:
    """(type_key, early, late, delta, trend) of rows (type_key, early flag, churn)."""
    halves = touches.groupBy("type_key").agg(
        F.sum(F.when(F.col("early"), F.col("churn")).otherwise(0)).alias("early"), F.sum(F.when(~F.col("early"), F.col("churn")).otherwise(0)).alias("late")
    )
    delta = F.col("late") - F.col("early")
    limit = F.greatest(F.lit(20.0), 0.25 * (F.col("early") + 1))
    return halves.withColumn("delta", delta).withColumn("trend", F.when(delta > limit, "heating").when(delta < -limit, "cooling").otherwise("steady"))


def cochange_votes(edges: DataFrame, clade: DataFrame, touches: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """One synchronous round of re-voting: (path, clade) where a file's neighbors agree on another clade."""
    ends = edges.select(F.col("a").alias("path"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("path"), F.col("a").alias("other"), "weight"))
    votes = ends.join(clade.select(F.col("path").alias("other"), F.col("clade").alias("vote")), "other").groupBy("path", "vote").agg(F.sum("weight").alias("w"))
    best = votes.groupBy("path").agg(F.min(F.struct((-F.col("w")).alias("m"), "vote")).alias("s")).select("path", F.col("s.vote").alias("vote"), (-F.col("s.m")).alias("w"))
    return clade.join(best, "path", "left").join(touches, "path", "left").select("path", F.when((F.col("w") >= least) & (F.col("w") > share * F.col("touches")), F.col("vote")).otherwise(F.col("clade")).alias("clade"))


def first_rule(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern a path matches."""
    out = None
    for name, pattern in rules:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(default)


def dominant(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, value): per key the value of the greatest total weight, ties by name."""
    sums = rows.groupBy(key, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("m"), F.col(value))).alias("s")).select(key, F.col(f"s.{value}").alias(value))


def capped(rows: DataFrame, family: str, order: list, per_family: int, limit: int) -> DataFrame:
    """A ranked list of at most ``per_family`` rows of each family and ``limit`` in all."""
    own = rows.withColumn("_k", F.row_number().over(Window.partitionBy(family).orderBy(*order))).filter(F.col("_k") <= per_family)
    return own.orderBy(*order).limit(limit).drop("_k")
