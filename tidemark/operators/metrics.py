"""Global metrics of a change log, per-file and per-author counts, timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import clamp, early, k_window, recent_third, soft_inverse, with_seq

#: Small constant in the logarithm of entropies (a fixed value).
TINY = 1e-12


def touch_counts(files: DataFrame) -> DataFrame:
    """(path, touches)"""
    return files.groupBy("path").agg(F.count("*").alias("touches"))


def author_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author").agg(F.count("*").alias("n_commits"))


def entropy(counts: DataFrame, column: str, name: str = "entropy") -> DataFrame:
    """One row: Shannon entropy in bits of a column of counts. Two aggregations, no window over the whole."""
    total = counts.agg(F.sum(column).alias("_total"))
    p = F.col(column) / F.col("_total")
    return counts.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log2(p + TINY)), F.lit(0.0)).alias(name))


def hot_files(files: DataFrame, limit: int | None = 15, endings: tuple[str, ...] = ()) -> DataFrame:
    """The most touched files; with ``endings``, of those whose path has one of them, in any case."""
    if endings:
        files = files.filter(reduce(lambda a, b: a | b, [F.lower("path").endswith(e.lower()) for e in endings]))
    ranked = touch_counts(files).orderBy(F.desc("touches"), "path")
    return ranked.limit(limit) if limit else ranked


def momentum(commits: DataFrame) -> DataFrame:
    """One row: change of churn and of reverts in the most recent third against the rest."""
    placed = with_seq(commits.select("sha", "ts", "churn", "is_revert"), "ts", "sha", total="n").withColumn("recent", recent_third(F.col("seq"), F.col("n")))
    r, o = F.avg(F.when(F.col("recent"), F.col("churn"))), F.coalesce(F.avg(F.when(~F.col("recent"), F.col("churn"))), F.lit(0.0))
    reverts = lambda side: F.coalesce(F.avg(F.when(side, F.col("is_revert").cast("int"))), F.lit(0.0))
    sums = placed.agg(r.alias("r"), o.alias("o"), reverts(~F.col("recent")).alias("rev_o"), reverts(F.col("recent")).alias("rev_r"))
    return sums.select(
        ((F.col("r") - F.col("o")) / (F.col("o") + 1)).alias("momentum"),
        (F.col("rev_o") - F.col("rev_r") + 0.1 * (F.col("o") - F.col("r")) / (F.col("o") + 1)).alias("improvement_trend"),
    )


def metric_bundle(commits: DataFrame, files: DataFrame, dependency: Column) -> DataFrame:
    """One row of global metrics. ``dependency`` says which of files' rows are dependency manifests."""
    base = commits.agg(
        F.count("*").alias("commit_count"), F.count_if("is_revert").alias("revert_count"), F.coalesce(F.sum("churn"), F.lit(0)).alias("churn_total"), F.countDistinct("author").alias("n_authors")
    )
    touches = touch_counts(files)
    top = touches.agg(F.max("touches").alias("top_touch"))
    dep = files.filter(dependency).agg(F.countDistinct("sha").alias("dependency_change_commits"))
    parts = (base, top, dep, entropy(touches, "touches", "file_touch_entropy"), momentum(commits))
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    n = F.greatest(F.lit(1), F.col("commit_count"))
    one = one.withColumns({"revert_rate": F.col("revert_count") / n, "avg_churn_per_commit": F.col("churn_total") / n, "dependency_rate": F.col("dependency_change_commits") / n})
    stable = 1 / (1 + 0.002 * F.col("avg_churn_per_commit") + 3 * F.col("revert_rate") + 0.5 * F.coalesce("top_touch", F.lit(0)) / n)
    return one.withColumn("code_stability", clamp(stable)).drop("top_touch")


def change_timeline(commits: DataFrame, buckets: int = 12) -> DataFrame:
    """(bucket, n_commits, churn, n_reverts): equal spans of time from the first commit to the last; empty ones are kept."""
    span = commits.agg(F.min(F.unix_micros("ts")).alias("t0"), F.max(F.unix_micros("ts")).alias("t1"))
    width = F.greatest(F.lit(1), F.col("t1") - F.col("t0")) / F.lit(buckets)
    at = F.least(F.lit(buckets - 1), F.floor((F.unix_micros("ts") - F.col("t0")) / width)).cast("bigint")
    counted = commits.crossJoin(F.broadcast(span)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"), F.sum("churn").alias("c"), F.count_if("is_revert").alias("r"))
    return commits.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").select(
        "bucket", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("n", "n_commits"), ("c", "churn"), ("r", "n_reverts"))]
    )


def file_fitness(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, touches, n_reverts, churn_share, fitness): 1 / (1 + 2 * share of reverts + .001 * churn per touch)."""
    per = files.select("sha", "path").join(commits.select("sha", "is_revert", "churn", "n_files"), "sha")
    out = per.groupBy("path").agg(
        F.count("*").alias("touches"), F.count_if("is_revert").alias("n_reverts"), F.sum(F.floor(F.col("churn") / F.greatest(F.lit(1), F.col("n_files")))).alias("churn_share")
    )
    return out.withColumn("fitness", 1 / (1 + 2 * F.col("n_reverts") / F.col("touches") + 0.001 * F.col("churn_share") / F.col("touches")))


def allocations(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(sha, path, clade, insertions, deletions): a commit's lines dealt evenly over its files, whole lines only."""
    totals = commits.select("sha", "n_files", F.col("insertions").alias("i"), F.col("deletions").alias("d"))
    share = lambda c: F.floor(F.col(c) / F.greatest(F.lit(1), F.col("n_files"))).cast("bigint")
    return files.select("sha", "path", "clade").join(totals, "sha").select("sha", "path", "clade", share("i").alias("insertions"), share("d").alias("deletions"))


def stage_windows(commits: DataFrame, k: int = 5) -> DataFrame:
    """(win, n_commits, avg_churn, revert_rate, stage): count-based windows and the rule-based stage of each."""
    placed = with_seq(commits.select("sha", "ts", "churn", "is_revert", "subject"), "ts", "sha", total="n").withColumn("win", k_window(F.col("seq"), F.col("n"), k))
    words = [F.max(F.col("subject").rlike(rf"(?i)\b{w}").cast("int")) for w in ("refactor", "cleanup", "consolidat", "simplif")]
    per = placed.groupBy("win").agg(
        F.count("*").alias("n_commits"), F.avg("churn").alias("avg_churn"), F.avg(F.col("is_revert").cast("int")).alias("revert_rate"), F.max("n").alias("n"), sum(words[1:], words[0]).alias("words")
    )
    c, r = F.col("avg_churn"), F.col("revert_rate")
    stage = (
        F.when((r > 0.15) | (c > 400), "disturbance")
        .when((F.col("win") == 0) & (F.col("n") < 40), "pioneer")
        .when((c > 120) & (r < 0.08), "growth")
        .when((F.col("words") / F.col("n_commits") > 0.25) & (c < 100), "consolidation")
        .when((c < 40) & (r < 0.05), "maturity")
        .when((c < 15) & (F.col("win") == k - 1), "decline")
        .otherwise("growth")
    )
    return per.withColumn("stage", stage).drop("n", "words")


def new_file_windows(files: DataFrame, commits: DataFrame, k: int = 8) -> DataFrame:
    """(win, new_files, total_files): files first touched in each count-based window, and how many there are so far."""
    placed = with_seq(commits.select("sha", "ts"), "ts", "sha", total="n").select("sha", k_window(F.col("seq"), F.col("n"), k).alias("win"))
    first = files.join(placed, "sha").groupBy("path").agg(F.min("win").alias("win")).groupBy("win").agg(F.count("*").alias("new"))
    every = commits.sparkSession.range(k).withColumnRenamed("id", "win").join(first, "win", "left").select("win", F.coalesce("new", F.lit(0)).alias("new_files"))
    return every.withColumn("total_files", F.sum("new_files").over(Window.orderBy("win").rowsBetween(Window.unboundedPreceding, 0)))  # k rows


def file_growth(files: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: files that only the second half touches, and their share of all."""
    half = with_seq(commits.select("sha", "ts"), "ts", "sha", total="n").select("sha", early(F.col("seq"), F.col("n")).alias("early"))
    per = files.join(half, "sha").groupBy("path").agg(F.bool_or("early").alias("early"))
    return per.agg(F.count_if(~F.col("early")).alias("new_files"), F.count("*").alias("all_files")).withColumn("growth", F.col("new_files") / F.greatest(F.lit(1), F.col("all_files")))


def stability_v2(bundle: DataFrame, test_ratio: Column, concentration: Column, utility: Column, load: Column, fatigue: Column | None = None) -> DataFrame:
    """The bundle's row with five soft-inverse components and their weighted composite."""
    parts = {
        "structural": soft_inverse(0.9 * concentration + 0.5 * utility + 0.4 * load, 2.2),
        "behavioral": soft_inverse(F.col("revert_rate"), 4.0),
        "dependency": soft_inverse(F.col("dependency_rate"), 3.5),
        "rhythm": soft_inverse(F.lit(0.25) if fatigue is None else fatigue, 2.5),
        "test": 1 - F.exp(-2.2 * test_ratio),
    }
    out = bundle.withColumns(parts)
    weights = {"structural": 0.25, "behavioral": 0.25, "dependency": 0.15, "rhythm": 0.15, "test": 0.20}
    return out.withColumn("composite", sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0)))


def hotspots(touches: DataFrame, complexity: DataFrame) -> DataFrame:
    """(path, touches, complexity, score): touches over the most, times cx / (cx + 20)."""
    top = touches.agg(F.max("touches").alias("_top"))
    return touches.join(complexity, "path").crossJoin(F.broadcast(top)).select("path", "touches", "complexity", (F.col("touches") / F.col("_top") * F.col("complexity") / (F.col("complexity") + 20)).alias("score"))
