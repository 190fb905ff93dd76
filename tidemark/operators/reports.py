"""Themes, frames in focus, walks over families, calibrated stages, and reports put together from the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph, metrics, series, taxonomy, texts, traces

# What each theme sounds like (fixed values).
THEMES = {
    "feature": "add implement feature new support introduce capability",
    "fix": "fix bugfix patch resolve crash error regression",
    "refactor": "refactor cleanup restructure rename simplify modular",
    "docs": "docs documentation readme comment changelog",
    "test": "test coverage unit e2e assert mock fixture",
    "chore": "chore deps dependency bump ci build release version",
    "perf": "perf performance optimize speed memory latency",
    "security": "security auth vulnerability cve sanitize privilege",
}


def themes(rows: DataFrame) -> DataFrame:
    """(id, theme, score) of rows (id, text): the theme whose hash vector is nearest; "chore" where none is near.

    Vectors stay sparse: texts meet the eight themes on the coordinates they share.
    """
    spark = rows.sparkSession
    names = spark.createDataFrame(list(THEMES.items()), "id string, text string")
    proto = texts.unit(texts.hash_embedding(names)).select(F.col("id").alias("theme"), "idx", F.col("val").alias("p"))
    own = texts.unit(texts.hash_embedding(rows))
    score = own.join(F.broadcast(proto), "idx").groupBy("id", "theme").agg(F.round(F.sum(F.col("val") * F.col("p")), 9).alias("score"))
    best = score.filter("score > 0").groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("m"), "theme")).alias("s")).select("id", F.col("s.theme").alias("theme"), (-F.col("s.m")).alias("score"))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("theme", F.lit("chore")).alias("theme"), F.coalesce("score", F.lit(0.0)).alias("score"))


def theme_shares(rows: DataFrame) -> DataFrame:
    """(bucket, theme, n, share) of rows (bucket, theme)."""
    per = rows.groupBy("bucket", "theme").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bucket")))


def frame_focus(frames: DataFrame, records: DataFrame) -> DataFrame:
    """Frames whose evidence is among the records (id)."""
    cited = frames.select(F.col("id").alias("frame"), F.explode("evidence").alias("rid")).join(records.select(F.col("id").alias("rid")), "rid", "left_semi").select("frame").distinct()
    return frames.join(cited, frames["id"] == cited["frame"], "left_semi")


def frames_of_commits(commits: DataFrame, frames: DataFrame, most: int = 8) -> DataFrame:
    """(sha, frame) of commits (sha, clade) and frames (id, claim, clades): by clade, or by hash or clade named in the claim; frames are few."""
    f = frames.select(F.col("id").alias("frame"), "claim", "clades")
    match = F.array_contains("clades", F.col("clade")) | F.contains(F.col("claim"), F.substring(F.col("sha").cast("string"), 1, 7)) | F.contains(F.col("claim"), F.col("clade"))
    hits = commits.join(f, match)
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("sha").orderBy("frame"))).filter(F.col("_k") <= most).select("sha", "frame")


def family_walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, family: str, depth: int = 3) -> DataFrame:
    """(id, hops) within one family's relations; pivots and what joins them bridge to it."""
    rels = graph.FAMILY_RELS[family] + graph.FAMILY_RELS["pivot"]
    got = graph.reach(edges.filter(F.col("rel").isin(*rels)), seeds, depth, directed=False)
    return got.join(nodes.filter(graph.family_of(F.col("kind")).isin(family, "pivot")).select("id"), "id", "left_semi")


def pivot_join(nodes: DataFrame, edges: DataFrame, pivot_type: str) -> DataFrame:
    """(pivot, id): what joins the pivots of a type (their label)."""
    at = nodes.filter((F.col("kind") == "pivot") & (F.col("label") == pivot_type)).select(F.col("id").alias("pivot"))
    return edges.filter("rel = 'joins'").join(at, edges["target"] == at["pivot"]).select("pivot", F.col("source").alias("id"))


def generation_stage(generation: Column, most: Column, stages: int) -> Column:
    """Number of the stage window a generation falls into, in proportion."""
    return F.least(F.lit(stages - 1), F.floor(generation / F.greatest(F.lit(1), most) * stages)).cast("int")


def calibrated_stage(segments: DataFrame, anchors: DataFrame, now: Column, heuristic: Column, revert_rate: Column) -> DataFrame:
    """One row (stage, source): a sure segment, else the latest anchor by its age, else the rule; many reverts decide alone."""
    inside = segments.filter((F.col("start") <= now) & (F.col("end") > now) & (F.col("confidence") >= 0.5)).agg(F.max_by("stage", "confidence").alias("seg"))
    fresh = anchors.withColumn("w", F.col("confidence") * F.exp(-F.datediff(now, F.col("at")) / 365.0)).agg(F.max(F.struct("at", "stage", "w")).alias("a"))
    one = inside.crossJoin(fresh)
    stage = F.when(revert_rate > 0.12, "disturbance").when(F.col("seg").isNotNull(), F.col("seg")).when(F.col("a.w") >= 0.3, F.col("a.stage")).otherwise(heuristic)
    source = F.when(revert_rate > 0.12, "reverts").when(F.col("seg").isNotNull(), "segment").when(F.col("a.w") >= 0.3, "anchor").otherwise("heuristic")
    return one.select(stage.alias("stage"), source.alias("source"))


def phylogeny(commits: DataFrame, files: DataFrame, dependency: Column) -> DataFrame:
    """One row: the last window's stage and the stage the whole log's metrics call for."""
    last = metrics.stage_windows(commits).agg(F.max_by("stage", "win").alias("window_stage"))
    bundle = metrics.metric_bundle(commits, files, dependency)
    stage = traces.stage_override(F.col("revert_rate"), F.col("code_stability"), F.col("momentum"), F.col("improvement_trend"), F.col("window_stage"))
    return bundle.crossJoin(last).select("commit_count", "window_stage", stage.alias("current_stage"))


def dynamics(commits: DataFrame, events: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """Tables of the monthly state trajectory, its responses to events, and how long each regime lasted."""
    months = series.monthly(commits)
    samples = series.state_samples(months, series.monthly_load(commits))
    return {"state_samples": samples, "impulse_responses": series.impulse_responses(samples, events, "activity"), "basins": series.basins(samples, segments)}


def ecology(commits: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Stage windows, growth of files, trend tests and changepoints of the monthly series."""
    months = series.monthly(commits).withColumn("t", F.row_number().over(Window.orderBy("month")))  # months: few rows
    long = months.select("t", F.stack(F.lit(2), F.lit("commits"), F.col("n_commits").cast("double"), F.lit("churn"), F.col("churn").cast("double")).alias("id", "x"))
    return {"stages": metrics.stage_windows(commits), "growth": metrics.new_file_windows(files, commits), "trends": series.with_trend_labels(series.mann_kendall(long)), "changepoints": series.changepoints(long)}


def signal_confidence(evidence: DataFrame) -> DataFrame:
    """(signal, confidence, grade) of rows (signal, n, parts): the mean of saturating parts; little evidence is insufficient."""
    c = F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.least(F.lit(1.0), x)) / F.greatest(F.lit(1), F.size("parts"))
    grade = F.when(F.col("n") < 10, "insufficient").when(c >= 0.7, "high").when(c >= 0.45, "medium").otherwise("low")
    return evidence.select("signal", c.alias("confidence"), grade.alias("grade"))


def steps_for(plan: DataFrame, focus: list[str]) -> DataFrame:
    """A plan's steps, those of the waves in focus first, then in order of waves."""
    return plan.withColumn("_f", (~F.col("wave").isin(*focus)).cast("int")).orderBy("_f", "rank", "id").drop("_f")


def expectations(results: DataFrame, spec: DataFrame) -> DataFrame:
    """(case, n, passed, rate) of specs (case, kind, present) against results (case, kind)."""
    seen = results.select("case", "kind").distinct().withColumn("_seen", F.lit(True))
    ok = F.coalesce("_seen", F.lit(False)) == F.col("present")
    return spec.join(seen, ["case", "kind"], "left").groupBy("case").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed")).withColumn("rate", F.col("passed") / F.col("n"))


def priorities(one: DataFrame) -> DataFrame:
    """(rank, priority) by threshold rules from a one-row table (revert_rate, debt, dependency_rate, drift, stage)."""
    stage = F.col("stage")
    rules = [
        F.when(F.col("revert_rate") > 0.1, "stabilize reverts"), F.when(F.col("debt") > 0.4, "pay down debt"), F.when(F.col("dependency_rate") > 0.15, "audit dependencies"), F.when(F.col("drift") > 0.35, "document drift"),
        F.when(stage == "disturbance", "consolidate").when(stage == "growth", "protect boundaries").when(stage == "maturity", "observe and refactor"),
    ]
    found = F.array_compact(F.array(*rules))
    return one.select(F.posexplode(F.when(F.size(found) == 0, F.array(F.lit("keep course"))).otherwise(found)).alias("rank", "priority"))


def sprint_report(commits: DataFrame, milestones: DataFrame | None = None) -> DataFrame:
    """(span, n, churn, n_reverts): commits within each milestone (span, start, due), or of each ISO week where there are none."""
    if milestones is None or milestones.isEmpty():
        spans = commits.select(series.week_key(F.col("ts")).alias("span"), "churn", "is_revert", F.lit(True).alias("inside"))
    else:
        within = (F.col("start").isNull() | (F.col("ts") >= F.col("start"))) & (F.col("due").isNull() | (F.col("ts") <= F.col("due")))
        spans = milestones.join(commits.select("ts", "churn", "is_revert"), within, "left").withColumn("inside", F.col("ts").isNotNull())
    return spans.groupBy("span").agg(F.count_if("inside").alias("n"), F.coalesce(F.sum("churn"), F.lit(0)).alias("churn"), F.count_if(F.coalesce("is_revert", F.lit(False))).alias("n_reverts"))


def dashboard(clades: DataFrame, drift: DataFrame, risk: DataFrame, debt: DataFrame) -> DataFrame:
    """(clade, drift, risk, debt): mean drift, gravest risk and weighted debt hits over the most of any clade. Debt rows have a weight."""
    hits = debt.groupBy("clade").agg(F.sum("weight").alias("hits"))
    most = hits.agg(F.greatest(F.lit(1e-9), F.max("hits").cast("double")).alias("_most"))
    out = clades.select("clade").distinct().join(drift.groupBy("clade").agg(F.avg("drift").alias("drift")), "clade", "left").join(risk.groupBy("clade").agg(F.max("severity").alias("risk")), "clade", "left").join(hits, "clade", "left")
    return out.crossJoin(most).select("clade", F.coalesce("drift", F.lit(0.0)).alias("drift"), F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce(F.col("hits") / F.col("_most"), F.lit(0.0)).alias("debt"))


def repositories(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, ...): the metrics of many repositories at once, from commits and files that carry a repo key."""
    touches = files.groupBy("repo", "path").agg(F.count("*").alias("t"))
    p = F.col("t") / F.sum("t").over(Window.partitionBy("repo"))
    spread = touches.withColumn("h", -p * F.log2(p + 1e-12)).groupBy("repo").agg(F.sum("h").alias("file_touch_entropy"), F.max("t").alias("_top"))
    base = commits.groupBy("repo").agg(F.count("*").alias("commit_count"), F.count_if("is_revert").alias("revert_count"), F.sum("churn").alias("churn_total"), F.countDistinct("author").alias("n_authors"))
    n = F.col("commit_count")
    stable = 1 / (1 + 0.002 * F.col("churn_total") / n + 3 * F.col("revert_count") / n + 0.5 * F.coalesce("_top", F.lit(0)) / n)
    return base.join(spread, "repo", "left").withColumn("code_stability", stable).drop("_top")


def regime_checks(months: DataFrame, points: DataFrame, pieces: DataFrame) -> DataFrame:
    """(check, ok): a year of months, a changepoint, one upward in activity, a disturbance, and a number of stages within bounds."""
    one = months.agg(F.count("*").alias("months")).crossJoin(points.agg(F.count("*").alias("points"), F.count_if((F.col("id") == "n_commits") & (F.col("direction") == "up")).alias("up")))
    one = one.crossJoin(pieces.agg(F.count("*").alias("pieces"), F.count_if(F.col("stage").isin("disturbance", "decline")).alias("cool")))
    checks = {"months": F.col("months") >= 12, "changepoint": F.col("points") >= 1, "upward": F.col("up") >= 1, "cooling": F.col("cool") >= 1, "stages": F.col("pieces").between(5, 11)}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()])).alias("c")).select("c.*")


def attention_rank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 3, per_family: int = 4, limit: int = 12, tau_hours: float = 24.0) -> DataFrame:
    """(id, kind, family, attention): what spreads from the seeds (id, value) to nodes (id, kind, age_hours), older ones less.

    A list of at most ``per_family`` nodes of a family and ``limit`` in all. A null age: no decay. Pass only nodes whose window is open.
    """
    heat = graph.spreading(edges, seeds, max(2, rounds))
    decay = F.coalesce(1 / (1 + F.greatest(F.lit(0.0), F.col("age_hours")) / max(1.0, tau_hours)), F.lit(1.0))
    scored = heat.join(nodes, "id").select("id", "kind", F.coalesce(graph.family_of(F.col("kind")), F.col("kind")).alias("family"), F.round(F.col("value") * decay, 9).alias("attention"))
    return taxonomy.capped(scored, "family", [F.desc("attention"), F.col("id")], per_family, limit)
