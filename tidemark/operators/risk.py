"""Failure points, remediation plans, pressure and fragility scores, snapshots and gates, the evidence ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Waves by kind of failure point, in order of work (fixed values).
WAVES = {
    "revert_surface": "stabilize", "test_gap": "stabilize", "hotspot_blast": "decouple", "change_coupling": "decouple", "bus_factor": "ownership", "offboarding_risk": "ownership",
    "dependency_shock": "dependencies", "dependency_fragility": "dependencies", "low_fitness": "consolidate", "sprint_fatigue": "people", "cognitive_load": "people", "selection_pressure": "people",
}
WAVE_ORDER = ("stabilize", "decouple", "dependencies", "consolidate", "ownership", "people")

POINT = ("kind", "path", "severity")


def points(df: DataFrame, kind: str, severity: Column, path: str | None = "path") -> DataFrame:
    """One kind's failure points in the common form; severity is at most one."""
    return df.select(F.lit(kind).alias("kind"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), F.least(F.lit(1.0), severity.cast("double")).alias("severity"))


def hotspot_points(touches: DataFrame, degree: DataFrame, n: Column, hot: DataFrame, limit: int = 8) -> DataFrame:
    """The first hotspots by score (path, touches, complexity, score) with their degree (path, degree)."""
    top = hot.orderBy(F.desc("score"), "path").limit(limit).join(degree, "path", "left").fillna(0, ["degree"])
    s = 0.25 + 0.35 * F.log1p("touches") / F.log1p(n) + 0.2 * F.log1p("degree") / F.log(F.lit(41.0)) + 0.25 * F.least(F.lit(1.0), 1.4 * F.col("score") + F.col("complexity") / 80)
    return points(top, "hotspot_blast", s)


def coupling_points(edges: DataFrame, limit: int = 5) -> DataFrame:
    top = edges.filter("weight >= 3").orderBy(F.desc("weight"), "a", "b").limit(limit).withColumn("path", F.concat("a", F.lit(" <-> "), "b"))
    return points(top, "change_coupling", 0.35 + F.col("weight") / 12)


def revert_points(files: DataFrame, commits: DataFrame, limit: int = 6) -> DataFrame:
    per = files.select("sha", "path").join(commits.filter("is_revert").select("sha"), "sha", "left_semi").groupBy("path").agg(F.count("*").alias("r"))
    return points(per.filter("r >= 2").orderBy(F.desc("r"), "path").limit(limit), "revert_surface", 0.4 + F.col("r") / 5)


def fitness_points(fitness: DataFrame, limit: int = 5) -> DataFrame:
    return points(fitness.filter("fitness < 0.45").orderBy("fitness", "path").limit(limit), "low_fitness", 1 - F.col("fitness"))


def scalar_point(one: DataFrame, kind: str, when: Column, severity: Column) -> DataFrame:
    """A failure point of the whole log, from a one-row table, where its condition holds."""
    return points(one.filter(when), kind, severity, None)


def log_points(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, path, severity): failure points of whole logs, a row each, from their scores; a null score makes none.

    Columns: prod_touches, test_touches, dependency_rate, fragility, mastery_drop, fatigue, load_index, pressure.
    """
    c = F.col
    rules = {
        "test_gap": ("(repository)", (c("prod_touches") > 20) & (c("test_touches") < 0.25 * c("prod_touches")), F.lit(0.7)),
        "dependency_shock": ("(manifests/lockfiles)", c("dependency_rate") > 0.12, 3 * c("dependency_rate")),
        "dependency_fragility": ("(supply chain)", c("fragility") >= 0.4, 0.35 + c("fragility")),
        "offboarding_risk": ("(knowledge)", c("mastery_drop") >= 0.35, 0.4 + c("mastery_drop")),
        "sprint_fatigue": ("(work rhythm)", c("fatigue") >= 0.45, 0.4 + c("fatigue")),
        "cognitive_load": ("(attention / ownership)", c("load_index") >= 0.5, 0.35 + c("load_index")),
        "selection_pressure": ("(github issues/prs)", c("pressure") >= 0.35, 0.4 + c("pressure")),
    }
    made = [F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(path).alias("path"), F.least(F.lit(1.0), s.cast("double")).alias("severity"))) for kind, (path, when, s) in rules.items()]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("p")).select(*keys, "p.*")


def owner_points(single: DataFrame) -> DataFrame:
    """Hot files (path) that one author alone touches."""
    return points(single, "bus_factor", F.lit(0.55))


def smell_points(found: DataFrame) -> DataFrame:
    """Failure points of smells (smell, severity), each under its own name."""
    return found.select(F.col("smell").alias("kind"), F.lit("(arch)").alias("path"), F.when(F.col("severity") == "high", 0.75).otherwise(0.5).alias("severity"))


def rank_points(*kinds: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, kind, path, severity, priority): the gravest of each kind and path, in order of severity; W1 is the first.

    The kinds' lists are short, so numbering them is one small sort.
    """
    every = reduce(DataFrame.unionByName, kinds)
    best = every.groupBy("kind", "path").agg(F.round(F.max("severity"), 3).alias("severity"))
    order = [F.desc("severity"), F.col("kind"), F.col("path").asc_nulls_first()]
    top = best.orderBy(*order).limit(limit) if limit else best
    numbered = top.withColumn("k", F.row_number().over(Window.orderBy(*order)))
    return numbered.select(F.concat(F.lit("W"), F.col("k").cast("string")).alias("id"), "kind", "path", "severity", priority(F.col("severity")).alias("priority"))


def priority(severity: Column) -> Column:
    return F.when(severity >= 0.85, "P0").when(severity >= 0.65, "P1").when(severity >= 0.45, "P2").otherwise("P3")


def effort_days(severity: Column, blast: Column, complexity: Column) -> Column:
    return F.least(F.lit(20.0), F.greatest(F.lit(0.25), 0.25 + 2.5 * severity + 1.5 * blast + F.least(F.lit(1.0), complexity / 40)))


def plan_steps(risks: DataFrame) -> DataFrame:
    """(id, kind, path, wave, days, size, gain, priority, depends_on): steps by wave; all wait for the first one that stabilises."""
    waves = F.create_map(*[F.lit(x) for kv in WAVES.items() for x in kv])
    wave = F.coalesce(waves[F.col("kind")], F.lit("consolidate"))
    rank = F.array_position(F.array(*map(F.lit, WAVE_ORDER)), wave)
    days = effort_days(F.col("severity"), F.lit(0.0), F.lit(0.0))
    steps = risks.select("id", "kind", "path", wave.alias("wave"), rank.alias("rank"), F.round(days, 3).alias("days"), F.when(days >= 4, "L").when(days >= 1.5, "M").otherwise("S").alias("size"), F.round(F.least(F.lit(0.35), 0.4 * F.col("severity")), 3).alias("gain"), "priority", "severity")
    first = steps.filter("wave = 'stabilize'").agg(F.min(F.struct((-F.col("severity")).alias("m"), "id")).alias("s")).select(F.col("s.id").alias("_first"))
    out = steps.crossJoin(F.broadcast(first))
    return out.withColumn("depends_on", F.when((F.col("wave") != "stabilize") & F.col("_first").isNotNull(), F.col("_first"))).drop("_first", "severity")


def selection_pressure(issues: DataFrame) -> DataFrame:
    """One row from issues (is_open, is_bug, n_bug_labels, reopened, is_pull, merged): rates and the weighted score."""
    i, p = ~F.col("is_pull"), F.col("is_pull")
    one = issues.agg(
        F.count_if(i & F.col("is_open")).alias("open"), F.count_if(i & ~F.col("is_open")).alias("closed"), F.count_if(i & F.col("is_bug")).alias("bugs"),
        F.sum(F.when(i, F.col("n_bug_labels")).otherwise(0)).alias("bug_labels"), F.count_if(i & F.col("reopened")).alias("reopened"), F.count_if(p).alias("pulls"), F.count_if(p & F.col("merged")).alias("merged"),
    )
    n = F.greatest(F.lit(1), F.col("open") + F.col("closed"))
    one = one.withColumns({"bug_rate": F.col("bugs") / n, "reopen_rate": F.col("reopened") / n, "backlog": F.col("open") / n, "merge_rate": F.when(F.col("pulls") == 0, 1.0).otherwise(F.col("merged") / F.greatest(F.lit(1), F.col("pulls")))})
    return one.withColumn("score", 0.45 * F.col("bug_rate") + 0.25 * F.col("reopen_rate") + 0.2 * F.col("backlog") + 0.1 * (1 - F.col("merge_rate")))


def fragility(rate: Column, depth: Column, locked: Column, abandoned: Column, packages: Column) -> Column:
    one = F.lit(1.0)
    parts = 0.35 * F.least(one, 4 * rate) + 0.35 * F.least(one, depth / 10) + 0.15 * F.when(locked, 0.0).otherwise(0.8) + 0.15 * F.least(one, abandoned / 3) + 0.1 * F.least(one, packages / 80)
    return F.least(one, parts)


def smells(touches: DataFrame, one: DataFrame) -> DataFrame:
    """(smell, severity) from file touches and a one-row table (n, feature_commits, test_touches, utility_touches, revert_files)."""
    top = touches.agg(F.max("touches").alias("top"))
    rules = [
        ("hotspot_gravity", F.col("top") >= F.greatest(F.lit(5.0), 0.2 * F.col("n")), "high"),
        ("test_lag", (F.col("feature_commits") > 10) & (F.col("test_touches") < 0.3 * F.col("feature_commits")), "high"),
        ("utility_sink", F.col("utility_touches") > F.greatest(F.lit(10.0), 0.25 * F.col("n")), "med"),
        ("repeated_revert_surface", F.col("revert_files") >= 2, "high"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("smell"), F.lit(s).alias("severity"))) for n, c, s in rules]))
    return one.crossJoin(top).select(F.explode(found).alias("s")).select("s.*")


# Metrics of a snapshot and whether more is better (fixed values).
DIRECTIONS = {
    "code_stability": True, "revert_rate": False, "avg_churn": False, "dependency_rate": False, "momentum": True, "improvement": True, "debt": False, "fatigue": False,
}


def snapshot_diff(history: DataFrame, least: float = 1e-4) -> DataFrame:
    """(run, metric, value, previous, delta, verdict) of a long history (run, metric, value): each run against the one before."""
    prev = F.lag("value").over(Window.partitionBy("metric").orderBy("run"))
    up = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])[F.col("metric")]
    out = history.withColumn("previous", prev).filter("previous is not null").withColumn("delta", F.col("value") - F.col("previous"))
    return out.withColumn("verdict", F.when(F.abs("delta") < least, "unchanged").when((F.col("delta") > 0) == F.coalesce(up, F.lit(True)), "better").otherwise("worse"))


def new_critical(current: DataFrame, previous: DataFrame, least: float = 0.85) -> DataFrame:
    """Failure points of this snapshot at or over the limit whose kind and path weren't in the last one's."""
    c, p = current.filter(F.col("severity") >= least), previous.filter(F.col("severity") >= least)
    return c.join(p.select("kind", F.col("path").alias("_p")), (c["kind"] == p["kind"]) & c["path"].eqNullSafe(F.col("_p")), "left_anti")


def gate(stability: DataFrame, fresh: DataFrame, fatigue: DataFrame, min_stability: float = 0.35, max_fatigue: float = 0.75, max_new: int = 0, baseline: bool = False, max_baseline: int = 12) -> DataFrame:
    """One row: passed, failures and warnings. In a baseline run ``fresh`` holds all critical points; more than ``max_baseline`` warn, none fail."""
    one = stability.crossJoin(fatigue).crossJoin(fresh.agg(F.count("*").alias("new_p0")))
    fails = F.array_compact(F.array(F.when(F.col("code_stability") < min_stability, F.lit("stability")), F.when(~F.lit(baseline) & (F.col("new_p0") > max_new), F.lit("new_p0"))))
    warns = F.array_compact(F.array(F.when(F.col("fatigue") > max_fatigue, F.lit("fatigue")), F.when(F.lit(baseline) & (F.col("new_p0") > max_baseline), F.lit("baseline"))))
    return one.select((F.size(fails) == 0).alias("passed"), F.array_join(fails, ",").alias("failures"), F.array_join(warns, ",").alias("warnings"), "new_p0")


def gate_with_tests(gates: DataFrame, tests: DataFrame, *keys: str, require_coverage: bool = False, least_gain: float = 0.0) -> DataFrame:
    """(keys, passed, failures, warnings): a gate's rows (keys, passed, failures, warnings) with those of test runs (keys, ok, coverage, previous_coverage).

    A run that failed, a coverage that is asked for and missing, or one that gained less than ``least_gain``, fails the gate. Without a test run nothing changes.
    """
    ran = tests.select(*keys, F.col("ok").alias("_ok"), F.col("coverage").alias("_now"), F.col("previous_coverage").alias("_then"), F.lit(True).alias("_ran"))
    rows = gates.join(ran, list(keys), "left") if keys else gates.crossJoin(F.broadcast(ran))
    there = F.coalesce("_ran", F.lit(False))
    more = F.array_compact(F.array(
        F.when(F.col("failures") != "", F.col("failures")), F.when(there & ~F.coalesce("_ok", F.lit(False)), F.lit("tests")), F.when(there & F.lit(require_coverage) & F.col("_now").isNull(), F.lit("coverage_missing")),
        F.when(there & (F.col("_now") - F.col("_then") + 1e-12 < least_gain), F.lit("coverage")),
    ))
    return rows.select(*keys, (F.size(more) == 0).alias("passed"), F.array_join(more, ",").alias("failures"), "warnings")


def budget_breach(usage: DataFrame, prices: DataFrame, limit: float) -> DataFrame:
    """(run, at, spent): where each run's running cost first passes the limit. usage(run, at, model, tokens), prices(model, per_1k)."""
    cost = usage.join(prices, "model", "left").withColumn("cost", F.col("tokens") / 1000 * F.coalesce("per_1k", F.lit(0.0)))
    spent = cost.withColumn("spent", F.sum("cost").over(Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return spent.filter(F.col("spent") > limit).groupBy("run").agg(F.min(F.struct("at", "spent")).alias("s")).select("run", "s.at", "s.spent")


def set_changes(previous: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, urgency): what was added, removed or changed between two snapshots."""
    p, c = previous.select(key, F.col(value).alias("_old")), current.select(key, F.col(value).alias("_new"))
    both = p.join(c, key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    urgency = F.create_map(F.lit("added"), F.lit(0.45), F.lit("removed"), F.lit(0.4), F.lit("changed"), F.lit(0.55))
    return both.select(key, change.alias("change")).filter("change is not null").withColumn("urgency", urgency[F.col("change")])


def surface(events: DataFrame, limit: int = 8) -> DataFrame:
    return events.withColumn("rank_score", F.col("urgency") * (0.5 + 0.5 * F.col("confidence"))).orderBy(F.desc("rank_score"), "id").limit(limit)


def directional(before: DataFrame, after: DataFrame, expects: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, expect, ok): directional expectations on two long digests (metric, value)."""
    j = expects.join(before.withColumnRenamed("value", "b"), "metric").join(after.withColumnRenamed("value", "a"), "metric")
    d = F.col("a") - F.col("b")
    ok = F.when(F.col("expect") == "up", d > tolerance).when(F.col("expect") == "down", d < -tolerance).when(F.col("expect") == "up_or_flat", d >= -tolerance).when(F.col("expect") == "down_or_flat", d <= tolerance).otherwise(F.col("a") != 0)
    return j.select("metric", "expect", ok.alias("ok"))


def combine_suites(scores: DataFrame) -> DataFrame:
    """One row: weighted mean of suites (suite, weight, score), weights renormalised over those present."""
    w = F.when(F.col("score").isNotNull(), F.col("weight"))
    return scores.agg((F.sum(F.col("weight") * F.col("score")) / F.sum(w)).alias("combined"), F.count("score").alias("suites"))


# --- ledger ---

def ledger_rows(df: DataFrame, kind: str, id_parts: list[Column], when: Column | None = None, path: Column | None = None, clade: Column | None = None, summary: Column | None = None, links: Column | None = None) -> DataFrame:
    """One source in the ledger's common form: id, kind, at, path, clade, summary, links[record_id, role]."""
    from tidemark.functions.text import record_id

    none = F.lit(None)
    no_links = F.array().cast("array<struct<record_id:string,role:string>>")
    return df.select(
        record_id(kind, *id_parts).alias("id"), F.lit(kind).alias("kind"), (none if when is None else when).cast("timestamp").alias("at"), (none if path is None else path).cast("string").alias("path"),
        (none if clade is None else clade).cast("string").alias("clade"), (none if summary is None else summary).cast("string").alias("summary"), (no_links if links is None else links.cast("array<struct<record_id:string,role:string>>")).alias("links"),
    )


def ledger(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def ledger_query(rows: DataFrame, path: str | None = None, clade: str | None = None, kinds: list[str] | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    out = rows
    if path:
        out = out.filter(F.coalesce(F.contains("path", F.lit(path)), F.lit(False)) | F.coalesce(F.contains("summary", F.lit(path)), F.lit(False)))
    if clade:
        out = out.filter(F.col("clade") == clade)
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if since:
        out = out.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.filter(F.col("at") <= F.lit(until).cast("timestamp"))
    return out.orderBy("at", "id").limit(limit) if limit else out


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def resolve(rows: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hops): records within two links of the start, either way."""
    from tidemark.operators.graph import reach

    links = rows.select(F.col("id").alias("source"), F.explode("links").alias("l")).select("source", F.col("l.record_id").alias("target"))
    return reach(links, start, depth, directed=False).join(rows.select("id"), "id", "left_semi")


def frames(risks: DataFrame) -> DataFrame:
    """Claim frames of failure points: what is claimed, how surely, and its evidence."""
    conf = F.when(F.col("severity") >= 0.75, 0.6).otherwise(0.45)
    return risks.select(F.concat(F.lit("frame:risk:"), "id").alias("id"), F.concat_ws(" in ", "kind", "path").alias("claim"), F.lit("risk").alias("stance"), conf.alias("confidence"), F.array(F.concat_ws(":", F.lit("failure_point"), "id", "path")).alias("evidence"))


def expand(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """(frame, id, kind, path): each frame's evidence records."""
    return frames.select(F.col("id").alias("frame"), F.explode("evidence").alias("rid")).join(rows, F.col("rid") == rows["id"]).select("frame", rows["id"], "kind", "path")


def path_pack(rows: DataFrame) -> DataFrame:
    """(path, n, kinds, last): for all paths at once what the ledger holds on each."""
    return rows.filter("path is not null").groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.max("at").alias("last"))
