"""What changed between two graphs, notes on failures, next experiments, checks of a trajectory, and queries in one call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph, lineage, reports, risk

#: Kinds of node that carry a stance as their label (fixed values).
STANCE_KINDS = ("frame", "decision", "proposal")


def delta_events(prev: DataFrame, cur: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, ref, urgency): crossings between two graphs of nodes (id, kind, label) and two one-row states (stage, debt, risks).

    Types added, removed or renamed and stances changed are rows of one outer join; node counts are sums over it.
    A state's null value crosses nothing.
    """
    p, c = (df.select("id", F.col("kind").alias(f"_k{s}"), F.col("label").alias(f"_l{s}")) for df, s in ((prev, "p"), (cur, "c")))
    both = p.join(c, "id", "full")
    old, new = (F.coalesce(F.col(k) == "type", F.lit(False)) for k in ("_kp", "_kc"))
    held = F.col("_kp").isin(*STANCE_KINDS) & F.col("_kc").isin(*STANCE_KINDS) & (F.col("_lp") != "") & (F.col("_lc") != "")
    event = lambda kind, urgency: F.struct(F.lit(kind).alias("kind"), urgency.cast("double").alias("urgency"))
    fixed = lambda kind, urgency: event(kind, F.lit(urgency))
    each = (
        F.when(new & ~old, fixed("type_added", 0.45)).when(old & ~new, fixed("type_removed", 0.4)).when(old & new & ~F.col("_lp").eqNullSafe(F.col("_lc")), fixed("type_changed", 0.55))
        .when(held & (F.col("_lp") != F.col("_lc")), fixed("stance_changed", 0.7))
    )
    rows = both.select(F.col("id").alias("ref"), each.alias("e")).filter("e is not null").select("e.kind", "ref", "e.urgency")

    n = both.agg(F.count_if(F.col("_kp").isNull()).alias("more"), F.count_if(F.col("_kc").isNull()).alias("less"))
    counts = [
        ("delta:nodes", F.when(F.col("more") >= 3, event("nodes_added", F.least(F.lit(0.5), F.col("more") / 40)))),
        ("delta:nodes", F.when(F.col("less") >= 3, event("nodes_removed", F.least(F.lit(0.45), F.col("less") / 40)))),
    ]
    pair = before.select(*[F.col(x).alias(f"_{x}") for x in ("stage", "debt", "risks")]).crossJoin(after.select("stage", "debt", "risks"))
    step = F.abs(F.col("debt") - F.col("_debt"))
    states = [
        ("window:ecology", F.when(F.col("stage") != F.col("_stage"), fixed("stage_changed", 0.8))),
        ("context:debt", F.when(step >= 0.05, event("debt_crossed", F.least(F.lit(1.0), 4 * step)))),
        ("context:risk", F.when(F.col("risks") != F.col("_risks"), fixed("risk_count", 0.6))),
    ]

    def found(one: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
        made = F.array(*[F.when(e.isNotNull(), F.struct(e["kind"].alias("kind"), F.lit(ref).alias("ref"), e["urgency"].alias("urgency"))) for ref, e in rules])
        return one.select(F.explode(F.array_compact(made)).alias("e")).select("e.*")

    return rows.unionByName(found(n, counts)).unionByName(found(pair, states))


def merge_findings(findings: DataFrame) -> DataFrame:
    """(kernel, finding, n, first) of rows (kernel, finding, seq): each kernel's findings once, with where they first stood."""
    return findings.groupBy("kernel", "finding").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


# --- nodes that decisions leave behind


def _frame_id(f: Column) -> Column:
    return F.when(f.startswith("frame:"), f).otherwise(F.concat(F.lit("frame:"), f))


def _frame_nodes(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("frames").alias("label")).distinct().select(_frame_id(F.col("label")).alias("id"), F.lit("frame").alias("kind"), "label", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("confidence"))


def preference_graph(prefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Policy nodes and what they cite, from preferences (id, rule, text, n, frames)."""
    conf = F.least(F.lit(0.9), 0.4 + 0.1 * F.col("n"))
    nodes = prefs.select("id", F.lit("policy").alias("kind"), F.col("rule").alias("label"), "text", F.lit(0).cast("bigint").alias("seq"), conf.alias("confidence"))
    edges = prefs.select(F.col("id").alias("source"), F.explode("frames").alias("f")).select("source", _frame_id(F.col("f")).alias("target"), F.lit("cites").alias("rel"))
    return nodes.unionByName(_frame_nodes(prefs)), edges.distinct()


def failure_reflections(rounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reflection nodes of rounds (index, verify_ok, notes, frames) whose check failed or whose notes tell of a rollback.

    Each overrides its round's decision and falsifies the frames its proposal rested on. A null check didn't fail.
    """
    told = F.coalesce(F.lower("notes").rlike("rolled back|rollback"), F.lit(False))
    failed = rounds.filter((F.col("verify_ok") == F.lit(False)) | told)
    key = lambda prefix: F.concat(F.lit(prefix), F.col("index").cast("string"))
    text = F.when(F.coalesce("notes", F.lit("")) == "", "verify/rollback failure").otherwise(F.col("notes"))
    node = lambda i, kind, label, t, conf: failed.select(i.alias("id"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), t.alias("text"), F.col("index").cast("bigint").alias("seq"), F.lit(conf).cast("double").alias("confidence"))
    nodes = node(key("reflect:fail:"), "reflection", "reflect:overridden", text, 0.7).unionByName(node(key("decision:"), "decision", "decision:overridden", F.lit(""), None)).unionByName(_frame_nodes(failed))
    over = failed.select(key("reflect:fail:").alias("source"), key("decision:").alias("target"), F.lit("overridden").alias("rel"))
    false = failed.select(key("reflect:fail:").alias("source"), F.explode("frames").alias("f")).select("source", _frame_id(F.col("f")).alias("target"), F.lit("falsified_by").alias("rel"))
    return nodes, over.unionByName(false).distinct()


def merge_reflections(host: tuple[DataFrame, DataFrame], live: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The host graph with another's reflection nodes, their overriding edges, and the other ends it doesn't know yet."""
    (nodes, edges), (more, links) = host, live
    own = more.filter("kind = 'reflection'").select("id")
    of = links.filter(F.col("rel").isin("overridden", "falsified_by"))
    ends = lambda c: of.join(own.withColumnRenamed("id", c), c, "left_semi").select("source", "target", "rel")
    kept = ends("source").unionByName(ends("target")).distinct()
    wanted = kept.select(F.explode(F.array("source", "target")).alias("id")).unionByName(own).distinct()
    fresh = more.join(wanted, "id", "left_semi").join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(fresh.select(*nodes.columns)), edges.unionByName(kept.select(*edges.columns)).distinct()


# --- follow-ups and checks


def next_experiments(branches: DataFrame, trends: DataFrame, stage: DataFrame, points: DataFrame, anchors: DataFrame, limit: int = 8) -> DataFrame:
    """(place, id, about): claims worth testing next, by rule; a list of ``limit`` at most.

    ``branches``: type_key, trend, delta; ``trends``: id, trend; ``stage``: one row (stage); ``points``: id, magnitude;
    ``anchors``: kind, label, at. Three branches that heat up and two that cool down by their change, then the rules of the whole log.
    """

    def moving(trend: str, name: str, first: int, k: int) -> DataFrame:
        order = (F.desc(F.abs("delta")), F.col("type_key"))
        top = branches.filter(F.col("trend") == trend).orderBy(*order).limit(k).withColumn("k", F.row_number().over(Window.orderBy(*order)))  # k rows
        return top.select((first + F.col("k")).alias("place"), F.concat(F.lit(name), F.col("k").cast("string")).alias("id"), F.col("type_key").alias("about"))

    def rule(one: DataFrame, place: int, name: str, about: Column) -> DataFrame:
        return one.select(F.lit(place).alias("place"), F.lit(name).alias("id"), about.cast("string").alias("about"))

    some = lambda df, value: df.agg(value.alias("v")).filter("v is not null")
    parts = [
        moving("heating", "heat_", 0, 3), moving("cooling", "cool_", 3, 2),
        rule(some(trends.filter("id = 'revert_rate' and trend = 'rising'"), F.max("id")), 6, "lehman_quality", F.col("v")),
        rule(stage.filter(F.col("stage").isin("disturbance", "growth")), 7, "stage_shift", F.col("stage")),
        rule(some(points, F.max(F.struct("magnitude", "id"))["id"]), 8, "changepoint_persist", F.col("v")),
        rule(some(anchors.filter("kind = 'security'"), F.max("kind")), 9, "security_disturbance", F.col("v")),
        rule(some(anchors, F.max(F.struct("at", "label"))["label"]), 10, "event_anchor", F.col("v")),
    ]
    every = graph.cut(reduce(DataFrame.unionByName, parts), "experiments")
    none = rule(every.agg(F.count("*").alias("n")).filter("n = 0"), 1, "baseline_monitor", F.lit(None))
    out = every.unionByName(none).orderBy("place").limit(limit)
    return out.select(F.row_number().over(Window.orderBy("place")).alias("place"), "id", "about")


def dynamics_checks(samples: DataFrame, records: DataFrame, frames: DataFrame, events: DataFrame, errors: DataFrame, stage: DataFrame, least: int = 8) -> DataFrame:
    """(case, check, ok): whether a trajectory, its answers to releases and its regimes rest on enough evidence.

    ``samples``: a row a month; ``records``: kind, at, path; ``frames``: id; ``events``: kind, label; ``errors``: a row for
    each fault of the pack; ``stage``: one row (stage).
    """
    kind = F.col("kind")
    seen = lambda *ks: F.count_if(kind.isin(*ks))
    release = kind.isin("major_release", "minor_release", "release") | F.col("label").startswith("v")
    one = samples.agg(F.count("*").alias("months")).crossJoin(
        records.agg(seen("trajectory", "state_sample").alias("states"), seen("impulse_response").alias("impulses"), seen("regime_basin").alias("basins"), F.count("at").alias("dated"), F.count("path").alias("paths"))
    )
    one = one.crossJoin(frames.agg(F.count("*").alias("frames"), F.count_if(F.col("id").startswith("frame:response:")).alias("responses"), F.count_if(F.col("id") == "frame:basin").alias("basin"), F.count_if(F.col("id") == "frame:stage").alias("staged")))
    one = one.crossJoin(events.agg(F.count("*").alias("events"), F.count_if(release).alias("releases"))).crossJoin(errors.agg(F.count("*").alias("errors"))).crossJoin(stage.agg(F.max("stage").alias("stage")))
    has = lambda *cs: reduce(lambda a, b: a | b, [F.col(c) >= 1 for c in cs])
    enough = F.col("months") >= least
    checks = {
        "trajectory": {"real_months": enough, "trajectory_record": has("states"), "pack_schema": F.col("errors") == 0, "frames_present": has("frames"), "timeline_dated": has("dated") | enough},
        "impulse_major": {"real_months": enough, "lifecycle_events": has("events"), "release_event": has("releases"), "impulse_response": has("impulses"), "response_or_stage_frame": has("responses", "basin", "staged")},
        "basin": {"real_months": enough, "basin_or_segment": has("basins"), "basin_or_stage_frame": has("basin", "staged"), "stage_labeled": F.coalesce(F.col("stage") != "", F.lit(False)), "path_pack_ok": has("paths")},
    }
    rows = F.array(*[F.struct(F.lit(case).alias("case"), F.lit(name).alias("check"), ok.alias("ok")) for case, cs in checks.items() for name, ok in cs.items()])
    return one.select(F.explode(rows).alias("c")).select("c.*")


# --- reports in one call


def remediation(risks: DataFrame, mistakes: DataFrame) -> DataFrame:
    """A plan's steps (``risk.plan_steps``) with one more for each architectural mistake (smell) that no failure point stands for."""
    steps = risk.plan_steps(risks)
    extra = mistakes.select(F.col("smell").alias("kind")).distinct().join(risks.select("kind"), "kind", "left_anti")
    calming = [k for k, wave in risk.WAVES.items() if wave == "stabilize"]
    waits = risks.filter(F.col("kind").isin(*calming)).agg(F.min(F.struct((-F.col("severity")).alias("m"), "id"))["id"].alias("depends_on"))
    more = extra.crossJoin(waits).select(
        F.concat(F.lit("DEB-"), "kind").alias("id"), "kind", F.lit(None).cast("string").alias("path"), F.lit("contain").alias("wave"), F.lit(len(risk.WAVE_ORDER) + 1).alias("rank"), F.lit(2.0).alias("days"), F.lit("M").alias("size"), F.lit(0.15).alias("gain"), F.lit("P1").alias("priority"), "depends_on",
    )
    return steps.unionByName(more.withColumn("rank", F.col("rank").cast(steps.schema["rank"].dataType)))


def commit_model(commits: DataFrame, parents: DataFrame, files: DataFrame, types: DataFrame, risks: DataFrame, debt: DataFrame) -> DataFrame:
    """(sha, intent, division, score, parents, shift): each commit's intent, division and score, and whether its first parent's division is another.

    ``parents``: sha, parent, pos; ``types``: path, type; ``risks`` and ``debt`` by clade. A commit without files has no division and no shift.
    """
    from tidemark.functions.text import intent

    division = lineage.divisions(files, types)
    clade = files.groupBy("sha").agg(F.min("clade").alias("clade"))
    score = lineage.commit_scores(commits.select("sha", "churn").join(clade, "sha", "left"), risks, debt)
    n = parents.groupBy("sha").agg(F.count("*").alias("parents"))
    up = parents.filter("pos = 0").select("sha", "parent").join(division.select(F.col("sha").alias("parent"), F.col("division").alias("_above")), "parent").select("sha", "_above")
    out = commits.select("sha", "subject").join(n, "sha", "left").join(division, "sha", "left").join(score, "sha", "left").join(up, "sha", "left")
    n0 = F.coalesce("parents", F.lit(0))
    return out.select("sha", intent(F.col("subject"), n0)["kind"].alias("intent"), "division", "score", n0.cast("bigint").alias("parents"), F.coalesce(F.col("division") != F.col("_above"), F.lit(False)).alias("shift"))


def query_context(nodes: DataFrame, edges: DataFrame, search: list[str] | None = None, flow: DataFrame | None = None, family: tuple[str, DataFrame] | None = None, pivot: str | None = None, precedent: list[str] | None = None, depth: int = 4, traverse: DataFrame | None = None, previous: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(mode, id, score) of all that is asked for at once: words, a flow from seeds (id), a family from seeds, members of a pivot type, precedents.

    ``traverse`` (id) asks for what lies around; ``previous`` (nodes, state before, state now) for what changed since, by urgency: see ``delta_events``.
    """
    as_rows = lambda df, mode, score: df.select(F.lit(mode).alias("mode"), "id", score.cast("double").alias("score"))
    near = 1 / (1 + F.col("hops"))
    parts = [
        as_rows(graph.search(nodes, search), "search", F.col("score")) if search else None,
        as_rows(graph.flow_walk(nodes, edges, flow, depth), "flow", near) if flow is not None else None,
        as_rows(reports.family_walk(nodes, edges, family[1], family[0], depth), "family", near) if family else None,
        as_rows(reports.pivot_join(nodes, edges, pivot), "pivot", F.lit(1.0)) if pivot else None,
        as_rows(graph.precedents(nodes, edges, precedent), "precedent", F.col("score")) if precedent else None,
        as_rows(graph.expand(nodes, edges, traverse, depth), "traverse", near) if traverse is not None else None,
        as_rows(delta_events(previous[0], nodes, previous[1], previous[2]).withColumnRenamed("ref", "id"), "delta", F.col("urgency")) if previous is not None else None,
    ]
    asked = [p for p in parts if p is not None]
    if not asked:
        raise ValueError("name at least one of search, flow, family, pivot, precedent, traverse and previous")
    return reduce(DataFrame.unionByName, asked)


def query_ledger(rows: DataFrame, frames: DataFrame, resolve: str | None = None, frame: str | None = None, pack: str | None = None, depth: int = 2, **filters) -> DataFrame:
    """One question to a ledger: records near one, a frame's evidence, what it holds on a path, else those that pass the filters."""
    if resolve is not None:
        start = rows.filter(F.col("id") == resolve).select("id")
        return risk.resolve(rows, start, depth)
    if frame is not None:
        return risk.expand(frames.filter(F.col("id") == frame), rows)
    if pack is not None:
        return risk.path_pack(rows.filter(F.col("path") == pack))
    return risk.ledger_query(rows, **filters)
