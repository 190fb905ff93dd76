"""Objectives of runs: what a spec asks for, and whether a run's signals came nearer to it without breaking its constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of objectives by the words that name them, with the signal each is read from and whether more of it is better (fixed values).
KINDS = {
    "reduce_debt": (("reduce_debt", "debt"), "debt.score", False),
    "raise_stability": (("raise_stability", "stability"), "stability.composite", True),
    "reduce_risk": (("reduce_risk", "risk"), "risk.count", False),
    "stabilize_path": (("stabilize_path", "path"), "risk.count", False),
    "follow_refactor": (("follow_refactor", "refactor"), "debt.score", False),
    "pass_tests": (("pass_tests", "tests", "test"), "tests.score", True),
}
COVERED = ("pass_tests+cov", "tests+cov", "coverage")
UPWARD = ("max", "maximize", "higher", "up")
#: Signal that a constraint holds to at least.
STABILITY = "stability.composite"


def parsed(specs: DataFrame) -> DataFrame:
    """(spec, kind, metric, higher, target, coverage) of specs (spec): a word of ``KINDS``, or ``metric:name:min|max[:target]``.

    Without a spec, or with one that says nothing known, the plan is followed.
    """
    raw = F.trim(F.coalesce("spec", F.lit("")))
    low, parts = F.lower(raw), F.split(raw, ":")
    kind = F.when(low.isin(*COVERED), "pass_tests")
    for name, (words, _, _) in KINDS.items():
        kind = kind.when(low.isin(*words), name)
    custom = F.startswith(low, F.lit("metric:"))
    kind = F.coalesce(F.when(custom, "custom"), kind, F.lit("follow_refactor"))
    of_kind = lambda i: F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[i])])[kind]
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    metric = F.when(custom, F.coalesce(part(1), F.lit("debt.score"))).otherwise(of_kind(1))
    higher = F.when(custom, F.lower(F.coalesce(part(2), F.lit("min"))).isin(*UPWARD)).otherwise(of_kind(2))
    return specs.select("spec", kind.alias("kind"), metric.alias("metric"), higher.alias("higher"), F.when(custom, F.try_to_number(part(3), F.lit("S999999999D999999")).cast("double")).alias("target"), low.isin(*COVERED).alias("coverage"))


def scored(objectives: DataFrame, signals: DataFrame, worsened: DataFrame, *keys: str, least_stability: float = 0.0, most_worsened: int = 3) -> DataFrame:
    """(keys, run, spec, value, previous, delta, improved, reached, constraints_ok, note) of every run of signals (keys, run, metric, value) for each objective.

    A run is compared with the one before it of the same keys, by ``run``; a signal that a run lacks counts as 0. ``worsened`` (keys, run, n) counts what got worse.
    Objectives are few, so they are joined by the signal they read; runs of one series are as long as they like.
    """
    on = [*keys, "run"]
    runs = signals.select(*on).distinct()
    before = Window.partitionBy(*keys).orderBy("run")
    runs = runs.withColumns({"_before": F.lag("run").over(before), "_first": F.row_number().over(before) == 1})
    wide = signals.join(F.broadcast(objectives.select("metric").distinct()), "metric", "left_semi").select(*on, "metric", F.col("value").cast("double").alias("value"))
    asked = F.explode(F.array(*[F.struct(F.lit(r["spec"]).alias("spec"), F.lit(r["metric"]).alias("metric"), F.lit(r["higher"]).alias("higher"), F.lit(r["target"]).cast("double").alias("target")) for r in objectives.collect()]))
    rows = runs.select(*on, "_before", "_first", asked.alias("o")).select(*on, "_before", "_first", "o.*")
    rows = rows.join(wide, [*on, "metric"], "left").join(wide.withColumnsRenamed({"run": "_before", "value": "previous"}), [*keys, "_before", "metric"], "left")
    stable = signals.filter(F.col("metric") == STABILITY).select(*on, F.col("value").cast("double").alias("_stable"))
    rows = rows.join(stable, on, "left").join(worsened.select(*on, F.col("n").alias("_worse")), on, "left")
    value, previous = F.coalesce("value", F.lit(0.0)), F.when(~F.col("_first"), F.coalesce("previous", F.lit(0.0)))
    delta = value - previous
    improved = F.coalesce((F.abs(delta) >= 1e-9) & (F.when(F.col("higher"), delta > 0).otherwise(delta < 0)), F.lit(False))
    reached = F.coalesce(F.when(F.col("higher"), value >= F.col("target")).otherwise(value <= F.col("target")), F.lit(False))
    held = (F.coalesce("_stable", F.lit(0.0)) >= least_stability) & (F.coalesce("_worse", F.lit(0)) <= most_worsened)
    note = F.when(F.col("_first"), "baseline").when(improved & held, "improved").when(improved, "improved, constraints failed").otherwise("not improved")
    return rows.select(*on, "spec", value.alias("value"), previous.alias("previous"), F.round(delta, 6).alias("delta"), improved.alias("improved"), reached.alias("reached"), held.alias("constraints_ok"), note.alias("note"))
