"""How far findings can be trusted: signals, hypotheses, drift of meaning by clade, and whole states of months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.texts import drift, mean_vector

# --- signals ---

#: Signals that lead a report, the order among equals (fixed values).
HEROES = ("change_coupling", "hotspot_churn_complexity", "offboarding_risk")


def _capped(x: Column, most: float = 1.0) -> Column:
    return F.least(F.lit(most), x.cast("double"))


def signal_scores(logs: DataFrame, *keys: str) -> DataFrame:
    """(keys, signal, value, confidence, reliability, n_evidence, hero) of logs, a row each.

    Columns: n (commits), n_edges, n_strong (pairs of weight 3 or more), top_weight, filtered (commits too large to couple), n_hot, hot_score,
    has_complexity, n_authors, mastery_drop, stability. A null n_edges, n_hot or n_authors: that signal was not measured. ``hero`` ranks the leading
    signals by confidence and strength; under ten commits nothing is reliable.
    """
    c = F.col
    n = c("n").cast("double")
    signals = {
        "change_coupling": (c("n_edges").isNotNull(), c("top_weight"), 0.95, 0.25 + 0.35 * _capped(c("n_strong") / 8) + 0.25 * _capped(n / 80) + 0.15 * (1 - _capped(c("filtered") / F.greatest(F.lit(1.0), n))), c("n_edges")),
        "hotspot_churn_complexity": (c("n_hot") > 0, c("hot_score"), 0.95, 0.3 + 0.3 * _capped(n / 60) + 0.25 * F.when(c("has_complexity"), 1.0).otherwise(0.35) + 0.15 * _capped(2 * c("hot_score")), c("n_hot")),
        "offboarding_risk": (c("n_authors").isNotNull(), c("mastery_drop"), 0.95, 0.25 + 0.3 * _capped(c("n_authors") / 5) + 0.25 * _capped(n / 60) + 0.2 * _capped(c("mastery_drop")), c("n_authors")),
        "code_stability": (c("stability").isNotNull(), c("stability"), 0.9, 0.2 + 0.5 * _capped(n / 80) + 0.2 * c("stability"), c("n")),
    }
    made = [F.when(there, F.struct(F.lit(name).alias("signal"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"), F.round(_capped(score, most), 4).alias("confidence"), evidence.cast("bigint").alias("n_evidence"))) for name, (there, value, most, score, evidence) in signals.items()]
    every = logs.withColumn("_s", F.array_compact(F.array(*made)))
    strength = lambda s: s["confidence"] * (0.5 + F.abs(s["value"]))
    heroes = F.array(*map(F.lit, HEROES))
    order = lambda s: F.array_position(heroes, s["signal"])
    before = lambda s: F.size(F.filter("_s", lambda x: (order(x) > 0) & ((strength(x) > strength(s)) | ((strength(x) == strength(s)) & (order(x) < order(s))))))
    ranked = F.transform("_s", lambda s: F.struct(s["signal"].alias("signal"), s["value"].alias("value"), s["confidence"].alias("confidence"), s["n_evidence"].alias("n_evidence"), F.when(order(s) > 0, before(s) + 1).alias("hero")))
    reliable = F.when(F.col("n") < 10, "insufficient").when(F.col("s.confidence") >= 0.7, "high").when(F.col("s.confidence") >= 0.45, "medium").otherwise("low")
    return every.select(*keys, "n", F.explode(ranked).alias("s")).select(*keys, "s.signal", "s.value", "s.confidence", reliable.alias("reliability"), "s.n_evidence", "s.hero")


# --- hypotheses ---

#: Laws of change, the series each is tested on and what it claims (fixed values but for the wording).
LAWS = {
    "continuing_change": ("churn_rate", "The code goes on changing"),
    "increasing_complexity": ("churn_rate", "Complexity grows unless it is worked against"),
    "continuing_growth": ("file_growth", "Its content goes on growing"),
    "declining_quality": ("revert_rate", "Quality declines where it is not maintained"),
    "conservation_of_familiarity": ("file_growth", "Growth stays within what people can follow"),
    "self_regulation": ("work_rate", "The rate of work regulates itself"),
    "organisational_stability": ("work_rate", "The rate of activity stays about the same"),
    "feedback_system": ("churn_rate", "Change feeds back on itself"),
}


def sample_confidence(n: Column, floor: int = 20, good: int = 80) -> Column:
    """How far n commits carry a claim."""
    return F.when(n < 8, 0.15).when(n < floor, 0.35).when(n < good, 0.55 + 0.25 * (n - floor) / (good - floor)).otherwise(F.least(F.lit(0.95), 0.8 + 0.001 * (n - good)))


def hypothesis_panel(logs: DataFrame, tests: DataFrame, support: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, claim, verdict, confidence, method, n) of all eight laws for each log (keys, n commits).

    ``tests`` (keys, series, n, p) are trend tests, ``support`` (keys, law, label) says what the trends say of a law. Under twelve commits there is no
    verdict; support whose trend is not significant is weak; a test over less than four windows counts for little.
    """
    laws = F.explode(F.array(*[F.struct(F.lit(k).alias("law"), F.lit(series).alias("series"), F.lit(text).alias("claim")) for k, (series, text) in LAWS.items()]))
    rows = logs.select(*keys, "n", laws.alias("l")).select(*keys, "n", "l.*")
    on = list(keys)
    trend = tests.select(*keys, "series", F.col("n").alias("_windows"), F.col("p").alias("_p"))
    rows = rows.join(trend, [*on, "series"], "left").join(support.select(*keys, "law", "label"), [*on, "law"], "left")
    n, p = F.col("n"), F.col("_p")
    base = sample_confidence(n)
    tested = F.when(p.isNull() | (F.col("_windows") < 4), F.least(base, F.lit(0.25))).otherwise(F.round(F.least(F.lit(0.95), 0.4 * base + 0.6 * base * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), p))), 4))
    plain = F.when(n < 12, "insufficient").when(F.col("label").isin("support", "contradict"), F.col("label")).otherwise("weak")
    verdict = F.when((plain == "support") & (p >= 0.05), "weak").otherwise(plain)
    confidence = F.when(n < 12, F.least(tested, F.lit(0.3))).otherwise(tested)
    return rows.select(*keys, F.concat(F.lit("H-"), "law").alias("id"), "claim", verdict.alias("verdict"), confidence.alias("confidence"), F.when(p.isNull(), "proxy_only").otherwise("mann_kendall_windows+proxy").alias("method"), "n")


def stage_hypothesis(logs: DataFrame, *keys: str) -> DataFrame:
    """The panel's claim on the stage of each log (keys, n, stage): never more than weak."""
    n = F.col("n")
    confidence = F.round(sample_confidence(n) * F.when(n >= 30, 0.7).otherwise(0.5), 4)
    claim = F.concat(F.lit("The repository is in stage "), "stage")
    return logs.filter("stage IS NOT NULL").select(*keys, F.lit("H-ecological_stage").alias("id"), claim.alias("claim"), F.when(n >= 20, "weak").otherwise("insufficient").alias("verdict"), confidence.alias("confidence"), F.lit("heuristic_window_classifier").alias("method"), "n")


# --- drift ---


def clade_drift(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(clade, drift): one less the cosine of the mean vectors of a clade's early and late texts; 0 where one half is missing.

    From unit vectors (id, idx, val, early) and members (id, clade); a text may be in several clades.
    """
    own = vectors.join(members.select("id", "clade").distinct(), "id").withColumn("half", F.struct("clade", "early"))
    means = mean_vector(own, "half").select("half.*", "idx", "val")
    e, late = means.filter("early").select("clade", "idx", F.col("val").alias("e")), means.filter("NOT early").select("clade", "idx", F.col("val").alias("l"))
    sums = e.join(late, ["clade", "idx"], "full").fillna(0.0, ["e", "l"]).groupBy("clade").agg(F.sum(F.col("e") * F.col("l")).alias("d"), F.sum(F.col("e") * F.col("e")).alias("a"), F.sum(F.col("l") * F.col("l")).alias("b"))
    moved = F.when((F.col("a") > 0) & (F.col("b") > 0), 1 - F.col("d") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0)
    return members.select("clade").distinct().join(sums.select("clade", moved.alias("drift")), "clade", "left").fillna(0.0, ["drift"])


def neutral_churn(commits: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: drift of all texts, and how much the churn (early, churn) grew while meaning stayed: between 0 and 1."""
    sums = commits.agg(F.sum(F.when(F.col("early"), F.col("churn"))).alias("_e"), F.sum(F.when(~F.col("early"), F.col("churn"))).alias("_l"))
    one = sums.crossJoin(F.broadcast(drift(vectors)))  # single rows
    some = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(c)
    moved = F.coalesce("drift", F.lit(0.0))
    grown = (some(F.col("_l")) / some(F.col("_e")) - 1) * 0.5 * (1 - moved)
    return one.select(moved.alias("drift"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), grown)).alias("neutral_churn"))


# --- states ---


def state_trajectory(samples: DataFrame, pressure: DataFrame, heat: DataFrame) -> DataFrame:
    """Monthly states (``series.state_samples``) with the two coordinates that a whole log has alike: selection pressure (score, one row) and mean heat of branches (delta)."""
    one = pressure.agg(F.max("score").cast("double").alias("selection")).crossJoin(F.broadcast(heat.agg(F.coalesce(F.avg("delta"), F.lit(0.0)).alias("typed_heat"))))
    return samples.crossJoin(F.broadcast(one)).fillna(0.0, ["selection"])
