"""Decision traces: outcomes, impasses, preferences, notes, test logs; claims and their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_outcome(accepted: Column, applied: Column, improved: Column, rolled_back: Column) -> Column:
    return F.when(rolled_back, "rolled_back").when(accepted & improved, "improved").when(accepted, "accepted_no_delta").when(~applied, "no_apply").otherwise("none")


#: Outcomes from worst to best, for the best of a run (fixed values).
OUTCOME_ORDER = ("none", "no_apply", "rolled_back", "accepted_no_delta", "improved")


def impasse(insufficient: Column, verify_failed: Column, refused: Column, outcome: Column, tied: Column) -> Column:
    return F.when(insufficient, "insufficient").when(verify_failed, "verify_fail").when(refused, "fence_refuse").when(outcome == "accepted_no_delta", "accepted_no_gain").when(tied, "path_tie")


def best_outcomes(rounds: DataFrame) -> DataFrame:
    """(run, outcome, rounds): the best outcome of each run of rounds (run, outcome)."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOME_ORDER)), F.col("outcome"))
    return rounds.groupBy("run").agg(F.max(F.struct(rank.alias("r"), "outcome")).getField("outcome").alias("outcome"), F.count("*").alias("rounds"))


def preferences(decisions: DataFrame, least: int = 2) -> DataFrame:
    """(paths, frames, outcome, n, rule): what happened repeatedly on the same paths and frames."""
    same = decisions.groupBy(F.array_sort("paths").alias("paths"), F.array_sort("frames").alias("frames"), "outcome").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return same.withColumn("rule", F.when(F.col("outcome").isin("rolled_back", "no_apply"), "refuse_blast").otherwise("prefer_fence"))


def conflicts(findings: DataFrame) -> DataFrame:
    """(path, owners): paths that more than one kernel claims, of findings (kernel, path)."""
    return findings.groupBy("path").agg(F.array_sort(F.collect_set("kernel")).alias("owners")).filter(F.size("owners") > 1)


def compact_notes(notes: DataFrame, key_chars: int = 80) -> DataFrame:
    """(owner, at, text): notes with white space made even; of those that begin alike the first stays."""
    even = notes.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).filter("text <> ''")
    first = Window.partitionBy("owner", F.lower(F.substring("text", 1, key_chars))).orderBy("at")
    return even.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def memory_score(age_hours: Column, cosine: Column, importance: Column, graph_hit: Column, path_hit: Column) -> Column:
    return F.exp(-age_hours / 24) * F.greatest(F.lit(0.0), cosine) * importance * F.when(graph_hit, 1.25).otherwise(1.0) * F.when(path_hit, 1.05).otherwise(1.0)


def test_score(logs: DataFrame) -> DataFrame:
    """(run, passed, failed, coverage, score) from the text of test logs (run, ok, text)."""
    number = lambda p: F.coalesce(F.try_to_number(F.regexp_extract("text", p, 1), F.lit("999999")).cast("int"), F.lit(0))
    out = logs.select("run", "ok", number(r"(\d+) passed").alias("passed"), number(r"(\d+) failed").alias("failed"), (number(r"TOTAL.*?(\d+)%") / 100).alias("coverage"))
    return out.withColumn("score", F.col("ok").cast("int") + 0.02 * F.least(F.col("passed"), F.lit(50)) - 0.1 * F.col("failed") + F.col("coverage")).drop("ok")


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller token set that both have."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def stage_override(revert_rate: Column, stability: Column, momentum: Column, improvement: Column, stage: Column) -> Column:
    """The last window's stage, unless the whole log's metrics say otherwise."""
    return F.when(revert_rate > 0.12, "disturbance").when((stability > 0.75) & (momentum < 0.2), "maturity").when((momentum > 0.8) & (improvement < 0), "growth").when(improvement > 0.15, "consolidation").otherwise(stage)


def hypothesis_confidence(n: Column, p: Column) -> Column:
    base = F.when(n < 8, 0.15).when(n < 20, 0.35).when(n < 80, 0.55 + 0.25 * (n - 20) / 60).otherwise(F.least(F.lit(0.95), 0.8 + 0.001 * (n - 80)))
    return base * (0.4 + 0.6 * (1 - p))


def hypotheses(tests: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim, verdict, confidence) of claims (claim, id, expects rising or falling) against trend tests (id, n, p, trend)."""
    j = claims.join(tests, "id", "left")
    verdict = F.when(F.coalesce("n", F.lit(0)) < 12, "insufficient").when(F.col("trend") == F.col("expects"), "support").when(F.col("trend") == "flat", "weak").otherwise("contradict")
    return j.select("claim", verdict.alias("verdict"), F.coalesce(hypothesis_confidence(F.col("n"), F.col("p")), F.lit(0.15)).alias("confidence"))


def laws(commits: DataFrame, files: DataFrame, bundle: DataFrame, windows: int = 6) -> DataFrame:
    """One row of eight law proxies, each between 0 and 1, from the log, its files and its metrics (``metric_bundle``)."""
    from tidemark.functions.ordering import clamp, k_window, with_seq
    from tidemark.operators.metrics import author_counts, entropy, file_growth

    growth = file_growth(files, commits).select(F.col("growth").alias("continuing_growth"))
    rates = with_seq(commits.select("ts", "sha"), "ts", "sha", total="n").groupBy(k_window(F.col("seq"), F.col("n"), windows)).agg(F.count("*").alias("rate"))
    even = rates.agg(F.when(F.count("*") < 2, 0.5).otherwise(clamp(1 - F.stddev_pop("rate") / F.avg("rate"))).alias("self_regulation"))
    authors = author_counts(commits)
    spread = entropy(authors, "n_commits").crossJoin(authors.agg(F.log2(F.greatest(F.lit(2), F.count("*"))).alias("most")))
    one = bundle.crossJoin(growth).crossJoin(even).crossJoin(spread.select(clamp(F.col("entropy") / F.col("most")).alias("organisational_stability")))
    return one.select(
        clamp(F.col("avg_churn_per_commit") / 200).alias("continuing_change"), clamp(F.col("file_touch_entropy") / 6).alias("increasing_complexity"), "continuing_growth",
        clamp(2.5 * F.col("revert_rate") + 0.5 * (1 - F.col("code_stability"))).alias("declining_quality"), (1 - F.col("continuing_growth")).alias("conservation_of_familiarity"),
        clamp(F.abs("momentum") / 2).alias("feedback_volatility"), "self_regulation", "organisational_stability",
    )


def law_support(tests: DataFrame) -> DataFrame:
    """(law, verdict) from trend tests (id, trend) of churn_rate, file_growth, revert_rate and work_rate; a law without its test has no row."""
    by = tests.groupBy().agg(*[F.max(F.when(F.col("id") == i, F.col("trend"))).alias(i) for i in ("churn_rate", "file_growth", "revert_rate", "work_rate")])
    rises = lambda c, down: F.when(F.col(c) == "rising", "support").when(F.col(c) == "flat", "weak").when(F.col(c).isNotNull(), down)
    even = F.when(F.col("work_rate") == "flat", "support").when(F.col("work_rate").isNotNull(), "contradict")
    rules = {
        "continuing_change": rises("churn_rate", "contradict"), "continuing_growth": rises("file_growth", "contradict"), "declining_quality": rises("revert_rate", "contradict"),
        "self_regulation": even, "organisational_stability": even, "increasing_complexity": rises("churn_rate", "weak"),
        "conservation_of_familiarity": F.when(F.col("file_growth") == "rising", "contradict").otherwise("support"), "feedback_system": F.lit("weak"),
    }
    rows = F.array(*[F.struct(F.lit(law).alias("law"), v.alias("verdict")) for law, v in rules.items()])
    return by.select(F.explode(rows).alias("r")).select("r.*").filter("verdict is not null")


def tool_findings(name: Column, size: Column, summary: Column) -> Column:
    """One line on a tool's output, from the number of things in it; null for other tools."""
    line = lambda word, unit: F.concat(F.lit(word + ":"), size.cast("string"), F.lit(unit))
    return (
        F.when(name == "grep", line("grep", " hits")).when(name == "web_search", line("web", " results")).when(name == "rag_query", line("rag", " chunks"))
        .when(name == "morpheme_scan", F.coalesce(summary, F.lit("morphemes"))).when(name == "provenance_hint", line("frames", "")).when(name == "file_read", line("read", " chars")).when(name == "graph_search", line("graph", " hits"))
    )


def pack_violations(packs: DataFrame, required: dict[str, str]) -> DataFrame:
    """(id, key, problem) of packs (id, body as JSON): keys that are missing, or of another JSON type than required."""
    parsed = packs.select("id", F.try_parse_json("body").alias("v"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    wanted = {"array": "ARRAY", "object": "OBJECT", "string": "STRING", "number": "(BIGINT|DECIMAL|DOUBLE)"}
    rows = [F.struct(F.lit(k).alias("key"), F.when(kind(k).isNull(), "missing").when(~kind(k).rlike("^" + wanted[t]), "type").alias("problem")) for k, t in required.items()]
    return parsed.select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.*").filter("problem is not null")


def evolution_corpus(commits: DataFrame) -> DataFrame:
    """(sha, words): one sentence per commit of subject, body, path words, a word for its churn and one for a revert."""
    from tidemark.functions.text import tokenize

    churn = F.when(F.col("churn") > 400, "churn_high").when(F.col("churn") > 50, "churn_mid").otherwise("churn_low")
    words = F.concat(tokenize(F.concat_ws(" ", "subject", F.coalesce("body", F.lit("")))), F.coalesce("path_words", F.array().cast("array<string>")), F.array(churn), F.when(F.col("is_revert"), F.array(F.lit("is_revert"))).otherwise(F.array().cast("array<string>")))
    return commits.select("sha", F.array_distinct(words).alias("words")).filter(F.size("words") >= 2)


def objective_score(diff: DataFrame, objectives: DataFrame) -> DataFrame:
    """(objective, ok) of objectives (objective, metric, target) against a snapshot's differences."""
    j = objectives.join(diff, "metric", "left")
    return j.select("objective", F.coalesce((F.col("verdict") == "better") | ((F.col("target").isNotNull()) & (F.col("value") >= F.col("target"))), F.lit(False)).alias("ok"))
