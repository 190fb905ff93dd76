"""Time series over a change log: weeks and months, z-scores, trends, changepoints, responses, episodes."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.operators import asof
from tidemark.operators.graph import cut


def week_key(ts: Column) -> Column:
    """ISO week, as 2024-W05."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def week_month(ts: Column) -> Column:
    """Month of the Monday of a time's ISO week."""
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def weekly(events: DataFrame) -> DataFrame:
    """(week, n, churn, intensity) of rows (ts, churn); intensity is churn per commit."""
    return events.groupBy(week_key(F.col("ts")).alias("week")).agg(F.count("*").alias("n"), F.sum("churn").alias("churn")).withColumn("intensity", F.col("churn") / F.col("n"))


def monthly(commits: DataFrame) -> DataFrame:
    """(month, n_commits, n_authors, n_reverts, churn); months without commits have no row."""
    return commits.groupBy(month_key(F.col("ts")).alias("month")).agg(
        F.count("*").alias("n_commits"), F.countDistinct(F.coalesce(F.col("email").cast("string"), F.col("author"))).alias("n_authors"), F.count_if("is_revert").alias("n_reverts"), F.sum("churn").alias("churn")
    )


def fatigue(commits: DataFrame, day_start: int = 9, day_end: int = 18) -> DataFrame:
    """One row: share of work after hours, at weekends and at the end of weeks, growth of weekly intensity, recovery, score.

    Weeks are few; their order is taken over the weekly table only.
    """
    hour, day = F.hour("ts"), F.dayofweek("ts")
    base = commits.agg(F.avg(((hour < day_start) | (hour >= day_end)).cast("int")).alias("after_hours"), F.avg(day.isin(1, 7).cast("int")).alias("weekend"))
    per_week = Window.partitionBy("week")
    placed = commits.select("ts", "sha", week_key(F.col("ts")).alias("week")).select(F.row_number().over(per_week.orderBy("ts", "sha")).alias("k"), F.count("*").over(per_week).alias("n"))
    late = placed.filter("n >= 5").agg(F.coalesce(F.avg((F.col("k") > F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))).cast("int")), F.lit(0.0)).alias("week_end"))
    weeks = weekly(commits)
    order = Window.orderBy("week")
    every = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle = F.element_at(F.array_sort(F.collect_list("intensity").over(every)), (F.floor(F.count("*").over(every) / 2) + 1).cast("int"))
    steps = weeks.select("intensity", F.row_number().over(order).alias("k"), F.count("*").over(every).alias("w"), middle.alias("mid"), F.lead("intensity").over(order).alias("nxt"))
    recent = F.col("k") > F.col("w") - F.greatest(F.lit(1), F.floor(F.col("w") / 3))
    peak, rest = F.col("intensity") >= 1.25 * F.col("mid"), F.col("nxt") <= 0.75 * F.col("mid")
    series = steps.agg(
        F.avg(F.when(recent, F.col("intensity"))).alias("r"), F.coalesce(F.avg(F.when(~recent, F.col("intensity"))), F.lit(0.0)).alias("o"),
        F.count_if(peak & F.col("nxt").isNotNull()).alias("peaks"), F.count_if(peak & rest).alias("rests"),
    )
    one = base.crossJoin(late).crossJoin(series)
    one = one.withColumn("creep", F.greatest(F.lit(0.0), (F.col("r") - F.col("o")) / (F.col("o") + 1))).withColumn("recovery", F.when(F.col("peaks") == 0, 1.0).otherwise(F.col("rests") / F.greatest(F.lit(1), F.col("peaks"))))
    score = 0.35 * F.col("after_hours") + 0.2 * F.col("weekend") + 0.25 * F.least(F.lit(1.0), F.col("creep")) + 0.1 * (1 - F.col("recovery")) + 0.1 * F.col("week_end")
    return one.select("after_hours", "weekend", "week_end", "creep", "recovery", F.least(F.lit(1.0), score).alias("fatigue"))


def z_scores(series: DataFrame, *columns: str) -> DataFrame:
    """Columns as z-scores (population deviation; 0 where it vanishes), from two one-row aggregates."""
    stats = series.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {f"z_{c}": F.when(F.col(f"_s_{c}") < 1e-9, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return series.crossJoin(F.broadcast(stats)).withColumns(z).drop(*stats.columns)


def state_samples(months: DataFrame, load: DataFrame) -> DataFrame:
    """Monthly states: z-scored activity, authors, churn, instability and load (month, load)."""
    base = months.join(load, "month", "left").select(
        "month", F.col("n_commits").cast("double").alias("activity"), F.col("n_authors").cast("double").alias("authors"), F.col("churn").cast("double").alias("churn"),
        (F.col("n_reverts") / F.col("n_commits")).alias("instability"), F.coalesce("load", F.lit(0.0)).alias("load"),
    )
    return z_scores(base, "activity", "authors", "churn", "instability", "load")


def monthly_load(commits: DataFrame) -> DataFrame:
    """(month, load): the greatest weekly intensity, by the month of the week's Monday."""
    weeks = commits.groupBy(F.date_trunc("week", "ts").alias("monday")).agg((F.sum("churn") / F.count("*")).alias("intensity"))
    return weeks.groupBy(F.date_format("monday", "yyyy-MM").alias("month")).agg(F.max("intensity").alias("load"))


def impulse_responses(samples: DataFrame, events: DataFrame, column: str, horizon: int = 3) -> DataFrame:
    """(label, month, pre, post, response, confidence): a column's mean in the months before an event against those from it on."""
    order = Window.orderBy("month")  # months: few rows
    ranked = samples.select(
        "month", F.row_number().over(order).alias("k"), F.avg(column).over(order.rowsBetween(-horizon, -1)).alias("pre"), F.avg(column).over(order.rowsBetween(0, horizon - 1)).alias("post"),
        F.count("*").over(order.rowsBetween(-horizon, -1)).alias("n_pre"), F.count("*").over(order.rowsBetween(0, horizon - 1)).alias("n_post"),
    )
    number = lambda c: F.year(c) * 12 + F.month(c)
    months = ranked.withColumn("at", number(F.to_date("month", "yyyy-MM")).cast("bigint"))
    near = asof.nearest(events.select("label", number("at").cast("bigint").alias("at")), months, [], 12).select("label", "hit.*")
    near = near.groupBy("label").agg(F.first(F.struct("month", "pre", "post", "n_pre", "n_post")).alias("s")).select("label", "s.*")
    return near.filter("n_pre > 0").select(
        "label", "month", "pre", "post", (F.col("post") - F.col("pre")).alias("response"), F.least(F.lit(0.9), 0.35 + 0.1 * F.col("n_pre") + 0.1 * F.col("n_post")).alias("confidence")
    )


def mann_kendall(series: DataFrame) -> DataFrame:
    """(id, n, s, tau, slope) of rows (id, t, x): pairs within a series; the slope is the upper median of pairwise slopes.

    p-values and labels: ``with_trend_labels``.
    """
    a, b = series.select("id", F.col("t").alias("t1"), F.col("x").alias("x1")), series.select("id", F.col("t").alias("t2"), F.col("x").alias("x2"))
    pairs = a.join(b, "id").filter("t1 < t2").select("id", F.signum(F.col("x2") - F.col("x1")).alias("sign"), ((F.col("x2") - F.col("x1")) / (F.col("t2") - F.col("t1"))).alias("slope"))
    n = series.groupBy("id").agg(F.count("*").alias("n"))
    out = pairs.groupBy("id").agg(F.sum("sign").cast("bigint").alias("s"), F.count("*").alias("m"), F.array_sort(F.collect_list("slope")).alias("slopes"))
    return out.join(n, "id").select("id", "n", "s", (F.col("s") / F.col("m")).alias("tau"), F.element_at("slopes", (F.floor(F.col("m") / 2) + 1).cast("int")).alias("slope"))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def with_trend_labels(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Adds p (normal approximation, no ties) and the trend's label."""
    n, s = F.col("n"), F.col("s")
    deviation = F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    z = F.when(s > 0, (s - 1) / deviation).when(s < 0, (s + 1) / deviation).otherwise(0.0)
    out = tests.withColumn("p", erfc(F.abs(z) / math.sqrt(2)))
    return out.withColumn("trend", F.when(F.col("p") >= level, "flat").when(s > 0, "rising").otherwise("falling"))


def binary_segmentation(values: np.ndarray, penalty: float = 0.75, min_seg: int = 3, max_cps: int = 8) -> list[int]:
    """Places where splitting a piece lowers the squared error by more than max(1, variance) * ln n * penalty, best first."""
    n = len(values)
    if n < 2 * min_seg:
        return []
    s, q = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])

    def error(a: int, b) -> np.ndarray:
        return q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)

    limit = max(1.0, float(np.var(values))) * math.log(n) * penalty
    cuts, pieces = [], [(0, n)]
    while len(cuts) < max_cps:
        best = None
        for a, b in pieces:
            if b - a < 2 * min_seg:
                continue
            at = np.arange(a + min_seg, b - min_seg + 1)
            gain = error(a, b) - (error(a, at) + (q[b] - q[at] - (s[b] - s[at]) ** 2 / (b - at)))
            k = int(gain.argmax())
            if gain[k] > limit and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), int(at[k]), (a, b))
        if best is None:
            break
        _, at, piece = best
        cuts.append(at)
        pieces.remove(piece)
        pieces += [(piece[0], at), (at, piece[1])]
    return sorted(cuts)


def cusum(values: np.ndarray, factor: float = 1.5, min_seg: int = 3) -> list[int]:
    """Places where a two-sided running sum of deviations passes factor * sd * sqrt(n).

    They lie ``min_seg`` or more apart and from both ends; the sums start afresh at each, and go on where a place is too near.
    """
    n, sd = len(values), float(np.std(values))
    if n < 2 * min_seg or sd < 1e-9:
        return []
    mean, limit = float(values.mean()), factor * sd * math.sqrt(n)
    out, up, down = [], 0.0, 0.0
    for i, gap in enumerate((values - mean).tolist()):
        up, down = max(0.0, up + gap), min(0.0, down + gap)
        far = i - (out[-1] if out else 0) >= min_seg and i <= n - min_seg
        if far and max(up, -down) > limit:
            out.append(i)
            up = down = 0.0
    return out


def changepoints(series: DataFrame, finder: Callable[[np.ndarray], list[int]] | None = None, min_seg: int = 3) -> DataFrame:
    """(id, t, index, direction, magnitude, before_mean, after_mean) of rows (id, t, x), one task per series.

    Means are over the whole prefix and suffix; weak changes and those within ``min_seg`` of an end are left out. A change is
    weak under 0.15 of the series' mean (1 at least), or of a series of reverts, whose id starts so, under 0.25.
    """
    find = finder or (lambda v: sorted({*binary_segmentation(v), *cusum(v)}))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, rows = pdf["x"].to_numpy(float), []
        margin = 0.25 if str(pdf["id"].iloc[0]).startswith("revert") else 0.15 * max(1.0, float(x.mean()))
        for i in find(x):
            if not min_seg <= i <= len(x) - min_seg:
                continue
            before, after = float(x[:i].mean()), float(x[i:].mean())
            if abs(after - before) >= margin:
                rows.append((pdf["id"].iloc[0], pdf["t"].iloc[i], i, "up" if after > before else "down", abs(after - before), before, after))
        return pd.DataFrame(rows, columns=["id", "t", "index", "direction", "magnitude", "before_mean", "after_mean"])

    kind = dict(series.dtypes)
    return series.select("id", "t", F.col("x").cast("double").alias("x")).groupBy("id").applyInPandas(run, f"id string, t {kind['t']}, index bigint, direction string, magnitude double, before_mean double, after_mean double")


def storms(events: DataFrame, days: int = 14, least: int = 3) -> DataFrame:
    """(repo, first, last, at, n, confidence): runs of ``least`` or more reverts within ``days`` of the run's first, found greedily."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times, rows, i = pdf["ts"].sort_values().tolist(), [], 0
        while i < len(times):
            j = i
            while j + 1 < len(times) and times[j + 1] - times[i] <= pd.Timedelta(days=days):
                j += 1
            n = j - i + 1
            if n >= least:
                rows.append((pdf["repo"].iloc[0], times[i], times[j], times[i + n // 2], n, min(0.95, 0.55 + 0.05 * n)))
                i = j + 1
            else:
                i += 1
        return pd.DataFrame(rows, columns=["repo", "first", "last", "at", "n", "confidence"])

    return events.select("repo", "ts").groupBy("repo").applyInPandas(run, "repo string, first timestamp, last timestamp, at timestamp, n bigint, confidence double")


def changepoint_bounds(points: DataFrame, most: int = 8, confidence: float = 0.45) -> DataFrame:
    """(repo, at, stage, confidence) of the ``most`` greatest changepoints (repo, id, t, direction, magnitude) of each repository.

    Equal magnitudes: the earlier stays, then the lesser id.
    """
    up, reverts = F.col("direction") == "up", F.col("id").startswith("revert")
    down = ~up & F.col("id").isin("commits", "churn")
    stage = F.when(up & reverts, "disturbance").when(down, "consolidation").when(~up & (F.col("id") == "authors"), "decline").otherwise("growth")
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("magnitude"), "t", "id"))
    return points.withColumn("_r", rank).filter(F.col("_r") <= most).select("repo", F.col("t").cast("timestamp").alias("at"), stage.alias("stage"), F.lit(confidence).alias("confidence"))


def segments(bounds: DataFrame, days: int = 14, spans: DataFrame | None = None) -> DataFrame:
    """(repo, start, end, stage, confidence): bounds (repo, at, stage, confidence) closer than ``days`` merge, the surer stays.

    A fold over each repository's sorted bounds; they are anchors and a few changepoints, never raw rows. With spans
    (repo, first, last) of all commits, a pioneer segment leads where the first bound lies over a week in, and the last one ends with the span.
    """
    item = "struct<at:timestamp,stage:string,confidence:double>"
    ordered = bounds.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("at", "stage", "confidence"))).alias("b"))
    gap = F.expr(f"interval {days} days")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        close = (F.size(acc) > 0) & (x["at"] < last["at"] + gap)
        surer = F.when(x["confidence"] > last["confidence"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)
        return F.when(close, surer).otherwise(F.concat(acc, F.array(x)))

    merged = ordered.select("repo", F.aggregate("b", F.array().cast(f"array<{item}>"), step).alias("b")).select("repo", F.posexplode("b").alias("k", "x")).select("repo", "k", "x.*")
    end = F.coalesce(F.lead("at").over(Window.partitionBy("repo").orderBy("k")), F.col("at") + F.expr("interval 1 day"))
    out = merged.select("repo", F.col("at").alias("start"), F.greatest(end, F.col("at") + F.expr("interval 1 day")).alias("end"), "stage", "confidence")
    if spans is None:
        return out
    own = Window.partitionBy("repo")
    placed = out.join(spans, "repo").withColumns({"_head": F.min("start").over(own), "_tail": F.max("start").over(own)})
    closed = placed.withColumn("end", F.when(F.col("start") == F.col("_tail"), F.when(F.col("last") > F.col("start"), F.col("last")).otherwise(F.col("end"))).otherwise(F.col("end")))
    lead = closed.filter((F.col("start") == F.col("_head")) & (F.col("start") > F.col("first") + F.expr("interval 7 days")))
    return closed.select(*out.columns).unionByName(lead.select("repo", F.col("first").alias("start"), F.col("start").alias("end"), F.lit("pioneer").alias("stage"), F.lit(0.55).alias("confidence")))


def nearest_within(events: DataFrame, points: DataFrame, days: int = 45) -> DataFrame:
    """(label, at, point, gap): the nearest point in time within ``days``, or none. Points are joined by buckets of days.

    Every event looks into its bucket and the two beside it, so neither side is broadcast or crossed.
    """
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / days)
    left = events.withColumn("_b", F.explode(F.array(bucket("at") - 1, bucket("at"), bucket("at") + 1)))
    right = points.select(F.col("at").alias("point"), bucket("at").alias("_b"))
    gap = F.abs(F.datediff("point", "at"))
    near = left.join(right, "_b").withColumn("gap", gap).filter(F.col("gap") <= days).groupBy("label", "at").agg(F.min(F.struct("gap", "point")).alias("s"))
    return events.join(near, ["label", "at"], "left").select("label", "at", F.col("s.point").alias("point"), F.col("s.gap").alias("gap"))


def within_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(span, n, churn): what lies inside each span (span, start, due); open ends reach all the way."""
    bounds = spans.select("span", asof.micros(F.col("start")).alias("start"), asof.micros(F.col("due")).alias("due"))
    return asof.within(bounds, rows.select(asof.micros(F.col("ts")).alias("at"), "churn"), ["churn"], asof.DAY).select("span", "n", "churn")


def stage_at(times: DataFrame, segs: DataFrame) -> DataFrame:
    """(label, stage, confidence): the segment that holds a time, else the last one before it at nine tenths of its confidence.

    Segments follow each other, as those that ``stage_spans`` gives.
    """
    starts = segs.select(asof.micros(F.col("start")).alias("at"), asof.micros(F.col("end")).alias("end"), "stage", "confidence")
    asked = times.select("label", asof.micros(F.col("at")).alias("at"))
    confidence = F.when(F.col("at") < F.col("hit.end"), F.col("hit.confidence")).otherwise(F.col("hit.confidence") * 0.9)
    return asof.last_before(asked, starts, [], asof.DAY, order="end").select("label", F.col("hit.stage").alias("stage"), confidence.alias("confidence"))


def basins(samples: DataFrame, segs: DataFrame, fallback: int = 3) -> DataFrame:
    """(stage, start, months, occupancy, mean_activity): months that fall into each segment.

    A segment without any takes the first ``fallback`` months from its start on. Segments are spread over their months, so months meet by equality.
    """
    total = samples.agg(F.count("*").alias("_all"))
    first = F.trunc(F.col("start"), "month")
    spread = segs.select("stage", "start", "end", F.explode(F.sequence(first, F.greatest(first, F.trunc(F.col("end"), "month")), F.expr("interval 1 month"))).alias("_m"))
    inside = spread.filter(F.date_format("_m", "yyyy-MM") <= F.date_format("end", "yyyy-MM")).select("stage", "start", F.date_format("_m", "yyyy-MM").alias("month"))
    got = inside.join(samples.select("month", "activity"), "month").select("stage", "start", "activity")
    # Months that any segment without samples could start from, three on from each month: by a lead, then one as-of join.
    order = Window.orderBy("month")  # months: few rows
    ahead = samples.select(F.to_date("month", "yyyy-MM").alias("_d"), F.collect_list("activity").over(order.rowsBetween(0, fallback - 1)).alias("next"))
    months = ahead.select((-(F.year("_d") * 12 + F.month("_d"))).cast("bigint").alias("at"), "next")
    empty = segs.select("stage", "start").join(got.select("stage", "start").distinct(), ["stage", "start"], "left_anti")
    asked = empty.withColumn("at", (-(F.year("start") * 12 + F.month("start"))).cast("bigint"))
    late = asof.last_before(asked, months, [], 12).filter("hit IS NOT NULL").select("stage", "start", F.explode("hit.next").alias("activity"))
    counted = got.unionByName(late).groupBy("stage", "start").agg(F.count("*").alias("months"), F.avg("activity").alias("mean_activity"))
    return counted.crossJoin(F.broadcast(total)).select("stage", "start", "months", (F.col("months") / F.col("_all")).alias("occupancy"), "mean_activity")


#: Series that speak for an event first, and those for events of trouble (fixed values).
PREFERRED, TROUBLED = ("commits", "authors", "churn"), ("reverts", "commits", "churn")
TROUBLE_KINDS = ("security", "revert_storm")


def anchors(events: DataFrame, points: DataFrame, days: int = 45) -> DataFrame:
    """(label, kind, at, series, direction, gap_days, stage, confidence) of events (label, kind, at, stage, confidence).

    Each event takes the nearest changepoint (at, series, direction, magnitude) within ``days`` among the strongest third (six at least) of the
    series its kind prefers, else the nearest of all. A changepoint adds confidence and may turn the stage; without one it falls.
    """
    strong = F.row_number().over(Window.orderBy(F.desc("magnitude"), "at", "series")) <= F.greatest(F.lit(6), F.floor(F.count("*").over(Window.partitionBy()) / 3))
    ranked = points.select(asof.micros(F.col("at")).alias("at"), "series", "direction", "magnitude", strong.alias("strong"))  # changepoints of monthly series: few rows
    ranked = cut(ranked.withColumn("place", F.struct(-F.col("magnitude"), "series")), "changepoints")
    asked = events.select(F.col("label"), "kind", F.col("at").alias("_at"), "stage", "confidence", asof.micros(F.col("at")).alias("at"), F.col("kind").isin(*TROUBLE_KINDS).alias("trouble"))
    asked = cut(asked, "events")
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("series").isin(*PREFERRED), False), F.when(F.col("series").isin(*TROUBLED), True))))
    first = asof.nearest(asked, ranked.filter("strong").withColumn("trouble", kinds), ["trouble"], asof.DAY * days, "place")
    close = lambda: F.col("gap") <= days * asof.DAY
    first = first.select(*asked.columns, F.when(close(), F.struct("hit.series", "hit.direction", "gap")).alias("mine"))
    first = cut(first, "preferred")
    both = asof.nearest(first, ranked, [], asof.DAY * days, "place")
    both = both.withColumn("hit", F.coalesce("mine", F.when(close(), F.struct("hit.series", "hit.direction", "gap")))).select(*asked.columns, "hit")
    gap = F.col("hit.gap") / F.lit(float(asof.DAY))
    stage = (
        F.when((F.col("stage") == "growth") & (F.col("hit.direction") == "down") & F.col("hit.series").isin("commits", "churn"), "consolidation")
        .when((F.col("stage") == "maturity") & (F.col("hit.direction") == "up") & (F.col("hit.series") == "reverts"), "disturbance")
        .otherwise(F.col("stage"))
    )
    more = F.least(F.lit(0.98), F.col("confidence") + 0.08 + F.greatest(F.lit(0.0), 0.12 * (1 - gap / days)))
    return both.select("label", "kind", F.col("_at").alias("at"), "hit.series", "hit.direction", gap.alias("gap_days"), stage.alias("stage"), F.when(F.col("hit").isNull(), F.col("confidence") * 0.85).otherwise(more).alias("confidence"))


def path_episodes(rows: DataFrame, gap: int = 5) -> DataFrame:
    """(path, episode, touches, first, last) of ordered rows (path, pos, item): groups of ``gap`` touches of a path."""
    k = F.floor((F.row_number().over(Window.partitionBy("path").orderBy("pos", "item")) - 1) / gap)
    return rows.withColumn("episode", k).groupBy("path", "episode").agg(
        F.count("*").alias("touches"), F.min(F.struct("pos", "item")).getField("item").alias("first"), F.max(F.struct("pos", "item")).getField("item").alias("last")
    )


def file_episodes(touches: DataFrame, gap: int = 5) -> DataFrame:
    """(path, episode, touches, churn, first_sha, last_sha, clade) of touches (path, ts, sha, churn, clade).

    Groups of ``gap`` touches of a path in order of time, then sha; the clade is the last touch's, else the first's.
    """
    place = F.row_number().over(Window.partitionBy("path").orderBy("ts", "sha"))
    at = F.struct("ts", "sha")
    got = touches.withColumn("episode", F.floor((place - 1) / gap)).groupBy("path", "episode").agg(
        F.count("*").alias("touches"), F.sum("churn").alias("churn"), F.min_by("sha", at).alias("first_sha"), F.max_by("sha", at).alias("last_sha"),
        F.coalesce(F.max_by("clade", at), F.min_by("clade", at)).alias("clade"),
    )
    return got


def dominant_responses(samples: DataFrame, events: DataFrame, *columns: str, horizon: int = 3) -> DataFrame:
    """(label, coordinate, response, confidence): which of the columns of monthly samples moves most after each event.

    Equal moves: the coordinate named first.
    """
    each = [impulse_responses(samples, events, c, horizon).select("label", F.lit(c).alias("coordinate"), F.lit(-k).alias("_k"), "response", "confidence") for k, c in enumerate(columns)]
    most = F.max_by(F.struct("coordinate", "response", "confidence"), F.struct(F.abs("response"), "_k"))
    return reduce(DataFrame.unionByName, each).groupBy("label").agg(most.alias("s")).select("label", "s.*")


def hit_rate(points: DataFrame, events: DataFrame, days: int = 45) -> DataFrame:
    """One row: the share of points in time with an event within ``days``."""
    near = nearest_within(points.select(F.col("at").cast("string").alias("label"), "at"), events, days)
    return near.agg(F.count("*").alias("points"), F.count("gap").alias("hits")).withColumn("rate", F.col("hits") / F.greatest(F.lit(1), F.col("points")))


def presence_shift(terms: DataFrame, least: float = 0.002) -> DataFrame:
    """(term, early, late, shift): shares of a term (term, early flag) in both halves; slight shifts are dropped."""
    totals = terms.agg(F.count_if("early").alias("_e"), F.count_if(~F.col("early")).alias("_l"))
    per = terms.groupBy("term").agg(F.count_if("early").alias("e"), F.count_if(~F.col("early")).alias("l")).crossJoin(F.broadcast(totals))
    e, late = F.col("e") / F.greatest(F.lit(1), F.col("_e")), F.col("l") / F.greatest(F.lit(1), F.col("_l"))
    return per.select("term", e.alias("early"), late.alias("late"), (late - e).alias("shift")).filter(F.abs("shift") >= least)
