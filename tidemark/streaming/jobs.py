"""The incremental jobs on Structured Streaming: weekly windows, trace replay, revert storms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def weekly(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(week, n, churn) over weeks from Monday; rows later than the watermark are dropped. The same on a batch."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    week = F.window("ts", "7 days", "7 days", "4 days")
    return rows.groupBy(week.alias("w")).agg(F.count("*").alias("n"), F.sum("churn").alias("churn")).select(F.col("w.start").alias("week"), "n", "churn")


def replay(traces: DataFrame, upsert: Callable[[DataFrame, DataFrame], None], late: str = "7 days"):
    """A writer that hands each batch's new traces on as nodes and edges; repeats within the watermark are dropped."""
    once = traces.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])

    def batch(df: DataFrame, _: int) -> None:
        nodes = df.select("id", "kind", F.col("outcome").alias("label"), F.lit(None).cast("string").alias("text"), F.unix_micros("at").alias("seq"))
        paths = df.select(F.col("id").alias("source"), F.explode("paths").alias("target"), F.lit("touches").alias("rel"))
        cites = df.select(F.col("id").alias("source"), F.explode("frames").alias("target"), F.lit("cites").alias("rel"))
        upsert(nodes, paths.unionByName(cites))

    return once.writeStream.foreachBatch(batch)


STORM = "repo string, first timestamp, n bigint"


def storms(events: DataFrame, days: int = 14, least: int = 3) -> DataFrame:
    """(repo, first, n) for each run of ``least`` or more reverts within ``days`` of its first, found greedily.

    In update mode: a storm is given as soon as it is one, and again whenever a batch adds to it (``newest`` keeps the last),
    so none waits for the stream to go on. The state of a repo is the times of less than ``least`` reverts, or a storm's
    first time and number; it is dropped once a run is over. A repo's reverts come in order from batch to batch.
    """
    span = int(pd.Timedelta(days=days).total_seconds() * 1_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out: dict[int, int] = {}
        if state.hasTimedOut:
            state.remove()
        else:
            for t in (pd.concat(list(frames))["ts"].sort_values().astype("datetime64[us]").astype("int64")).tolist():
                waiting = [x for x in waiting if t - x <= span]
                if n >= least and waiting:
                    n += 1
                else:
                    waiting.append(t)
                    n = len(waiting)
                if n >= least:
                    waiting = waiting[:1]
                    out[waiting[0]] = n
            state.update((waiting, n))
            state.setTimeoutTimestamp(max((waiting[-1] + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame({"repo": [key[0]] * len(out), "first": pd.to_datetime(list(out), unit="us"), "n": list(out.values())})

    return events.withWatermark("ts", f"{days} days").groupBy("repo").applyInPandasWithState(step, STORM, "waiting array<bigint>, n bigint", "update", GroupStateTimeout.EventTimeTimeout)


def newest(updates: DataFrame) -> DataFrame:
    """The last state of each storm of a stream of updates."""
    return updates.groupBy("repo", "first").agg(F.max("n").alias("n"))
