"""The streaming jobs run once over what lies in the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.graph import shared_dir
from tidemark.plans.registry import query
from tidemark.plans.series_queries import STORMS
from tidemark.streaming import ingest, jobs


def shared(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("churn"), F.col("event_type"), F.col("user_id").cast("string").alias("repo"))


@query("weekly_stream", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, round(sum(value), 4) AS churn FROM events GROUP BY 1")
def _(spark, d):
    """Equals the weekly table of a batch: all weeks are kept in complete mode, each batch replaces the result."""
    to = shared(spark)
    run = (
        jobs.weekly(event_stream(spark, d)).writeStream.outputMode("complete").option("checkpointLocation", f"{to}/state")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{to}/weeks")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{to}/weeks").select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n", F.round("churn", 4).alias("churn"))


@query("storm_stream", STORMS + " SELECT repo, epoch_us(ts) AS first, n FROM storms")
def _(spark, d):
    to = shared(spark)
    reverts = event_stream(spark, d).filter("event_type = 'error'").select("repo", "ts")
    run = (
        jobs.storms(reverts).writeStream.outputMode("update").option("checkpointLocation", f"{to}/state")
        .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{to}/storms/batch={k}")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return jobs.newest(spark.read.schema(jobs.STORM).parquet(f"{to}/storms").drop("batch")).select("repo", F.unix_micros("first").alias("first"), "n")


#: Kinds of the traces that events stand for, and what each refers to by the number in its properties.
_KINDS = {"click": ("tool", "path", "touches"), "view": ("rag", "frame", "cites"), "purchase": ("decision", "record", "allowed_because"), "error": ("pivot", "context", "joins")}


@query(
    "graph_stream",
    """WITH k AS (SELECT *, regexp_extract(props, '[0-9]+') AS num FROM events),
    t AS (SELECT 'e' || event_id AS id, CASE event_type WHEN 'click' THEN 'tool' WHEN 'view' THEN 'rag' WHEN 'purchase' THEN 'decision' WHEN 'error' THEN 'pivot' ELSE 'round' END AS kind, CAST(user_id AS VARCHAR) AS run, ts,
      CASE event_type WHEN 'click' THEN 'path:' WHEN 'view' THEN 'frame:' WHEN 'purchase' THEN 'record:' WHEN 'error' THEN 'context:' END || num AS ref,
      CASE event_type WHEN 'click' THEN 'touches' WHEN 'view' THEN 'cites' WHEN 'purchase' THEN 'allowed_because' WHEN 'error' THEN 'joins' END AS rel FROM k),
    ed AS (SELECT DISTINCT 'run:' || run AS source, id AS target, CASE kind WHEN 'tool' THEN 'invoked' WHEN 'rag' THEN 'retrieved' WHEN 'decision' THEN 'proposed' WHEN 'pivot' THEN 'pivots' ELSE 'spawned' END AS rel FROM t
      UNION SELECT id, ref, rel FROM t WHERE ref IS NOT NULL
      UNION SELECT id, nxt, 'next' FROM (SELECT id, lead(id) OVER (PARTITION BY run ORDER BY ts, id) AS nxt FROM t) WHERE nxt IS NOT NULL),
    no AS (SELECT id, kind FROM t UNION SELECT 'run:' || run, 'run' FROM t UNION SELECT ref, split_part(ref, ':', 1) FROM t WHERE ref IS NOT NULL)
    SELECT 'node ' || kind AS what, count(*) AS n FROM no GROUP BY 1 UNION ALL SELECT 'edge ' || rel, count(*) FROM ed GROUP BY 1""",
)
def _(spark, d):
    """The events as traces of runs, streamed into a graph; its nodes by kind and edges by relation."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    number = F.regexp_extract("props", "[0-9]+", 0)
    kind, ref = F.lit("round"), F.lit(None).cast("array<struct<id:string,kind:string,rel:string>>")
    for event, (own, other, rel) in _KINDS.items():
        kind = F.when(F.col("event_type") == event, own).otherwise(kind)
        ref = F.when(F.col("event_type") == event, F.array(F.struct(F.concat(F.lit(f"{other}:"), number).alias("id"), F.lit(other).alias("kind"), F.lit(rel).alias("rel")))).otherwise(ref)
    traces = raw.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("label"), F.lit(None).cast("string").alias("text"), ref.alias("refs"))
    path = shared(spark)
    ingest.start(traces, path).awaitTermination()
    nodes, edges = ingest.read_graph(spark, path)
    return nodes.groupBy(F.concat(F.lit("node "), "kind").alias("what")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.concat(F.lit("edge "), "rel").alias("what")).agg(F.count("*").alias("n")))
