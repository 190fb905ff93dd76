"""Traces streamed into a context graph: every batch's nodes and edges are written once, however often it runs.

A trace is a row (id, kind, at, run, label, text, refs) where ``refs`` names what it touches, cites, joins and so on as
(id, kind, rel), so all kinds of nodes and relations come the same way. A batch replaces its own folder, so one that was killed halfway and
runs again leaves the same rows; readers merge by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import graph

TRACE = "id string, kind string, at timestamp, run string, label string, text string, refs array<struct<id:string,kind:string,rel:string>>"
NODES, EDGES = "id string, kind string, label string, text string, seq bigint, run string", "source string, target string, rel string"
#: What a trace is to its run, by kind (fixed values); others are invoked by it.
OF_RUN = {"round": "spawned", "subagent": "spawned", "decision": "proposed", "proposal": "proposed", "score": "scored", "rag": "retrieved", "memory": "retrieved", "morpheme": "retrieved", "reflection": "reflects", "pivot": "pivots"}


def projected(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of traces: themselves, their runs and all they refer to."""
    seq = F.unix_micros("at")
    known = traces.filter("id IS NOT NULL")
    own = known.select("id", F.coalesce("kind", F.lit("context")).alias("kind"), "label", "text", seq.alias("seq"), "run")
    none = F.lit(None).cast("string")
    runs = known.filter("run IS NOT NULL").select(F.concat(F.lit("run:"), "run").alias("id"), F.lit("run").alias("kind"), F.col("run").alias("label"), none.alias("text"), seq.alias("seq"), "run")
    each = known.select("id", F.explode("refs").alias("r"), seq.alias("seq")).filter("r.id IS NOT NULL")
    # What is only referred to comes after any trace of its own, whose label and kind are kept.
    named = each.select("r.id", "r.kind", F.element_at(F.split("r.id", ":"), -1).alias("label"), none.alias("text"), (F.col("seq") + F.lit(1 << 60)).alias("seq"), none.alias("run"))
    rels = F.create_map(*[F.lit(x) for kv in OF_RUN.items() for x in kv])
    of_run = known.filter("run IS NOT NULL").select(F.concat(F.lit("run:"), "run").alias("source"), F.col("id").alias("target"), F.coalesce(rels[F.col("kind")], F.lit("invoked")).alias("rel"))
    return own.unionByName(runs).unionByName(named), of_run.unionByName(each.select(F.col("id").alias("source"), F.col("r.id").alias("target"), "r.rel"))


def write_batch(traces: DataFrame, batch: int, path: str) -> None:
    """Puts a batch's rows in its own folder in place of what is there."""
    kept = traces.persist()
    nodes, edges = projected(kept)
    nodes.dropDuplicates().write.mode("overwrite").parquet(f"{path}/nodes/batch={batch}")
    edges.dropDuplicates().write.mode("overwrite").parquet(f"{path}/edges/batch={batch}")
    kept.unpersist()


def start(traces: DataFrame, path: str, write=write_batch, **trigger):
    """Runs a stream of traces into the graph at ``path``; started again it goes on where it was."""
    writer = traces.writeStream.foreachBatch(lambda df, k: write(df, k, path)).option("checkpointLocation", f"{path}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all batches: nodes merged by id, edges once, and ``next`` from each trace of a run to the one after it.

    Batches may overlap or repeat rows: the graph is the same.
    """
    rows = spark.read.schema(NODES).parquet(f"{path}/nodes").drop("batch")
    links = spark.read.schema(EDGES).parquet(f"{path}/edges").drop("batch")
    told = rows.filter((F.col("run").isNotNull()) & (F.col("kind") != "run")).groupBy("run", "id").agg(F.min("seq").alias("seq"))
    after = told.select(F.col("id").alias("source"), F.lead("id").over(Window.partitionBy("run").orderBy("seq", "id")).alias("target"), F.lit("next").alias("rel")).filter("target IS NOT NULL")
    return graph.build(rows, links.unionByName(after))


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Writes the graph's rows, each once, as the first batch of another folder, for a stream that starts anew there."""
    for part, schema in (("nodes", NODES), ("edges", EDGES)):
        spark.read.schema(schema).parquet(f"{path}/{part}").drop("batch").dropDuplicates().write.mode("overwrite").parquet(f"{into}/{part}/batch=-1")
