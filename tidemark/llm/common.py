"""Shared helpers: tables, lineage cuts and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document id that is null sorts before every real one; this stands for it inside a job.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint directory.

    Where the session names none, a local master (tests) gets a temporary one; a cluster is refused.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's rows to the shared folder and read them again.

    It cuts the lineage and lets several consumers share one computation; Parquet keeps only what is asked for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def with_defaults(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator needs, so that others, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])
