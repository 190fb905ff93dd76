"""Retrieval over file chunks: chunks of whole lines that end at definitions and blank lines, hash vectors, and an exact search by blocks of queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import hash_index, hash_sign, tokenize
from tidemark.operators.graph import cut

#: A line at which a chunk may end: blank, or one that opens a definition (a fixed value).
BOUNDARY = re.compile(r"^\s*(def |class |function |export |pub )")
DIM = 64


def line_spans(lines: list[str], size: int = 700, overlap: int = 80) -> Iterator[tuple[int, int]]:
    """(first, last) line of each chunk, from 1: it ends at a boundary line once it has ``size`` letters, at any line once it has 1.4 times that.

    The next chunk begins with the last lines of the one before, as many as make ``overlap`` letters.
    """
    ends = np.cumsum([0, *[len(x) + 1 for x in lines]])
    first = 1
    for i, line in enumerate(lines, 1):
        held = ends[i] - ends[first - 1]
        if held >= size and (held >= 1.4 * size or not line.strip() or BOUNDARY.match(line)):
            yield first, i
            first = max(first, int(np.searchsorted(ends, ends[i] - overlap, "right")))
    if lines:
        yield first, len(lines)


def line_chunks(files: DataFrame, size: int = 700, overlap: int = 80) -> DataFrame:
    """(id, path, index, first, last, text) of files (path, text): whole texts, chunks of white space alone left out.

    An id is made of the path, the number and a digest of those and the chunk's first letters, so it changes with the chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                lines = text.split("\n") if text else []
                spans = list(line_spans(lines, size, overlap))
                bodies = [("\n".join(lines[a - 1 : b]).strip(), a, b) for a, b in spans]
                rows = [(path, k, a, b, body) for k, (body, a, b) in enumerate(x for x in bodies if x[0])]
                yield pd.DataFrame(rows, columns=["path", "index", "first", "last", "body"])

    got = files.select(F.col("path").cast("string").alias("path"), "text").mapInPandas(run, "path string, index bigint, first bigint, last bigint, body string")
    name = F.concat_ws(":", "path", "index")
    digest = F.substring(F.sha1(F.concat(name, F.lit(":"), F.substring("body", 1, 80))), 1, 12)
    head = F.concat(F.lit("FILE "), "path", F.lit(" L"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit("\n"), "body")
    return got.select(F.concat(name, F.lit(":"), digest).alias("id"), "path", "index", "first", "last", head.alias("text"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, index, sign) -> (id, v): the signs of each row's words summed by index."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, sign = (batch.column(c) for c in ("index", "sign"))
        row = np.repeat(np.arange(batch.num_rows), np.asarray(at.value_lengths()))
        sums = np.bincount(row * DIM + at.flatten().to_numpy(), sign.flatten().to_numpy(), batch.num_rows * DIM).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * DIM), pa.array(sums))], names=["id", "v"])


def dense(rows: DataFrame) -> DataFrame:
    """(id, v): hash vectors of rows (id, text) as arrays of whole numbers; texts without words have none.

    A row's words are summed where it is read, so only its vector is shuffled, to add up rows of one id.
    """
    words = rows.select("id", tokenize(F.col("text")).alias("w")).filter(F.size("w") > 0)
    hashed = words.select("id", F.transform("w", lambda t: hash_index(t, DIM).cast("int")).alias("index"), F.transform("w", lambda t: hash_sign(t).cast("int")).alias("sign"))
    own = hashed.mapInArrow(_vectors, f"id {dict(rows.dtypes)['id']}, v array<bigint>")
    every = own.groupBy("id").agg(F.collect_list("v").alias("vs"))
    return every.select("id", F.aggregate(F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(0))), F.col("vs")[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y)).alias("v")).filter(F.exists("v", lambda x: x != 0))


def nearest(queries: DataFrame, items: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): each query's k items (id, v) of greatest cosine, ties by id; exact.

    Queries (query_id, v) are taken in blocks of a fixed size, each multiplied with the items' vectors as these are read. A task keeps k items
    per query; a block's best are written before the next begins and its broadcast is given back.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)["id"]
    numbered = cut(queries.select("query_id", "v").withColumn("_b", F.expr(f"floor((row_number() OVER (PARTITION BY pmod(xxhash64(query_id), 64) ORDER BY query_id) - 1) / {max(1, block // 64)})")), "queries")
    parts = [r["_b"] for r in numbered.select("_b").distinct().collect()]
    items = cut(items.select("id", "v"), "vectors") if len(parts) > 1 else items.select("id", "v")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, score double"
    out = spark.createDataFrame([], schema)
    for b in sorted(parts):
        own = numbered.filter(F.col("_b") == b).toPandas()  # at most ``block`` rows and those of uneven hashes
        shared = spark.sparkContext.broadcast((own["query_id"].tolist(), np.array(own["v"].tolist(), float)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            norms = (q * q).sum(axis=1)
            best: list[list[tuple]] = [[] for _ in names]
            for pdf in frames:
                if not len(pdf):
                    continue
                v, own = np.array(pdf["v"].tolist(), float), pdf["id"].tolist()
                score = (q @ v.T) / np.sqrt(norms[:, None] * (v * v).sum(axis=1)[None, :])
                floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(names), -np.inf)
                for i, low in enumerate(floor):
                    found = np.flatnonzero(score[i] >= low)
                    best[i] = sorted([*best[i], *[(-score[i, j], own[j]) for j in found]])[:k]
            rows = [(n, j, -s) for n, own in zip(names, best, strict=True) for s, j in own]
            yield pd.DataFrame(rows, columns=["query_id", "id", "score"])

        found = items.mapInPandas(run, schema)
        last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        found = cut(found.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= k).drop("_r"), "nearest")
        shared.destroy()
        out = out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "id", "score")


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = 8, members: DataFrame | None = None, outside: float = 0.55, widen: int = 4, most: int = 40) -> DataFrame:
    """(query_id, rank, id, path, first, last, score): the k chunks most like each query (query_id, text).

    With ``members`` (query_id, path), ``widen`` times as many are fetched, ``most`` at most, and those of other paths count ``outside`` times as much.
    """
    chunks = cut(chunks, "chunks")
    fetch = min(most, max(k, k * widen)) if members is not None else k
    near = nearest(dense(queries.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id"), dense(chunks.select("id", "text")), fetch)
    hits = near.drop("rank").join(chunks.select("id", "path", "first", "last"), "id")
    if members is not None:
        own = members.select("query_id", "path").distinct().withColumn("_in", F.lit(True))
        hits = hits.join(own, ["query_id", "path"], "left").withColumn("score", F.when(F.col("_in").isNull(), F.col("score") * outside).otherwise(F.col("score"))).drop("_in")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "path", "first", "last", "score")


def clade_queries(clades: DataFrame, members: DataFrame, named: int = 12) -> DataFrame:
    """(query_id, text): what to ask for each clade (clade, label, code_type, layer): its names and its first files (clade, path)."""
    first = members.select("clade", "path").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("clade").orderBy("path"))).filter(F.col("_k") <= named)
    files = first.groupBy("clade").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("files"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.concat(F.lit("taxonomy role for clade "), "clade", F.lit(" labeled "), F.coalesce("label", "clade"), F.lit(" type "), none("code_type"), F.lit(" layer "), none("layer"), F.lit(" files "), none("files"))
    return clades.join(files, "clade", "left").select(F.col("clade").alias("query_id"), said.alias("text"))


def clade_evidence(chunks: DataFrame, clades: DataFrame, members: DataFrame, k: int = 6) -> DataFrame:
    """The chunks that bear out each clade, those of its own files before others: see ``retrieve``."""
    own = members.select(F.col("clade").alias("query_id"), "path")
    return retrieve(chunks, clade_queries(clades, members), k, own)
