"""Exact top-k inner products by distributed histogram selection.

Queries go in blocks of a fixed number of vectors, so a broadcast block has a known size whatever the table's; for each
block every candidate is scored in every pass. A pass counts scores in a histogram per query over the interval that
still holds its k-th best; partial histograms are summed per query and the interval shrinks to the bin found, until it
is one integer wide: the k-th score. The last pass keeps what lies above that score and, of ties with it, the smallest
ids, as many as each query still needs. A block's winners are written before the next block is read, and its broadcast
is released, so neither the driver nor the plan grows with the number of queries.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; a row
whose id equals the query's is its own row and no candidate; a repeated query id is asked once; fewer than k candidates
give all of them; vectors of another length than the query's have no inner product with it and are left out; an empty
table gives an empty result. Scores are exact whole numbers up to 2**62 - 1; components are held at 2**62 and scores at
2**62 - 1, either way of zero, so values of any size rank without an error.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_dir

BINS = 256
BLOCK = 4096
ROWS = 2048
#: Whole numbers are held within this.
MOST = 2**62 - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): whole-number vectors floor(scale * x), only rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
        .select("id", F.transform("v", lambda x: F.floor(F.least(F.lit(2.0**62), F.greatest(F.lit(-(2.0**62)), x * F.lit(float(scale)))))).alias("v"))
    )


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        col = batch.column("v")
        if not batch.num_rows:
            continue
        lengths = np.diff(np.asarray(col.offsets))
        ids = np.asarray(batch.column("id"))
        if (lengths == dim).all():
            values = np.asarray(col.flatten()).reshape(-1, dim)
        else:
            pick = np.flatnonzero(lengths == dim)
            flat, offsets = np.asarray(col.values), np.asarray(col.offsets)
            values = np.array([flat[offsets[i] : offsets[i] + dim] for i in pick]).reshape(-1, dim)
            ids = ids[pick]
        for i in range(0, len(ids), ROWS):
            yield ids[i : i + ROWS], values[i : i + ROWS]


def _scorer(qvecs: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Exact integer products: single precision where no sum or bin edge can reach 2**24, then double, else integers, of any size if need be."""
    top = float(np.abs(qvecs).max(initial=0))

    def score(c: np.ndarray) -> np.ndarray:
        bound = top * float(np.abs(c).max(initial=0)) * c.shape[1]
        if bound >= 2**61:  # beyond a long: Python's own integers
            return np.clip(qvecs.astype(object) @ c.astype(object).T, -MOST, MOST).astype(np.int64)
        kind = np.float32 if bound < 2**22 else np.float64 if bound < 2**51 else np.int64
        return qvecs.astype(kind) @ c.astype(kind).T

    return score


def _histograms(shared, lows, widths, bins: int, dim: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qvecs = shared.value
        score, hist = _scorer(qvecs), None
        base = np.arange(len(qids))[:, None] * (BINS + 1)
        for ids, values in _blocks(batches, dim):
            s = score(values)
            low, width = lows[:, None].astype(s.dtype), widths[:, None].astype(s.dtype)
            if s.dtype == np.int64:
                b = (s - low) // width
            else:  # widths are powers of two, so the quotient is exact
                b = np.floor((s - low) * (1 / width))
            inside = (b >= 0) & (b < bins)  # what lies above the interval is counted already
            np.copyto(b, BINS, where=~inside)
            b = b.astype(np.int64)
            at = np.minimum(np.searchsorted(qids, ids), len(qids) - 1)
            own = np.flatnonzero(qids[at] == ids)
            b[at[own], own] = BINS
            b += base
            h = np.bincount(b.ravel(), minlength=len(qids) * (BINS + 1))
            hist = h if hist is None else hist + h
        if hist is not None:
            hist = hist.reshape(len(qids), BINS + 1)[:, :BINS]
            step = 64
            chunks = range(0, len(qids), step)
            yield pa.RecordBatch.from_pydict({"chunk": [i // step for i in chunks], "h": [hist[i : i + step].astype("<i8").tobytes() for i in chunks]})

    return count


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, "<i8") for x in pdf["h"]], axis=0)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "h": [total.tobytes()]})


def _totals(parts: DataFrame, tasks: int) -> DataFrame:
    """(chunk, h) summed over all tasks in two steps, so that no group holds more than about the square root of their number."""
    some = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(tasks)))))
    once = some.groupBy("chunk", "g").applyInPandas(_sum, "chunk bigint, h binary")
    return once.groupBy("chunk").applyInPandas(_sum, "chunk bigint, h binary")


def _winners(shared, kth, need, dim: int, k: int) -> Callable:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qvecs = shared.value
        score = _scorer(qvecs)
        ties: tuple[np.ndarray, np.ndarray] | None = None
        for ids, values in _blocks(batches, dim):
            s = score(values)
            level = kth[:, None].astype(s.dtype)
            q, c = np.nonzero(s > level)
            other = qids[q] != ids[c]
            q, c = q[other], c[other]
            yield pa.RecordBatch.from_pydict({"query_id": qids[q], "vec_id": ids[c], "score": s[q, c].astype(np.int64)})
            q, c = np.nonzero(s == level)
            other = qids[q] != ids[c]
            q, v = q[other], ids[c[other]]
            if ties is not None:
                q, v = np.concatenate([ties[0], q]), np.concatenate([ties[1], v])
            order = np.lexsort((v, q))
            q, v = q[order], v[order]
            first = np.searchsorted(q, q, side="left")
            few = np.arange(len(q)) - first < need[q]
            ties = q[few], v[few]
        if ties is not None and len(ties[0]):
            yield pa.RecordBatch.from_pydict({"query_id": qids[ties[0]], "vec_id": ties[1], "score": kth[ties[0]].astype(np.int64)})

    return pick


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest whole-number inner products.

    Ties go to the smaller id. ``block`` bounds what is broadcast at once: block vectors.
    """
    spark = queries.sparkSession
    cand = cut(quantised(candidates, id_col, vec_col, scale), "candidates")
    asked = quantised(queries, id_col, vec_col, scale).dropDuplicates(["id"])
    reach = cand.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]
    # Blocks are slices of the sorted queries; each is read when its turn comes.
    slices = max(1, -(-asked.count() // block)) if reach is not None else 0
    asked = cut(asked.withColumn("dim", F.size("v")).repartitionByRange(max(1, slices), "id"), "queries") if slices else asked
    schema = "query_id bigint, vec_id bigint, score bigint"
    folder, none = f"{shared_dir(spark)}/winners-{uuid.uuid4().hex}", True
    for n, (qids, qvecs) in enumerate(_query_blocks(asked, block) if slices else ()):
        _search_block(spark, cand, qids, qvecs, reach, k, f"{folder}/block={n}")
        none = False
    if none:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(asked: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, at most ``block`` of one vector length at a time; only one block is on the driver."""
    last: int | None = None
    for dim in sorted(r[0] for r in asked.select("dim").distinct().collect()):
        last = None
        while True:
            rest = asked.filter(F.col("dim") == dim)
            rest = rest if last is None else rest.filter(F.col("id") > last)
            rows = rest.orderBy("id").limit(block).toPandas()
            if not len(rows):
                break
            yield rows["id"].to_numpy(np.int64), np.array(rows["v"].tolist(), dtype=np.int64).reshape(-1, dim)
            last = int(rows["id"].iloc[-1])
            if len(rows) < block:
                break


def _search_block(spark, cand: DataFrame, qids: np.ndarray, qvecs: np.ndarray, reach: float, k: int, path: str) -> None:
    """Writes (query_id, vec_id, score) of the block's winners."""
    n, dim = qvecs.shape
    shared = spark.sparkContext.broadcast((qids, qvecs))
    # No score exceeds |q| * max |c|; the first interval is a power of two times the number of bins.
    bound = min(MOST, int(np.ceil(np.sqrt(float((qvecs.astype(np.float64) ** 2).sum(axis=1).max()) * reach) * 1.0001)) + 1)
    width = 1
    while width * BINS < 2 * bound + 1:
        width *= 2
    tasks = cand.rdd.getNumPartitions()
    lows, widths, above, bins = np.full(n, -(width * BINS) // 2, np.int64), np.full(n, width, np.int64), np.zeros(n, np.int64), BINS
    while True:
        parts = cand.mapInArrow(_histograms(shared, lows, widths, bins, dim), "chunk bigint, h binary")
        sums = _totals(parts, tasks).orderBy("chunk").toPandas()
        hist = np.concatenate([np.frombuffer(h, "<i8").reshape(-1, BINS) for h in sums["h"]]) if len(sums) else np.zeros((n, BINS), np.int64)
        downward = above[:, None] + np.cumsum(hist[:, ::-1], axis=1)
        enough = downward >= k
        has = enough.any(axis=1)
        step = np.where(has, enough.argmax(axis=1), BINS - 1)  # without k candidates: the lowest bin
        above = np.where(step > 0, downward[np.arange(n), np.maximum(step - 1, 0)], above)
        lows = lows + (BINS - 1 - step) * widths
        if widths[0] == 1:
            break
        bins = min(BINS, int(widths[0]))
        widths = widths // bins
    cand.mapInArrow(_winners(shared, lows, np.maximum(0, k - above), dim, k), "query_id bigint, vec_id bigint, score bigint").write.parquet(path)
    shared.destroy()
