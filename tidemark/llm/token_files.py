"""Token ids of a corpus in files of Simple-8b words, in ascending document order, and reading them back.

The files are a Parquet folder that Spark writes and commits, so any store that Spark reaches can hold them and a task that is lost or run twice
leaves nothing behind. A row is a stretch of whole documents, about ``SEGMENT`` ids: ``part`` and ``first`` (ids of the
part before it) place it in the corpus, ``doc_ids`` names its documents, ``lengths`` and ``ids`` are Simple-8b segments
(see ``simple8b``) with offsets per block. Parts follow each other in document order.

Documents are dealt over tasks by ranges of their id and sorted there; each task encodes and writes its range. Where a
document starts in the whole corpus follows from the sizes of the parts before its own, one number per task.

Edge cases: null text is an empty text, the end id alone; a null id sorts before every other; rows that share an id
stay rows of their own, in the order of a hash of their texts, and a range may end among them; a text of any length is
one document of one segment; an empty table gives files without rows and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import simple8b
from tidemark.llm.common import shared_dir
from tidemark.llm.word_pieces import word_encoder

#: Ids after which a segment is closed; only a longer document makes a longer one.
SEGMENT = 1 << 20
_FILE = "part int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths binary, ids binary"
_DOCS = "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint"


def _packed(tokenizer_path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, end = word_encoder(tokenizer_path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        first, names, sizes, blobs, held = 0, [], [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(blobs), "<u4")
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([held], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "lengths": pa.array([simple8b.encode(np.array(sizes))], pa.binary()), "ids": pa.array([simple8b.encode(ids)], pa.binary()),
            })

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                blobs += [encode(text.as_py() or ""), end]
                names.append(name)
                sizes.append(len(blobs[-2]) // 4 + 1)
                held += sizes[-1]
                if held >= SEGMENT:
                    yield segment()
                    first, names, sizes, blobs, held = first + held, [], [], [], 0
        if names:
            yield segment()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> None:
    """Writes the ids of docs (doc_id, text), each document closed by ``end_id``, to a folder."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", "_hash", "_row"]
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_packed(tokenizer_path, end_id), _FILE).write.option("compression", "none").parquet(path)


def _unpacked(with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, first = batch.column("part")[r].as_py(), batch.column("first")[r].as_py()
                names, blob = batch.column("doc_ids")[r].values, batch.column("ids")[r].as_py()
                sizes = simple8b.decode(batch.column("lengths")[r].as_py()).astype(np.int64)
                raw = memoryview(simple8b.decode(blob).astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                out = {
                    "doc_id": names, "part": pa.array(np.full(len(sizes), part, np.int32)), "at": pa.array(first + ends - sizes), "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in pieces], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in a folder of token files, decoded from them."""
    files = spark.read.schema(_FILE).parquet(path)
    parts = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row per task that wrote
    before = [0, *accumulate(n for _, n in parts)]
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, before, strict=False)], "part int, base bigint")
    docs = files.mapInArrow(_unpacked(with_ids), _DOCS + (", ids array<bigint>" if with_ids else ""))
    start = (F.col("base") + F.col("at")).alias("start")
    return docs.join(F.broadcast(bases), "part").select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Writes the documents' ids (to a new folder beside the checkpoints, if no path is given) and reads the files back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_path, path, end_id)
    return read_token_files(spark, path, with_ids)
