"""Packing token sequences into windows of a fixed capacity by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left over is packed by decreasing length, each
piece into the tightest open window that holds it. Which window a piece gets depends only on how many pieces there are
of each length, so the plan is made from that histogram (one number per length, at most the capacity of them) with a
segment tree over remaining capacities, for whole groups of equal pieces at a time; its size is bounded by the capacity
and not by the corpus. Pieces then find their windows by their rank among those of equal length, in a join.

Edge cases: null text is an empty text, one end token; a text of any length, also one of white space alone, is encoded
whole; among equal pieces the smaller id, then the smaller start goes first; repeated rows are documents of their own; a null id stays null
and its pieces are told apart by the row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

CAPACITY = 2048
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint"
_PIECES_IDS = _PIECES + ", ids binary"


#: Runs of white space (Unicode's property, fixed values) from this length on are cut out before a text is split.
LONG_RUN = 10_000
_LONG = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level_encoder(path: str):
    """text -> uint32 ids, as the tokenizer file's own library gives them without added tokens.

    The file's vocabulary is run by the faster of the two installed byte-pair encoders; tests compare the two.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    # The split rule of this family of vocabularies (a fixed value).
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    # Bytes beyond single-byte tokens get ids in merge order, which the ids of this vocabulary are.
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    marks = tuple(special)

    def plain(text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def encode(text: str) -> np.ndarray:
        """Long runs of white space are cut out first, as the split rule's look-ahead would step back through all of one.

        Where such a run ends the text, or a special token follows, all of it is one piece; elsewhere all but its last letter.
        """
        if len(text) < LONG_RUN:
            return plain(text)
        parts, at = [], 0
        for m in _LONG.finditer(text):
            stop = m.end() if m.end() == len(text) or text.startswith(marks, m.end()) else m.end() - 1
            parts += [plain(text[at : m.start()]), np.array(encoding._encode_single_piece(text[m.start() : stop]), np.uint32)]
            at = stop
        return np.concatenate([*parts, plain(text[at:])])

    return encode


def _cut_documents(tokenizer_path: str, end_id: int, capacity: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = byte_level_encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column("doc_id")
            texts = batch.column("text")
            rows, starts, lengths, crcs, totals, blobs = [], [], [], [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                ids = np.concatenate([encode(text).astype("<u4", copy=False), end]) if text else end
                raw, n = memoryview(ids.tobytes()), len(ids)
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    piece = raw[4 * at : 4 * (at + size)]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(size)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
                    if with_ids:
                        blobs.append(bytes(piece))
            out = {"doc_id": doc_ids.take(pa.array(rows, pa.int64())), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
                   "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": pa.array(totals, pa.int64()), "part": pa.array([part] * len(rows), pa.int64())}
            if with_ids:
                out["ids"] = pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


class _Tightest:
    """A segment tree over remaining capacities 0..capacity: the smallest one not below a length that has open windows."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, windows: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += windows
            i //= 2

    def find(self, length: int) -> int | None:
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: number of pieces}.

    Rows (length, rank_from, pieces, window_from, each, offset): pieces of that length from rank_from on fill windows
    from window_from on, ``each`` of them to a window, the first at offset. It is what placing one piece after the
    other gives: a window just filled stays the tightest as long as it still holds a piece of the same length.
    """
    tree, open_, plan, windows = _Tightest(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.find(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                n = -(-left // each)
                first, windows = windows, windows + n
            else:
                each = remaining // length
                first, n = open_[remaining].pop()
                tree.add(remaining, -n)
                if (used := -(-left // each)) < n:
                    open_[remaining].append((first + used, n - used))
                    tree.add(remaining, n - used)
                    n = used
            pieces = min(left, n * each)
            plan.append((length, rank, pieces, first, each, capacity - remaining))
            for start, count, held in ((first, pieces // each, each), (first + pieces // each, 1 if pieces % each else 0, pieces % each)):
                if count and (rest := remaining - held * length):
                    open_.setdefault(rest, []).append((start, count))
                    tree.add(rest, count)
            rank, left = rank + pieces, left - pieces
    return plan


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, part); ``part`` deals the ranking out, any bounded groups do."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = _plan_frame(spark, best_fit_plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("n", F.row_number().over(within)).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("n") - 1)
    # The plan's rows of one length are intervals of ranks; a rank's interval is found by its number in a sorted array.
    table = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank_from", "window_from", "each", "offset_from"))).alias("steps"))
    placed = ranked.join(F.broadcast(table), "length")
    step = F.element_at(F.filter("steps", lambda s: s["rank_from"] <= F.col("rank")), -1)
    placed = placed.withColumn("s", step).withColumn("at", F.col("rank") - F.col("s.rank_from"))
    return placed.select(
        *pieces.columns,
        (F.col("s.window_from") + F.floor(F.col("at") / F.col("s.each"))).cast("bigint").alias("sequence_id"),
        (F.col("s.offset_from") + F.col("at") % F.col("s.each") * F.col("length")).cast("bigint").alias("offset"),
    )


def _plan_frame(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    return spark.createDataFrame(plan, "length bigint, rank_from bigint, pieces bigint, window_from bigint, each bigint, offset_from bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = cut(src.mapInArrow(_cut_documents(tokenizer_path, end_id, capacity, with_ids), _PIECES_IDS if with_ids else _PIECES), "pieces")
    return pack_pieces(pieces, capacity).drop("part")
