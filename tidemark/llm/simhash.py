"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Documents become 64-bit fingerprints; equal ones are collapsed before anything is compared. Distinct fingerprints are
cut into five blocks of bits: within a radius of three at least two blocks agree, so every linked pair meets in one of
the ten tables keyed by two blocks. Inside a bucket the bits are stored vertically, one machine word per bit and 64
fingerprints; distances to all lanes are counted at once by carry-save counters, and words whose lanes have all passed
the radius are left out from then on. A bucket over ``CHUNK`` is dealt out as pairs of chunks, so no task grows with a
bucket, and a task returns a spanning forest of the links it found, never all pairs. Forests are merged into groups by
alternating star contractions, tables all the way.

Edge cases: null text is an empty text; a text of any length is hashed whole; a bit set in exactly half of the hashes is 0; a text without words has fingerprint zero, and links like any other; a null id
counts as the largest, so it names a group only if all its ids are null; repeated rows are one group; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SEED = 42
CHUNK = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FULL = np.uint64(2**64 - 1)


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``words`` words, lower-cased A-Z and joined by one space; of all words if there are fewer."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at exactly 0x20 and 0x09-0x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: len(parts) - words]]).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(text: str, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """A bit is one if it is set in over half the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        block = h[i : i + (1 << 16)]
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = [fingerprint(texts[i].as_py() or "", words) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": np.array(fps, np.uint64).view(np.int64)})

    return run


def _counters(radius: int, shape, word) -> list[np.ndarray]:
    """Counters that overflow when a lane's distance passes the radius: as many bits as it takes, started high enough."""
    bits = radius.bit_length()
    start = (1 << bits) - 1 - radius
    return [np.full(shape, np.iinfo(word).max if start >> i & 1 else 0, word) for i in range(bits)]


def _add(counters: list[np.ndarray], over: np.ndarray, x: np.ndarray) -> None:
    for c in counters:
        carry = c & x
        c ^= x
        x = carry
    over |= x


def lanes_within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """planes[bit, word] of many fingerprints, queries[q] -> bits[q, word]: which lanes are within the radius."""
    words = planes.shape[1]
    out = np.zeros((len(queries), words), np.uint64)
    alive = np.arange(words)
    over = np.zeros((len(queries), words), np.uint64)
    counters = _counters(radius, over.shape, np.uint64)
    for b in range(64):
        sign = np.uint64(0) - (queries >> np.uint64(b) & np.uint64(1))
        _add(counters, over, planes[b][alive][None, :] ^ sign[:, None])
        if b % 8 == 7 and b < 63:
            left = (over != FULL).any(axis=0)
            if not left.any():
                return out
            if left.sum() < 0.75 * len(left):
                alive, over, counters = alive[left], over[:, left], [c[:, left] for c in counters]
    out[:, alive] = ~over
    return out


def planes_of(fps: np.ndarray) -> np.ndarray:
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    return np.array([np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for b in range(64)])


def large_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large bucket: breadth-first, each fingerprint is compared once, with what is still unseen."""
    planes, n = planes_of(fps), len(fps)
    unseen = np.ones(n, bool)
    a, b = [], []
    words = planes.shape[1]
    nxt = 0
    while nxt < n:
        if not unseen[nxt]:
            nxt += 1
            continue
        unseen[nxt] = False
        frontier = np.array([nxt])
        root = fps[nxt]
        while len(frontier):
            mask = np.packbits(np.pad(unseen, (0, words * 64 - n)), bitorder="little").view("<u8")
            keep = np.flatnonzero(mask)
            found = np.zeros(words, np.uint64)
            for i in range(0, len(frontier), 256):
                found[keep] |= np.bitwise_or.reduce(lanes_within(planes[:, keep], fps[frontier[i : i + 256]], radius), axis=0) & mask[keep]
            frontier = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[:n])
            unseen[frontier] = False
            a.append(fps[frontier])
            b.append(np.full(len(frontier), root))
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def small_forests(members: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many buckets at once: members[bucket, lane], at most 8 or 64 lanes, one word per bucket and bit."""
    lanes = members.shape[1]
    word = np.uint8 if lanes == 8 else np.uint64
    planes = [np.packbits((members >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8" if lanes == 64 else "u1")[:, 0] for b in range(64)]
    one = word(1)
    valid = np.array([(1 << int(s)) - 1 for s in range(lanes + 1)], dtype=np.uint64).astype(word)[sizes]
    most = int(sizes.max())
    reach = np.zeros((len(members), most), word)
    for lane in range(most):
        over = np.zeros(len(members), word)
        counters = _counters(radius, over.shape, word)
        for b in range(64):
            sign = (np.uint64(0) - (members[:, lane] >> np.uint64(b) & np.uint64(1))).astype(word)
            _add(counters, over, planes[b] ^ sign)
            if b % 16 == 15 and ((over | ~valid) | (one << word(lane)) == np.iinfo(word).max).all():
                break
        reach[:, lane] = np.where(sizes > lane, ~over & valid | (one << word(lane)), 0)
    while True:  # transitive closure
        before = reach.copy()
        for lane in range(most):
            has = (reach >> word(lane) & one).astype(bool)
            reach |= np.where(has, reach[:, lane][:, None], word(0))
        if (reach == before).all():
            break
    low = reach & (~reach + one)
    root = np.where(low > 0, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64), 0)
    g, lane = np.nonzero((np.arange(most)[None, :] < sizes[:, None]) & (root != np.arange(most)[None, :]))
    return members[g, lane], members[g, root[g, lane]]


def forests(fps: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within runs of equal ``groups``."""
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(edges, len(fps)))
    out = []
    for lanes, pick in ((8, (sizes > 1) & (sizes <= 8)), (64, (sizes > 8) & (sizes <= 64))):
        where = np.flatnonzero(pick)
        for i in range(0, len(where), 4096):
            w = where[i : i + 4096]
            members = np.zeros((len(w), lanes), np.uint64)
            at = np.arange(lanes)[None, :] < sizes[w][:, None]
            members[at] = fps[(edges[w][:, None] + np.arange(lanes)[None, :])[at]]
            out.append(small_forests(members, sizes[w], radius))
    for i in np.flatnonzero(sizes > 64):
        out.append(large_forest(fps[edges[i] : edges[i] + sizes[i]], radius))
    if not out:
        return fps[:0], fps[:0]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket -> links; whole buckets are worked off together."""
        rest_fp, rest_key = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def emit(fps, keys):
            a, b = forests(fps, keys, radius)
            return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            fps = np.concatenate([rest_fp, np.asarray(batch.column("fp")).view(np.uint64)])
            new = np.asarray(batch.column("bucket"))
            keys = np.concatenate([rest_key, new])
            if not len(keys):
                continue
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if last:
                yield emit(fps[:last], keys[:last])
            rest_fp, rest_key = fps[last:], keys[last:]
        if len(rest_fp):
            yield emit(rest_fp, rest_key)

    return run


def linked(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links enough to connect all distinct fingerprints (column fp) that differ in at most ``radius`` bits."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]

    def block(i: int):
        return F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))

    tables = [F.xxhash64(F.lit(n), block(i), block(j)) for n, (i, j) in enumerate(combinations(range(blocks), 2))]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(crowded, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    met = met.withColumn("other", F.explode(other)).filter("chunks = 1 or other <> own")
    met = met.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    return met.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_links(radius), "a bigint, b bigint").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root): each linked node's smallest reachable node, by alternating large and small stars."""
    edges = cut(links.filter("a <> b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marked = cut(src.mapInArrow(_fingerprints(words), "doc_id bigint, fp bigint"), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(linked(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(smallest, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
