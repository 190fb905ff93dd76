"""Periodic runs: stretches of words that repeat with some period at least four times over, found whole and collapsed to one period.

A period of an octave [S, 2S) repeats over at least 4S words, so a run of it crosses many multiples of S. A document is
exploded into overlapping tiles per octave, each a few of these boundaries with the words around them, the tiles are
dealt over the tasks and solved by themselves: Z-functions from a boundary on and back give, for every period of
the octave at once, how far words agree with those a period on. The fragments are shuffled by document and period and
joined to intervals where they meet. Boundaries are left out only where the words that follow cannot be a run of the octave, because
some eight words of them do not come again within its longest period. Periods under eight need no tile: whole documents are compared with
themselves a few words on as they are read.

A fragment whose period is itself made of repeats of a shorter one is that one's and not reported, so each run has its smallest period.

Documents without fragments are finished as they are read; only the others' words are kept, in a written table, for the joined runs.

Edge cases: null text has no words; a text of any length is searched whole; rows that share an id stay rows of their
own; a document with a null id is searched as it is, nothing being planted in it; runs of equal length are ranked by start, then period; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shuffle_width

#: Repeats and words a run has at least.
REPEATS, LEAST = 4, 6
#: Periods below this one are found without tiles.
FIRST = 8
#: Words of a tile that hold boundaries, unless four boundaries take more.
TILE = 4096
_FOUND = "kind int, row bigint, doc_id bigint, n bigint, words binary, kept string, period bigint, lo bigint, hi bigint, octave bigint, codes binary"
_OUT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
_DONE, _OPEN, _FRAGMENT, _TILE = range(4)


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place where the id's hash plants a periodic tail; None where it plants none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _least_match(period: int) -> int:
    """Words in a row that must equal the one a period on."""
    return max((REPEATS - 1) * period, LEAST - period)


def _primitive(codes: np.ndarray, period: int) -> bool:
    """Whether the first ``period`` codes are not repeats of a shorter stretch."""
    return not any(period % d == 0 and np.array_equal(codes[d:period], codes[: period - d]) for d in range(1, period // 2 + 1))


def short_fragments(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, lo, hi): all matches of periods below FIRST, where words lo..hi-1 equal those a period on."""
    out = []
    for q in range(1, min(FIRST - 1, len(codes) // REPEATS) + 1):
        lo, hi = _intervals(codes[q:] == codes[:-q])
        for k in np.flatnonzero(hi - lo >= _least_match(q)):
            if _primitive(codes[lo[k] : lo[k] + q], q):
                out.append((q, int(lo[k]), int(hi[k])))
    return out


def next_places(codes: np.ndarray, size: int = FIRST) -> np.ndarray:
    """How many words on the next equal gram of ``size`` words begins; a huge number where none does (or none fits)."""
    n = len(codes)
    out = np.full(n, 2**40, np.int64)
    if n <= size:
        return out
    grams, mix = np.zeros(n - size + 1, np.uint64), codes.astype(np.uint64) + np.uint64(1)
    for k in range(size):  # equal grams have equal sums; a chance meeting only keeps a boundary
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + mix[k : n - size + 1 + k]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def boundaries(ahead: np.ndarray, octave: int) -> np.ndarray:
    """Multiples of 2**octave that a run of the octave may cross.

    Within a run all grams but those at its end come again within a period, for more than 2 x 2**octave words, so one whole
    block between boundaries is of that kind; the run's last match may lie two boundaries on.
    """
    s = 1 << octave
    blocks = len(ahead) // s
    good = np.flatnonzero((ahead[: blocks * s].reshape(blocks, s) < 2 * s).all(axis=1))
    near = np.unique(np.concatenate([good, good + 1, good + 2]))
    return near[near * s < len(ahead)]


def z_function(codes: list[int], upto: int) -> list[int]:
    """For each of the first ``upto`` places how many codes from there on equal those from the start on."""
    n = len(codes)
    z = [0] * min(upto, n)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and codes[k] == codes[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def solve_tile(codes: np.ndarray, base: int, marks: list[int], octave: int) -> list[tuple[int, int, int]]:
    """(period, lo, hi) of the matches around boundaries (numbers of multiples of 2**octave); codes start at word ``base``."""
    s, found = 1 << octave, {}
    listed = codes.tolist()
    for mark in marks:
        c = mark * s - base
        # Words from the boundary on against those a period later, up to the next boundary.
        right = z_function(listed[c : c + 3 * s], 2 * s)
        # The same backwards: the words before the boundary against those before boundary + period.
        back, both = listed[max(c - s, 0) : c][::-1], listed[max(c - s, 0) : c + 2 * s][::-1]
        tail = z_function([*back, -1, *both], len(back) + 1 + len(both))[len(back) + 1 :]
        ahead = len(both) - len(back)  # words from the boundary on, at most 2s
        for q in range(s, min(2 * s, len(right))):
            r = min(right[q], s)
            left = min(tail[ahead - q], s) if q <= ahead else 0
            if left + r < s or (left < s and r < s) or _repeats(right, q):
                continue
            spans = found.setdefault(q, [])
            lo, hi = base + c - left, base + c + r
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
    return [(q, lo, hi) for q, spans in found.items() for lo, hi in spans]


def _repeats(z: list[int], q: int) -> bool:
    """Whether the first q codes are repeats of a shorter stretch, from their Z-function."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if z[q // p] >= q - q // p:
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and where each text's end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))  # white space at an end leaves an empty word
    return flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[offsets]


def _explore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished documents, and of the others their words, fragments of short periods and tiles."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    schema = pa.schema([("kind", pa.int32()), *[(k, pa.int64()) for k in ("row", "doc_id", "n")], ("words", pa.binary()), ("kept", pa.string()), *[(k, pa.int64()) for k in ("period", "lo", "hi", "octave")], ("codes", pa.binary())])
    for batch in batches:
        words, ends = _split(batch.column("text"))
        every = np.asarray(words.dictionary_encode().indices).astype(np.int32, copy=False)
        out: list[dict] = []
        for k, name in enumerate(batch.column("doc_id").to_pylist()):
            row += 1
            codes, own = every[ends[k] : ends[k + 1]], words.slice(ends[k], ends[k + 1] - ends[k])
            if (at := planted(len(codes), name)) is not None:
                codes, own = codes[at], own.take(pa.array(at))
            said = {"row": row, "doc_id": name, "n": len(codes)}
            parts = [{"kind": _FRAGMENT, "row": row, "period": q, "lo": lo, "hi": hi} for q, lo, hi in short_fragments(codes)]
            size = len(out)
            out += parts
            for tile in tiles(codes):
                out.append({"kind": _TILE, "row": row} | tile)
            text = " ".join(own.to_pylist()).encode()
            if len(out) > size:
                out.append(said | {"kind": _OPEN, "words": text})
            else:
                out.append(said | {"kind": _DONE, "kept": hashlib.sha256(text).hexdigest()})
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)


def tiles(codes: np.ndarray) -> Iterator[dict]:
    """Tiles of all octaves from FIRST on: lo and hi are the numbers of their first and last boundary, codes their words and those around."""
    if len(codes) < REPEATS * FIRST:
        return
    ahead = next_places(codes)
    for octave in range(FIRST.bit_length() - 1, (len(codes) // REPEATS).bit_length()):
        s = 1 << octave
        marks = boundaries(ahead, octave)
        if not len(marks):
            continue
        per = max(TILE >> octave, 4)
        for group in np.split(marks, np.flatnonzero((np.diff(marks) > 1) | (np.diff(marks // per) > 0)) + 1):
            a, b = int(group[0]), int(group[-1])
            yield {"octave": octave, "lo": a, "hi": b, "codes": codes[max(a - 1, 0) * s : (b + 3) * s].tobytes()}


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tile in batch.to_pylist():
            a, b, octave = tile["lo"], tile["hi"], tile["octave"]
            found = solve_tile(np.frombuffer(tile["codes"], "<i4"), max(a - 1, 0) << octave, list(range(a, b + 1)), octave)
            q, lo, hi = (pa.array([f[i] for f in found], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_pydict({"row": pa.array([tile["row"]] * len(found), pa.int64()), "period": q, "lo": lo, "hi": hi})


def stitched(fragments: DataFrame) -> DataFrame:
    """row, period, start, length of the runs that fragments (row, period, lo, hi) make up where they meet."""
    order = Window.partitionBy("row", "period").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.withColumn("opens", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1)))
    groups = opened.withColumn("g", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = groups.groupBy("row", "period", "g").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("period")).alias("length"))
    return joined.filter((F.col("length") >= REPEATS * F.col("period")) & (F.col("length") >= LEAST)).select("row", "period", "start", "length")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            runs, words = r["runs"] or [], r["words"].split(b" ") if r["n"] else []
            gone = np.zeros(len(words) + 1, np.int64)
            for run in runs:
                gone[run["start"] + run["period"]] += 1
                gone[run["start"] + run["length"]] -= 1
            kept = b" ".join([w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g])
            best = min(runs, key=lambda x: (-x["length"], x["start"], x["period"])) if runs else {}
            said = "".join(f"{x['start']},{x['length']},{x['period']}\n" for x in runs)
            out.append({
                "doc_id": r["doc_id"], "n_runs": len(runs), "start": best.get("start"), "length": best.get("length"), "period": best.get("period"),
                "exponent_milli": 1000 * best["length"] // best["period"] if runs else None,
                "runs_sha256": hashlib.sha256(said.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
            })
        longs = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")
        yield pa.RecordBatch.from_pylist(out, pa.schema([*[(k, pa.int64()) for k in longs], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]))


def find_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, runs): the read documents (kind, row, doc_id, n, words, kept) and their runs (row, period, start, length)."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    read = cut(src.mapInArrow(_explore, _FOUND), "run-parts")
    dealt = read.filter(F.col("kind") == _TILE).select("row", "octave", "lo", "hi", "codes").repartition(shuffle_width(docs.sparkSession), "row", "octave", "lo")  # tiles are small but dear, so their bytes must not decide
    long = dealt.mapInArrow(_solve, "row bigint, period bigint, lo bigint, hi bigint")
    fragments = read.filter(F.col("kind") == _FRAGMENT).select("row", "period", "lo", "hi").unionByName(long)
    return read.filter(F.col("kind") <= _OPEN).select("kind", "row", "doc_id", "n", "words", "kept"), stitched(fragments)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    read, runs = find_runs(docs)
    listed = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    kept = read.filter(F.col("kind") == _OPEN).join(listed, "row", "left").select("doc_id", "n", "words", "runs").mapInArrow(_collapse, _OUT)
    none = F.lit(None).cast("bigint")
    plain = read.filter(F.col("kind") == _DONE).select(
        "doc_id", F.lit(0).cast("bigint").alias("n_runs"), *[none.alias(k) for k in ("start", "length", "period", "exponent_milli")],
        F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("kept").alias("collapsed_sha256"),
    )
    return plain.unionByName(kept)
