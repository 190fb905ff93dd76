"""Substring deduplication with suffix automata of reference shards.

A window is ``length`` consecutive words of one document; a word goes if a window that covers it also starts earlier.
Streaming every document past the automaton of every other shard costs shards x words, so shards are made of passages
that can share a window, and documents meet only those:

1. Every window names an anchor: the ``GRAM``-word run of least hash in it. Equal windows name equal anchors, and an
   anchor's windows all lie in its context, the words around it that its windows can reach.
2. Anchors meet by hash. Where an anchor and its whole context repeat, every window of the later one starts earlier.
   Within a task that is settled before the shuffle, so copies send one row per task.
3. Where an anchor comes with different contexts, these contexts are the shard's passages. A suffix automaton of the
   passages (over word fingerprints) is built, each state keeps the earliest place its words end at, and the passages
   are streamed through it: where the matching statistic reaches ``length`` the state of the last ``length`` words
   tells whether the window starts earlier elsewhere. An anchor with more than ``CROWD`` contexts is dealt out by its
   windows instead, each with the SHA-256 of its words, so a common line makes no large shard. A task sends a window
   on only where it starts earlier than all the task saw of it, which is once or, where documents come in no order,
   about as often as the logarithm of their number says. Where windows meet they are read in order of document and
   start, and only the first is remembered: nothing is gathered, however many there are.
   The ``HOT`` most frequent anchors, found by a first pass, are dealt out like that at once: an anchor that is not
   among them has at most one in ``HOT`` of all rows or ``LEAST_HOT`` of each task.
4. Documents, joined with what was found in them, lose the union of the maximal spans.

In shards words are compared by 64-bit fingerprints, and repeated contexts by a sum of these, so two words whose
fingerprints collide count as equal there (2**-64 for a pair). No window is skipped and nothing is capped.

Edge cases: null text has no words; a text of any length is read whole; of equal windows the smallest id, then the earliest start stays; a null id sorts before all others; rows that repeat an id are one document in the
order of windows, so they take nothing from each other at equal starts; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import NO_ID, cut

LENGTH = 20
GRAM = 8
CROWD = 256
HOT = 100_000
#: Texts are worked off together up to this many bytes, which bounds the arrays' size.
BATCH_BYTES = 1 << 21
#: So many anchors of a task are settled together.
FLUSH = 400_000
#: An anchor with fewer rows than this in a task is not looked at as frequent.
LEAST_HOT = 64
#: So many windows of crowded anchors a task remembers; beyond, it forgets them and may send some once more.
REMEMBERED = 1 << 17

U = np.uint64
_RNG = np.random.default_rng(20)
_LETTER = _RNG.integers(0, 2**64, 256, dtype=U)
_P, _Q = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_Q_INV = U(pow(int(_Q), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a well-known 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Words(NamedTuple):
    """The words of several documents on end: fingerprints, byte spans in ``data``, and each document's first word."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    bounds: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, stops = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(starts):
        return Words(data, np.zeros(0, U), starts, stops, bounds)
    lengths = stops - starts
    power, hashes, i = _powers(_P, int(lengths.max())), [], 0
    while i < len(starts):  # by slices, so that a very long text needs no more at once than several short ones
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + BATCH_BYTES)))
        part = data[starts[i] : stops[j - 1]]
        letters, sizes = part[~space[starts[i] : stops[j - 1]]], lengths[i:j]
        first = np.cumsum(sizes) - sizes
        at = np.arange(len(letters)) - np.repeat(first, sizes)
        hashes.append(_mix(np.add.reduceat(_LETTER[letters] * power[at], first) + sizes.astype(U)))
        i = j
    return Words(data, np.concatenate(hashes), starts, stops, bounds)


class Anchors(NamedTuple):
    """owner[w]: the anchor's place for the window that starts at word w, or -1; places: the anchors in order."""

    owner: np.ndarray
    places: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    contexts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def anchors_of(words: Words, length: int = LENGTH, gram: int = GRAM) -> Anchors:
    h, n = words.hashes, len(words.hashes)
    docs = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    empty = np.zeros(0, np.int64)
    if n < length:
        return Anchors(np.full(n, -1), empty, empty, empty.astype(U), empty.astype(U), empty, empty)
    back = _powers(_Q_INV, n + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(h * _powers(_Q, n), dtype=U)])
    grams = _mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    # The hash's high bits order grams, the place settles ties: equal windows choose the same one, relative to their start.
    place_bits = U(max(1, int(n).bit_length()))
    keys = (grams >> U(30)) << place_bits | np.arange(len(grams), dtype=U)
    span = length - gram + 1
    least, width = keys, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(keys) - span + 1], least[span - width : span - width + len(keys) - span + 1])
    owner = (least & ((U(1) << place_bits) - U(1))).astype(np.int64)
    ends = words.bounds[1:][docs[: n - length + 1]]
    owner[np.arange(n - length + 1) + length > ends] = -1
    owner = np.concatenate([owner, np.full(length - 1, -1)])
    real = owner[owner >= 0]
    places = real[np.concatenate([[True], real[1:] != real[:-1]])] if len(real) else empty
    doc = docs[places]
    low = np.maximum(words.bounds[doc], places - (length - gram))
    high = np.minimum(words.bounds[doc + 1], places + length)
    context = (sums[high] - sums[low]) * back[low] + _mix(((places - low) * 4096 + high - low).astype(U))
    return Anchors(owner, places, doc, grams[places], _mix(context * _P), low, high)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a batch's texts up to BATCH_BYTES, with the first row's number."""
    texts, held, size, first = batch.column("text"), [], 0, 0
    for i in range(batch.num_rows):
        text = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
        if held and size + len(text) > BATCH_BYTES:
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _task_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, context, document's id and mark, place) of anchors, about FLUSH at a time."""
    held: list[tuple] = []
    for batch in batches:
        ids, marks = np.asarray(batch.column("d")), np.asarray(batch.column("t"))
        for first, texts in _pieces(batch):
            words = words_of(texts)
            a = anchors_of(words, length)
            if len(a.places):
                held.append((a.hashes, a.contexts, ids[first + a.doc], marks[first + a.doc], a.places - words.bounds[a.doc]))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _frequent(length: int, least: int) -> Callable:
    """Anchors that make up one in HOT of a task's open rows or more: whatever is that frequent in all is so in some task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, d, _, pos in _task_anchors(batches, length):
            values, counts = np.unique(h[~_later_in_task(h, c, d, pos)], return_counts=True)
            often = counts >= max(least, counts.sum() // HOT)
            yield pa.RecordBatch.from_pydict({"h": values[often].view(np.int64), "n": counts[often]})

    return run


def _place_rows(length: int, shared) -> Callable:
    """Documents -> one row per anchor: its hash and context, the document, its place; ``settled`` or ``hot`` if it needs no meeting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, d, t, pos in _task_anchors(batches, length):
            settled = _later_in_task(h, c, d, pos)
            hot = ~settled & np.isin(h, shared.value)
            # What is settled or hot meets nobody here: its rows are dealt evenly.
            alone = settled | hot
            h = np.where(alone, _mix(d.view(U) * _P + pos.astype(U)), h)
            c = np.where(alone, U(0), c)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c.view(np.int64), "d": d, "t": t, "pos": pos.astype(np.int32), "settled": settled, "hot": hot})

    return run


def _later_in_task(h: np.ndarray, c: np.ndarray, d: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rows whose anchor and context come earlier among these rows."""
    order = np.lexsort((pos, d, c, h))
    hs, cs, ds, ps = h[order], c[order], d[order], pos[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (ds > ds[lead]) | (ps > ps[lead])
    out = np.zeros(len(h), bool)
    out[order] = later
    return out


#: A passage's words are the fingerprints of its words; a window's are the SHA-256 of its text, and none if it is settled.
_PASSAGE = "route bigint, d bigint, t bigint, start bigint, words binary, kind tinyint"
PASSAGE, WINDOW, SETTLED = range(3)
_PASSAGE_ARROW = pa.schema([("route", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), ("kind", pa.int8())])


def _passages(length: int) -> Callable:
    """Documents with their open anchors -> the passages that go to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[bytes, tuple[int, int]] = {}  # windows of crowded anchors -> where this task saw them start first
        for batch in batches:
            ids, marks, opened = batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("opened")
            for first, texts in _pieces(batch):
                words = words_of(texts)
                a = anchors_of(words, length)
                where = {(int(i), int(p)): k for k, (i, p) in enumerate(zip(a.doc, a.places - words.bounds[a.doc], strict=True))}
                out: list[tuple] = []
                for row, text in enumerate(texts):
                    d, t, base = ids[first + row], marks[first + row], int(words.bounds[row])
                    parts: list[bytes] = []
                    for o in opened[first + row].as_py():
                        k = where[row, o["pos"]]
                        if not o["crowded"]:
                            out.append((int(a.hashes[k].view(np.int64)), d, t, int(a.low[k]) - base, words.hashes[a.low[k] : a.high[k]].tobytes(), PASSAGE))
                            continue
                        parts = parts or text.split()
                        for w in range(int(a.low[k]) - base, int(a.places[k]) - base + 1):
                            if a.owner[base + w] == a.places[k]:
                                digest = hashlib.sha256(b" ".join(parts[w : w + length])).digest()
                                seen = earliest.get(digest)
                                if seen is not None and seen < (d, w):
                                    out.append((_anywhere(d, w), d, t, w, b"", SETTLED))  # needs no meeting
                                    continue
                                if len(earliest) >= REMEMBERED:
                                    earliest.clear()
                                earliest[digest] = d, w
                                out.append((int.from_bytes(digest[:8], "little", signed=True), d, t, w, digest, WINDOW))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PASSAGE_ARROW, strict=True)], schema=_PASSAGE_ARROW)

    return run


def _anywhere(d: int, start: int) -> int:
    """A route that deals rows evenly."""
    return ((d * 0x9E3779B97F4A7C15 + start) * 0xC2B2AE3D27D4EB4F + 2**63) % 2**64 - 2**63


class Automaton:
    """A suffix automaton of several passages. ``first[state]`` is the earliest place (as given) where its words end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.first: list = [None]

    def add(self, passage: list[int], places: list) -> None:
        nxt, link, length, first = self.next, self.link, self.len, self.first
        last = 0
        for word, place in zip(passage, places, strict=True):
            q = nxt[last].get(word)
            if q is not None and length[q] == length[last] + 1:
                last = q
                if place < first[q]:
                    first[q] = place
                continue
            if q is not None:
                last = self._split(last, q, word)
                if place < first[last]:
                    first[last] = place
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(place)
            link.append(0)
            p = last
            while p != -1 and word not in nxt[p]:
                nxt[p][word] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][word]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, word)
            last = cur

    def _split(self, p: int, q: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = copy
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def settle(self) -> None:
        """Hands the earliest places up the suffix links, longest first."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0 and self.first[v] < self.first[up]:
                self.first[up] = self.first[v]

    def statistics(self, passage: list[int], length: int) -> Iterator[tuple[int, object]]:
        """Where the longest match ending at a word has ``length`` words or more: (word's number, earliest end of the last ``length``)."""
        nxt, link, size = self.next, self.link, self.len
        v, matched = 0, 0
        for i, word in enumerate(passage):
            while v and word not in nxt[v]:
                v = link[v]
                matched = size[v]
            if word in nxt[v]:
                v = nxt[v][word]
                matched += 1
            else:
                matched = 0
            while v and size[link[v]] >= length:
                v = link[v]
                matched = size[v]
            if matched >= length:
                yield i, self.first[v]


def repeated_windows(passages: list[tuple[int, int, list[int]]], length: int) -> Iterator[tuple[int, int]]:
    """passages (document, start, words), one shard -> (passage's number, word where a window starts that starts earlier elsewhere)."""
    shard = Automaton()
    for d, start, words in passages:
        shard.add(words, [(d, start + i) for i in range(len(words))])
    shard.settle()
    for k, (d, start, words) in enumerate(passages):
        for i, first in shard.statistics(words, length):
            if first < (d, start + i):
                yield k, i - length + 1


def _shards(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by route, document and start -> windows that start earlier."""
        held: list[tuple] = []  # a shard's passages, at most CROWD
        lead: dict[bytes, tuple[int, int]] = {}  # the windows of a route, nearly always one, each with its first start
        route = None

        def finish() -> list[tuple]:
            passages = [(d, s, w) for d, _, s, w in held]
            return [(held[k][0], held[k][1], held[k][2] + i) for k, i in repeated_windows(passages, length)] if len(held) > 1 else []

        ready: list[tuple] = []
        for batch in batches:
            for r, d, t, s, w, kind in zip(*(batch.column(c).to_pylist() for c in ("route", "d", "t", "start", "words", "kind")), strict=True):
                if kind == SETTLED:
                    ready.append((d, t, s))
                    continue
                if r != route:
                    ready += finish()
                    held, lead, route = [], {}, r
                if kind == PASSAGE:
                    held.append((d, t, s, np.frombuffer(w, U).tolist()))
                elif lead.setdefault(w, (d, s)) != (d, s):
                    ready.append((d, t, s))
            if len(ready) > 5000:
                yield _windows(ready)
                ready = []
        ready += finish()
        if ready:
            yield _windows(ready)

    return run


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    d, t, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"d": pa.array(d, pa.int64()), "t": pa.array(t, pa.int64()), "start": pa.array(s, pa.int64())})


def _covered(words: Words, a: Anchors, row: int, anchors: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of a document's words go: all windows of its settled anchors and the windows found in shards."""
    low, high = words.bounds[row], words.bounds[row + 1]
    n = high - low
    starts = windows
    if len(anchors):
        owner = a.owner[low:high] - low
        starts = np.concatenate([np.flatnonzero((a.owner[low:high] >= 0) & np.isin(owner, anchors)), windows])
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _results(length: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, ids = batch.column("gone"), batch.column("d").to_pylist()
            out: list[list] = [[], [], [], []]
            for first, texts in _pieces(batch):
                marked = [gone[first + i].is_valid for i in range(len(texts))]
                words = words_of([x for x, m in zip(texts, marked, strict=True) if m])
                a, k = anchors_of(words, length), 0
                for i, text in enumerate(texts):
                    parts = text.split()
                    n, removed = len(parts), 0
                    if marked[i]:
                        codes = np.asarray(gone[first + i].values, dtype=np.int64)
                        cover = _covered(words, a, k, codes[codes >= 0], -1 - codes[codes < 0], length)
                        removed = int(cover.sum())
                        parts = [p for p, c in zip(parts, cover.tolist(), strict=True) if not c]
                        k += 1
                    d = ids[first + i]
                    for col, x in zip(out, (None if d == NO_ID else d, n, removed, hashlib.sha256(b" ".join(parts)).hexdigest()), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _rewrite(length: int, schema: pa.Schema) -> Callable:
    """(text, rest, gone) -> the rows' fields, texts without what goes; texts that lose nothing stay as they are, white space too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("gone")
            fields = dict(zip((c for c in schema.names if c != "text"), batch.column("rest").flatten(), strict=True))
            new, sizes = [], []
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                if text is not None and gone[i].is_valid:
                    raw = text.encode("utf-8", "surrogatepass")
                    words = words_of([raw])
                    codes = np.asarray(gone[i].values, dtype=np.int64)
                    cover = _covered(words, anchors_of(words, length), 0, codes[codes >= 0], -1 - codes[codes < 0], length)
                    keep = np.flatnonzero(np.diff(np.concatenate([[True], cover, [True]]).astype(np.int8)))
                    spans = [raw[words.starts[x] : words.stops[y - 1]] for x, y in keep.reshape(-1, 2)]
                    text = b"\n".join(spans).decode("utf-8", "surrogatepass")
                new.append(text)
                sizes.append(None if text is None else len(text))
            fields["text"] = pa.array(new, schema.field("text").type)
            if "n_chars" in fields:
                fields["n_chars"] = pa.array(sizes, schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([fields[c] for c in schema.names], names=schema.names)

    return run


def removals(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, t, gone) of documents (d, t, text; more may follow): anchors' places (0 and up) and windows' starts (-1 - start) that go.

    The documents are dealt by (d, t) with all their columns, so a caller that joins the same ``keyed`` by (d, t) reads that shuffle again and texts travel once.
    """
    spark, texts = keyed.sparkSession, keyed.select("d", "t", "text")
    frequent = texts.mapInArrow(_frequent(length, LEAST_HOT), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HOT)
    shared = spark.sparkContext.broadcast(np.array([r["h"] for r in frequent.collect()], np.int64).view(U))  # at most HOT numbers
    rows = texts.mapInArrow(_place_rows(length, shared), "h bigint, c bigint, d bigint, t bigint, pos int, settled boolean, hot boolean")
    met, same = Window.partitionBy("h"), Window.partitionBy("h", "c")
    rows = (
        rows.repartition("h")
        .withColumn("lead", F.min(F.struct("d", "pos")).over(same))
        .withColumn("later", F.col("settled") | (F.struct("d", "pos") > F.col("lead")))
        .withColumn("open", F.col("hot") | (~F.col("settled") & (F.min("c").over(met) != F.max("c").over(met))))
        .withColumn("n", F.count("*").over(met))
    )
    marks = cut(rows.filter("later or open").select("d", "t", "pos", "later", (F.col("hot") | (F.col("n") > CROWD)).alias("crowded")), "anchors")
    opened = marks.filter("not later").groupBy("d", "t").agg(F.collect_set(F.struct("pos", "crowded")).alias("opened"))
    passages = keyed.join(opened, ["d", "t"]).mapInArrow(_passages(length), _PASSAGE)
    found = passages.repartition("route").sortWithinPartitions("route", "d", "start").mapInArrow(_shards(length), "d bigint, t bigint, start bigint")
    codes = marks.filter("later").select("d", "t", F.col("pos").cast("bigint").alias("code")).unionByName(found.select("d", "t", (F.lit(-1) - F.col("start")).alias("code")))
    return codes.groupBy("d", "t").agg(F.collect_set("code").alias("gone"))


def _keyed(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("t"), *(more or ("text",)))


def _check(length: int) -> None:
    if not GRAM <= length < 4096:
        raise ValueError(f"length must be from {GRAM} to 4095")


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space)."""
    _check(length)
    keyed = _keyed(docs)
    gone = removals(keyed, length)
    return keyed.join(gone, ["d", "t"], "left").mapInArrow(_results(length), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def drop_repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all columns, texts without what also starts earlier (n_chars follows); texts without any stay as they are."""
    _check(length)
    keyed = _keyed(docs, "text", F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]).alias("rest"))
    return keyed.join(removals(keyed, length), ["d", "t"], "left").select("text", "rest", "gone").mapInArrow(_rewrite(length, to_arrow_schema(docs.schema)), docs.schema)


def matching_spans(docs: DataFrame, references: DataFrame, length: int = LENGTH, shard_words: int = 1 << 16) -> DataFrame:
    """Spans of documents that lie in a given reference set: (doc_id, start, words), start counted in words.

    References are read in shards of about ``shard_words`` words, each one broadcast as an automaton past which all
    documents stream; a shard is the most that is held at once, on the driver and in a task. For small reference sets
    (benchmarks); a corpus against itself is ``substring_dedup``.
    """
    spark, out = docs.sparkSession, None
    shard, size = Automaton(), 0

    def search(shard: Automaton) -> DataFrame:
        shared = spark.sparkContext.broadcast(shard)

        def run(batches):
            for batch in batches:
                rows: list[tuple] = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    words = words_of([(text or "").encode("utf-8", "surrogatepass")])
                    ends = [e for e, _ in shared.value.statistics(words.hashes.tolist(), length)]
                    cover = np.zeros(len(words.hashes) + 1, np.int64)
                    for e in ends:
                        cover[e - length + 1] += 1
                        cover[e + 1] -= 1
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)))
                    rows += [(batch.column("doc_id")[i].as_py(), int(a), int(b - a)) for a, b in turn.reshape(-1, 2)]
                if rows:
                    d, s, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "words": pa.array(n, pa.int64())})

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, start bigint, words bigint")

    for row in references.select("text").toLocalIterator():
        words = words_of([(row["text"] or "").encode("utf-8", "surrogatepass")]).hashes.tolist()
        shard.add(words, [(0, i) for i in range(len(words))])
        size += len(words)
        if size >= shard_words:
            found = search(shard)
            out, shard, size = found if out is None else out.unionByName(found), Automaton(), 0
    if size or out is None:
        found = search(shard)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
