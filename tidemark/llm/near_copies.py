"""Near copies by word shingles: min-hash buckets, bit-sliced SimHash fingerprints inside them, exact Jaccard to confirm.

Texts with equal sets of five-word shingles are one class, so copies are compared once. At a similarity of 0.8 two
64-bit fingerprints differ by about ten bits, and no blocks of bits that near copies must share would still tell texts
apart. So classes meet by ``BANDS`` keys of ``ROWS`` least hashes instead: two sets of similarity s share a key with a
probability of 1 - (1 - s**ROWS)**BANDS, all but 3 in 100000 at 0.8. Inside a bucket fingerprints are compared by
vertical bit planes and carry-save counters (``simhash.lanes_within``); lanes within ``RADIUS``, about five deviations
beyond what 0.8 gives, are compared by their whole sets, so no pair below the threshold is linked. Groups are the
links' connected parts; a task returns a spanning forest, never all pairs.

Two rounds keep this linear in a group of near copies of any size:

1. Over the first ``FIRST`` bands every bucket is cut into chunks of ``CHUNK`` shingles, dealt anew in each band, and only
   what lies in one chunk is compared. That unites all but a few of a large group.
2. Over all bands, buckets whose classes are united already are left out, and buckets of the same classes are one. In the
   others, classes of the largest part are each sent once, to meet the rest; the rest meets itself in pairs of chunks.
   Every pair of a bucket that is not united yet meets.

Edge cases: null text is an empty text; texts without words are one class and link to nothing else; texts of fewer than
five words have one shingle; a null id counts as the largest; repeated rows are one class and one of them stays; a very
long text is a chunk of its own; an empty table gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.simhash import connected, lanes_within, majority, planes_of, shingle_hashes

WORDS, LEAST = 5, 0.8
BANDS, ROWS, FIRST = 20, 4, 4
RADIUS = 28
#: Shingles that meet in one task at once, on either side.
CHUNK = 1 << 20
_RANDOM = np.random.default_rng(42)
_FLIP = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[i : i + 4096, None] ^ _FLIP) * _TIMES).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), n) - 2**63 for n, band in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, bands = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py() or "", words)
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                bands.append(band_keys(s))
            own = [batch.column(c) for c in ("h1", "h2", "doc_id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["h1", "h2", "doc_id", "class", "size", "bands"])

    return run


def similar_forest(sets: list[np.ndarray], least: float, labels: list | None = None) -> list[tuple[int, int]]:
    """Spanning links (i, root) of the sets whose Jaccard similarity is ``least`` or more.

    Sets of one label are linked already. Breadth-first; each set is compared with what is unseen.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(int(sizes.sum()), bool)
    names = np.unique(np.array(labels), return_inverse=True)[1] if labels else np.arange(n)
    order = np.argsort(names, kind="stable")
    own = np.split(order, np.cumsum(np.bincount(names))[:-1])
    fps = np.array([majority(s) for s in sets], np.uint64)
    planes = planes_of(fps)
    unseen, out = np.ones(n, bool), []
    for root in range(n):
        if not unseen[root]:
            continue
        frontier = own[names[root]].tolist()
        unseen[frontier] = False
        while frontier and unseen.any():
            block, frontier = frontier[:64], frontier[64:]
            lanes = np.unpackbits(lanes_within(planes, fps[block], RADIUS).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
            for at, close in zip(block, lanes, strict=True):
                others = np.flatnonzero(close & unseen & (np.minimum(sizes, sizes[at]) >= least * np.maximum(sizes, sizes[at]) - 1e-9))
                if not len(others):
                    continue
                mark[ids[at]] = True
                same = np.add.reduceat(mark[np.concatenate([ids[i] for i in others])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
                mark[ids[at]] = False
                for i in others[same >= least * (sizes[others] + sizes[at] - same) - 1e-9].tolist():
                    if unseen[i]:
                        unseen[own[names[i]]] = False
                        frontier += own[names[i]].tolist()
                        out.append((i, root))
    return out


def _links(words: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket -> confirmed links."""
        now, names, labels, sets = None, [], [], []

        def found() -> list[tuple[int, int]]:
            return [(names[i], names[k]) for i, k in similar_forest(sets, least, labels)] if len(sets) > 1 else []

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

        for batch in batches:
            links = []
            for bucket, name, label, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "cid", "label")), batch.column("text"), strict=True):
                if bucket != now:
                    links += found()
                    now, names, labels, sets = bucket, [], [], []
                names.append(name)
                labels.append(label)
                sets.append(shingle_set(text.as_py() or "", words))
            yield out(links)
        yield out(found())

    return run


def _hashed(docs: DataFrame) -> DataFrame:
    """(h1, h2, row): two hashes of all columns tell rows apart, so none needs a number; equal rows are interchangeable."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.xxhash64(F.lit(1), *columns).alias("h1"), F.xxhash64(F.lit(2), *columns).alias("h2"), F.struct(*columns).alias("row"))


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """(h1, h2, doc_id, class, size, bands) of each row."""
    src = _hashed(docs).select("h1", "h2", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"))
    return cut(src.mapInArrow(_sketches(words), "h1 bigint, h2 bigint, doc_id bigint, class binary, size bigint, bands array<bigint>"), "sketches")


def _chunks(size: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col(size) / CHUNK if isinstance(size, str) else size / CHUNK))


def _range(n: Column) -> Column:
    """0 to n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _named(docs: DataFrame, marked: DataFrame, words: int, least: float) -> DataFrame:
    """(class, lead, root): every class with its first row and the number of its group."""
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2"))
    classes = marked.groupBy("class").agg(lead.alias("lead"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    texts = _hashed(docs).select("h1", "h2", F.col("row.text").alias("text"))

    def compare(met: DataFrame) -> DataFrame:
        """met(bucket, cid, label) -> links, from the text of each class's first row."""
        need = met.select("cid").distinct().join(classes.select("cid", "lead.h1", "lead.h2"), "cid")
        same = Window.partitionBy("h1", "h2").orderBy("cid")
        own = texts.join(need, ["h1", "h2"]).withColumn("k", F.row_number().over(same)).filter("k = 1").select("cid", "text")
        full = met.join(own, "cid").select("bucket", "cid", "label", "text")
        return full.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(words, least), "a bigint, b bigint").distinct()

    def crossed(keyed: DataFrame, where: str) -> DataFrame:
        """Keys whose classes are not united yet, one of those that hold the same classes."""
        sums = keyed.groupBy("key").agg(
            F.min("band").alias("band"), F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("cid")).alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")
        )
        return sums.filter(f"lo <> hi and ({where})").groupBy("n", "total", "members").agg(F.min("key").alias("key")).select("key", "total")

    first = classes.select("cid", F.col("cid").alias("label"), "size", F.posexplode(F.slice("bands", 1, FIRST)).alias("band", "key"))
    met = first.join(crossed(first, "true"), "key").select(F.xxhash64("key", F.pmod(F.xxhash64("cid", "key"), _chunks("total"))).alias("bucket"), "cid", "label")
    links = cut(compare(cut(met, "met")), "first-links")

    roots = connected(links)
    labelled = cut(classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", F.coalesce("root", "cid").alias("label"), "size", "bands"), "labelled")
    every = labelled.select("cid", "label", "size", F.posexplode("bands").alias("band", "key"))
    met = cut(every.join(crossed(every, f"band >= {FIRST} or total > {CHUNK}"), "key").select("key", "total", "cid", "label", "size"), "met")
    small, large = met.filter(F.col("total") <= CHUNK), met.filter(F.col("total") > CHUNK)
    parts = large.groupBy("key", "label").agg(F.sum("size").alias("size")).groupBy("key").agg(F.max(F.struct("size", "label")).alias("main"))
    large = large.join(parts, "key")
    main = F.col("label") == F.col("main.label")
    n_main, n_rest = _chunks("main.size"), _chunks(F.col("total") - F.col("main.size"))
    chunk = F.pmod(F.xxhash64("cid"), F.when(main, n_main).otherwise(n_rest))
    place = lambda kind, a, b: F.xxhash64("key", F.lit(kind), a, b)
    among = F.transform(F.filter(_range(n_rest), lambda f: f != chunk), lambda f: place(1, F.least(chunk, f), F.greatest(chunk, f)))
    buckets = F.when(main, F.transform(_range(n_rest), lambda e: place(0, chunk, e))).otherwise(F.concat(F.transform(_range(n_main), lambda m: place(0, m, chunk)), among))
    met = small.select(F.col("key").alias("bucket"), "cid", "label").unionByName(large.select(F.explode(buckets).alias("bucket"), "cid", "label"))
    roots = connected(links.unionByName(compare(cut(met, "met"))))
    return classes.join(roots, classes["cid"] == roots["node"], "left").select("class", "lead", F.coalesce("root", "cid").alias("root"))


def near_copy_groups(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable over links of ``least`` similarity or more)."""
    docs = docs.select("doc_id", "text")
    marked = _marked(docs, words)
    named = _named(docs, marked, words, least)
    smallest = named.groupBy("root").agg(F.min("lead").getField("doc_id").alias("component_id"))
    return marked.select("doc_id", "class").join(named.join(smallest, "root").select("class", "component_id"), "class").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The documents with one row of each group, that of the smallest id. All columns as they were."""
    stay = _named(docs, _marked(docs, words), words, least).groupBy("root").agg(F.min("lead").alias("lead")).select("lead.h1", "lead.h2")
    same = Window.partitionBy("h1", "h2").orderBy("h1")
    return _hashed(docs).join(stay, ["h1", "h2"], "left_semi").withColumn("k", F.row_number().over(same)).filter("k = 1").select("row.*")
