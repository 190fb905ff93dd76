"""Spelling variants: words one edit apart, and the frequent form each rare one belongs to.

Words are counted in the tasks that read the texts and only sums are shuffled. Near words are found by asymmetric
chunks, in joins of built-in expressions: of two words the shorter one (or the smaller, where both are as long) gives two disjoint chunks,
its halves; the other gives the grams that can equal a half, at the half's place or shifted by the one letter that it is longer.
One edit falls into one half and leaves the other whole, so near words meet in at least one of them, and the pairs that
met are verified. A half that many words share would bring all of them together: there the half that may differ is cut
in two again and the rest of the word is added to the key, until few words share a key or the part that may differ
is one letter, which leaves no more words than there are letters. So no group grows with the corpus, and no pair is lost.

Edge cases: null text has no words; a text or word of any length counts in full; rows that share an id, and repeated
rows, each count; a null id takes part as the text ``null`` in the hash that plants misspellings; among near words of equal
count the smaller in code-point order is the form; a form has at least five times the word's count, so forms never run in a circle; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Runs of letters in UTF-8: A-Z, a-z and U+00C0 to U+00FF, after lower-casing A-Z.
_RUNS = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Distinct words that a task counts before it hands its sums on.
HELD = 300_000
#: Words at one key up to which all of them are compared.
CROWD = 64


def misspelt(run: bytes, h: int, every: int) -> bytes:
    """The run without its letter h % length, if ``every`` divides h."""
    if not every or h % every:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counted(every: int, least_length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)

        def sums() -> pa.RecordBatch:
            words = [w for w in held if len(w.decode()) >= least_length]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array([held[w] for w in words], pa.int64())})

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                salt = zlib.crc32(f"{'null' if name is None else name}:".encode())
                for word, n in Counter(_RUNS.findall((text.as_py() or "").encode().lower())).items():
                    held[misspelt(word, zlib.crc32(word, salt), every)] += n
                if len(held) >= HELD:
                    yield sums()
                    held.clear()
        yield sums()

    return run


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n of all words of docs (doc_id, text), where one in ``every`` runs loses a letter (none, if 0)."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = src.mapInArrow(_counted(every, least_length), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _around(word: Column, start: Column, stop: Column, longer: Column) -> Column:
    """The letters before ``start`` and those from ``stop`` on, where the word is longer by so many letters, told apart by a stroke."""
    return F.concat(word.substr(F.lit(1), start), F.lit("|"), word.substr(stop + longer + 1, F.length(word)))


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """shorter, longer: all pairs of distinct words (column word) one inserted, deleted or replaced code point apart."""
    # A row says: where the word stands for one of ``size`` letters, the letters from start to stop may differ.
    n = F.length("word")
    chunks = words.select("word", F.lit(False).alias("gram"), n.alias("size"), F.lit(0).alias("longer"))
    grams = words.select("word", F.lit(True).alias("gram"), F.explode(F.array(n, n - 1)).alias("size")).withColumn("longer", n - F.col("size"))
    rows = chunks.unionByName(grams.filter("size >= 0")).withColumn("start", F.lit(0)).withColumn("stop", F.col("size"))
    found, level = None, 0
    while rows is not None:
        middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
        halves = F.when(F.col("stop") - F.col("start") > 1, F.array(F.struct(F.col("start").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("stop").alias("b")))).otherwise(
            F.array(F.struct(F.col("start").alias("a"), F.col("stop").alias("b")))
        )
        rows = rows.withColumn("h", F.explode(halves)).withColumn("start", F.col("h.a")).withColumn("stop", F.col("h.b")).drop("h")
        rows = rows.withColumn("key", F.xxhash64("size", "start", "stop", _around(F.col("word"), F.col("start"), F.col("stop"), F.col("longer"))))
        rows = cut(rows, f"grams-{level}")
        sizes = rows.groupBy("key").agg(F.count_if(~F.col("gram")).alias("c"), F.count_if("gram").alias("g"), F.max(F.col("stop") - F.col("start")).alias("open"))
        # A chunk meets its own word as a gram; a key of one word alone has no pair.
        sizes = sizes.filter("c > 0 AND c + g > 2").withColumn("crowded", (F.col("c") * F.col("g") > crowd * crowd) & (F.col("open") > 1))
        sizes = cut(sizes, f"keys-{level}")
        meet = rows.join(sizes.filter("NOT crowded").select("key"), "key", "left_semi")
        pairs = meet.filter("NOT gram").select("key", F.col("word").alias("shorter")).join(meet.filter("gram").select("key", F.col("word").alias("longer")), "key")
        pairs = pairs.filter((F.length("shorter") < F.length("longer")) | (F.col("shorter") < F.col("longer")))
        pairs = cut(pairs.filter(F.levenshtein("shorter", "longer", 1) == 1).select("shorter", "longer").distinct(), f"near-{level}")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = sizes.filter("crowded")
        rows = None if crowded.isEmpty() else rows.join(crowded.select("key"), "key", "left_semi").drop("key")
        level += 1
    return found.distinct() if level > 1 else found


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words (word, form) that have a form: forms followed to the last, twice as far each round."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, ratio: int = 5) -> DataFrame:
    """One row per distinct word: word, form, root, n, n_near, form_n."""
    words = cut(count_words(docs, least_length, least_count, every), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("shorter").alias("word"), F.col("longer").alias("near")), F.struct(F.col("longer").alias("word"), F.col("shorter").alias("near")))).alias("p")).select("p.*")
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The largest count first, then the smallest word: the least of (-n, word).
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    mine = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "b")
    is_form = -F.col("b.m") >= ratio * F.col("n")
    mine = cut(mine.select("word", F.when(is_form, F.col("b.near")).alias("form"), "n", "n_near", F.when(is_form, -F.col("b.m")).alias("form_n")), "forms")
    ends = roots(mine.filter("form IS NOT NULL"))
    return mine.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
