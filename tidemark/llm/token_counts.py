"""Token counts without tokens: Aho-Corasick matches and a dynamic programme that carries counts only.

The vocabulary's automaton runs once over a batch's distinct marked words, written on end, and enumerates every piece
that ends at every letter; no piece crosses from one word into the next. A cell per letter carries what decides the
tokenizer's choice (best score, or the last piece of a byte-pair model) and the number of pieces so far. Ties follow
the tokenizer: the piece that starts earliest. A letter without a piece counts its bytes.

Edge cases: null text is an empty text with no tokens; a text of any length is counted whole; ties between merges or scores go as in the library; repeated rows are counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.piece_encoding import _groups
from tidemark.llm.pieces import Pieces, load_pieces

#: Distinct words are counted together up to this many letters.
RUN_LETTERS = 1_000_000


def vocabulary_automaton(pieces: Pieces):
    import ahocorasick

    out = ahocorasick.Automaton()
    for piece in pieces.id:
        out.add_word(piece, piece)
    out.make_automaton()
    return out


@lru_cache(maxsize=2)
def _automaton(path: str):
    return vocabulary_automaton(load_pieces(path))


def count_words(pieces: Pieces, automaton, words: Iterable[str]) -> dict[str, int]:
    """Distinct marked words -> numbers of tokens."""
    out, run, size = {}, [], 0
    for word in words:
        run.append(word)
        size += len(word)
        if size >= RUN_LETTERS:
            out |= _count_run(pieces, automaton, run)
            run, size = [], 0
    return out | _count_run(pieces, automaton, run)


def _count_run(pieces: Pieces, automaton, words: list[str]) -> dict[str, int]:
    text = "".join(words)
    edges = np.cumsum([0, *map(len, words)]).tolist()
    n = len(text)
    counts = [0] * (n + 1)
    step = _unigram if pieces.unigram else _merges
    step(pieces, automaton, text, set(edges), counts)
    return {w: counts[e] for w, e in zip(words, edges[1:], strict=True)}


def _by_end(automaton, text: str) -> Iterator[tuple[int, list[str]]]:
    """(end, pieces that end there, longest first) for every letter, also those where none ends."""
    matches = automaton.iter(text)
    nxt = next(matches, None)
    for end in range(1, len(text) + 1):
        found = []
        while nxt is not None and nxt[0] == end - 1:
            found.append(nxt[1])
            nxt = next(matches, None)
        yield end, found


def _merges(pieces: Pieces, automaton, text: str, edges: set[int], counts: list[int]) -> None:
    """``counts`` holds the pieces of each word so far; a word's first letter starts from none.

    At each end the longest match comes first and one alone fits, so a single letter needs no test once others have failed.
    """
    apart, known, seen = pieces.stay_apart, pieces.id, pieces.apart
    n = len(text)
    last = [""] * (n + 1)

    def single(end: int) -> None:
        letter = text[end - 1]
        last[end] = letter
        counts[end] = (0 if end - 1 in edges else counts[end - 1]) + (1 if letter in known else len(pieces.spelled(letter)))

    done = 0  # all ends up to here are settled
    for i, piece in automaton.iter(text):
        end, size = i + 1, len(piece)
        if end > done + 1:
            for e in range(done + 1, end):
                if not last[e]:
                    single(e)
            done = end - 1
        if size == 1 or last[end]:
            continue
        start = end - size
        first = start in edges
        pair = ("" if first else last[start], piece)
        fits = seen.get(pair)
        if apart(*pair) if fits is None else fits:
            last[end] = piece
            counts[end] = (0 if first else counts[start]) + 1
    for e in range(done + 1, n + 1):
        if not last[e]:
            single(e)


def _unigram(pieces: Pieces, automaton, text: str, edges: set[int], counts: list[int]) -> None:
    known, score = pieces.id, pieces.score
    best = [0.0] * (len(text) + 1)
    done = [0] * (len(text) + 1)
    for end, found in _by_end(automaton, text):
        top, n = None, 0
        if not found or len(found[-1]) > 1:
            found.append(text[end - 1])
        for piece in found:  # longest first, which starts earliest and so keeps ties
            start = end - len(piece)
            first = start in edges
            number = known.get(piece)
            value = np.float32(0.0 if first else best[start]) + (pieces.penalty if number is None else np.float32(score[number]))
            if top is None or value > top:
                top, n = value, (0 if first else done[start]) + (1 if number is not None else len(pieces.spelled(piece)))
        best[end], done[end], counts[end] = float(top), n, n


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, automaton = load_pieces(path), _automaton(path)
        for batch in batches:
            for first, texts in _groups(batch):
                split = [pieces.marked_words(t) for t in texts]
                known = count_words(pieces, automaton, sorted(set().union(*split)))
                counts = [sum(map(known.__getitem__, words)) for words in split]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(texts)), "n_tokens": pa.array(counts, pa.int64())})

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_count(path), "doc_id bigint, n_tokens bigint")
