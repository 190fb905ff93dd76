"""SentencePiece encoding and decoding.

Each batch's distinct marked words are sorted, which is a depth-first walk of their trie: going from one word to the
next drops the forward cells behind the common prefix and computes only those of the new letters. Texts are then put
together from their words' ids. Nothing is shuffled. The public vocabulary at hand is a byte-pair model, whose result
no Viterbi sum gives; its cells follow the exact rule in ``pieces``, unigram models' cells are Viterbi's.

Edge cases: null text is an empty text, which has no ids; a word mark in a text decodes to a space, as in the library;
rows keep their order and number, repeated ones too; a text of any length is encoded whole; of two merges as good the one further to the left is made, as in the library; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pieces import MARK, Cells, Pieces, load_pieces

#: Texts are worked off together up to this many characters.
BATCH_CHARS = 8_000_000


def encode_words(pieces: Pieces, words: Iterable[str]) -> dict[str, bytes]:
    """Distinct marked words -> ids as little-endian unsigned 32-bit integers, by one walk of their trie."""
    cells, out = Cells(pieces), {}
    for word in sorted(words):
        cells.move_to(word)
        out[word] = cells.ids()
    return out


def encode_texts(pieces: Pieces, texts: list[str]) -> list[np.ndarray]:
    split = [pieces.marked_words(t) for t in texts]
    known = encode_words(pieces, set().union(*split))
    return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]


def decode_ids(pieces: Pieces, ids: Iterable[int]) -> str:
    """The text of ids; byte pieces are joined before they are read as UTF-8."""
    ids = list(ids)
    if pieces.partial.keys().isdisjoint(ids):
        text = "".join(map(pieces.spoken.__getitem__, ids))
    else:
        out, held = [], bytearray()
        for i in ids:
            if i in pieces.partial:
                held.append(pieces.partial[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(pieces.spoken[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
    return text[1:] if pieces.prefix and text.startswith(" ") else text


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    texts, first, held, size = batch.column("text"), 0, [], 0
    for i in range(batch.num_rows):
        text = texts[i].as_py() or ""
        if held and size + len(text) > BATCH_CHARS:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _encode(path: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        for batch in batches:
            for first, texts in _groups(batch):
                encoded = encode_texts(pieces, texts)
                out = {
                    "doc_id": batch.column("doc_id").slice(first, len(texts)),
                    "n_tokens": pa.array([len(x) for x in encoded], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in encoded], pa.int64()),
                    "decoded_sha256": [hashlib.sha256(decode_ids(pieces, x.tolist()).encode("utf-8", "surrogatepass")).hexdigest() for x in encoded],
                }
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in encoded], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_sha256 (and ids, if asked for)."""
    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_encode(path, with_ids), schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        for batch in batches:
            texts = [decode_ids(pieces, x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
