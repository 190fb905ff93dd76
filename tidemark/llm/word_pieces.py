"""Ids of byte-pair vocabularies that mark the end of a word, equal to the tokenizer file's own library.

Such a model lower-cases the text, leaves white space out and merges each word by itself, so a text's ids are those of
its words one after the other and a word need only be merged once per worker. Merging runs on the faster of the
installed byte-pair encoders: the end of a word becomes a byte that no text holds, and joining it to the letter before it is
made the first of all merges. Words with letters beyond those whose class and case never changed between Unicode
versions, and the strings of special tokens, go to the file's own library, cut at white space.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from tidemark.llm.packing import _byte_letters

#: White space between chunks, letters and the splitting rule of this family of vocabularies (fixed values).
_SPACE = "\\t-\\r "
_LETTERS = "a-zÀ-ÖØ-öø-į"
_RULE = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_SPACE}{_LETTERS}0-9]+"
#: What the rule above may not decide by itself.
_OTHER = re.compile(f"[^{_SPACE}!-~A-Z{_LETTERS}]|<\\|")
_CHUNK = re.compile(f"[^{_SPACE}]+")
_END = b"\xff"
#: Words that a worker remembers before it starts afresh, and the longest that it does.
REMEMBERED, LONGEST = 300_000, 64


class _Memory(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        out = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class WordPieces:
    """text -> ids, as bytes of little-endian unsigned 32-bit integers, without added tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, special = spec["model"]["end_of_word_suffix"], {t["content"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        whole = {}
        for piece, i in spec["model"]["vocab"].items():
            if piece not in special:
                ends = piece.endswith(suffix) and piece != suffix
                body = bytes(letters[c] for c in (piece[: -len(suffix)] if ends else piece))
                whole[body + _END if ends else body] = i
        # Ranks in the order of merging: first the letters that end a word, then single letters, then the merges by id.
        order = sorted(whole, key=lambda p: (0 if len(p) == 2 and p.endswith(_END) else 1 if len(p) == 1 else 2, whole[p]))
        self.ids = np.array([whole[p] for p in order], "<u4")
        self.merge = tiktoken.Encoding("words", pat_str=_RULE, mergeable_ranks={p: r for r, p in enumerate(order)}, special_tokens={})._encode_single_piece
        self.pieces = re.compile(_RULE).findall
        self.known, self.odd = _Memory(self._merged), _Memory(self._by_library)

    def _merged(self, piece: str) -> bytes:
        return self.ids[self.merge(piece.encode() + _END)].tobytes()

    def _by_library(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(text.lower())))

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text) is None:
            return self._plain(text)
        return b"".join([self._plain(c) if _OTHER.search(c) is None else self.odd[c] for c in _CHUNK.findall(text)])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordPieces:
    return WordPieces(path)
