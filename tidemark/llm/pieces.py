"""Piece vocabularies of SentencePiece models, and how their tokens are chosen.

Both kinds of model are decided by a forward cell per prefix of a word, so that words can share the cells of common
prefixes:

* unigram: the cell is the best score of the prefix and where its last piece starts. Ties keep the earliest start, and
  a letter without a piece costs the model's least score less ten, as in the library. Sums start afresh in each word;
  the library sums whole texts in single precision, so in long texts its sums round where these are exact.
* byte-pair: no sum of scores gives the merges' result, so the maximising step is replaced by an exact one. The last
  piece of a prefix is the one piece that stays apart from the last piece of the rest: a sequence is the result of the
  merges if and only if each two neighbours, merged by themselves, give just those two.

No piece of these vocabularies has a word mark inside, so a text falls into marked words that are tokenised by
themselves; a model with such pieces is refused.

Which pieces end at a letter is read off a state, the longest end of the letters so far that begins a piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MARK = "▁"


#: So many pairs of pieces, and steps from state to state, are remembered in a worker; beyond, all are forgotten.
REMEMBERED = 1 << 21


class State:
    """The longest end of the letters so far that begins a piece, and the pieces of two letters or more that end there."""

    __slots__ = ("begun", "ends", "steps")

    def __init__(self, begun: str, ends: tuple[tuple[int, str, dict[str, bool]], ...]):
        self.begun = begun
        self.ends = ends  # longest first: length, piece, and which pieces before it stay apart from it
        self.steps: dict[str, State] = {}


class _Codes(dict):
    """piece -> its id, or the ids a letter without a piece is spelled with, as little-endian unsigned 32-bit integers."""

    def __init__(self, pieces: Pieces):
        super().__init__((p, i.to_bytes(4, "little")) for p, i in pieces.id.items())
        self.spelled = pieces.spelled

    def __missing__(self, letter: str) -> bytes:
        return np.array(self.spelled(letter), "<u4").tobytes()


class Pieces:
    """A model's vocabulary: piece -> id, scores, and the byte pieces for letters that have none."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        model = pb2.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        spec, norm = model.trainer_spec, model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are")
        self.unigram = spec.model_type == spec.UNIGRAM
        if not self.unigram and spec.model_type != spec.BPE:
            raise ValueError("only unigram and byte-pair models")
        self.prefix = norm.add_dummy_prefix
        normal = (model.SentencePiece.NORMAL,)
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in normal}
        self.text = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a word mark inside")
        self.longest = max(map(len, self.id))
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == model.SentencePiece.BYTE}
        # How pieces read: marks are spaces, bytes of one-byte letters those letters; other bytes are read together.
        letter = {i: chr(b) for b, i in self.bytes.items() if b < 128}
        self.spoken = [letter.get(i, t.replace(MARK, " ")) for i, t in enumerate(self.text)]
        self.partial = {i: b for b, i in self.bytes.items() if b >= 128}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == model.SentencePiece.UNKNOWN), 0)
        self.penalty = np.float32(min(self.score[i] for i in self.id.values()) - 10)
        self.apart: dict[tuple, bool] = {}
        self.codes = _Codes(self)
        self.beginnings = {p[:n] for p in self.id for n in range(1, len(p) + 1)} | {""}
        self.followers: dict[str, dict[str, bool]] = {p: {} for p in self.id if len(p) > 1}
        self.states = {"": State("", ())}
        self.room = REMEMBERED

    def spelled(self, letter: str) -> list[int]:
        """A letter without a piece: its bytes, or the unknown piece."""
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in letter.encode("utf-8", "surrogatepass")]

    def marked_words(self, text: str) -> list[str]:
        """Marks before letters: each word starts with the marks before it; marks at the end are a word of their own."""
        if not text:
            return []
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        parts = marked.split(MARK)
        words, marks = ([parts[0]] if parts[0] else []), 0
        for p in parts[1:]:
            marks += 1
            if p:
                words.append(MARK * marks + p)
                marks = 0
        return [*words, MARK * marks] if marks else words

    def merged(self, text: str) -> list[str]:
        """Merges of neighbours, best score first and the leftmost of equal ones, until none is a piece."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                p = self.id.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.score[p] > best[0]):
                    best = (self.score[p], i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def settled(self, left: str, right: str) -> bool:
        """Whether the merges of two pieces, written on end, give just those two."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def stay_apart(self, left: str, right: str) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            known = self.apart[left, right] = self.settled(left, right)
        return known

    def _note(self) -> None:
        """Room for one more step or pair; when there is none, all are forgotten. States stay, at most one for each beginning."""
        self.room -= 1
        if self.room < 0:
            self.room = REMEMBERED - 1
            for pairs in self.followers.values():
                pairs.clear()
            for state in self.states.values():
                state.steps.clear()

    def step(self, state: State, letter: str) -> State:
        """The state after one more letter; remembered."""
        begun = state.begun + letter
        while begun not in self.beginnings:
            begun = begun[1:]
        found = self.states.get(begun)
        if found is None:
            ends = [begun[i:] for i in range(len(begun) - 1)]
            found = self.states[begun] = State(begun, tuple((len(p), p, self.followers[p]) for p in ends if p in self.id))
        self._note()
        state.steps[letter] = found
        return found

    def follows(self, left: str, right: str) -> bool:
        """``settled``, remembered with the states of the piece on the right."""
        fits = self.settled(left, right)
        self._note()
        self.followers[right][left] = fits
        return fits


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


class Cells:
    """Forward cells of a word's prefixes, as a stack: letters are added to the prefix that a word shares with the one before."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.word = ""
        self.last = [""]  # the last piece of each prefix
        self.best: list[float] = [0.0]
        self.states = [pieces.states[""]]

    def move_to(self, word: str) -> None:
        keep = 0
        for a, b in zip(self.word, word, strict=False):
            if a != b:
                break
            keep += 1
        self.word = word
        (self._extend_unigram if self.pieces.unigram else self._extend_merges)(keep)

    def _extend_merges(self, keep: int) -> None:
        """Longest pieces first; one alone fits, so a single letter needs no test once the others have failed."""
        last, states, step, follows = self.last, self.states, self.pieces.step, self.pieces.follows
        del last[keep + 1 :], states[keep + 1 :]
        state, end = states[keep], keep
        for piece in self.word[keep:]:
            state = state.steps.get(piece) or step(state, piece)
            end += 1
            for size, longer, pairs in state.ends:
                left = last[end - size]
                fits = pairs.get(left)
                if follows(left, longer) if fits is None else fits:
                    piece = longer
                    break
            states.append(state)
            last.append(piece)

    def _extend_unigram(self, keep: int) -> None:
        word, known, score, longest = self.word, self.pieces.id, self.pieces.score, self.pieces.longest
        del self.last[keep + 1 :], self.best[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            best, at = None, 0
            for start in range(max(0, end - longest), end):
                piece = known.get(word[start:end])
                if piece is None:
                    if end - start > 1:
                        continue
                    value = np.float32(self.best[start]) + self.pieces.penalty
                else:
                    value = np.float32(self.best[start]) + np.float32(score[piece])
                if best is None or value > best:
                    best, at = value, start
            self.last.append(word[at:end])
            self.best.append(float(best))

    def ids(self) -> bytes:
        """The word's ids as little-endian unsigned 32-bit integers."""
        out, end, last, codes = [], len(self.word), self.last, self.pieces.codes
        while end:
            piece = last[end]
            out.append(codes[piece])
            end -= len(piece)
        out.reverse()
        return b"".join(out)
