import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb2

from tidemark.llm.piece_encoding import decode, decode_ids, encode, encode_texts
from tidemark.llm.pieces import Pieces, load_pieces
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.token_counts import count_words, token_counts, vocabulary_automaton

PATH = tokenizer_file("piece_bpe_32k.model")


def texts(seed, n=400):
    rng = random.Random(seed)
    letters = ["▁", " ", "  ", "a", "b", "é", "ß", "\n", "\t", "日", "語", "😀", "12", "the", " in", "ing", " tion", "Hello", "<s>", "\x00"]
    return ["", " ", "   ", "\n", "word " * 300, "x" * 2000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def unigram_proto():
    """The same vocabulary read as a unigram model, which the library can run too."""
    model = pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb2.TrainerSpec.UNIGRAM
    for p in model.pieces:  # the library sums whole texts in single precision, where such a score blots out the others
        p.score = max(p.score, -32000.0)
    return model.SerializeToString()


@pytest.mark.parametrize("unigram", [False, True])
def test_ids_and_counts_equal_the_library(unigram):
    proto = unigram_proto() if unigram else None
    pieces = Pieces(PATH) if proto is None else Pieces(proto=proto)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
    rows = [t for t in texts(1) if len(t) < 1000] if unigram else texts(1)  # nor do long texts' sums stay exact there
    want = library.encode(rows)
    assert [x.tolist() for x in encode_texts(pieces, rows)] == want
    assert [decode_ids(pieces, x) for x in want] == [library.decode(x) for x in want]
    split = [pieces.marked_words(t) for t in rows]
    counts = count_words(pieces, vocabulary_automaton(pieces), sorted(set().union(*split)))
    assert [sum(counts[w] for w in s) for s in split] == [len(x) for x in want]


def test_round_trip_and_odd_rows(spark):
    rows = [*texts(2, 50), None]
    docs = spark.createDataFrame([(i if i else None, t, 1, "z") for i, t in enumerate(rows)], "doc_id bigint, text string, n_tokens int, ids string")
    got = encode(docs, PATH, with_ids=True)
    back = {r["doc_id"]: r["text"] for r in decode(got, PATH).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, PATH).collect()}
    for r in got.collect():
        text = rows[r["doc_id"] or 0] or ""
        ids = library.encode(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) == counts[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert back[r["doc_id"]] == text.replace("▁", " ") or text.startswith(" ") or "▁" in text
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode(docs.limit(0), PATH).count() == 0 and token_counts(docs.limit(0), PATH).count() == 0


def test_marked_words_hold_the_whole_text():
    pieces = load_pieces(PATH)
    for t in texts(3):
        assert "".join(pieces.marked_words(t)) == ("▁" + t.replace(" ", "▁") if t else "")


class Counted(dict):
    """A vocabulary that counts how often it is asked."""

    asked = 0

    def __contains__(self, piece):
        self.asked += 1
        return super().__contains__(piece)

    def get(self, piece, other=None):
        self.asked += 1
        return super().get(piece, other)


def test_known_words_are_walked_without_the_vocabulary():
    pieces, rows = Pieces(PATH), texts(4)
    first = encode_texts(pieces, rows)
    pieces.id = Counted(pieces.id)
    assert [x.tolist() for x in encode_texts(pieces, rows)] == [x.tolist() for x in first] and pieces.id.asked == 0


def test_states_hold_the_pieces_that_end_at_a_letter():
    pieces, rng = load_pieces(PATH), random.Random(5)
    vocabulary = list(pieces.id)
    for _ in range(300):
        word, state = "".join(rng.choice(vocabulary)[: rng.randrange(1, 9)] for _ in range(4)), pieces.states[""]
        for end, letter in enumerate(word, 1):
            state = pieces.step(state, letter)
            assert [p for _, p, _ in state.ends] == [word[i:end] for i in range(end - 1) if word[i:end] in pieces.id]


def test_a_small_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr("tidemark.llm.pieces.REMEMBERED", 40)
    pieces, rows = Pieces(PATH), texts(6)
    assert [x.tolist() for x in encode_texts(pieces, rows)] == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(rows)
    assert sum(map(len, pieces.followers.values())) + sum(len(s.steps) for s in pieces.states.values()) <= 40
