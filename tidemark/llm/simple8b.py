"""Simple-8b: unsigned integers in 64-bit words, a selector in the top four bits saying how many share the other sixty.

A segment is: the mark ``S8B1``, values per block, number of values, of words and of escapes; then per block the number of the word it
starts at, so that any block is decoded by itself; the words; positions and values of the escapes. Each block starts a
word of its own. A value of more than sixty bits can stand in no word: its place holds zero and the value is an escape.
Encoding is greedy, the most values that fit into each word, done for all blocks at once; decoding spreads every word over
its values at once. All integers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

#: Selector -> values in a word, bits of each (the layout's fixed values).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)
MASKS = (np.uint64(1) << BITS) - np.uint64(1)
MARK, BLOCK = b"S8B1", 1024
_HEAD = struct.Struct("<4sIQQQ")
#: Blocks that are worked on together; bounds the memory of long segments.
_TOGETHER = 1024


def _ahead(a: np.ndarray, b: np.ndarray, places: int) -> np.ndarray:
    """At each place the larger of a there and b some places on."""
    out = a.copy()
    np.maximum(out[:, :-places], b[:, places:], out=out[:, :-places])
    return out


def _pack_blocks(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, words per block) of values below 2**60, at most _TOGETHER blocks of them."""
    n, rows = len(values), -(-len(values) // block)
    padded = np.zeros((rows, block + int(COUNTS[0])), np.uint64)
    flat = np.zeros(rows * block, np.uint64)
    flat[:n] = values
    padded[:, :block] = flat.reshape(rows, block)
    # The narrowest width that holds each value; the padding fits any, so that a block's last word may be filled up.
    widths, largest = np.ones(padded.shape, np.uint8), values.max(initial=0)
    for mask in MASKS[1:15]:
        if mask < largest:
            widths += padded > mask
    # The selector of a word that starts at a place: the first that is as wide as the widest of the values it would hold.
    best = np.full((rows, block), 15, np.uint8)
    widest, held, reach = widths, 1, {1: widths}
    for s in range(14, -1, -1):
        count = int(COUNTS[s])
        near = max(c for c in reach if 2 * c >= count) if any(2 * c >= count for c in reach) else None
        if near is None:  # two reaches of the one before don't meet
            near = held
            while 2 * near < count:
                reach[2 * near] = _ahead(reach[near], reach[near], near)
                near *= 2
        reach[count] = widest = _ahead(reach[near], reach[near], count - near)
        held = count
        best[widest[:, :block] <= max(s, 1)] = s
    at, lines = np.zeros(rows, np.int64), np.arange(rows)
    ends = np.full(rows, block, np.int64)
    ends[-1] = n - (rows - 1) * block
    begins = np.zeros((rows, block), bool)
    while len(lines):
        here = at[lines]
        begins[lines, here] = True
        at[lines] = here = here + COUNTS[best[lines, here]]
        lines = lines[here < ends[lines]]
    owner, starts = np.nonzero(begins)
    chosen = best[owner, starts]
    words = np.zeros(len(starts), np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        words[here] = np.uint64(s) << np.uint64(60)
        if BITS[s]:
            lanes = np.arange(COUNTS[s])
            held = padded[owner[here][:, None], starts[here][:, None] + lanes]
            words[here] |= np.bitwise_or.reduce(held << (lanes.astype(np.uint64) * BITS[s]), axis=1)
    return words, np.bincount(owner, minlength=rows)


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment of any unsigned 64-bit integers."""
    values = np.ascontiguousarray(values, np.uint64)
    escapes = np.flatnonzero(values > MASKS[15]).astype("<u8")
    kept = values.copy() if len(escapes) else values
    kept[escapes] = 0
    words, sizes = [], []
    for at in range(0, len(kept), _TOGETHER * block):
        w, k = _pack_blocks(kept[at : at + _TOGETHER * block], block)
        words.append(w.astype("<u8", copy=False))
        sizes.append(k)
    offsets = np.concatenate([[0], *sizes]).cumsum().astype("<u8")
    head = _HEAD.pack(MARK, block, len(values), int(offsets[-1]), len(escapes))
    return b"".join([head, offsets.tobytes(), *[w.tobytes() for w in words], escapes.tobytes(), values[escapes].astype("<u8").tobytes()])


def _unpack(words: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Values of blocks whose words start at ``firsts`` (from 0, ascending) and that hold ``lengths`` values."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    starts = np.cumsum(counts) - counts
    sizes = np.diff(np.append(firsts, len(words)))
    left = np.repeat(lengths + starts[firsts], sizes) - starts  # values of the block from this word on
    counts = np.minimum(counts, left)
    ends = np.cumsum(counts)
    lane = np.arange(int(ends[-1]), dtype=np.int64) - np.repeat(ends - counts, counts)
    bits = BITS[selectors]
    spread = np.repeat(words, counts) >> (lane.astype(np.uint64) * np.repeat(bits, counts))
    return spread & np.repeat(MASKS[selectors], counts)


def size(segment: bytes) -> int:
    return _HEAD.unpack_from(segment)[2]


def decode(segment: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The values of a segment from ``start`` up to ``stop``; only the blocks that hold them are read."""
    mark, block, n, n_words, n_escapes = _HEAD.unpack_from(segment)
    if mark != MARK:
        raise ValueError("not a Simple-8b segment")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint64)
    blocks = -(-n // block)
    offsets = np.frombuffer(segment, "<u8", blocks + 1, _HEAD.size).astype(np.int64)
    words = np.frombuffer(segment, "<u8", n_words, _HEAD.size + 8 * (blocks + 1))
    first, last = start // block, -(-stop // block)
    out = []
    for a in range(first, last, _TOGETHER):
        b = min(a + _TOGETHER, last)
        lengths = np.minimum(block, n - block * np.arange(a, b))
        out.append(_unpack(words[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], lengths))
    values = np.concatenate(out)
    if n_escapes:
        tail = np.frombuffer(segment, "<u8", 2 * n_escapes, _HEAD.size + 8 * (blocks + 1 + n_words))
        places = tail[:n_escapes].astype(np.int64) - first * block
        inside = (places >= 0) & (places < len(values))
        values[places[inside]] = tail[n_escapes:][inside]
    return values[start - first * block : stop - first * block]
