"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a bounded sample of labelled texts is built. A document is cut into the
longest phrases that occur in that sample, greedily from its start to its end; the number of phrases per letter, times
the logarithm of the sample's length, estimates how many bits a letter costs in that language, and the language needing
the fewest wins. Automata are built once, packed into arrays of one entry per transition (an alphabet of any size costs
nothing by itself) and broadcast.

Documents are parsed many at a time, in lanes of ``LANE`` letters. A lane is first parsed as if a phrase began with it;
where the document's own parse, coming from the lane before, starts a phrase at the same letter, both go on alike. Only
the letters up to there are parsed again, so the phrases are those of one parse of the whole text.

Only documents whose crc32 of the id, modulo 5, is not 0 are learned from. Each language's sample is whole documents:
those of least hash in ``BUCKETS`` groups, the shortest first, as long as they add up to at most ``TRAIN`` letters (the
shortest in any case). Those next in hash set how sharply bits turn into a score, by likelihood. Both numbers are
parameters; the models' size depends on them, the number of languages and, if a language has long documents only, the
shortest of those.

Words are runs of letters and the marks on them, lower-cased; nothing else of a text is compared.

Edge cases: a null text or one without a letter is ``und`` with score 0; equally good languages: the first by name;
without labelled documents all are ``und``; a null id counts as held out; a very long text is parsed whole, in time that grows in proportion; repeated
rows are each predicted; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, TRAIN = 48, 64_000
LANE = 512
#: Lanes up to which they are parsed one by one.
FEW = 64
BATCH_LETTERS = 1 << 21
#: What the score's sharpness is chosen from.
SHARPNESS = tuple(2.0**i for i in range(8))

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def normal(text: str | None) -> str:
    """Lower-case words of letters, one space between and around them; empty if there is no letter."""
    words = _WORD.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; the first is the start."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for s in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = clone
                    p = link[p]
        last = cur
    return nxt


class Packed(NamedTuple):
    """Transitions on symbol c of state s lie at base[s] + c, if owner says s there; goal is where they lead."""

    base: np.ndarray
    owner: np.ndarray
    goal: np.ndarray


def pack(transitions: list[dict[int, int]], symbols: int) -> Packed:
    """Rows are laid over one another in twice the room they need: the fullest first, each at the first random place that fits."""
    order = sorted(range(len(transitions)), key=lambda s: -len(transitions[s]))
    room = 2 * sum(map(len, transitions)) + 1
    rng = np.random.default_rng(1)
    used, base, places = bytearray(room + symbols), [0] * len(transitions), iter(())
    for s in order:
        codes = list(transitions[s])
        if not codes:
            break
        while True:
            at = next(places, None)
            if at is None:
                places = iter(rng.integers(0, room, 1 << 16).tolist())
            elif not any(used[at + c] for c in codes):
                break
        base[s] = at
        for c in codes:
            used[at + c] = 1
    owner, goal = np.full(room + symbols, -1, np.int32), np.zeros(room + symbols, np.int32)
    for s, row in enumerate(transitions):
        for c, q in row.items():
            owner[base[s] + c], goal[base[s] + c] = s, q
    return Packed(np.array(base, np.int32), owner, goal)


class Parser:
    """All languages' automata, over an alphabet of every letter in their samples; other letters match nothing."""

    def __init__(self, samples: tuple[tuple[str, str], ...], sharpness: float = 8.0):
        letters = sorted({c for _, text in samples for c in text})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.languages = [lang for lang, _ in samples]
        self.bits = np.array([np.log2(max(2, len(text))) for _, text in samples])
        self.automata = [pack(suffix_automaton(self.symbols(text).tolist()), len(letters) + 1) for _, text in samples]
        self.samples, self.sharpness = samples, sharpness

    def symbols(self, text: str) -> np.ndarray:
        """Numbers of the letters; one more than the last for a letter in no sample."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.letters, points), max(0, len(self.letters) - 1))
        return np.where(self.letters[at] == points, at, len(self.letters)).astype(np.int32) if len(self.letters) else np.zeros(len(points), np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[text, language]: numbers of phrases."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        out = np.zeros((len(texts), len(self.automata)))
        if not len(owner):
            return out
        number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        width = np.minimum(LANE, np.repeat(sizes, lanes) - number * LANE)
        grid = np.zeros((len(owner), LANE), np.int32)
        first = np.cumsum(lanes) - lanes
        for text, at, n in zip(texts, first.tolist(), lanes.tolist(), strict=True):
            grid[at : at + n].reshape(-1)[: len(text)] = self.symbols(text)
        order = np.argsort(-width, kind="stable")  # full lanes first: at every step the lanes that go on are the first ones
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lanes_in = _Lanes(np.ascontiguousarray(grid[order].T), width[order])
        # The lanes of each document of several, in order.
        chains = [place[at : at + n] for at, n in zip(first.tolist(), lanes.tolist(), strict=True) if n > 1]
        for k, automaton in enumerate(self.automata):
            out[:, k] = np.bincount(owner[order], lanes_in.phrases(automaton, chains), minlength=len(texts))
        return out

    def bits_a_letter(self, texts: list[str]) -> np.ndarray:
        return self.phrases(texts) * self.bits / np.maximum(1, [[len(t)] for t in texts])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        plain = [normal(t) for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        out = []
        for text, bits in zip(plain, self.bits_a_letter(plain), strict=True):
            if not text:
                out.append(("und", 0.0))
                continue
            best = int(bits.argmin())
            out.append((self.languages[best], float(1 / np.exp(-self.sharpness * (bits - bits[best])).sum())))
        return out

    def sharpened(self, rows: list[tuple[str, str]]) -> float:
        """The sharpness that makes other labelled texts (language, text) most likely."""
        rows = [(self.languages.index(lang), text) for lang, text in rows if text and lang in self.languages]
        if not rows:
            return self.sharpness
        bits, own = self.bits_a_letter([t for _, t in rows]), np.array([k for k, _ in rows])
        bits = bits - bits.min(axis=1, keepdims=True)

        def loss(sharp: float) -> float:
            return float(np.mean(sharp * bits[np.arange(len(own)), own] + np.log(np.exp(-sharp * bits).sum(axis=1))))

        return min(SHARPNESS, key=loss)


class _Lanes:
    """Letters by lane, steps[letter's number, lane], longer lanes first."""

    def __init__(self, steps: np.ndarray, width: np.ndarray):
        self.steps, self.width = steps, width
        self.going = np.searchsorted(-width, -np.arange(LANE))  # how many lanes are longer than the step's number

    def phrases(self, automaton: Packed, chains: list[np.ndarray]) -> np.ndarray:
        """Phrases that start in each lane, in one parse of each document."""
        n = len(self.width)
        starts, ends = np.zeros((LANE, n), bool), np.zeros(n, np.int32)
        for i, m in enumerate(self.going.tolist()):
            if not m:
                break
            ends[:m], starts[i, :m] = _step(automaton, ends[:m], self.steps[i, :m])
        seen = np.cumsum(starts, axis=0, dtype=np.int32)
        count = seen[-1].copy()
        if not chains:
            return count
        met, own = np.ones(n, bool), ends.copy()

        def go_on(lanes: np.ndarray, state: np.ndarray) -> None:
            """Parses lanes from the states that the lanes before end in, each up to where it meets the lane's own parse."""
            more, at, state = np.zeros(len(lanes), np.int32), np.arange(len(lanes)), state.copy()
            met[lanes], ends[lanes] = False, own[lanes]
            for i in range(LANE):
                at = at[self.width[lanes[at]] > i]
                if not len(at):
                    break
                state[at], begins = _step(automaton, state[at], self.steps[i, lanes[at]])
                both = begins & starts[i, lanes[at]]
                here = at[both]
                count[lanes[here]] = more[here] + seen[-1, lanes[here]] - seen[i, lanes[here]] + 1
                met[lanes[here]] = True
                more[at] += begins
                at = at[~both]
            rest = np.flatnonzero(~met[lanes])
            count[lanes[rest]], ends[lanes[rest]] = more[rest], state[rest]

        go_on(np.concatenate([c[1:] for c in chains]), ends[np.concatenate([c[:-1] for c in chains])])
        def go_on_alone(chain: np.ndarray, k: int) -> int:
            """Parses lane after lane of one document, letter by letter, from the k-th on as long as they never meet their own parse; gives the next place."""
            state = int(ends[chain[k - 1]])
            while k < len(chain) and not met[chain[k - 1]]:
                lane, more = chain[k], 0
                own_starts, after = starts[:, lane].tolist(), seen[:, lane]
                met[lane], ends[lane] = False, own[lane]
                for i, c in enumerate(self.steps[: self.width[lane], lane].tolist()):
                    at = base[state] + c
                    if owner[at] == state:
                        begins, state = state == 0, goal[at]
                    else:
                        begins, at = True, base[0] + c
                        state = goal[at] if owner[at] == 0 else 0
                    if begins:
                        if own_starts[i]:
                            count[lane] = more + after[-1] - after[i] + 1
                            met[lane] = True
                            break
                        more += 1
                else:
                    count[lane], ends[lane] = more, state
                state, k = int(ends[lane]), k + 1
            return k

        base, owner, goal = (memoryview(a) for a in automaton)
        # A lane after one that never met its own parse was begun in the wrong state; such lanes follow one another.
        waiting = [(c, 1) for c in chains if not met[c[:-1]].all()]
        while waiting:
            turn = []
            for chain, k in waiting:
                while k < len(chain) and met[chain[k - 1]]:
                    k += 1
                if k < len(chain):
                    turn.append((chain, k))
            if len(turn) > FEW:
                go_on(np.array([c[k] for c, k in turn]), ends[np.array([c[k - 1] for c, k in turn])])
                waiting = [(c, k + 1) for c, k in turn]
            else:  # so few are sooner done one letter after the other than a step of arrays at a time
                waiting = [(c, go_on_alone(c, k)) for c, k in turn]
        return count


def _step(automaton: Packed, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after a letter each, and whether that letter starts a phrase.

    A phrase that can't go on ends before the letter; a letter that is in no phrase is one of its own.
    """
    at = automaton.base[state] + symbols
    stuck = automaton.owner[at] != state
    starts = stuck | (state == 0)
    new = automaton.goal[at]
    if stuck.any():
        again = automaton.base[0] + symbols[stuck]
        new[stuck] = np.where(automaton.owner[again] == 0, automaton.goal[again], 0)
    return new, starts


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame) -> Parser:
    """From labelled documents that aren't held out: two of each of BUCKETS groups of every language, by least hash."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    marked = known.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(BUCKETS)))
    least = Window.partitionBy("lang", "bucket").orderBy("h")
    sizes = marked.select("lang", "bucket", "h", F.length("text").alias("n")).distinct().withColumn("k", F.row_number().over(least)).filter("k <= 2")
    chosen: dict[int, list[list[tuple[int, int, str]]]] = {1: {}, 2: {}}  # type: ignore[assignment]
    for r in sizes.collect():  # at most 2 * BUCKETS a language
        chosen[r["k"]].setdefault(r["lang"], []).append((r["n"], r["h"]))
    picked: dict[tuple[str, int], int] = {}
    for k, languages in chosen.items():
        for lang, rows in languages.items():
            total = 0
            for n, h in sorted(rows):
                if total and total + n > TRAIN:
                    break
                total += n
                picked[lang, h] = k
    if not picked:
        return Parser(())
    want = docs.sparkSession.createDataFrame([(lang, h, k) for (lang, h), k in picked.items()], "lang string, h bigint, k int")
    rows = marked.join(F.broadcast(want), ["lang", "h"]).select("lang", "h", "k", "text").dropDuplicates(["lang", "h"]).collect()
    rows = sorted(((r["lang"], r["h"], r["k"], normal(r["text"])) for r in rows))
    texts: dict[str, str] = {}
    for lang, _, k, text in rows:
        if k == 1:
            texts[lang] = texts.get(lang, "") + text.rstrip()
    parser = Parser(tuple((lang, texts[lang]) for lang in sorted(texts)))
    parser.sharpness = parser.sharpened([(lang, text) for lang, _, k, text in rows if k == 2])
    return parser


def _predict(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in batches:
            column, first, held, size = batch.column("text"), 0, [], 0
            for i in range(batch.num_rows + 1):
                text = column[i].as_py() if i < batch.num_rows else None
                if held and (i == batch.num_rows or size + len(text or "") > BATCH_LETTERS):
                    found = parser.predict(held)
                    rows = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "lang_pred": [x for x, _ in found], "score": pa.array([x for _, x in found], pa.float64())})
                    first, held, size = i, [], 0
                held.append(text)
                size += len(text or "")

    return run


def identify_language(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the share of the best language among all, by their bits)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return src.mapInArrow(_predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")
