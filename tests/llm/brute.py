"""Plain versions of the operators, one row after the other."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(docs, length=20):
    """docs: (doc_id, text) -> {doc_id: (n_words, n_removed, sha)}; ids are distinct."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][s : s + length]), (d, s))
    out = {}
    for d, w in words.items():
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (d, s):
                gone[s : s + length] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fingerprint(text, words=3):
    parts = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """{doc_id: fingerprint} -> {doc_id: smallest linked id}"""
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, i in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius)
        for j in near:
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_groups(docs, words=5, least=0.8):
    """{doc_id: text} -> {doc_id: smallest id reachable}, by the Jaccard similarity of word shingles of all pairs."""
    sets = {}
    for i, text in docs.items():
        parts = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if sets[a] == sets[b] or same >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def exact_top_k(vectors, queries, k, scale=64):
    whole = {i: [int(np.floor(scale * float(x))) for x in v] for i, v in vectors}
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def groups(rows):
    out = defaultdict(list)
    for k, v in rows:
        out[k].append(v)
    return out


def runs(words):
    """All (start, period, length) of a list of words: every period, every maximal stretch; the smallest period of each stretch."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in out.items())


def planted_words(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def periodic_runs(doc_id, text):
    words = planted_words(doc_id, text)
    found, gone = runs(words), set()
    for s, q, length in found:
        gone |= set(range(s + q, s + length))
    best = min(((-length, s, q) for s, q, length in found), default=None)
    said = "".join(f"{s},{length},{q}\n" for s, q, length in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (None, None, None, None) if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (len(found), *top, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def spelling_variants(docs, every=199, least_length=6, least_count=5, ratio=5):
    """(doc_id, text) -> {word: (form, root, n, n_near, form_n)}, comparing each word with all others of nearly its length."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}

    def one_apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: min(((-n[x], x) for x in near[w] if n[x] >= ratio * n[w]), default=(0, None))[1] for w in n}
    form = {w: f if f == min(((-n[x], x) for x in near[w]), default=(0, None))[1] else None for w, f in form.items()}
    out = {}
    for w in n:
        last = w
        while form[last] is not None:
            last = form[last]
        out[w] = (form[w], last, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out
