"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

A document's grade y is 0 (not toxic) to 3. The model has one weight per feature, shared by all thresholds:
P(y > k) = 1 / (1 + exp(theta_k - w.x)), theta_0 < theta_1 < theta_2; the severity is the expected grade, the sum of
P(y > k). It is rejected as toxic if P(y > 0) reaches a limit, which is set on held-out labels: of ``LIMITS`` the one with
the least share of toxic documents missed and, ``COST`` times as dear, of clean ones rejected.

Training uses at most ``TOXIC`` toxic and ``CLEAN`` other labelled documents, those of least hash, so the bound holds
at any size; one in four of them is held out for the limit. Everything else runs over all rows. Features are lower-case words and the first four and five letters of
longer ones; those that set toxic documents apart (log-likelihood ratio, at most ``FEATURES`` of them) are kept. The
labels only say toxic or not, so toxic documents are graded by how often such features occur in them, in thirds: the
severity orders texts by that, and no label says whether people would.

Edge cases: a null text or one without a word has severity 0 and stays; a very long text is read whole; labels without id or grade are left out; with no toxic or no other
labelled documents nothing is rejected; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOXIC, CLEAN, FEATURES = 3000, 6000, 4000
GRADES = 4
LIMITS, COST = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5), 10
#: The limit where no labels are held out.
REJECT = 0.25
#: A feature must occur in so many toxic documents, and stand out so clearly.
LEAST_DOCS, LEAST_RATIO, LEAST_LIFT = 3, 12.0, 8.0

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter:
    """Feature -> how often: words (bare), and the first letters of longer words (with a mark)."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        out[word] += n
        if len(word) > 5:
            out["^" + word[:5]] += n
        if len(word) > 4:
            out["^" + word[:4]] += n
    return out


def strength(n: int) -> float:
    """What a feature counts if it occurs n times: most of it lies in occurring at all."""
    return 1 + 0.5 * math.log(n)


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: tuple[float, ...]
    reject: float = REJECT

    def exceed(self, counts: Counter) -> list[float]:
        """P(y > k) for each threshold; 0 for a text without words."""
        if not counts:
            return [0.0] * len(self.thresholds)
        s = sum(self.weights[f] * strength(n) for f, n in counts.items() if f in self.weights)
        return [float(1 / (1 + np.exp(np.clip(t - s, -60, 60)))) for t in self.thresholds]


def _sample(labels: DataFrame, grade: int, n: int) -> DataFrame:
    """The ids of at most n labelled documents, those of least hash."""
    own = labels.filter(F.col("toxic") == grade).select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _document_counts(keep: Callable[[], set | None]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = keep(), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = features(text).keys()
                total.update(found if wanted is None else found & wanted)
        if total:
            yield pa.RecordBatch.from_pydict({"f": list(total), "n": list(total.values())})

    return run


def _vectors(keep: Callable[[], set]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keep()
        for batch in batches:
            rows = [[(f, n) for f, n in sorted(features(t).items()) if f in wanted] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"part": batch.column("part"), "f": pa.array([[f for f, _ in r] for r in rows], pa.list_(pa.string())), "n": pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int64()))}
            )

    return run


def _ratio(a: float, b: float, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a feature in a of n1 toxic and b of n0 other documents; 0 if it is not far more frequent in toxic ones."""
    if a / n1 <= LEAST_LIFT * b / n0:
        return 0.0

    def part(k: float, n: int, p: float) -> float:
        return k * np.log(max(p, 1e-12)) + (n - k) * np.log(max(1 - p, 1e-12))

    p = (a + b) / (n1 + n0)
    return 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, p) - part(b, n0, p))


def fit_ordinal(x: list[list[tuple[int, float]]], y: np.ndarray, size: int, grades: int = GRADES, rounds: int = 1500, rate: float = 0.1, ridge: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model by gradient descent on the log-likelihood.

    Thresholds are kept in order by learning the first and the logs of the steps between them.
    """
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.array([c for r in x for c, _ in r], np.int64)
    vals = np.array([v for r in x for _, v in r], float)
    w = np.zeros(size)
    t = np.concatenate([[1.0], np.zeros(grades - 2)])
    moment = [np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)]

    def sig(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, rounds + 1):
        theta = np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
        s = np.bincount(rows, vals * w[cols], minlength=len(x))
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        up, lo = sig(bounds[y + 1] - s), sig(bounds[y] - s)
        up[y == grades - 1], lo[y == 0] = 1.0, 0.0
        p = np.maximum(up - lo, 1e-12)
        d_up, d_lo = up * (1 - up) / p, lo * (1 - lo) / p
        g_s = (d_up - d_lo) / len(x)  # of the negative log-likelihood
        g_w = np.bincount(cols, vals * g_s[rows], minlength=size) + ridge * w
        g_theta = np.zeros(grades - 1)
        for k in range(grades - 1):
            g_theta[k] = (-d_up[y == k].sum() + d_lo[y == k + 1].sum()) / len(x)
        tail = np.cumsum(g_theta[::-1])[::-1]
        g_t = np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])
        for i, (param, grad) in enumerate(((w, g_w), (t, g_t))):
            moment[i][:] = 0.9 * moment[i] + 0.1 * grad
            moment[i + 2][:] = 0.99 * moment[i + 2] + 0.01 * grad**2
            param -= rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(moment[i + 2] / (1 - 0.99**step)) + 1e-8)
    return w, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])


def limit_of(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The limit for P(y > 0) on held-out documents; of equally good ones the nearest to ``REJECT``."""
    if not len(toxic) or not len(clean):
        return REJECT
    return min(LIMITS, key=lambda t: (float(np.mean(toxic < t) + COST * np.mean(clean >= t)), abs(t - REJECT), t))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sc = docs.sparkSession.sparkContext
    sample = {g: _sample(labels, g, n) for g, n in ((1, TOXIC), (0, CLEAN))}
    picked = sample[1].withColumn("toxic", F.lit(1)).unionByName(sample[0].join(sample[1], "doc_id", "left_anti").withColumn("toxic", F.lit(0)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most TOXIC + CLEAN ids
    both = texts.withColumn("aside", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).persist()
    held = both.filter("not aside")
    try:
        sizes = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        if not n1 or not n0:
            return Model({}, (np.inf,) * (GRADES - 1))
        counted = held.filter("toxic = 1").select("text").mapInArrow(_document_counts(lambda: None), "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
        common = {r["f"]: r["n"] for r in counted.filter(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "f").limit(20 * FEATURES).collect()}
        shared = sc.broadcast(set(common))
        other = held.filter("toxic = 0").select("text").mapInArrow(_document_counts(lambda: shared.value), "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
        clean = {r["f"]: r["n"] for r in other.collect()}
        ratios = {f: _ratio(a, clean.get(f, 0), n1, n0) for f, a in common.items()}
        chosen = sorted((f for f, r in ratios.items() if r >= LEAST_RATIO), key=lambda f: (-ratios[f], f))[:FEATURES]
        index = {f: i for i, f in enumerate(chosen)}
        known = sc.broadcast(set(chosen))
        vectors = both.withColumn("part", F.col("aside").cast("int") * 2 + F.col("toxic")).select("part", "text").mapInArrow(_vectors(lambda: known.value), "part int, f array<string>, n array<bigint>")
        rows: list[list[dict[str, int]]] = [[], [], [], []]  # clean and toxic ones to learn from, then those held out
        for r in vectors.collect():
            rows[r["part"]].append(dict(zip(r["f"], r["n"], strict=True)))
    finally:
        both.unpersist()
    clean_rows, toxic_rows = rows[:2]
    x = [[(index[f], strength(n)) for f, n in r.items()] for r in [*toxic_rows, *clean_rows]]
    amount = np.array([sum(r.values()) for r in toxic_rows], float)
    y = np.concatenate([1 + np.searchsorted(np.quantile(amount, [1 / 3, 2 / 3]), amount, side="left"), np.zeros(len(clean_rows))]).astype(int)
    w, theta = fit_ordinal(x, np.minimum(y, GRADES - 1), len(chosen))
    model = Model({f: float(w[i]) for f, i in index.items()}, tuple(map(float, theta)))
    # Texts without a chosen feature are scored as such, not as empty ones.
    chance = [np.array([model.exceed(Counter(r) or Counter({"": 1}))[0] for r in part]) for part in rows[2:]]
    return model._replace(reject=limit_of(chance[1], chance[0]))


def _scores(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = batch.column("text")
            exceed = [model.exceed(features(texts[i].as_py())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "severity": pa.array([sum(e) for e in exceed], pa.float64()), "p_toxic": pa.array([e[0] for e in exceed], pa.float64()), "rejected": pa.array([e[0] >= model.reject for e in exceed], pa.bool_())}
            )

    return run


def grade_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, severity (0 to 3), p_toxic, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scores(shared), "doc_id bigint, severity double, p_toxic double, rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't reject, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            keep = [shared.value.exceed(features(texts[i].as_py()))[0] < shared.value.reject for i in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
