"""Toxicity: maximum-scoring segments of token log-odds, calibrated by their extreme-value distribution."""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import append, words

#: Hashed counters of words, and of their first PREFIX bytes.
WORDS, PREFIXES, PREFIX = 1 << 19, 1 << 16, 5
#: Labelled documents of each class that are learned from at most; every FOLDS-th calibrates.
SAMPLE, FOLDS = 10_000, 4
#: Strength of the Dirichlet priors of words and of prefixes.
WORD_PRIOR, PREFIX_PRIOR = 2.0, 5.0
#: What is taken off each token's log-odds, so that scores fall outside passages.
DRIFT = 0.7
#: Passages with fewer expected chance hits in a document than this are significant.
SIGNIFICANT = 0.05
#: Weight of the toxic documents, of 1, in the calibration.
TOXIC_WEIGHT = 0.2
#: Words back to which a repeated word counts for less; what stands further off has no say in a passage's score.
SPAN = 64
#: Cached token scores in a task.
CACHE = 500_000


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, sum), in linear time (Ruzzo and Tompa 1999).

    Each segment links to the nearest one before it with a smaller sum on its
    left, so that a search passes over no segment twice.
    """
    out: list[tuple] = []  # start, end, sum before, sum after, link
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, k = i, len(out) - 1
        while True:
            while k >= 0 and out[k][2] >= before:
                k = out[k][4]
            if k < 0 or out[k][3] >= total:
                out.append((start, i + 1, before, total, k))
                break
            start, _, before, _, link = out[k]
            del out[k:]
            k = link
    return [(a, b, after - before) for a, b, before, after, _ in out]


class _Scores(dict):
    """Token to score, filled as tokens come."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE:
            self.clear()
        p = zlib.crc32(word[:PREFIX]) % PREFIXES
        w = zlib.crc32(word) % WORDS
        score = self[word] = float(self.model.words[w] if self.model.known[w] else self.model.prefixes[p]) - DRIFT
        return score


@dataclass
class Model:
    words: np.ndarray  # log-odds by hashed word
    known: np.ndarray
    prefixes: np.ndarray
    rate: float = 1.0  # lambda of Karlin and Altschul
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def passages(self, tokens: list[bytes], cache: dict | None = None) -> list[tuple[int, int, float]]:
        """Start, end and sum of every maximal segment of a text's tokens."""
        cache = _Scores(self) if cache is None else cache
        s = np.fromiter(map(cache.__getitem__, tokens), np.float64, len(tokens))
        up = s > 0
        if not up.any():
            return []
        recent: dict[bytes, deque[int]] = {}
        for i in np.flatnonzero(up).tolist():  # the n-th time a word stands within SPAN words counts for an n-th
            at = recent.setdefault(tokens[i], deque())
            while at and at[0] <= i - SPAN:
                at.popleft()
            at.append(i)
            s[i] /= len(at)
        # neighbours of one sign act as one
        edge = np.flatnonzero(np.diff(up, prepend=not up[0]))
        ends = np.append(edge[1:], len(s))
        return [(int(edge[a]), int(ends[b - 1]), x) for a, b, x in segments(np.add.reduceat(s, edge).tolist())]

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Normalized scores of the significant passages summed, or of the best one if none is: minus the log of the expected chance hits."""
        norm = [self.rate * x - math.log(n + 1) - self.log_k for *_, x in found]
        significant = [x for x in norm if x > -math.log(SIGNIFICANT)]
        return sum(significant) if significant else max(norm, default=-math.log(n + 1) - self.log_k)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


def _log_odds(counts: np.ndarray, strength: float) -> np.ndarray:
    """Toxic against other rates of each counter, both drawn by a Dirichlet prior to the common rate."""
    both = counts.sum(0)
    rates = [(own + strength) / (both * own.sum() / both.sum() + strength) for own in counts]
    return np.log(rates[0]) - np.log(rates[1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {(kind, y): np.zeros(size, np.int64) for kind, size in (("w", WORDS), ("p", PREFIXES)) for y in (0, 1)}
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = set(words(text))
            counts["w", y][[zlib.crc32(w) % WORDS for w in seen]] += 1
            np.add.at(counts["p", y], [zlib.crc32(w[:PREFIX]) % PREFIXES for w in seen], 1)
    for kind in "wp":
        a, b = counts[kind, 0], counts[kind, 1]
        at = np.flatnonzero(a + b)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(at), pa.array(a[at]), pa.array(b[at])], names=["kind", "at", "other", "toxic"])


def train(labelled: DataFrame, *, text: str = "text", toxic: str = "toxic") -> Model | None:
    """A model from rows with a text, a 0/1 label and ``_fold``: fold 0 calibrates, the others are counted.

    Log-odds compare in how many toxic and other documents a word stands; a
    rare word scores as the words that begin alike. None unless both classes
    occur.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(toxic).cast("int").alias("y"), "_fold").where("t is not null and y in (0, 1)")
    counted = rows.where("_fold != 0").select("t", "y").mapInArrow(_count, "kind string, at long, other long, toxic long")
    sums = counted.groupBy("kind", "at").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    counts = {"w": np.zeros((2, WORDS)), "p": np.zeros((2, PREFIXES))}
    kinds = np.array(sums.column("kind").to_pylist(), dtype=object)
    for kind, c in counts.items():
        mine = kinds == kind
        at = sums.column("at").to_numpy()[mine]
        c[0, at], c[1, at] = sums.column("toxic").to_numpy()[mine], sums.column("other").to_numpy()[mine]
    if not counts["w"].sum(1).all():
        return None
    prefixes = _log_odds(counts["p"], PREFIX_PRIOR)
    # words of under three documents score by their prefix instead
    base = _log_odds(counts["w"], WORD_PRIOR)
    model = Model(base.astype(np.float32), counts["w"].sum(0) > 2, prefixes.astype(np.float32))
    share, score = counts["w"][1] / counts["w"][1].sum(), np.where(model.known, base, 0.0) - DRIFT
    model.rate = _karlin(share, score)
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shipped.value, _Scores(shipped.value)
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                seen = words(t)
                out.append(m.evidence(m.passages(seen, cache), len(seen)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(1)], names=["x", "y"])

    held = rows.where("_fold = 0").select("t", "y").mapInArrow(measure, "x double, y int").toArrow()
    x, y = held.column("x").to_numpy(), held.column("y").to_numpy()
    if len(set(y.tolist())) == 2:
        # the mean of a Gumbel variable is its mode plus Euler's constant
        model.log_k = float(x[y == 0].mean() - 0.5772156649)
        model.slope, model.offset = _logistic(x - model.log_k, y)
    return model


def _karlin(share: np.ndarray, score: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1."""
    low, high = 1e-3, 1.0
    grows = lambda r: float((share * np.exp(np.minimum(r * score, 700))).sum()) > 1
    while not grows(high) and high < 16:
        high *= 2
    for _ in range(50):
        half = (low + high) / 2
        low, high = (low, half) if grows(half) else (half, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge; the toxic class weighs TOXIC_WEIGHT."""
    a, b = 0.1, 0.0
    weight = np.where(y == 1, TOXIC_WEIGHT / max(1, (y == 1).sum()), (1 - TOXIC_WEIGHT) / max(1, (y == 0).sum()))
    x = np.clip(x, -30, 60)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-3 * a, (weight * (p - y)).sum() + 1e-4 * b])
        h = weight * p * (1 - p)
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -5, 5)
    return float(max(a, 1e-3)), float(b)


def sample(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", toxic: str = "toxic", seed: int = 5) -> DataFrame:
    """Labelled documents, SAMPLE of each class at most, picked by a seeded hash of the id; with ``_fold``.

    The picked labels, at most 2 * SAMPLE rows of three numbers, are broadcast,
    so that no text is shuffled. A document with several labels is toxic if one
    of them says so. Null labels and ids are left out.
    """
    labels = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1)).groupBy(doc_id).agg(F.max(toxic).alias("_toxic"))
    labels = labels.withColumn("_draw", F.xxhash64(F.lit(seed), doc_id))
    counts = {r["_toxic"]: r["count"] for r in labels.groupBy("_toxic").count().collect()}
    drawn = F.shiftrightunsigned("_draw", 1) / float(1 << 63)
    picked = [labels.where((F.col("_toxic") == y) & (drawn < min(1.0, 1.15 * SAMPLE / counts.get(y, SAMPLE)))).orderBy("_draw", doc_id).limit(SAMPLE) for y in (0, 1)]
    picked = picked[0].unionAll(picked[1]).select(doc_id, "_toxic", F.pmod(F.shiftright("_draw", 7), F.lit(FOLDS)).alias("_fold"))
    return documents.join(F.broadcast(picked), doc_id).withColumnRenamed("_toxic", toxic)


def score(documents: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """The documents with ``score`` and ``passages``: start and end in words, and log-odds, of every significant toxic passage.

    Texts are scored whole, one by one, where they stand. Null and empty texts
    have no passage and the score of no evidence; without a model all scores
    are 0. Clashing columns are replaced.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    caches: list[_Scores] = []

    def run(texts: list) -> list[list]:
        m = shipped.value
        if m is None:
            return [[0.0] * len(texts), [[] for _ in texts]]
        if not caches:
            caches.append(_Scores(m))
        scores, found = [], []
        for t in texts:
            seen = words(t)
            all_ = m.passages(seen, caches[0])
            scores.append(m.probability(m.evidence(all_, len(seen))))
            found.append([{"start": a, "end": b, "log_odds": x} for a, b, x in all_ if m.rate * x - math.log(len(seen) + 1) - m.log_k > -math.log(SIGNIFICANT)])
        return [scores, found]

    return append(documents, [text], "score double, passages array<struct<start: int, end: int, log_odds: double>>", run)
