"""Language identification: a byte convolutional network in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import append

#: Bytes in a window.
WINDOW = 256
#: Filter widths, filters of each width, size of a byte's embedding.
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 4
#: Documents of each language, and of all, that the network learns from at most, and windows of each document. Every language has one at least.
SAMPLE, SAMPLE_ROWS, SAMPLE_WINDOWS = 1500, 60_000, 3
EPOCHS, RATE, BATCH, SEED = 6, 0.01, 64, 7
#: The prediction for texts without a letter.
UNDETERMINED = "und"


def windows(text: bytes) -> np.ndarray:
    """The bytes as rows of WINDOW, the last filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class ByteNetwork:
    """Embedding, filters of several widths, maximum over positions, softmax."""

    def __init__(self, labels: list[str], seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.w = {"e": draw.normal(0, 0.5, (256, EMBED)), "o": draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))), "c": np.zeros(len(labels))}
        for k in WIDTHS:
            self.w[f"f{k}"] = draw.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS))
            self.w[f"b{k}"] = np.zeros(FILTERS)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _columns(self, e: np.ndarray, k: int) -> np.ndarray:
        """Every k neighbouring embeddings as one row: a view, no copy."""
        n, size, d = e.shape
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, size - k + 1, k * d), (s[0], s[1], s[2]), writeable=False)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        e = np.ascontiguousarray(self.w["e"][x])
        parts, trace = [], []
        for k in WIDTHS:
            y = self._columns(e, k) @ self.w[f"f{k}"]
            at = y.argmax(1) if trace is not None else None
            parts.append(y.max(1) + self.w[f"b{k}"])
            trace.append(at)
        return np.maximum(np.concatenate(parts, 1), 0), [e, trace]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """For windows, a few at a time so that the columns stay in the cache."""
        out = []
        for at in range(0, len(x), 16):
            e = self.w["e"][x[at : at + 16]]
            parts = [(self._columns(e, k) @ self.w[f"f{k}"]).max(1) + self.w[f"b{k}"] for k in WIDTHS]
            out.append(np.maximum(np.concatenate(parts, 1), 0) @ self.w["o"] + self.w["c"])
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        hidden, (e, trace) = self.pooled(x)
        z = hidden @ self.w["o"] + self.w["c"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g = {"o": hidden.T @ p, "c": p.sum(0), "e": np.zeros_like(self.w["e"])}
        back = (p @ self.w["o"].T) * (hidden > 0)
        rows = np.arange(len(x))[:, None]
        for i, k in enumerate(WIDTHS):
            b, at = back[:, i * FILTERS : (i + 1) * FILTERS], trace[i]
            g[f"b{k}"] = b.sum(0)
            picked = self._columns(e, k)[rows, at]  # window, filter, k * EMBED
            g[f"f{k}"] = np.einsum("nf,nfd->df", b, picked)
            into = (b[:, :, None] * self.w[f"f{k}"].T[None]).reshape(-1, k, EMBED)
            for j in range(k):
                np.add.at(g["e"], x[rows, at + j].ravel(), into[:, j])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> ByteNetwork:
        """Adam over shuffled batches."""
        draw, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                rows = order[at : at + BATCH]
                for k, g in self.gradients(x[rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Label and probability of each text: the mean over its windows, by their bytes."""
        parts = [windows(t) for t in texts]
        z = self.logits(np.concatenate(parts))
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        share = np.concatenate([(np.minimum(WINDOW, len(t) - WINDOW * np.arange(len(w))) / len(t)) for t, w in zip(texts, parts, strict=True)])
        p = np.add.reduceat(p * share[:, None], np.cumsum([0, *map(len, parts)])[:-1], axis=0)
        return [(self.labels[i], min(1.0, float(q[i]))) for q, i in zip(p, p.argmax(1), strict=True)]


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", seed: int = SEED) -> ByteNetwork | None:
    """A network from a bounded sample: SAMPLE documents of each language at most, spread by a seeded hash.

    Every language with labelled text is learned; the more there are, the fewer
    documents of each, SAMPLE_ROWS in all or one of each language. The sample
    is SAMPLE_WINDOWS windows of a document, cut at seeded places of the whole
    text, so the driver holds about SAMPLE_ROWS * SAMPLE_WINDOWS * WINDOW bytes
    beside the network's row for each language. None without labelled text.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = rows.groupBy(lang).count().collect()
    if not counts:
        return None
    most = max(1, min(SAMPLE, SAMPLE_ROWS // len(counts)))
    # rows drawn by chance, with room that even a small number of a language is met but once in ten million times
    room = most + 6 * most**0.5 + 20
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[lang], min(1.0, room / r["count"]))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1) / float(1 << 63)
    places = F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1
    cuts = [F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(seed + i), doc_id), places) + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    picked = rows.withColumn("_draw", draw).where(F.col("_draw") < share[F.col(lang)]).select(lang, "_draw", F.array(*cuts).alias("cuts")).toArrow()
    per: dict[str, list] = {r[lang]: [] for r in counts}
    for label, at, parts in sorted(zip(*(c.to_pylist() for c in picked.columns), strict=True), key=lambda r: (r[0], r[1], r[2])):
        if len(per[label]) < most:
            per[label].append(parts)
    labels = sorted(k for k, v in per.items() if v)
    x, y = [], []
    for i, label in enumerate(labels):
        for parts in per[label]:
            for part in parts:
                x.append(windows(part.encode("utf-8", "replace"))[0])
                y.append(i)
    return ByteNetwork(labels, seed).fit(np.array(x), np.array(y), seed) if labels else None


def identify(documents: DataFrame, model: ByteNetwork | None, *, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``.

    The whole text counts, by windows. Texts that are null or without a letter
    are ``und`` with score 0, and so is everything without a model. Texts are
    handled one by one where they stand: copies, hot sources and repeated rows
    need nothing special. Clashing columns are replaced.
    """
    sc = documents.sparkSession.sparkContext
    shipped = sc.broadcast(model)
    rows = documents.drop("_letters").withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(texts: list, letters: list) -> list[list]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        known = [i for i, ok in enumerate(letters) if ok and shipped.value]
        for at in range(0, len(known), 64):
            some = known[at : at + 64]
            for i, found in zip(some, shipped.value.predict([texts[i].encode("utf-8", "replace") for i in some]), strict=True):
                out[i] = found
        return [list(x) for x in zip(*out, strict=True)] or [[], []]

    return append(rows, [text, "_letters"], "lang_pred string, score double", run).drop("_letters")
