"""Personal data: exact base patterns, and a character BiLSTM-CRF in numpy that adds the spans they miss."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import append

#: Kinds of the base patterns.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that the tagger tells: those of the base patterns, and keys, tokens and passwords, which it alone knows.
TAGGED = (*KINDS, "secret")
#: The base patterns, written so that a long run of signs is walked once: an e-mail is searched from its at sign outwards, a run of digits is begun at its start only.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Every span of any kind holds a digit or an at sign, or follows a sign that assigns; windows without one of these are not decoded.
TRIGGER = re.compile(r"[0-9@=]|[\[({] ?(?:at|dot) ?[\])}]|[a-z]: ?[\"'A-Za-z_/+-]{8}")
#: Characters in a window, and between the starts of two.
WINDOW, STRIDE = 96, 48
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(TAGGED)
EMBED, HIDDEN = 12, 20
#: Training: texts for contexts at most, characters of each, windows made from them, characters of these, passes.
CONTEXTS, CONTEXT_CHARS, EXAMPLES, LENGTH, EPOCHS, BATCH, RATE, SEED = 400, 2000, 5000, 72, 5, 48, 0.02, 3
#: Mean log-probability a character that a span needs.
LEAST = -1.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(map(_octet, text.split(".")))
    digits = re.sub(r"[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern without overlap, from each at sign to the left and to the right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost without overlap in each kind, failing matches dropped."""
    out = [(start, 0, end) for start, end in emails(text)]
    return sorted(out + [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) if k for m in BASE[kind].finditer(text) if _valid(kind, m[0])])


def _plausible(kind: int, text: str) -> bool:
    """Whether the numbers of a decoded span can be of its kind: ranges, lengths and checksums. The rest is for the tagger to tell."""
    if kind == 0:
        return "@" in text or "at" in text.lower()
    if kind == 4:
        return len(text) >= 8 and " " not in text
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(_octet, parts))
    digits = re.sub(r"[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def encode(text: str) -> np.ndarray:
    """ASCII as it is, every other letter as one sign."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 127, x, 127).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


LETTERS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
#: Text that is left out of training where no base pattern labels it, since it may be an item without a label.
RUN = re.compile(r"[A-Za-z0-9_+/-]{8,}")
UNSURE = re.compile(r"[0-9][0-9 ().-]{5,}[0-9]|[A-Za-z0-9]{18,}")


class Tagger:
    """Embedding, an LSTM in each direction, a linear layer, CRF transitions. Both directions take their steps together."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.w = {
            "e": draw.normal(0, 0.3, (128, EMBED)), "o": draw.normal(0, 0.2, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS),
            "x": draw.normal(0, 1 / np.sqrt(EMBED), (2, EMBED, 4 * HIDDEN)), "h": draw.normal(0, 1 / np.sqrt(HIDDEN), (2, HIDDEN, 4 * HIDDEN)), "z": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN), (2, 1, 1)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        # an inside follows a begin or inside of its kind only
        self.banned = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(TAGGED)):
            self.banned[:, 2 + 2 * k] = -1e4
            self.banned[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.first = np.where(np.arange(TAGS) % 2 == 0, np.float32(-1e4), np.float32(0))
        self.first[0] = 0

    def emissions(self, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        """Scores of each tag for windows; and what the gradients need: inputs, hidden states, the trace of every step."""
        e = self.w["e"][x]
        both = np.stack([e, e[:, ::-1]]).transpose(2, 0, 1, 3)  # step, direction, window, embedding
        size, _, n, _ = both.shape
        pre = both @ self.w["x"] + self.w["z"]
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        out, trace = np.empty((size, 2, n, HIDDEN), np.float32), []
        for t in range(size):
            g = pre[t] + h @ self.w["h"]
            gate, u = _sigmoid(g[..., : 3 * HIDDEN]), np.tanh(g[..., 3 * HIDDEN :])
            before = (h, c)
            c = gate[..., HIDDEN : 2 * HIDDEN] * c + gate[..., :HIDDEN] * u
            tc = np.tanh(c)
            out[t] = h = gate[..., 2 * HIDDEN :] * tc
            if keep:
                trace.append((gate, u, tc, *before))
        hidden = np.concatenate([out[:, 0], out[::-1, 1]], 2).transpose(1, 0, 2)
        return hidden @ self.w["o"] + self.w["c"], (both, hidden, trace)

    def _sweeps(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chance of each tag at each place, the expected number of moves from tag to tag, and the log of the sum over all paths.

        Forward and backward sums are scaled to one at each place.
        """
        n, size, _ = y.shape
        top = y.max(2, keepdims=True)
        e = np.exp(y - top).transpose(1, 0, 2)
        move = np.exp(self.w["t"] + self.banned)
        a, b, c = np.empty_like(e), np.ones_like(e), np.empty((size, n, 1), np.float32)
        for t in range(size):
            a[t] = (a[t - 1] @ move if t else np.exp(self.w["s"] + self.first)) * e[t]
            c[t] = np.maximum(a[t].sum(1, keepdims=True), 1e-30)
            a[t] /= c[t]
        e /= c
        for t in range(size - 2, -1, -1):
            b[t] = (e[t + 1] * b[t + 1]) @ move.T
        moves = move * np.tensordot(a[:-1], (e * b)[1:], ([0, 1], [0, 1]))
        return (a * b).transpose(1, 0, 2), moves, np.log(c).sum((0, 2)) + top.sum((1, 2))

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        y, (both, hidden, trace) = self.emissions(x)
        p, moves, z = self._sweeps(y)
        n, size, _ = y.shape
        rows = np.arange(n)
        move = self.w["t"] + self.banned
        gold = y[rows[:, None], np.arange(size), tags].sum(1) + self.w["s"][tags[:, 0]] + move[tags[:, :-1], tags[:, 1:]].sum(1)
        dy = p.copy()
        dy[rows[:, None], np.arange(size), tags] -= 1
        np.add.at(moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        g = {"t": moves / n, "s": dy[:, 0].sum(0) / n}
        dy /= n
        g["o"], g["c"] = np.tensordot(hidden, dy, ([0, 1], [0, 1])), dy.sum((0, 1))
        dh = dy @ self.w["o"].T
        back = np.stack([dh[:, :, :HIDDEN], dh[:, ::-1, HIDDEN:]]).transpose(2, 0, 1, 3)
        dg = np.empty((size, 2, n, 4 * HIDDEN), np.float32)
        g["h"], across = np.zeros_like(self.w["h"]), self.w["h"].transpose(0, 2, 1)
        back_h = back_c = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(size - 1, -1, -1):
            gate, u, tc, h0, c0 = trace[t]
            i, f, o = gate[..., :HIDDEN], gate[..., HIDDEN : 2 * HIDDEN], gate[..., 2 * HIDDEN :]
            now = back[t] + back_h
            dc = back_c + now * o * (1 - tc * tc)
            slope = gate * (1 - gate)
            dg[t, ..., :HIDDEN] = dc * u * slope[..., :HIDDEN]
            dg[t, ..., HIDDEN : 2 * HIDDEN] = dc * c0 * slope[..., HIDDEN : 2 * HIDDEN]
            dg[t, ..., 2 * HIDDEN : 3 * HIDDEN] = now * tc * slope[..., 2 * HIDDEN :]
            dg[t, ..., 3 * HIDDEN :] = dc * i * (1 - u * u)
            g["h"] += h0.transpose(0, 2, 1) @ dg[t]
            back_h, back_c = dg[t] @ across, dc * f
        g["x"], g["z"] = np.stack([np.tensordot(both[:, d], dg[:, d], ([0, 1], [0, 1])) for d in (0, 1)]), dg.sum((0, 2))[:, None]
        de = dg @ self.w["x"].transpose(0, 2, 1)
        de = (de[:, 0] + de[::-1, 1]).transpose(1, 0, 2).reshape(-1, EMBED)
        g["e"] = np.zeros_like(self.w["e"])
        np.add.at(g["e"], x.ravel(), de)
        return float((z - gold).mean()), g

    def fit(self, x: np.ndarray, tags: np.ndarray, seed: int = SEED) -> Tagger:
        """Adam over shuffled batches, the steps growing smaller towards the end."""
        draw, step, last = np.random.default_rng(seed), 0, EPOCHS * -(-len(x) // BATCH)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                rows, rate = order[at : at + BATCH], RATE * min(1.0, 1.5 * (1 - (step - 1) / last))
                for k, g in self.gradients(x[rows], tags[rows])[1].items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """For each window the spans of the best path: start, end, kind, mean log-probability of its characters' tags."""
        y, _ = self.emissions(x, False)
        p = np.log(np.maximum(self._sweeps(y)[0], 1e-30))
        n, size, _ = y.shape
        move, best = self.w["t"] + self.banned, y[:, 0] + self.w["s"] + self.first
        came = np.empty((size, n, TAGS), np.int64)
        for t in range(1, size):
            step = best[:, :, None] + move
            came[t] = step.argmax(1)
            best = step.max(1) + y[:, t]
        path = np.empty((n, size), np.int64)
        path[:, -1] = best.argmax(1)
        for t in range(size - 1, 0, -1):
            path[:, t - 1] = came[t, np.arange(n), path[:, t]]
        out = []
        for row in range(n):
            tags, spans, t = path[row], [], 0
            for t in np.flatnonzero(tags % 2):
                end = t + 1
                while end < size and tags[end] == tags[t] + 1:
                    end += 1
                spans.append((int(t), int(end), int(tags[t] // 2), float(p[row, np.arange(t, end), tags[t:end]].mean())))
            out.append(spans)
        return out


def _write(draw: np.random.Generator) -> tuple[int, str, str, str]:
    """One made-up item of personal data, in usual and in unusual spelling: kind, what stands before it, the item, what follows; kind -1 for look-alikes."""
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    number = lambda n: "".join(str(d) for d in draw.integers(0, 10, n))
    some = lambda signs, n: "".join(signs[int(i)] for i in draw.integers(0, len(signs), n))
    name = lambda low=2, high=9: some(LETTERS, int(draw.integers(low, high)))
    kind = int(draw.integers(0, 7))
    if kind == 0:
        user = name() + pick(["", f".{number(2)}", f"_{name()}", f".{name()}", number(1)])
        host = [pick([name(3), f"mail{number(1)}"]), pick(["example", name(3)]), pick(["com", "org", "net", "de", "fr", "es"])][int(draw.integers(0, 2)) :]
        at, dot = pick([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", ".")])
        return 0, "", user + at + dot.join(host), ""
    if kind == 1:
        dot = pick([".", ".", ".", "[.]", " . "])
        return 1, "", dot.join(str(int(x)) for x in draw.integers(0, 256, 4)), ""
    if kind == 2:
        digits = pick("3456") + number(14)
        digits = next(digits + d for d in "0123456789" if luhn(digits + d))
        by = pick(["", "", " ", "-", "."])
        return 2, "", by.join(digits[i : i + 4] for i in range(0, 16, 4)), ""
    if kind == 3:
        a, b, c = number(3), number(3), number(4)
        return 3, "", pick([f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}"]), ""
    if kind == 4:
        item = pick([
            lambda: some(HEX, pick([24, 32, 40, 64])), lambda: some(HEX, 40), lambda: some(HEX, pick([16, 18, 20])), lambda: some(LETTERS + LETTERS.upper() + DIGITS, int(draw.integers(16, 40))),
            lambda: "AKIA" + some(LETTERS.upper() + DIGITS, 16), lambda: "sk-" + some(LETTERS + DIGITS, 32), lambda: "ghp_" + some(LETTERS + LETTERS.upper() + DIGITS, 36),
        ])()
        key = pick(["token", "token", "password", "passwd", "secret", "api_key", "apikey", "key", "access_key", "auth", name()])
        if item[:3] in {"AKI", "sk-", "ghp"} and draw.random() < 0.5:
            return 4, "", item, ""
        by, quote = pick([" = ", "=", ": ", ":", " := "]), pick(['"', '"', "'", ""])
        return 4, key + by + quote, item, quote
    return -1, "", pick([
        lambda: some(HEX, 40), lambda: f"{number(1)}.{number(1)}", lambda: f"version {number(1)}.", lambda: f"{pick(['commit', 'sha1', 'digest', 'rev'])} {some(HEX, pick([7, 12, 40]))}", lambda: f"{name()} = {number(2)}",
        lambda: number(4), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(1)},{number(3)},{number(3)}", lambda: number(int(draw.integers(5, 9))), lambda: f"{number(1)}.{number(2)}.{number(1)}", lambda: f"@{name()}", lambda: f"{name()} = {name()}", lambda: f'{name()}="{name()}"', lambda: f"{number(2)}:{number(2)}",
    ])(), ""


def examples(contexts: list[str], count: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of running text with labelled spans: made-up items among the words, base spans where they stand."""
    draw = np.random.default_rng(seed)
    contexts = [c for c in contexts if c] or ["and so on, "]
    x, tags = np.full((count, LENGTH), 32, np.int64), np.zeros((count, LENGTH), np.int64)
    for row in range(count):
        text = contexts[int(draw.integers(len(contexts)))]
        start = int(draw.integers(0, max(1, len(text) - LENGTH)))
        piece, spans = text[start : start + LENGTH], []
        known = Taken([(a, b) for a, _, b in base_spans(piece)])
        if any(not known.meets(*m.span()) for m in UNSURE.finditer(piece)):
            piece = ""
        if draw.random() < 0.9:
            kind, before, item, after = _write(draw)
            at = piece.rfind(" ", 0, int(draw.integers(1, max(2, LENGTH - 8)))) + 1
            mark = ["", "", "", ".", ",", "!!", "###"][int(draw.integers(7))]
            piece = piece[:at] + before + item + after + mark + " " + piece[at:]
            at += len(before)
            spans = [(at, at + len(item), kind)] if kind >= 0 else [(at, at + len(item), -1)]
        taken = [(a, b) for a, b, _ in spans]
        spans = [s for s in spans if s[2] >= 0]
        spans += [(a, b, k) for a, k, b in base_spans(piece) if all(b <= s or a >= e for s, e in taken)]
        piece = piece[:LENGTH]
        x[row, : len(piece)] = encode(piece)
        for a, b, k in spans:
            if a < LENGTH:
                tags[row, a : min(b, LENGTH)] = 2 + 2 * k
                tags[row, a] = 1 + 2 * k
    return x, tags


@lru_cache(maxsize=4)
def _fitted(contexts: tuple[str, ...]) -> Tagger:
    return Tagger().fit(*examples(list(contexts)))


def train(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> Tagger:
    """A tagger from labelled spans in the text of CONTEXTS documents at most, CONTEXT_CHARS of each, picked by a seeded hash."""
    drawn = documents.where(F.length(text) > 0).select(F.xxhash64(F.lit(seed), doc_id).alias("d"), F.substring(text, 1, CONTEXT_CHARS).alias("t"))
    least = [r.d for r in drawn.select("d").orderBy("d").limit(CONTEXTS).collect()]
    rows = drawn.where(F.col("d") <= least[-1]).orderBy("d", "t").limit(CONTEXTS).collect() if least else []
    return _fitted(tuple(r.t for r in rows))


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold something a span needs; every such place lies in two windows, but at the text's ends."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    found: dict[int, None] = {}
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        found |= dict.fromkeys(min(max(i, 0), last) * STRIDE for i in (k - 1, k))
    return sorted(found)


class Taken:
    """The stretches that some spans cover, to ask what meets them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


class Runs:
    """Unbroken runs of a secret's signs; a span whose middle lies in one stands for all of it."""

    def __init__(self, text: str):
        self.runs = [m.span() for m in RUN.finditer(text)]

    def around(self, a: int, b: int) -> tuple[int, int]:
        k = bisect_right(self.runs, ((a + b) // 2, 1 << 62)) - 1
        return self.runs[k] if k >= 0 and self.runs[k][1] > (a + b) // 2 else (a, b)


class Holding:
    """Spans by kind, to ask whether one of a kind holds a stretch."""

    def __init__(self, spans: list[tuple[int, int, int, float]]):
        self.kinds: dict[int, tuple[list[int], list[int]]] = {}
        for a, b, k, _ in sorted(spans):
            starts, ends = self.kinds.setdefault(k, ([], []))
            starts.append(a)
            ends.append(max(b, ends[-1]) if ends else b)

    def holds(self, a: int, b: int, kind: int) -> bool:
        starts, ends = self.kinds.get(kind, ([], []))
        k = bisect_right(starts, a) - 1
        return k >= 0 and ends[k] >= b


def reconcile(found: list[tuple[int, int, int, float]], fixed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of all windows of a text, without overlap: the choice of greatest total weight, beside the fixed ones.

    A span weighs its characters by how far its mean log-probability is above
    LEAST; the same span from two windows counts once, with the better weight.
    """
    best: dict[tuple[int, int, int], float] = {}
    taken = Taken([(a, b) for a, _, b in fixed])
    for a, b, k, p in found:
        if p >= LEAST and not taken.meets(a, b):
            best[a, b, k] = max(best.get((a, b, k), 0.0), (b - a) * (p - LEAST))
    spans = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends, total, choice = [s[1] for s in spans], [0.0], [()]
    for i, (a, b, k) in enumerate(spans):
        j = bisect_right(ends, a, 0, i)
        with_it = total[j] + best[a, b, k]
        take = with_it > total[-1]
        total.append(with_it if take else total[-1])
        choice.append((j, (a, k, b)) if take else (len(choice) - 1, None))
    out, at = [], len(choice) - 1
    while at:
        at, span = choice[at]
        out += [span] if span else []
    return out[::-1]


def _decode(tagger: Tagger, texts: list[str], jobs: list[tuple[int, int, int]], base: list[list], found: list[list]) -> list[tuple[int, int, int]]:
    """Adds the plausible spans of some stretches (text, start, end) to ``found``; the wider stretches of spans that are cut come back.

    A cut part is done with when a whole span of its kind holds it, or a fixed
    one meets it. Parts of a text that meet or overlap, of windows or of
    stretches, become one stretch with as much again and STRIDE on both sides, which
    holds the stretches it came from, so that none comes back for ever.
    """
    parts: dict[int, list[tuple[int, int, int, int, int]]] = {}
    runs: dict[int, Runs] = {}
    jobs = sorted(jobs, key=lambda j: j[2] - j[1])  # those of a batch are of like length
    at = 0
    while at < len(jobs):
        some = jobs[at : at + 256]
        some = [j for j in some if j[2] - j[1] <= 2 * (some[0][2] - some[0][1])]
        at += len(some)
        x = np.full((len(some), max(e - s for _, s, e in some)), 32, np.int64)
        for i, (row, s, e) in enumerate(some):
            codes = encode(texts[row][s:e])
            x[i, : len(codes)] = codes
        for (row, s, e), made in zip(some, tagger.decode(x), strict=True):
            t = texts[row]
            for a, b, k, p in made:
                a, b = s + a, min(s + b, e)
                if a >= b:
                    continue
                if k == 4:
                    if row not in runs:
                        runs[row] = Runs(t)
                    low, high = runs[row].around(a, b)
                    if (low, high) != (a, b):
                        found[row] += [(low, high, k, p)] if _plausible(k, t[low:high]) else []
                        continue
                if (a == s and s > 0) or (b == e and e < len(t)):
                    parts.setdefault(row, []).append((a, b, k, s, e))
                elif _plausible(k, t[a:b]):
                    found[row].append((a, b, k, p))
    wider = []
    for row, cut in parts.items():
        joined: list[list[int]] = []
        whole, taken = Holding(found[row]), Taken([(s, e) for s, _, e in base[row]])
        for a, b, k, start, end in sorted(cut):
            if whole.holds(a, b, k) or taken.meets(a, b):
                continue
            if joined and a <= joined[-1][1]:
                last = joined[-1]
                last[1:] = max(b, last[1]), min(start, last[2]), max(end, last[3])
            else:
                joined.append([a, b, start, end])
        for a, b, start, end in joined:
            more = b - a + STRIDE
            wider.append((row, max(0, min(start, a - more)), min(len(texts[row]), max(end, b + more))))
    return wider


def spans_of(texts: list, tagger: Tagger) -> tuple[list[list], list[list]]:
    """(start, kind, end) of each text's base matches, and of these with what the tagger adds."""
    texts = [t or "" for t in texts]
    base, jobs = [], []
    for row, t in enumerate(texts):
        starts = window_starts(t)
        base.append(base_spans(t) if starts else [])  # every base span holds a trigger
        jobs += [(row, s, s + WINDOW) for s in starts]
    found: list[list] = [[] for _ in texts]
    while jobs:
        jobs = _decode(tagger, texts, jobs, base, found)
    return base, [sorted(fixed + reconcile(found[row], fixed)) if found[row] else fixed for row, fixed in enumerate(base)]


def find(documents: DataFrame, tagger: Tagger, *, text: str = "text") -> DataFrame:
    """The documents with ``base`` and ``spans``: arrays of kind, start and end in code points, by start, then kind.

    ``base`` are the matches of the base patterns, ``spans`` has what the
    tagger adds as well. Whole texts are searched; the tagger decodes the
    overlapping windows that hold a digit, an at sign, a bracketed "at" or "dot"
    or a sign that assigns, without which there is no span of any kind. Only the
    tagger tells secrets: keys, tokens and passwords. A span that a window's
    end cuts is decoded again, joined with what it meets, in a stretch wide
    enough to hold it. Null and empty texts have none. Texts are handled where
    they stand; clashing columns are replaced.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(tagger)

    def run(texts: list) -> list[list]:
        both = spans_of(texts, shipped.value)
        return [[[{"kind": TAGGED[k], "start": a, "end": b} for a, k, b in row] for row in x] for x in both]

    span = "array<struct<kind: string, start: int, end: int>>"
    return append(documents, [text], f"base {span}, spans {span}", run)
