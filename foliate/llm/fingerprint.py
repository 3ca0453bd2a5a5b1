"""Document fingerprints: prefix polynomial hashes that answer the equality of any two spans."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.common import append

#: Two moduli of one size, a base for each; together 62 bits.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
#: Span hashes of a fingerprint at most.
SKETCH = 32
#: Points of a span that is hashed where the content says so, and the neighbouring spans of which the least is taken.
SPAN, NEIGHBOURS = 16, 32
#: UTF-8 bytes of text that a range of ids holds on average.
RANGE_BYTES = 32 << 20
#: Ranges at most; beyond, they hold more. Their bounds, and a few numbers of each, are all that the driver and every task see of all ids.
MOST_RANGES = 50_000


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


class Powers:
    """Powers of a base modulo PRIME, as many as the longest text so far needed."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(int(self.values[-1]) * self.base % PRIME)
            self.values = np.concatenate([self.values, _mod(self.values * step)])
        return self.values[:n]


_POWERS = tuple(Powers(b) for b in BASES)
_INVERSE = tuple(Powers(pow(b, -1, PRIME)) for b in BASES)


def _slide(pick: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """The least or greatest of every ``size`` neighbours, by doubling."""
    width = 1
    while width < size:
        step = min(width, size - width)
        x, width = pick(x[:-step], x[step:]), width + step
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """prefix[i]: the sum of point * base^position over the first i points, modulo PRIME, for both bases."""

    def __init__(self, points: np.ndarray):
        self.n, self._anchors, self._places = len(points), None, None
        wide = points.astype(np.uint64)
        # a sum of 2^32 terms below 2^31 fits in 64 bits
        self.prefix = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mod((wide + np.uint64(1)) * p.upto(self.n)))]) for p in _POWERS]

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of a span, still shifted by its start."""
        return tuple((p.item(end) - p.item(start)) % PRIME for p in self.prefix)

    def equal(self, start: int, other: PrefixHash, at: int, size: int) -> bool:
        """Whether two spans hold the same points: the one further left is shifted to the other."""
        one, i, two, j = (self, start, other, at) if start <= at else (other, at, self, start)
        for base in (0, 1):
            p, q = one.prefix[base], two.prefix[base]
            shift = _POWERS[base].upto(j - i + 1).item(j - i)
            if (p.item(i + size) - p.item(i)) % PRIME * shift % PRIME != (q.item(j + size) - q.item(j)) % PRIME:
                return False
        return True

    def common_extension(self, start: int, other: PrefixHash, at: int) -> int:
        """How far two texts agree from these positions on, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.equal(start, other, at, half) else (low, half - 1)
        return low

    def common_before(self, start: int, other: PrefixHash, at: int, most: int) -> int:
        """How far, up to ``most``, two texts agree backwards from these positions, by binary search."""
        low, high = 0, min(start, at, most)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.equal(start - half, other, at - half, half) else (low, half - 1)
        return low

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places set by content, and the hashes of the SPAN points from there on, whatever the place.

        Of every NEIGHBOURS neighbouring spans those of least mixed hash are
        taken, so that texts that share a run of SPAN + NEIGHBOURS - 1 points
        share an anchor in it.
        """
        if self._anchors is None:
            n = max(0, self.n - SPAN + 1)
            mixed = self._spans(0, np.arange(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            size = min(NEIGHBOURS, n)
            least = _slide(np.minimum, mixed, size)
            edge = np.zeros(max(0, size - 1), np.uint64)
            at = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), size) == mixed) if n else np.zeros(0, np.int64)
            self._anchors = at, self._spans(0, at) << np.uint64(31) | self._spans(1, at)
        return self._anchors

    def places(self) -> tuple[list[int], list[int], dict[int, list[int]]]:
        """The anchors as plain numbers: places, hashes, and the places of each hash."""
        if self._places is None:
            at, hashes = (x.tolist() for x in self.anchors())
            of: dict[int, list[int]] = {}
            for i, h in zip(at, hashes, strict=True):
                of.setdefault(h, []).append(i)
            self._places = at, hashes, of
        return self._places

    def _spans(self, base: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the SPAN points from each place, shifted back to place 0."""
        p = self.prefix[base]
        return _mod(_mod(p[at + SPAN] - p[at]) * _INVERSE[base].upto(self.n)[at])

    def found_in(self, other: PrefixHash) -> int:
        """So many points stand in the other text too, at any place, in common spans as long as they go.

        Spans are the common beginning and end, and those that hold an anchor
        of both texts.
        """
        done = self.common_extension(0, other, 0)
        end = self.n - self.common_before(self.n, other, other.n, self.n - done)
        total, follow = done + self.n - end, done
        mine, hashes, own = self.places()
        theirs = other.places()[2]
        if own.keys().isdisjoint(theirs):
            return total
        k = bisect_left(mine, done - SPAN + 1)
        while k < len(mine) and mine[k] < end:
            i, at = mine[k], theirs.get(hashes[k])
            k += 1
            if at is None:
                continue
            j = at[min(bisect_left(at, follow), len(at) - 1)]
            if not self.equal(i, other, j, SPAN):
                continue
            stop = i + self.common_extension(i, other, j)
            start = i - self.common_before(i, other, j, max(0, i - done))
            total += max(0, min(stop, end) - max(start, done))
            done, follow = max(done, stop), j + stop - i
            k = max(k, bisect_left(mine, done - SPAN + 1))
        return total

    def fingerprint(self) -> str:
        """Length, hash of the whole, and the SKETCH least span hashes of all anchors, which insertions leave alone but where they stand."""
        whole = int(self.prefix[0][-1]) % PRIME << 31 | int(self.prefix[1][-1]) % PRIME
        return f"{self.n}:{whole:016x}:" + ",".join(f"{h:016x}" for h in np.unique(self.anchors()[1])[:SKETCH].tolist())


def likeness(one: PrefixHash, two: PrefixHash, equal: bool) -> float:
    """The share of the longer text, in points, that stands in the other at any place; of both ways the lesser.

    Equal texts have 1, two empty ones too, all others less; an empty and
    another text 0.
    """
    if equal:
        return 1.0
    longest = max(one.n, two.n)
    found = min(one.found_in(two), two.found_in(one)) if one.n and two.n else 0
    return min(found, longest - 1) / longest


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pack(texts: list) -> list[list]:
    press = zstandard.ZstdCompressor(level=3)
    return [[press.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]]


def _measure(texts: list, nexts: list) -> list[list]:
    rows, press = [], zstandard.ZstdDecompressor()
    unpack = lambda z: press.decompress(z).decode("utf-8", "surrogatepass") if z else ""
    known = ("", PrefixHash(code_points("")))

    def hashed(text: str) -> PrefixHash:
        return known[1] if text == known[0] else PrefixHash(code_points(text))

    for text, following in zip(texts, nexts, strict=True):
        text, following = unpack(text), unpack(following)
        changed = edit(text, following)
        whole = hashed(text)
        known = (following, hashed(following))  # rows follow each other, so this is most often the next one's text
        other, after = hashed(changed), known[1]
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        near = [likeness(whole, x, text == t) for x, t in ((other, changed), (after, following))]
        rows.append((len(text), digest, whole.fingerprint(), other.fingerprint(), *near))
    return [list(x) for x in zip(*rows, strict=True)] or [[]] * 6


def _ranges(documents: DataFrame, doc_id: str, text: str, range_bytes: int) -> tuple[Column, Column, int]:
    """The bounds as a column, the range that each row is in by ``_bounds`` and ``_tie``, and how many ranges there are.

    Ranges are numbered from the last to the first row in the order of falling
    ids, rows of one id by their text's hash, null ids at the end. Ids that
    several quantiles fall on, and null ids, have ranges by their hash. The
    bounds are an array in the plan, searched in two steps.
    """
    sized = documents.agg(F.sum(F.octet_length(text)), F.sum(F.when(F.col(doc_id).isNull(), F.octet_length(text)))).first()
    total, unnamed = sized[0] or 0, sized[1] or 0
    range_bytes = max(range_bytes, total // MOST_RANGES)
    ranges = max(1, math.ceil(total / range_bytes))
    found = [int(x) for x in documents.approxQuantile(doc_id, [i / ranges for i in range(1, ranges)], 0.1 / ranges)] if ranges > 1 else []
    # an id that is met again and again has a range of its own, in as many parts
    often = {x: n for x, n in Counter(found).items() if n > 1}
    cuts = sorted({*found, *(x + 1 for x in often if x < (1 << 63) - 1)})
    parts = [1, *(often.get(c, 1) for c in cuts)]
    nulls = max(1, math.ceil(unnamed / range_bytes))
    before = [nulls, *(nulls + n for n in accumulate(parts))]
    step = max(1, math.isqrt(len(cuts)))
    rows = list(zip([-(1 << 63), *cuts], before, parts, strict=False))
    table = documents.sparkSession.createDataFrame([([rows[i : i + step] for i in range(0, len(rows), step)],)], "b array<array<struct<least: long, first: int, parts: int>>>")
    ident = F.col(doc_id).cast("long")
    at_most = lambda x: x["least"] <= ident
    last = lambda found: F.get(found, F.size(found) - 1)
    mine = last(F.filter(last(F.filter("_bounds", lambda block: at_most(block[0]))), at_most))
    place = F.pmod(F.shiftrightunsigned("_tie", 1) / float(1 << 63) + 0.5, F.lit(1.0))
    among = lambda n: n - 1 - F.least(F.floor(place * n), n - 1)
    # of the parts of one id those of greater hashes come later, and later rows have lesser numbers
    part = F.when(ident.isNull(), among(F.lit(nulls))).otherwise(mine["first"] + among(mine["parts"]))
    return table.scalar(), part.cast("int"), before[-1]


def fingerprint(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The documents, without their text, with ``n_chars``, ``fingerprint`` and what an edit does to it.

    The edited text ends in the beginning of the next document by descending
    id; after the last comes the first. The rows are dealt to ranges of that
    order of about ``range_bytes``, MOST_RANGES at most, and each range is
    sorted; texts go there packed, once. Only the first document of each range
    goes to its neighbour too; what is put in one order is a number a range.

    Null texts count as empty. Rows with a null id come last; rows that share
    an id, and those without one, follow each other by their text's hash, in
    several ranges if they are many. An empty table gives an empty result.
    Clashing columns are replaced.
    """
    made = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    keep = [c for c in documents.columns if c not in made and c != text]
    bounds, part, ranges = _ranges(documents, doc_id, text, range_bytes)
    rows = documents.select(*keep, text, F.xxhash64(text).alias("_tie")).withColumn("_bounds", bounds)
    rows = rows.select(*keep, text, part.alias("_part"), "_tie")
    heads = rows.groupBy("_part").agg(F.max(F.struct(F.col(doc_id).alias("_id"), F.bitwise_not("_tie").alias("_less"))).alias("h"))
    ring = Window.orderBy(F.col("_part").desc())
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_part").over(ring), F.last("_part").over(everything))
    heads = heads.select("_part", F.col("h._id").alias("_id"), F.bitwise_not("h._less").alias("_tie"), before.alias("_before"))
    # a row of four numbers for each range, MOST_RANGES at most
    heads = F.broadcast(heads)
    first = rows.join(heads.select("_part", "_tie", "_id", "_before"), ["_part", "_tie"]).where(F.col(doc_id).eqNullSafe(F.col("_id")))
    first = append(first, [text], "_head binary", _pack, ["_before"]).groupBy("_before").agg(F.first("_head").alias("_head"))
    packed = append(rows, [text], "_text binary", _pack, [*keep, "_part", "_tie"]).withColumn("_ghost", F.lit(False))
    # the first document of a range stands at the end of the range before it as well, as a row that is only looked at
    nothing = [F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in keep]
    ghosts = first.select(*nothing, F.col("_before").alias("_part"), F.lit(0).cast("long").alias("_tie"), F.col("_head").alias("_text"), F.lit(True).alias("_ghost"))
    packed = packed.select(ghosts.columns).unionAll(ghosts).repartitionById(ranges, F.col("_part"))
    inside = Window.partitionBy("_part").orderBy("_ghost", F.col(doc_id).desc_nulls_last(), "_tie")
    both = packed.withColumn("_next", F.lead("_text").over(inside)).where("not _ghost")
    fields = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return append(both, ["_text", "_next"], fields, _measure, keep)
