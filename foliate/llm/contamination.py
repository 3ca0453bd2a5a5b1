"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import append, words

#: Words in a window; an item of fewer words is one window.
WINDOW = 10
#: Words in a block of the shift tables.
BLOCK = 2
#: Bytes that the tables of one pass may take, and that a word of the benchmark adds to them at most, beside its own; a larger benchmark is searched in several passes.
TABLE_BYTES, WORD_COST = 256 << 20, 250
#: Multiplier of block hashes, and 64 bits.
MIX, FULL = 0x9E3779B97F4A7C15, (1 << 64) - 1


class WuManber:
    """Search for many word sequences of one length at once.

    Words are numbers by a vocabulary. ``shift`` is a table by the hash of a
    block of words: how far the window may move when its last block stands
    there in no pattern nearer to the end. Blocks of one hash share the lesser
    shift, which costs a look more and misses nothing. A block without shift
    leads to the bucket of patterns that end in it, and these are compared word
    by word. All tables are arrays, so they take a few tens of bytes a word.
    """

    def __init__(self, length: int, ids: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        """``ids`` are the words of all items one after another, ``starts`` where windows begin, ``owners`` the items they are of."""
        self.length, self.block = length, min(BLOCK, length)
        self.default = length - self.block + 1
        mixed = np.zeros(len(starts), np.uint64)
        for i in range(length):
            mixed = (mixed ^ ids[starts + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        last = self._blocks(ids, starts + length - 1)
        order = np.lexsort((mixed, last))
        starts, mixed, last, owners = starts[order], mixed[order], last[order], owners[order]
        same = (mixed[1:] == mixed[:-1]) & (last[1:] == last[:-1])
        for i in range(length):
            same &= ids[starts[1:] + i] == ids[starts[:-1] + i]
        cuts = np.flatnonzero(np.concatenate([[True], ~same]))
        self.ids, self.owners, self.keys = ids, owners, last[cuts]
        self.starts, self.ends = starts[cuts], np.append(cuts, len(starts))
        self.bits = max(8, int(len(starts)).bit_length() + 2)
        table = np.full(1 << self.bits, self.default, np.uint8 if self.default < 256 else np.int32)
        for away in range(self.default):
            at = self._slot(self._blocks(ids, self.starts + length - 1 - away))
            np.minimum.at(table, at, away)
        self.shift = table.tobytes() if table.dtype == np.uint8 else table

    def _blocks(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The block that ends at each place, as one number."""
        key = ids[last].astype(np.int64)
        return key if self.block == 1 else ids[last - 1].astype(np.int64) << 32 | key

    def _slot(self, keys):
        """The place of a block in the shift table; of arrays and of plain numbers alike."""
        if isinstance(keys, np.ndarray):
            return ((keys.astype(np.uint64) * np.uint64(MIX)) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (keys * MIX & FULL) >> (64 - self.bits)

    def _matches(self, key: int, text: list[bytes], start: int, number) -> Iterator[int]:
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        if low < high:
            mine = [number(w, -1) for w in text[start : start + self.length]]
            for g in range(low, high):
                at = self.starts[g]
                if self.ids[at : at + self.length].tolist() == mine:
                    yield g

    def search(self, text: list[bytes], number) -> Iterator[tuple[int, np.ndarray]]:
        """Start and items of every occurrence, in order; ``number`` is the vocabulary's get."""
        m, b, n, shift, bits = self.length, self.block, len(text), self.shift, 64 - self.bits
        at = m - 1
        while at < n:
            last = number(text[at])
            if last is None:
                at += m  # no window holds this word
                continue
            if b == 2:
                before = number(text[at - 1])
                if before is None:
                    at += m - 1
                    continue
                last |= before << 32
            step = shift[(last * MIX & FULL) >> bits]
            if step:
                at += int(step)
                continue
            for g in self._matches(last, text, at - m + 1, number):
                yield at - m + 1, self.owners[self.ends[g] : self.ends[g + 1]]
            at += 1


@dataclass
class Tables:
    """What a task needs: numbers of words, names of items, a search for each length of window."""

    vocabulary: dict[bytes, int]
    names: list[str]
    searches: list[WuManber]

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        for one in self.searches:
            for start, owners in one.search(text, self.vocabulary.get):
                yield start, one.length, owners


def build(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Tables:
    """The tables of some items, given by name and words; an item of fewer words than a window is one window."""
    vocabulary: dict[bytes, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for _, seen in items for w in seen), np.int32)
    sizes = np.array([len(seen) for _, seen in items], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    lengths = np.minimum(window, sizes)
    searches = []
    for k in sorted(set(lengths.tolist()) - {0}):
        mine = np.flatnonzero(lengths == k)
        counts = sizes[mine] - k + 1
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        searches.append(WuManber(k, ids, np.repeat(first[mine], counts) + inside, np.repeat(mine, counts)))
    return Tables(vocabulary, [name for name, _ in items], searches)


def _blocks(benchmark: DataFrame, limit: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words by blocks whose tables take at most ``limit`` bytes; the driver holds one at a time.

    An item too long for one block goes into several, in pieces that overlap
    by a window less one word.
    """
    piece = max(window, limit // (4 * WORD_COST))
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        seen = words(row[1])
        for at in range(0, max(1, len(seen) - window + 1), piece):
            part = seen[at : at + piece + window - 1]
            cost = WORD_COST * len(part) + sum(map(len, part))
            if block and size + cost > limit:
                yield block
                block, size = [], 0
            block.append((row[0], part))
            size += cost
    yield block  # an empty one if there are no items


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``items`` and ``n_items``.

    A document word is hit when it lies in an occurrence of any window. Search
    tables of at most ``table_bytes`` go to the tasks, one after another if the
    benchmark is larger, and each pass widens what the one
    before found. No document leaves its partition, so copies, hot sources and
    very long texts need nothing special.

    Null and empty texts have no words and no hit. Items with a null id or
    without words are never found; rows of one item id count as one item.
    Repeated documents each keep their row. Columns of the input that clash
    with a result column are replaced.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    sc = documents.sparkSession.sparkContext
    empty = (F.array().cast("array<int>").alias("_spans"), F.array().cast("array<string>").alias("items"))
    out = documents.drop("n_words", "n_hit", "n_items", "items", "_spans").select("*", *empty)
    kept = out.columns[:-2]
    for block in _blocks(items.where("i is not null and t is not null"), table_bytes, window):
        out = append(out, [text, "_spans", "items"], "n_words long, _spans array<int>, items array<string>", _search(sc.broadcast(build(block, window))))
    return out.select(
        *kept,
        "n_words",
        F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: x - a).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
    )


def _search(tables):
    """Widens the hit ranges and items of each text by what the tables find in it."""

    def run(texts: list[str | None], spans: list[list[int]], items: list[list[str]]) -> list[list]:
        sizes, ranges, names = [], [], []
        for text, old, known in zip(texts, spans, items, strict=True):
            seen, found, who = words(text), list(zip(old[::2], old[1::2], strict=True)), set(known)
            for start, length, owners in tables.value.search(seen):
                found.append((start, start + length))
                who.update(map(tables.value.names.__getitem__, owners.tolist()))
            sizes.append(len(seen))
            ranges.append(_merge(found))
            names.append(sorted(who))
        return [sizes, ranges, names]

    return run


def _merge(ranges: list[tuple[int, int]]) -> list[int]:
    """Disjoint ranges as start, end, start, end."""
    flat: list[int] = []
    for start, end in sorted(ranges):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat
