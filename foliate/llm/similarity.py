"""N-gram Jaccard join: MinHash bands find candidates, a posterior prunes them, exact sets decide."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import append, cut, set_apart, words
from foliate.llm.components import components

#: Words in a shingle, and the Jaccard similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: Bands and MinHash values in each. A pair at the threshold shares no band with a chance of (1 - 0.8^6)^48 = 5e-7.
BANDS, BAND = 48, 6
HASHES = BANDS * BAND
#: MinHash values compared at a time, and the posterior chance of a link below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Texts in a block; two blocks are compared in one task.
BLOCK = 256
#: Word hashes that a task remembers.
CACHE = 1_000_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(tokens: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of SHINGLE words; fewer words are one shingle."""
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    size = min(SHINGLE, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


_draw = np.random.default_rng(11)
_A = (_draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_MIX = _draw.integers(0, 1 << 63, BAND, dtype=np.uint64) | np.uint64(1)
_SALT = _draw.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def min_hash(shingle: np.ndarray) -> np.ndarray:
    low = (shingle >> np.uint64(16)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[None, at : at + 512] * _A + _B).min(1), out=out)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    rows = (signature.reshape(BANDS, BAND).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64) ^ _SALT
    rows *= np.uint64(0x94D049BB133111EB)
    return (rows ^ (rows >> np.uint64(31))).astype(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 0, STEP, 2 STEP, ... values compared: the least matches with which a pair stays.

    With a flat prior and m of n values equal the similarity is distributed as
    Beta(m + 1, n - m + 1), so that it is the threshold or more with the chance
    that a binomial variable of n + 1 trials at the threshold is at most m.
    """
    out = [0]
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def compare(left: list[int], right: list[int] | None, sets: list[np.ndarray], signatures: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Index pairs with a similarity of the threshold or more: of left and right, or among left.

    MinHash values are compared step by step and pairs are dropped on the way;
    what stays is verified with the sets.
    """
    other = left if right is None else right
    a, b = (np.array(left)[:, None], np.array(other)[None])
    keep = np.ones((len(left), len(other)), bool) if right is not None else np.arange(len(left))[:, None] < np.arange(len(left))[None]
    i, j = np.nonzero(keep)
    i, j = np.broadcast_to(a, keep.shape)[i, j], np.broadcast_to(b, keep.shape)[i, j]
    matches = np.zeros(len(i), np.int32)
    for step, least in enumerate(least_matches(threshold)[1:]):
        part = slice(step * STEP, (step + 1) * STEP)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            matches[s] += (signatures[i[s], part] == signatures[j[s], part]).sum(1, dtype=np.int32)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
    if not len(i):
        return []
    used = np.unique(np.concatenate([i, j]))
    codes = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)[1]
    cuts = np.cumsum([0, *(len(sets[k]) for k in used)])
    ids = {int(k): codes[cuts[n] : cuts[n + 1]] for n, k in enumerate(used)}
    flag, out = np.zeros(codes.max() + 1, bool), []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    edges = [*np.flatnonzero(np.diff(i, prepend=-1)), len(i)]
    for first, end in zip(edges, edges[1:], strict=False):
        k, partners = int(i[first]), [int(x) for x in j[first:end]]
        flag[ids[k]] = True
        for at in range(0, len(partners), 64):
            some = partners[at : at + 64]
            sizes = [len(ids[p]) for p in some]
            common = np.add.reduceat(flag[np.concatenate([ids[p] for p in some])].astype(np.int64), np.cumsum([0, *sizes[:-1]]))
            out += [(k, p) for p, c, n in zip(some, common.tolist(), sizes, strict=True) if c >= threshold * (len(ids[k]) + n - c)]
        flag[ids[k]] = False
    return out


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs enough to connect what the pairs connect."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _links(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        seen: dict[int, int] = {}
        sides: dict[int, list[int]] = {}
        sets, signatures, cache = [], [], _WordHash()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        for node, block, text in zip(*(group.column(c).to_pylist() for c in ("node", "block", "text")), strict=True):
            if node not in seen:
                seen[node] = len(sets)
                sets.append(shingles(words(text), cache))
                signatures.append(min_hash(sets[-1]))
                sides.setdefault(block, []).append(seen[node])
        nodes = list(seen)
        pairs = compare(sides.get(i, []), None if i == j else sides.get(j, []), sets, np.array(signatures), threshold) if i in sides and j in sides else []
        count: dict[int, int] = {}
        for pair in pairs:
            for k in pair:
                count[k] = count.get(k, 0) + 1
        rows = [(nodes[a], nodes[b], 0) for a, b in _forest(pairs)] + [(nodes[k], None, n) for k, n in count.items()]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], names=["a", "b", "n"])

    return run


def _texts(documents: DataFrame, text: str, keep: list[str], with_bands: bool = False) -> DataFrame:
    """Some columns with ``node``, a 64-bit hash of the text's words, null without words; and the bands."""
    cache = _WordHash()

    def run(texts: list) -> list[list]:
        nodes, found = [], []
        for t in texts:
            seen = words(t)
            nodes.append(xxhash.xxh3_64_intdigest(b" ".join(seen)) - (1 << 63) if seen else None)
            if with_bands:
                found.append(bands(min_hash(shingles(seen, cache))) if seen else None)
        return [nodes, found] if with_bands else [nodes]

    return append(documents, [text], "node long, bands array<long>" if with_bands else "node long", run, keep)


def _one_row(rows: DataFrame, nodes: DataFrame, doc_id: str) -> DataFrame:
    """One row of ``rows`` for each of ``nodes`` (node, rep, copies and others), with the node's columns.

    It has the node and its least id; of several with both, null ids included,
    the one with the least hash. Nodes of one document need no choice; the rows
    of others are pre-aggregated, so that repeated rows do not meet in one task.
    """
    nodes = nodes.withColumnRenamed("node", "_node")
    joined = rows.join(nodes, (F.col("node") == F.col("_node")) & F.col(doc_id).eqNullSafe(F.col("rep")))
    columns = [c for c in joined.columns if c != "_node"]
    chosen = F.min_by(F.struct(*columns), F.xxhash64(*rows.columns)).alias("_row")
    repeated = joined.where("copies > 1").groupBy("_node").agg(chosen).select("_row.*")
    return joined.where("copies = 1").select(columns).unionAll(repeated)


def _classes(documents: DataFrame, doc_id: str, text: str, threshold: float, block: int) -> DataFrame:
    """A row for each text with words: ``node``, ``label`` of its class, ``rep``, the least id, ``copies`` and ``n_links``."""
    texts = _texts(documents, text, [doc_id], True).where("node is not null")
    texts = cut(texts.groupBy("node").agg(F.min(doc_id).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))
    buckets = texts.select("node", F.explode("bands").alias("bucket"))
    centers = buckets.groupBy("bucket").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    stars = buckets.join(centers, "bucket").where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    near = components(stars)
    sizes = near.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    near = near.join(sizes, "label").join(texts.select("node", "rep", "copies"), "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    own = _one_row(_texts(documents, text, [doc_id, text]), near, doc_id)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.select("node", "label", "block", F.col(text).alias("text"), other.alias("other"))
    dealt = dealt.select("node", "block", "text", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = cut(dealt.groupBy("label", "i", "j").applyInArrow(_links(threshold), "a long, b long, n long"))
    classes = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return texts.select("node", "rep", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The documents with ``class_id``, ``n_links`` and ``n_copies``.

    Two texts are linked when the Jaccard similarity of their sets of five-word
    shingles is the threshold or more; classes are the connected components,
    named by their least id. ``n_links`` counts the other texts that a text is
    linked with, ``n_copies`` the documents with its very words.

    Copies are counted once, by a pre-aggregated hash of their words. Texts
    that share a MinHash band form neighbourhoods: stars around the least text
    of each band's bucket, joined to components. Within a neighbourhood, texts
    are dealt into blocks, and tasks compare two blocks each; they return the
    links of each text as a number, and as many pairs as connect them. So no
    group of copies or near copies meets in one task, and no bucket is expanded
    to its pairs.

    Texts without words, null or not, are alone: class_id is their id. Rows
    with a null id take part, with the class's least id. An empty table gives
    an empty result. Rows that repeat an id and a text count as copies.
    Clashing columns are replaced.
    """
    documents = documents.drop("class_id", "n_links", "n_copies", "node", "bands")
    rows = _classes(documents, doc_id, text, threshold, block)
    least = rows.groupBy("label").agg(F.min("rep").alias("class_id"))
    rows = rows.join(least, "label").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    keep = documents.columns
    out = _texts(documents, text, keep).join(rows, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        *keep,
        F.when(alone, F.col(doc_id)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_of_each(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Exactly one of the rows of each class of ``near_duplicates``: one with the class's least id, ids before null.

    Among texts with that id it is the one with the least hash of its words,
    so that rows that repeat an id, or have none, leave one as well. Texts
    without words are alone and stay. All columns stay, whatever their names.
    """
    documents, back = set_apart(documents, [doc_id, text])
    rows = _classes(documents, doc_id, text, threshold, block)
    first = F.min(F.struct(F.col("rep").isNull().alias("_null"), "rep", "node", "copies")).alias("_first")
    chosen = rows.groupBy("label").agg(first).select("_first.node", "_first.rep", "_first.copies")
    kept = _one_row(_texts(documents, text, documents.columns), chosen, doc_id).select(documents.columns)
    alone = documents.where(~F.coalesce(F.col(text).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)))
    return back(kept.unionAll(alone))
