"""MinHash near-dedup: an inverted join of signature coordinates, exact sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import append, written
from foliate.llm.components import components

#: Words in a shingle; a link needs PERCENT * union <= 100 * intersection.
SHINGLE, PERCENT = 5, 85
#: Coordinates of a signature, and the chance that a pair at the threshold agrees in fewer than the least matches.
HASHES, MISSED = 96, 1e-6
#: Counters of coordinate values: a fixed size, whatever the data.
COUNTERS = 1 << 20
#: Lists that hold at least this share of all texts are broadcast with their hubs, SHARE times the prefix of them at most.
SHARE = 1000
#: Bytes of a block of differences and signatures; a task holds two.
BLOCK_BYTES = 1 << 20
#: So many keys of nodes are broadcast; more are joined by a shuffle.
FEW = 1 << 20
#: Word hashes that a task remembers.
CACHE = 1_000_000


@lru_cache(maxsize=8)
def least_matches(percent: int = PERCENT, hashes: int = HASHES, missed: float = MISSED) -> int:
    """The most matches that a pair at the threshold reaches but for a chance of ``missed``."""
    p, total, m = percent / 100, 0.0, -1
    while total <= missed:
        m += 1
        total += math.comb(hashes, m) * p**m * (1 - p) ** (hashes - m)
    return m


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of SHINGLE words of a text; fewer words are one run, none have none."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


_draw = np.random.default_rng(12)
_A = (_draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def signature(shingle: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions over the shingles."""
    low = (shingle >> np.uint64(16)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[None, at : at + 512] * _A + _B).min(1), out=out)
    return out


def _keys(signatures: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs as 64-bit integers, the coordinate above the value."""
    return (np.arange(HASHES, dtype=np.int64) << 32)[None] | signatures.astype(np.int64)


def _slots(keys: np.ndarray) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64) & (COUNTERS - 1)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint32).reshape(batch.num_rows, HASHES)


def _signed(rows: DataFrame) -> DataFrame:
    """``id``, ``n_shingles``, ``node``, a 64-bit hash of the set, null for an empty one, and ``signature``."""
    cache = _WordHash()

    def run(texts: list) -> list[list]:
        sizes, nodes, found = [], [], []
        for t in texts:
            s = shingles(t, cache)
            sizes.append(len(s))
            nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
            found.append(signature(s).tobytes() if len(s) else None)
        return [sizes, nodes, found]

    return append(rows, ["text"], "n_shingles long, node long, signature binary", run, ["id"])


def _counters(nodes: DataFrame) -> np.ndarray:
    """How often each slot of COUNTERS is hit by the coordinates of all signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_slots(_keys(_matrix(batch, "signature"))).ravel(), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    found = nodes.select("signature").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _postings(nodes: DataFrame, prefix: int) -> DataFrame:
    """(key, node, weight): each node under its ``prefix`` rarest coordinate values; ``weight`` tells how common all its values are."""
    counters = nodes.sparkSession.sparkContext.broadcast(_counters(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_matrix(batch, "signature"))
                slots = _slots(keys)
                counts = counters.value[slots]
                # an order of all values, the same for all nodes: the rarest first, ties by slot and value
                order = np.lexsort((keys, slots, counts))[:, :prefix]
                weights = np.log2(counts).sum(1)
                nodes = np.repeat(batch.column("node").to_numpy(), prefix)
                columns = [pa.array(np.take_along_axis(keys, order, 1).ravel()), pa.array(nodes), pa.array(np.repeat(weights, prefix))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "weight"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long, weight double")


def _lists(postings: DataFrame) -> DataFrame:
    """Lists of more than one node: ``key``, ``m`` nodes and the ``hub``, the node whose values are the most common."""
    hub = F.max(F.struct("weight", "node"))["node"].alias("hub")
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("m"), hub).where("m > 1")


def _with_hubs(postings: DataFrame, lists: DataFrame, texts: int) -> DataFrame:
    """(node, hub) for each posting in a list. The longest lists, few by their length, are broadcast, so that none is joined in one task."""
    long = F.col("m") * SHARE >= texts
    rest = postings.join(F.broadcast(lists.where(long).select("key")), "key", "left_anti").join(lists.where(~long), "key")
    return postings.join(F.broadcast(lists.where(long)), "key").select("node", "hub").unionAll(rest.select("node", "hub"))


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of some nodes."""
    return rows.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "node")


def _sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, shingles) of some nodes, from one of the rows that have the node's set and its least id."""
    few = nodes.count() <= FEW
    wanted = nodes.select(F.col("rep").alias("_rep"), F.col("node").alias("_node"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("_rep")))
    cache = _WordHash()

    def run(texts: list, expected: list) -> list[list]:
        found = []
        for t, node in zip(texts, expected, strict=True):
            s = shingles(t, cache)
            found.append(s.view(np.int64) if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == node else None)
        return [expected, [None if s is None else len(s) for s in found], found]

    made = append(rows, ["text", "_node"], "node long, n long, shingles array<long>", run, []).where("shingles is not null")
    made = written(made, "near-sets")
    if made.count() == nodes.count():
        return made
    # rows that repeat their id
    return written(made.groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "near-sets")


def _shared(postings: DataFrame, key: str, sizes: DataFrame, least: Column) -> DataFrame:
    """The nodes of ``sizes`` (node, n) of whose n keys so many as ``least`` are posted by another node too."""
    counted = postings.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.max("node").alias("node"))
    alone = counted.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return sizes.join(alone, "node", "left").where(F.col("n") - F.coalesce("alone", F.lit(0)) >= least).select("node")


def _coordinates(nodes: DataFrame) -> DataFrame:
    """(key, node) for every coordinate of the nodes' signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                node = np.repeat(batch.column("node").to_numpy(), HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(_keys(_matrix(batch, "signature")).ravel()), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def similar(common: Column, total: Column, percent: int) -> Column:
    """Whether sets with so many elements in common, and ``total`` counted apart, are linked."""
    return 100 * common >= percent * (total - common)


class _Union:
    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x


def linked(labels: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, differences: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, least: int) -> list[tuple[int, int]]:
    """Pairs of labels, enough to join the labels that links between left and right rows join.

    Collisions of the signatures are counted, pairs of two labels with
    ``least`` of them are retained and tested exactly. Sets are given by what
    they differ in from one and the same set: two sets differ in what just one
    of their differences holds.
    """
    codes = np.unique(np.concatenate([*differences, np.zeros(1, np.int64)]), return_inverse=True)[1]
    cuts = np.cumsum([0, *map(len, differences)])
    own = [codes[cuts[i] : cuts[i + 1]] for i in range(len(differences))]
    flag, found, known = np.zeros(codes.max(initial=0) + 1, bool), [], _Union()
    step = max(1, 80_000 // max(1, len(right)))
    for first in range(0, len(left), step):
        a = left[first : first + step]
        near = (labels[a][:, None] != labels[right][None]) & (100 * np.minimum(sizes[a][:, None], sizes[right][None]) >= percent * np.maximum(sizes[a][:, None], sizes[right][None]))
        rows, columns = np.nonzero(near)
        matches = (signatures[a[rows]] == signatures[right[columns]]).sum(1) if len(rows) else np.zeros(0)
        rows, columns = rows[matches >= least], columns[matches >= least]
        for row in np.unique(rows):
            x = int(a[row])
            others = [int(y) for y in right[columns[rows == row]] if known.top(int(labels[y])) != known.top(int(labels[x]))]
            if not others:
                continue
            flag[own[x]] = True
            lengths = np.array([len(own[y]) for y in others])
            both = np.bincount(np.repeat(np.arange(len(others)), lengths), flag[np.concatenate([own[y] for y in others])], minlength=len(others))
            flag[own[x]] = False
            total = sizes[x] + sizes[others]
            common = (total - (len(own[x]) + lengths - 2 * both)) // 2
            for y in np.array(others)[100 * common >= percent * (total - common)]:
                p, q = known.top(int(labels[x])), known.top(int(labels[y]))
                if p != q:
                    known.root[p] = q
                    found.append((int(labels[x]), int(labels[y])))
    return found


def _among(members: DataFrame, percent: int, least: int, block_bytes: int) -> DataFrame:
    """Edges (a, b) between labels of the members (hub, node, label, n, e, signature) of a hub, dealt into blocks of bounded bytes, two blocks a task."""
    size = F.col("d") * 8 + 4 * HASHES + 64
    groups = members.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.sum(size) / block_bytes).cast("int").alias("blocks"))
    dealt = members.join(groups.where("low != high").select("hub", "blocks"), "hub").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "n", "e", "signature")

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block, labels, sizes = (group.column(c).to_numpy() for c in ("block", "label", "n"))
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(block), HASHES)
        e = group.column("e").combine_chunks()
        cuts, flat = e.offsets.to_numpy(), e.values.to_numpy()
        differences = [flat[cuts[k] : cuts[k + 1]] for k in range(len(block))]
        found = linked(labels, sizes, signatures, differences, np.flatnonzero(block == i), np.flatnonzero(block == j), percent, least)
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], []))], names=["a", "b"])

    # else the blocks of a hub would stay in one task
    return dealt.repartition("hub", "i", "j").groupBy("hub", "i", "j").applyInArrow(run, "a long, b long")


def _classes(rows: DataFrame, nodes: DataFrame, percent: int, missed: float, block_bytes: int) -> DataFrame:
    """(node, label) of the nodes that have a link, by the components of all links."""
    least = least_matches(percent, HASHES, missed)
    prefix = HASHES - least + 1
    postings = written(_postings(nodes, prefix), "near-postings")
    texts = nodes.count()
    # nodes that meet another one, then those that can agree with others in enough coordinates, then in enough shingles
    near = written(_shared(postings, "key", nodes.select("node", F.lit(prefix).alias("n")), F.lit(1)), "near-met")
    agrees = _shared(_coordinates(_only(nodes, near)), "key", near.withColumn("n", F.lit(HASHES)), F.lit(least))
    near = written(agrees, "near-agrees")
    near = written(_shared(_only(postings, near), "key", near.withColumn("n", F.lit(prefix)), F.lit(1)), "near-met")
    sets = _sets(rows, written(_only(nodes.select("node", "rep"), near), "near-nodes"))
    shingle = sets.select(F.explode("shingles").alias("shingle"), "node")
    live = written(_shared(shingle, "shingle", sets.select("node", "n"), F.ceil(F.col("n") * percent / 100 - 1e-9)), "near-live")
    # lists of nodes that can have a link
    postings = _only(postings, live)
    stars = written(_with_hubs(postings, written(_lists(postings), "near-lists"), texts).distinct(), "near-stars")
    x, y = sets.select("node", "n", F.col("shingles").alias("x")), sets.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("shingles").alias("y"))
    e = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    stars = stars.join(x, "node").join(y, "hub").select("hub", "hub_n", "node", "n", e.alias("e")).withColumn("d", F.size("e").cast("long"))
    stars = written(stars, "near-stars")
    total = F.col("n") + F.col("hub_n")
    links = stars.where("node != hub").where(similar((total - F.col("d")) / 2, total, percent)).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    labels = written(components(links), "near-labels")
    labelled = stars.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(_only(nodes.select("node", "signature"), live), "node")
    more = written(_among(labelled, percent, least, block_bytes), "near-links")
    joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("over"))
    # labels of one node alone are not among the labels so far
    alone = joined.join(labels.select("label"), "label", "left_anti").select(F.col("label").alias("node"), F.col("over").alias("label"))
    return labels.join(joined, "label", "left").select("node", F.coalesce("over", "label").alias("label")).unionAll(alone)


def near_duplicates(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    missed: float = MISSED,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row for each document with its id, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked when 100 times the shingles they share are at
    least ``percent`` times those of either. ``component_id`` is the least id
    that links lead to, ``kept`` whether it is the row's own.

    Documents with one and the same set are one node, made by pre-aggregation.
    A node is posted under its coordinate-value pairs. Two nodes at the
    threshold agree in ``least_matches`` coordinates but for a chance of
    ``missed``, so they meet in a list even if each is posted under its rarest
    values alone; only these lists, the prefix, are merged, and all others are
    skipped and just probed for pairs that met. No list is expanded to its
    pairs: of each, only the hub, the node with the most common values, is
    paired with the others. Nodes go before that if more of their coordinates,
    or of their shingles, than a link allows occur with no other candidate. A
    pair of hub and
    member yields the exact difference of their sets. From these differences
    the members of a hub decide links among themselves, in blocks of bounded
    bytes, two to a task, and only where links with hubs left them in several
    components; there, collisions of all coordinates are counted and pairs
    with the least matches are tested exactly. So the work within a group of
    near copies that no hub joins grows with its square, on hashes in tasks,
    while what is written grows with its size.

    Texts without words, null or not, are alone: no shingles, their own id,
    kept. Rows with a null id take part and are kept only where no row of
    their component has one. Rows that repeat an id are rows of their own; all
    with the component's id are kept. An empty table gives an empty result.
    Other columns are not returned.
    """
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    signed = written(_signed(rows), "near-signed")
    nodes = signed.where("node is not null").groupBy("node")
    nodes = written(nodes.agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature")), "near-nodes")
    classes = written(_classes(rows, nodes, percent, missed, block_bytes), "near-classes")
    labelled = nodes.select("node", "rep").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = labelled.join(least, "label").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = signed.select("id", "n_shingles", "node").join(named, "node", "left")
    return out.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
