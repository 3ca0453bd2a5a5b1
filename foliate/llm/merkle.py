"""Merkle manifest of a table: a tree for each source, a tree over the sources, a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliate.llm.common import written

#: Nodes that become one, and levels that a superblock collapses.
FANOUT, LEVELS = 16, 3
#: Rows of a group on average; superblocks are dealt over groups by a hash.
GROUP_ROWS = 2048
#: Starts of ranges are broadcast up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "before array<string>, after array<string>, top string"


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def leaf_of(columns: dict[str, Column]) -> Column:
    """sha256 of the fields one after another, each ``-`` for null, else its UTF-8 bytes' count, a colon and the value."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)).cast("binary"), 256)


def collapse(nodes: list[str], whole: bool, fanout: int = FANOUT, levels: int = LEVELS) -> Iterator[list[str]]:
    """The levels above a superblock's nodes: ``levels`` of them, or of a whole tree as many as lead to one node."""
    done = 0
    while len(nodes) > 1 if whole else done < levels:
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        done += 1
        yield nodes


def path_of(at: int, levels: list[list[str]], fanout: int = FANOUT) -> tuple[list[str], list[str]]:
    """For node ``at`` of the first level: what stands before and after it and after its ancestors in their runs."""
    before, after = [], []
    for nodes in levels:
        first = at - at % fanout
        before.append("".join(nodes[first:at]))
        after.append("".join(nodes[at + 1 : first + fanout]))
        at //= fanout
    return before, after


def fold(leaf: str, before: list[str], after: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(before, after, strict=True):
        leaf = digest(left + leaf + right)
    return leaf


class Forest:
    """The trees over nodes (tree, at, n, node), ``n`` being the nodes of the tree.

    A superblock is ``fanout ** levels`` nodes in a row. ``rounds`` holds the
    nodes, the roots of their superblocks, the roots of these, and so on, until
    all trees have one; ``roots`` is (tree, node). Superblocks are dealt over
    groups of bounded size by a hash, several small trees to a group.
    """

    def __init__(self, nodes: DataFrame, fanout: int, levels: int):
        self.fanout, self.levels, self.size = fanout, levels, fanout**levels
        self.rounds, self.packs = [nodes], []
        while True:
            rows, inner, most = self.rounds[-1].agg(F.count(F.lit(1)), F.count_if(F.col("n") > 1), F.max("n")).first()
            self.packs.append(max(1, -(-(inner if self.packs else rows) // GROUP_ROWS)))
            if (most or 0) <= 1:
                break
            self.rounds.append(written(self._reduced(), "merkle-nodes"))
        self.roots = reduce(DataFrame.unionAll, (r.where("n = 1").select("tree", "node") for r in self.rounds))

    def _dealt(self, nodes: DataFrame, block: Column, packs: int) -> DataFrame:
        return nodes.withColumn("block", block).withColumn("pack", F.pmod(F.xxhash64("tree", "block"), F.lit(packs))).groupBy("pack")

    def _reduced(self) -> DataFrame:
        fanout, levels, size = self.fanout, self.levels, self.size

        def run(group: pd.DataFrame) -> pd.DataFrame:
            out = []
            for (tree, block), found in _superblocks(group, ["n", "node"]):
                n, top = found[0][0], [x[1] for x in found]
                for level in collapse(top, n <= size, fanout, levels):
                    top = level
                out.append((tree, block, -(-n // size), top[0]))
            return pd.DataFrame(out, columns=["tree", "at", "n", "node"])

        dealt = self._dealt(self.rounds[-1].where("n > 1"), F.floor(F.col("at") / size).cast("long"), self.packs[-1])
        return dealt.applyInPandas(run, "tree string, at long, n long, node string")

    def _descended(self, nodes: DataFrame, above: DataFrame, packs: int, keep: list[str], fields: str, finish: Callable[..., tuple]) -> DataFrame:
        """``keep`` and ``fields`` of the nodes: ``finish`` of a node's kept values and its path, the part in its superblock before that above it."""
        fanout, levels, size = self.fanout, self.levels, self.size
        names = [*keep, *StructType.fromDDL(fields).names]

        def run(group: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
            known = {(t, b): (list(x), list(y), top) for t, b, x, y, top in zip(*(upper[c] for c in ("tree", "block", "before", "after", "top")), strict=True)}
            out = []
            for (tree, block), found in _superblocks(group, ["n", "node", *keep]):
                first = [x[1] for x in found]
                trail = [first, *collapse(first, found[0][0] <= size, fanout, levels)][:-1]
                left, right, top = known[tree, block]
                for i, (_, _, *kept) in enumerate(found):
                    before, after = path_of(i, trail, fanout)
                    out.append((*kept, *finish(*kept, before + left, after + right, top)))
            return pd.DataFrame(out, columns=names)

        below = self._dealt(nodes.select(*dict.fromkeys(["tree", "at", "n", "node", *keep])), F.floor(F.col("at") / size).cast("long"), packs)
        schema = ", ".join([*(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in keep), fields])
        return below.cogroup(self._dealt(above, F.col("at"), packs)).applyInPandas(run, schema)

    def descend(self, tops: DataFrame, keep: list[str], fields: str, finish: Callable[..., tuple]) -> DataFrame:
        """``_descended`` for all nodes of the first round, below the paths (tree, before, after, top) of the trees' roots."""
        places = ["tree", "at", "before", "after", "top"]
        found = None
        for nodes, packs in zip(self.rounds[:0:-1], self.packs[:0:-1], strict=True):
            lone = nodes.where("n = 1").select("tree", "at").join(tops, "tree").select(places)
            if found is not None:
                inner = self._descended(nodes.where("n > 1"), found, packs, ["tree", "at"], PATH, lambda _, __, *path: path)
                lone = lone.unionAll(inner.select(places))
            found = written(lone, "merkle-paths")
        lone = self.rounds[0].where("n = 1").select("tree", "at").join(tops, "tree").select(places)
        found = written(lone, "merkle-paths") if found is None else found.unionAll(lone)
        return self._descended(self.rounds[0], found, self.packs[0], keep, fields, finish)


def _superblocks(group: pd.DataFrame, columns: list[str]) -> Iterator[tuple[tuple[str, int], list[tuple]]]:
    """Tree and block, and the rows' values, of each superblock of a group, in the order of the places."""
    group = group.sort_values(["tree", "block", "at"])
    rows = zip(*(group[c].astype(object).where(group[c].notna(), None) for c in ("tree", "block", *columns)), strict=True)
    for key, found in groupby(rows, key=itemgetter(0, 1)):
        yield key, [r[2:] for r in found]


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with ``at``, their place in their tree, and ``n``, the tree's rows.

    Rows are sorted by ranges of tree and order, so that a large tree takes
    many ranges; a range's rows of a tree begin where those of the ranges
    before it end. ``order`` must tell all rows apart.
    """
    placed = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = written(placed.withColumn("_place", F.monotonically_increasing_id()), "merkle-sorted")
    placed = placed.withColumn("_range", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy(tree, "_range").agg(F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select(tree, "_range", (before - F.col("_start")).alias("_shift"), F.sum("_n").over(own).alias("n")), "merkle-starts")
    few = (starts.agg(F.sum(F.octet_length(tree) + 40)).first()[0] or 0) <= BROADCAST_BYTES
    joined = placed.join(F.broadcast(starts) if few else starts, [tree, "_range"])
    return joined.withColumn("at", F.col("_place") + F.col("_shift")).drop("_place", "_range", "_shift")


def manifest(documents: DataFrame, changed: Column | None = None, *, fanout: int = FANOUT, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """A row for each document with its place in the manifest and the check of its proof.

    Columns: ``doc_id``, ``leaf``, ``subroot`` of its source, ``root``,
    ``proof_sha256`` (sha256 of the siblings from leaf to root), ``folded_root``
    (what the leaf that is checked and the siblings lead to) and ``verified``.
    The leaf that is checked is that of ``changed``, a text to put in place of
    the document's, where it is not null. With ``proofs`` also ``before`` and
    ``after``, the siblings on either side at each level.

    Leaves are made in one scan; what follows moves their hashes, not texts.
    They are ranked within their source by doc_id. Places are bucketed by
    ``fanout ** levels``; a bucket is a superblock, of which ``applyInPandas``
    collapses ``levels`` levels, and the roots of superblocks are reduced in
    the same way until each source has its subroot. The subroots, in the order
    of their sources, are one more such tree. Then paths go down: the path of a
    superblock's root is joined to the superblock, and each node's own siblings
    come before it. So a source of any size is spread over all tasks, and the
    proofs of leaves, some kilobytes each, are folded and hashed where they are
    made.

    Rows that share a doc_id stand in the order of their leaves, those without
    one come first. Rows that repeat in full are leaves each. Null sources are
    a source of their own, before all others. Null and empty texts have
    different leaves. An empty table gives an empty result; other columns are
    not used.
    """
    fields = {c: F.col(c) for c in FIELDS}
    checked = F.lit(None) if changed is None else F.when(changed.isNotNull(), leaf_of(fields | {"text": changed}))
    # null sorts before all sources, which sort by their bytes
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaves = documents.select("doc_id", tree.alias("tree"), leaf_of(fields).alias("node"), checked.cast("string").alias("checked"), F.monotonically_increasing_id().alias("row"))
    below = Forest(written(_ranked(written(leaves, "merkle-leaves"), "tree", ["doc_id", "node", "row"]), "merkle-ranked"), fanout, levels)
    subroots = below.roots.select(F.lit("").alias("all"), "tree", "node")
    subroots = _ranked(written(subroots, "merkle-subroots"), "all", ["tree"]).select(F.col("all").alias("tree"), "at", "n", "node", F.col("tree").alias("source"))
    above = Forest(written(subroots, "merkle-sources"), fanout, levels)
    top = above.roots.first()
    root = top["node"] if top else ""
    nothing = F.array().cast("array<string>")
    tops = above.roots.select("tree", nothing.alias("before"), nothing.alias("after"), F.lit("").alias("top"))
    tops = above.descend(written(tops, "merkle-top"), ["source", "node"], PATH, lambda _, __, *path: path)
    tops = written(tops.select(F.col("source").alias("tree"), "before", "after", F.col("node").alias("top")), "merkle-tops")

    def finish(_, leaf: str, checked: str | None, before: list[str], after: list[str], subroot: str) -> tuple:
        siblings = digest("".join(x + y for x, y in zip(before, after, strict=True)))
        return subroot, siblings, fold(checked or leaf, before, after), *((before, after) if proofs else ())

    made = "subroot string, proof_sha256 string, folded_root string" + ", before array<string>, after array<string>" * proofs
    found = below.descend(tops, ["doc_id", "node", "checked"], made, finish)
    kept = ["before", "after"] if proofs else []
    return found.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), *kept)
