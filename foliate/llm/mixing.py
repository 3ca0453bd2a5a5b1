"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas."""

from __future__ import annotations

import heapq
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: no blank and no ASCII control blank. ASCII only.
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"
#: Documents that a bin of the seeded order holds on average.
BIN_ROWS = 500
#: So many patterns' plans are broadcast.
BROADCAST_PATTERNS = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources in order of code points, null last, take the weights in turn. A
    target stops at ``most`` times its source's size; what is over is shared
    again by weight among the others until no target is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in order if s in open_)
        full = [s for s in order if s in open_ and unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def min_cost_flow(patterns: dict[tuple, int], wanted: dict, repeats: int = 2) -> dict[tuple, dict]:
    """Words that each source takes of each membership pattern.

    Network: start, pattern, source, end. A pattern gives its words once at
    cost 0, a second time at cost 1, a third at cost 2 and so on, up to
    ``repeats`` times. Paths of least cost are filled one after another. Parts
    of the network that share no source are solved apart.
    """
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    for group in _apart(list(patterns)):
        _solve(group, patterns, wanted, repeats, flow)
    return flow


def _apart(patterns: list[tuple]) -> list[list[tuple]]:
    root: dict = {}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p in patterns:
        for s in p:
            root.setdefault(s, s)
            root[top(s)] = top(p[0])
    groups: dict = {}
    for p in patterns:
        if p:
            groups.setdefault(top(p[0]), []).append(p)
    return list(groups.values())


def _solve(group: list[tuple], sizes: dict, wanted: dict, repeats: int, flow: dict) -> None:
    edges: list[list] = []  # to, room, cost
    out: dict = {}

    def edge(a, b, room: float, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(edges))
            edges.append([y, r, c])
        return len(edges) - 2

    sources = sorted({s for p in group for s in p}, key=lambda s: (s is None, s or ""))
    links = []
    for p in group:
        for k in range(repeats):
            edge("start", ("p", p), sizes[p], k)
        links += [(p, s, edge(("p", p), ("s", s), math.inf, 0)) for s in p]
    for s in sources:
        edge(("s", s), "end", math.floor(wanted[s]), 0)
    height = dict.fromkeys(out, 0.0)
    while True:
        far, by, heap = {"start": 0.0}, {}, [(0.0, 0, "start")]
        ties = 0
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                y, room, cost = edges[e]
                if room > 0 and (new := d + cost + height[x] - height[y]) < far.get(y, math.inf) - 1e-9:
                    far[y], by[y] = new, e
                    heapq.heappush(heap, (new, ties := ties + 1, y))
        if "end" not in far:
            break
        for x in height:
            height[x] += far.get(x, far["end"])
        path, x = [], "end"
        while x != "start":
            path.append(by[x])
            x = edges[by[x] ^ 1][0]
        least = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= least
            edges[e ^ 1][1] += least
    for p, s, e in links:
        if edges[e ^ 1][1]:
            flow[p][s] = edges[e ^ 1][1]


def mix(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    sources: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 23,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes.

    ``sources`` is a source or an array of the sources that a document belongs
    to; ``source_size`` and ``target`` are then sums over them. Words are
    counted by membership pattern; the driver sees these counts alone, and
    sends the flow back. Within a pattern every document is taken as often as
    the flow has whole rounds of it. For the rest, documents follow in seeded
    order: the order is cut into bins of some hundred documents, bins are taken
    whole until the one in which the quota ends, and in that one each document
    that still fits is taken, and a last one if that comes nearer. So no task
    sees more of a hot source than its last bin.

    Null texts have size 0, null sources are a source of their own. Rows with a
    null or repeated id are ordered by their text too; equal rows are alike. An
    empty table gives an empty result. Clashing columns are replaced.
    """
    made = ["size", "source_size", "target", "taken", "_pattern", "_hash", "_bin"]
    is_array = dict(documents.dtypes)[sources].startswith("array")
    pattern = F.array_sort(F.array_distinct(sources)) if is_array else F.array(F.col(sources).cast("string"))
    rows = documents.select(
        *(c for c in documents.columns if c not in made),
        n_words(text).alias("size"),
        F.coalesce(pattern, F.array(F.lit(None).cast("string"))).alias("_pattern"),
        F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text)).alias("_hash"),
    )
    key = F.to_json(F.struct(F.transform("_pattern", lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))).alias("p")))
    rows = rows.withColumn("_key", key).drop("_pattern")
    totals = rows.groupBy("_key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    if not totals:
        empty = "cast(null as long) as source_size", "cast(null as double) as target", "cast(null as long) as taken"
        return rows.drop("_hash", "_key").selectExpr("*", *empty)
    spark = documents.sparkSession
    plan = spark.createDataFrame(_plan(totals, weights, share, repeats, bin_rows), "_key string, source_size long, target double, rounds long, rest long, bins long")
    # a row of numbers a pattern, and the patterns are counted: broadcast, or joined by a shuffle if there are many
    few = len(totals) <= BROADCAST_PATTERNS
    plan = F.broadcast(plan) if few else plan
    rows = rows.join(plan, "_key").withColumn("_bin", F.floor((F.shiftrightunsigned("_hash", 1) / float(1 << 63)) * F.col("bins")).cast("long"))
    bins = rows.groupBy("_key", "_bin").agg(F.sum("size").alias("w"), F.first("rest").alias("rest"))
    edges = _edges(bins)
    rows = rows.join(F.broadcast(edges) if few else edges, "_key", "left")
    base = F.col("rounds") * F.col("size")
    inside = F.col("_bin") == F.col("_edge")
    columns = [c for c in rows.columns if c not in {"_hash", "_key", "rounds", "rest", "bins", "_bin", "_edge", "_room"}]
    before = (F.col("rest") > 0) & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")))
    outside = rows.where(~F.coalesce(inside, F.lit(False)))
    whole = outside.select(*columns, (base + F.when(before, F.col("size")).otherwise(0)).cast("long").alias("taken"))
    last = rows.where(inside).select(*columns, "_key", "rounds", "_hash", "_room")
    part = last.groupBy("_key").applyInArrow(_fill, whole.select(*columns, "taken").schema)
    return whole.unionByName(part)


def _edges(bins: DataFrame) -> DataFrame:
    """For each pattern with a rest to take: the bin in which it ends, and the room left there."""
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    run = bins.where("rest > 0").withColumn("_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    return run.where((F.col("_before") <= F.col("rest")) & (F.col("rest") < F.col("_before") + F.col("w"))).select("_key", F.col("_bin").alias("_edge"), (F.col("rest") - F.col("_before")).alias("_room"))


def _fill(rows: pa.Table) -> pa.Table:
    """The last bin: in seeded order, what still fits; then one more if that comes nearer."""
    rows = rows.sort_by([("_hash", "ascending"), ("size", "ascending")])
    sizes, room, extra = rows.column("size").to_pylist(), rows.column("_room")[0].as_py(), []
    for size in sizes:
        extra.append(size if size <= room else 0)
        room -= extra[-1]
    over = [(size, i) for i, (size, x) in enumerate(zip(sizes, extra, strict=True)) if size > x and size - room < room]
    if over:
        extra[min(over)[1]] = min(over)[0]
    taken = [n * size + x for n, size, x in zip(rows.column("rounds").to_pylist(), sizes, extra, strict=True)]
    return rows.drop_columns(["_key", "rounds", "_hash", "_room"]).append_column("taken", pa.array(taken, pa.int64()))


def _plan(totals: list, weights: tuple, share: float, repeats: int, bin_rows: int) -> list[tuple]:
    patterns = {r["_key"]: tuple(s[1:] if s[0] == "s" else None for s in json.loads(r["_key"])["p"]) for r in totals}
    sizes: dict = {}
    for r in totals:
        for s in patterns[r["_key"]]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    words = {patterns[r["_key"]]: r["words"] for r in totals}
    wanted = targets(sizes, weights, share, repeats) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    flow = min_cost_flow(words, wanted, repeats)
    out = []
    for r in totals:
        p = patterns[r["_key"]]
        take = int(sum(flow[p].values()))
        rounds = take // r["words"] if r["words"] else 0
        out.append((r["_key"], sum(sizes[s] for s in p), float(sum(wanted[s] for s in p)), rounds, take - rounds * r["words"], max(1, round(r["n"] / bin_rows))))
    return out
