"""Retrieval: term-frequency and vector cosine, top-k with every block ranked."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from foliate.functions.text import tokens
from foliate.storage import spread


def squared_norm(words: Column) -> Column:
    """The sum of squared term frequencies: runs of the sorted words, in the row, without a shuffle."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))

    def step(acc: Column, w: Column) -> Column:
        same = acc["w"] == w
        n = F.when(same, acc["n"] + 1).otherwise(F.lit(1).cast("long"))
        # (n + 1)^2 - n^2 = 2n + 1
        return F.struct(w.alias("w"), n.alias("n"), (acc["s"] + 2 * n - 1).alias("s"))

    return F.aggregate(F.sort_array(words), start, step, lambda acc: acc["s"])


def query_terms(queries: dict[str, str]) -> dict[str, dict[str, int]]:
    found: dict[str, dict[str, int]] = {}
    for name, text in queries.items():
        found[name] = {}
        for w in re.findall("[a-z0-9]+", text.lower()):
            found[name][w] = found[name].get(w, 0) + 1
    return found


def tf_cosine(blocks: DataFrame, queries: dict[str, str], text: str = "context") -> DataFrame:
    """A row for each query and block with the cosine of their term frequencies, rounded to 6 places; 0 without a shared word.

    The queries are a few literals, so scoring stays in the row of a block.
    """
    parts = []
    base = blocks.withColumn("_w", tokens(F.col(text))).withColumn("_n", F.sqrt(squared_norm(F.col("_w")).cast("double")))
    for name, terms in query_terms(queries).items():
        norm = sum(n * n for n in terms.values()) ** 0.5
        dot: Column = F.lit(0).cast("long")
        for w, n in terms.items():
            dot = dot + F.size(F.filter("_w", _equals(w))) * n
        score = F.when(F.col("_n") > 0, dot / (F.col("_n") * F.lit(norm))).otherwise(0.0) if norm else F.lit(0.0)
        parts.append(F.struct(F.lit(name).alias("query_id"), F.round(score, 6).alias("score")))
    return base.withColumn("_s", F.explode(F.array(*parts))).select(*blocks.columns, "_s.query_id", "_s.score")


def _equals(word: str):
    return lambda x: x == word


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors as doubles; 0 if one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def top_k(scored: DataFrame, k: int | None, by: list[str], score: str = "score", tie: str = "block_id") -> DataFrame:
    """The k best of each group by score, ties by id; all if k is none or not positive. Adds ``rank``."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))
    return ranked.where(F.col("rank") <= k) if k and k > 0 else ranked


def render_scored(ranked: DataFrame, by: list[str], text: str = "context") -> DataFrame:
    """One text of each group's blocks in the order of their rank, and their ids."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"), "block_id")))
    return ranked.groupBy(*by).agg(rows.alias("_r")).select(*by, F.array_join(F.transform("_r", lambda r: r["t"]), "\n\n").alias("context"), F.transform("_r", lambda r: r["block_id"]).alias("block_ids"))


#: Vectors and query vectors of a block, and query vectors that are scored at a time.
VECTOR_BLOCK, QUERY_BLOCK, AT_A_TIME = 8192, 4096, 256


def _stacked(vectors: pd.Series, norms: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows filled up to a width, those of a norm above 0 alone, the norms, and the sizes."""
    out, sizes = np.zeros((len(vectors), width)), np.zeros(len(vectors), dtype=int)
    lengths = norms.to_numpy(dtype=float)
    for i, v in enumerate(vectors):
        if lengths[i] > 0:
            sizes[i] = len(v)
            out[i, : len(v)] = v
    return out, lengths, sizes


def _nearest_block(k: int):
    def nearest_block(asked: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        """The k vectors of a block nearest to each query vector of a block."""
        none = pd.DataFrame({"query_id": asked["query_id"][:0], "vec_id": met["vec_id"][:0], "score": pd.Series(dtype=float)})
        if not len(asked) or not len(met):
            return none
        met = met.sort_values("vec_id", kind="stable", ignore_index=True)
        width = max((len(v) for rows in (asked["q"], met["q"]) for v in rows if v is not None), default=0)
        v, v_norm, v_size = _stacked(met["q"], met["norm"], width)
        q, q_norm, q_size = _stacked(asked["q"], asked["norm"], width)
        most = min(k, len(met))
        found = []
        for start in range(0, len(q), AT_A_TIME):
            part = slice(start, start + AT_A_TIME)
            norms = q_norm[part, None] * v_norm[None, :]
            with np.errstate(invalid="ignore", over="ignore"):
                scores = np.round(np.divide(q[part] @ v.T, norms, out=np.zeros_like(norms), where=norms > 0), 6)
            # a score that is no number comes first, as in an order of Spark and SQL
            scores[np.isnan(scores) | (norms < 0) | ((q_norm[part, None] < 0) & (v_norm[None, :] < 0))] = np.inf
            scores[(q_norm[part, None] > 0) & (v_norm[None, :] > 0) & (q_size[part, None] != v_size[None, :])] = -np.inf
            # of equal scores the least ids: all above the k-th score, then the first that have it
            kth = -np.partition(-scores, most - 1, axis=1)[:, most - 1 : most]
            above, same = scores > kth, scores == kth
            take = above | (same & (np.cumsum(same, axis=1) <= most - above.sum(axis=1, keepdims=True)))
            rows, columns = np.nonzero(take)
            found.append(pd.DataFrame({"query_id": asked["query_id"].to_numpy()[part][rows], "vec_id": met["vec_id"].to_numpy()[columns], "score": scores[rows, columns]}))
        return pd.concat(found, ignore_index=True)

    return nearest_block


def nearest(vectors: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors nearest to each query vector by cosine, ties by id, scores rounded to six places.

    Vectors and query vectors are dealt into blocks, and every block of the one
    meets every block of the other in a task, as a product of matrices. A pair
    of blocks passes on the k best of each query only, so what is ranked at the
    end is k rows a query and block. A vector that is null, has nulls or no
    length scores 0, one with a NaN comes first; vectors of different sizes come last, without a score.
    """
    norm = F.sqrt(dot(F.col("q"), F.col("q"))).alias("norm")
    # batches of Arrow do not tell null and NaN apart
    length = F.when(F.isnan("norm"), -1.0).otherwise(F.coalesce("norm", F.lit(0.0))).alias("norm")

    def dealt(rows: DataFrame, name: str, block: int) -> tuple[DataFrame, int]:
        rows = rows.select(F.col(ident).alias(name), F.col(vector).cast("array<double>").alias("q"))
        number = max(1, -(-rows.count() // block))
        return rows.select(name, "q", norm).select(name, "q", length, F.pmod(F.xxhash64(name), F.lit(number)).alias("_b")), number

    v, v_blocks = dealt(vectors, "vec_id", VECTOR_BLOCK)
    q, q_blocks = dealt(queries, "query_id", QUERY_BLOCK)
    cell = lambda i, j: (i * q_blocks + j).alias("_cell")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_o")
    v = v.select("*", each(q_blocks)).select("vec_id", "q", "norm", cell(F.col("_b"), F.col("_o")))
    q = q.select("*", each(v_blocks)).select("query_id", "q", "norm", cell(F.col("_o"), F.col("_b")))
    ids = {name: rows.schema[name].dataType.simpleString() for rows, name in ((q, "query_id"), (v, "vec_id"))}
    parts = spread(q, "_cell").groupBy("_cell").cogroup(spread(v, "_cell").groupBy("_cell"))
    best = parts.applyInPandas(_nearest_block(k), f"query_id {ids['query_id']}, vec_id {ids['vec_id']}, score double")
    best = best.withColumn("score", F.when(F.col("score") == float("inf"), float("nan")).when(F.col("score") > float("-inf"), F.col("score")))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("vec_id", ident)


#: Buckets that hashed terms fall into, a fixed value.
BUCKETS = 256
_SPARSE = ArrayType(StructType([StructField("bucket", IntegerType()), StructField("weight", DoubleType())]))


@functools.lru_cache(1 << 18)
def _hashed(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def hashed_vector(text: str | None, buckets: int = BUCKETS) -> list[tuple[int, float]]:
    """Term frequencies by the 64-bit BLAKE2b hash of each word, of length 1, as (bucket, weight); none without words."""
    counts: dict[int, int] = {}
    for word, n in Counter(re.findall("[a-z0-9]+", (text or "").lower())).items():
        bucket = _hashed(word) % buckets
        counts[bucket] = counts.get(bucket, 0) + n
    length = math.sqrt(sum(n * n for n in counts.values()))
    return [(b, n / length) for b, n in sorted(counts.items())]


def hashed_index(blocks: DataFrame, ident: str = "block_id", text: str = "context", buckets: int = BUCKETS) -> DataFrame:
    """A row for each bucket of each block: its weight in the block's vector. Spark has no such hash, so words are hashed in Arrow batches."""

    @F.pandas_udf(_SPARSE)
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"bucket": b, "weight": w} for b, w in hashed_vector(t, buckets)])

    return blocks.select(ident, F.explode(vectors(text)).alias("_v")).select(ident, "_v.bucket", "_v.weight")


def hashed_search(index: DataFrame, blocks: DataFrame, queries: DataFrame, k: int, ident: str = "block_id") -> DataFrame:
    """The k best blocks of each query (query_id, query) by cosine of hashed terms, ties by id; blocks without a shared bucket have 0 and fill up.

    Queries, which are few, meet buckets where these stand, so what no query
    asks for is not moved. Of blocks without a shared bucket the 2k least ids
    are enough to fill any query up.
    """
    asked = hashed_index(queries, "query_id", "query").withColumnRenamed("weight", "_w")
    met = index.join(F.broadcast(asked), "bucket").groupBy("query_id", ident).agg(F.round(F.sum(F.col("weight") * F.col("_w")), 6).alias("score"))
    best = top_k(met, k, ["query_id"], tie=ident).drop("rank")
    # one row of 2k ids, whatever the number of blocks
    least = blocks.select(ident).orderBy(ident).limit(2 * k).agg(F.collect_list(ident).alias("ids"))
    filling = queries.withColumn("_ids", least.scalar()).select("query_id", F.explode("_ids").alias(ident), F.lit(0.0).alias("score")).join(best.select("query_id", ident), ["query_id", ident], "left_anti")
    return top_k(best.unionByName(filling), k, ["query_id"], tie=ident)
