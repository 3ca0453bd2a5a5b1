"""Sharding: a two-pass external shuffle into shards of equal row counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.common import cut

#: UTF-8 bytes of text that a bucket holds on average, small enough for a task's memory.
BUCKET_BYTES = 8 << 20
#: So many bucket offsets (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_BUCKETS = 1 << 20


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of the text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(
    documents: DataFrame,
    shards: int = 16,
    *,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The documents in random order, with ``shard``, ``slot``, ``size`` and ``text_crc32``.

    Law ``rows``: the counts of the shards differ by one at most, slots count
    from 0 without gaps. The first pass measures the bytes and counts the rows
    of each bucket. The second scatters the records by a seeded hash into as
    many buckets as keep each within a task's memory, one partition a bucket,
    and shuffles each bucket with the Fisher-Yates shuffle of ``F.shuffle``.
    The position in all buckets one after another, dealt in turn, gives shard
    and slot.

    The hash covers id, size and checksum, so copies of one text, rows of one
    source and rows without id scatter. Rows that repeat in full are counted
    and numbered first, and the number is hashed too, so they scatter as well.
    Null texts have size 1 and checksum 0. An empty table
    gives an empty result. Clashing columns are replaced. A bucket's rows are
    sorted before they are shuffled, and a bucket is a partition, so that reruns
    agree.
    """
    made = ["size", "text_crc32", "shard", "slot"]
    rows = documents.select(
        *(c for c in documents.columns if c not in made),
        text_bytes(text).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    key = F.xxhash64(F.lit(seed), doc_id, "size", "text_crc32")
    rows = _numbered(rows, key)
    columns = [c for c in rows.columns if c != "_copy"]
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, "_copy"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    shuffled = (
        rows.select("_bucket", F.struct(F.xxhash64(F.lit(seed + 1), key, "_copy").alias("_key"), *columns).alias("_row"))
        .repartitionById(buckets, F.col("_bucket"))
        .sortWithinPartitions("_bucket", "_row._key", f"_row.{doc_id}", f"_row.{text}")
        .groupBy("_bucket")
        .agg(F.collect_list("_row").alias("_rows"))
        .select("_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    )
    placed = shuffled.join(F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets, "_bucket")
    at = F.col("_before") + F.col("_at")
    return (
        placed.select("_before", F.posexplode("_rows").alias("_at", "_row"))
        .select("_row.*", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))
        .drop("_key")
    )


def _numbered(rows: DataFrame, key: Column) -> DataFrame:
    """The rows with ``_copy``: 0, and 1, 2, ... for further rows that are alike in all columns.

    Only rows of a key that comes twice are grouped, and they are counted
    before they move; so most tables pay for a count of their keys alone.
    """
    twice = cut(rows.groupBy(key.alias("_twice")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_twice"))
    if twice.isEmpty():
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    keyed = rows.withColumn("_twice", key)
    once = keyed.join(twice, "_twice", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("_copy"))
    counted = keyed.join(twice, "_twice", "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    return once.unionAll(counted.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; the rows of a file in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
