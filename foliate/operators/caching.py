"""Results of calls kept by what was asked, so that a call is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.storage import settled

STORED = "key string, action string, model string, result string"


def canonical(payload: Column) -> Column:
    """JSON text with the keys of its objects in order at every depth and without blanks; null where it is no JSON or an object repeats a key."""
    return F.to_json(F.try_parse_json(payload))


def call_key(action: Column, payload: Column, model: Column) -> Column:
    """What tells calls apart: action, model and the payload's content, whatever the order of its keys; null where the payload is no JSON.

    Each part stands behind its length, so that parts cannot run into each
    other. A missing model is the same as an empty one.
    """
    parts = [F.coalesce(action, F.lit("")), F.coalesce(model, F.lit("")), canonical(payload)]
    return F.left(F.sha2(F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)).cast("binary"), 256), F.lit(32))


class ResultCache:
    """A Parquet store of results under a folder that all tasks reach.

    An entry that cannot be read is a miss, and so is one that another run has
    not written yet; a key that was stored twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stored(self) -> DataFrame:
        """(key, action, model, result) of all that can be read, one row a key."""
        try:
            rows = self.spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").schema(STORED).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], STORED)
        rows = rows.where("key is not null and result is not null")
        return rows.groupBy("key").agg(F.min(F.struct("action", "model", "result")).alias("x")).select("key", "x.*")

    def put(self, results: DataFrame) -> None:
        """Appends (key, action, model, result); rows without key or result are not stored."""
        results.where("key is not null and result is not null").select("key", "action", "model", "result").write.mode("append").parquet(self.path)

    def through(self, calls: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The calls (action, payload, model) with ``key``, ``result`` and ``hit``.

        Only calls that are not stored go to ``compute``, each once however
        often it is asked. It gets (key, action, payload, model) and returns
        (key, result, error). Results without an error are stored, others are
        returned but asked again the next time. Calls without a key are
        computed one by one and never stored. Without a miss nothing is
        computed and nothing is written.
        """
        made = [c for c in calls.columns if c not in ("key", "result", "hit")]
        keyed = settled(calls.select(made).withColumn("key", call_key(F.col("action"), F.col("payload"), F.col("model"))).withColumn("_row", F.monotonically_increasing_id()))
        known = settled(self.stored().join(keyed.select("key").distinct(), "key", "left_semi").select("key", "result"))
        missing = keyed.join(known.select("key"), "key", "left_anti")
        asked = missing.where("key is not null").groupBy("key").agg(F.min(F.struct("action", "model", "payload")).alias("x")).select("key", "x.*")
        lone = missing.where("key is null").select(F.concat(F.lit("row "), "_row").alias("key"), "action", "model", "payload")
        asked = settled(asked.unionAll(lone))
        place = F.coalesce("key", F.concat(F.lit("row "), F.col("_row"))).alias("_key")
        if asked.isEmpty():
            found = known.select(F.col("key").alias("_key"), "result", F.lit(True).alias("hit"))
        else:
            computed = settled(compute(asked).select("key", "result", "error"))
            self.put(asked.join(computed.where("error is null"), "key").where(~F.startswith("key", F.lit("row "))))
            found = known.select(F.col("key").alias("_key"), "result", F.lit(True).alias("hit")).unionAll(computed.select("key", "result", F.lit(False)))
        return keyed.withColumn("_key", place).join(found, "_key", "left").select(*made, "key", "result", F.coalesce("hit", F.lit(False)).alias("hit"))
