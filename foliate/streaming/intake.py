"""New markdown files of a folder as section blocks, in batches as they come. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliate.operators.blocks import build_sections, to_lines


def stream_sections(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch's files go through the batch operator and are appended; a batch that is repeated overwrites its own folder."""
    files = spark.readStream.schema("value string").option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("paper_id"), F.col("value").alias("markdown"))

    def batch(df: DataFrame, number: int) -> None:
        build_sections(to_lines(df)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
