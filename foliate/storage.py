"""Where intermediate tables of several rounds are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a temporary one in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="foliate-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(rows: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, so that rounds do not grow the plan and a lost executor costs no round."""
    checkpoint_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by these columns over as many tasks as shuffles have, for rows that are small and make much work; small partitions are not joined again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
