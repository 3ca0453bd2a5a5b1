"""The corpus pipeline: five operators one after another over ``documents``.

Every stage takes a table without rows, null in any column, texts that are
empty or very long, rows that repeat, and further columns of any name, which
all stages but the last hand on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import contamination, language, mixing, sharding, similarity
from foliate.llm.common import bucket_of_id, set_apart, shared_path, table

#: A document stays when its language is told with this mean probability at least.
LEAST_LANGUAGE = 0.4
SHARDS = 16


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a text of a recognised language; null texts, texts without a letter and doubtful ones go.

    Repeated rows stay or go together. Without any labelled text no language
    is recognised and nothing stays.
    """
    docs, back = set_apart(docs, ["doc_id", "text", "lang"])
    model = language.train(docs.where(~F.coalesce(bucket_of_id("doc_id", 4) == 2, F.lit(False))))
    found = language.identify(docs, model)
    return back(found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of copies and near copies, with the least id; rows that repeat an id or have none leave one as well."""
    return similarity.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; null and empty texts have none and stay, repeated rows stay or go together."""
    docs, back = set_apart(docs, ["doc_id", "text"])
    found = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return back(found.where("n_hit = 0"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, once or twice; those without a word are never taken.

    Null is a source of its own. Rows that repeat are documents of their own.
    """
    docs, back = set_apart(docs, ["doc_id", "text", "source"])
    taken = mixing.mix(docs).where("taken > 0")
    times = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    return back(taken.withColumn("_time", times))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order, by shard and slot, with size and checksum; these replace columns of their names."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The network, the flow's seeded choice and the shuffle have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
