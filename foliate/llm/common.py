"""What the corpus operators share: tables, words, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word, after A-Z became a-z: digits, letters of ASCII, everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z and turns every byte outside WORD into a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; null has none."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a temporary one in local mode, as in tests, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="foliate-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder: a lost executor costs no recomputation of what led to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """As ``cut``, in columns and compressed, for tables that are read in part or more than once; with options of the writer."""
    path = shared_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_apart(df: DataFrame, used: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all columns but the ``used`` ones under names that no operator makes, and what gives a result the columns back."""
    columns, names = df.columns, {c: f"_column_{i}" for i, c in enumerate(df.columns) if c not in used}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(names.get(c, c)).alias(c) for c in columns))

    return df.withColumnsRenamed(names), back


def bucket_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Rows that a Python function gets at a time, whatever the size of Spark's own batches.
ROWS = 1000


def append(df: DataFrame, inputs: list[str], fields: str, function: Callable[..., list[list]], keep: list[str] | None = None) -> DataFrame:
    """The rows with new columns, computed in batches from the lists of values of some columns.

    Other columns, or those of ``keep``, pass through untouched in Arrow. Columns that clash with a new one are replaced.
    """
    new = StructType.fromDDL(fields)
    passed = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    kept = df.select(*dict.fromkeys([*passed, *inputs]))
    out = StructType([kept.schema[c] for c in passed] + new.fields)
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                made = function(*(batch.column(c).to_pylist() for c in inputs))
                columns = [pa.array(x, type=f.type) for x, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *columns], names=[*passed, *new.names])

    return kept.mapInArrow(run, out)
