"""BibTeX texts as tables of entries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# How an entry begins, its key possibly empty, and how a field does.
ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s}]*)\s*[,}]", re.I)
FIELD = re.compile(r"(\w+)\s*=")

_FOUND = ArrayType(StructType([StructField("type", StringType()), StructField("key", StringType()), StructField("fields", ArrayType(StringType()))]))


def entries_of(text: str | None) -> list[dict]:
    """Type, key and sorted field names of each entry of a text; an entry whose braces never close runs to the end."""
    text = text or ""
    closes: dict[int, int] = {}
    opened: list[int] = []
    for brace in re.finditer("[{}]", text):
        if brace[0] == "{":
            opened.append(brace.start())
        elif opened:
            closes[opened.pop()] = brace.start()
    out = []
    for head in ENTRY.finditer(text):
        first = text.index("{", head.start())
        comma = text.find(",", first, closes.get(first, len(text)))
        names = {m[1].lower() for m in FIELD.finditer(text, comma + 1, closes.get(first, len(text)))} if comma >= 0 else set()
        out.append({"type": head[1].lower(), "key": head[2].strip(), "fields": sorted(names)})
    return out


@F.pandas_udf(_FOUND)
def _entries(texts: pd.Series) -> pd.Series:
    return texts.map(entries_of)


def parse(texts: DataFrame, by: list[str], bibtex: str = "bibtex") -> DataFrame:
    """A row an entry of each text: ``ord`` from 0, type, key, fields. Braces nest, so texts are parsed in Arrow batches where they stand."""
    rows = texts.select(*by, F.posexplode(_entries(bibtex)).alias("ord", "e"))
    return rows.select(*by, "ord", F.col("e.type").alias("type"), F.col("e.key").alias("key"), F.col("e.fields").alias("fields"))
