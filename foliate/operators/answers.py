"""Answers of language models as tables: the JSON object in a text, and graphs from batches of such answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliate.operators import entities, graph
from foliate.storage import settled

FENCE = "```json"
#: A string, closed or not, or a brace outside of strings.
_PIECE = re.compile(r'"(?:\\.|[^"\\])*"?|[{}]', re.S)


def json_object(text: str | None) -> str | None:
    """The JSON object of a text: of its first fenced block, else the first balanced braces; none if that is no object."""
    text = text or ""
    tries = []
    start = text.find(FENCE)
    end = text.find("```", start + len(FENCE)) if start >= 0 else -1
    if end >= 0:
        tries.append(text[start + len(FENCE) : end])
    first, depth = text.find("{"), 0
    for piece in _PIECE.finditer(text, first) if first >= 0 else ():
        depth += {"{": 1, "}": -1}.get(piece[0], 0)
        if not depth:
            tries.append(text[first : piece.end()])
            break
    for tried in tries:
        try:
            if isinstance(json.loads(tried), dict):
                return tried
        except (ValueError, RecursionError):
            continue
    return None


@F.pandas_udf(StringType())
def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(json_object)


def parsed(answers: DataFrame, text: str = "response") -> DataFrame:
    """The answers with ``object``, the JSON object in their text, null where there is none."""
    return answers.withColumn("object", _objects(text))


def graphs(answers: DataFrame, text: str = "response") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the answers (paper_id, batch, response), and the papers of which no answer could be read.

    Items that are no objects, or lack an id, a label or an end, are left out,
    unknown types and relations become the general ones; edges need both ends
    in their answer. Nodes still have to be merged over the batches.
    """
    found = parsed(answers, text).select("paper_id", "batch", F.from_json("object", "nodes array<string>, edges array<string>").alias("o"), F.col("object").isNotNull().alias("read"))
    failed = found.groupBy("paper_id").agg(F.bool_or("read").alias("any")).where("not any").select("paper_id")
    one = lambda raw: F.from_json(raw, "id string, label string, type string, description string, section_path string, aliases array<string>, evidence string, confidence double")
    nodes = found.select("paper_id", "batch", F.posexplode("o.nodes").alias("at", "raw")).withColumn("n", one("raw")).where("n.id is not null and n.label is not null")
    empty = lambda c: F.coalesce(f"n.{c}", F.lit("")).alias(c)
    order = (F.col("batch").cast("long") * (1 << 32) + F.col("at")).alias("ord")
    nodes = nodes.select("paper_id", "batch", order, "n.id", "n.label", F.coalesce("n.type", F.lit("concept")).alias("type"), empty("description"), "n.section_path", F.coalesce("n.aliases", F.array().cast("array<string>")).alias("aliases"), empty("evidence"), F.coalesce("n.confidence", F.lit(1.0)).alias("confidence"))
    # the ends of edges are looked up in the row of their answer, so that nothing is moved or read twice for them
    named = F.filter(F.transform("o.nodes", one), lambda n: n["id"].isNotNull() & n["label"].isNotNull())
    pairs = found.select("paper_id", "batch", F.transform(named, lambda n: n["id"]).alias("ids"), F.posexplode("o.edges").alias("at", "raw")).withColumn("e", F.from_json("raw", "source string, target string, relation string"))
    edges = pairs.where(F.array_contains("ids", F.col("e.source")) & F.array_contains("ids", F.col("e.target"))).select("paper_id", "batch", order, "e.source", "e.target", F.coalesce("e.relation", F.lit("related_to")).alias("relation"))
    return graph.coerce_types(nodes), edges.withColumn("relation", graph.coerce(F.col("relation"), graph.RELATIONS, "related_to")), failed


def batches(sections: DataFrame, size: int = 6, text: str = "text") -> DataFrame:
    """(paper_id, batch, context): the sections of a paper in their order, so many to a batch, apart by blank lines."""
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord")) - 1
    rows = sections.select("paper_id", "ord", F.col(text).alias("_text"), F.floor(place / size).cast("int").alias("batch"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "_text"))), lambda x: x["_text"])
    return rows.groupBy("paper_id", "batch").agg(F.array_join(texts, "\n\n").alias("context"))


def build(answers: DataFrame, text: str = "response") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graphs of papers from their batches of answers: nodes, edges, and the papers of which no answer could be read.

    Nodes of all batches are merged in the order of batches. An edge names
    nodes of its own batch, so each end goes where the batch's node of that id
    went, the last one if the batch has several; ids that batches use for
    different things stay apart. Then loops go, and of equal edges the first
    stays. An unread batch takes nothing from the others.
    """
    nodes, edges, failed = graphs(answers, text)
    nodes = settled(nodes)
    merged, to = entities.merge(nodes.drop("batch"))
    ends = to.join(nodes.select("paper_id", "ord", "batch", "id"), ["paper_id", "ord"])
    ends = settled(ends.groupBy("paper_id", "batch", "id").agg(F.max_by("canonical", "ord").alias("_to")))
    for end in ("source", "target"):
        edges = edges.join(ends.withColumnRenamed("id", end), ["paper_id", "batch", end]).withColumn(end, F.col("_to")).drop("_to")
    first = edges.where("source != target").groupBy("paper_id", "source", "target", "relation").agg(F.min("ord").alias("ord"))
    return merged, first.select("paper_id", "ord", "source", "target", "relation"), failed
