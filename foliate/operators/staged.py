"""Knowledge graphs made in stages that are kept, so that a run goes on where one was cut."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.operators import answers, entities, graph

#: The stages in their order; asking a model for an ontology is left out.
STAGES = ("metadata", "extraction", "coref", "verification", "summary")
#: Extracted nodes and edges come after all that was there.
LATER = 1 << 50
Graph = tuple[DataFrame, DataFrame]


class Checkpoints:
    """Stages under a folder: nodes and edges as Parquet, and a manifest that is written last, so that a stage that was cut is not taken for a whole one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, stage: str, state: Graph) -> dict:
        """Keeps a stage, in place of what was there, and returns its manifest."""
        path = f"{self.folder}/{stage}"
        counts = {}
        # without a manifest the stage does not count while its tables are written
        self.spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{path}/manifest")
        for name, table in zip(("nodes", "edges"), state, strict=True):
            table.write.mode("overwrite").parquet(f"{path}/{name}")
            counts[name] = self.spark.read.parquet(f"{path}/{name}").count()
        manifest = {"stage": stage, **counts}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        return manifest

    def manifest(self, stage: str) -> dict | None:
        """The manifest of a whole stage; none where it is missing, is not one, or its tables do not have the rows that it tells."""
        path = f"{self.folder}/{stage}"
        try:
            lines = self.spark.read.text(f"{path}/manifest").limit(2).collect()
            found = json.loads(lines[0]["value"]) if len(lines) == 1 else None
            if isinstance(found, dict) and found.get("stage") == stage and all(self.spark.read.parquet(f"{path}/{t}").count() == found.get(t) for t in ("nodes", "edges")):
                return found
        except (AnalysisException, ValueError):
            pass
        return None

    def read(self, stage: str) -> Graph:
        return tuple(self.spark.read.parquet(f"{self.folder}/{stage}/{t}") for t in ("nodes", "edges"))


def _filled(nodes: DataFrame) -> DataFrame:
    """Nodes with the columns of extracted ones."""
    missing = {"evidence": F.lit(""), "confidence": F.lit(1.0)}
    return nodes.withColumns({c: v for c, v in missing.items() if c not in nodes.columns})


def enrich(state: Graph, more: Graph) -> Graph:
    """A graph with another's nodes merged into it and the edges whose ends are still there, of equal ones the first."""
    columns = ["paper_id", "ord", "id", "label", "type", "description", "section_path", "aliases", "evidence", "confidence"]
    later = F.col("ord") + LATER
    nodes = entities.merge(state[0].select(columns).unionAll(more[0].withColumn("ord", later).select(columns)))[0]
    ends = ["paper_id", "ord", "source", "target", "relation"]
    return nodes, graph.valid_edges(state[1].select(ends).unionAll(more[1].withColumn("ord", later).select(ends)), nodes)


def run(spark: SparkSession, inputs: dict[str, Callable[[], DataFrame]], folder: str, stages: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Nodes, edges, and a report of each stage: its name, counts, and whether it was ``skipped``.

    ``inputs`` makes the tables that stages read: ``papers`` (paper_id, title)
    and ``sections`` (paper_id, ord, title, section_path, text) for metadata,
    sections for verification, ``answers`` (paper_id, batch, response) for
    extraction. Stages run in their order, or those of ``stages``, each on what
    the one before has kept. A stage that is whole in the folder is not run,
    and its inputs are not made; what was kept but is not whole is made
    anew. The summary adds a briefing of each paper, ``summary`` returns it.
    """
    kept, report, state = Checkpoints(spark, folder), [], None

    def empty() -> Graph:
        nodes = "paper_id long, ord long, id string, label string, type string, description string, section_path string, aliases array<string>, evidence string, confidence double"
        return spark.createDataFrame([], nodes), spark.createDataFrame([], "paper_id long, ord long, source string, target string, relation string")

    def made(stage: str, before: Graph) -> Graph:
        if stage == "metadata":
            nodes, edges = graph.seed(inputs["papers"](), inputs["sections"]())
            return _filled(nodes), edges
        if stage == "extraction":
            return enrich(before, answers.build(inputs["answers"]())[:2])
        if stage == "coref":
            return graph.corefer(*before)
        if stage == "verification":
            texts = inputs["sections"]().groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
            return graph.verify(*before, texts)
        return before

    for stage in (s for s in STAGES if stages is None or s in stages):
        found = kept.manifest(stage)
        manifest = found or kept.write(stage, made(stage, state or empty()))
        state = kept.read(stage)
        report.append({**manifest, "skipped": found is not None})
    return *(state or empty()), report


def summary(state: Graph) -> DataFrame:
    """The briefing of each paper's graph."""
    return graph.briefing(*state)
