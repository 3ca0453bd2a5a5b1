"""Knowledge graphs of many papers as two tables: nodes and edges, keyed by paper_id.

A node has ord, id, label, type, description, section_path, aliases, evidence
and confidence; an edge has ord, source, target and relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.lines import let
from foliate.functions.text import squash, strip
from foliate.operators import entities

# The vocabulary, the types whose labels must stand in the text, and the keywords of the domains in their order.
NODE_TYPES = ("method", "dataset", "claim", "result", "metric", "concept", "task")
RELATIONS = ("uses", "evaluates_on", "compared_against", "reports", "part_of", "related_to")
GROUNDED = ("method", "dataset", "metric", "task")
UNGROUNDED_FACTOR, LEAST_CONFIDENCE, MOST_SHOWN = 0.4, 0.5, 12
DOMAINS = {
    "ml": ("neural network", "deep learning", "gradient", "training", "classifier", "supervised", "reinforcement", "embedding", "loss function"),
    "nlp": ("language model", "tokeniz", "transformer", "text corpus", "translation", "question answering", "named entity", "sentiment"),
    "vision": ("image", "convolution", "segmentation", "object detection", "pixel", "visual", "video frame"),
    "systems": ("throughput", "latency", "filesystem", "scheduler", "distributed system", "cache", "kernel", "concurrency", "i/o"),
    "theory": ("theorem", "lemma", "proof", "complexity", "bound", "np-hard", "approximation algorithm", "asymptotic"),
    "bio": ("protein", "genome", "molecul", "cell", "rna", "clinical", "biological", "sequencing"),
}


def coerce(value: Column, known: tuple[str, ...], otherwise: str) -> Column:
    tidy = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(tidy.isin(*known), tidy).otherwise(otherwise)


def coerce_types(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("type", coerce(F.col("type"), NODE_TYPES, "concept"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two nodes of their paper, no loops, the first of equal ones, with a known relation."""
    ids = nodes.select("paper_id", F.col("id")).distinct()
    known = edges.withColumn("relation", coerce(F.col("relation"), RELATIONS, "related_to")).where("source != target")
    for end in ("source", "target"):
        known = known.join(ids.withColumnRenamed("id", end), ["paper_id", end], "left_semi")
    same = Window.partitionBy("paper_id", "source", "relation", "target").orderBy("ord")
    return known.withColumn("_i", F.row_number().over(same)).where("_i = 1").select(edges.columns)


def prune_below(nodes: DataFrame, edges: DataFrame, least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Nodes of that confidence, and the edges between them."""
    kept = nodes.where(F.col("confidence") >= least)
    ids = kept.select("paper_id", "id").distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["paper_id", end], "left_semi")
    return kept, edges


def prune_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge; a paper without any edge keeps all its nodes."""
    ends = edges.select("paper_id", F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_has", F.lit(True))
    papers = edges.select("paper_id").distinct().withColumn("_any", F.lit(True))
    marked = nodes.join(ends, ["paper_id", "id"], "left").join(papers, "paper_id", "left")
    return marked.where(F.col("_any").isNull() | F.col("_has").isNotNull()).select(nodes.columns)


def ground(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Confidence and evidence by whether the label or an alias stands in the paper's text (paper_id, text)."""
    names = F.array_prepend(F.coalesce("aliases", F.array().cast("array<string>")), F.col("label"))
    both = nodes.join(texts.select("paper_id", F.lower("text").alias("_text")), "paper_id", "left")
    text = F.coalesce("_text", F.lit(""))
    found = F.exists(names, lambda n: (n != "") & F.contains(text, F.lower(F.trim(n))))
    asked = F.col("type").isin(*GROUNDED)
    evidence = F.when(asked & found & (F.coalesce("evidence", F.lit("")) == ""), "grounded in section text").otherwise(F.col("evidence"))
    return both.withColumns({"confidence": F.when(asked & ~found, F.col("confidence") * UNGROUNDED_FACTOR).otherwise(F.col("confidence")), "evidence": evidence}).select(nodes.columns)


def verify(nodes: DataFrame, edges: DataFrame, texts: DataFrame, least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Grounding, then pruning by confidence, then of what is left without an edge."""
    kept, between = prune_below(ground(nodes, texts), edges, least)
    return prune_orphans(kept, between), between


def briefing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A short text of each graph: labels by type, the first dozen of each."""
    labels = F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"])
    by_type = nodes.groupBy("paper_id", "type").agg(labels.alias("_l"))
    more = F.when(F.size("_l") > MOST_SHOWN, F.concat(F.lit(" (+"), F.size("_l") - MOST_SHOWN, F.lit(" more)"))).otherwise("")
    line = F.concat(F.lit("- "), "type", F.lit(": "), F.array_join(F.slice("_l", 1, MOST_SHOWN), ", "), more)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("type", line.alias("line")))), lambda x: x["line"])
    grouped = by_type.groupBy("paper_id").agg(rows.alias("_rows"), F.sum(F.size("_l")).alias("_n"))
    counted = edges.groupBy("paper_id").agg(F.count(F.lit(1)).alias("_e"))
    head = F.concat(F.lit("Knowledge graph: "), "_n", F.lit(" nodes, "), F.coalesce("_e", F.lit(0)), F.lit(" relations."))
    return grouped.join(counted, "paper_id", "left").select("paper_id", F.concat(head, F.lit("\n"), F.array_join("_rows", "\n")).alias("briefing"))


def seed(papers: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node for each paper's title and for each different title of its sections, the sections being part of the paper.

    A section whose title, blanks and case aside, came before joins that node:
    it gives its path where the node has none, and its spelling as an alias;
    it has no edge of its own.
    """
    def node(ident: Column, text: str, path: Column) -> list[Column]:
        return [ident.alias("id"), strip(F.col("title")).alias("label"), F.lit("concept").alias("type"), F.lit(text).alias("description"), path.alias("section_path")]

    titled = papers.where(strip(F.coalesce("title", F.lit(""))) != "")
    tops = titled.select("paper_id", F.lit(0).cast("long").alias("ord"), *node(F.lit("paper"), "paper title", F.lit(None).cast("string")))
    parts = sections.where(strip(F.coalesce("title", F.lit(""))) != "")
    parts = parts.select("paper_id", F.col("ord").cast("long").alias("ord"), *node(F.concat(F.lit("sec"), F.col("ord") - 1), "section", F.col("section_path")))
    everything = tops.unionAll(parts).withColumn("_same", F.lower(squash(F.col("label"))))
    first = F.min(F.struct("ord", "id", "label", "type", "description", "section_path"))
    path = F.min(F.when(F.col("section_path") != "", F.struct("ord", "section_path")))
    spellings = F.array_sort(F.collect_list(F.struct("ord", "label")))
    merged = everything.groupBy("paper_id", "_same").agg(first.alias("n"), path.alias("p"), spellings.alias("_l"))
    aliases = F.array_except(F.array_distinct(F.transform("_l", lambda x: x["label"])), F.array("n.label"))
    section_path = F.when(F.col("n.section_path") != "", F.col("n.section_path")).otherwise(F.col("p.section_path"))
    nodes = merged.select("paper_id", "n.ord", "n.id", "n.label", "n.type", "n.description", section_path.alias("section_path"), aliases.alias("aliases"))
    linked = nodes.where("id != 'paper'").join(titled.select("paper_id").distinct(), "paper_id", "left_semi")
    return nodes, linked.select("paper_id", "ord", F.col("id").alias("source"), F.lit("paper").alias("target"), F.lit("part_of").alias("relation"))


def detect_domain(texts: DataFrame, text: str = "text") -> DataFrame:
    """The domain with most keywords in the text, the first of equals; general without any."""
    def best_of(lower: Column) -> Column:
        hits = lambda words: sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0))
        return F.array_max(F.array(*(F.struct(hits(words).alias("hits"), F.lit(-i).alias("o"), F.lit(name).alias("domain")) for i, (name, words) in enumerate(DOMAINS.items()))))

    texts = texts.withColumn("_best", let(F.lower(F.coalesce(text, F.lit(""))), best_of))
    best = F.col("_best")
    return texts.withColumns({"domain": F.when(best["hits"] > 0, best["domain"]).otherwise("general"), "hits": best["hits"]}).drop("_best")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each entity of a paper: the same id, or the same type and label; see ``entities``."""
    return entities.merge(nodes)[0]


def coreference(nodes: DataFrame) -> DataFrame:
    """paper_id, id and the canonical id of every node; see ``entities.corefer``."""
    ends = nodes.select("paper_id", F.col("ord").alias("to"), F.col("id").alias("_to"))
    goes = entities.corefer(nodes).join(ends, ["paper_id", "to"]).select("paper_id", "ord", "_to")
    return nodes.join(goes, ["paper_id", "ord"], "left").select("paper_id", "id", F.coalesce("_to", "id").alias("canonical"))


def corefer(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with coreferent nodes made one: what stands for another gives it its label as an alias, and its description where that is longer."""
    to = entities.corefer(nodes)
    names = to.join(nodes.select("paper_id", "ord", "label", "description"), ["paper_id", "ord"])
    size = F.length(F.coalesce("description", F.lit("")))
    given = names.groupBy("paper_id", F.col("to").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("_l"), F.max_by("description", F.struct(size, -F.col("ord"))).alias("_d"))
    kept = nodes.join(to.select("paper_id", "ord"), ["paper_id", "ord"], "left_anti").join(given, ["paper_id", "ord"], "left")
    before = F.coalesce("aliases", F.array().cast("array<string>"))
    more = F.array_except(F.filter(F.transform("_l", lambda x: x["label"]), lambda x: x != ""), before)
    longer = F.length("_d") > F.length(F.coalesce("description", F.lit("")))
    kept = kept.withColumns({"aliases": F.concat(before, F.coalesce(more, F.array().cast("array<string>"))), "description": F.when(longer, F.col("_d")).otherwise(F.col("description"))})
    return kept.select(nodes.columns), redirect(edges, coreference(nodes))


def redirect(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between canonical nodes: loops go, of equal ones the first stays."""
    out = edges
    for end in ("source", "target"):
        to = mapping.select("paper_id", F.col("id").alias(end), F.col("canonical").alias("_to"))
        out = out.join(to, ["paper_id", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    same = Window.partitionBy("paper_id", "source", "relation", "target").orderBy("ord")
    return out.where("source != target").withColumn("_i", F.row_number().over(same)).where("_i = 1").select(edges.columns)
