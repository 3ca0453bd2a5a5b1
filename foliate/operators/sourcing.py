"""Records and claims between searches and sources: addresses, cascades of services, claims and what supports them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.text import squash, strip
from foliate.storage import spread

# Words of headers that tell of methods and experiments; characters that a paper gives to a prompt; pairs of claim and source of a text; new kinds an ontology takes.
RELEVANT = r"(?i)method|approach|architect|model|system|design|experiment|evaluat|setup|dataset|benchmark|baseline|metric|ablation|result|implementation|protocol"
PAPER_CHARS, MOST_PAIRS, MOST_KINDS = 8000, 200, 8
#: Parts that the records filed under a title are dealt over.
RECORD_PARTS = 32


def arxiv_id(record_id: Column, external_ids: Column) -> Column:
    """The arXiv id of a record, from its own id or the ids of other services."""
    own = F.when(record_id.startswith("arxiv:"), F.nullif(F.substring_index(F.substring(record_id, 7, 1 << 30), "\x00", 1), F.lit("")))
    others = [F.nullif(F.try_element_at(external_ids, F.lit(name)), F.lit("")) for name in ("ArXiv", "arxiv", "ARXIV")]
    return F.when(record_id.startswith("arxiv:"), own).otherwise(F.coalesce(*others))


def record_url(record_id: Column, external_ids: Column) -> Column:
    """The best address of a record: by DOI, by arXiv id, by the service its id names."""
    after = lambda name: F.substring(record_id, len(name) + 1, 1 << 30)
    doi, arxiv = (F.nullif(F.try_element_at(external_ids, F.lit(k)), F.lit("")) for k in ("DOI", "ArXiv"))
    return (
        F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi))
        .when(arxiv.isNotNull(), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
        .when(record_id.startswith("arxiv:"), F.concat(F.lit("https://arxiv.org/abs/"), after("arxiv:")))
        .when(record_id.startswith("crossref:") & F.contains(after("crossref:"), F.lit("/")), F.concat(F.lit("https://doi.org/"), after("crossref:")))
        .when(record_id.startswith("openalex:"), F.nullif(after("openalex:"), F.lit("")))
        .when((record_id != "") & ~record_id.startswith("crossref:"), F.concat(F.lit("https://www.semanticscholar.org/paper/"), record_id))
    )


def record_view(records: DataFrame) -> DataFrame:
    """The seven columns of a record that discovery shows."""
    return records.select("title", "year", "authors", "venue", "abstract", F.col("record_id").alias("paper_id"), record_url(F.col("record_id"), F.col("external_ids")).alias("url"))


def cascade(records: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Records of each query from services tried in turn, and what came of each service.

    ``records`` has query_id, backend_ord, rec_ord and title. Of equal titles,
    blanks and case aside, the first stays; the first ``limit`` are taken, and
    services after the one that fills them are not reached.
    """
    key = F.lower(squash(F.coalesce("title", F.lit(""))))
    order = Window.partitionBy("query_id").orderBy("backend_ord", "rec_ord")
    once = Window.partitionBy("query_id", "_key").orderBy("backend_ord", "rec_ord")
    kept = records.withColumn("_key", key).where("_key != ''").withColumn("_i", F.row_number().over(once)).where("_i = 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    given = records.groupBy("query_id", "backend_ord").agg(F.count(F.lit(1)).alias("given"))
    full = kept.where(F.col("rank") == limit).select("query_id", F.col("backend_ord").alias("_last"))
    outcome = F.when(F.col("backend_ord") > F.col("_last"), "not reached: limit already met").otherwise(F.concat(F.lit("ok: "), F.col("given").cast("string")))
    outcomes = given.join(full, "query_id", "left").select("query_id", "backend_ord", outcome.alias("outcome"))
    return kept.drop("_key", "_i"), outcomes


def known_records(titles: DataFrame, records: DataFrame) -> DataFrame:
    """Records filed under each title (``filed_as``), case aside.

    The records of a title are dealt over RECORD_PARTS parts, and each part
    meets all its titles, so a title with many records is no work of one task.
    """
    parts = titles.withColumn("_t", F.lower("title")).where("_t is not null").withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(RECORD_PARTS - 1))))
    filed = records.withColumn("_t", F.lower("filed_as")).where("_t is not null").withColumn("_p", F.pmod(F.xxhash64(*records.columns), F.lit(RECORD_PARTS)).cast("int"))
    return spread(parts, "_t", "_p").hint("shuffle_hash").join(spread(filed, "_t", "_p"), ["_t", "_p"]).drop("_t", "_p")


def unseen_titles(records: DataFrame, notes: DataFrame) -> DataFrame:
    """Records whose title no note of the brief has, blanks and case aside; of equal ones the first by ord."""
    key = F.lower(strip(F.coalesce("title", F.lit(""))))
    first = Window.partitionBy("brief_id", "_t").orderBy("ord")
    have = notes.select("brief_id", key.alias("_t")).distinct()
    return records.withColumn("_t", key).where("_t != ''").join(have, ["brief_id", "_t"], "left_anti").withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i", "_t")


def first_pairs(pairs: DataFrame, most: int = MOST_PAIRS, order: tuple[str, ...] = ("ord", "sentence", "key")) -> DataFrame:
    """The first pairs of claim and key of each paper."""
    at = F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))
    return pairs.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def sources_of_claims(pairs: DataFrame, citations: DataFrame, full_texts: DataFrame | None = None) -> DataFrame:
    """Pairs of claim and key with the text to judge them by: the full text if there is one, else the abstract; ``no_source`` where neither is."""
    entries = citations.select("paper_id", "key", strip(F.coalesce("abstract", F.lit(""))).alias("_abstract"), F.lit(True).alias("_cited"))
    out = pairs.join(entries, ["paper_id", "key"], "left")
    if full_texts is not None:
        out = out.join(full_texts.select("key", strip(F.coalesce("text", F.lit(""))).alias("_full")), "key", "left")
    else:
        out = out.withColumn("_full", F.lit(None).cast("string"))
    full, brief = F.col("_cited") & (F.col("_full") != ""), F.col("_cited") & (F.col("_abstract") != "")
    kind = F.when(full, "full_text").when(brief, "abstract").otherwise("none")
    text = F.when(full, F.col("_full")).when(brief, F.col("_abstract")).otherwise("")
    verdict = F.when(kind == "none", "no_source")
    return out.select(*pairs.columns, kind.alias("source_kind"), text.alias("source_text"), verdict.alias("verdict"))


def paper_contexts(sections: DataFrame, default: str = "paper", most: int = PAPER_CHARS) -> DataFrame:
    """A text of each source of a gathered set: sections on methods and experiments first, then the others, cut at ``most`` characters."""
    path = F.coalesce("section_path", F.lit(""))
    labelled = path.rlike(r"^\[[^\]]+\]")
    label = F.when(labelled, strip(F.regexp_extract(path, r"^\[([^\]]+)\]", 1))).otherwise(F.lit(default))
    heading = F.when(labelled, strip(F.regexp_replace(path, r"^\[[^\]]+\]\s*", ""))).otherwise(path)
    body = F.when(heading != "", strip(F.concat(F.lit("## "), heading, F.lit("\n"), F.coalesce("text", F.lit(""))))).otherwise(strip(F.coalesce("text", F.lit(""))))
    rows = sections.select("set_id", "ord", F.when(label != "", label).otherwise(F.lit(default)).alias("label"), (~heading.rlike(RELEVANT)).alias("later"), body.alias("body")).where("body != ''")
    parts = F.array_sort(F.collect_list(F.struct("later", "ord", "body")))
    joined = F.substring(F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n"), 1, most)
    return rows.groupBy("set_id", "label").agg(F.min("ord").alias("ord"), joined.alias("text"))


def merge_kinds(base: DataFrame, extra: DataFrame, most: int = MOST_KINDS) -> DataFrame:
    """The base vocabulary of each paper's ontology (paper_id, kind, name, ord), and the first new names found, over all kinds together."""
    once = Window.partitionBy("paper_id", "kind", "name").orderBy("ord")
    new = extra.join(base.select("paper_id", "kind", "name"), ["paper_id", "kind", "name"], "left_anti").withColumn("_i", F.row_number().over(once)).where("_i = 1").drop("_i")
    new = new.withColumn("_at", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("kind"), "ord"))).where(F.col("_at") <= most).drop("_at")
    return base.select("paper_id", "kind", "name", "ord", F.lit(False).alias("found")).unionAll(new.select("paper_id", "kind", "name", "ord", F.lit(True)))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, entities (all but concepts) and edges of each paper."""
    counted = nodes.groupBy("paper_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type") != "concept").alias("entities"))
    return counted.join(edges.groupBy("paper_id").agg(F.count(F.lit(1)).alias("edges")), "paper_id", "left").na.fill(0, ["edges"])
