"""Checks of manuscripts: citations against bibliographies, drafts against budgets, plans against outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import cite_keys, strip, word_count
from foliate.storage import spread

#: A draft below this share of its budget is short; a plan's budgets may be off by this share of the target.
SHORT_OF_BUDGET, BUDGET_TOLERANCE = 0.8, 0.15
# Open places in a draft.
TODO, CITE_MARKER, EMPTY_CITE = r"(?i)\[TODO[^\]]*\]", r"(?i)\[CITE:[^\]]*\]", r"\\cite[a-zA-Z]*\s*(?:\[[^\]]*\])*\s*\{\s*\}"


def cross_check(cited: DataFrame, bibliography: DataFrame, by: list[str]) -> DataFrame:
    """A row a group with the sorted keys that are cited but not listed, and listed but not cited."""
    c = cited.select(*by, "key").where("key != ''").distinct().withColumn("_c", F.lit(True))
    b = bibliography.select(*by, "key").where("key != ''").distinct().withColumn("_b", F.lit(True))
    both = c.join(b, [*by, "key"], "full_outer")
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("key"))))
    return both.groupBy(*by).agg(pick(F.col("_b").isNull()).alias("missing_in_bib"), pick(F.col("_c").isNull()).alias("uncited_in_bib"))


def duplicates(entries: DataFrame, by: list[str]) -> DataFrame:
    """Keys of several entries of a group, in the order of their second entries. Empty keys do not count."""
    places = F.array_sort(F.collect_list("ord"))
    many = entries.where("key != ''").groupBy(*by, "key").agg(places.alias("_p")).where(F.size("_p") > 1)
    return many.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.get("_p", F.lit(1)).alias("at"), "key"))), lambda x: x["key"]).alias("duplicates"))


def malformed(entries: DataFrame) -> DataFrame:
    """Entries without a key or without a title among their fields, with what is missing."""
    missing = F.array_compact(F.array(F.when(F.coalesce("key", F.lit("")) == "", "key"), F.when(~F.array_contains("fields", "title"), "title")))
    return entries.withColumn("missing", missing).where(F.size("missing") > 0)


def lint_counts(cited: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries, cited keys, malformed entries, duplicate, missing and uncited keys of each group."""
    c = cited.select(*by, "key").where("key != ''").distinct().withColumn("_c", F.lit(True))
    b = entries.select(*by, "key").where("key != ''").distinct().withColumn("_b", F.lit(True))
    checked = c.join(b, [*by, "key"], "full_outer").groupBy(*by).agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_c").isNull()).alias("uncited"))
    listed = entries.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"))
    keys = cited.where("key != ''").groupBy(*by).agg(F.count_distinct("key").alias("cited"))
    bad = malformed(entries).groupBy(*by).agg(F.count(F.lit(1)).alias("malformed"))
    twice = duplicates(entries, by).select(*by, F.size("duplicates").cast("long").alias("duplicates"))
    out = listed.join(keys, by, "full_outer").join(bad, by, "left").join(twice, by, "left").join(checked, by, "left")
    return out.na.fill(0, ["entries", "cited", "malformed", "duplicates", "missing", "uncited"])


def word_budgets(sections: DataFrame) -> DataFrame:
    """Sections with words, delta to the budget, and whether they are short of it."""
    words = word_count(F.col("draft"))
    return sections.select(
        "paper_id", "ord", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Section")).alias("title"), words.cast("long").alias("words"), "word_budget",
        (words - F.col("word_budget")).cast("long").alias("delta"),
        F.coalesce((F.col("word_budget") > 0) & (words < F.col("word_budget") * F.lit(SHORT_OF_BUDGET)), F.lit(False)).alias("under_budget"),
    )


def placeholders(sections: DataFrame, *more: Column) -> DataFrame:
    """Open places of each manuscript: todo notes, citation markers, empty citations, empty sections, and all of them; with ``more`` in the same pass."""
    # a text without the sign that a pattern begins with needs no search
    text = F.coalesce("draft", F.lit(""))
    count = lambda p, sign: F.sum(F.when(F.contains(text, F.lit(sign)), F.regexp_count(text, F.lit(p))).otherwise(0)).cast("long")
    empty = F.count_if(~text.rlike(r"\S"))
    found = sections.groupBy("paper_id").agg(count(TODO, "[").alias("todo"), count(CITE_MARKER, "[").alias("cite_markers"), count(EMPTY_CITE, "\\cite").alias("empty_cite"), empty.alias("empty_sections"), *more)
    return found.withColumn("total", F.col("todo") + F.col("cite_markers") + F.col("empty_cite") + F.col("empty_sections"))


def missing_titles(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required rows without a present title of their paper, blanks and case aside.

    Repeated titles stay, since finding them would take a table of all titles
    in memory; both sides are dealt over all tasks, though they are small.
    """
    key = F.lower(strip(F.col("title"))).alias("_t")
    have = spread(present.select("paper_id", F.lower(strip(F.coalesce("title", F.lit("")))).alias("_t")), "paper_id", "_t")
    return spread(required.select("*", key), "paper_id", "_t").join(have, ["paper_id", "_t"], "left_anti").drop("_t")


def coverage(candidates: Column, verified: Column) -> list[Column]:
    """Least count for nine tenths of the candidates, the ratio, and whether it is met; vacuously without candidates."""
    least = F.floor((candidates * 9 + 9) / 10).cast("long")
    return [
        F.when(candidates > 0, least).otherwise(0).cast("long").alias("min_required"),
        F.when(candidates > 0, verified / candidates).otherwise(0.0).alias("ratio"),
        ((candidates == 0) | (verified >= least)).alias("meets"),
    ]


def uncovered(cited: DataFrame, bibliography: DataFrame, by: list[str]) -> DataFrame:
    """Cited keys that the group's bibliography lacks: all of them where it is empty."""
    return cited.where("key != ''").select(*by, "key").distinct().join(bibliography.where("key != ''").select(*by, "key").distinct(), [*by, "key"], "left_anti")


def audit(sections: DataFrame, required: DataFrame, bibliography: DataFrame, counts: DataFrame) -> DataFrame:
    """A row a manuscript: each kind of problem, all together, and whether it passes.

    ``counts`` has paper_id, candidates and verified.
    """
    missing = missing_titles(required, sections).groupBy("paper_id").agg(F.count(F.lit(1)).alias("missing_sections"))
    under = F.count_if(F.when(F.col("word_budget") > 0, word_count(F.col("draft")) < F.col("word_budget") * F.lit(SHORT_OF_BUDGET)))
    cited = sections.select("paper_id", F.explode(cite_keys(F.coalesce("draft", F.lit("")))).alias("key"))
    lacking = uncovered(cited, bibliography, ["paper_id"]).groupBy("paper_id").agg(F.count(F.lit(1)).alias("uncovered"))
    met = counts.select("paper_id", coverage(F.col("candidates"), F.col("verified"))[2])
    found = placeholders(sections, under.alias("under_budget")).select("paper_id", F.col("total").alias("placeholders"), "under_budget")
    out = found.join(missing, "paper_id", "left").join(lacking, "paper_id", "left").join(met, "paper_id", "left")
    out = out.na.fill(0, ["missing_sections", "uncovered"]).withColumn("meets", F.coalesce("meets", F.lit(True)))
    problems = F.col("missing_sections") + F.col("under_budget") + F.col("placeholders") + F.col("uncovered") + F.when(F.col("meets"), 0).otherwise(1)
    return out.withColumn("problems", problems.cast("long")).withColumn("passed", F.col("problems") == 0)


def plan_check(plans: DataFrame, outline: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a paper: sections without plan, tasks, claims, evidence, budget or topics; the budgets' total and whether it is near the target."""
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    evidence = has("sources") | has("citation_hints")
    budget = F.when(F.col("word_budget") > 0, F.col("word_budget"))
    checked = plans.groupBy("paper_id").agg(
        F.count_if(~has("tasks")).alias("taskless"),
        F.count_if(~has("claims")).alias("claimless"),
        F.count_if(has("claims") & ~evidence).alias("uncited_claim_sections"),
        F.count_if(budget.isNull()).alias("missing_budgets"),
        F.count_if(F.coalesce("research_needed", F.lit(False)) & ~has("research_topics")).alias("unresolved_research"),
        F.coalesce(F.sum(budget), F.lit(0)).cast("long").alias("budget_total"),
    )
    missing = missing_titles(outline.where("title != ''"), plans.where("title != ''")).groupBy("paper_id").agg(F.count(F.lit(1)).alias("missing_plans"))
    out = checked.join(missing, "paper_id", "left").join(targets.select("paper_id", "word_target"), "paper_id", "left").na.fill(0, ["missing_plans"])
    near = F.abs(F.col("budget_total") - F.col("word_target")) <= F.lit(BUDGET_TOLERANCE) * F.col("word_target")
    return out.withColumn("budget_ok", F.when(F.col("word_target") > 0, near).otherwise(True))

