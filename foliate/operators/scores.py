"""Scores rolled up from verdicts, grades and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import cite_keys
from foliate.operators import bibtex

# Credit of a verdict; what is not here was not judged. Bounds of the review axes.
CREDIT = {"supported": 1.0, "partial": 0.5, "unsupported": 0.0, "contradicted": 0.0}
VERDICTS = ("supported", "partial", "unsupported", "contradicted", "unknown", "no_source")
AXES = {"originality": (1, 4), "quality": (1, 4), "clarity": (1, 4), "significance": (1, 4), "soundness": (1, 4), "presentation": (1, 4), "contribution": (1, 4), "overall": (1, 10), "confidence": (1, 5)}
ACCEPT_AT = 6


def grade_summary(graded: DataFrame, by: list[str]) -> DataFrame:
    """Grades by severity, and the share that is a real record; 1 without any."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("exact", "minor", "major")]
    out = graded.groupBy(*by).agg(*counts, F.count("severity").alias("total"))
    return out.withColumn("citation_integrity", F.when(F.col("total") > 0, (F.col("exact") + F.col("minor")) / F.col("total")).otherwise(1.0))


def support_integrity(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Verdicts by kind, and the mean credit of those that were judged; null if none was."""
    credit: Column = F.lit(None).cast("double")
    for verdict, value in CREDIT.items():
        credit = F.when(F.col("verdict") == verdict, value).otherwise(credit)
    return verdicts.groupBy(*by).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS), F.avg(credit).alias("support_integrity"))


def grounding(parts: DataFrame) -> DataFrame:
    """The mean of what there is of citation and claim integrity.

    Citations count only where some are cited, claims where there are some;
    ``parts`` has cited, missing, claims, supported and support_integrity.
    """
    citation = F.when(F.col("cited") > 0, (F.col("cited") - F.col("missing")) / F.col("cited"))
    claim = F.when(F.col("claims") > 0, F.col("supported") / F.col("claims"))
    known = F.array_compact(F.array(citation, claim, F.col("support_integrity")))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return parts.withColumns({"citation_integrity": citation, "claim_integrity": claim, "grounding_integrity": mean})


def meta_review(reviews: DataFrame, by: list[str]) -> DataFrame:
    """One review of all: means rounded half to even and clamped, lists one after another, concerns if one has them.

    Accept from a mean overall of ACCEPT_AT, or by a strict majority.
    """
    axes = [a for a in AXES if a in reviews.columns]
    means = [F.least(F.greatest(F.bround(F.avg(a)).cast("int"), F.lit(AXES[a][0])), F.lit(AXES[a][1])).alias(a) for a in axes]
    lists = [c for c in ("strengths", "weaknesses", "questions", "limitations") if c in reviews.columns]
    ordered = lambda c: F.array_sort(F.collect_list(F.struct("reviewer_ord", F.col(c).alias("v"))))
    joined = [F.flatten(F.transform(ordered(c), lambda x: x["v"])).alias(c) for c in lists]
    votes = F.count_if(F.col("decision") == "Accept")
    accept = (F.avg("overall") >= ACCEPT_AT) | (votes > F.count(F.lit(1)) / 2)
    concerns = [F.bool_or("ethical_concerns").alias("ethical_concerns")] if "ethical_concerns" in reviews.columns else []
    return reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("reviewer_count"), *means, *joined, *concerns, F.when(accept, "Accept").otherwise("Reject").alias("decision"))


def robustness(reviews: DataFrame, by: list[str]) -> DataFrame:
    """How far the reviewers agree: solid, borderline or split."""
    n, yes = F.count(F.lit(1)), F.count_if(F.col("decision") == "Accept")
    # from sums of whole numbers, so that a deviation on a limit is not moved over it by the order of rows
    x, m = F.col("overall").cast("long"), F.count("overall")
    spread = F.sqrt((m * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double")) / m
    out = reviews.groupBy(*by).agg(n.alias("reviewer_count"), (F.greatest(yes, n - yes) / n).alias("_a"), F.coalesce(F.when(m > 0, spread), F.lit(0.0)).alias("_s"))
    label = F.when((F.col("_a") >= 0.8) & (F.col("_s") <= 1.0), "solid").when((F.col("_a") < 0.6) | (F.col("_s") > 2.0), "split").otherwise("borderline")
    return out.select(*by, "reviewer_count", F.round("_a", 3).alias("agreement"), F.round("_s", 3).alias("overall_std"), label.alias("label"))


def ground_cases(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """(name, cite_only, claim_only, unified) of cases (name, markdown, bibtex, claim_integrity) and their judged claims (name, supported).

    Citations count where some are cited: the share of cited keys that the
    bibliography has. Claims count by the share that is supported; a case
    without claims has its own figure, or none. Unified is the mean of what there is.
    """
    cited = cases.select("name", F.explode(cite_keys(F.col("markdown"))).alias("key"))
    known = bibtex.parse(cases, ["name"]).select("name", "key").distinct().withColumn("_known", F.lit(True))
    shares = cited.join(known, ["name", "key"], "left").groupBy("name").agg((F.count("_known") / F.count(F.lit(1))).alias("cite_only"))
    judged = claims.groupBy("name").agg(F.avg(F.col("supported").cast("int")).alias("_judged"))
    both = cases.select("name", "claim_integrity").join(shares, "name", "left").join(judged, "name", "left")
    both = both.select("name", "cite_only", F.coalesce("_judged", "claim_integrity").alias("claim_only"))
    parts = F.array_compact(F.array("cite_only", "claim_only"))
    return both.withColumn("unified", F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)))


def benchmark(rows: DataFrame) -> DataFrame:
    """Means of the three scores, how far each slice is from the unified one on average, and cases of false confidence."""
    far = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col("unified"))), 3)
    return rows.agg(
        *(F.avg(c).alias(f"mean_{c}") for c in ("cite_only", "claim_only", "unified")),
        far("cite_only").alias("mae_cite_only"),
        far("claim_only").alias("mae_claim_only"),
        F.count_if((F.col("unified") < 0.75) & (F.greatest("cite_only", "claim_only") >= 0.9)).alias("false_confidence"),
    )


def verification_status(claims: DataFrame, by: list[str]) -> DataFrame:
    """VERIFIED if there are claims and all are made and supported."""
    good = F.bool_and(F.coalesce("made", F.lit(False)) & F.coalesce("supported", F.lit(False)))
    return claims.groupBy(*by).agg(F.when(F.coalesce(good, F.lit(False)), "VERIFIED").otherwise("NOT_VERIFIED").alias("status"))


def worst_severity(findings: DataFrame, by: list[str]) -> DataFrame:
    """The worst of critical, major and minor findings of each group."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "major", 2).when(F.col("severity") == "minor", 1)
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("findings"), F.max_by("severity", rank).alias("max_severity"))


def comparison(measures: DataFrame, systems: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """A row a system, a column a metric; 0 where nothing was measured."""
    return measures.groupBy(systems).pivot(metric, metrics).agg(F.first(value)).na.fill(0)
