"""Queries of the checks, scores and records, over the star tables in these roles.

An order is a manuscript, its lines are sections; a part is a bibliographic
record, the part of a line a citation; a customer is a paper under review and
its orders are the reviews. SQL stands beside each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import lint, scholarly, scores
from foliate.plans.documents import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


CITED = """cited AS (SELECT l_orderkey % 200 AS paper_id, 'p' || l_partkey AS key FROM lineitem),
entries AS (SELECT p_partkey % 200 AS paper_id, p_partkey * 2 + d AS ord, CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 'p' || p_partkey END AS key,
  CASE WHEN p_size < 5 THEN ['author'] ELSE ['author', 'title'] END AS fields FROM part, (VALUES (0), (1)) v(d) WHERE d = 0 OR p_partkey % 20 = 0)"""


def cited(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("paper_id"), F.concat(F.lit("p"), "l_partkey").alias("key"))


def entries(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    copies = F.explode(F.when(F.col("p_partkey") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("d")
    rows = part.select("p_partkey", "p_size", copies)
    return rows.select(
        (F.col("p_partkey") % 200).alias("paper_id"), (F.col("p_partkey") * 2 + F.col("d")).alias("ord"),
        F.when(F.col("p_partkey") % 97 == 0, "").otherwise(F.concat(F.lit("p"), "p_partkey")).alias("key"),
        F.when(F.col("p_size") < 5, F.array(F.lit("author"))).otherwise(F.array(F.lit("author"), F.lit("title"))).alias("fields"),
    )


@query("lint_cross_check", f"""WITH {CITED}, c AS (SELECT DISTINCT * FROM cited), b AS (SELECT DISTINCT paper_id, key FROM entries WHERE key != '')
SELECT coalesce(c.paper_id, b.paper_id) AS paper_id, coalesce(string_agg(CASE WHEN b.key IS NULL THEN c.key END, ',' ORDER BY c.key), '') AS missing, coalesce(string_agg(CASE WHEN c.key IS NULL THEN b.key END, ',' ORDER BY b.key), '') AS uncited
FROM c FULL JOIN b ON c.paper_id = b.paper_id AND c.key = b.key GROUP BY 1""")
def lint_cross_check(spark, sf_dir):
    found = lint.cross_check(cited(spark, sf_dir), entries(spark, sf_dir), ["paper_id"])
    return found.select("paper_id", F.array_join("missing_in_bib", ",").alias("missing"), F.array_join("uncited_in_bib", ",").alias("uncited"))


@query("lint_duplicates", f"""WITH {CITED}, t AS (SELECT paper_id, key, list_sort(list(ord))[2] AS second FROM entries WHERE key != '' GROUP BY ALL HAVING count(*) > 1)
SELECT paper_id, string_agg(key, ',' ORDER BY second, key) AS duplicates FROM t GROUP BY paper_id""")
def lint_duplicates(spark, sf_dir):
    return lint.duplicates(entries(spark, sf_dir), ["paper_id"]).select("paper_id", F.array_join("duplicates", ",").alias("duplicates"))


@query("lint_malformed", f"""WITH {CITED} SELECT paper_id, ord, key, array_to_string(list_filter([CASE WHEN key = '' THEN 'key' END, CASE WHEN NOT list_contains(fields, 'title') THEN 'title' END], lambda x: x IS NOT NULL), ',') AS missing FROM entries WHERE key = '' OR NOT list_contains(fields, 'title')""")
def lint_malformed(spark, sf_dir):
    return lint.malformed(entries(spark, sf_dir)).select("paper_id", "ord", "key", F.array_join("missing", ",").alias("missing"))


@query("lint_counts", f"""WITH {CITED}, c AS (SELECT DISTINCT * FROM cited), b AS (SELECT DISTINCT paper_id, key FROM entries WHERE key != ''),
e AS (SELECT paper_id, count(*) AS entries, count(*) FILTER (WHERE key = '' OR NOT list_contains(fields, 'title')) AS malformed FROM entries GROUP BY 1),
k AS (SELECT paper_id, count(DISTINCT key) AS cited FROM cited GROUP BY 1),
d AS (SELECT paper_id, count(*) AS duplicates FROM (SELECT paper_id, key FROM entries WHERE key != '' GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
x AS (SELECT coalesce(c.paper_id, b.paper_id) AS paper_id, count(*) FILTER (WHERE b.key IS NULL) AS missing, count(*) FILTER (WHERE c.key IS NULL) AS uncited FROM c FULL JOIN b ON c.paper_id = b.paper_id AND c.key = b.key GROUP BY 1)
SELECT paper_id, coalesce(entries, 0) AS entries, coalesce(cited, 0) AS cited, coalesce(malformed, 0) AS malformed, coalesce(duplicates, 0) AS duplicates, coalesce(missing, 0) AS missing, coalesce(uncited, 0) AS uncited
FROM e FULL JOIN k USING (paper_id) LEFT JOIN d USING (paper_id) LEFT JOIN x USING (paper_id)""")
def lint_counts(spark, sf_dir):
    return lint.lint_counts(cited(spark, sf_dir), entries(spark, sf_dir), ["paper_id"])


# prose: a line as a sentence with citations in several forms
PROSE = "concat('Line ', l_linenumber, ' holds. See \\\\citep[p 2]{p', l_partkey, ', s', l_suppkey % 7, '}', case when l_linenumber % 3 = 0 then '; also \\\\cite{}' else '' end, '. ', case l_linenumber % 4 when 0 then '[Todo check] ' when 1 then '[cite: x] [CITE: y] ' else '' end, repeat('word ', cast(l_quantity as int)))"


def prose(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.selectExpr("l_orderkey as paper_id", "l_linenumber as ord", "concat('Part ', l_linenumber) as title", f"{PROSE} as draft", "cast(case when l_linenumber % 5 = 0 then null else 20 + l_linenumber * 5 end as int) as word_budget", "l_partkey", "l_suppkey")


PROSE_SQL = """prose AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, 'Part ' || l_linenumber AS title,
  'Line ' || l_linenumber || ' holds. See \\citep[p 2]{p' || l_partkey || ', s' || (l_suppkey % 7) || '}' || CASE WHEN l_linenumber % 3 = 0 THEN '; also \\cite{}' ELSE '' END || '. ' ||
  CASE l_linenumber % 4 WHEN 0 THEN '[Todo check] ' WHEN 1 THEN '[cite: x] [CITE: y] ' ELSE '' END || repeat('word ', CAST(l_quantity AS INTEGER)) AS draft,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE 20 + l_linenumber * 5 END AS word_budget, 'p' || l_partkey AS k1, 's' || (l_suppkey % 7) AS k2 FROM lineitem)"""


@query("extract_cite_keys", f"WITH {PROSE_SQL} SELECT paper_id, ord, array_to_string(list_sort([k1, k2]), ',') AS keys FROM prose")
def extract_cite_keys(spark, sf_dir):
    return prose(spark, sf_dir).select("paper_id", "ord", F.array_join(lint.cite_keys(F.col("draft")), ",").alias("keys"))


@query("claim_pairs", f"WITH {PROSE_SQL} SELECT paper_id, ord, 'See ' || CASE WHEN ord % 3 = 0 THEN '; also .' ELSE '.' END AS claim, unnest([k1, k2]) AS key FROM prose")
def claim_pairs(spark, sf_dir):
    from foliate.functions.text import cite_keys, claim_sentences, without_cites

    rows = prose(spark, sf_dir).select("paper_id", "ord", F.explode(claim_sentences(F.col("draft"))).alias("s"))
    return rows.select("paper_id", "ord", without_cites(F.col("s")).alias("claim"), F.explode(cite_keys(F.col("s"))).alias("key")).where("claim != ''")


@query("audit_words", f"""WITH {PROSE_SQL}, w AS (SELECT *, CAST(len(regexp_extract_all(draft, '\\S+')) AS BIGINT) AS words FROM prose)
SELECT paper_id, ord, title, words, CAST(word_budget AS INTEGER) AS word_budget, words - word_budget AS delta, coalesce(word_budget > 0 AND words < word_budget * 0.8, false) AS under_budget FROM w""")
def audit_words(spark, sf_dir):
    return lint.word_budgets(prose(spark, sf_dir))


@query("audit_placeholders", f"""WITH {PROSE_SQL}, c AS (SELECT paper_id, CAST(sum(len(regexp_extract_all(draft, '(?i)\\[todo[^\\]]*\\]'))) AS BIGINT) AS todo, CAST(sum(len(regexp_extract_all(draft, '(?i)\\[cite:[^\\]]*\\]'))) AS BIGINT) AS cite_markers, CAST(sum(len(regexp_extract_all(draft, '\\\\cite[a-z]*\\{{\\s*\\}}'))) AS BIGINT) AS empty_cite, count(*) FILTER (WHERE trim(draft) = '') AS empty_sections FROM prose GROUP BY 1)
SELECT *, todo + cite_markers + empty_cite + empty_sections AS total FROM c""")
def audit_placeholders(spark, sf_dir):
    return lint.placeholders(prose(spark, sf_dir))


def _audit_inputs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"))
    required = orders.select("paper_id", F.explode(F.array(*(F.lit(f" PART {i} ") for i in (1, 2, 9)))).alias("title")).where("not (title = ' PART 9 ' and paper_id % 2 = 0)")
    bibliography = prose(spark, sf_dir).where("l_partkey % 5 != 0").select("paper_id", F.concat(F.lit("p"), "l_partkey").alias("key"))
    counts = orders.selectExpr("paper_id", "paper_id % 12 as candidates", "paper_id % 12 - paper_id % 3 as verified")
    return required, bibliography, counts


@query("audit_rollup", f"""WITH {PROSE_SQL},
r AS (SELECT o_orderkey AS paper_id, unnest([1, 2, 9]) AS n FROM orders), req AS (SELECT * FROM r WHERE NOT (n = 9 AND paper_id % 2 = 0)),
m AS (SELECT req.paper_id, count(*) AS missing_sections FROM req ANTI JOIN prose ON prose.paper_id = req.paper_id AND prose.ord = req.n GROUP BY 1),
u AS (SELECT paper_id, count(*) FILTER (WHERE word_budget > 0 AND len(regexp_extract_all(draft, '\\S+')) < word_budget * 0.8) AS under_budget,
  CAST(sum(len(regexp_extract_all(draft, '(?i)\\[todo[^\\]]*\\]'))) AS BIGINT) + CAST(sum(len(regexp_extract_all(draft, '(?i)\\[cite:[^\\]]*\\]'))) AS BIGINT) + CAST(sum(len(regexp_extract_all(draft, '\\\\cite[a-z]*\\{{\\s*\\}}'))) AS BIGINT) AS placeholders FROM prose GROUP BY 1),
c AS (SELECT DISTINCT paper_id, unnest([k1, k2]) AS key FROM prose), b AS (SELECT DISTINCT paper_id, k1 AS key FROM prose WHERE CAST(substr(k1, 2) AS BIGINT) % 5 != 0),
l AS (SELECT paper_id, count(*) AS uncovered FROM c ANTI JOIN b USING (paper_id, key) GROUP BY 1),
k AS (SELECT o_orderkey AS paper_id, o_orderkey % 12 = 0 OR o_orderkey % 12 - o_orderkey % 3 >= ((o_orderkey % 12) * 9 + 9) // 10 AS meets FROM orders)
SELECT u.paper_id, placeholders, under_budget, coalesce(missing_sections, 0) AS missing_sections, coalesce(uncovered, 0) AS uncovered, meets,
  coalesce(missing_sections, 0) + under_budget + placeholders + coalesce(uncovered, 0) + CASE WHEN meets THEN 0 ELSE 1 END AS problems,
  coalesce(missing_sections, 0) + under_budget + placeholders + coalesce(uncovered, 0) + CASE WHEN meets THEN 0 ELSE 1 END = 0 AS passed
FROM u LEFT JOIN m USING (paper_id) LEFT JOIN l USING (paper_id) LEFT JOIN k USING (paper_id)""")
def audit_rollup(spark, sf_dir):
    return lint.audit(prose(spark, sf_dir), *_audit_inputs(spark, sf_dir))


@query("audit_missing", """WITH r AS (SELECT o_orderkey AS paper_id, unnest([1, 2, 9]) AS n FROM orders)
SELECT r.paper_id, ' PART ' || n || ' ' AS title FROM r ANTI JOIN lineitem ON l_orderkey = r.paper_id AND l_linenumber = n WHERE NOT (n = 9 AND r.paper_id % 2 = 0)""")
def audit_missing(spark, sf_dir):
    return lint.missing_titles(_audit_inputs(spark, sf_dir)[0], prose(spark, sf_dir)).select("paper_id", "title")


@query("plan_check", """WITH p AS (SELECT l_orderkey AS paper_id, l_linenumber AS n, l_partkey % 3 AS tasks, l_suppkey % 3 AS claims, l_partkey % 2 AS sources, l_suppkey % 2 AS hints, l_quantity AS q, l_linenumber % 2 = 0 AS research, l_partkey % 4 AS topics FROM lineitem),
c AS (SELECT paper_id, count(*) FILTER (WHERE tasks = 0) AS taskless, count(*) FILTER (WHERE claims = 0) AS claimless, count(*) FILTER (WHERE claims > 0 AND sources = 0 AND hints = 0) AS uncited_claim_sections,
  count(*) FILTER (WHERE CAST(q AS INTEGER) % 6 = 0) AS missing_budgets, count(*) FILTER (WHERE research AND topics = 0) AS unresolved_research, CAST(coalesce(sum(CASE WHEN CAST(q AS INTEGER) % 6 != 0 THEN CAST(q AS INTEGER) * 10 END), 0) AS BIGINT) AS budget_total FROM p GROUP BY 1),
m AS (SELECT o.o_orderkey AS paper_id, count(*) AS missing_plans FROM (SELECT o_orderkey, unnest(range(1, 5)) AS n FROM orders) o ANTI JOIN p ON p.paper_id = o.o_orderkey AND p.n = o.n GROUP BY 1)
SELECT c.*, coalesce(missing_plans, 0) AS missing_plans, CAST(o_orderkey % 4 * 400 AS BIGINT) AS word_target,
  CASE WHEN o_orderkey % 4 * 400 > 0 THEN abs(budget_total - o_orderkey % 4 * 400) <= 0.15 * (o_orderkey % 4 * 400) ELSE true END AS budget_ok
FROM c LEFT JOIN m USING (paper_id) JOIN orders ON o_orderkey = c.paper_id""")
def plan_check(spark, sf_dir):
    take = lambda expr: f"slice(array('a', 'b', 'c'), 1, cast({expr} as int))"
    plans = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as paper_id", "concat('S', l_linenumber) as title", f"{take('l_partkey % 3')} as tasks", f"{take('l_suppkey % 3')} as claims", f"{take('l_partkey % 2')} as sources",
        f"{take('l_suppkey % 2')} as citation_hints", "case when cast(l_quantity as int) % 6 = 0 then null else cast(l_quantity as int) * 10 end as word_budget", "l_linenumber % 2 = 0 as research_needed", f"{take('l_partkey % 4')} as research_topics",
    )
    orders = table(spark, sf_dir, "orders")
    outline = orders.selectExpr("o_orderkey as paper_id", "explode(sequence(1, 4)) as n").selectExpr("paper_id", "concat(' s', n) as title")
    return lint.plan_check(plans, outline, orders.selectExpr("o_orderkey as paper_id", "o_orderkey % 4 * 400 as word_target"))


@query("coverage_90", """WITH c AS (SELECT c_custkey, count(o_orderkey) AS candidates, count(*) FILTER (WHERE o_orderstatus != 'F') AS verified FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, candidates, CASE WHEN candidates > 0 THEN (candidates * 9 + 9) // 10 ELSE 0 END AS min_required, CASE WHEN candidates > 0 THEN verified / candidates ELSE 0.0 END AS ratio, candidates = 0 OR verified >= (candidates * 9 + 9) // 10 AS meets FROM c""")
def coverage_90(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    counted = both.groupBy("c_custkey").agg(F.count("o_orderkey").alias("candidates"), F.count_if(F.col("o_orderstatus") != "F").alias("verified"))
    return counted.select("c_custkey", "candidates", *lint.coverage(F.col("candidates"), F.col("verified")))


@query("grade_summary", """WITH g AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'minor' ELSE 'major' END AS s FROM orders),
c AS (SELECT o_custkey, count(*) FILTER (WHERE s = 'exact') AS exact, count(*) FILTER (WHERE s = 'minor') AS minor, count(*) FILTER (WHERE s = 'major') AS major, count(*) AS total FROM g GROUP BY 1)
SELECT *, (exact + minor) / total AS citation_integrity FROM c""")
def grade_summary(spark, sf_dir):
    graded = table(spark, sf_dir, "orders").selectExpr("o_custkey", "case o_orderstatus when 'F' then 'exact' when 'O' then 'minor' else 'major' end as severity")
    return scores.grade_summary(graded, ["o_custkey"])


VERDICT = "element_at(array('supported', 'partial', 'unsupported', 'contradicted', 'unknown', 'no_source'), cast(1 + l_partkey % 6 as int))"
VERDICT_SQL = "['supported', 'partial', 'unsupported', 'contradicted', 'unknown', 'no_source'][1 + l_partkey % 6]"


@query("support_integrity", f"""WITH v AS (SELECT l_orderkey AS paper_id, {VERDICT_SQL} AS v FROM lineitem)
SELECT paper_id, {", ".join(f"count(*) FILTER (WHERE v = '{x}') AS {x}" for x in scores.VERDICTS)},
  avg(CASE v WHEN 'supported' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 WHEN 'unsupported' THEN 0.0 WHEN 'contradicted' THEN 0.0 END) AS support_integrity FROM v GROUP BY 1""")
def support_integrity(spark, sf_dir):
    return scores.support_integrity(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as paper_id", f"{VERDICT} as verdict"), ["paper_id"])


@query("grounding_integrity", f"""WITH v AS (SELECT l_orderkey AS paper_id, {VERDICT_SQL} AS v, l_partkey, l_suppkey FROM lineitem),
a AS (SELECT paper_id, count(*) FILTER (WHERE l_partkey % 3 > 0) AS cited, count(*) FILTER (WHERE l_partkey % 3 = 1) AS missing, count(*) FILTER (WHERE l_suppkey % 2 = 0) AS claims, count(*) FILTER (WHERE l_suppkey % 4 = 0) AS supported,
  avg(CASE v WHEN 'supported' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 WHEN 'unsupported' THEN 0.0 WHEN 'contradicted' THEN 0.0 END) AS s FROM v GROUP BY 1),
b AS (SELECT *, CASE WHEN cited > 0 THEN (cited - missing) / cited END AS ci, CASE WHEN claims > 0 THEN supported / claims END AS cl FROM a)
SELECT paper_id, ci AS citation_integrity, cl AS claim_integrity, s AS support_integrity,
  round((coalesce(ci, 0) + coalesce(cl, 0) + coalesce(s, 0)) / nullif(CASE WHEN ci IS NULL THEN 0 ELSE 1 END + CASE WHEN cl IS NULL THEN 0 ELSE 1 END + CASE WHEN s IS NULL THEN 0 ELSE 1 END, 0), 9) AS grounding_integrity FROM b""")
def grounding_integrity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    support = scores.support_integrity(lines.selectExpr("l_orderkey as paper_id", f"{VERDICT} as verdict"), ["paper_id"]).select("paper_id", "support_integrity")
    counted = lines.groupBy(F.col("l_orderkey").alias("paper_id")).agg(
        F.count_if(F.col("l_partkey") % 3 > 0).alias("cited"), F.count_if(F.col("l_partkey") % 3 == 1).alias("missing"),
        F.count_if(F.col("l_suppkey") % 2 == 0).alias("claims"), F.count_if(F.col("l_suppkey") % 4 == 0).alias("supported"),
    )
    found = scores.grounding(counted.join(support, "paper_id"))
    return found.select("paper_id", "citation_integrity", "claim_integrity", "support_integrity", F.round("grounding_integrity", 9).alias("grounding_integrity"))


REVIEWS = "reviews AS (SELECT o_custkey AS paper_id, o_orderkey AS reviewer_ord, 1 + o_orderkey % 10 AS overall, 1 + o_orderkey % 4 AS clarity, 1 + o_orderkey % 5 AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 'Accept' ELSE 'Reject' END AS decision, o_orderkey % 11 = 0 AS concerns FROM orders)"


def reviews(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as paper_id", "o_orderkey as reviewer_ord", "1 + o_orderkey % 10 as overall", "1 + o_orderkey % 4 as clarity", "1 + o_orderkey % 5 as confidence",
        "case when o_orderkey % 3 = 0 then 'Accept' else 'Reject' end as decision", "o_orderkey % 11 = 0 as ethical_concerns", "array(concat('s', o_orderkey), concat('t', o_orderkey % 3)) as strengths",
    )


@query("meta_review", f"""WITH {REVIEWS} SELECT paper_id, count(*) AS reviewer_count, CAST(round_even(avg(overall), 0) AS INTEGER) AS overall, CAST(round_even(avg(clarity), 0) AS INTEGER) AS clarity, CAST(round_even(avg(confidence), 0) AS INTEGER) AS confidence,
  string_agg('s' || reviewer_ord || ',t' || (reviewer_ord % 3), ',' ORDER BY reviewer_ord) AS strengths, bool_or(concerns) AS ethical_concerns,
  CASE WHEN avg(overall) >= 6 OR count(*) FILTER (WHERE decision = 'Accept') > count(*) / 2 THEN 'Accept' ELSE 'Reject' END AS decision FROM reviews GROUP BY 1""")
def meta_review(spark, sf_dir):
    return scores.meta_review(reviews(spark, sf_dir), ["paper_id"]).withColumn("strengths", F.array_join("strengths", ","))


@query("review_robustness", f"""WITH {REVIEWS}, a AS (SELECT paper_id, count(*) AS reviewer_count, greatest(count(*) FILTER (WHERE decision = 'Accept'), count(*) FILTER (WHERE decision != 'Accept')) / count(*) AS a, stddev_pop(overall) AS s FROM reviews GROUP BY 1)
SELECT paper_id, reviewer_count, round(a, 3) AS agreement, round(s, 3) AS overall_std, CASE WHEN a >= 0.8 AND s <= 1.0 THEN 'solid' WHEN a < 0.6 OR s > 2.0 THEN 'split' ELSE 'borderline' END AS label FROM a""")
def review_robustness(spark, sf_dir):
    return scores.robustness(reviews(spark, sf_dir), ["paper_id"])


# Cases of the documents: words cite a dozen keys in two forms, the bibliography lacks a third of them, claims are judged by the words' places, some cases have no claims and some no citations.
def _cases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents").selectExpr("doc_id", "split(coalesce(text, ''), ' ') as w")
    cite = "case when i % 9 = 0 then concat('\\\\cite{k', (doc_id + i) % 13, '}') when i % 14 = 3 then concat('\\\\citep[see]{k', i % 13, ', k', (doc_id * i) % 12, '}') else w end"
    cases = documents.selectExpr(
        "doc_id as name", f"case when doc_id % 7 = 0 then 'None cited.' else array_join(transform(w, (w, i) -> {cite}), ' ') end as markdown",
        "array_join(transform(filter(sequence(0, 12), j -> (doc_id + j) % 3 != 0), j -> concat('@article{k', j, ', title={A {B} ', j, '}, year={2020}}')), '\\n') as bibtex", "case when doc_id % 12 = 6 then cast(doc_id % 10 / 10.0 as double) end as claim_integrity",
    )
    claims = documents.where("doc_id % 6 != 0").selectExpr("doc_id as name", "posexplode(w) as (i, w)").where("i % 5 = 0").selectExpr("name", "(name * i) % 4 != 0 as supported")
    return cases, claims


GROUNDING = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
t AS (SELECT doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN 'None cited.' ELSE array_to_string(list_transform(w, lambda x, n: CASE WHEN (n - 1) % 9 = 0 THEN '\\cite{k' || (doc_id + n - 1) % 13 || '}' WHEN (n - 1) % 14 = 3 THEN '\\citep[see]{k' || (n - 1) % 13 || ', k' || (doc_id * (n - 1)) % 12 || '}' ELSE x END), ' ') END AS markdown,
  array_to_string(list_transform(list_filter(range(0, 13), lambda j: (doc_id + j) % 3 != 0), lambda j: '@article{k' || j || ', title={A {B} ' || j || '}, year={2020}}'), chr(10)) AS bibtex, w FROM d),
k AS (SELECT DISTINCT name, unnest(list_transform(flatten(list_transform(regexp_extract_all(markdown, '\\cite[a-zA-Z]*\s*(?:\[[^\]]*\])*\s*\{([^}]*)\}', 1), lambda x: string_split(x, ','))), lambda x: trim(x))) AS key FROM t),
b AS (SELECT DISTINCT name, unnest(regexp_extract_all(bibtex, '@\w+\s*\{\s*([^,\s}]*)', 1)) AS key FROM t),
c AS (SELECT k.name, count(b.key) / count(*) AS cite_only FROM k LEFT JOIN b ON b.name = k.name AND b.key = k.key WHERE k.key != '' GROUP BY 1),
j AS (SELECT name, avg(CASE WHEN (name * i) % 4 != 0 THEN 1 ELSE 0 END) AS judged FROM (SELECT name, unnest(range(0, len(w))) AS i FROM t WHERE name % 6 != 0) WHERE i % 5 = 0 GROUP BY 1),
g AS (SELECT t.name, cite_only, coalesce(judged, CASE WHEN t.name % 12 = 6 THEN CAST(t.name % 10 / 10.0 AS DOUBLE) END) AS claim_only FROM t LEFT JOIN c ON c.name = t.name LEFT JOIN j ON j.name = t.name),
r AS (SELECT *, CASE WHEN cite_only IS NOT NULL AND claim_only IS NOT NULL THEN (cite_only + claim_only) / 2 ELSE coalesce(cite_only, claim_only) END AS unified FROM g)
"""


@query("grounding_cases", GROUNDING + "SELECT name, round(cite_only, 9) AS cite_only, round(claim_only, 9) AS claim_only, round(unified, 9) AS unified FROM r")
def grounding_cases(spark, sf_dir):
    return scores.ground_cases(*_cases(spark, sf_dir)).select("name", *(F.round(c, 9).alias(c) for c in ("cite_only", "claim_only", "unified")))


@query("benchmark_grounding", GROUNDING + """SELECT round(avg(cite_only), 9) AS mean_cite_only, round(avg(claim_only), 9) AS mean_claim_only, round(avg(unified), 9) AS mean_unified, round(avg(abs(cite_only - unified)), 3) AS mae_cite_only, round(avg(abs(claim_only - unified)), 3) AS mae_claim_only,
  count(*) FILTER (WHERE unified < 0.75 AND greatest(cite_only, claim_only) >= 0.9) AS false_confidence FROM r""")
def benchmark_grounding(spark, sf_dir):
    means = {f"mean_{c}": F.round(f"mean_{c}", 9) for c in ("cite_only", "claim_only", "unified")}
    return scores.benchmark(scores.ground_cases(*_cases(spark, sf_dir))).withColumns(means)


@query("verification_status", "SELECT l_orderkey AS paper_id, CASE WHEN bool_and(l_linestatus = 'F' AND l_discount < 0.09) THEN 'VERIFIED' ELSE 'NOT_VERIFIED' END AS status FROM lineitem GROUP BY 1")
def verification_status(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as paper_id", "l_linestatus = 'F' as made", "l_discount < 0.09 as supported")
    return scores.verification_status(claims, ["paper_id"])


@query("max_severity", "SELECT l_orderkey AS paper_id, count(*) AS findings, arg_max(['minor', 'major', 'critical'][1 + l_partkey % 3], l_partkey % 3) AS max_severity FROM lineitem GROUP BY 1")
def max_severity(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as paper_id", "element_at(array('minor', 'major', 'critical'), cast(1 + l_partkey % 3 as int)) as severity")
    return scores.worst_severity(found, ["paper_id"])


@query("comparison_report", """SELECT p_brand AS system, coalesce(max(CASE WHEN p_size % 5 = 0 THEN p_partkey END), 0) AS recall, coalesce(max(CASE WHEN p_size % 5 = 1 THEN p_partkey END), 0) AS speed FROM part GROUP BY 1""")
def comparison_report(spark, sf_dir):
    measured = table(spark, sf_dir, "part").selectExpr("p_brand as system", "case p_size % 5 when 0 then 'recall' when 1 then 'speed' end as metric", "p_partkey").groupBy("system", "metric").agg(F.max("p_partkey").alias("value"))
    return scores.comparison(measured, "system", "metric", "value", ["recall", "speed"])


RECORDS = """records AS (SELECT p_partkey AS ord, p_size % 20 AS grp, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'r' || (p_partkey % 50) END AS record_id, p_name AS title, p_brand AS venue,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE 2000 + p_size % 30 END AS year, CASE WHEN p_size % 3 = 0 THEN (2000 + p_partkey % 30) || '-0' || (1 + p_partkey % 9) || '-15' WHEN p_size % 3 = 1 THEN 'undated' END AS publication_date, p_type FROM part)"""


def records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as ord", "p_size % 20 as grp", "case when p_partkey % 9 = 0 then '' else concat('r', p_partkey % 50) end as record_id", "p_name as title", "p_brand as venue",
        "case when p_size % 7 = 0 then null else 2000 + p_size % 30 end as year", "case when p_size % 3 = 0 then concat(2000 + p_partkey % 30, '-0', 1 + p_partkey % 9, '-15') when p_size % 3 = 1 then 'undated' end as publication_date", "p_type",
    )


VALID = "CASE WHEN try_strptime(publication_date, '%Y-%m-%d') IS NOT NULL THEN try_strptime(publication_date, '%Y-%m-%d') < DATE '2017-06-01' WHEN year IS NOT NULL THEN year <= 2017 ELSE true END"


@query("recency_gate", f"WITH {RECORDS} SELECT ord, {VALID} AS valid FROM records")
def recency_gate(spark, sf_dir):
    return records(spark, sf_dir).select("ord", scholarly.date_valid(F.col("publication_date"), F.col("year"), "2017-06").alias("valid"))


@query("dedupe_citations", f"WITH {RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY grp, record_id ORDER BY ord) AS i FROM records) SELECT grp, ord, record_id FROM n WHERE i = 1 OR record_id = ''")
def dedupe_citations(spark, sf_dir):
    return scholarly.dedupe(records(spark, sf_dir), ["grp"]).select("grp", "ord", "record_id")


@query("discover_dedupe", f"""WITH {RECORDS}, v AS (SELECT *, row_number() OVER (PARTITION BY grp, lower(trim(regexp_replace(split_part(title, ' ', 1), '\\s+', ' ', 'g'))) ORDER BY ord) AS i FROM records WHERE {VALID}),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS rank FROM v WHERE i = 1) SELECT grp, ord, split_part(title, ' ', 1) AS title, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 6""")
def discover_dedupe(spark, sf_dir):
    short = records(spark, sf_dir).withColumn("title", F.split_part("title", F.lit(" "), F.lit(1)))
    return scholarly.discover(short, ["grp"], 6, "2017-06").select("grp", "ord", "title", "rank")


@query("rank_ties", f"""WITH {RECORDS} SELECT grp, ord, CAST(row_number() OVER (PARTITION BY grp ORDER BY ord % 4 DESC, coalesce(year, 9999), ord) AS INTEGER) AS rank FROM records""")
def rank_ties(spark, sf_dir):
    rows = records(spark, sf_dir).withColumns({"ref_id": F.col("grp"), "rec_ord": F.col("ord")})
    return scholarly.ranked(rows, F.col("ord") % 4).select("grp", "ord", "rank")


KEYED = f"""WITH {RECORDS}, w AS (SELECT *, list_filter(string_split(lower(title), ' '), lambda x: x != '' AND NOT list_contains([{", ".join(f"'{s}'" for s in scholarly.STOPWORDS)}], x)) AS ws FROM records),
keyed AS (SELECT *, CASE WHEN ord % 13 = 0 THEN 'anon' ELSE lower(replace(regexp_replace(venue, '[^A-Za-z0-9]', '', 'g'), ' ', '')) END || coalesce(CAST(year AS VARCHAR), 'nd') || array_to_string(list_transform(ws[1:2], lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), '') AS key FROM w)"""


def keyed(spark, sf_dir) -> DataFrame:
    authors = F.when(F.col("ord") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Ann "), F.regexp_replace("venue", "[^A-Za-z0-9]", ""))))
    return records(spark, sf_dir).withColumn("authors", authors).withColumn("citation_key", scholarly.mint_key(F.col("authors"), F.col("year"), F.col("title")))


@query("mint_keys", KEYED + "SELECT ord, key AS citation_key FROM keyed")
def mint_keys(spark, sf_dir):
    return keyed(spark, sf_dir).select("ord", "citation_key")


@query("key_suffix", f"""WITH {RECORDS}, k AS (SELECT ord, grp, 'k' || (ord % 40) AS key FROM records), n AS (SELECT *, count(*) OVER (PARTITION BY grp, key) AS n, row_number() OVER (PARTITION BY grp, key ORDER BY ord) AS i FROM k)
SELECT grp, ord, CASE WHEN n > 1 THEN key || chr(CAST(96 + i AS INTEGER)) ELSE key END AS citation_key FROM n""")
def key_suffix(spark, sf_dir):
    rows = records(spark, sf_dir).select("grp", "ord", F.concat(F.lit("k"), F.col("ord") % 40).alias("citation_key"))
    return scholarly.suffix_keys(rows, ["grp"])


@query("bibtex_render", KEYED + """, b AS (SELECT *, CASE WHEN ord % 4 = 0 THEN venue END AS journal, CASE WHEN ord % 4 = 1 THEN '1706.0' || ord END AS arxiv, CASE WHEN ord % 4 = 3 THEN '' ELSE venue END AS v FROM keyed)
SELECT ord, '@' || CASE ord % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'misc' WHEN 2 THEN 'inproceedings' ELSE 'misc' END || '{' || key || ',' || chr(10) || array_to_string(list_filter([
  CASE WHEN ord % 13 != 0 THEN '  author = {Ann ' || regexp_replace(venue, '[^A-Za-z0-9]', '', 'g') || '}' END, '  title = {' || title || '}', '  journal = {' || journal || '}', CASE WHEN ord % 4 = 2 THEN '  booktitle = {' || v || '}' END,
  '  year = {' || year || '}', '  eprint = {' || arxiv || '}', CASE WHEN ord % 4 = 1 THEN '  archivePrefix = {arXiv}' END, CASE WHEN ord % 4 = 3 THEN '  note = {venue not reported by the scholarly backend}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}' AS bibtex FROM b""")
def bibtex_render(spark, sf_dir):
    rows = keyed(spark, sf_dir).selectExpr("*", "case when ord % 4 = 0 then venue end as journal", "case when ord % 4 = 1 then concat('1706.0', ord) end as arxiv", "case when ord % 4 = 3 then '' else venue end as v")
    c = F.col
    return rows.select("ord", scholarly.bibtex(c("citation_key"), c("authors"), c("title"), c("year"), c("v"), c("journal"), c("arxiv")).alias("bibtex"))


def _matches(spark, sf_dir):
    """References are part names cut short; a search returns the parts of the same size and brand."""
    part = table(spark, sf_dir, "part").withColumn("search_key", F.concat_ws("/", "p_brand", "p_size"))
    references = part.where("p_partkey % 4 = 0").selectExpr("p_partkey as ref_id", "search_key", "left(p_name, length(p_name) - cast(p_partkey % 16 as int)) as query_title", "case when p_partkey % 8 = 0 then 2000 + p_size % 30 end as year_hint")
    found = part.selectExpr("search_key", "p_partkey as rec_ord", "p_name as title", "case when p_partkey % 5 = 0 then 1990 else 2000 + p_size % 30 end as year", "case when p_partkey % 11 = 0 then '' else 'text' end as abstract", "cast(null as string) as publication_date")
    return references, found


@query("fuzzy_best_match")
def fuzzy_best_match(spark, sf_dir):
    return scholarly.match(*_matches(spark, sf_dir)).select("ref_id", "query_title", "title", "year", "points")


@query("grade_reference")
def grade_reference(spark, sf_dir):
    return scholarly.match_grade(*_matches(spark, sf_dir))


LETTERS = "list_transform(range(0, 32), lambda b: len(list_filter(string_split(lower({x}), ''), lambda c: c != '' AND ascii(c) % 32 = b)))"


@query("fuzzy_bounds", f"""WITH p AS (SELECT *, p_brand || '/' || p_size AS k FROM part), a AS (SELECT k, p_partkey AS ref_id, left(p_name, CAST(greatest(0, length(p_name) - p_partkey % 16) AS BIGINT)) AS t, CASE WHEN p_partkey % 8 = 0 THEN 2000 + p_size % 30 END AS hint FROM p WHERE p_partkey % 4 = 0),
b AS (SELECT k, p_partkey AS rec_ord, p_name AS t, CASE WHEN p_partkey % 5 = 0 THEN 1990 ELSE 2000 + p_size % 30 END AS year FROM p WHERE p_name != ''),
al AS (SELECT *, {LETTERS.format(x="t")} AS l FROM a), bl AS (SELECT *, {LETTERS.format(x="t")} AS l FROM b),
j AS (SELECT ref_id, round_even(200.0 * list_sum(list_transform(range(1, 33), lambda i: least(al.l[i], bl.l[i]))) / (length(al.t) + length(bl.t)), 0) AS bound, coalesce(year = hint, false) AS same FROM al JOIN bl USING (k))
SELECT ref_id, count(*) AS found, count(*) FILTER (WHERE bound + CASE WHEN same THEN 10 ELSE 0 END > 70) AS compared, CAST(max(bound) AS INTEGER) AS best_bound FROM j GROUP BY 1""")
def fuzzy_bounds(spark, sf_dir):
    """Of the records found for a reference, those whose titles must be compared."""
    return scholarly.bound_counts(*_matches(spark, sf_dir))
