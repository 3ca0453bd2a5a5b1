"""Queries over the text tables: retrieval, sections, rendering, metrics. SQL stands beside each.

Their markdown is made of ``documents`` by one rule in both engines: of the
lines of a document, some become numbered headers of varying depth, the others
end in a bracketed citation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.operators import blocks, markdown, retrieval

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
QUESTION = {"q1": "the theorem of the nation", "q2": "de la para que"}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = blocks.to_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    header = "concat(repeat('#', cast(1 + (paper_id * 5 + line_no * 7 + line_no * line_no) % 4 as int)), ' ', line_no, '.', (paper_id + line_no) % 4, ' Part ', (paper_id * 3 + line_no) % 6)"
    plain = "concat(line, ' [', 1 + (paper_id + line_no) % 30, ']')"
    return raw.selectExpr("paper_id", "line_no", f"case when (paper_id + line_no * line_no) % 3 = 0 then {header} else {plain} end as line")


MD = """
raw AS (SELECT doc_id AS paper_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM documents),
md AS (SELECT paper_id, line_no, CASE WHEN (paper_id + line_no * line_no) % 3 = 0
  THEN repeat('#', CAST(1 + (paper_id * 5 + line_no * 7 + line_no * line_no) % 4 AS INTEGER)) || ' ' || line_no || '.' || ((paper_id + line_no) % 4) || ' Part ' || ((paper_id * 3 + line_no) % 6)
  ELSE line || ' [' || (1 + (paper_id + line_no) % 30) || ']' END AS line FROM raw)
"""
SECTIONS = f"""
WITH {MD},
h AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s+(.*?)\\s*$', 1)) AS level,
  regexp_replace(regexp_extract(line, '^(#{{1,6}})\\s+(.*?)\\s*$', 2), '^(?:\\d+(?:\\.\\d+)*|[IVXLCDM]+)\\.?\\s+', '') AS title FROM md),
w AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY line_no) AS ord,
  {", ".join(f"last_value(CASE WHEN level = {k} THEN line_no END IGNORE NULLS) OVER b AS l{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER b AS t{k}" for k in range(1, 6))}
  FROM h WINDOW b AS (PARTITION BY paper_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, concat_ws(' > ', {", ".join(f"CASE WHEN level > {k} AND l{k} > greatest(0, {', '.join(f'coalesce(l{j}, 0)' for j in range(1, k)) or '0'}) THEN t{k} END" for k in range(1, 6))}, title) AS path FROM w WHERE ord > 0),
sections AS (SELECT paper_id, CAST(ord AS BIGINT) AS ord, max(CASE WHEN level > 0 THEN level END) AS level, max(CASE WHEN level > 0 THEN title END) AS title,
  max(CASE WHEN level > 0 THEN path END) AS section_path, max(CASE WHEN level > 0 THEN line_no END) AS start_line,
  regexp_replace(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY line_no), ''), '^\\s+|\\s+$', '', 'g') AS text
  FROM p GROUP BY paper_id, ord)
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.build_sections(md_lines(spark, sf_dir))


@query("build_sections", SECTIONS + "SELECT paper_id, ord, CAST(level AS INTEGER) AS level, title, section_path, start_line, text FROM sections")
def build_sections(spark, sf_dir):
    return sections(spark, sf_dir)


SHORT = "CASE WHEN length(t) <= 280 THEN t ELSE regexp_replace(left(t, 279), '\\s+$', '') || '…' END"
SLUG = "regexp_replace(regexp_replace(lower(section_path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def section_blocks(spark, sf_dir) -> DataFrame:
    empty = {c: F.lit(None).cast("string") for c in ("caption", "language")}
    return sections(spark, sf_dir).withColumns({"kind": F.lit("section"), "number": F.lit(0), **empty})


@query("render_summary", SECTIONS + f""", s AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM sections)
SELECT paper_id, ord, 'section:' || {SLUG} AS block_id, regexp_replace('## ' || section_path || chr(10) || {SHORT}, '\\s+$', '') AS summary,
  '[section:' || {SLUG} || '] ' || section_path AS ref FROM s""")
def render_summary(spark, sf_dir):
    ident = blocks.block_id(F.col("kind"), F.col("section_path"), F.col("number"))
    return section_blocks(spark, sf_dir).select("paper_id", "ord", ident.alias("block_id"), blocks.render("summary").alias("summary"), blocks.render("ref").alias("ref"))


@query("select_prefix_cap", SECTIONS + """, k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS n FROM sections WHERE starts_with(section_path, 'Part 1'))
SELECT paper_id, ord, section_path FROM k WHERE n <= 2""")
def select_prefix_cap(spark, sf_dir):
    return blocks.select(section_blocks(spark, sf_dir), kinds=["section"], prefix="Part 1", most=2).select("paper_id", "ord", "section_path")


@query("split_h2", f"""WITH {MD}, m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^##\\s+[^#]') THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY line_no) AS ord FROM md)
SELECT paper_id, CAST(ord AS BIGINT) AS ord, trim(max(CASE WHEN regexp_matches(line, '^##\\s+[^#]') THEN regexp_replace(line, '^##\\s+', '') END)) AS title,
  regexp_replace(coalesce(string_agg(CASE WHEN NOT regexp_matches(line, '^##\\s+[^#]') THEN line END, chr(10) ORDER BY line_no), ''), '^\\s+|\\s+$', '', 'g') AS draft
FROM m WHERE ord > 0 GROUP BY paper_id, ord""")
def split_h2(spark, sf_dir):
    return blocks.split_level(md_lines(spark, sf_dir), 2)


def paragraphs(spark, sf_dir) -> DataFrame:
    rows = blocks.to_lines(table(spark, sf_dir, "documents"), "doc_id", "text").where("line != ''")
    path = F.concat_ws(" > ", F.col("paper_id").cast("string"), F.col("line_no").cast("string"))
    rows = rows.withColumn("section_path", path)
    return rows.select("paper_id", F.concat(F.lit("section:"), F.col("paper_id"), F.lit("-"), F.col("line_no")).alias("block_id"), F.concat(F.lit("## "), "section_path", F.lit("\n"), "line").alias("context"))


def _terms(text: str) -> str:
    terms = retrieval.query_terms({"q": text})["q"]
    return ", ".join(f"('{w}', {n})" for w, n in terms.items())


TOPK = """
WITH blocks AS (SELECT doc_id AS paper_id, 'section:' || doc_id || '-' || no AS block_id, '## ' || doc_id || ' > ' || no || chr(10) || line AS context
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) WHERE line != ''),
tf AS (SELECT block_id, t, count(*) AS n FROM (SELECT block_id, unnest(regexp_extract_all(lower(context), '[a-z0-9]+')) AS t FROM blocks) GROUP BY ALL),
q(query_id, t, n) AS (VALUES {values}),
qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM q GROUP BY query_id),
bn AS (SELECT block_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM tf GROUP BY block_id),
d AS (SELECT block_id, query_id, sum(tf.n * q.n) AS dot FROM tf JOIN q USING (t) GROUP BY ALL),
s AS (SELECT b.paper_id, b.block_id, qn.query_id, round(coalesce(dot / (bn.norm * qn.norm), 0.0), 6) AS score
  FROM blocks b CROSS JOIN qn LEFT JOIN bn ON bn.block_id = b.block_id LEFT JOIN d ON d.block_id = b.block_id AND d.query_id = qn.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) AS rank FROM s)
"""


def _values(queries: dict[str, str]) -> str:
    return ", ".join(f"('{name}', '{w}', {n})" for name, terms in retrieval.query_terms(queries).items() for w, n in terms.items())


@query("topk_tf_cosine", TOPK.replace("{values}", _values(QUESTION)) + "SELECT query_id, paper_id, block_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def topk_tf_cosine(spark, sf_dir):
    scored = retrieval.tf_cosine(paragraphs(spark, sf_dir), QUESTION)
    return retrieval.top_k(scored, 5, ["query_id"]).select("query_id", "paper_id", "block_id", "score", "rank")


ZERO = {"none": "zzqx"}


@query("topk_zero_scores", TOPK.replace("{values}", _values(ZERO)) + "SELECT query_id, block_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def topk_zero_scores(spark, sf_dir):
    return retrieval.top_k(retrieval.tf_cosine(paragraphs(spark, sf_dir), ZERO), 20, ["query_id"]).select("query_id", "block_id", "score", "rank")


@query("ask_context", TOPK.replace("{values}", _values(QUESTION)) + "SELECT query_id, string_agg(b.context, chr(10) || chr(10) ORDER BY rank) AS context, list(block_id ORDER BY rank) AS block_ids FROM r JOIN blocks b USING (block_id) WHERE rank <= 3 GROUP BY query_id")
def ask_context(spark, sf_dir):
    scored = retrieval.tf_cosine(paragraphs(spark, sf_dir), QUESTION)
    return retrieval.render_scored(retrieval.top_k(scored, 3, ["query_id"]), ["query_id"])


@query("embedding_topk_cosine", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM v, v q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def embedding_topk_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(vectors, vectors.where("vec_id % 50 = 0"), 10)


def _md_documents(spark, sf_dir) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return md_lines(spark, sf_dir).groupBy("paper_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"))


REFS = "concat(body, '\\n## References\\n', array_join(transform(sequence(1, cast(1 + paper_id % 7 as int)), i -> concat('[', i, '] Entry ', i)), '\\n'), '\\n')"
WHOLE = f"""
WITH {MD}, body AS (SELECT paper_id, string_agg(line, chr(10) ORDER BY line_no) AS body FROM md GROUP BY paper_id),
doc AS (SELECT paper_id, body, body || chr(10) || '## References' || chr(10) || array_to_string(list_transform(range(1, CAST(2 + paper_id % 7 AS BIGINT)), lambda i: '[' || i || '] Entry ' || i), chr(10)) || chr(10) AS markdown FROM body)
"""


def whole(spark, sf_dir) -> DataFrame:
    return _md_documents(spark, sf_dir).selectExpr("paper_id", f"{REFS} as markdown")


@query("link_citations", WHOLE + """SELECT paper_id,
  regexp_replace(body, '\\[(\\d{1,3})\\]', '[[\\1]](#ref-\\1)', 'g') || substr(regexp_replace(chr(10) || substr(markdown, length(body) + 2), '(\\n+)\\[(\\d{1,3})\\]', '\\1<a id="ref-\\2"></a>[\\2]', 'g'), 1) AS markdown FROM doc""")
def link_citations(spark, sf_dir):
    return whole(spark, sf_dir).select("paper_id", markdown.process_citations(F.col("markdown")).alias("markdown"))


@query("md_metrics", WHOLE + """SELECT paper_id, CAST(len(regexp_extract_all(markdown, '(?m)^#{1,6}\\s+\\S')) AS BIGINT) AS sections,
  CAST(len(regexp_extract_all(body, '\\[\\d{1,3}\\]')) AS BIGINT) AS linked_citations, CAST(0 AS BIGINT) AS figures, coalesce(tables, 0) AS tables, CAST(1 + paper_id % 7 AS BIGINT) AS refs
FROM doc LEFT JOIN (SELECT paper_id, count(*) AS tables FROM (
  SELECT paper_id, isle, count(*) FILTER (WHERE len(regexp_extract_all(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '\\|')) >= 1) AS wide
  FROM (SELECT *, line_no - row_number() OVER (PARTITION BY paper_id ORDER BY line_no) AS isle FROM md WHERE contains(line, '|')) GROUP BY ALL) WHERE wide >= 2 GROUP BY 1) USING (paper_id)""")
def md_metrics(spark, sf_dir):
    linked = whole(spark, sf_dir).select("paper_id", markdown.process_citations(F.col("markdown")).alias("markdown"))
    return markdown.metrics(linked)


@query("bibliography_spacing", WHOLE + """SELECT paper_id, body || chr(10) || '## References' || chr(10) || array_to_string(list_transform(range(1, CAST(2 + paper_id % 7 AS BIGINT)), lambda i: '[' || i || '] Entry ' || i), chr(10) || chr(10)) || chr(10) AS markdown FROM doc""")
def bibliography_spacing(spark, sf_dir):
    return whole(spark, sf_dir).select("paper_id", markdown.space_bibliography(F.col("markdown")).alias("markdown"))


@query("cleanup_text", """WITH d AS (SELECT doc_id, replace(text, 'th', 'ﬁ') || '  ' || chr(10) || '<!-- image -->' || chr(10) || chr(10) || chr(10) || chr(10) || 'glyph[alpha] glyph[nope] GLYPH<12> a–b' AS t FROM documents),
e AS (SELECT doc_id, replace(replace(t, 'ﬁ', 'fi'), '–', '-') AS t FROM d),
f AS (SELECT doc_id, replace(replace(replace(replace(t, '<!-- image -->' || chr(10), ''), 'glyph[alpha]', 'α'), 'glyph[nope]', ''), 'GLYPH<12>', '') AS t FROM e),
g AS (SELECT doc_id, regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM f)
SELECT doc_id, regexp_replace(t, '[ \\t]+(\\n|$)', '\\1', 'g') AS cleaned FROM g""")
def cleanup_text(spark, sf_dir):
    noisy = F.concat(F.replace("text", F.lit("th"), F.lit("ﬁ")), F.lit("  \n<!-- image -->\n\n\n\nglyph[alpha] glyph[nope] GLYPH<12> a–b"))
    return table(spark, sf_dir, "documents").select("doc_id", markdown.cleanup(noisy).alias("cleaned"))


@query("hashed_topk")
def hashed_topk(spark, sf_dir):
    asked = spark.createDataFrame(list(QUESTION.items()), "query_id string, query string")
    found = paragraphs(spark, sf_dir)
    return retrieval.hashed_search(retrieval.hashed_index(found), found, asked, 10).select("query_id", "block_id", "score", "rank")
