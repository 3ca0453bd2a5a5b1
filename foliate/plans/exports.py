"""Queries of bibliographies as text, of records and claims, repairs of figures and equations, and exports. SQL stands beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import answers, bibtex, export, lint, repair, sourcing
from foliate.plans.documents import SECTIONS, sections, table
from foliate.plans.graphs import KG, valid
from foliate.sources import readers
from foliate.storage import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


# An entry a line, of four makes; a paper's bibliography is the lines of twenty parts.
ENTRY = "CASE p_partkey % 4 WHEN 0 THEN '@Article{p' || p_partkey || ', title = {A {B} c = d}, Year=2000}' WHEN 1 THEN '@misc{, author = \"' || p_brand || '\", note={}}' WHEN 2 THEN 'text @book{p' || (p_partkey - p_partkey % 3) || '}' ELSE '@InProceedings { p' || p_partkey || ' , title={T}, ' || CASE WHEN p_size % 2 = 0 THEN 'booktitle' ELSE 'Pages' END || '={x}, title={again}}' END"
PARSED = f"""lines AS (SELECT p_partkey // 20 AS paper_id, CAST(row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS INTEGER) AS ord, {ENTRY} AS line FROM part),
entries AS (SELECT paper_id, ord, lower(regexp_extract(line, '@(\\w+)\\s*\\{{', 1)) AS type, regexp_extract(line, '@\\w+\\s*\\{{\\s*([^,\\s}}]*)\\s*[,}}]', 1) AS key,
  list_sort(list_distinct(list_transform(regexp_extract_all(CASE WHEN contains(line, ',') THEN substr(line, strpos(line, ',')) ELSE '' END, '(\\w+)\\s*=', 1), lambda x: lower(x)))) AS fields FROM lines)"""


def bibliographies(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey div 20 as paper_id", "p_partkey", f"{ENTRY} as line")
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", "line")))
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("bibtex"))


@query("parse_bibtex", f"WITH {PARSED} SELECT paper_id, ord, type, key, array_to_string(fields, ',') AS fields FROM entries")
def parse_bibtex(spark, sf_dir):
    return bibtex.parse(bibliographies(spark, sf_dir), ["paper_id"]).select("paper_id", "ord", "type", "key", F.array_join("fields", ",").alias("fields"))


@query("check_refs_text", f"""WITH {PARSED}, cited AS (SELECT l_partkey // 20 AS paper_id, 'p' || l_partkey AS key FROM lineitem),
c AS (SELECT DISTINCT * FROM cited), b AS (SELECT DISTINCT paper_id, key FROM entries WHERE key != ''),
p AS (SELECT DISTINCT paper_id FROM cited UNION SELECT DISTINCT paper_id FROM entries)
SELECT p.paper_id, (SELECT count(*) FROM entries e WHERE e.paper_id = p.paper_id) AS entries, (SELECT count(*) FROM c WHERE c.paper_id = p.paper_id) AS cited,
  (SELECT count(*) FROM entries e WHERE e.paper_id = p.paper_id AND (key = '' OR NOT list_contains(fields, 'title'))) AS malformed,
  (SELECT count(*) FROM (SELECT key FROM entries e WHERE e.paper_id = p.paper_id AND key != '' GROUP BY key HAVING count(*) > 1)) AS duplicates,
  (SELECT count(*) FROM c WHERE c.paper_id = p.paper_id AND NOT EXISTS (SELECT 1 FROM b WHERE b.paper_id = c.paper_id AND b.key = c.key)) AS missing,
  (SELECT count(*) FROM b WHERE b.paper_id = p.paper_id AND NOT EXISTS (SELECT 1 FROM c WHERE b.paper_id = c.paper_id AND b.key = c.key)) AS uncited FROM p""")
def check_refs_text(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").selectExpr("l_partkey div 20 as paper_id", "concat('p', l_partkey) as key")
    return lint.lint_counts(cited, bibtex.parse(bibliographies(spark, sf_dir), ["paper_id"]), ["paper_id"])


@query("space_equations", """WITH t AS (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '$$' || chr(10) || 'x' || chr(10) || chr(10) || '$$' ELSE ' $$ a = b $$ ' END || chr(10)), chr(10))) AS line,
  generate_subscripts(string_split(replace(text, '. ', '.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '$$' || chr(10) || 'x' || chr(10) || chr(10) || '$$' ELSE ' $$ a = b $$ ' END || chr(10)), chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM t)
SELECT doc_id, string_agg(CASE WHEN (trim(line) = '$$' OR (starts_with(trim(line), '$$') AND ends_with(trim(line), '$$') AND length(trim(line)) > 2)) AND before != '' THEN chr(10) ELSE '' END || line, chr(10) ORDER BY n) AS markdown FROM l GROUP BY doc_id""")
def space_equations(spark, sf_dir):
    made = F.expr("replace(text, '. ', concat('.\\n', if(doc_id % 2 = 0, '$$\\nx\\n\\n$$', ' $$ a = b $$ '), '\\n'))")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", repair.space_equations(made).alias("markdown"))


FIGURES = """CASE p_partkey % 5 WHEN 0 THEN 'Figure ' || p_size || ': a caption' WHEN 1 THEN ' **Fig. ' || (p_size % 7) || '. bold' WHEN 2 THEN 'As shown in Fig. 1. there' WHEN 3 THEN '![Figure ' || (p_size % 9) || '](x)' ELSE 'fig ' || (p_size % 7) || ' of it' END"""
FILES = """CASE p_size % 4 WHEN 0 THEN 'Figure-' || (p_partkey % 11) || '.png' WHEN 1 THEN 'doc_img_00' || (p_partkey % 10) || '.png' WHEN 2 THEN 'plot.png' ELSE 'fig' || p_size || '.png' END"""
EMBEDDED = f"""lines AS (SELECT p_partkey // 20 AS paper_id, p_partkey AS n, {FIGURES} AS line, {FILES} AS file FROM part),
numbered AS (SELECT *, try_cast(nullif(regexp_extract(line, '(?i)^\\s*(?:\\*\\*)?Fig(?:ure)?\\.?\\s*(\\d+)[.:\\s]', 1), '') AS BIGINT) AS number, try_cast(nullif(regexp_extract(line, '!\\[Figure (\\d+)\\]', 1), '') AS BIGINT) AS had,
  try_cast(coalesce(nullif(regexp_extract(file, '(?i)(?:figure|fig)[_-]?(\\d+)', 1), ''), nullif(regexp_extract(file, '(?i)_img[_-]?0*(\\d+)', 1), '')) AS BIGINT) AS of FROM lines),
files AS (SELECT paper_id, of AS number, arg_min(file, n) AS file FROM numbered WHERE of IS NOT NULL GROUP BY ALL), shown AS (SELECT DISTINCT paper_id, had AS number FROM numbered WHERE had IS NOT NULL)"""


def figure_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey div 20 as paper_id", "p_partkey as ord", f"{FIGURES} as line", f"{FILES} as file")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("markdown")), rows.select("paper_id", "ord", "file")


@query("embed_figures", f"""WITH {EMBEDDED}, f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, number ORDER BY n) AS i FROM numbered)
SELECT paper_id, string_agg(CASE WHEN i = 1 AND g.file IS NOT NULL AND s.number IS NULL THEN '![Figure ' || f.number || '](./img/' || g.file || ')' || chr(10) || chr(10) ELSE '' END || line, chr(10) ORDER BY n) AS markdown
FROM f LEFT JOIN files g USING (paper_id, number) LEFT JOIN shown s USING (paper_id, number) GROUP BY paper_id""")
def embed_figures(spark, sf_dir):
    return repair.embed_figures(*figure_inputs(spark, sf_dir))


@query("unembedded_figures", f"WITH {EMBEDDED} SELECT paper_id, number, file FROM files ANTI JOIN shown USING (paper_id, number)")
def unembedded_figures(spark, sf_dir):
    return repair.unembedded_figures(*figure_inputs(spark, sf_dir))


@query("latex_escape", """WITH t AS (SELECT doc_id, replace(replace(text, 'th', '{\\_^'), 'on', '~50% & $x#') AS t FROM documents)
SELECT doc_id, replace(replace(replace(regexp_replace(translate(t, '\\~^', chr(1) || chr(2) || chr(3)), '([&%$#_{}])', '\\\\\\1', 'g'), chr(1), '\\textbackslash{}'), chr(2), '\\textasciitilde{}'), chr(3), '\\textasciicircum{}') AS latex FROM t""")
def latex_escape(spark, sf_dir):
    odd = F.replace(F.replace("text", F.lit("th"), F.lit("{\\_^")), F.lit("on"), F.lit("~50% & $x#"))
    return table(spark, sf_dir, "documents").select("doc_id", export.latex_escape(odd).alias("latex"))


@query("own_headers", """WITH b AS (SELECT p_partkey, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN chr(10) || '## 2.' || p_size || ' ' || upper(p_name) WHEN 1 THEN '# ' || p_name WHEN 2 THEN p_name ELSE '### other' END || CASE WHEN p_size % 3 > 0 THEN chr(10) || chr(10) || 'Body of ' || p_brand ELSE '' END AS body FROM part),
s AS (SELECT *, regexp_replace(body, '^\\n+', '') AS bare FROM b)
SELECT p_partkey, CASE WHEN starts_with(bare, '#') AND lower(regexp_replace(trim(regexp_replace(trim(regexp_extract(bare, '^([^\\n]*)', 1)), '^#+', '')), '^\\d+(\\.\\d+)*\\.?\\s*', '')) = lower(trim(title))
  THEN regexp_replace(regexp_replace(bare, '^[^\\n]*', ''), '^\\n+', '') ELSE bare END AS body FROM s""")
def own_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_name as title",
        "concat(case p_partkey % 4 when 0 then concat('\\n## 2.', p_size, ' ', upper(p_name)) when 1 then concat('# ', p_name) when 2 then p_name else '### other' end, if(p_size % 3 > 0, concat('\\n\\nBody of ', p_brand), '')) as body",
    )
    return rows.select("p_partkey", export.without_own_header(F.col("body"), F.col("title")).alias("body"))


STYLE_LINES = " || ".join(f"'    classDef {kind} {style};' || chr(10)" for kind, style in export.STYLES.items())


@query("kg_mermaid", KG + f""", shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS i, count(*) OVER (PARTITION BY paper_id) AS n FROM edges) WHERE i <= 100),
kept AS (SELECT * FROM nodes WHERE coalesce((SELECT count(*) FROM edges e WHERE e.paper_id = nodes.paper_id), 0) <= 100 OR EXISTS (SELECT 1 FROM shown s WHERE s.paper_id = nodes.paper_id AND nodes.id IN (s.source, s.target))),
l AS (SELECT paper_id, 1 AS part, ord, '    ' || id || '["' || trim(translate(label || ' (' || type || ')', '"[]', '''()')) || '"]:::' || type AS line FROM kept UNION ALL SELECT paper_id, 2, ord, '    ' || source || ' -->|' || relation || '| ' || target FROM shown),
h AS (SELECT paper_id, max(n) AS n FROM shown GROUP BY 1)
SELECT l.paper_id, 'graph TD' || chr(10) || CASE WHEN any_value(n) > 100 THEN '    %% showing 100 of ' || any_value(n) || ' edges + their nodes' || chr(10) ELSE '' END || {STYLE_LINES} || string_agg(line, chr(10) ORDER BY part, ord, line) AS mermaid FROM l LEFT JOIN h USING (paper_id) GROUP BY l.paper_id""")
def kg_mermaid(spark, sf_dir):
    return export.mermaid(*valid(spark, sf_dir), most_edges=100)


@query("kg_counts", KG + "SELECT n.paper_id, count(*) AS nodes, count(*) FILTER (WHERE type != 'concept') AS entities, (SELECT count(*) FROM edges e WHERE e.paper_id = n.paper_id) AS edges FROM nodes n GROUP BY n.paper_id")
def kg_counts(spark, sf_dir):
    return sourcing.graph_counts(*valid(spark, sf_dir))


IDS = "CASE p_partkey % 6 WHEN 0 THEN 'arxiv:21' || p_partkey WHEN 1 THEN 'crossref:10.1/' || p_partkey WHEN 2 THEN 'openalex:https://w/' || p_partkey WHEN 3 THEN 'crossref:no' WHEN 4 THEN 's' || p_partkey ELSE '' END"


@query("record_urls", f"""WITH r AS (SELECT p_partkey, {IDS} AS id, CASE WHEN p_size % 4 = 0 THEN '10.2/' || p_size END AS doi, CASE WHEN p_size % 3 = 0 THEN '19' || p_size END AS arxiv FROM part)
SELECT p_partkey, CASE WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi WHEN arxiv IS NOT NULL THEN 'https://arxiv.org/abs/' || arxiv WHEN starts_with(id, 'arxiv:') THEN 'https://arxiv.org/abs/' || substr(id, 7)
  WHEN starts_with(id, 'crossref:') AND contains(id, '/') THEN 'https://doi.org/' || substr(id, 10) WHEN starts_with(id, 'openalex:') THEN substr(id, 10) WHEN id != '' AND NOT starts_with(id, 'crossref:') THEN 'https://www.semanticscholar.org/paper/' || id END AS url,
  CASE WHEN starts_with(id, 'arxiv:') THEN substr(id, 7) ELSE arxiv END AS arxiv_id FROM r""")
def record_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{IDS} as id", "map_filter(map('DOI', if(p_size % 4 = 0, concat('10.2/', p_size), null), 'ArXiv', if(p_size % 3 = 0, concat('19', p_size), null)), (k, v) -> v is not null) as ids")
    return rows.select("p_partkey", sourcing.record_url(F.col("id"), F.col("ids")).alias("url"), sourcing.arxiv_id(F.col("id"), F.col("ids")).alias("arxiv_id"))


CASCADE = "SELECT p_partkey // 40 AS query_id, p_size % 3 AS backend_ord, p_partkey AS rec_ord, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE '  ' || p_brand END || ' ' || (p_size % 5) END AS title FROM part"
CASCADED = f"""r AS ({CASCADE}), k AS (SELECT *, lower(trim(title)) AS key FROM r), d AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY backend_ord, rec_ord) AS i FROM k WHERE key != ''),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY backend_ord, rec_ord) AS rank FROM d WHERE i = 1)"""


def cascaded(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey div 40 as query_id", "p_size % 3 as backend_ord", "p_partkey as rec_ord", "if(p_partkey % 13 = 0, ' ', concat(if(p_partkey % 2 = 0, upper(p_brand), concat('  ', p_brand)), ' ', p_size % 5)) as title")
    return sourcing.cascade(rows, 12)


@query("search_cascade", f"WITH {CASCADED} SELECT query_id, rec_ord, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 12")
def search_cascade(spark, sf_dir):
    return cascaded(spark, sf_dir)[0].select("query_id", "rec_ord", "rank")


@query("cascade_outcomes", f"""WITH {CASCADED}, f AS (SELECT query_id, backend_ord AS last FROM o WHERE rank = 12), g AS (SELECT query_id, backend_ord, count(*) AS n FROM r GROUP BY ALL)
SELECT query_id, backend_ord, CASE WHEN backend_ord > last THEN 'not reached: limit already met' ELSE 'ok: ' || n END AS outcome FROM g LEFT JOIN f USING (query_id)""")
def cascade_outcomes(spark, sf_dir):
    return cascaded(spark, sf_dir)[1]


@query("known_records", "SELECT s_suppkey, p_partkey, p_name FROM supplier JOIN part ON lower(CASE WHEN s_suppkey % 2 = 0 THEN upper('Brand#' || (s_suppkey % 60)) ELSE 'brand#' || (s_suppkey % 60) END) = lower(p_brand)")
def known_records(spark, sf_dir):
    titles = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "if(s_suppkey % 2 = 0, upper(concat('Brand#', s_suppkey % 60)), concat('brand#', s_suppkey % 60)) as title")
    return sourcing.known_records(titles, table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_brand as filed_as")).select("s_suppkey", "p_partkey", "p_name")


@query("unseen_titles", """WITH r AS (SELECT p_partkey % 50 AS brief_id, p_partkey AS ord, ' ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END AS title FROM part), n AS (SELECT DISTINCT p_partkey % 50 AS brief_id, lower(p_brand) AS t FROM part WHERE p_size % 3 = 0),
f AS (SELECT brief_id, lower(trim(title)) AS t, min(ord) AS ord FROM r GROUP BY ALL) SELECT f.brief_id, f.ord FROM f ANTI JOIN n USING (brief_id, t)""")
def unseen_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    records = part.selectExpr("p_partkey % 50 as brief_id", "p_partkey as ord", "concat(' ', p_brand, if(p_partkey % 2 = 0, ' ', '')) as title")
    return sourcing.unseen_titles(records, part.where("p_size % 3 = 0").selectExpr("p_partkey % 50 as brief_id", "upper(p_brand) as title")).select("brief_id", "ord")


@query("claim_sources", """WITH p AS (SELECT l_orderkey AS paper_id, l_linenumber AS ord, 'p' || l_partkey AS key FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS paper_id, 'p' || l_partkey AS key, l_partkey FROM lineitem WHERE l_partkey % 3 > 0),
j AS (SELECT p.*, c.key IS NOT NULL AS cited, trim(CASE WHEN c.l_partkey % 4 = 0 THEN '  ' ELSE 'about ' || c.key END) AS abstract, (SELECT 'whole text ' || p_name FROM part WHERE p_partkey = c.l_partkey AND p_size % 5 = 0) AS whole FROM p LEFT JOIN c ON p.paper_id = c.paper_id AND p.key = c.key)
SELECT paper_id, ord, key, CASE WHEN cited AND whole IS NOT NULL THEN 'full_text' WHEN cited AND abstract != '' THEN 'abstract' ELSE 'none' END AS source_kind,
  CASE WHEN cited AND whole IS NOT NULL THEN whole WHEN cited AND abstract != '' THEN abstract ELSE '' END AS source_text,
  CASE WHEN NOT (cited AND (whole IS NOT NULL OR abstract != '')) THEN 'no_source' END AS verdict FROM j""")
def claim_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.selectExpr("l_orderkey as paper_id", "l_linenumber as ord", "concat('p', l_partkey) as key")
    citations = lines.where("l_partkey % 3 > 0").selectExpr("l_orderkey as paper_id", "concat('p', l_partkey) as key", "if(l_partkey % 4 = 0, '  ', concat('about p', l_partkey)) as abstract").distinct()
    whole = table(spark, sf_dir, "part").where("p_size % 5 = 0").selectExpr("concat('p', p_partkey) as key", "concat('whole text ', p_name) as text")
    return sourcing.sources_of_claims(pairs, citations, whole)


@query("first_pairs", "SELECT paper_id, ord, key FROM (SELECT l_suppkey AS paper_id, l_orderkey * 8 + l_linenumber AS ord, 'p' || l_partkey AS key, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber, 'p' || l_partkey) AS i FROM lineitem) WHERE i <= 200")
def first_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as paper_id", "l_orderkey * 8 + l_linenumber as ord", "concat('p', l_partkey) as key")
    return sourcing.first_pairs(pairs, order=("ord", "key"))


@query("paper_contexts", SECTIONS + """, g AS (SELECT paper_id AS set_id, ord, CASE ord % 3 WHEN 0 THEN 'paper' ELSE 'L' || ord % 3 END AS label, CASE WHEN ord % 5 = 0 THEN 'Our Methods' WHEN ord % 7 = 0 THEN '' ELSE title END AS heading, text FROM sections),
b AS (SELECT *, trim(CASE WHEN heading != '' THEN '## ' || heading || chr(10) || text ELSE text END, ' ' || chr(10)) AS body FROM g)
SELECT set_id, label, min(ord) AS ord, left(string_agg(body, chr(10) || chr(10) ORDER BY NOT regexp_matches(heading, '(?i)method|approach|architect|model|system|design|experiment|evaluat|setup|dataset|benchmark|baseline|metric|ablation|result|implementation|protocol'), ord), 8000) AS text FROM b WHERE body != '' GROUP BY set_id, label""")
def paper_contexts(spark, sf_dir):
    heading = "case when ord % 5 = 0 then 'Our Methods' when ord % 7 = 0 then '' else title end"
    rows = sections(spark, sf_dir).selectExpr("paper_id as set_id", "ord", f"case when ord % 3 = 0 then {heading} else concat('[L', ord % 3, '] ', {heading}) end as section_path", "text")
    return sourcing.paper_contexts(rows).select("set_id", "label", "ord", "text")


@query("context_markdown", SECTIONS + "SELECT paper_id, regexp_replace(string_agg(regexp_replace('## ' || section_path || chr(10) || text, '\\s+$', ''), chr(10) || chr(10) ORDER BY ord), '^\\s+|\\s+$', '', 'g') || chr(10) AS context FROM sections GROUP BY paper_id")
def context_markdown(spark, sf_dir):
    return export.context_markdown(sections(spark, sf_dir))


@query("paper_queries", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' ' || source || ' ' WHEN doc_id % 4 = 1 THEN ' ' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'first' || chr(10) || '##' || chr(10) || ' ## A head ' || doc_id || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents)
SELECT doc_id, CASE WHEN trim(title) != '' THEN trim(title) WHEN doc_id % 3 = 0 THEN trim(regexp_extract(text, '(?m)^\\s*#+[ ]*([^#\\n]+)$', 1)) ELSE array_to_string(regexp_extract_all(text, '\\S+')[1:12], ' ') END AS search FROM t""")
def paper_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "case doc_id % 4 when 0 then concat(' ', source, ' ') when 1 then ' ' end as title", "concat(if(doc_id % 3 = 0, concat('first\\n##\\n ## A head ', doc_id, '\\n'), ''), coalesce(text, '')) as text")
    return rows.select("doc_id", export.paper_query(F.col("title"), F.col("text")).alias("search"))


@query("ontology_kinds", """WITH b AS (SELECT s_suppkey AS paper_id, k.kind, k.name, k.ord, false AS found FROM supplier, (VALUES ('entity', 'method', 1), ('entity', 'dataset', 2), ('edge', 'uses', 1)) k(kind, name, ord)),
e AS (SELECT l_suppkey AS paper_id, CASE WHEN l_linenumber % 2 = 0 THEN 'entity' ELSE 'edge' END AS kind, CASE WHEN l_quantity < 5 THEN 'method' ELSE 'k' || CAST(l_quantity AS INTEGER) END AS name, min(l_orderkey * 8 + l_linenumber) AS ord FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY kind DESC, ord) AS i FROM e WHERE NOT (kind = 'entity' AND name = 'method'))
SELECT paper_id, kind, name, CAST(ord AS BIGINT) AS ord, found FROM b UNION ALL SELECT paper_id, kind, name, CAST(ord AS BIGINT), true FROM n WHERE i <= 8""")
def ontology_kinds(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as paper_id", "stack(3, 'entity', 'method', cast(1 as bigint), 'entity', 'dataset', cast(2 as bigint), 'edge', 'uses', cast(1 as bigint)) as (kind, name, ord)")
    extra = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as paper_id", "if(l_linenumber % 2 = 0, 'entity', 'edge') as kind", "if(l_quantity < 5, 'method', concat('k', cast(l_quantity as int))) as name", "l_orderkey * 8 + l_linenumber as ord")
    return sourcing.merge_kinds(base, extra)


@query("scholar_records", """SELECT p_partkey, 's' || p_partkey AS record_id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS authors, CASE WHEN p_size % 2 = 0 THEN 'J ' || p_size END AS journal, CASE WHEN p_size % 4 > 0 THEN 1990 + p_size END AS year,
  CASE WHEN p_size % 5 = 0 THEN '10.9/' || p_partkey END AS doi FROM part""")
def scholar_records(spark, sf_dir):
    raw = table(spark, sf_dir, "part").selectExpr("p_partkey", """to_json(named_struct('paperId', concat('s', p_partkey), 'title', p_name, 'authors', if(p_partkey % 3 = 0, null, array(named_struct('name', p_brand), named_struct('name', ''))), 'venue', '',
      'journal', if(p_size % 2 = 0, named_struct('name', concat('J ', p_size)), null), 'year', if(p_size % 4 > 0, 1990 + p_size, null), 'externalIds', map('DOI', if(p_size % 5 = 0, concat('10.9/', p_partkey), null), 'X', 'y'))) as raw""")
    rows = readers.semantic_scholar_records(raw)
    return rows.select("p_partkey", "record_id", "title", F.array_join("authors", "|").alias("authors"), "journal", "year", F.try_element_at("external_ids", F.lit("DOI")).alias("doi"))


@query("atom_records", """SELECT p_partkey // 10 AS feed, 'arxiv:' || p_partkey || 'v1' AS record_id, p_name || ' & more’s — <x> &' AS title, 'A ' || p_brand || CASE WHEN p_size % 2 = 0 THEN '|B' ELSE '' END AS authors, CASE WHEN p_size % 3 > 0 THEN 1970 + p_size END AS year,
  CASE WHEN p_size % 3 = 1 THEN (1970 + p_size) || '-01-02' END AS publication_date, CASE WHEN p_size % 4 > 0 THEN 'on ' || p_type END AS abstract FROM part""")
def atom_records(spark, sf_dir):
    entry = """concat('<entry><id>http://a/abs/', p_partkey, 'v1/</id><title>', p_name, '\\n  &amp;  more&#8217;s &#x2014; <![CDATA[<x> &]]></title><title2>no</title2><published>', case p_size % 3 when 0 then '' when 1 then concat(1970 + p_size, '-01-02T00:00:00Z') else cast(1970 + p_size as string) end,
      '</published><author><name> A ', p_brand, '</name></author>', if(p_size % 2 = 0, '<author><name>B</name></author>', '<author><name> </name></author>'), '<summary type=\\"text\\">', if(p_size % 4 > 0, concat(' on\\n', p_type), ''), '</summary></entry>')"""
    feeds = table(spark, sf_dir, "part").selectExpr("p_partkey div 10 as feed", f"{entry} as e").groupBy("feed").agg(F.array_join(F.collect_list("e"), "\n").alias("raw"))
    # entries alone, in a feed, and in a feed whose names have a prefix
    opened, prefixed = F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.regexp_replace("raw", "<(/?)(?=[a-z])", "<$1a:")
    kinds = [F.col("raw"), F.concat(F.lit('<?xml version="1.0"?>'), opened, "raw", F.lit("</feed>")), F.concat(F.lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><title>none</title>'), prefixed, F.lit("</a:feed>"))]
    feeds = feeds.withColumn("raw", F.when(F.col("feed") % 3 == 0, kinds[0]).when(F.col("feed") % 3 == 1, kinds[1]).otherwise(kinds[2]))
    return readers.atom_records(feeds).select("feed", "record_id", "title", F.array_join("authors", "|").alias("authors"), "year", "publication_date", "abstract")


# Answers of each part: fenced, bare after a brace in a string, broken, or an array; each with two nodes, a stray item and edges of which one has no end.
ANSWER = """concat(case p_partkey % 4 when 0 then 'Here: ```json\\n' when 1 then 'As said ' when 2 then '{ broken ' else '[1, 2] ' end,
  '{\\"note\\": \\"a } brace\\", \\"nodes\\": [{\\"id\\": \\"a', p_size, '\\", \\"label\\": \\"', p_brand, '\\", \\"type\\": \\"', if(p_size % 2 = 0, ' Method ', 'gadget'), '\\"}, 7, {\\"id\\": \\"b\\"}, {\\"id\\": \\"c\\", \\"label\\": \\"C\\", \\"confidence\\": 0.5}], ',
  '\\"edges\\": [{\\"source\\": \\"a', p_size, '\\", \\"target\\": \\"c\\", \\"relation\\": \\"uses\\"}, {\\"source\\": \\"c\\", \\"target\\": \\"zz\\", \\"relation\\": \\"uses\\"}]}', if(p_partkey % 4 = 0, '\\n```', ' done }'))"""


def _answers(spark, sf_dir):
    # keys are dealt before they become long answers
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey")
    return answers.graphs(parts.selectExpr("p_partkey div 10 as paper_id", "p_partkey as batch", f"{ANSWER} as response"))


@query("answer_nodes", """SELECT p_partkey // 10 AS paper_id, p_partkey AS batch, n.id, n.label, n.type, n.confidence FROM part, (VALUES (1), (2)) v(k),
  LATERAL (SELECT CASE WHEN k = 1 THEN 'a' || p_size ELSE 'c' END AS id, CASE WHEN k = 1 THEN p_brand ELSE 'C' END AS label, CASE WHEN k = 1 AND p_size % 2 = 0 THEN 'method' ELSE 'concept' END AS type, CAST(CASE WHEN k = 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence) n WHERE p_partkey % 4 != 2""")
def answer_nodes(spark, sf_dir):
    return _answers(spark, sf_dir)[0].select("paper_id", "batch", "id", "label", "type", "confidence")


@query("answer_edges", "SELECT p_partkey // 10 AS paper_id, p_partkey AS batch, 'a' || p_size AS source, 'c' AS target, 'uses' AS relation FROM part WHERE p_partkey % 4 != 2")
def answer_edges(spark, sf_dir):
    return _answers(spark, sf_dir)[1].select("paper_id", "batch", "source", "target", "relation")
