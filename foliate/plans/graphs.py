"""Queries of graphs and sources. Suppliers are nodes of three papers; SQL stands beside each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import answers, caching, graph
from foliate.plans.documents import MD, SECTIONS, sections, table
from foliate.sources import readers
from foliate.storage import settled, shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TYPES = "'method', 'concept', 'dataset', 'metric', 'claim', 'result', 'Task ', 'gadget'"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


KG = f"""
WITH raw_nodes AS (SELECT s_suppkey // 50 AS paper_id, s_suppkey AS ord, 'n' || s_suppkey AS id, s_name AS label, [{TYPES}][1 + s_suppkey % 8] AS type, CAST((s_suppkey % 10) / 10.0 AS DOUBLE) AS confidence FROM supplier),
nodes AS (SELECT paper_id, ord, id, label, CASE WHEN lower(trim(type)) IN ('method', 'dataset', 'claim', 'result', 'metric', 'concept', 'task') THEN lower(trim(type)) ELSE 'concept' END AS type, confidence FROM raw_nodes),
raw_edges AS (SELECT s_suppkey // 50 AS paper_id, s_suppkey * 8 + k AS ord, 'n' || s_suppkey AS source, 'n' || (s_suppkey // 50 * 50 + (s_suppkey * k) % 50) AS target, CASE WHEN k % 2 = 0 THEN 'uses' ELSE 'likes' END AS relation FROM supplier, (VALUES (1), (2), (3), (5), (6), (6)) v(k)),
edges AS (SELECT e.paper_id, min(e.ord) AS ord, e.source, e.target, CASE WHEN relation = 'uses' THEN 'uses' ELSE 'related_to' END AS relation FROM raw_edges e
  JOIN nodes a ON a.paper_id = e.paper_id AND a.id = e.source JOIN nodes b ON b.paper_id = e.paper_id AND b.id = e.target WHERE source != target GROUP BY ALL)
"""


def raw_nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey div 50 as paper_id", "s_suppkey as ord", "concat('n', s_suppkey) as id", "s_name as label", f"element_at(array({TYPES}), cast(1 + s_suppkey % 8 as int)) as type",
        "'' as description", "'' as section_path", "cast(array() as array<string>) as aliases", "'' as evidence", "s_suppkey % 10 / 10.0D as confidence",
    )


def raw_edges(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey div 50 as paper_id", "s_suppkey", "explode(array(1, 2, 3, 5, 6, 6)) as k")
    return rows.selectExpr("paper_id", "s_suppkey * 8 + k as ord", "concat('n', s_suppkey) as source", "concat('n', s_suppkey div 50 * 50 + (s_suppkey * k) % 50) as target", "case when k % 2 = 0 then 'uses' else 'likes' end as relation")


def valid(spark, sf_dir):
    nodes = graph.coerce_types(raw_nodes(spark, sf_dir))
    return nodes, graph.valid_edges(raw_edges(spark, sf_dir), nodes)


@query("kg_edge_valid", KG + "SELECT paper_id, source, target, relation FROM edges")
def kg_edge_valid(spark, sf_dir):
    return valid(spark, sf_dir)[1].select("paper_id", "source", "target", "relation")


PRUNED = KG + ", pn AS (SELECT * FROM nodes WHERE confidence >= 0.5), pe AS (SELECT * FROM edges SEMI JOIN pn a ON a.paper_id = edges.paper_id AND a.id = edges.source SEMI JOIN pn b ON b.paper_id = edges.paper_id AND b.id = edges.target)"


@query("kg_prune", PRUNED + "SELECT paper_id, source, target, relation FROM pe")
def kg_prune(spark, sf_dir):
    return graph.prune_below(*valid(spark, sf_dir))[1].select("paper_id", "source", "target", "relation")


ORPHANS = ", po AS (SELECT * FROM pn WHERE paper_id NOT IN (SELECT paper_id FROM pe) OR EXISTS (SELECT 1 FROM pe WHERE pe.paper_id = pn.paper_id AND pn.id IN (pe.source, pe.target)))"


@query("kg_orphans", PRUNED + ORPHANS + "SELECT paper_id, id, label, type FROM po")
def kg_orphans(spark, sf_dir):
    nodes, edges = graph.prune_below(*valid(spark, sf_dir))
    return graph.prune_orphans(nodes, edges).select("paper_id", "id", "label", "type")


@query("kg_verify", KG.replace("nodes AS (SELECT paper_id", "texts AS (SELECT s_suppkey // 50 AS paper_id, lower(string_agg(s_name, ' ') FILTER (WHERE s_suppkey % 3 > 0)) AS t FROM supplier GROUP BY 1), nodes AS (SELECT paper_id").replace(", confidence FROM raw_nodes)", """, confidence AS c0 FROM raw_nodes),
g AS (SELECT nodes.*, CASE WHEN type IN ('method', 'dataset', 'metric', 'task') AND NOT contains(t, lower(label)) THEN c0 * 0.4 ELSE c0 END AS confidence FROM nodes JOIN texts USING (paper_id))""") + """,
pn AS (SELECT * FROM g WHERE confidence >= 0.3), pe AS (SELECT * FROM edges SEMI JOIN pn a ON a.paper_id = edges.paper_id AND a.id = edges.source SEMI JOIN pn b ON b.paper_id = edges.paper_id AND b.id = edges.target)""" + ORPHANS + "SELECT paper_id, id, type, round(confidence, 6) AS confidence FROM po")
def kg_verify(spark, sf_dir):
    nodes, edges = valid(spark, sf_dir)
    texts = table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 50).cast("long").alias("paper_id")).agg(F.array_join(F.collect_list(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name"))), " ").alias("text"))
    return graph.verify(nodes, edges, texts, 0.3)[0].select("paper_id", "id", "type", F.round("confidence", 6).alias("confidence"))


@query("kg_briefing", KG + """, t AS (SELECT paper_id, type, list(label ORDER BY ord) AS l FROM nodes GROUP BY ALL),
r AS (SELECT paper_id, sum(len(l)) AS n, string_agg('- ' || type || ': ' || array_to_string(l[1:12], ', ') || CASE WHEN len(l) > 12 THEN ' (+' || (len(l) - 12) || ' more)' ELSE '' END, chr(10) ORDER BY type) AS rows FROM t GROUP BY 1)
SELECT paper_id, 'Knowledge graph: ' || n || ' nodes, ' || (SELECT count(*) FROM edges WHERE edges.paper_id = r.paper_id) || ' relations.' || chr(10) || rows AS briefing FROM r""")
def kg_briefing(spark, sf_dir):
    return graph.briefing(*valid(spark, sf_dir))


@query("kg_seed", SECTIONS + """, n AS (SELECT doc_id AS paper_id, 0 AS ord, 'paper' AS id, CASE WHEN doc_id % 2 = 0 THEN 'part  3' ELSE source || ' ' || doc_id END AS label, NULL AS path FROM documents WHERE doc_id % 3 > 0
  UNION ALL SELECT paper_id, ord, 'sec' || (ord - 1), title, section_path FROM sections WHERE trim(title) != ''),
m AS (SELECT *, first_value(id) OVER (PARTITION BY paper_id, lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) ORDER BY ord) AS kept,
  first_value(label) OVER (PARTITION BY paper_id, lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) ORDER BY ord) AS kept_label FROM n)
SELECT paper_id, kept AS id, kept_label AS label, arg_min(path, ord) FILTER (WHERE path != '') AS section_path, CAST(count(DISTINCT label) - 1 AS INTEGER) AS n_aliases, (kept != 'paper' AND paper_id % 3 > 0) AS linked FROM m GROUP BY paper_id, kept, kept_label""")
def kg_seed(spark, sf_dir):
    papers = table(spark, sf_dir, "documents").selectExpr("doc_id as paper_id", "case when doc_id % 3 > 0 then if(doc_id % 2 = 0, 'part  3', concat(source, ' ', doc_id)) end as title")
    nodes, edges = graph.seed(papers, sections(spark, sf_dir))
    linked = edges.select("paper_id", F.col("source").alias("id"), F.lit(True).alias("_l"))
    return nodes.join(linked, ["paper_id", "id"], "left").select("paper_id", "id", "label", "section_path", F.size("aliases").alias("n_aliases"), F.coalesce("_l", F.lit(False)).alias("linked"))


WORDS = [w for words in graph.DOMAINS.values() for w in words]


@query("domain_detect", f"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' on ' || [{", ".join(f"'{w}'" for w in WORDS)}][1 + doc_id % {len(WORDS)}] || CASE WHEN doc_id % 2 = 0 THEN ' and LATENCY, cache' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' nothing' ELSE '' END AS text FROM documents),
h AS (SELECT doc_id, unnest([{", ".join("{'hits': " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words) + f", 'o': -{i}, 'd': '{name}'" + "}" for i, (name, words) in enumerate(graph.DOMAINS.items()))}]) AS s FROM t),
b AS (SELECT doc_id, max(s) AS s FROM h GROUP BY 1) SELECT doc_id, CASE WHEN s.hits > 0 THEN s.d ELSE 'general' END AS domain, s.hits AS hits FROM b""")
def domain_detect(spark, sf_dir):
    words = ", ".join(f"'{w}'" for w in WORDS)
    texts = table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat(coalesce(text, ''), ' on ', element_at(array({words}), cast(1 + doc_id % {len(WORDS)} as int)), case when doc_id % 2 = 0 then ' and LATENCY, cache' else '' end, case when doc_id % 7 = 0 then ' nothing' else '' end) as text")
    return graph.detect_domain(texts).select("doc_id", "domain", "hits")


LABEL = """CASE p_partkey % 9 WHEN 0 THEN 'BN' WHEN 1 THEN p_brand || ' net' WHEN 2 THEN p_brand WHEN 3 THEN p_brand || ' net ' || p_size WHEN 4 THEN 'XMLNet ' || p_size % 5 WHEN 5 THEN 'B' || substr(p_brand, 7, 1) || 'N'
  WHEN 6 THEN 'B' || substr(p_brand, 7, 1) || 'N' || p_size % 4 WHEN 7 THEN '  ' || lower(p_brand) || '  net' ELSE substr(p_name, 1, 12) END"""
FIELDS = (
    "p_partkey AS ord", "'e' || p_partkey % 60 AS id", f"{LABEL} AS label", "CASE WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'concept' END AS type", "repeat('d', CAST(p_partkey % 9 AS INT)) AS description",
    "CASE WHEN p_partkey % 2 = 0 THEN 'A > ' || p_partkey % 11 ELSE '' END AS section_path", "CASE WHEN p_partkey % 5 = 0 THEN 'e' || p_partkey % 7 ELSE '' END AS evidence",
)


def _labelled(spark, sf_dir) -> DataFrame:
    """Parts as entities: names of one to four words, acronyms, ids and labels that come back."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey div 100 as paper_id", *FIELDS, "p_partkey % 10 / 10.0D as confidence")
    return rows.withColumn("aliases", F.when(F.col("ord") % 4 == 0, F.array(F.lit("also"), F.lit(""), "label")).otherwise(F.array().cast("array<string>")))


# Each paper's nodes one by one: the ids and keys that stay are lists, in which a node finds the first that it joins.
PARTS = f"""
WITH RECURSIVE n AS (SELECT p_partkey // 100 AS paper_id, {", ".join(FIELDS)}, CAST(p_partkey % 10 / 10.0 AS DOUBLE) AS confidence,
  CASE WHEN p_partkey % 4 = 0 THEN ['also', '', {LABEL}] ELSE [] END AS aliases FROM part)"""
FOLD = """,
k AS (SELECT paper_id, ord, id, type || chr(10) || lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) AS key, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS r FROM n),
f AS (SELECT paper_id, r, ord, ord AS into_, [id] AS ids, [key] AS keys, [ord] AS ords FROM k WHERE r = 1
  UNION ALL SELECT k.paper_id, k.r, k.ord, coalesce(f.ords[p], k.ord), CASE WHEN p IS NULL THEN f.ids || [k.id] ELSE f.ids END, CASE WHEN p IS NULL THEN f.keys || [k.key] ELSE f.keys END, CASE WHEN p IS NULL THEN f.ords || [k.ord] ELSE f.ords END
  FROM (SELECT f.*, k.id AS own_id, k.key AS own_key, nullif(least(coalesce(nullif(list_position(f.ids, k.id), 0), 99999), coalesce(nullif(list_position(f.keys, k.key), 0), 99999)), 99999) AS p
    FROM f JOIN k ON k.paper_id = f.paper_id AND k.r = f.r + 1) f JOIN k ON k.paper_id = f.paper_id AND k.r = f.r + 1),
j AS (SELECT n.*, f.into_, length(description) > max(length(description)) OVER (PARTITION BY n.paper_id, into_ ORDER BY n.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longer FROM n JOIN f USING (paper_id, ord)),
a AS (SELECT paper_id, into_, list(x ORDER BY ord, i) AS xs FROM (SELECT paper_id, into_, ord, unnest(aliases || [label]) AS x, generate_subscripts(aliases || [label], 1) AS i FROM j WHERE ord != into_) GROUP BY ALL),
g AS (SELECT paper_id, into_, arg_max(description, {'l': length(description), 'o': -ord}) AS description, coalesce(arg_max(section_path, ord) FILTER (WHERE longer AND section_path != ''), arg_min(section_path, ord) FILTER (WHERE section_path != ''), '') AS section_path,
  coalesce(arg_min(evidence, ord) FILTER (WHERE evidence != ''), '') AS evidence, max(confidence) AS confidence FROM j GROUP BY ALL),
m AS (SELECT n.paper_id, n.ord, n.id, n.label, n.type, g.description, g.section_path, g.evidence, g.confidence,
  n.aliases || list_transform(list_filter(list_transform(coalesce(xs, []), lambda x, i: CASE WHEN x != '' AND x != n.label AND NOT list_contains(n.aliases, x) AND list_position(xs, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x) AS aliases
  FROM n JOIN g ON g.paper_id = n.paper_id AND g.into_ = n.ord LEFT JOIN a ON a.paper_id = n.paper_id AND a.into_ = n.ord)
"""
MERGE = PARTS + FOLD


@query("kg_merge", MERGE + "SELECT paper_id, ord, id, label, type, description, section_path, evidence, confidence, array_to_string(aliases, '|') AS aliases FROM m")
def kg_merge(spark, sf_dir):
    return graph.merge_nodes(_labelled(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "|"))


# Acronyms one by one, then the first pair that is alike, again and again: what is gone is a list.
COREF = MERGE + """, w AS (SELECT *, list_filter(flatten(list_transform(list_filter(string_split_regex(trim(label), '[\\s\\-_/]+'), lambda t: t != ''), lambda t:
  CASE WHEN len(regexp_extract_all(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+')) > 0 THEN regexp_extract_all(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+') ELSE [t] END)), lambda x: x != '') AS words FROM m),
s AS (SELECT paper_id, ord, trim(label) AS l, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS r FROM w WHERE regexp_matches(trim(label), '^[A-Z][A-Z0-9]{1,4}$')),
h AS (SELECT s.paper_id, s.ord, s.r, list(w.ord ORDER BY w.ord) AS longs FROM s JOIN w ON w.paper_id = s.paper_id AND w.ord != s.ord AND len(w.words) > 1 AND upper(array_to_string(list_transform(w.words, lambda x: x[1]), '')) = s.l GROUP BY ALL),
ac AS (SELECT DISTINCT paper_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS gone, CAST([] AS STRUCT(o BIGINT, t BIGINT)[]) AS went FROM w
  UNION ALL SELECT ac.paper_id, ac.r + 1, CASE WHEN len(list_filter(h.longs, lambda x: NOT list_contains(ac.gone, x))) > 0 THEN ac.gone || [s.ord] ELSE ac.gone END,
    CASE WHEN len(list_filter(h.longs, lambda x: NOT list_contains(ac.gone, x))) > 0 THEN ac.went || [{'o': s.ord, 't': list_filter(h.longs, lambda x: NOT list_contains(ac.gone, x))[1]}] ELSE ac.went END
    FROM ac JOIN s ON s.paper_id = ac.paper_id AND s.r = ac.r + 1 LEFT JOIN h ON h.paper_id = s.paper_id AND h.ord = s.ord),
al AS (SELECT paper_id, arg_max(gone, r) AS gone, arg_max(went, r) AS went FROM ac GROUP BY 1),
v AS (SELECT w.paper_id, w.ord, w.type, length(label) AS n, lower(trim(label)) AS l, list_distinct(list_transform(words, lambda x: lower(x))) AS ws FROM w JOIN al USING (paper_id) WHERE NOT list_contains(al.gone, w.ord) AND trim(label) != ''),
p AS (SELECT a.paper_id, a.ord AS a, b.ord AS b, a.n >= b.n AS left_ FROM v a JOIN v b ON a.paper_id = b.paper_id AND a.type = b.type AND a.ord < b.ord AND a.l != b.l
  WHERE contains(a.l, b.l) OR contains(b.l, a.l) OR (len(list_intersect(a.ws, b.ws)) > 0 AND len(list_intersect(a.ws, b.ws)) >= 0.8 * least(len(a.ws), len(b.ws)))),
fo AS (SELECT paper_id, gone, went FROM al UNION ALL
  SELECT paper_id, gone || [CASE WHEN left_ THEN b ELSE a END], went || [CASE WHEN left_ THEN {'o': b, 't': a} ELSE {'o': a, 't': b} END] FROM (
    SELECT fo.*, p.a, p.b, p.left_, row_number() OVER (PARTITION BY fo.paper_id ORDER BY p.a, p.b) AS i FROM fo JOIN p ON p.paper_id = fo.paper_id WHERE NOT list_contains(fo.gone, p.a) AND NOT list_contains(fo.gone, p.b)) WHERE i = 1),
z AS (SELECT paper_id, unnest(arg_max(went, len(went))) AS g FROM fo GROUP BY 1),
e AS (SELECT paper_id, ord, ord AS at_ FROM m UNION ALL SELECT e.paper_id, e.ord, z.g.t FROM e JOIN z ON z.paper_id = e.paper_id AND z.g.o = e.at_),
last_ AS (SELECT e.paper_id, e.ord, e.at_ FROM e LEFT JOIN z ON z.paper_id = e.paper_id AND z.g.o = e.at_ WHERE z.g IS NULL)
SELECT m.paper_id, m.id, t.id AS canonical FROM last_ JOIN m USING (paper_id, ord) JOIN m t ON t.paper_id = last_.paper_id AND t.ord = last_.at_"""


@query("kg_coref", COREF)
def kg_coref(spark, sf_dir):
    return graph.coreference(settled(graph.merge_nodes(_labelled(spark, sf_dir))))


# Answers with a node and an edge for each of six parts; ids come back for other labels, ends are missing, some answers cannot be read.
NODE = """concat('{"id": "x', p_partkey % 7, '", "label": "', CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END, '", "type": "', CASE p_partkey % 4 WHEN 0 THEN 'Method ' WHEN 1 THEN 'gadget' ELSE 'task' END, '", "description": "', repeat('d', CAST(p_partkey % 6 AS INT)), '", "confidence": 0.', p_partkey % 10, '}')"""
EDGE = """concat('{"source": "x', p_partkey % 7, '", "target": "x', p_partkey * 3 % 8, '", "relation": "', CASE WHEN p_partkey % 2 = 0 THEN 'uses' ELSE 'likes' END, '"}')"""
HEAD = """CASE WHEN batch % 5 = 3 OR paper_id % 9 = 4 THEN 'nothing {' ELSE concat('Here it is: ```json{"nodes": [', nodes, ', 7, {"id": "y"}], "edges": [', edges, ']}``` {}') END"""


def _answers(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey div 60 as paper_id", "cast(p_partkey div 6 % 10 as int) as batch", "p_partkey", f"{NODE} as node", f"{EDGE} as edge")

    def listed(column: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", column))), lambda x: x[column]), ", ")

    return rows.groupBy("paper_id", "batch").agg(listed("node").alias("nodes"), listed("edge").alias("edges")).selectExpr("paper_id", "batch", f"{HEAD} as response")


ANSWERS = f"""
WITH RECURSIVE raw AS (SELECT p_partkey // 60 AS paper_id, p_partkey // 6 % 10 AS batch, string_agg({NODE}, ', ' ORDER BY p_partkey) AS nodes, string_agg({EDGE}, ', ' ORDER BY p_partkey) AS edges FROM part GROUP BY ALL),
text AS (SELECT paper_id, batch, {HEAD} AS response FROM raw),
obj AS (SELECT paper_id, batch, CASE WHEN contains(response, '```json') THEN CAST(regexp_extract(response, '```json(.*?)```', 1) AS JSON) END AS o FROM text),
nd AS (SELECT paper_id, batch, unnest(CAST(o->'$.nodes' AS JSON[])) AS x, generate_subscripts(CAST(o->'$.nodes' AS JSON[]), 1) AS i FROM obj),
ed AS (SELECT paper_id, batch, unnest(CAST(o->'$.edges' AS JSON[])) AS x, generate_subscripts(CAST(o->'$.edges' AS JSON[]), 1) AS i FROM obj),
b AS (SELECT paper_id, batch, batch * 4294967296 + i - 1 AS ord, x->>'$.id' AS id, x->>'$.label' AS label, lower(trim(x->>'$.type')) AS t, x->>'$.description' AS description, CAST(x->>'$.confidence' AS DOUBLE) AS confidence FROM nd WHERE x->>'$.id' IS NOT NULL AND x->>'$.label' IS NOT NULL),
n AS (SELECT paper_id, batch, ord, id, label, CASE WHEN t IN ({", ".join(f"'{t}'" for t in graph.NODE_TYPES)}) THEN t ELSE 'concept' END AS type, description, '' AS section_path, '' AS evidence, confidence, CAST([] AS VARCHAR[]) AS aliases FROM b)
""" + FOLD


@query("answers_merged", ANSWERS + "SELECT paper_id, ord, id, label, type, description, confidence, array_to_string(aliases, '|') AS aliases FROM m")
def answers_merged(spark, sf_dir):
    nodes, _, _ = answers.build(_answers(spark, sf_dir))
    return nodes.select("paper_id", "ord", "id", "label", "type", "description", "confidence", F.array_join("aliases", "|").alias("aliases"))


@query("answers_linked", ANSWERS + """, went AS (SELECT n.paper_id, n.batch, n.id, arg_max(c.id, n.ord) AS at_ FROM n JOIN f USING (paper_id, ord) JOIN n c ON c.paper_id = n.paper_id AND c.ord = f.into_ GROUP BY ALL),
el AS (SELECT ed.paper_id, batch * 4294967296 + i - 1 AS ord, s.at_ AS source, t.at_ AS target, CASE WHEN x->>'$.relation' = 'uses' THEN 'uses' ELSE 'related_to' END AS relation
  FROM ed JOIN went s USING (paper_id, batch) JOIN went t USING (paper_id, batch) WHERE s.id = ed.x->>'$.source' AND t.id = ed.x->>'$.target')
SELECT paper_id, min(ord) AS ord, source, target, relation FROM el WHERE source != target GROUP BY ALL""")
def answers_linked(spark, sf_dir):
    return answers.build(_answers(spark, sf_dir))[1]


@query("answers_failed", ANSWERS + "SELECT paper_id FROM obj GROUP BY 1 HAVING count(o) = 0")
def answers_failed(spark, sf_dir):
    return answers.build(_answers(spark, sf_dir))[2]


@query("section_batches", """WITH l AS (SELECT doc_id AS paper_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)
SELECT paper_id, CAST(no // 6 AS INTEGER) AS batch, string_agg(line, chr(10) || chr(10) ORDER BY no) AS context FROM l GROUP BY ALL""")
def section_batches(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return answers.batches(lines)


# Calls of three actions, with nested payloads whose keys come in two orders, and some that are no JSON.
CALLS = (
    "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'verify' ELSE 'cite' END AS action", "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'm' END AS model",
    """CASE WHEN p_partkey % 11 = 0 THEN concat('no json {', p_size) WHEN p_partkey % 2 = 0 THEN concat('{"size": ', p_size, ', "in": {"a": [1, {"y": 2, "x": null}], "b": "', p_brand, '"}}') ELSE concat('{"in":{"b":"', p_brand, '","a":[1,{"x":null,"y":2}]},"size":', p_size, '}') END AS payload""",
)


@query("cached_calls", f"""WITH c AS (SELECT {", ".join(CALLS)}, p_size, p_brand FROM part),
k AS (SELECT *, CASE WHEN p_partkey % 11 != 0 THEN concat_ws('/', action, coalesce(model, ''), p_size, p_brand) END AS key FROM c),
w AS (SELECT *, coalesce(bool_or(p_partkey % 5 < 2) OVER (PARTITION BY key) AND p_size % 10 != 3 AND key IS NOT NULL, false) AS hit FROM k)
SELECT p_partkey, CASE WHEN key IS NULL THEN 'nothing' WHEN p_size % 10 != 3 THEN action || ' ' || p_size || p_brand END AS result, hit FROM w""")
def cached_calls(spark, sf_dir):
    """Some calls, then all: those whose content was asked before are not computed again, but for failures."""
    calls = table(spark, sf_dir, "part").selectExpr(*CALLS)
    size = F.get_json_object("payload", "$.size").cast("int")

    def compute(asked: DataFrame) -> DataFrame:
        result = F.coalesce(F.concat("action", F.lit(" "), size.cast("string"), F.get_json_object("payload", "$.in.b")), F.lit("nothing"))
        failed = F.coalesce(size % 10 == 3, F.lit(False))
        return asked.select("key", F.when(~failed, result).alias("result"), F.when(failed, F.lit("failed")).alias("error"))

    cache = caching.ResultCache(spark, shared_path(spark, "cache"))
    cache.through(calls.where("p_partkey % 5 < 2"), compute)
    return cache.through(calls, compute).select("p_partkey", "result", "hit")


# Sources made of parts that vary on their own, so that both engines must decide for each mix.
SOURCE = """CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://' WHEN 2 THEN ' http://www.' ELSE 'docs/' END || ['github.com', 'arxiv.org', 'example.org', 'notarxiv.org', 'export.arxiv.org', 'gitlab.com'][1 + p_size % 6] || CASE p_partkey % 5 WHEN 0 THEN '/a/b' WHEN 1 THEN '/a' WHEN 2 THEN '/abs/2101.0' || (1000 + p_size) || 'v2' WHEN 3 THEN '/x/*' ELSE '/c/d' END || ['', '.pdf', '.md', '.txt', '.git', ' '][1 + (p_partkey + p_size) % 6]"""
SOURCE_SQL = f"""WITH r AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN 'arXiv:2101.0' || (1000 + p_partkey % 9000) WHEN p_size = 8 THEN '2101.0' || (1000 + p_partkey % 9000) WHEN p_size = 9 THEN 'plain' ELSE {SOURCE} END AS source FROM part),
u AS (SELECT *, trim(source) AS s, regexp_matches(trim(source), '(?i)^https?://') AS url FROM r), h AS (SELECT *, CASE WHEN url THEN lower(regexp_extract(s, '^https?://([^/]+)', 1)) ELSE '' END AS host, CASE WHEN url THEN regexp_extract(s, '^https?://[^/]+(.*)$', 1) ELSE '' END AS path FROM u),
k AS (SELECT *, host = 'arxiv.org' OR ends_with(host, '.arxiv.org') AS arxiv, regexp_matches(s, '^\\d{{4}}\\.\\d{{4,5}}(v\\d+)?$') AS bare, regexp_matches(s, '^(?i:arxiv:)?\\d{{4}}\\.\\d{{4,5}}(v\\d+)?$') AS named, len(list_filter(string_split(path, '/'), lambda x: x != '')) AS parts FROM h)
SELECT p_partkey, CASE WHEN ends_with(s, '.git') OR starts_with(s, 'git@') OR (regexp_matches(host, '(^|\\.)(github\\.com|gitlab\\.com|bitbucket\\.org)$') AND parts >= 2 AND NOT ends_with(path, '.pdf')) THEN 'git'
  WHEN bare OR ends_with(lower(s), '.pdf') OR arxiv THEN 'pdf' WHEN NOT url AND regexp_matches(s, '[*?\\[]') THEN 'glob' WHEN NOT url AND ends_with(s, '.md') THEN 'markdown' WHEN url THEN 'url' WHEN regexp_matches(s, '\\.[A-Za-z0-9]+$') THEN 'text' ELSE 'unknown' END AS kind,
  CASE WHEN named THEN 'https://arxiv.org/pdf/' || regexp_replace(s, '(?i)^arxiv:', '') || '.pdf' WHEN arxiv AND regexp_matches(s, '\\d{{4}}\\.\\d{{4,5}}') THEN 'https://arxiv.org/pdf/' || regexp_extract(s, '(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1) || '.pdf' WHEN url THEN s ELSE source END AS address FROM k"""


@query("source_router", SOURCE_SQL)
def source_router(spark, sf_dir):
    made = SOURCE.replace("['github.com', 'arxiv.org', 'example.org', 'notarxiv.org', 'export.arxiv.org', 'gitlab.com'][1 + p_size % 6]", "element_at(array('github.com', 'arxiv.org', 'example.org', 'notarxiv.org', 'export.arxiv.org', 'gitlab.com'), 1 + p_size % 6)")
    made = made.replace("['', '.pdf', '.md', '.txt', '.git', ' '][1 + (p_partkey + p_size) % 6]", "element_at(array('', '.pdf', '.md', '.txt', '.git', ' '), cast(1 + (p_partkey + p_size) % 6 as int))")
    source = F.expr(f"case when p_size = 7 then concat('arXiv:2101.0', 1000 + p_partkey % 9000) when p_size = 8 then concat('2101.0', 1000 + p_partkey % 9000) when p_size = 9 then 'plain' else {made} end")
    return table(spark, sf_dir, "part").select("p_partkey", readers.source_kind(source).alias("kind"), readers.arxiv_pdf(source).alias("address"))


@query("gather_union_budget", f"""WITH {MD}, f AS (SELECT CAST(substr(source, 4) AS INTEGER) AS source_ord, source AS label, doc_id AS file_ord FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY source_ord, file_ord) AS place FROM f)
SELECT label, file_ord, '[' || label || '] Doc ' || file_ord AS section_path FROM n WHERE place <= 120""")
def gather_union_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("cast(substring(source, 4) as int) as source_ord", "source as label", "doc_id as file_ord", "'section' as kind", "concat('Doc ', doc_id) as section_path")
    return readers.gather(rows, 120)[0].select("label", "file_ord", "section_path")


@query("openalex_records", """SELECT p_partkey, 'openalex:https://openalex.org/W' || p_partkey AS record_id, p_name AS title,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_brand || '|' || p_type END AS authors, CASE WHEN p_partkey % 4 > 0 THEN 2000 + p_size END AS year,
  CASE WHEN p_partkey % 5 > 0 THEN 'Source ' || p_size END AS venue, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 2 = 0 THEN 'Source ' || p_size END AS journal,
  CASE WHEN p_partkey % 7 > 0 THEN array_to_string(list_transform(range(0, 1 + p_size % 6), lambda i: ['alpha', 'beta', 'gamma'][1 + (i * p_size) % 3]), ' ') END AS abstract FROM part""")
def openalex_records(spark, sf_dir):
    words = "transform(sequence(0, p_size % 6), i -> element_at(array('alpha', 'beta', 'gamma'), cast(1 + (i * p_size) % 3 as int)))"
    index = f"map_from_arrays(array_distinct({words}), transform(array_distinct({words}), w -> filter(sequence(0, p_size % 6), i -> element_at({words}, cast(i + 1 as int)) = w)))"
    raw = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        f"""to_json(named_struct('id', concat('https://openalex.org/W', p_partkey), 'display_name', p_name, 'publication_year', if(p_partkey % 4 > 0, 2000 + p_size, null),
        'authorships', case p_partkey % 3 when 0 then null when 1 then array(named_struct('author', named_struct('display_name', p_brand)), named_struct('author', named_struct('display_name', '')))
          else array(named_struct('author', named_struct('display_name', p_brand)), named_struct('author', named_struct('display_name', p_type))) end,
        'primary_location', if(p_partkey % 5 > 0, named_struct('source', named_struct('display_name', concat('Source ', p_size), 'type', if(p_partkey % 2 = 0, 'journal', 'repository'))), null),
        'abstract_inverted_index', if(p_partkey % 7 > 0, {index}, null))) as raw""",
    )
    return readers.openalex_records(raw).select("p_partkey", "record_id", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "journal", "abstract")


@query("crossref_records", """SELECT p_partkey, 'crossref:' || CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'http://x/' || p_partkey ELSE '10.1/' || p_partkey END AS record_id, p_name AS title,
  CASE WHEN p_partkey % 2 = 0 THEN 'Ann ' || p_brand ELSE p_brand END AS author, CASE WHEN p_partkey % 7 > 0 THEN 2000 + p_size END AS year,
  CASE WHEN p_partkey % 7 > 0 THEN (2000 + p_size) || CASE WHEN p_partkey % 2 = 0 THEN '-05-09' ELSE '-01-01' END END AS publication_date,
  'Journal ' || p_size AS venue, CASE WHEN p_partkey % 2 = 0 THEN 'Journal ' || p_size END AS journal, CAST(CASE WHEN p_partkey % 5 > 0 THEN p_size END AS BIGINT) AS citation_count, 'a < b & "c" café’s — &lt; ' || p_size AS abstract FROM part""")
def crossref_records(spark, sf_dir):
    date = "named_struct('date-parts', array(if(p_partkey % 2 = 0, array(2000 + p_size, 5, 9), array(2000 + p_size))))"
    raw = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        f"""to_json(named_struct('DOI', if(p_partkey % 3 = 2, concat('10.1/', p_partkey), null), 'URL', if(p_partkey % 3 = 0, null, concat('http://x/', p_partkey)), 'title', array('', p_name),
        'container-title', array(concat('Journal ', p_size)), 'type', if(p_partkey % 2 = 0, 'Journal-Article', 'posted'), 'is-referenced-by-count', if(p_partkey % 5 > 0, p_size, null),
        'author', array(named_struct('given', if(p_partkey % 2 = 0, ' Ann ', null), 'family', p_brand)),
        'published-print', named_struct('date-parts', array(array(cast(null as int)))), 'issued', if(p_partkey % 7 > 0, {date}, null),
        'abstract', concat('<jats:p>a &lt; b &amp;  &quot;c&quot;</jats:p> caf&eacute;&#8217;s&nbsp; &#x2014; &amp;lt; ', p_size)), map('ignoreNullFields', 'false')) as raw""",
    )
    rows = readers.crossref_records(raw)
    return rows.select("p_partkey", "record_id", "title", F.get("authors", F.lit(0)).alias("author"), "year", "publication_date", "venue", "journal", "citation_count", "abstract")
