"""Queries of the repairs of extracted markdown, each beside its SQL.

Their texts are made of the words of ``documents``: every four words fill one
of some templates, chosen by a number that mixes the document's and the
place's, in the same way in both engines. So whatever a repair looks for
comes in all orders, beside all that it must leave alone.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions.lines import let
from foliate.operators import equations, headings, joining, markdown, passes, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "| {a} | {b} |", "| {a} | {b} | {c} |", "{a} | {b}", "| --- | :-: |", "", "{a} {b}", "| {c} | {d} |", "- {a} | {b}", "see `{a} | {b}` and {c}", "|{a}|", "$ {a} | {b} $ and {c} \\mid {d}", "| {b} | {a} |", "| {c} | {d} | {a} | {b} |",
    "  {a} |{b}|{c}", "```", "|---|---|", "{a} | {b} |", "| {a} | | {b} |", "", "| {d} | `x|y` |", "{c}", "1. {a} | {b}", "| {a} |  |",
)
HEADINGS = (
    "{n}. INTRODUCTION {a}", "{n}.{m} Results of Everything", "{n}.{m}.{n}.{m}.1.2 Deep Part", "{n}. We use the method of {a}", "{n} Related Work.", "{n}. First:", "{n}. First", "{n}. Second", "IV. METHODS", "XXI. Too Many", "VIII. the lower", "", "{a} {b}.",
    "- {n}) Setup of {a}:", "- {n}) {a}", "- {n}. Titled:", "{n}.{m} Method. The {a} goes on", "{n}. Short Name. And {b} follows. It does", "# Kept {n}. Title", "Abstract - {a}", "  {n}.{m} Indented Title  ", "II. A {b} C {d} e", "index terms — {a} {b}",
    "", "- {a}", "{n}. {a}, {b}", "XX. LAST ONE.", "", "* {a}",
)
EQUATIONS = (
    "so $x _ {{ {a} }} ^ 2$ and $1 0 0 {n}$ hold", "in 1 0 0 0 cases {a} _ {b}", "$$ \\ frac {{ {n} }} {{ 2 }} + d _ {{ k }} $$", "", "{a} {b}", "$$", "a _ 1 \\\\", "b ^ {{ {n} }}", "cost $5 and {a}", "<!-- formula-not-decoded -->", "<!--FORMULA-NOT-DECODED-->",
    "M u l t i H e a d ( {a} ) = p _ {{ d a t a }}", "{c} \\ sqrt {d}", "$$y _ {n}$$", "$$\\begin{{cases}} 1 \\\\\n2 3\\end{{cases}}$$", "{a}", "{b} $ {c} $",
)
JOINING = ("{a} of the exam-", "ple {b}", "well-known {a}", "{a} goes on", "", "", "# head-", "| {a}-", "({b}) then", "Figure {n} shows", "{a} ends.", "- item-", "Upper {b}", "x{c} {d}", "```", "to{a}--", "{d} to-  ", "  then {c}  ", "", "{a} {b} {c}", "{n}. item", "small and", "fig trees")
BIBLIOGRAPHY = ("[{n}] {a}", "[{m}] {b} {c}", "  - [{n}] {d}", "more of {a}", "", "free text {b}", '<a id="ref-{n}"></a>[{n}] {c}', "see [{m}]", "[{n}] {a}", "   ", "[1234] {d}", "")
MIXED = (*TABLES[:14], "{n}. INTRODUCTION {a}", "", "{n}.{m} Results of Everything", "so $x _ {{ {a} }}$ as in [{m}]", "", "{a} ﬁnds {b} – {c}", "$$y _ {n}$$", "", "<!-- image -->", "glyph[alpha] {a} GLYPH<12>  ", "IV. METHODS", "", "", "")


#: All but letters, digits and some signs; they are listed, since a class of ranges is several times slower.
NO_WORDS = f"[^{string.ascii_letters}{string.digits} .,;-]+"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def planted(spark: SparkSession, sf_dir: str, templates: tuple[str, ...]) -> DataFrame:
    """(paper_id, markdown): the words of each document in the templates, a line for every four of them."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("paper_id"), "text")
    documents = documents.withColumn("w", F.split(F.regexp_replace("text", NO_WORDS, " "), " "))

    def filled(template: str, i: Column) -> Column:
        """The template from its pieces, so that no line is searched for what is to be put in."""
        values = {"n": ((i % 7) + 1).cast("string"), "m": ((i % 5) + 2).cast("string")}
        values |= {name: F.coalesce(F.get("w", (i * 4 + j).cast("int")), F.lit("")) for j, name in enumerate("abcd")}
        pieces = re.split(r"\{([abcdnm])\}", template.replace("{{", "{").replace("}}", "}"))
        return F.concat(*(values[x] if at % 2 else F.lit(x) for at, x in enumerate(pieces) if at % 2 or x or len(pieces) == 1))

    def chosen(k: Column, first: int, until: int, i: Column) -> Column:
        if until - first == 1:
            return filled(templates[first], i)
        middle = (first + until) // 2
        return F.when(k < middle, chosen(k, first, middle, i)).otherwise(chosen(k, middle, until, i))

    def line(i: Column) -> Column:
        k = (F.col("paper_id") * 31 + i * i * 7 + i * 13 + (F.col("paper_id") % 7) * i + F.floor(i / 5)) % len(templates)
        return let(k.cast("int"), lambda k: F.when(k >= 0, chosen(k, 0, len(templates), i)))

    lines = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 4).cast("int") - 1), line)
    return documents.select("paper_id", F.array_join(lines, "\n").alias("markdown"))


def source(templates: tuple[str, ...]) -> str:
    """SQL of ``planted``, as t0 (paper_id, x)."""
    choice = ", ".join("'" + t.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'" for t in templates)
    out = f"([{choice}])[1 + (paper_id * 31 + i * i * 7 + i * 13 + (paper_id % 7) * i + i // 5) % {len(templates)}]"
    for j, name in enumerate("abcd"):
        out = f"replace({out}, '{{{name}}}', coalesce(w[i * 4 + {j + 1}], ''))"
    out = f"replace(replace({out}, '{{n}}', CAST(i % 7 + 1 AS VARCHAR)), '{{m}}', CAST(i % 5 + 2 AS VARCHAR))"
    return f"""w0 AS (SELECT doc_id AS paper_id, string_split(regexp_replace(text, '[^A-Za-z0-9 .,;-]+', ' ', 'g'), ' ') AS w FROM documents),
t0 AS (SELECT paper_id, array_to_string(list_transform(range(0, CAST(ceil(len(w) / 4) AS BIGINT)), lambda i: {out}), chr(10)) AS x FROM w0)"""


def lines_of(t: str, out: str) -> str:
    return f"{out} AS (SELECT paper_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS no FROM {t})"


def span_rewrite(x: str, pattern: str, change: str) -> str:
    """SQL of x with the spans s that match rewritten."""
    return f"array_to_string(list_transform(range(1, len(string_split_regex({x}, '{pattern}')) + 1), lambda i: string_split_regex({x}, '{pattern}')[i] || coalesce(list_transform([regexp_extract_all({x}, '{pattern}')[i]], lambda s: {change})[1], '')), '')"


def tables_sql(t: str, out: str) -> str:
    """SQL of the repair of tables: lines in islands, islands that are tables, rows of a table."""
    p, doc = out, "PARTITION BY paper_id ORDER BY no"
    cells = lambda x: f"list_transform(string_split(regexp_replace(regexp_replace(trim({x}), '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c))"
    mark = lambda x: f"len(list_filter({x}, lambda c: NOT regexp_matches(c, '^:?-+:?$'))) = 0"
    return f"""{lines_of(t, f"{p}l")},
{p}f AS (SELECT *, starts_with(trim(line), '```') AS fence, sum(CAST(starts_with(trim(line), '```') AS INT)) OVER ({doc}) AS fences,
  replace(regexp_replace(regexp_replace(line, '`[^`]*`', ' ', 'g'), '\\$[^$]*\\$', ' ', 'g'), '\\mid', ' ') AS bare FROM {p}l),
{p}k AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'f' WHEN trim(line) = '' THEN 'b'
  WHEN contains(bare, '|') AND NOT regexp_matches(line, '^\\s*(?:[-*+>]\\s|\\d+[.)]\\s)') THEN 'p' ELSE 'o' END AS kind FROM {p}f),
{p}m AS (SELECT *, lag(kind) OVER ({doc}) AS b4, lead(kind) OVER ({doc}) AS af, lead(line) OVER ({doc}) AS below FROM {p}k),
{p}i AS (SELECT *, kind = 'p' OR (kind != 'f' AND b4 = 'p' AND af = 'p') IS TRUE AS inner_ FROM {p}m),
{p}s AS (SELECT *, sum(CAST(NOT inner_ AS INT)) OVER ({doc}) AS isle FROM {p}i),
{p}c AS (SELECT *, {cells("bare")} AS masked, {cells("line")} AS cells, lead(inner_) OVER ({doc}) AS more FROM {p}s),
{p}g AS (SELECT *, kind = 'p' AND {mark("masked")} AS sep, sum(CAST(kind = 'b' AS INT)) OVER (PARTITION BY paper_id, isle ORDER BY no) AS part FROM {p}c WHERE inner_),
{p}w AS (SELECT paper_id, isle, part, sum(CAST(kind = 'p' AS INT)) AS n, sum(CAST(sep AS INT)) AS seps, sum(CAST(kind = 'p' AND NOT sep AND len(masked) >= 2 AS INT)) AS wide FROM {p}g GROUP BY ALL),
{p}t AS (SELECT paper_id, isle FROM {p}w GROUP BY ALL HAVING (sum(seps) > 0 AND sum(seps) < sum(n)) OR max(wide) >= 2),
{p}r AS (SELECT paper_id, no, isle, row_number() OVER (PARTITION BY paper_id, isle ORDER BY no) - 1 AS r,
  CASE WHEN af = 'o' AND more THEN cells[:-2] || [CASE WHEN cells[-1] != '' THEN cells[-1] || ' ' || trim(below) ELSE trim(below) END] ELSE cells END AS cells FROM {p}g JOIN {p}t USING (paper_id, isle) WHERE kind = 'p'),
{p}e AS (SELECT *, min(CASE WHEN r < 2 AND {mark("cells")} THEN r END) OVER (PARTITION BY paper_id, isle) AS sp FROM {p}r),
{p}x AS (SELECT *, greatest(1, coalesce(max(CASE WHEN r IS DISTINCT FROM sp THEN len(cells) END) OVER (PARTITION BY paper_id, isle), 0)) AS width FROM {p}e),
{p}y AS (SELECT paper_id, no, '| ' || array_to_string(list_transform(range(0, width), lambda j: '---'), ' | ') || ' |' AS rule,
  '| ' || array_to_string(cells || list_transform(range(0, width - len(cells)), lambda j: ''), ' | ') || ' |' AS row, r, sp FROM {p}x),
{p}o AS (SELECT l.paper_id, l.no, CASE WHEN y.no IS NULL THEN l.line WHEN y.r = y.sp THEN y.rule WHEN y.r = 0 AND y.sp IS NULL THEN y.row || chr(10) || y.rule ELSE y.row END AS line
  FROM {p}i l LEFT JOIN {p}y y ON y.paper_id = l.paper_id AND y.no = l.no LEFT JOIN {p}g g ON g.paper_id = l.paper_id AND g.no = l.no LEFT JOIN {p}t t ON t.paper_id = g.paper_id AND t.isle = g.isle
  WHERE y.no IS NOT NULL OR t.paper_id IS NULL),
{out} AS (SELECT paper_id, string_agg(line, chr(10) ORDER BY no) AS x FROM {p}o GROUP BY paper_id)"""


def headings_sql(t: str, out: str) -> str:
    """SQL of the headings: texts, then lines with their neighbours, three times."""
    p, doc = out, "PARTITION BY paper_id ORDER BY no"
    title = lambda x: f"(length({x}) <= 120 AND NOT regexp_matches({x}, '[:,;]\\s*$') AND len(regexp_extract_all({x}, '\\. ')) <= 1 AND len(list_filter(string_split_regex({x}, '\\s+'), lambda v: regexp_matches(v, '^[a-z]'))) < 2)"
    head = lambda n, x: f"repeat('#', least(6, 2 + len({n}) - len(replace({n}, '.', '')))) || ' ' || {n} || CASE WHEN contains({n}, '.') THEN '' ELSE '.' END || ' ' || {x}"
    alone, inline = "^(\\d+(?:\\.\\d+)*)\\.?\\s+([A-Z][^.]+?)\\.?\\s*$", "^(\\d+(?:\\.\\d+)*)\\.?\\s+([A-Z][^.]{2,50})\\.\\s+(.+)$"
    roman = f"({'|'.join(('XVIII', 'VIII', 'XIII', 'XVII', 'III', 'VII', 'XII', 'XIV', 'XVI', 'XIX', 'II', 'IV', 'VI', 'IX', 'XI', 'XV', 'XX', 'I', 'V', 'X'))})"
    return f"""{p}a AS (SELECT paper_id, regexp_replace(regexp_replace(x, '(?im)^(?:#+\\s*)?Abstract\\s*[-–—]\\s*', '## Abstract' || chr(10) || chr(10)), '(?im)^(?:#+\\s*)?Index Terms\\s*[-–—]\\s*', '## Index Terms' || chr(10) || chr(10)) AS x FROM {t}),
{lines_of(f"{p}a", f"{p}l")},
{p}n AS (SELECT *, trim(line) AS s, regexp_extract(trim(line), '{alone}', 1) AS n1, trim(regexp_extract(trim(line), '{alone}', 2)) AS t1, regexp_extract(trim(line), '{inline}', 1) AS n2, trim(regexp_extract(trim(line), '{inline}', 2)) AS t2,
  trim(regexp_extract(trim(line), '{inline}', 3)) AS rest, lag(line) OVER ({doc}) AS b4, lead(line) OVER ({doc}) AS af FROM {p}l),
{p}h AS (SELECT paper_id, no, CASE WHEN n1 != '' AND (contains(n1, '.') OR NOT (regexp_matches(trim(coalesce(b4, '')), '^\\d+\\.?\\s+\\S') OR regexp_matches(trim(coalesce(af, '')), '^\\d+\\.?\\s+\\S'))) AND {title("t1")}
    THEN {head("n1", "t1")} || CASE WHEN trim(coalesce(af, '')) != '' THEN chr(10) ELSE '' END
  WHEN n2 != '' AND length(t2) <= 60 AND {title("t2")} THEN {head("n2", "t2")} || chr(10) || chr(10) || rest ELSE line END AS line FROM {p}n),
{p}b AS (SELECT paper_id, string_agg(line, chr(10) ORDER BY no) AS x FROM {p}h GROUP BY paper_id),
{lines_of(f"{p}b", f"{p}m")},
{p}r AS (SELECT paper_id, no, regexp_extract(trim(line), '^{roman}\\.\\s+([A-Z][^.]+?)\\.?\\s*$', 1) AS n, trim(regexp_extract(trim(line), '^{roman}\\.\\s+([A-Z][^.]+?)\\.?\\s*$', 2)) AS t, line FROM {p}m),
{p}q AS (SELECT paper_id, no, CASE WHEN n != '' AND {title("t")} THEN '## ' || n || '. ' || t ELSE line END AS line FROM {p}r),
{p}w AS (SELECT *, trim(first_value(CASE WHEN trim(line) != '' THEN line END IGNORE NULLS) OVER ({doc} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS nx FROM {p}q),
{p}z AS (SELECT paper_id, no, CASE WHEN regexp_matches(line, '^-\\s*(\\d+[).])\\s*(.+):\\s*$') AND nx IS NOT NULL AND NOT regexp_matches(nx, '^[-*•]\\s') AND NOT regexp_matches(nx, '^\\d+[).]\\s')
  THEN regexp_replace(line, '^-\\s*(\\d+[).])\\s*(.+):\\s*$', '### \\1 \\2') || chr(10)
  WHEN regexp_matches(line, '^-\\s*(\\d+)\\)\\s*(.+)$') THEN regexp_replace(line, '^-\\s*(\\d+)\\)\\s*(.+)$', '\\1. \\2') ELSE line END AS line FROM {p}w),
{out} AS (SELECT paper_id, string_agg(line, chr(10) ORDER BY no) AS x FROM {p}z GROUP BY paper_id)"""


def equations_sql(t: str, out: str) -> str:
    """SQL of the formulas: spans cut out and put back, then lines."""
    p, doc, commands = out, "PARTITION BY paper_id ORDER BY no", "frac|sqrt|sum|prod|int|partial|nabla|begin|end|left|right|text"
    # digits are joined twice, since a pattern without a look behind takes both
    tight = lambda n: f"s[1:{n}] || regexp_replace(regexp_replace(regexp_replace(regexp_replace(s[{n + 1}:-{n + 1}], '\\s*([_^])\\s*', '\\1', 'g'), '\\s*([{{}}])\\s*', '\\1', 'g'), '(\\d)\\s+(\\d)', '\\1\\2', 'g'), '(\\d)\\s+(\\d)', '\\1\\2', 'g') || s[1:{n}]"
    body = "regexp_replace(s[3:-3], '^\\n+|\\n+$', '', 'g')"
    wrap = f"CASE WHEN regexp_matches({body}, '\\\\\\\\\\s*\\n') AND NOT contains({body}, 'aligned') AND NOT contains({body}, '\\begin') THEN '$$' || chr(10) || '\\begin{{aligned}}' || chr(10) || {body} || chr(10) || '\\end{{aligned}}' || chr(10) || '$$' ELSE s END"
    wrap = wrap.replace("{{", "{").replace("}}", "}")
    return f"""{p}a AS (SELECT paper_id, regexp_replace(x, '(?i)<!--\\s*formula-not-decoded\\s*-->', '*[Formula - see original PDF]*', 'g') AS x FROM {t}),
{p}b AS (SELECT paper_id, {span_rewrite("x", "(?s)\\$\\$.+?\\$\\$", tight(2))} AS x FROM {p}a),
{p}c AS (SELECT paper_id, {span_rewrite("x", "\\$[^$\\n]+?\\$", tight(1))} AS x FROM {p}b),
{p}d AS (SELECT paper_id, regexp_replace(x, '\\\\\\s+({commands})', '\\\\\\1', 'g') AS x FROM {p}c),
{p}e AS (SELECT paper_id, {span_rewrite("x", "(?s)\\$\\$.*?\\$\\$", wrap)} AS x FROM {p}d),
{lines_of(f"{p}e", f"{p}l")},
{p}g AS (SELECT *, trim(line) AS s, lag(line) OVER ({doc}) AS b4 FROM {p}l),
{p}h AS (SELECT paper_id, no, CASE WHEN (s = '$$' OR (starts_with(s, '$$') AND ends_with(s, '$$') AND length(s) > 2)) AND trim(coalesce(b4, '')) != '' THEN chr(10) || line ELSE line END AS line FROM {p}g),
{out} AS (SELECT paper_id, string_agg(line, chr(10) ORDER BY no) AS x FROM {p}h GROUP BY paper_id)"""


def bibliography_sql(t: str, out: str) -> str:
    p, doc = out, "PARTITION BY paper_id ORDER BY no"
    return f"""{lines_of(t, f"{p}l")},
{p}h AS (SELECT *, min(CASE WHEN regexp_matches(line, '^## References\\s*$') THEN no END) OVER (PARTITION BY paper_id) AS head, sum(CAST(trim(line) = '' AS INT)) OVER ({doc}) AS gaps FROM {p}l),
{p}e AS (SELECT *, no > head AND regexp_matches(line, '^\\s*(?:<a[^>]*></a>)?(?:-\\s*)?\\[(\\d{{1,3}})\\]') AS entry FROM {p}h),
{p}c AS (SELECT *, sum(CAST(entry IS TRUE AS INT)) OVER (PARTITION BY paper_id, gaps ORDER BY no) AS entries FROM {p}e),
{out} AS (SELECT paper_id, string_agg(CASE WHEN entry AND entries > 1 THEN chr(10) || line ELSE line END, chr(10) ORDER BY no) AS x FROM {p}c GROUP BY paper_id)"""


def steps_sql(t: str, out: str, kinds: str, take: str, joined: str) -> str:
    """SQL of a fold over lines: at each line ``take`` lines are taken, as ``joined`` or as they are; ``kinds`` adds columns to the lines."""
    p = out
    return f"""{lines_of(t, f"{p}l")},
{p}k AS ({kinds.replace("LINES", f"{p}l")}),
{p}n AS (SELECT *, {take} AS n FROM {p}k),
{p}w AS (SELECT paper_id, 1 AS no FROM {p}n WHERE no = 1 UNION ALL SELECT w.paper_id, CAST(w.no + n.n AS INTEGER) FROM {p}w w JOIN {p}n n ON n.paper_id = w.paper_id AND n.no = w.no),
{out} AS (SELECT n.paper_id, string_agg(CASE WHEN n > 1 THEN {joined} ELSE line END, chr(10) ORDER BY n.no) AS x FROM {p}n n JOIN {p}w w ON w.paper_id = n.paper_id AND w.no = n.no GROUP BY n.paper_id)"""


def hyphens_sql(t: str, out: str) -> str:
    doc = "PARTITION BY paper_id ORDER BY no"
    kinds = f"""SELECT *, lead(line) OVER ({doc}) AS one, lead(line, 2) OVER ({doc}) AS two, lead(guard) OVER ({doc}) AS g1, lead(guard, 2) OVER ({doc}) AS g2 FROM
  (SELECT *, regexp_matches(line, '^\\s*[#|]') OR starts_with(trim(line), '```') OR sum(CAST(starts_with(trim(line), '```') AS INT)) OVER ({doc}) % 2 = 1 AS guard FROM LINES)"""
    ends = "NOT guard AND regexp_matches(line, '\\w-\\s*$')"
    take = f"CASE WHEN {ends} AND trim(one) != '' AND NOT g1 AND regexp_matches(one, '^\\s*[a-z]') THEN 2 WHEN {ends} AND trim(one) = '' AND NOT g2 AND regexp_matches(two, '^\\s*[a-z]') THEN 3 ELSE 1 END"
    rest = "trim(CASE WHEN n = 2 THEN one ELSE two END)"
    return steps_sql(t, out, kinds, take, f"rtrim(rtrim(line), '-') || CASE WHEN regexp_matches({rest}, '^[a-z]\\w*-') THEN '-' ELSE '' END || {rest}")


def paragraphs_sql(t: str, out: str) -> str:
    doc = "PARTITION BY paper_id ORDER BY no"
    plain = lambda x: f"trim({x}) != '' AND NOT regexp_matches(trim({x}), '^(?:[#*|-]|!\\[|\\d+[.)]\\s)')"
    kinds = f"SELECT *, lead(line) OVER ({doc}) AS one, lead(line, 2) OVER ({doc}) AS two FROM LINES"
    take = f"CASE WHEN {plain('line')} AND NOT regexp_matches(rtrim(line), '[.!?:;\")>]$') AND trim(one) = '' AND {plain('two')} AND NOT regexp_matches(trim(two), '^(?:Fig|Figure|Table)\\b') AND regexp_matches(trim(two), '^[a-z(]') THEN 3 ELSE 1 END"
    return steps_sql(t, out, kinds, take, "rtrim(line) || ' ' || trim(two)")


def done(*parts: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} SELECT paper_id, x AS markdown FROM t1"


def _changed(spark: SparkSession, sf_dir: str, templates: tuple[str, ...], change) -> DataFrame:
    return planted(spark, sf_dir, templates).select("paper_id", change(F.col("markdown")).alias("markdown"))


@query("repair_tables", done(source(TABLES), tables_sql("t0", "t1")))
def repair_tables(spark, sf_dir):
    return _changed(spark, sf_dir, TABLES, tables.repair_tables)


@query("rebuild_headings", done(source(HEADINGS), headings_sql("t0", "t1")))
def rebuild_headings(spark, sf_dir):
    return _changed(spark, sf_dir, HEADINGS, headings.rebuild_headings)


@query("repair_equations", done(source(EQUATIONS), equations_sql("t0", "t1")))
def repair_equations(spark, sf_dir):
    return _changed(spark, sf_dir, EQUATIONS, equations.repair_equations)


@query("join_hyphens", done(source(JOINING), hyphens_sql("t0", "t1")))
def join_hyphens(spark, sf_dir):
    return _changed(spark, sf_dir, JOINING, joining.join_hyphens)


@query("join_paragraphs", done(source(JOINING), paragraphs_sql("t0", "t1")))
def join_paragraphs(spark, sf_dir):
    return _changed(spark, sf_dir, JOINING, joining.join_paragraphs)


HEAD = "One line [7] before.\n## References\n"


@query("space_bibliography", done(source(BIBLIOGRAPHY), "s0 AS (SELECT paper_id, 'One line [7] before.' || chr(10) || '## References' || chr(10) || x AS x FROM t0)", bibliography_sql("s0", "t1")))
def space_bibliography(spark, sf_dir):
    return _changed(spark, sf_dir, BIBLIOGRAPHY, lambda t: markdown.space_bibliography(F.concat(F.lit(HEAD), t)))


MORE = "\n## References\n[1] One\n[2] Two\nof two\n\n[3] Three\n"


@query("process_markdown", done(
    source(MIXED), "s0 AS (SELECT paper_id, x || '" + MORE.replace("\n", "' || chr(10) || '") + "' AS x FROM t0)", headings_sql("s0", "h1"),
    """c1 AS (SELECT paper_id, instr(x, chr(10) || '## References' || chr(10)) AS pos, x FROM h1),
c2 AS (SELECT paper_id, regexp_replace(x[1:pos], '\\[(\\d{1,3})\\]', '[[\\1]](#ref-\\1)', 'g') || regexp_replace(x[pos + 1:], '(?m)^(\\s*)\\[(\\d{1,3})\\]', '\\1<a id="ref-\\2"></a>[\\2]', 'g') AS x FROM c1)""",
    equations_sql("c2", "e1"), bibliography_sql("e1", "b1"), tables_sql("b1", "g1"),
    """k1 AS (SELECT paper_id, array_to_string(list_filter(string_split(x, chr(10)), lambda l: trim(l) != '<!-- image -->'), chr(10)) AS x FROM g1),
k2 AS (SELECT paper_id, regexp_replace(regexp_replace(replace(replace(replace(x, 'ﬁ', 'fi'), '–', '-'), 'glyph[alpha]', 'α'), 'GLYPH<\\d+>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS x FROM k1),
t1 AS (SELECT paper_id, regexp_replace(x, '[ \\t]+(\\n|$)', '\\1', 'g') AS x FROM k2)""",
))
def process_markdown(spark, sf_dir):
    """All passes in their order, over papers that end in references."""
    papers = planted(spark, sf_dir, MIXED).select("paper_id", F.concat("markdown", F.lit(MORE)).alias("markdown"))
    return passes.process(papers)
