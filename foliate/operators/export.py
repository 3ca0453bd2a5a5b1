"""Text for other readers: LaTeX, Mermaid graphs, merged context, and small renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.text import strip

# LaTeX commands of the signs that need one, of header levels, and the styles of node types in a graph.
COMMANDS = {"\\": "\\textbackslash{}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}
LEVELS = {1: "section", 2: "section", 3: "subsection", 4: "subsubsection", 5: "paragraph", 6: "subparagraph"}
STYLES = {
    "method": "fill:#cfe2ff,stroke:#1f3a5f,color:#000",
    "concept": "fill:#e9ecef,stroke:#495057,color:#000",
    "dataset": "fill:#d1e7dd,stroke:#0f5132,color:#000",
    "metric": "fill:#fff3cd,stroke:#997404,color:#000",
    "claim": "fill:#f8d7da,stroke:#842029,color:#000",
    "result": "fill:#e2d9f3,stroke:#59359a,color:#000",
    "task": "fill:#cff4fc,stroke:#055160,color:#000",
}
#: Edges that a drawn graph shows unless told otherwise.
MOST_EDGES = 500
NUMBER = r"^\d+(\.\d+)*\.?\s*"


def latex_escape(text: Column) -> Column:
    """Plain text with LaTeX's special signs escaped, each once: signs that become commands wait as control signs until braces are done."""
    held = F.translate(text, "".join(COMMANDS), "\x01\x02\x03")
    plain = F.regexp_replace(held, r"([&%$#_{}])", r"\\$1")
    for held_sign, command in zip("\x01\x02\x03", COMMANDS.values(), strict=True):
        plain = F.replace(plain, F.lit(held_sign), F.lit(command))
    return plain


def latex_inline(text: Column) -> Column:
    """Escaped text with reference marks, links, code, bold and italics turned to LaTeX."""
    out = latex_escape(text)
    for pattern, to in (
        (r"\[\[(\d+)\]\]\(\\?#ref(?:-|\\?_)\d+\)", "[$1]"),
        (r"\[([^\]]+)\]\(([^)]+)\)", "$1"),
        (r"`(.+?)`", r"\\texttt{$1}"),
        (r"\*\*(.+?)\*\*", r"\\textbf{$1}"),
        (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", r"\\textit{$1}"),
        (r"\\_(.+?)\\_", r"\\textit{$1}"),
    ):
        out = F.regexp_replace(out, pattern, to)
    return out


def latex(lines: DataFrame) -> DataFrame:
    """The LaTeX of each paper's markdown, from its lines (paper_id, line_no, line).

    Lines of one kind that follow each other without a blank line are an
    island: a paragraph, a list, or one header. Islands are joined by blank
    lines in their order.
    """
    order = Window.partitionBy("paper_id").orderBy("line_no")
    line = strip(F.regexp_replace("line", "\r$", ""))
    header, bullet, item = line.rlike(r"^#{1,6}\s+"), line.rlike(r"^[-*]\s+"), line.rlike(r"^\d+\.\s+")
    kind = F.when(line == "", "blank").when(header, "header").when(bullet, "itemize").when(item, "enumerate").otherwise("text")
    rows = lines.select("paper_id", "line_no", line.alias("line"), kind.alias("kind"))
    begins = (F.col("kind") == "header") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    rows = rows.withColumn("island", F.sum(begins.cast("int")).over(order)).where("kind != 'blank'")
    content = F.when(F.col("kind") == "header", F.regexp_replace(F.regexp_replace("line", r"^#{1,6}\s+", ""), NUMBER, "")).when(F.col("kind") == "itemize", F.regexp_replace("line", r"^[-*]\s+", "")).when(F.col("kind") == "enumerate", F.regexp_replace("line", r"^\d+\.\s+", "")).otherwise(F.col("line"))
    level = F.length(F.regexp_extract("line", "^(#{1,6})", 1))
    islands = rows.groupBy("paper_id", "island", "kind").agg(F.max(level).alias("level"), F.array_sort(F.collect_list(F.struct("line_no", strip(content).alias("t")))).alias("ls"))
    texts = F.transform("ls", lambda x: x["t"])
    # list items are rendered one by one, a paragraph as a whole
    listed = F.concat(F.lit("\\begin{"), "kind", F.lit("}\n\n"), F.array_join(F.transform(texts, lambda t: F.concat(F.lit("  \\item "), latex_inline(t))), "\n\n"), F.lit("\n\n\\end{"), "kind", F.lit("}"))
    whole = latex_inline(F.array_join(texts, " "))
    command = F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.col("level"))
    rendered = F.when(F.col("kind") == "header", F.concat(F.lit("\\"), command, F.lit("{"), whole, F.lit("}"))).when(F.col("kind") == "text", whole).otherwise(listed)
    parts = islands.select("paper_id", "island", rendered.alias("r")).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("island", "r"))).alias("rs"))
    return parts.select("paper_id", F.array_join(F.filter(F.transform("rs", lambda x: x["r"]), lambda r: r != ""), "\n\n").alias("latex"))


def without_own_header(body: Column, title: Column) -> Column:
    """A section's body without a leading header that repeats its title, numbering and case aside."""
    bare = F.regexp_replace(body, "^\n+", "")
    first = F.trim(F.regexp_extract(bare, r"^([^\n]*)", 1))
    told = F.lower(F.regexp_replace(F.trim(F.regexp_replace(first, "^#+", "")), NUMBER, ""))
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^\n]*", ""), "^\n+", "")
    return F.when(first.startswith("#") & (told == F.lower(F.trim(title))), rest).otherwise(bare)


def mermaid(nodes: DataFrame, edges: DataFrame, most_edges: int | None = MOST_EDGES) -> DataFrame:
    """A drawing of each paper's graph: styles, nodes, edges. Beyond ``most_edges`` only the first edges and their nodes are drawn, with a note; 0 or none draws all."""
    clean = lambda c: F.trim(F.translate(c, '"[]\n', "'() "))
    named = F.regexp_replace(F.regexp_replace("id", r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    totals = edges.groupBy("paper_id").agg(F.count(F.lit(1)).alias("_all"))
    shown = edges
    if most_edges and most_edges > 0:
        shown = edges.withColumn("_at", F.row_number().over(Window.partitionBy("paper_id").orderBy("ord"))).where(F.col("_at") <= most_edges).drop("_at")
    ends = shown.select("paper_id", F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_end", F.lit(True))
    cap = F.lit(most_edges if most_edges and most_edges > 0 else None).cast("long")
    cut = F.coalesce(F.col("_all") > cap, F.lit(False))
    kept = nodes.join(totals, "paper_id", "left").join(ends, ["paper_id", "id"], "left").where(~cut | F.col("_end"))

    def ident(c: str) -> Column:
        safe = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
        return F.when(safe != "", safe).otherwise("n")

    suffix = F.when(F.col("type").isin(*STYLES), F.concat(F.lit(":::"), "type")).otherwise("")
    node = F.concat(F.lit("    "), F.when(named != "", named).otherwise("n"), F.lit('["'), clean(F.concat("label", F.lit(" ("), "type", F.lit(")"))), F.lit('"]'), suffix)
    edge = F.concat(F.lit("    "), ident("source"), F.lit(" -->|"), clean(F.col("relation")), F.lit("| "), ident("target"))
    rows = kept.select("paper_id", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), node.alias("line")).unionAll(shown.select("paper_id", F.lit(2), F.col("ord").cast("long"), edge))
    body = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("_l"))
    note = F.concat(F.lit("    %% showing "), cap.cast("string"), F.lit(" of "), F.col("_all").cast("string"), F.lit(" edges + their nodes"))
    styles = [F.lit(f"    classDef {kind} {style};") for kind, style in STYLES.items()]
    head = F.array_compact(F.array(F.lit("graph TD"), F.when(cut, note), *styles))
    return body.join(totals, "paper_id", "left").select("paper_id", F.array_join(F.concat(head, F.transform("_l", lambda x: x["line"])), "\n").alias("mermaid"))


def context_markdown(sections: DataFrame) -> DataFrame:
    """Each paper's sections in full, in order, as one markdown text."""
    full = F.regexp_replace(F.concat(F.lit("## "), "section_path", F.lit("\n"), F.coalesce("text", F.lit(""))), r"\s+$", "")
    rows = sections.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", full.alias("t")))).alias("_r"))
    return rows.select("paper_id", F.concat(strip(F.array_join(F.transform("_r", lambda x: x["t"]), "\n\n")), F.lit("\n")).alias("context"))


def percentage(share: Column) -> Column:
    """A share as whole per cent, rounded half to even; n/a for null."""
    return F.coalesce(F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%")), F.lit("n/a"))


def paper_query(title: Column, text: Column) -> Column:
    """What to search related work by: the title, else the first header with words, else the first dozen words."""
    named = F.nullif(strip(F.coalesce(title, F.lit(""))), F.lit(""))
    headers = F.transform(F.split(text, "\n"), lambda x: F.when(strip(x).startswith("#"), strip(F.regexp_replace(strip(x), "^#+", ""))))
    header = F.get(F.filter(headers, lambda h: h != ""), F.lit(0))
    opening = F.array_join(F.slice(F.filter(F.split(strip(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), 1, 12), " ")
    return F.coalesce(named, header, opening)
