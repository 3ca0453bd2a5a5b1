"""Bibliographies as text, LaTeX, drawings, repairs and sources on literal rows."""

from pyspark.sql import functions as F

from foliate.operators import bibtex, blocks, export, repair, retrieval, sourcing
from foliate.sources import readers


def value(spark, column, **row):
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return frame.select(column.alias("v")).first().v


def test_bibtex_entries():
    found = bibtex.entries_of("@Article{a, title = {On {B} = x}, Year = 2000}\n@misc{,note={}}\n@book{c}\n@x{d, title={never closed")
    assert [(e["type"], e["key"], e["fields"]) for e in found] == [("article", "a", ["title", "year"]), ("misc", "", ["note"]), ("book", "c", []), ("x", "d", ["title"])]
    assert bibtex.entries_of(None) == bibtex.entries_of("no entry { here }") == []
    assert len(bibtex.entries_of("@a{k, t={" * 20_000)) == 20_000


def test_latex(spark):
    escape = lambda t: value(spark, export.latex_escape(F.col("t")), t=t)
    assert escape(r"a\b ~50% {x}_y^z & $#") == r"a\textbackslash{}b \textasciitilde{}50\% \{x\}\_y\textasciicircum{}z \& \$\#"
    assert value(spark, export.latex_inline(F.col("t")), t="**bold** *it* `co_de` [a link](http://x) see [[3]](#ref-3)") == r"\textbf{bold} \textit{it} \texttt{co\_de} a link see [3]"
    md = "# 1. Intro\none\ntwo\n\n- a\n- b & c\n1. first\n2. second\ntext\r\n### Deep\n\n- alone"
    out = export.latex(blocks.to_lines(spark.createDataFrame([(1, md)], "paper_id int, markdown string"))).first().latex
    assert out.split("\n\n") == [r"\section{Intro}", "one two", r"\begin{itemize}", r"  \item a", r"  \item b \& c", r"\end{itemize}", r"\begin{enumerate}", r"  \item first", r"  \item second", r"\end{enumerate}", "text", r"\subsection{Deep}", r"\begin{itemize}", r"  \item alone", r"\end{itemize}"]


def test_mermaid_draws_all_or_the_first(spark):
    nodes = spark.createDataFrame([(1, i, f"n-{i}", f'l"{i}]', "method" if i else "other") for i in range(4)], "paper_id int, ord int, id string, label string, type string")
    edges = spark.createDataFrame([(1, i, f"n-{i}", f"n-{i + 1}", "uses") for i in range(3)], "paper_id int, ord int, source string, target string, relation string")
    whole = export.mermaid(nodes, edges).first().mermaid.split("\n")
    assert whole[0] == "graph TD" and whole[8:] == ["    n_0[\"l'0) (other)\"]", *(f"    n_{i}[\"l'{i}) (method)\"]:::method" for i in (1, 2, 3)), *(f"    n_{i} -->|uses| n_{i + 1}" for i in range(3))]
    some = export.mermaid(nodes, edges, 1).first().mermaid
    assert "showing 1 of 3 edges" in some and "n_2" not in some
    assert "showing" not in export.mermaid(nodes, edges, 0).first().mermaid


def test_repairs(spark):
    assert value(spark, repair.space_equations(F.col("t")), t="a\n$$\nx\n$$\n\n$$ y $$\nb") == "a\n\n$$\nx\n\n$$\n\n$$ y $$\nb"
    papers = spark.createDataFrame([(1, "As in Fig. 2. no\nFigure 2: cap\nFig. 2: again\n![Figure 3](x)\nFig. 3: had"), (2, None)], "paper_id int, markdown string")
    files = spark.createDataFrame([(1, 0, "fig_2.png"), (1, 1, "figure2.png"), (1, 2, "x_img_003.png"), (1, 3, "x_img_009.png"), (1, 4, "none.png")], "paper_id int, ord int, file string")
    out = {r.paper_id: r.markdown for r in repair.embed_figures(papers, files).collect()}
    assert out == {1: "As in Fig. 2. no\n![Figure 2](./img/fig_2.png)\n\nFigure 2: cap\nFig. 2: again\n![Figure 3](x)\nFig. 3: had", 2: None}
    again = spark.createDataFrame(list(out.items()), "paper_id int, markdown string")
    assert {r.paper_id: r.markdown for r in repair.embed_figures(again, files).collect()} == out
    assert [(r.number, r.file) for r in repair.unembedded_figures(again, files).collect()] == [(9, "x_img_009.png")]


def test_figures_are_numbered_through(spark):
    rows = [(0, "a", 0, "figure", "", 7), (0, "a", 0, "section", "S", None), (0, "a", 1, "figure", "", 1), (1, "b", 0, "figure", "", 1), (1, "b", 0, "figure", "", 3)]
    out = readers.gather(spark.createDataFrame(rows, "source_ord int, label string, file_ord int, kind string, section_path string, figure_id int"), 50)[0]
    assert sorted((r.source_ord, r.file_ord, r.figure_id) for r in out.where("kind = 'figure'").collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 0, 4)]
    assert out.where("kind = 'section'").first().section_path == "[a] S"


def test_sources(spark, tmp_path):
    assert value(spark, export.percentage(F.col("t").cast("double")), t="0.125") == "12%" and value(spark, export.percentage(F.col("t").cast("double")), t=None) == "n/a"
    (tmp_path / "list.txt").write_text("# none\n\n a \nb\n")
    (tmp_path / "list.json").write_text('["x", "y z"]')
    assert [r["source"] for r in readers.read_sources(spark, f"{tmp_path}/list.txt").orderBy("ord").collect()] == ["a", "b"]
    assert [r["source"] for r in readers.read_sources(spark, f"{tmp_path}/list.json").orderBy("ord").collect()] == ["x", "y z"]
    whole = readers.text_blocks(spark.createDataFrame([("d/e.py", " # no header\nx ")], "label string, text string")).first()
    assert (whole.title, whole.section_path, whole.text) == ("e", "", "# no header\nx")
    (tmp_path / "g").mkdir()
    for name in ("b.md", "a.md", "c.txt"):
        (tmp_path / "g" / name).write_text(name)
    assert [r.text for r in readers.read_glob(spark, f"{tmp_path}/g/*.md", 1).collect()] == ["a.md"]
    frame = spark.createDataFrame([(1, "x")], "id int, t string")
    readers.append_lines(frame, f"{tmp_path}/out")
    readers.append_lines(frame, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    kinds = [value(spark, readers.source_kind(F.col("t")), t=t) for t in (" https://www.github.com/a/b ", "https://notarxiv.org/x", "https://export.arxiv.org/abs/2101.00001", "arXiv:2101.00001")]
    assert kinds == ["git", "url", "pdf", "text"]
    claims = spark.createDataFrame([(1, "k"), (1, "gone")], "paper_id int, key string")
    found = sourcing.sources_of_claims(claims, spark.createDataFrame([(1, "k", " an abstract ")], "paper_id int, key string, abstract string"))
    assert {r.key: (r.source_kind, r.source_text, r.verdict) for r in found.collect()} == {"k": ("abstract", "an abstract", None), "gone": ("none", "", "no_source")}


def test_hashed_retrieval(spark):
    one = dict(retrieval.hashed_vector("The cat, the hat"))
    assert one == dict(retrieval.hashed_vector("hat THE the cat")) and abs(sum(w * w for w in one.values()) - 1) < 1e-12
    assert retrieval.hashed_vector("") == retrieval.hashed_vector(None) == []
    texts = {f"b{i}": " ".join(f"w{(i * j) % 40}" for j in range(i % 7)) for i in range(60)}
    blocks_ = spark.createDataFrame(list(texts.items()), "block_id string, context string")
    queries = {"a": "w3 w6 w9 w3", "none": "zebra", "empty": ""}
    found = retrieval.hashed_search(retrieval.hashed_index(blocks_), blocks_, spark.createDataFrame(list(queries.items()), "query_id string, query string"), 8)
    for name, q in queries.items():
        v = dict(retrieval.hashed_vector(q))
        scores = {b: round(sum(w * v.get(k, 0) for k, w in retrieval.hashed_vector(t)), 6) for b, t in texts.items()}
        want = sorted(scores, key=lambda b: (-scores[b], b))[:8]
        got = sorted((r["rank"], r.block_id, r.score) for r in found.where(F.col("query_id") == name).collect())
        assert [b for _, b, _ in got] == want and [s for *_, s in got] == [scores[b] for b in want]


def test_json_object_of_an_answer():
    from foliate.operators.answers import json_object

    assert json_object('x ```json\n{"a": "}"}\n``` {"b": 1}') == '\n{"a": "}"}\n'
    assert json_object('x ```json\n[1]\n``` {"b": {"c": "\\"{"}} tail') == '{"b": {"c": "\\"{"}}'
    assert json_object("[{}]") == "{}" and json_object("{ no") is json_object("") is json_object(None) is None
    assert json_object('{"a": 1') is None and json_object("{bad} {\"a\": 1}") is None
