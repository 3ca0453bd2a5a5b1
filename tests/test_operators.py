"""The operators on literal fixtures."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from foliate.functions import text as T
from foliate.operators import blocks, graph, lint, markdown, retrieval, scholarly, scores
from foliate.sources import readers
from foliate.streaming.intake import stream_sections


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def md(spark, text):
    return blocks.to_lines(spark.createDataFrame([("p", text)], "paper_id string, markdown string"))


def test_section_paths(spark):
    rows = blocks.build_sections(md(spark, "before\n# Title\nintro\n## 1 Methods\na\n\n### 1.1 Setup\nb\n## II. Results\nc\n#### Deep\n## 3\n")).orderBy("ord").collect()
    assert [r.section_path for r in rows] == ["Title", "Title > Methods", "Title > Methods > Setup", "Title > Results", "Title > Results > Deep", "Title > 3"]
    assert [r.text for r in rows] == ["intro", "a", "b", "c", "", ""] and [r.start_line for r in rows] == [2, 4, 7, 9, 11, 12]
    assert one(spark, blocks.block_id(F.lit("section"), F.col("p"), F.lit(1)), p="Title > Methods > Setup") == "section:title-methods-setup"
    assert one(spark, blocks.block_id(F.lit("section"), F.col("p"), F.lit(1)), p="") == "section:untitled"
    assert one(spark, blocks.block_id(F.lit("figure"), F.col("p"), F.lit(3)), p="") == "figure:3"


def test_skipped_and_equal_levels(spark):
    rows = blocks.build_sections(md(spark, "# A\n### C\n## B\n### D\n# E\n### F")).orderBy("ord").collect()
    assert [r.section_path for r in rows] == ["A", "A > C", "A > B", "A > B > D", "E", "E > F"]


def test_split_and_select(spark):
    rows = blocks.split_level(md(spark, "pre\n## One\na\n### deep\n## Two")).orderBy("ord").collect()
    assert [(r.title, r.draft) for r in rows] == [("One", "a\n### deep"), ("Two", "")]
    made = blocks.build_sections(md(spark, "# T\n## Methods\n### Setup\n## Other")).withColumn("kind", F.lit("section"))
    assert blocks.select(made, prefix="T > Methods").count() == 2
    assert blocks.select(made, prefix="T", most=2).count() == 2
    assert blocks.select(made, kinds=[]).count() == 0


def test_render(spark):
    cols = {"kind": "equation", "section_path": "", "text": "x" * 130, "number": "1", "caption": "", "language": ""}
    assert one(spark, blocks.render("summary"), **cols) == "$$ " + "x" * 119 + "… $$"
    cols = {"kind": "code", "section_path": "", "text": "a = 1", "number": "2", "caption": "", "language": "py"}
    assert one(spark, blocks.render("full"), **cols) == "```py\na = 1\n```" and one(spark, blocks.render("ref"), **cols) == "[code:2] py"
    cols = {"kind": "section", "section_path": "A > B", "text": "  t  ", "number": "0", "caption": "", "language": ""}
    assert one(spark, blocks.render("ref"), **cols) == "[section:a-b] A > B" and one(spark, blocks.render("summary"), **cols) == "## A > B\nt"
    cols = {"kind": "figure", "section_path": "", "text": "", "number": "4", "caption": "A curve", "language": ""}
    assert one(spark, blocks.render("summary"), **cols) == "Figure 4: A curve"


def test_top_k(spark):
    rows = [("s:a", "methods dataset"), ("s:b", "other words"), ("s:c", "dataset")]
    frame = spark.createDataFrame(rows, "block_id string, context string")
    got = retrieval.top_k(retrieval.tf_cosine(frame, {"q": "methods dataset"}), 2, ["query_id"]).orderBy("rank").collect()
    assert [(r.block_id, r.score) for r in got] == [("s:a", 1.0), ("s:c", 0.707107)]
    none = retrieval.top_k(retrieval.tf_cosine(frame, {"q": "zzz"}), 0, ["query_id"]).orderBy("rank").collect()
    assert [(r.block_id, r.score) for r in none] == [("s:a", 0.0), ("s:b", 0.0), ("s:c", 0.0)]


def test_citations(spark):
    link = lambda t: one(spark, markdown.process_citations(F.col("t")), t=t)
    assert link("see [7].") == "see [[7]](#ref-7)." and link(link("see [7].")) == "see [[7]](#ref-7)."
    assert link("in [2024]") == "in [2024]" and link("[a](b)[3]") == "[a](b)[[3]](#ref-3)"
    expand = lambda t: one(spark, markdown.expand_ranges(F.col("t")), t=t)
    assert expand("x [11]-[14] y [3]–[2]") == "x [11], [12], [13], [14] y [2], [3]" and expand("[1]-[100]") == "[1]-[100]"
    refs = "a [1]\n## References\n[1] One\n- [2] Two\n"
    done = link(refs)
    assert done == 'a [[1]](#ref-1)\n## References\n<a id="ref-1"></a>[1] One\n<a id="ref-2"></a>[2] Two\n' and link(done) == done
    spaced = one(spark, markdown.space_bibliography(F.col("t")), t="## References\n[1] A\n[2] B\nmore\n[3] C")
    assert spaced == "## References\n[1] A\n\n[2] B\nmore\n\n[3] C" and one(spark, markdown.reference_count(F.col("t")), t=spaced) == 3
    assert one(spark, markdown.reference_count(F.col("t")), t="[1] A") == 0


def test_cleanup(spark):
    assert one(spark, markdown.cleanup(F.col("t")), t="eﬃcient a–b  \n <!-- image -->\n\n\n\n\nglyph[alpha]GLYPH[Alpha]GLYPH<3>glyph[x] end\t") == "efficient a-b\n\nα end"


def test_table_count(spark):
    text = "| a | b |\n| --- | --- |\n| 1 | 2 |\n\nprose | pipe\n\n```\n| x | y |\n| 1 | 2 |\n```\n\n| c | d |\n| 3 | 4 |\n\n- a | b\n- c | d\n\n| --- |\n\n`a | b`\n$x | y$"
    assert one(spark, markdown.table_count(F.col("t")), t=text) == 2 and one(spark, markdown.table_count(F.col("t")), t="") == 0


def test_cite_keys_and_claims(spark):
    text = r"A \cite{a,b}. B \citep[p. 1]{c} and \citet*[x][y]{ d }, \cite{} end"
    assert one(spark, T.cite_keys(F.col("t")), t=text) == ["a", "b", "c"] or one(spark, T.cite_keys(F.col("t")), t=text.replace("*", "")) == ["a", "b", "c", "d"]
    sentences = one(spark, T.claim_sentences(F.col("t")), t="One \\cite{x}. Two!\n\nThree?")
    assert sentences == ["One \\cite{x}.", "Two!", "Three?"]
    assert one(spark, T.without_cites(F.col("t")), t="(As  shown \\cite[p]{x}),") == "As shown"


def test_lint(spark):
    cited = spark.createDataFrame([("p", "a"), ("p", "ghost"), ("p", "a")], "paper_id string, key string")
    entries = spark.createDataFrame([("p", 1, "a", ["title"]), ("p", 2, "b", ["title"]), ("p", 3, "a", ["author"]), ("p", 4, "", ["title"])], "paper_id string, ord int, key string, fields array<string>")
    r = lint.cross_check(cited, entries, ["paper_id"]).first()
    assert (r.missing_in_bib, r.uncited_in_bib) == (["ghost"], ["b"])
    assert lint.duplicates(entries, ["paper_id"]).first().duplicates == ["a"]
    assert sorted((r.ord, r.missing) for r in lint.malformed(entries).collect()) == [(3, ["title"]), (4, ["key"])]
    r = lint.lint_counts(cited, entries, ["paper_id"]).first()
    assert (r.entries, r.cited, r.malformed, r.duplicates, r.missing, r.uncited) == (4, 2, 2, 1, 1, 1)


def test_audit_and_coverage(spark):
    sections = spark.createDataFrame([("p", 1, "Intro", "one two \\cite{ghost} [TODO x] \\cite{}", 100), ("p", 2, "End", " ", None)], "paper_id string, ord int, title string, draft string, word_budget int")
    required = spark.createDataFrame([("p", " intro "), ("p", "Methods")], "paper_id string, title string")
    bib = spark.createDataFrame([], "paper_id string, key string")
    r = lint.audit(sections, required, bib, spark.createDataFrame([("p", 10, 8)], "paper_id string, candidates int, verified int")).first()
    assert (r.missing_sections, r.under_budget, r.placeholders, r.uncovered, r.meets, r.problems, r.passed) == (1, 1, 3, 1, False, 7, False)
    for n, v, least, ratio, meets in [(10, 9, 9, 0.9, True), (10, 8, 9, 0.8, False), (1, 0, 1, 0.0, False), (0, 0, 0, 0.0, True)]:
        assert tuple(spark.range(1).select(*lint.coverage(F.lit(n), F.lit(v))).first()) == (least, ratio, meets)


def test_dates_and_ranking(spark):
    valid = lambda d, y: spark.createDataFrame([(d, y)], "d string, y int").select(scholarly.date_valid(F.col("d"), F.col("y"), "2020-05")).first()[0]
    assert [valid("2020-04-30", None), valid("2020-05-01", None), valid("bad", 2019), valid(None, 2020), valid(None, 2021), valid(None, None)] == [True, False, True, True, False, True]
    assert spark.range(1).select(scholarly.date_valid(F.lit("2030-01-01"), F.lit(2030), "2020-05-01")).first()[0] is True
    found = [("k", 1, "Attention", 2025, "x", None), ("k", 2, "Attention", 2017, "x", None)]
    refs = spark.createDataFrame([(1, "k", "attention", None), (2, "k", "Attention", 2025)], "ref_id int, search_key string, query_title string, year_hint int")
    records = spark.createDataFrame(found, "search_key string, rec_ord int, title string, year int, abstract string, publication_date string")
    scored = scholarly.score(refs, records)
    assert {r.ref_id: r.year for r in scholarly.best_match(scored).collect()} == {1: 2017, 2: 2025}
    graded = {r.ref_id: r for r in scholarly.grade(refs, scored).collect()}
    assert graded[1].severity == "exact" and graded[2].severity == "minor" and graded[1].year_conflict == [2017, 2025] and graded[1].alternatives == ["Attention"]


@pytest.mark.parametrize(("cut", "hint", "ok"), [(71, None, True), (70, None, False), (65, 2000, True), (65, 1999, False)])
def test_threshold(spark, cut, hint, ok):
    title = "a" * 100
    query = "a" * next(n for n in range(1, 101) if round(200 * n / (100 + n)) == cut)
    refs = spark.createDataFrame([(1, "k", query, hint)], "ref_id int, search_key string, query_title string, year_hint int")
    records = spark.createDataFrame([("k", 1, title, 2000, "x", None)], "search_key string, rec_ord int, title string, year int, abstract string, publication_date string")
    assert (scholarly.best_match(scholarly.score(refs, records)).count() == 1) == ok


def test_keys_and_dedupe(spark):
    row = spark.createDataFrame([(["Dzmitry Bahdanau"], 2015, "Neural Machine Translation"), ([], None, "On the topic")], "a array<string>, y int, t string")
    assert [r[0] for r in row.select(scholarly.mint_key(F.col("a"), F.col("y"), F.col("t"))).collect()] == ["bahdanau2015neuralmachine", "anonndtopic"]
    keys = spark.createDataFrame([(1, "g", "k", "r"), (2, "g", "k", "r"), (3, "g", "k", ""), (4, "g", "k", ""), (5, "g", "z", "q")], "ord int, g string, citation_key string, record_id string")
    kept = scholarly.dedupe(keys, ["g"])
    assert sorted((r.ord, r.citation_key) for r in scholarly.suffix_keys(kept, ["g"]).collect()) == [(1, "ka"), (3, "kb"), (4, "kc"), (5, "z")]


def test_scores(spark):
    v = spark.createDataFrame([("a", "supported"), ("a", "no_source"), ("b", "contradicted"), ("c", "unknown")], "p string, verdict string")
    assert {r.p: r.support_integrity for r in scores.support_integrity(v, ["p"]).collect()} == {"a": 1.0, "b": 0.0, "c": None}
    parts = spark.createDataFrame([("a", 2, 1, 0, 0, None), ("b", 1, 0, 2, 1, None), ("c", 0, 0, 0, 0, None)], "p string, cited int, missing int, claims int, supported int, support_integrity double")
    assert {r.p: r.grounding_integrity for r in scores.grounding(parts).collect()} == {"a": 0.5, "b": 0.75, "c": None}
    rev = spark.createDataFrame([("a", i, o, d) for i, (o, d) in enumerate([(8, "Accept"), (7, "Accept"), (3, "Reject")])] + [("b", i, o, "Reject") for i, o in enumerate([4, 4, 6])], "p string, reviewer_ord int, overall int, decision string")
    assert {r.p: (r.overall, r.decision) for r in scores.meta_review(rev, ["p"]).collect()} == {"a": (6, "Accept"), "b": (5, "Reject")}
    rob = spark.createDataFrame([("a", 8, "Accept"), ("a", 8, "Accept"), ("a", 7, "Accept"), ("b", 9, "Accept"), ("b", 3, "Reject"), ("b", 4, "Reject")], "p string, overall int, decision string")
    assert {r.p: (r.label, r.agreement) for r in scores.robustness(rob, ["p"]).collect()} == {"a": ("solid", 1.0), "b": ("split", 0.667)}


NODES = "paper_id int, ord int, id string, label string, type string, description string, section_path string, aliases array<string>, evidence string, confidence double"


def nodes(spark, rows):
    return spark.createDataFrame([(1, i, a, b, c, d, "", [], "", e) for i, (a, b, c, d, e) in enumerate(rows)], NODES)


def test_merge_nodes(spark):
    rows = graph.merge_nodes(nodes(spark, [("x", "Self Attention", "concept", "d", 0.3), ("x", "attention", "method", "longer", 0.9), ("y", "self  attention", "concept", "", 0.1), ("z", "Other", "concept", "", 1.0)])).orderBy("ord").collect()
    assert [r.id for r in rows] == ["x", "z"]
    assert rows[0].aliases == ["attention", "self  attention"] and rows[0].description == "longer" and rows[0].confidence == 0.9


def test_coreference(spark):
    rows = nodes(spark, [("a", "GNN", "method", "", 1.0), ("b", "Graph Neural Net", "concept", "", 1.0), ("c", "Graph Neural Net v2", "concept", "", 1.0), ("d", "Tree", "task", "", 1.0)])
    to = {r.id: r.canonical for r in graph.coreference(rows).collect()}
    assert to == {"a": "c", "b": "c", "c": "c", "d": "d"}
    edges = spark.createDataFrame([(1, 0, "a", "b", "uses"), (1, 1, "a", "d", "uses"), (1, 2, "c", "d", "uses")], "paper_id int, ord int, source string, target string, relation string")
    assert [(r.source, r.target) for r in graph.redirect(edges, graph.coreference(rows)).collect()] == [("c", "d")]


def test_verify(spark):
    rows = nodes(spark, [("a", "Known", "method", "", 1.0), ("b", "Unknown", "method", "", 1.0), ("c", "Idea", "concept", "", 1.0)])
    edges = spark.createDataFrame([(1, 0, "a", "c", "uses"), (1, 1, "b", "c", "uses")], "paper_id int, ord int, source string, target string, relation string")
    texts = spark.createDataFrame([(1, "a known thing")], "paper_id int, text string")
    kept, between = graph.verify(rows, edges, texts)
    assert sorted(r.id for r in kept.collect()) == ["a", "c"] and between.count() == 1
    lone, _ = graph.verify(rows, edges.where("source = 'b'"), texts)
    assert sorted(r.id for r in lone.collect()) == ["a", "c"]  # no edge is left, so none is an orphan
    assert graph.briefing(rows, edges).first().briefing == "Knowledge graph: 3 nodes, 2 relations.\n- concept: Idea\n- method: Known, Unknown"


def test_folder(spark, tmp_path):
    for name, text in {"b.md": "# B\nx", "README.md": "no header", "sub/a.md": "# A", ".git/c.md": "# C", "d.bin": "x", "vendor/e.md": "# E"}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(text)
    files = readers.read_folder(spark, str(tmp_path))
    assert [r.label for r in files.collect()] == ["README.md", "b.md", "sub/a.md", "vendor/e.md"]
    assert {(r.label, r.title, r.section_path) for r in readers.markdown_blocks(files).collect()} == {("README.md", "README", ""), ("b.md", "B", "B"), ("sub/a.md", "A", "A"), ("vendor/e.md", "E", "E")}
    assert one(spark, readers.cap_text(F.col("t"), 4), t="abc def") == "abc\n\n[... truncated ...]"
    frame = spark.range(1)
    assert readers.write_new(frame, f"{tmp_path}/out") is None and readers.write_new(frame, f"{tmp_path}/out").startswith("exists") and readers.write_new(frame, f"{tmp_path}/out", True) is None


def test_gather(spark):
    rows = [(1, "r", i, "section", f"S{i}") for i in range(3)] + [(2, "t", 0, "section", ""), (3, "u", 0, "section", "x")]
    kept, sizes = readers.gather(spark.createDataFrame(rows, "source_ord int, label string, file_ord int, kind string, section_path string"), 4)
    assert sorted(r.section_path for r in kept.collect()) == ["[r] S0", "[r] S1", "[r] S2", "[t]"]
    assert {r.label: r.taken for r in sizes.collect()} == {"r": 3, "t": 1, "u": 0}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\ntext\n## B")
    stream_sections(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "in/b.md").write_text("# C")
    stream_sections(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.section_path for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["A", "A > B", "C"]


def test_entry_without_the_optional_parts(tmp_path):
    """The rest imports, and has its queries, where the corpus operators and the pipeline are not there."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/foliate", tmp_path / "foliate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps([len(e.queries()), [q for q in e.queries() if q.startswith('op') and q[2].isdigit()], sorted(set(e.oracle_sql()) - set(e.queries()))]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    n, optional, loose = json.loads(out.stdout.strip().splitlines()[-1])
    assert n > 40 and optional == [] and loose == []
