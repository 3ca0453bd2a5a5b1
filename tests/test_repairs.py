"""Repairs of extracted markdown on literal texts."""

import pytest
from pyspark.sql import functions as F

from foliate.operators import equations, headings, joining, markdown, passes, tables


def changed(spark, change, texts, again=True):
    """Each text changed; with ``again`` a second pass must change nothing."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", change(F.col("t")).alias("o"))
    rows = rows.withColumn("p", change(F.col("o"))).orderBy("i").collect()
    if again:
        assert [r.o for r in rows] == [r.p for r in rows]
    return [r.o for r in rows]


def check(spark, change, cases, again=True):
    assert changed(spark, change, [a for a, _ in cases], again) == [a if b is True else b for a, b in cases]


def test_tables(spark):
    check(spark, tables.repair_tables, [
        ("| A | B |\n| 1 | 2 |\n", "| A | B |\n| --- | --- |\n| 1 | 2 |\n"),
        ("| A | B |\n| --- | --- |\n| 1 | 2 |\n", True),
        ("| A | B |\n| :--- | ---: |\n| 1 | 2 |", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
        ("| A | B | C |\n|---|---|\n| 1 | 2 |\n| x |", "| A | B | C |\n| --- | --- | --- |\n| 1 | 2 |  |\n| x |  |  |"),
        ("| A | B |\n| 1 | 2 | 3 | 4 |", "| A | B |  |  |\n| --- | --- | --- | --- |\n| 1 | 2 | 3 | 4 |"),
        ("| A | B |\n| --- | --- |\n| 1 | 2 |\n\n| 3 | 4 |\n\n\n| 5 | 6 |", "| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\n\n| 5 | 6 |"),
        ("| T | D |\n| --- | --- |\n| R | one\ntwo\n| G |  |\nthree\n| H | x |", "| T | D |\n| --- | --- |\n| R | one two |\n| G | three |\n| H | x |"),
        ("a | b\nc | d\n\ntext", "| a | b |\n| --- | --- |\n| c | d |\n\ntext"),
        ("| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", True),
        ("| --- | --- |", True), ("- a | b\n- c | d", True), ("1. a | b\n2) c | d\n> e | f", True), ("one `a | b` and\ntwo `c | d`", True), ("$x | y$ and\n$\\{x \\mid y\\}$ | only one", True),
        ("```\n| not | a |\n| ta | ble |\n```\n| A | B |\n| 1 | 2 |", "```\n| not | a |\n| ta | ble |\n```\n| A | B |\n| --- | --- |\n| 1 | 2 |"),
        ("~~~\n| a | b |\n```\n| c | d |\n~~~", True), ("| a | b |\n```\n| c | d |\n```", True), ("lone | pipe", True), ("", True), (None, None), ("|", True), ("\x01 | b\n\x02 | d\nx", "| \x01 | b |\n| --- | --- |\n| \x02 | d |\nx"),
    ])


def test_a_long_table(spark):
    rows = "\n".join("| a | b |" for _ in range(20_000))
    assert changed(spark, tables.repair_tables, [rows]) == [rows.replace("\n", "\n| --- | --- |\n", 1)]


def test_headings(spark):
    check(spark, headings.rebuild_headings, [
        ("1. INTRODUCTION\n\ntext", "## 1. INTRODUCTION\n\ntext"),
        ("2 Related Work\ntext", "## 2. Related Work\n\ntext"),
        ("3.1 Background\n3.1.1 Details.\n1.2.3.4.5.6.7 Deep", "### 3.1 Background\n\n#### 3.1.1 Details\n\n###### 1.2.3.4.5.6.7 Deep"),
        ("1. First\n2. Second\n3. Third", True), ("1. Setup:\n\nx", True), ("1. We use method X to evaluate Y", True), (f"1. {'A' * 121}", True), ("# 1. Kept", True),
        ("2.1 Method. We do it. Now", "### 2.1 Method\n\nWe do it. Now"),
        ("IV. METHODS\ntext", "## IV. METHODS\ntext"), ("XX. LAST", "## XX. LAST"), ("XXI. NOT ONE", True), ("VI. we use some of it", True), ("IIII. NO", True),
        ("Abstract - We do.\nAbstract - Twice", "## Abstract\n\nWe do.\nAbstract - Twice"), ("x\n# index terms — a, b", "x\n## Index Terms\n\na, b"),
        ("- 1) Setup:\n\n\nA paragraph", "### 1) Setup\n\n\n\nA paragraph"), ("- 1) Setup:\n- 2) item", "1. Setup:\n2. item"), ("- 2. Titled:\n* x", True), ("- 2. Titled:", True), ("", True), (None, None), ("plain\ntext.", True),
    ], again=False)


def test_equations(spark):
    check(spark, equations.repair_equations, [
        ("a $d _ { k }$ in 1 0 0 years x _ 1", "a $d_{k}$ in 1 0 0 years x _ 1"), ("$1 0 0 0$", "$1000$"), ("$$ 1 0 ^ 3 $$", "$$ 10^3 $$"), ("open $ x _ 1", True), ("$a\n_ b$ c _ d", True),
        ("\\ frac{1}{2} and \\  sqrt x and \\ alpha", "\\frac{1}{2} and \\sqrt x and \\ alpha"), ("<!-- Formula-Not-Decoded -->", "*[Formula - see original PDF]*"),
        ("x\n$$\na \\\\\nb\n$$", "x\n\n$$\n\\begin{aligned}\na \\\\\nb\n\\end{aligned}\n\n$$"), ("$$\n\\begin{cases} 1 \\\\\n2\\end{cases}\n$$", "$$\n\\begin{cases}1 \\\\\n2\\end{cases}$$"), ("$$a \\alpha\n$$", "$$a \\alpha\n\n$$"), ("text\n$$x$$", "text\n\n$$x$$"), (None, None), ("", True),
    ], again=False)
    names = "M u l t i H e a d p _ { d a t a } d _ {m odel}"
    check(spark, lambda t: equations.repair_equations(t, names=True), [(names, "MultiHead p_{data} d_{model}")])
    check(spark, equations.repair_equations, [(names, True)])


def test_joining(spark):
    check(spark, joining.join_hyphens, [
        ("an exam-\nple here", "an example here"), ("an exam-\n\nple here", "an example here"), ("a state-\nof-the-art", "a state-of-the-art"), ("an exam-\nPle", True), ("an exam-\n\n\nple", True), ("# head-\nline", True), ("| cell-\nrow", True), ("a-\n# b", True),
        ("```\ncut-\nhere\n```\nbe-\nlow", "```\ncut-\nhere\n```\nbelow"), ("one-\ntwo-\nthree", "one-two-\nthree"), ("to--\nend", True), ("x -\ny", True), ("", True), (None, None),
    ], again=False)
    check(spark, joining.join_paragraphs, [
        ("it goes\n\non here", "it goes on here"), ("it goes\n\n(so) on", "it goes (so) on"), ("it ends.\n\non here", True), ("it goes\n\nOn here", True), ("- item\n\non here", True), ("it goes\n\n- on", True), ("it\n\n\non", True), ("# it\n\non", True),
        ("a\n\nb\n\nc", "a b\n\nc"), ("1. a\n\nb", True), (None, None), ("", True),
    ], again=False)


def test_bibliography(spark):
    head = "x [1]\n## References\n"
    check(spark, markdown.space_bibliography, [
        (head + "[1] a\n[2] b", head + "[1] a\n\n[2] b"), (head + "[1] a\nmore\n- [2] b", head + "[1] a\nmore\n\n- [2] b"), (head + "[1] a\n   \n[2] b", True), (head + "[1] a\n\nfree\n[2] b\n[3] c", head + "[1] a\n\nfree\n[2] b\n\n[3] c"),
        (head + "free\n[1] a", True), ('## References\n<a id="r"></a>[1] a\n[1234] b\n[2] c', '## References\n<a id="r"></a>[1] a\n[1234] b\n\n[2] c'), ("[1] a\n[2] b", True), (None, None),
    ])


@pytest.mark.parametrize("joined", [False, True])
def test_all_passes(spark, joined):
    text = "1. INTRODUCTION\nAs in [1]-[3], a ﬁne way – it\n\ngoes on and is hyph-\nenated.\n<!-- image -->\t\nFigure 2: A view\n| a | b |\n| 1 | $x _ 1$ |\n\n\n\n## References\n[1] A\n[2] B"
    papers = spark.createDataFrame([(1, text), (2, None)], "paper_id int, markdown string")
    files = spark.createDataFrame([(1, 1, "figure2.png")], "paper_id int, ord int, file string")
    out = {r.paper_id: r.markdown for r in passes.process(papers, files, hyphens=joined, paragraphs=joined).collect()}
    body = "goes on and is hyphenated." if joined else "goes on and is hyph-\nenated."
    between = " " if joined else "\n\n"
    expected = f"## 1. INTRODUCTION\n\nAs in [[1]](#ref-1), [[2]](#ref-2), [[3]](#ref-3), a fine way - it{between}{body}\n![Figure 2](./img/figure2.png)\n\nFigure 2: A view\n| a | b |\n| --- | --- |\n| 1 | $x_1$ |\n\n## References\n"
    assert out == {1: expected + '<a id="ref-1"></a>[1] A\n\n<a id="ref-2"></a>[2] B', 2: None}
