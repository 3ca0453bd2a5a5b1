"""What came out only on larger tables: results on limits, and steps whose work or memory grew faster than their input."""

import math
import random

from pyspark.sql import functions as F

from foliate.functions.lines import is_blank, let
from foliate.operators import answers, graph, lint, loose, markdown, repair, retrieval, scores, sourcing, tables
from foliate.plans import repairs


def test_a_deviation_on_the_limit_stays_on_it(spark):
    """Groups of a thousand mixtures whose deviation is exactly 1 or 2."""
    draw, groups = random.Random(5), []
    while len(groups) < 1000:
        votes = [draw.randrange(1, 11 if draw.random() < 0.3 else 7) for _ in range(draw.randrange(4, 12))]
        n, total, squares = len(votes), sum(votes), sum(v * v for v in votes)
        if n * squares - total * total in (n * n, 4 * n * n):
            groups.append((votes * draw.randrange(1, 7), (n * squares - total * total) / n / n))
    rows = [(p, v, "Accept") for p, (votes, _) in enumerate(groups) for v in draw.sample(votes, len(votes))]
    found = scores.robustness(spark.createDataFrame(rows, "p int, overall int, decision string").repartition(8), ["p"]).collect()
    want = {1.0: (1.0, "solid"), 4.0: (2.0, "borderline")}
    assert len(found) == 1000 and all((r.overall_std, r.label) == want[groups[r.p][1]] for r in found) and {v for _, v in groups} == {1.0, 4.0}


def test_records_of_one_title_are_dealt_over_tasks(spark):
    titles = spark.createDataFrame([(1, "Deep"), (2, "deep"), (3, "DEEP"), (4, "other"), (5, None)], "s int, title string").coalesce(1)
    records = spark.range(4000).selectExpr("id", "if(id % 10 = 0, null, 'dEEp') as filed_as").coalesce(1)
    found = sourcing.known_records(titles, records)
    assert sorted((r.s, r.id) for r in found.collect()) == [(s, i) for s in (1, 2, 3) for i in range(4000) if i % 10]
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_nearest_in_blocks(spark, monkeypatch):
    """Blocks of each with each give what all pairs give, with copies, odd vectors and few rows; the plan does not grow with the queries."""
    draw = random.Random(3)
    vectors = [(i, [float(draw.randrange(-3, 4)) for _ in range(4)]) for i in range(300)]
    vectors += [(300 + i, vectors[i][1]) for i in range(60)] + [(400, None), (401, [0.0] * 4), (402, [1.0, None, 2.0, 3.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")

    def cosine(a, b):
        if not a or not b or None in a or None in b:
            return 0.0
        norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norms, 6) + 0.0 if norms else 0.0

    want = {(q, *n) for q, a in vectors if q % 5 == 0 for n in [(v, s, r + 1) for r, (s, v) in enumerate(sorted((-cosine(a, b), v) for v, b in vectors)[:7])]}
    want = {(q, v, -s + 0.0, r) for q, v, s, r in want}
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    monkeypatch.setattr(retrieval, "AT_A_TIME", 7)
    found = retrieval.nearest(rows, rows.where("vec_id % 5 = 0"), 7)
    assert {(r.query_id, r.vec_id, r.score + 0.0, r["rank"]) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    few = retrieval.nearest(rows.where("vec_id < 3"), rows.where("vec_id < 2"), 7)
    assert sorted((r.query_id, r["rank"]) for r in few.collect()) == [(q, r) for q in (0, 1) for r in (1, 2, 3)]
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, str(r.score)) for r in retrieval.nearest(odd, odd.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(1, "nan"), (0, "1.0"), (2, "None")]


def test_reviews_are_read_in_their_rows(spark):
    """Nothing is sorted, gathered or joined for a review, so a task holds a row."""
    raws = [(1, '{"Overall": 3, "overall ": 5, "OVERALL": 4, "Strengths": ["a", null, " "]}'), (2, "no"), (3, None)]
    found = loose.reviews(spark.createDataFrame(raws, "i int, raw string"), ["i"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Aggregate", "Join", "Sort", "Generate"))
    assert [(r.overall, r.strengths) for r in found.orderBy("i").collect()] == [(5, ["a", "None"]), (1, []), (1, [])]


def _plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cut_once_for_its_equations(spark):
    """Not once a line, which made the work grow with the square of a text."""
    texts = spark.createDataFrame([("a\n$$ x $$\n $$\n\n$$\nb $$ c\n$$$\n$$\u00a0$$",), (None,), ("$$",)], "t string")
    found = texts.select(repair.space_equations(F.col("t")).alias("t"))
    assert _plan(found).count("split(") == 1
    assert [r.t for r in found.collect()] == ["a\n\n$$ x $$\n\n $$\n\n$$\nb $$ c\n\n$$$\n\n$$\u00a0$$", None, "$$"]


def test_a_text_is_lowered_once_for_all_keywords(spark):
    name, words = next(iter(graph.DOMAINS.items()))
    texts = spark.createDataFrame([(" ".join(words).upper(),), ("",), (None,)], "text string")
    found = graph.detect_domain(texts)
    assert _plan(found).count("lower(") == 1
    assert [(r.domain, r.hits) for r in found.collect()] == [(name, len(words)), ("general", 0), ("general", 0)] and found.columns == ["text", "domain", "hits"]


def test_only_buckets_that_are_asked_for_move(spark):
    blocks = spark.createDataFrame([("a", "graph net"), ("b", "tree"), ("c", "")], "block_id string, context string")
    asked = spark.createDataFrame([("q", "graph tree tree")], "query_id string, query string")
    found = retrieval.hashed_search(retrieval.hashed_index(blocks), blocks, asked, 3)
    assert "rightHint=(strategy=broadcast)" in _plan(found)
    assert [(r.block_id, r.score) for r in found.orderBy("rank").collect()] == [("b", 0.894427), ("a", 0.316228), ("c", 0.0)]


def test_an_audit_reads_drafts_once_for_counts_and_budgets(spark):
    sections = spark.createDataFrame([("p", 1, "A", "[todo x] \\\\cite{} \\\\cite{k} [CITE: y]", 50), ("p", 2, "B", " \t", None), ("q", 1, "", None, 5)], "paper_id string, ord int, title string, draft string, word_budget int")
    required = spark.createDataFrame([("p", "a"), ("p", "c")], "paper_id string, title string")
    bibliography = spark.createDataFrame([("p", "other")], "paper_id string, key string")
    counts = spark.createDataFrame([("p", 10, 8)], "paper_id string, candidates int, verified int")
    found = lint.audit(sections, required, bibliography, counts)
    # missing titles and uncovered keys, each found and joined, and the counts of records
    assert _plan(found).count("Join ") == 5
    assert [(r.paper_id, r.placeholders, r.under_budget, r.missing_sections, r.uncovered, r.meets, r.problems) for r in found.orderBy("paper_id").collect()] == [("p", 4, 1, 1, 1, False, 8), ("q", 1, 1, 0, 0, True, 2)]


def test_a_value_that_is_let_is_typed_once(spark):
    """``get`` asked for the type of the whole body at every value."""
    rows = spark.createDataFrame([("a",), (None,)], "t string")
    found = rows.select(let(F.col("t"), lambda t: F.concat(t, t)).alias("t"))
    assert "get(" not in _plan(found).replace("element_at(", "") and [r.t for r in found.collect()] == ["aa", None]


def test_templates_are_filled_from_their_pieces(spark, tmp_path):
    """No line is searched for what is to be put in, and letters are no ranges, which are slow."""
    spark.createDataFrame([(0, "aa b,b é c-c  {n} dd ee"), (1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = repairs.planted(spark, str(tmp_path), ("{{ {a} }}{n}{b}", "{m} \\x {c}"))
    assert _plan(found).count("replace(") == 1 and "A-Z" not in _plan(found)
    assert {r.paper_id: r.markdown for r in found.collect()} == {0: "{ aa }1b,b\n{ c-c }2\n{  }3dd", 1: None, 2: "{  }1"}


def test_most_lines_are_told_by_their_first_byte(spark):
    lines = ["", " \t\r\x0b\f", "\x01", " ", "a", " | a | b |", "|", "`|`", "- | a", "|`x`", "$|$", r"a \mid b", "`a` | b", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    found = rows.select("i", is_blank(F.col("line")).alias("blank"), tables.is_row(F.col("line")).alias("row"), tables.is_separator(F.array(F.lit(":--"), F.trim("line"))).alias("rule")).orderBy("i")
    assert _plan(found).count(" < ") >= 2
    got = found.collect()
    assert [r.i for r in got if r.blank] == [0, 1] and [r.i for r in got if r.row] == [5, 6, 9, 12] and not any(r.rule for r in got)


def test_signs_and_blanks_go_without_classes_of_many_kinds(spark):
    texts = spark.createDataFrame([("ﬁn – x \t\r\n <!-- image --> \nglyph[ALPHA]glyph[alpha] GLYPH<12>\n\n\n\n \x0b\f",), (None,)], "t string")
    found = texts.select(markdown.cleanup(F.col("t")).alias("t"))
    assert "[^\\S\\n]+" not in _plan(found)
    assert [r.t for r in found.collect()] == ["fin - x\nα\n\n", None]


def test_ends_of_edges_are_looked_up_in_their_answer(spark):
    """Answers were read three times and their edges joined twice."""
    good = '{"nodes": [{"id": "a", "label": "A"}, 7, {"id": "b"}, {"id": "c", "label": "C", "confidence": "x"}], "edges": [{"source": "a", "target": "c"}, 3, {"source": "b", "target": "c"}, {"source": "c", "target": "d"}, {"source": "c", "target": "a", "relation": "uses"}]}'
    rows = [(1, 1, good), (1, 2, '{"nodes": [{"id": "d", "label": "D"}], "edges": [{"source": "a", "target": "d"}]}'), (2, 1, "none"), (2, 2, '{"edges": [{"source": "a", "target": "c"}]}'), (3, 1, None)]
    edges = answers.graphs(spark.createDataFrame(rows, "paper_id int, batch int, response string"))[1]
    assert "Join" not in _plan(edges) and _plan(edges).count("ArrowEvalPython") == 1
    assert sorted((r.paper_id, r.batch, r.ord - (1 << 32), r.source, r.target, r.relation) for r in edges.collect()) == [(1, 1, 0, "a", "c", "related_to"), (1, 1, 4, "c", "a", "uses")]


def test_missing_titles_hold_no_table_of_titles(spark):
    """Distinct titles were kept in memory, in as few tasks as their size alone asked for."""
    required = spark.createDataFrame([("p", " A "), ("p", "b"), ("p", "b"), ("q", "a"), (None, "a"), ("q", None)], "paper_id string, title string")
    present = spark.createDataFrame([("p", "a"), ("p", "a "), ("q", None), (None, "a")], "paper_id string, title string")
    found = lint.missing_titles(required, present)
    assert "Aggregate" not in _plan(found) and _plan(found).count("RepartitionByExpression") == 2
    assert sorted((r.paper_id or "", r.title or "") for r in found.collect()) == [("", "a"), ("p", "b"), ("p", "b"), ("q", ""), ("q", "a")]
