"""Entities by joins against a fold in order, batches of answers, stages that resume, the cache of results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliate.operators import answers, caching, entities, graph, staged

NODES = "paper_id long, ord long, id string, label string, type string, description string, section_path string, aliases array<string>, evidence string, confidence double"


def made(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], NODES)


def test_first_come_against_a_fold(spark):
    draw = random.Random(4)
    rows = [(p, i, f"i{draw.randrange(12)}", f"k{draw.randrange(12)}" if draw.random() < 0.9 else None) for p in range(6) for i in range(40)]
    found = {(r.paper_id, r.ord): r.to for r in entities.first_come(spark.createDataFrame(rows, "paper_id int, ord int, a string, b string"), ["a", "b"]).collect()}
    kept = {}
    for p, i, a, b in rows:
        own = kept.setdefault(p, [])
        to = next((o for o, x, y in own if x == a or (y == b and b is not None)), None)
        if to is None:
            own.append((i, a, b))
        assert found[p, i] == (i if to is None else to)
    one = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, None)], "paper_id int, ord int, a string")
    assert sorted((r.ord, r.to) for r in entities.first_come(one, ["a"]).collect()) == [(0, 0), (1, 0), (2, 2)]


def fold_of_pairs(labels):
    """Takes the first pair that is alike again and again, by the definition."""
    gone, live = {}, list(range(len(labels)))

    def like(a, b):
        x, y = labels[a].strip().lower(), labels[b].strip().lower()
        one, two = set(x.split()), set(y.split())
        return x and y and x != y and (x in y or y in x or (one and two and len(one & two) / min(len(one), len(two)) >= 0.8))

    while True:
        pair = next(((a, b) for k, a in enumerate(live) for b in live[k + 1 :] if like(a, b)), None)
        if not pair:
            break
        keep, drop = pair if len(labels[pair[0]]) >= len(labels[pair[1]]) else pair[::-1]
        gone[drop] = keep
        live.remove(drop)
    return gone


def test_like_labels_against_a_fold(spark):
    draw = random.Random(9)
    words = ["net", "graph", "work", "network", "tree", "a", "of", "deep"]
    papers = [[" ".join(draw.choice(words) for _ in range(draw.randrange(1, 5))) for _ in range(14)] for _ in range(5)]
    rows = [(p, i, f"n{i}", label, "method", "", "", [], "", 1.0) for p, labels in enumerate(papers) for i, label in enumerate(labels)]
    found = entities.shorter_to_longer(entities.alike(spark.createDataFrame(rows, NODES))).collect()
    assert {(r.paper_id, r.ord): r.to for r in found} == {(p, i): to for p, labels in enumerate(papers) for i, to in fold_of_pairs(labels).items()}


def test_acronyms(spark):
    rows = [("b", "G3"), ("a", "GPT3"), ("c", "Graph Neural Net"), ("d", "GNN"), ("e", "graph-neural_net"), ("f", "GN"), ("g", None), ("h", "XMLHttp"), ("i", "XH"), ("j", "Graph Pre Train 3x")]
    nodes = made(spark, [(i, label, "method", "", "", [], "", 1.0) for i, label in rows])
    assert {r.ord: r.to for r in entities.acronyms(nodes).collect()} == {0: 1, 1: 9, 3: 2, 8: 7}
    # what went before its turn is no long form any more
    late = made(spark, [(i, label, "method", "", "", [], "", 1.0) for i, label in (rows[1], rows[0], rows[9])])
    assert {r.ord: r.to for r in entities.acronyms(late).collect()} == {0: 2}
    assert [r.w for r in nodes.select(entities.words_of(F.coalesce("label", F.lit(""))).alias("w")).collect()][7] == ["XML", "Http"]


def test_corefer_takes_names_and_edges(spark):
    nodes = made(spark, [("a", "Attention", "method", "a longer text", "", [], "", 1.0), ("b", "Attention Mechanism", "method", "short", "", ["x"], "", 1.0), ("c", "Result Z", "result", "", "", [], "", 1.0), ("d", "AM", "concept", "", "", [], "", 1.0)])
    edges = spark.createDataFrame([(1, 0, "a", "b", "part_of"), (1, 1, "a", "c", "reports"), (1, 2, "d", "c", "reports")], "paper_id long, ord long, source string, target string, relation string")
    kept, between = graph.corefer(nodes, edges)
    assert {r.id: (r.aliases, r.description) for r in kept.collect()} == {"b": (["x", "Attention", "AM"], "a longer text"), "c": ([], "")}
    assert [(r.source, r.target, r.relation) for r in between.collect()] == [("b", "c", "reports")]
    none = spark.createDataFrame([], NODES)
    assert entities.corefer(none).collect() == [] and graph.coreference(none).collect() == []


ANSWER = "paper_id long, batch int, response string"


def answer(nodes, edges):
    return "```json\n" + json.dumps({"nodes": [{"id": i, "label": x, "type": "method"} for i, x in nodes], "edges": [{"source": s, "target": t, "relation": "uses"} for s, t in edges]}) + "\n```"


def test_batches_keep_ids_apart(spark):
    rows = [(1, 0, answer([("x", "Alpha"), ("y", "Beta")], [("x", "y")])), (1, 1, answer([("n", "Gamma"), ("x", "Delta"), ("b", "beta")], [("n", "b"), ("x", "b"), ("n", "gone")])), (1, 2, "no answer"), (2, 0, "none"), (2, 1, "{")]
    nodes, edges, failed = answers.build(spark.createDataFrame(rows, ANSWER))
    assert {r.id: (r.label, r.aliases) for r in nodes.collect()} == {"x": ("Alpha", ["Delta"]), "y": ("Beta", ["beta"]), "n": ("Gamma", [])}
    assert sorted((r.source, r.target) for r in edges.collect()) == [("n", "y"), ("x", "y")]
    assert [r.paper_id for r in failed.collect()] == [2]
    sections = spark.createDataFrame([(1, i, f"s{i}") for i in range(7, 0, -1)], "paper_id long, ord int, text string")
    assert [tuple(r) for r in answers.batches(sections).orderBy("batch").collect()] == [(1, 0, "\n\n".join(f"s{i}" for i in range(1, 7))), (1, 1, "s7")]


def test_stages_resume(spark, tmp_path):
    sections = spark.createDataFrame([(1, 1, "Method", "Method", "we use Alpha Net"), (1, 2, "Data", "Data", "on Beta")], "paper_id long, ord int, title string, section_path string, text string")
    asked = []

    def table(name, rows):
        def make():
            asked.append(name)
            return rows

        return make

    inputs = {
        "papers": table("papers", spark.createDataFrame([(1, "A Paper")], "paper_id long, title string")), "sections": table("sections", sections),
        "answers": table("answers", spark.createDataFrame([(1, 0, answer([("a", "Alpha Net"), ("an", "AN"), ("z", "Nowhere"), ("m", "method")], [("a", "z"), ("an", "a"), ("a", "m")]))], ANSWER)),
    }
    whole = staged.run(spark, inputs, f"{tmp_path}/a")
    assert [r["stage"] for r in whole[2]] == list(staged.STAGES) and not any(r["skipped"] for r in whole[2])
    labels = sorted(r.label for r in whole[0].collect())
    assert labels == ["A Paper", "Data", "Method"]  # what is grounded has no edge left
    assert staged.summary(whole[:2]).first().briefing.startswith("Knowledge graph: 3 nodes, 2 relations.")
    for cut in (1,):
        folder = f"{tmp_path}/cut{cut}"
        staged.run(spark, inputs, folder, stages=list(staged.STAGES[: cut + 1]))
        asked.clear()
        nodes, edges, report = staged.run(spark, inputs, folder)
        assert [r["skipped"] for r in report] == [i <= cut for i in range(len(staged.STAGES))]
        assert ("papers" in asked) is False and ("answers" in asked) == (cut < 1)
        assert sorted(nodes.collect()) == sorted(whole[0].collect()) and sorted(edges.collect()) == sorted(whole[1].collect())
    # a stage whose manifest is missing or wrong is made again
    kept = staged.Checkpoints(spark, f"{tmp_path}/a")
    assert kept.manifest("coref") and kept.manifest("other") is None
    spark.createDataFrame([("{broken",)], "value string").write.mode("overwrite").text(f"{tmp_path}/a/coref/manifest")
    assert kept.manifest("coref") is None
    assert [r["stage"] for r in staged.run(spark, inputs, f"{tmp_path}/a")[2] if not r["skipped"]] == ["coref"]


def test_cache(spark, tmp_path):
    calls = spark.createDataFrame([(1, "verify", '{"text": "hi", "k": {"b": 1, "a": [2, 3]}}', "echo"), (2, "verify", '{"k": {"a": [2, 3], "b": 1}, "text": "hi"}', "echo"), (3, "verify", '{"k": {"a": [3, 2], "b": 1}, "text": "hi"}', "echo"), (4, "verify", '{"text": "hi", "k": {"b": 1, "a": [2, 3]}}', None), (5, "fails", "{}", ""), (6, "fails", "{", "x"), (7, "verify", None, "x")], "i int, action string, payload string, model string")
    seen = []

    def compute(asked):
        seen.append(asked.count())
        return asked.select("key", F.concat(F.lit("r"), "action").alias("result"), F.when(F.col("payload") == "{}", "error").alias("error"))

    cache = caching.ResultCache(spark, f"{tmp_path}/cache")
    assert cache.stored().count() == 0
    first = {r.i: (r.result, r.hit, r.key) for r in cache.through(calls, compute).collect()}
    assert first[1][2] == first[2][2] and len({first[i][2] for i in (1, 3, 4, 5)}) == 4 and first[6][2] is None and len(first[1][2]) == 32
    assert seen == [6] and all(x[:2] in (("rverify", False), ("rfails", False)) for x in first.values())
    again = {r.i: r.hit for r in cache.through(calls, compute).collect()}
    assert again == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False} and seen == [6, 3]
    third = cache.through(calls.where("i < 5"), compute)
    assert third.count() == 4 and seen == [6, 3] and cache.stored().count() == 3
    (tmp_path / "cache" / "part-broken.parquet").write_text("not a file of this kind")
    assert cache.stored().count() == 3


@pytest.mark.parametrize(("text", "expected"), [('{"b":1,"a":{"d":[{"z":1,"y":2}],"c":null}}', '{"a":{"c":null,"d":[{"y":2,"z":1}]},"b":1}'), ("[2, 1]", "[2,1]"), ("no", None), (None, None)])
def test_canonical(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(caching.canonical(F.col("t"))).first()[0] == expected
