"""Bounds of title ratios: pairs that are left out change nothing."""

import random

from foliate.operators import scholarly


def test_bounds_change_no_result(spark):
    draw = random.Random(6)
    words = ["graph", "neural", "net", "Networks", "deep", "", "tree", "ä", "of", "the"]
    title = lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(0, 6)))
    references = [(i, i % 5, title(), draw.choice([None, 2000, 2001])) for i in range(40)]
    records = [(k, n, draw.choice([title(), references[draw.randrange(40)][2] + draw.choice(["", "s", " net"])]), draw.choice([None, 2000, 2001]), draw.choice(["", "text"])) for k in range(5) for n in range(25)]
    refs = spark.createDataFrame(references, "ref_id int, search_key int, query_title string, year_hint int")
    found = spark.createDataFrame([(*r, None) for r in records], "search_key int, rec_ord int, title string, year int, abstract string, publication_date string")
    exact = scholarly.score(refs, found)
    for r in scholarly.bounded(refs, found).join(exact.select("ref_id", "rec_ord", "ratio"), ["ref_id", "rec_ord"]).collect():
        assert r.bound >= r.ratio
    fields = ["ref_id", "title", "year", "points"]
    some, every = scholarly.score_matches(refs, found), scholarly.best_match(exact).select(fields).collect()
    assert sorted(map(str, scholarly.best_match(some).select(fields).collect())) == sorted(map(str, every)) and 0 < some.count() < exact.count() and every
    best = scholarly.score_best(refs, found)
    assert sorted(map(str, scholarly.grade(refs, best).collect())) == sorted(map(str, scholarly.grade(refs, exact).collect())) and best.count() < exact.count()


def test_copies_are_compared_once(spark):
    """Ten times the references and records: ten times the answers of the brute force, from as many pairs of titles."""
    draw = random.Random(7)
    names = ["deep graph net", "deep graph nets", "deep grape net", "tree of words", "tree of swords", "trees", ""]
    references = [(i, i % 3, draw.choice([*names, None]), draw.choice([None, 2000, 2001])) for i in range(30)]
    records = [(k, n, draw.choice(names), draw.choice([None, 2000, 2001]), draw.choice(["", "text", None]), draw.choice([None, "2001-05-03"])) for k in range(3) for n in range(40)]
    fields = ["ref_id", "title", "year", "points"]

    def inputs(times):
        refs = [(r[0] + 100 * t, *r[1:]) for r in references for t in range(times)]
        found = [(r[0], r[1] + 100 * t, *r[2:]) for r in records for t in range(times)]
        return spark.createDataFrame(refs, "ref_id int, search_key int, query_title string, year_hint int"), spark.createDataFrame(found, "search_key int, rec_ord int, title string, year int, abstract string, publication_date string")

    seen = lambda rows: sorted(map(str, rows.collect()))
    for times in (1, 10):
        refs, found = inputs(times)
        exact = scholarly.score(refs, found)
        for cutoff in (None, "2001-01"):
            assert seen(scholarly.match(refs, found, cutoff).select(fields)) == seen(scholarly.best_match(exact, cutoff).select(fields))
        assert seen(scholarly.match_grade(refs, found)) == seen(scholarly.grade(refs, exact))
        counted = {r.ref_id: r for r in scholarly.bound_counts(refs, found).collect()}
        for r in scholarly.bounded(refs, found).groupBy("ref_id").agg({"*": "count", "bound": "max"}).collect():
            assert (counted[r.ref_id].found, counted[r.ref_id].best_bound) == (r["count(1)"], r["max(bound)"])
        assert scholarly._title_pairs(refs, found, "search_key").count() == scholarly._title_pairs(*inputs(1), "search_key").count()


def test_many_citations_share_a_key(spark):
    """Suffixes go on by code points, past 256 and past the surrogates."""
    last = 0xD800 - 96 + 1
    rows = spark.range(1, last + 1).selectExpr("1 as grp", "id as ord", "'k' as citation_key")
    keys = [r.citation_key for r in scholarly.suffix_keys(rows, ["grp"]).orderBy("ord").collect()]
    assert keys[:2] == ["ka", "kb"] and keys[158:161] == ["k\u00ff", "k\u0100", "k\u0101"]
    assert keys[:-2] == ["k" + chr(97 + i) for i in range(last - 2)] and keys[-2:] == ["k\ue000", "k\ue001"] and len(set(keys)) == last
