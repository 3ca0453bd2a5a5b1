"""Citations and reviews from JSON of several shapes."""

import pytest

from foliate.operators import loose


@pytest.mark.parametrize(("raw", "expected"), [
    ('[{"key": "a", "title": "T"}, {"citation_key": " b ", "record": {"title": "R", "abstract": "A", "source": "s"}, "source": ""}, {"key": "a", "title": "last"}, 3, null]', [("a", "last", "", None), ("b", "R", "A", "s")]),
    ('{"key": "c", "title": 5}', [("c", "5", "", None)]),
    ('{"m": {"title": "x"}, "n": {"key": "q", "title": true}, "o": 7, "p": {"key": ""}}', [("m", "x", "", None), ("o", "", "", None), ("q", "True", "", None)]),
    ('{"action": "x", "structured": {"verified": {"w": {"record": {"abstract": "z"}, "title": "own"}}}}', [("w", "own", "z", None)]),
    ('{"structured": {"a": 1}, "verified": null}', []), ('{"citation_key": null, "key": "k"}', [("k", "", "", None)]), ('"text"', []), ("no json", []), (None, []), ("{}", []), ("[]", []),
])
def test_citations(spark, raw, expected):
    found = loose.citations(spark.createDataFrame([(1, raw)], "i int, raw string"), ["i"]).orderBy("key").collect()
    assert [tuple(r)[1:] for r in found] == expected


def test_reviews(spark):
    raws = [
        '{"Summary": "s", "Strengths": "one ", "Weaknesses": ["a", " ", 3, null, true], "Ethical Concerns": "Yes", "Overall": "7.5", "confidence": 2.5, "originality": 99, "quality": "x", "clarity": true, "Decision": "Weak Accept"}',
        '{"summary": 0, "questions": 5, "limitations": {"a": 1}, "ethical_concerns": 1, "overall": [1], "decision": true}', "[1]", None, '{"ethical_concerns": [], "overall": "nan", "soundness": -3, "strengths": ""}',
    ]
    a, b, *rest = loose.reviews(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"), ["i"]).orderBy("i").collect()
    assert (a.summary, a.strengths, a.weaknesses, a.ethical_concerns, a.overall, a.confidence, a.originality, a.quality, a.clarity, a.decision) == ("s", ["one"], ["a", "3", "None", "True"], True, 8, 2, 4, 1, 1, "Accept")
    assert (b.summary, b.questions, b.limitations, b.ethical_concerns, b.overall, b.decision) == ("", ["5"], ['{"a":1}'], True, 1, "Reject")
    assert len(rest) == 3 and all((r.summary, r.strengths, r.ethical_concerns, r.overall, r.soundness, r.decision) == ("", [], False, 1, 1, "Reject") for r in rest)
