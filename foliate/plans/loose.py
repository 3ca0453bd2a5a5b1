"""Queries of citations and reviews in JSON of several shapes. Both engines make the same texts from ``part``, and each parses them."""

from __future__ import annotations

from foliate.operators import loose
from foliate.operators.scores import AXES
from foliate.plans.documents import table
from foliate.storage import settled, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return add


def _entry(i: int) -> str:
    """An entry of a list, of five kinds, as an expression."""
    k = f"(p_partkey + {i} * 3) % 6"
    return f"""CASE {k} WHEN 0 THEN concat('{{"key": "k', p_size % 3, '", "title": "T', p_partkey, '{i}"}}') WHEN 1 THEN concat('{{"citation_key": " c{i} ", "record": {{"title": "R ', p_brand, '", "abstract": "A"}}, "source": "s1", "title": "own"}}')
  WHEN 2 THEN concat('{{"key": "k', p_size % 3, '", "title": ', p_size, ', "abstract": true, "record": 3, "source": 0}}') WHEN 3 THEN '12' WHEN 4 THEN '{{"title": "no key", "source": "s"}}' ELSE concat('{{"citation_key": null, "key": ', p_size % 2, ', "record": {{"source": "deep"}}, "abstract": "B"}}') END"""


LIST = f"concat('[', {_entry(0)}, ', ', {_entry(1)}, ', ', {_entry(2)}, ', null]')"
MAP = f"""concat('{{"m1": ', {_entry(0)}, ', "m2": ', {_entry(1)}, ', "a0": {{"title": "A"}}}}')"""
CITATIONS = f"""CASE p_partkey % 9 WHEN 0 THEN {LIST} WHEN 1 THEN concat('{{"verified": ', {LIST}, '}}') WHEN 2 THEN concat('{{"x": 1, "structured": {{"verified": ', {LIST}, '}}, "verified": []}}') WHEN 3 THEN {_entry(0)}
  WHEN 4 THEN {MAP} WHEN 5 THEN '"text"' WHEN 6 THEN 'no json [' WHEN 7 THEN concat('{{"structured": {{"other": 1}}, "verified": ', {MAP}, '}}') ELSE '{{"structured": 5, "verified": null}}' END AS raw"""


def _truth(x: str) -> str:
    return f"(CASE json_type({x}) WHEN 'VARCHAR' THEN ({x}->>'$') != '' WHEN 'BOOLEAN' THEN ({x}->>'$') = 'true' WHEN 'NULL' THEN false WHEN 'ARRAY' THEN json_array_length({x}) > 0 WHEN 'OBJECT' THEN len(json_keys({x})) > 0 ELSE CAST({x}->>'$' AS DOUBLE) != 0 END)"


def _text(x: str) -> str:
    return f"(CASE json_type({x}) WHEN 'BOOLEAN' THEN CASE ({x}->>'$') WHEN 'true' THEN 'True' ELSE 'False' END WHEN 'NULL' THEN 'None' ELSE {x}->>'$' END)"


def _first(*values: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {_truth(v)} THEN {_text(v)} END" for v in values) + ")"


@query("loose_citations", f"""WITH r AS (SELECT p_partkey, {CITATIONS} FROM part), j AS (SELECT p_partkey, TRY_CAST(raw AS JSON) AS j FROM r),
v AS (SELECT p_partkey, CASE WHEN json_type(j->'$.structured') = 'OBJECT' AND json_exists(j, '$.structured.verified') THEN j->'$.structured.verified' WHEN json_exists(j, '$.verified') THEN j->'$.verified' ELSE j END AS v FROM j),
one AS (SELECT *, json_type(v) = 'OBJECT' AND (json_exists(v, '$.citation_key') OR json_exists(v, '$.key')) AS one FROM v),
i AS (SELECT p_partkey, 0 AS pos, NULL AS name, v AS x FROM one WHERE one
  UNION ALL SELECT p_partkey, generate_subscripts(CAST(v AS JSON[]), 1), NULL, unnest(CAST(v AS JSON[])) FROM one WHERE json_type(v) = 'ARRAY'
  UNION ALL SELECT p_partkey, generate_subscripts(list_sort(json_keys(v)), 1), unnest(list_sort(json_keys(v))), unnest(list_transform(list_sort(json_keys(v)), lambda k: v->k)) FROM one WHERE json_type(v) = 'OBJECT' AND NOT one),
k AS (SELECT *, x->'$.key' AS own, CASE WHEN json_type(x->'$.record') = 'OBJECT' THEN x->'$.record' ELSE x END AS rec FROM i WHERE json_type(x) = 'OBJECT' OR name IS NOT NULL),
f AS (SELECT p_partkey, pos, trim(coalesce({_first("(x->'$.citation_key')", "own")}, CASE WHEN own IS NULL THEN name END)) AS key, {{'title': coalesce({_first("(rec->'$.title')", "(x->'$.title')")}, ''), 'abstract': coalesce({_first("(rec->'$.abstract')", "(x->'$.abstract')")}, ''),
  'source': {_first("(x->'$.source')", "(rec->'$.source')")}}} AS s FROM k)
SELECT p_partkey, key, arg_max(s, pos).title AS title, arg_max(s, pos).abstract AS abstract, arg_max(s, pos).source AS source FROM f WHERE key != '' GROUP BY ALL""")
def loose_citations(spark, sf_dir):
    return loose.citations(settled(spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey", CITATIONS)), ["p_partkey"])


def _value(*kinds: str) -> str:
    return f"CASE p_partkey % {len(kinds)} " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END"


SCORES = ", ".join(
    f"""', "{axis.title() if i % 2 else axis}": ', """ + _value("CAST(p_size AS VARCHAR(9))", f"concat('\"', p_size % 5, '.5\"')", "'true'", "'\"seven\"'", "concat(p_size % 7, '.5')", "'null'", "'[2]'", "'\" 3 \"'") for i, axis in enumerate(list(AXES)[:5])
)
REVIEW = f"""CASE WHEN p_partkey % 13 = 0 THEN '[1]' WHEN p_partkey % 17 = 0 THEN 'none' ELSE concat('{{"Summary": ', {_value("'\"Well done\"'", "'5'", "'null'", "'0'", "'\"\"'")}, ', "strengths": ', {_value("'\" one \"'", "'[\"a\", \" \", 3, null, true]'", "'7'", "'null'", "'\"  \"'", "'[]'")},
  ', "Questions ": ', {_value("'false'", "'[\"q\"]'", "'\"why\"'")}, ', "Ethical Concerns": ', {_value("'\"Yes\"'", "'\"no\"'", "'true'", "'0'", "'[]'", "'[0]'", "'null'", "'2'")}, ', "decision": ', {_value("'\"Weak Accept\"'", "'\"Reject\"'", "'true'", "'\" ACCEPTED\"'")}, {SCORES}, '}}') END AS raw"""


def _score(axis: str) -> str:
    low, high = AXES[axis]
    x = f"p['{axis}']"
    # half to even
    return f"CAST(least(greatest(coalesce(round_even(CASE json_type({x}) WHEN 'BOOLEAN' THEN CASE ({x}->>'$') WHEN 'true' THEN 1.0 ELSE 0.0 END WHEN 'VARCHAR' THEN TRY_CAST(trim({x}->>'$') AS DOUBLE) WHEN 'ARRAY' THEN NULL WHEN 'NULL' THEN NULL ELSE CAST({x}->>'$' AS DOUBLE) END, 0), {low}), {low}), {high}) AS INTEGER) AS {axis}"


def _listed(name: str) -> str:
    x = f"p['{name}']"
    items = f"list_filter(list_transform(list_transform(range(0, CAST(json_array_length({x}) AS BIGINT)), lambda n: json_extract({x}, '$[' || n || ']')), lambda i: {_text('i')}), lambda i: trim(i) != '')"
    return f"array_to_string(CASE json_type({x}) WHEN 'ARRAY' THEN {items} WHEN 'VARCHAR' THEN list_filter([trim({x}->>'$')], lambda i: i != '') WHEN 'NULL' THEN [] ELSE CASE WHEN {x} IS NULL THEN [] ELSE [{_text(x)}] END END, '|') AS {name}"


@query("loose_reviews", f"""WITH r AS (SELECT p_partkey, {REVIEW} FROM part), j AS (SELECT p_partkey, TRY_CAST(raw AS JSON) AS j FROM r),
m AS (SELECT p_partkey, CASE WHEN json_type(j) = 'OBJECT' THEN map_from_entries(list_transform(json_keys(j), lambda k: (replace(lower(trim(k)), ' ', '_'), j->k))) ELSE MAP {{}} END AS p FROM j)
SELECT p_partkey, coalesce(CASE WHEN {_truth("p['summary']")} THEN {_text("p['summary']")} END, '') AS summary, {_listed("strengths")}, {_listed("questions")},
  coalesce(CASE json_type(p['ethical_concerns']) WHEN 'VARCHAR' THEN lower(p['ethical_concerns']->>'$') IN ('true', 'yes', '1') ELSE {_truth("p['ethical_concerns']")} END, false) AS ethical_concerns,
  {", ".join(map(_score, AXES))}, CASE WHEN json_type(p['decision']) = 'VARCHAR' AND contains(lower(p['decision']->>'$'), 'accept') THEN 'Accept' ELSE 'Reject' END AS decision FROM m""")
def loose_reviews(spark, sf_dir):
    found = loose.reviews(spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey", REVIEW), ["p_partkey"])
    return found.selectExpr("p_partkey", "summary", "array_join(strengths, '|') as strengths", "array_join(questions, '|') as questions", "ethical_concerns", *AXES, "decision")
