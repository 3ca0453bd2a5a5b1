"""Column functions on text: words, trimming, slugs, citation commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: LaTeX citation commands with options, and the braces of keys.
CITE = r"\\cite[a-zA-Z]*\s*(?:\[[^\]]*\])*\s*\{([^}]*)\}"
ELLIPSIS = "…"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, limit: int = 280) -> Column:
    """Trimmed text of at most ``limit`` characters, an ellipsis in place of what is cut."""
    whole = strip(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, limit - 1), r"\s+$", ""), F.lit(ELLIPSIS)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def cite_keys(text: Column) -> Column:
    """The distinct keys of all citation commands, sorted."""
    groups = F.regexp_extract_all(text, F.lit(CITE), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda k: strip(k))))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def claim_sentences(text: Column) -> Column:
    """The sentences, cut after a closing mark before white space, and at blank lines."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n{2,}"), lambda s: strip(s)), lambda s: s != "")


def without_cites(text: Column) -> Column:
    """A sentence without its citation commands, tidied at the ends."""
    bare = F.regexp_replace(F.regexp_replace(text, CITE, ""), r"\s+", " ")
    return F.regexp_replace(bare, r"^[ ,;()\[\]]+|[ ,;()\[\]]+$", "")
