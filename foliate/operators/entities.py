"""Entities of knowledge graphs made one: nodes that repeat an id or a label, acronyms, and like labels.

All of it is joins on keys of a paper and rounds of them until nothing
changes; no paper's nodes are gathered in one task. ``nodes`` are those of
``graph``, told apart by (paper_id, ord); their order decides.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.lines import let
from foliate.functions.text import squash, strip
from foliate.storage import settled

# How an acronym looks, and the share of words at which labels are alike.
ACRONYM, ALIKE = r"^[A-Z][A-Z0-9]{1,4}$", 0.8
#: Letters in a row by which labels within labels are found.
GRAM = 3


def label_key(label: Column) -> Column:
    return F.lower(squash(F.regexp_replace(F.coalesce(label, F.lit("")), r"[\r\n\t]", " ")))


def first_come(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(paper_id, ord, to): the earlier node that each node joins, or itself.

    In their order, nodes stay or join the earliest of those that stayed with
    an equal value in one of the ``keys``; a key that is null joins nothing. A node
    that comes first among what is left with each of its values stays, and all
    with one of these values are decided; rounds of this end when none is left,
    after about as many as the logarithm of the nodes, in an order by chance.
    """
    left, stays = settled(nodes.select("paper_id", "ord", *keys)), None
    while not left.isEmpty():
        first = left
        for i, key in enumerate(keys):
            least = left.where(F.col(key).isNotNull()).groupBy("paper_id", key).agg(F.min("ord").alias(f"_first{i}"))
            first = first.join(least, ["paper_id", key], "left")
        mine = [F.coalesce(F.col(f"_first{i}") == F.col("ord"), F.lit(True)) for i in range(len(keys))]
        found = settled(first.where(reduce(and_, mine)).select("paper_id", "ord", *keys))
        stays = found if stays is None else stays.unionAll(found)
        left = left.join(found.select("paper_id", "ord"), ["paper_id", "ord"], "left_anti")
        for key in keys:
            left = left.join(found.where(F.col(key).isNotNull()).select("paper_id", key), ["paper_id", key], "left_anti")
        left = settled(left)
    own = nodes.select("paper_id", "ord", *keys)
    if stays is None:
        return own.select("paper_id", "ord", F.col("ord").alias("to"))
    for i, key in enumerate(keys):
        # of the nodes that stayed, one at most has a value
        own = own.join(stays.where(F.col(key).isNotNull()).select("paper_id", key, F.col("ord").alias(f"_to{i}")), ["paper_id", key], "left")
    earlier = [F.when(F.col(f"_to{i}") <= F.col("ord"), F.col(f"_to{i}")) for i in range(len(keys))]
    return own.select("paper_id", "ord", F.least(F.col("ord"), *earlier).alias("to"))


def resolve(nodes: DataFrame) -> DataFrame:
    """(paper_id, ord, to, canonical): the node that each node joins and its id; nodes are one by their id, or by type and label."""
    keyed = nodes.select("paper_id", "ord", F.col("id").alias("_id"), F.concat_ws("\n", "type", label_key(F.col("label"))).alias("_label"))
    to = first_come(keyed, ["_id", "_label"])
    names = nodes.select("paper_id", F.col("ord").alias("to"), F.col("id").alias("canonical"))
    return settled(to.join(names, ["paper_id", "to"]).select("paper_id", "ord", "to", "canonical"))


def absorbed(nodes: DataFrame, to: DataFrame) -> DataFrame:
    """The nodes that others join, with what those add: ``to`` is (paper_id, ord, to).

    The longest description stays, the first of equals, and brings its path
    along where it has one; else the first path and evidence that is there;
    the highest confidence; further labels and aliases in the nodes' order,
    without the label and without repeats.
    """
    joined = nodes.join(to.select("paper_id", "ord", "to"), ["paper_id", "ord"])
    size, group = F.length(F.coalesce("description", F.lit(""))), Window.partitionBy("paper_id", "to").orderBy("ord")
    longest = F.max(size).over(group.rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumns({"_size": size, "_longer": size > longest, "_own": F.col("ord") == F.col("to")})
    path, evidence = F.nullif(F.col("section_path"), F.lit("")), F.nullif(F.col("evidence"), F.lit(""))
    names = F.when(~F.col("_own"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("label")))
    merged = joined.groupBy("paper_id", "to").agg(
        F.max_by("description", F.struct("_size", -F.col("ord"))).alias("description"),
        F.coalesce(F.max_by(path, F.when(F.col("_longer") & path.isNotNull(), F.col("ord"))), F.min_by(path, F.when(path.isNotNull(), F.col("ord")))).alias("_path"),
        F.min_by(evidence, F.when(evidence.isNotNull(), F.col("ord"))).alias("_evidence"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_list(F.when(~F.col("_own"), F.struct("ord", names.alias("names"))))).alias("_names"),
    )
    own = nodes.drop("description", "confidence").withColumnRenamed("ord", "to")
    before = F.coalesce("aliases", F.array().cast("array<string>"))
    more = F.filter(F.array_distinct(F.flatten(F.transform("_names", lambda n: n["names"]))), lambda n: n.isNotNull() & (n != "") & ~F.array_contains(before, n) & (n != F.coalesce("label", F.lit(""))))
    out = own.join(merged, ["paper_id", "to"]).withColumnRenamed("to", "ord")
    out = out.withColumns({"section_path": F.coalesce("_path", "section_path"), "evidence": F.coalesce("_evidence", "evidence"), "aliases": F.concat(before, more)})
    return out.select(nodes.columns)


def merge(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with one for each entity, and (paper_id, ord, to, canonical) for all that there were."""
    to = resolve(nodes)
    return absorbed(nodes, to), to


def words_of(label: Column) -> Column:
    """Words between blanks, dashes, underscores and slashes, and at the humps of camel case."""
    pieces = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+"
    parts = F.filter(F.split(strip(label), r"[\s\-_/]+"), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: let(F.regexp_extract_all(p, F.lit(pieces), F.lit(0)), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(p)))))


def acronyms(nodes: DataFrame) -> DataFrame:
    """(paper_id, ord, to): acronyms whose letters begin the words of another node's label, and the first such node.

    A label that is an acronym itself may be the long form of a shorter one,
    as long as it did not go to its own long form before. Longer acronyms are
    decided first; there are four lengths.
    """
    words = words_of(F.col("label"))
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    label = strip(F.col("label"))
    rows = nodes.select("paper_id", "ord", "id", F.when(label.rlike(ACRONYM), label).alias("short"), F.when(F.size(words) > 1, initials).alias("long"))
    shorts = rows.where("short is not null").select("paper_id", "ord", "id", F.col("short").alias("long"))
    longs = rows.where("long is not null").select("paper_id", F.col("ord").alias("to"), F.col("id").alias("_id"), "long")
    pairs = settled(shorts.join(longs, ["paper_id", "long"]).where("id != _id").select("paper_id", "ord", "to", F.length("long").alias("size")))
    gone = None
    for size in (5, 4, 3, 2):
        some = pairs.where(F.col("size") == size)
        if gone is not None:
            before = gone.select("paper_id", F.col("ord").alias("to"), F.lit(True).alias("_gone"))
            some = some.join(before, ["paper_id", "to"], "left").where("_gone is null or to > ord").drop("_gone")
        found = some.groupBy("paper_id", "ord").agg(F.min("to").alias("to"))
        gone = found if gone is None else gone.unionAll(found)
    return settled(gone)


def _candidates(rows: DataFrame) -> DataFrame:
    """(paper_id, a, b) with a before b: labels of a type that share a word of the smaller one's rarest, or a gram as rare as any of the shorter one's."""
    place = ["paper_id", "type"]

    def meet(keys: DataFrame, rarest: Column, smaller: Column) -> DataFrame:
        counted = keys.join(keys.groupBy(*place, "key").agg(F.count(F.lit(1)).alias("n")), [*place, "key"])
        rank = F.row_number().over(Window.partitionBy("paper_id", "ord").orderBy("n", "key"))
        few = counted.withColumn("_rank", rank).where(F.col("_rank") <= rarest).select(*place, "key", F.col("ord").alias("x"), F.col("size").alias("x_size"))
        both = few.join(keys.select(*place, "key", F.col("ord").alias("y"), F.col("size").alias("y_size")), [*place, "key"]).where("x != y").where(smaller)
        return both.select("paper_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    by_word = rows.select(*place, "ord", F.size("words").alias("size"), F.explode("words").alias("key"))
    prefix = F.col("size") - F.ceil(F.col("size") * ALIKE - 1e-9) + 1
    # a label in another: one gram of it, or all of it where it is shorter than a gram
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("lower") - n + 1)), lambda i: F.substring(F.col("lower"), i, F.lit(n)))
    by_gram = rows.select(*place, "ord", F.length("lower").alias("size"), F.explode(F.array_distinct(F.flatten(F.array(*(grams(n) for n in range(1, GRAM + 1)))))).alias("key"))
    probe = F.length("key") == F.least(F.lit(GRAM), F.col("size"))
    counted = by_gram.groupBy(*place, "key").agg(F.count(F.lit(1)).alias("n"))
    one = by_gram.where(probe).join(counted, [*place, "key"]).groupBy("paper_id", "type", "ord", "size").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    one = one.select(*place, "key", F.col("ord").alias("x"), F.col("size").alias("x_size"))
    within = one.join(by_gram.select(*place, "key", F.col("ord").alias("y"), F.col("size").alias("y_size")), [*place, "key"]).where("x != y and x_size <= y_size")
    within = within.select("paper_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return meet(by_word, prefix, F.col("x_size") <= F.col("y_size")).unionAll(within).distinct()


def alike(nodes: DataFrame) -> DataFrame:
    """(paper_id, a, b, longer): pairs of one type whose labels are unlike but one within the other, or share four fifths of the smaller one's words; whether b's label is the longer."""
    label = F.coalesce("label", F.lit(""))
    lower = F.lower(strip(label))
    words = F.array_distinct(F.transform(words_of(label), F.lower))
    rows = settled(nodes.select("paper_id", "ord", "type", lower.alias("lower"), words.alias("words"), F.length(label).alias("length")).where("lower != ''"))
    x, y = (rows.select("paper_id", F.col("ord").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("lower", "words", "length"))) for n in "ab")
    both = _candidates(rows).join(x, ["paper_id", "a"]).join(y, ["paper_id", "b"]).where("a_lower != b_lower")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    near = F.contains("a_lower", F.col("b_lower")) | F.contains("b_lower", F.col("a_lower")) | ((shared > 0) & (shared / F.least(F.size("a_words"), F.size("b_words")) >= ALIKE))
    return settled(both.where(near).select("paper_id", "a", "b", (F.col("b_length") > F.col("a_length")).alias("longer")))


def shorter_to_longer(pairs: DataFrame) -> DataFrame:
    """(paper_id, ord, to) of the nodes that go: in the order of pairs, the one with the shorter label goes, the later of equals.

    A node takes in the later ones it is like, up to the first that is longer
    and takes it in. Its turn has come when no earlier node is like it, and it is the
    first of all that are like one of the later. Rounds decide all whose turn
    it is, until no pair is left.
    """
    left, gone = pairs, None
    while not left.isEmpty():
        first = left.groupBy("paper_id", F.col("b").alias("v")).agg(F.min("a").alias("first"))
        waits = left.join(first.withColumnRenamed("v", "b"), ["paper_id", "b"])
        ready = waits.groupBy("paper_id", "a").agg(F.bool_and(F.col("first") == F.col("a")).alias("alone"), F.min(F.when(F.col("longer"), F.col("b"))).alias("over")).where("alone").drop("alone")
        ready = ready.join(first.select("paper_id", F.col("v").alias("a")), ["paper_id", "a"], "left_anti")
        turns = settled(left.join(ready, ["paper_id", "a"]))
        taken = turns.where("over is null or b < over").select("paper_id", F.col("b").alias("ord"), F.col("a").alias("to"))
        taken = settled(taken.unionAll(turns.where("b = over").select("paper_id", F.col("a").alias("ord"), F.col("b").alias("to"))))
        gone = taken if gone is None else gone.unionAll(taken)
        out = taken.select("paper_id", "ord")
        left = left.join(ready.select("paper_id", "a"), ["paper_id", "a"], "left_anti")
        for end in "ab":
            left = left.join(out.withColumnRenamed("ord", end), ["paper_id", end], "left_anti")
        left = settled(left)
    return pairs.selectExpr("paper_id", "a as ord", "b as to").limit(0) if gone is None else gone


def followed(steps: DataFrame) -> DataFrame:
    """(paper_id, ord, to) with ``to`` where the steps end; each round doubles how far a step reaches."""
    steps = settled(steps)
    while True:
        on = steps.select("paper_id", F.col("ord").alias("to"), F.col("to").alias("_on"))
        further = settled(steps.join(on, ["paper_id", "to"], "left").select("paper_id", "ord", F.coalesce("_on", "to").alias("to"), F.col("_on").isNotNull().alias("_moved")))
        steps = further.drop("_moved")
        if further.where("_moved").isEmpty():
            return steps


def corefer(nodes: DataFrame) -> DataFrame:
    """(paper_id, ord, to) of the nodes that stand for another one: acronyms for their long form, then the shorter of like labels of a type for the longer."""
    short = acronyms(nodes)
    rest = nodes.join(short.select("paper_id", "ord"), ["paper_id", "ord"], "left_anti")
    return followed(short.unionAll(shorter_to_longer(alike(rest))))
