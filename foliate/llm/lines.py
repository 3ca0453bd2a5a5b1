"""Line dedup: an exact set-similarity join of lines by their words, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.common import cut, written

#: Jaccard similarity at which the later of two lines goes.
THRESHOLD = 0.8
#: Counters of word frequency, and bits that tell which lines are candidates: fixed sizes, whatever the data.
COUNTERS, BITS = 1 << 20, 1 << 22
#: Frequencies are kept as logarithms, STEPS to a doubling, above the bits of a word's hash.
STEPS, HASH_BITS = 4096, 33
#: Lines of more words have a signature of 128 bits, others of 64.
LONG = 80
#: Earliest lines of a word's group that the first round probes, and by how much each further round reaches on.
FIRST_REACH, REACH = 256, 8
#: The words of a task fit a dictionary of this size, and then take less than four bytes each.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(4 << 20)}
#: Words that occur in so many lines have groups that are not gathered in one task.
FREQUENT = 100_000


def _shift(value: Column, by: int | Column) -> Column:
    return F.call_function("shiftleft", value, F.lit(by) if isinstance(by, int) else by)


def _bit(number: Column, bits: int = 64) -> Column:
    return _shift(F.lit(1).cast("long"), number.bitwiseAND(F.lit(bits - 1)).cast("int"))


def _dense(rows: DataFrame, size: int, value: Column) -> DataFrame:
    """One row with an array of ``size`` values below 2^32, in the order of their slots; ``rows`` has slot and v, the aggregate ``value`` is over v."""
    empty = rows.sparkSession.range(size).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("v"))
    filled = rows.select(F.col("slot").cast("long").alias("slot"), F.col("v").cast("long").alias("v")).unionAll(empty).groupBy("slot").agg(value.alias("v"))
    packed = F.collect_list(_shift(F.col("slot"), 32).bitwiseOR(F.col("v")))
    return filled.agg(F.sort_array(packed).alias("values")).select(F.transform("values", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))).alias("values"))


def _lines(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row a line with words: its document (id and hash of the text), number, hash, and the 32-bit hashes of its distinct words."""
    whole = documents.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("k"), F.posexplode(F.split(F.lower(text), "\n")).alias("l", "_line"))
    # a line with more than blanks has a word; asked of the words, each would be hashed twice
    whole = whole.where(F.length(F.trim("_line")) > 0)
    hashes = F.transform(F.split("_line", " "), lambda w: F.hash(w))
    nothing = F.array(F.hash(F.lit("")))
    return whole.select("d", "k", "l", F.xxhash64("_line").alias("line"), F.array_except(hashes, nothing).alias("words"))


def _frequencies(lines: DataFrame) -> DataFrame:
    """One row: for each counter of hashed words the logarithm of its count, above HASH_BITS."""
    slots = lines.select(F.explode("words").alias("w")).select(F.col("w").bitwiseAND(F.lit(COUNTERS - 1)).alias("slot"))
    counted = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    dense = _dense(counted.select("slot", (F.floor(F.log2("n") * STEPS) + 1).alias("v")), COUNTERS, F.max("v"))
    return dense.select(F.transform("values", lambda v: _shift(v, HASH_BITS)).alias("values"))


def _entries(lines: DataFrame, frequencies: DataFrame, threshold: float) -> DataFrame:
    """A row for each word in the prefix of each distinct line: code, place in the order of rarity, the line's first place, size and signature.

    A code is a word's frequency before its hash, so that sorted codes begin
    with the rarest word. The signature's 128 bits are flipped once by each
    word, so two lines differ in at most as many bits as words.
    """

    def code(w: Column) -> Column:
        return F.coalesce(F.get(F.col("_counts"), w.bitwiseAND(F.lit(COUNTERS - 1))), F.lit(0).cast("long")) + w.cast("long")

    def flips(part: int) -> Column:
        # a shift by an int goes by its last six bits
        return F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(_shift(F.lit(1).cast("long"), F.shiftright(w, part) if part else w)))

    n = F.size("words")
    prefix = (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")
    rarest = F.slice(F.sort_array(F.transform("words", code)), F.lit(1), prefix)
    # long lines need the second half of the signature
    more = F.when(n > LONG, flips(6)).otherwise(F.lit(0).cast("long"))
    row = F.struct("d", "l", n.alias("n"), flips(0).alias("s"), more.alias("u"), rarest.alias("prefix"))
    distinct = lines.withColumn("_counts", frequencies.scalar()).select("line", row.alias("x")).groupBy("line").agg(F.min("x").alias("x"))
    rows = distinct.select("line", "x.d", "x.l", "x.n", "x.s", "x.u", F.posexplode("x.prefix").alias("at", "code"))
    # none of these is null; told so, the planner adds no filters, and all readers share one exchange
    return rows.select("d", "l", *(F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)).alias(c) for c in ("line", "n", "s", "u", "at", "code")))


def _close(a: str, b: str, t: float) -> Column:
    """Length, positional and signature filter of two entries of one code; ``a`` is the earlier."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    total = x("n") + y("n")
    # words that similar sets share at least, and differ in at most
    shared = F.ceil(F.lit(t / (1 + t)) * total - 1e-9)
    rest = F.least(x("n") - x("at"), y("n") - y("at"))
    differ = total - 2 * shared
    earlier = F.struct(x("d"), x("l"), x("line")) < F.struct(y("d"), y("l"), y("line"))
    near = (x("n") >= t * y("n") - 1e-9) & (y("n") >= t * x("n") - 1e-9) & (rest >= shared)
    # the second half is compared only where both have one
    half = (x("n") <= LONG) | (y("n") <= LONG) | (F.bit_count(x("u").bitwiseXOR(y("u"))) <= differ)
    return near & (F.bit_count(x("s").bitwiseXOR(y("s"))) <= differ) & half & earlier


def _similar(lines: DataFrame, threshold: float) -> DataFrame:
    """``line`` of the distinct lines that have a similar one before them.

    Lines are grouped by the words of their prefixes, each group in the order
    of the lines. A line first meets the FIRST_REACH earliest of each of its
    groups; what is not found similar then goes on to the next REACH times as
    many, and so on, until its groups are through. So a group of near copies,
    most of which are like its first ones, is not expanded to its pairs, and
    still nothing is left out. Groups of frequent words are left to these
    rounds, which pick the earliest before anything moves, and whose joins may
    split the lines that meet them over tasks.
    """
    entries = _entries(lines, cut(_frequencies(lines)), threshold)
    least = ((math.floor(math.log2(FREQUENT) * STEPS) + 1) << HASH_BITS) - (1 << HASH_BITS - 1)
    usual = entries.where(F.col("code") < least).repartition("code")
    by_word = Window.partitionBy("code")
    rank = F.row_number().over(by_word.orderBy("d", "l", "line"))

    def probe(earliest: DataFrame, others: DataFrame) -> DataFrame:
        met = earliest.alias("a").join(others.alias("b"), (F.col("a.code") == F.col("b.code")) & _close("a", "b", threshold))
        return met.select(F.col("a.line").alias("first"), F.col("b.line").alias("then")).distinct()

    pairs = probe(usual.withColumn("rank", rank).where(F.col("rank") <= FIRST_REACH), usual)
    large = usual.withColumn("size", F.count(F.lit(1)).over(by_word)).where(F.col("size") > FIRST_REACH).withColumn("met", F.lit(FIRST_REACH))
    large = large.drop("size").unionAll(entries.where(F.col("code") >= least).select(*usual.columns, F.lit(0).alias("met")))
    # one job, so that the entries are made and dealt once
    kept = [F.lit(None).cast(f.dataType).alias(f.name) for f in large.schema]
    made = written(pairs.select("first", "then", *kept).unionAll(large.select(F.lit(None).cast("long"), F.lit(None).cast("long"), "*")), "line-pairs", compression="zstd")
    found = _verified(made.where("met is null").select("first", "then"), lines, threshold)
    large = made.where("met is not null").drop("first", "then")
    last = large.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    low, reach = 0, FIRST_REACH
    while last > low:
        left = large.join(found, "line", "left_anti")
        chunk = large.withColumn("rank", rank).where(F.col("rank") <= reach).where((F.col("rank") > low) & (F.col("met") <= low))
        found = cut(found.unionAll(_verified(probe(chunk, left), lines, threshold)))
        low, reach = reach, reach * REACH
    return found


def _verified(pairs: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """``line`` of the later lines of pairs whose whole sets are similar. Sets that no pair names are left out before the rest move, by bits of their hashes."""
    pairs = cut(pairs)
    slot = F.pmod(F.col("line"), F.lit(BITS))
    named = pairs.select(F.explode(F.array("first", "then")).alias("line"))
    marks = cut(_dense(named.select(F.shiftright(slot, 5).alias("slot"), _bit(slot, 32).alias("v")), BITS // 32, F.bit_or("v")))
    word = F.element_at(F.col("_marks"), (F.shiftright(slot, 5) + 1).cast("int"))
    sets = lines.select("line", "words").withColumn("_marks", marks.scalar()).where(word.bitwiseAND(_bit(slot, 32)) != 0)
    sets = sets.groupBy("line").agg(F.first("words").alias("words"))
    x, y = sets.select(F.col("line").alias("first"), F.col("words").alias("x")), sets.select(F.col("line").alias("then"), F.col("words").alias("y"))
    both = pairs.join(x, "first").join(y, "then")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.where(common >= F.lit(t) * (F.size("x") + F.size("y") - common) - 1e-9).select(F.col("then").alias("line")).distinct())


def _removed(documents: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """``removed`` for each document with a line to remove, by id (d) and hash of the text (k)."""
    lines = written(_lines(documents, doc_id, text), "coded-lines", **PACKED)
    similar = _similar(lines, threshold)
    place = F.struct("d", "l", "k")
    own = lines.select("d", "k", "l", "line")
    first = own.groupBy("line").agg(F.min(place).alias("first"))
    stays = first.join(similar, "line", "left_anti").select("line", "first")
    gone = own.join(stays, "line", "left").where(F.col("first").isNull() | (F.col("first") != place))
    return gone.groupBy("d", "k").agg(F.array_sort(F.collect_set("l")).alias("removed"))


def duplicate_lines(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of the documents with its id, ``n_lines`` and ``removed``, the numbers of the lines to remove, counted from 0.

    A line is a set of lower-case words between blanks. It goes when a line
    before it, by id, line number and hash, has the same set or one of at least
    the threshold's Jaccard similarity, whether that line itself stays or not.
    Lines without words stay.

    Lines are cut into words once; what follows reads 32-bit hashes of words,
    so two different words of a pair of lines are taken for one with a chance
    of 2e-10. Copies of a line are one set. The words of a set are ordered by
    how rare they are in all documents; two sets can be similar only if their
    prefixes share a word, their sizes are near, what follows the shared word
    is long enough, and the 128-bit signatures differ in few enough bits. Pairs
    that pass are verified by their whole sets. The frequencies and the marks of
    candidate sets are arrays of fixed size.

    Null and empty texts have no line. Rows with a null id come first in the
    order. Rows alike in id and text are the same document and get the same
    result; rows that share only the id are documents of their own. An empty
    table gives an empty result; other columns are not returned.
    """
    removed = _removed(documents, doc_id, text, threshold)
    newlines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    counted = documents.select(F.col(doc_id), F.xxhash64(text).alias("_k"), F.when(F.length(text) > 0, newlines + 1).otherwise(0).cast("long").alias("n_lines"))
    out = counted.join(removed, counted[doc_id].eqNullSafe(removed["d"]) & (counted["_k"] == removed["k"]), "left").select(counted[doc_id], "n_lines", "removed")
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def remove_lines(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without the lines that ``duplicate_lines`` names; nothing else is changed, and every row stays."""
    gone = _removed(documents, doc_id, text, threshold).select(F.col("d").alias("_d"), F.col("k").alias("_k"), F.col("removed").alias("_removed"))
    joined = documents.join(gone, F.col(doc_id).eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_k")), "left")
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_removed", i))
    return joined.withColumn(text, F.when(F.size("_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col(text))).select(documents.columns)
