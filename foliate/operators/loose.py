"""Citations and reviews from JSON of several shapes, read as variants: what a value is decides what becomes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.lines import let
from foliate.operators.scores import AXES

LISTS = ("strengths", "weaknesses", "questions", "limitations")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID for a null of JSON, else the kind of number; null without a value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def part(value: Column, name: str) -> Column:
    """The part of an object under a name, null where there is none; the null of JSON is a value of its own."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def as_text(value: Column) -> Column:
    """A value as text: words for true, false and null, JSON for what is nested; null without a value."""

    def text(v: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        return let(kind(v), lambda of: F.when(of == "VOID", "None").when(of == "BOOLEAN", F.initcap(plain)).when(of.isin("OBJECT", "ARRAY"), F.to_json(v)).otherwise(plain))

    return let(value, text)


def truth(value: Column) -> Column:
    """False for nothing, null, false, zero, and what is empty."""

    def some(v: Column) -> Column:
        def by_kind(of: Column) -> Column:
            full = F.when(of == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(of == "STRING", F.try_variant_get(v, "$", "string") != "").when(of == "VOID", False).when(of.isin("OBJECT", "ARRAY"), ~F.to_json(v).isin("{}", "[]"))
            return full.otherwise(F.try_variant_get(v, "$", "double") != 0)

        return let(kind(v), by_kind)

    return F.coalesce(let(value, some), F.lit(False))


def first_true(*values: Column) -> Column:
    """The text of the first value that is not nothing, null, false, zero or empty; null without one."""
    return F.coalesce(*(let(v, lambda x: F.when(truth(x), as_text(x))) for v in values))


def _parts(rows: DataFrame, value: str, ids: list[str]) -> DataFrame:
    """(ids, pos, name, item) for the entries of objects and lists; entries of an object come in the order of their names."""
    exploded = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer()))
    return exploded.select(*ids, "pos", F.col("key").alias("name"), F.col("value").alias("item"))


def citations(inputs: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """(by, key, title, abstract, source) of citations in JSON texts, one row a key, the last of equal keys.

    A text is a list of entries, an entry alone, a map from keys to entries,
    or holds one of these under ``verified``, or that under ``structured``. An
    entry has its key as ``citation_key`` or ``key``, in a map else by its name,
    and its fields in itself or in its ``record``. What is no object has no
    fields; entries without a key, and texts that are no JSON, give nothing.
    """
    v = F.try_parse_json(raw)
    rows = inputs.select(*by, v.alias("_v"))
    inner = part(F.col("_v"), "structured.verified")
    rows = rows.withColumn("_v", F.when(inner.isNotNull() & (kind(part(F.col("_v"), "structured")) == "OBJECT"), inner).otherwise(F.coalesce(part(F.col("_v"), "verified"), F.col("_v"))))
    rows = rows.withColumn("_kind", kind(F.col("_v"))).where("_kind in ('OBJECT', 'ARRAY')")
    named = F.lit(False)
    for name in ("citation_key", "key"):
        named = named | part(F.col("_v"), name).isNotNull()
    alone = (F.col("_kind") == "OBJECT") & named
    many = _parts(rows.where(~alone), "_v", by)
    items = many.unionAll(rows.where(alone).select(*by, F.lit(0).alias("pos"), F.lit(None).cast("string").alias("name"), F.col("_v").alias("item")))
    item = F.col("item")
    items = items.where((kind(item) == "OBJECT") | F.col("name").isNotNull())
    record = F.when(kind(part(item, "record")) == "OBJECT", part(item, "record")).otherwise(item)
    own = part(item, "key")
    key = F.coalesce(first_true(part(item, "citation_key")), first_true(own), F.when(own.isNull(), F.col("name")))
    field = lambda name: F.coalesce(first_true(part(record, name), part(item, name)), F.lit(""))
    source = F.coalesce(first_true(part(item, "source")), first_true(part(record, "source")))
    found = items.select(*by, "pos", F.trim(key).alias("key"), F.struct(field("title").alias("title"), field("abstract").alias("abstract"), source.alias("source")).alias("x")).where("key != ''")
    return found.groupBy(*by, "key").agg(F.max_by("x", "pos").alias("x")).select(*by, "key", "x.*")


def reviews(inputs: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """(by, review fields) from JSON objects whose names may be spelled with capitals and blanks.

    Lists take a text or number alone as one item and leave out what is blank;
    scores are read from numbers and texts, rounded half to even and clamped,
    what is none becomes the lowest; a decision that has "accept" in it is
    Accept, all else Reject. What is missing, or no object, gets these too.
    """
    rows = inputs.select(*by, F.try_parse_json(raw).alias("_v"))
    slug = lambda name: F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
    names = ["summary", *LISTS, "ethical_concerns", "decision", *AXES]
    # in the row: the entries come in the order of their names, the last of a name counts
    entries = F.map_entries(F.when(kind(F.col("_v")) == "OBJECT", F.try_variant_get("_v", "$", "map<string,variant>")))
    rows = rows.select(*by, F.transform(entries, lambda e: F.struct(slug(e["key"]).alias("name"), e["value"].alias("item"))).alias("_e"))

    def last(n: str) -> Column:
        item = F.try_element_at(F.filter("_e", lambda e: e["name"] == n), F.lit(-1))["item"]
        items = lambda v: F.transform(F.try_variant_get(v, "$", "array<variant>"), as_text)
        return let(item, lambda v: F.when(v.isNotNull(), F.struct(kind(v).alias("kind"), as_text(v).alias("text"), truth(v).alias("truth"), items(v).alias("items")))).alias(n)

    found = rows.select(*by, *map(last, names))
    text = lambda n: F.col(f"{n}.text")
    none = F.array().cast("array<string>")

    def listed(n: str) -> Column:
        one = F.when(F.col(f"{n}.kind") == "STRING", F.trim(text(n))).otherwise(text(n))
        whole = F.when(F.col(f"{n}.kind") == "ARRAY", F.filter(f"{n}.items", lambda i: F.trim(i) != "")).when(F.col(f"{n}.kind") == "VOID", none)
        return F.coalesce(whole.otherwise(F.when(one != "", F.array(one)).otherwise(none)), none).alias(n)

    def score(n: str) -> Column:
        low, high = AXES[n]
        value = F.when(F.col(f"{n}.kind") == "BOOLEAN", F.col(f"{n}.truth").cast("double")).when(~F.col(f"{n}.kind").isin("ARRAY", "OBJECT", "VOID"), F.trim(text(n)).try_cast("double"))
        return F.coalesce(F.when(~F.isnan(value), F.least(F.greatest(F.bround(value), F.lit(low)), F.lit(high))), F.lit(low)).cast("int").alias(n)

    concerns = F.when(F.col("ethical_concerns.kind") == "STRING", F.lower(F.trim(text("ethical_concerns"))).isin("true", "yes", "1")).otherwise(F.col("ethical_concerns.truth"))
    accepts = (F.col("decision.kind") == "STRING") & F.lower(text("decision")).contains("accept")
    summary = F.coalesce(F.when(F.col("summary.truth"), text("summary")), F.lit("")).alias("summary")
    return found.select(*by, summary, *map(listed, LISTS), F.coalesce(concerns, F.lit(False)).alias("ethical_concerns"), *map(score, AXES), F.when(F.coalesce(accepts, F.lit(False)), "Accept").otherwise("Reject").alias("decision"))
