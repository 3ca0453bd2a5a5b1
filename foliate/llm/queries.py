"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import collisions, contamination, fingerprint, language, lines, merkle, mixing, personal, sharding, similarity, toxicity, warc, whitening
from foliate.llm.common import LOWER, UPPER, bucket_of_id, shared_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), archive)

    def page(urn: str):
        return F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1).try_cast("long")

    records = warc.read_warc(spark, archive)
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(bucket_of_id("doc_id", 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.train(toxicity.sample(documents, labels))
    scored = toxicity.score(documents.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.find(documents, personal.train(documents))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    hashed, added = F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *map(count, personal.KINDS), hashed, joined("spans").alias("spans"), added)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket_of_id("doc_id", 4) == 2, F.lit(False))
    model = language.train(documents.where(~held_out))
    return language.identify(documents.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    numbers = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), numbers.alias("removed"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprint.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prints.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(bucket_of_id("doc_id", 5) == 0, F.translate("text", UPPER, LOWER))
    return merkle.manifest(table(spark, sf_dir, "documents").select(*merkle.FIELDS), tampered)


def op12_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), keep=["vec_id"])


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _merkle_sql(levels: int = 8) -> str:
    """The manifest by unrolled levels, as many as 16^levels leaves of a source or sources need."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    crc = "list_reduce(flatten(list_prepend([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1)))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d AS (SELECT row_number() OVER () AS row, *, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(lower)} END AS bad FROM documents)",
        "a0 AS (SELECT row, coalesce('1' || source, '0') AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d)",
    ]

    def tree(t: str, keys: str) -> None:
        run = f"PARTITION BY {keys} i // 16 ORDER BY i ROWS BETWEEN"
        for k in range(levels):
            n = f"count(*) OVER ({'PARTITION BY s' if keys else ''})"
            parts.append(f"{t}r{k} AS (SELECT *, {n} AS n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS e FROM {t}{k})")
            parts.append(f"{t}{k + 1} AS (SELECT {keys} i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {t}r{k} GROUP BY {keys} i // 16)")

    tree("a", "s,")
    parts.append(f"b0 AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, h FROM a{levels})")
    tree("b", "")
    parts.append(f"u0 AS (SELECT d.row, d.doc_id, d.leaf, a0.s, a0.i AS i, b0.i AS j, b0.h AS subroot, coalesce(bad, leaf) AS x, '' AS p FROM d JOIN a0 USING (row) JOIN b0 USING (s))")
    step = 0
    for t, at, keys in (("a", "i", "AND r.s = u.s"), ("b", "j", "")):
        for k in range(levels):
            parts.append(f"u{step + 1} AS (SELECT u.* REPLACE (CASE WHEN r.n > 1 THEN sha256(r.b || u.x || r.e) ELSE u.x END AS x, CASE WHEN r.n > 1 THEN u.p || r.b || r.e ELSE u.p END AS p) FROM u{step} u JOIN {t}r{k} r ON r.i = u.{at} // {16**k} {keys})")
            step += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT h FROM b{levels}) AS root, sha256(p) AS proof_sha256, x AS folded_root, x = (SELECT h FROM b{levels}) AS verified FROM u{step}"


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_shards": op3_shards,
    "op4_toxicity": op4_toxicity,
    "op5_personal": op5_personal,
    "op6_mix": op6_mix,
    "op7_language": op7_language,
    "op8_lines": op8_lines,
    "op9_fingerprint": op9_fingerprint,
    "op10_jaccard": op10_jaccard,
    "op11_merkle": op11_merkle,
    "op12_collisions": op12_collisions,
    "op13_whiten": op13_whiten,
}

ORACLES = {
    "op12_collisions": """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT row, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT row, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row, count(*) AS n, list_sort(list(g)) AS s FROM g GROUP BY row),
t AS (SELECT min(row) AS node, s, any_value(n) AS n FROM n GROUP BY s),
m AS (SELECT n.row, t.node, n.n FROM n JOIN t USING (s)),
h AS (SELECT node, unnest(s) AS g FROM t),
o AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.node != b.node GROUP BY a.node, b.node),
e AS (SELECT a, b FROM o JOIN t x ON x.node = a JOIN t y ON y.node = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT node, node AS seen FROM t UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT r.node, min(d.doc_id) AS id FROM r JOIN m ON m.node = r.seen JOIN d ON d.row = m.row GROUP BY r.node)
SELECT d.doc_id, coalesce(m.n, 0) AS n_shingles, CASE WHEN m.node IS NULL THEN d.doc_id ELSE c.id END AS component_id,
  d.doc_id IS NOT DISTINCT FROM CASE WHEN m.node IS NULL THEN d.doc_id ELSE c.id END AS kept
FROM d LEFT JOIN m ON m.row = d.row LEFT JOIN c ON c.node = m.node
""",
    "op11_merkle": _merkle_sql(),
    "op8_lines": """
WITH d AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no FROM d),
w AS (SELECT doc_id, no, list_sort(list_distinct(list_filter(string_split(lower(line), ' '), lambda x: x != ''))) AS t FROM l),
s AS (SELECT t, min({'d': doc_id, 'l': no}) AS first FROM w WHERE len(t) > 0 GROUP BY t),
j AS (SELECT DISTINCT b.t FROM s a JOIN s b ON a.first < b.first AND len(a.t) >= 0.8 * len(b.t) AND len(b.t) >= 0.8 * len(a.t)
  WHERE len(list_intersect(a.t, b.t)) >= 0.8 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))),
g AS (SELECT w.doc_id, w.no FROM w JOIN s ON w.t = s.t LEFT JOIN j ON j.t = w.t
  WHERE j.t IS NOT NULL OR s.first != {'d': w.doc_id, 'l': w.no})
SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, count(g.no) AS n_removed,
  coalesce(string_agg(CAST(g.no AS VARCHAR), ',' ORDER BY g.no), '') AS removed
FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.ls
""",
    "op10_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
t AS (SELECT w, min(doc_id) AS rep, count(*) AS n_copies FROM d WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT rep, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT rep, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rep != b.rep GROUP BY a.rep, b.rep),
e AS (SELECT a, b FROM o JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c)),
r AS (SELECT rep AS node, rep AS seen FROM t UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node AS rep, min(seen) AS class_id FROM r GROUP BY node),
l AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links, coalesce(t.n_copies, 1) AS n_copies
FROM d LEFT JOIN t ON d.w = t.w AND len(d.w) > 0 LEFT JOIN c ON c.rep = t.rep LEFT JOIN l ON l.rep = t.rep
""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, t, strlen(t) AS n, min(page_id) OVER (PARTITION BY t) AS first,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS digest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d
""",
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
sizes AS (SELECT DISTINCT least(10, len(w)) AS k FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, grams.k, i, item FROM grams JOIN windows ON grams.k = windows.k AND grams.g = windows.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
