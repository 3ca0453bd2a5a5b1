"""The pipeline on small tables, stage by stage and whole, against brute force; and the fixed columns of the queries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliate.llm import queries
from foliate.llm.common import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, node string, lang_pred string, shard string, taken string, items string"


def prose(draw, lang, n):
    letters = "abcdefgh" if lang == "aa" else "qrstuvwx"
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A table with copies, near copies, benchmark passages, null columns, repeated ids and names that clash with those of the stages."""
    draw = random.Random(13)
    texts = [(prose(draw, lang, 30 + draw.randrange(60)), lang) for i in range(120) for lang in ("aa", "bb")]
    item = prose(draw, "aa", 14)
    rows = [(i, t, lang, f"s{i % 3}" if i % 11 else None) for i, (t, lang) in enumerate(texts)]
    near = texts[5][0].split()
    rows += [(1000 + i, texts[i][0], texts[i][1], "s1") for i in range(0, 20, 2)]  # copies
    rows += [(1100 + i, " ".join([*near[:-1], f"abc{'d' * i}"]), "bb", "s2") for i in range(8)]  # near copies
    rows += [(1200 + i, f"{prose(draw, 'aa', 20)} {item.upper()} {prose(draw, 'aa', 20)}", "aa", "s0") for i in range(3)]
    rows += [(1300, None, "aa", "s0"), (1301, "", "aa", "s0"), (1302, " 12 ", None, None), (None, prose(draw, "aa", 40), None, "s0"), (None, None, None, None), (7, rows[7][1], "bb", "s1"), (7, rows[7][1], "bb", "s1")]
    rows += [(1400, prose(draw, "bb", 20_000), "bb", "s2")]
    frame = spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "x", "x", "x", "x", "x", "x") for i, t, lang, s in rows], COLUMNS)
    path = str(tmp_path_factory.mktemp("small"))
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "of no use")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, small):
    path, rows = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, path)
    assert known.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in known.collect()]
    lettered = Counter((i, t) for i, t, *_ in rows if t and re.search("[a-z]", t))
    assert not Counter(kept) - lettered and len(kept) > 0.97 * sum(lettered.values())

    single = stages["near_duplicates"](spark, known, path)
    assert single.columns == docs.columns
    one = [(r.doc_id, r.text) for r in single.collect()]
    assert not Counter(one) - Counter(kept)
    sets = [shingles(t) for _, t in one]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    assert not any(like(sets[i], sets[j]) for i in range(len(sets)) for j in range(i))
    assert all(any(like(shingles(t), s) for s in sets) for _, t in kept)

    clean = stages["decontamination"](spark, single, path)
    assert clean.columns == docs.columns
    item = " ".join(w.decode() for w in words(spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 1").first().text)).split()
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    held = lambda t: any(tuple(w) in windows for w in zip(*(t.lower().split()[k:] for k in range(10)), strict=False))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in one if not held(r[1]))
    assert any(held(t) for _, t in one)

    mixed = stages["mixing"](spark, clean, path)
    assert mixed.columns == docs.columns
    size, taken = Counter(), Counter()
    for r in clean.collect():
        size[r.source] += len(r.text.split())
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values()) and all(taken[s] <= 2 * size[s] for s in size)

    dealt = stages["sharding"](spark, mixed, path)
    places = Counter((r.shard, r.slot) for r in dealt.select("shard", "slot").collect())
    assert set(places.values()) == {1} and len(places) == mixed.count()
    counts = Counter(s for s, _ in places)
    assert max(counts.values()) - min(counts.values()) <= 1 and all((s, c - 1) in places for s, c in counts.items())


def test_run_and_empty_tables(spark, small, tmp_path):
    path, rows = small
    out = corpus_pipeline.run(spark, path)
    assert not {(r.doc_id, r.text) for r in out.collect()} - {(i, t) for i, t, *_ in rows}
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_the_queries(spark, small, tmp_path):
    path, rows = small
    spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    path = str(tmp_path)
    kinds = ["email", "ip", "card", "phone"]
    key = lambda r: (r[0] is None, r[0] or 0)
    shards = queries.op3_shards(spark, path).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in shards), key=lambda r: (key(r), r[1:])) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=lambda r: (key(r), r[1:]))
    assert {r.law for r in shards} == {"rows"} and {r.shard for r in shards} <= set(range(16))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in queries.op6_mix(spark, path).collect():
        assert r.taken <= 2 * r["size"] and r.source_size in sizes.values()
    prints = queries.op9_fingerprint(spark, path).collect()
    assert Counter(r.n_chars for r in prints) == Counter(len(t or "") for _, t, *_ in rows)
    found = queries.op5_personal(spark, path).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(found) == len(rows)
    assert all([getattr(r, f"n_{k}") for k in kinds] == [0] * 4 and r.base_sha256 == nothing for r in found)
    langs = queries.op7_language(spark, path).collect()
    assert all((r.lang_pred == "und") == (not re.search("[a-z]", t or "")) for r, t in ((r, t) for r in langs if r.doc_id and r.doc_id > 1000 for i, t, *_ in rows if i == r.doc_id))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in langs)


def test_personal_query_against_brute_force(spark, tmp_path):
    texts = ["write to a.b@c.de, or x@y", "10.0.0.1 and 300.1.1.1; card 4242 4242 4242 4242", "+49 (30) 123-45678 and +1 2", None, "", "ä 1.2.3.4 a@b.c +49 (30) 123-45678"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: ["email:9:17"], 1: ["ip:0:8", "card:29:48"], 2: ["phone:0:18"], 3: [], 4: [], 5: ["ip:2:9", "email:10:15", "phone:16:34"]}
    found = queries.op5_personal(spark, str(tmp_path)).collect()
    assert len(found) == 12
    for r in found:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(r.spans.split(","))


def test_shards_of_one_repeated_row(spark):
    """Rows that repeat in full are dealt over all buckets, and reruns agree."""
    from foliate.llm import sharding

    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same").alias("text"), (F.col("id") * 0).alias("size"))
    frame = rows.unionAll(spark.range(30).selectExpr("id as doc_id", "cast(id as string) as text", "id as size")).repartition(4)
    out = sharding.shard(frame, 4, bucket_bytes=900)
    assert sorted(r[0] for r in out.groupBy("shard").count().select("count").collect()) == [757, 757, 758, 758]
    where = {(r.doc_id, r.text, r.shard, r.slot) for r in out.collect()}
    assert len(where) == 3030 and where == {(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard(frame.repartition(7), 4, bucket_bytes=900).collect()}
    numbered = sharding._numbered(frame, F.xxhash64("doc_id", "text"))
    assert numbered.where("text = 'the same'").agg(F.count_distinct("_copy")).first()[0] == 3000
