"""Each corpus operator against a brute-force version on small tables, with nulls, empty and repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliate.llm import components, contamination, fingerprint, language, lines, mixing, personal, sharding, similarity, toxicity, warc
from foliate.llm.common import words

DOCS = "doc_id long, text string, size string, score string, items string, class_id string"


def text(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", "x", "x", "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n\n", "one", "ä", "one", text(1, 3000)]


# WARC


def test_warc_round_trip(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
    pages = [(5, "http://a\r\nb", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (4, "u", fake), (6, "u", "x" * 50_000), (7, "u", "é\r\n\r\n" + fake), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_warc(df.repartition(2), f"{tmp_path}/w", archive_records=3)
    out = warc.read_warc(spark, f"{tmp_path}/w", payload=True).collect()
    assert len(out) == len(pages)
    by_payload = {}
    for i, _, h in pages:
        by_payload.setdefault(h or "", []).append(i)
    for r in out:
        ident = None if r.record_id == "<urn:page:null>" else int(r.record_id[10:-1])
        html = next(h or "" for i, _, h in pages if i == ident)
        data = html.encode()
        first = min(i for i in by_payload[html] if i is not None)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.record_type == ("response" if ident == first else "revisit")
        assert r.refers_to == (None if ident == first else f"<urn:page:{first}>")
        assert r.payload == (html if ident == first else None)


def test_warc_min_bytes_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    warc.write_warc(df, f"{tmp_path}/w", min_bytes=3)
    assert {r.record_type for r in warc.read_warc(spark, f"{tmp_path}/w").collect()} == {"response"}
    warc.write_warc(df.limit(0), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").count() == 0


def test_archives_keep_to_their_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * (i * i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, f"{tmp_path}/w", archive_records=100, archive_bytes=5000)
    out = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert sorted(r.payload_bytes for r in out) == [i * i for i in range(60)]
    found = warc.candidates(spark, f"{tmp_path}/w").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("b")).collect()
    assert all(r.b <= 5000 for r in found) and len(found) > 15


def test_reachable_needs_the_chain(spark):
    links = [("f", 0, 10), ("f", 4, 12), ("f", 10, 30), ("f", 12, 20), ("f", 30, 40), ("g", 5, 9)]
    found = warc.reachable(spark.createDataFrame(links, "file string, offset long, next long"))
    assert sorted(map(tuple, found.collect())) == [("f", 0), ("f", 10), ("f", 30)]


# decontamination


def brute_hits(doc, items, window=10):
    w, hit, found = words(doc), set(), set()
    for name, item in items:
        v = words(item)
        k = min(window, len(v))
        if name is None or not k:
            continue
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_decontaminate(spark, limit):
    items = [(i, text(i, n, 30)) for i, n in enumerate([40, 25, 10, 9, 3, 1, 0])] + [(3, text(99, 30, 30)), (None, text(7, 20)), (8, None)]
    pieces = [items[i % 8][1] or "" for i in range(20)]
    texts = ODD + [f"{text(100 + i, 30, 30)} {pieces[i].upper()}, {text(200 + i, 20, 30)}" for i in range(20)] + [pieces[0][:60]] * 3
    out = contamination.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), table_bytes=limit)
    assert out.columns.count("items") == 1
    for r in out.collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], items)
        assert r.n_items == len(r["items"])


def test_decontamination_tables_keep_to_their_bound():
    """The bytes of arrays and vocabulary, against what a block of that many words is counted for."""
    draw = random.Random(3)
    seen = [bytes(draw.randrange(97, 123) for _ in range(5)) for _ in range(40_000)]
    made = contamination.build([("a", seen[:20_000]), ("b", seen[20_000:])])
    arrays = sum(x.nbytes for one in made.searches for x in vars(one).values() if isinstance(x, np.ndarray)) + sum(len(one.shift) for one in made.searches)
    names = sys.getsizeof(made.vocabulary) + sum(sys.getsizeof(w) + 32 for w in made.vocabulary)
    assert arrays + names < contamination.WORD_COST * len(seen)
    assert [(at, n, [made.names[i] for i in who]) for at, n, who in made.search([b"x", *seen[500:511], b"y", *seen[20_000:20_010]])] == [(1, 10, ["a"]), (2, 10, ["a"]), (13, 10, ["b"])]


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = contamination.decontaminate(docs(spark, ["a b", None]), none).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in out] == [(2, 0, 0), (0, 0, 0)]
    assert contamination.decontaminate(docs(spark, ["a"]).limit(0), none).count() == 0


# sharding


def test_shards(spark):
    texts = ODD + [text(i, 20 + i % 30) for i in range(500)] + ["copy"] * 300
    out = sharding.shard(docs(spark, texts).repartition(3), 16, bucket_bytes=4000)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    counts = {}
    for r in rows:
        counts.setdefault(r.shard, []).append(r.slot)
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert set(counts) == set(range(16))
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs(spark, texts).repartition(7), 16, bucket_bytes=4000).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.2


def test_shards_edges(spark):
    assert sharding.shard(docs(spark, ["a"]).limit(0)).count() == 0
    rows = sharding.shard(spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "doc_id long, text string"), 3).collect()
    assert len(rows) == 4 and sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (1, 0), (2, 0)]


# toxicity


def test_segments_are_the_maximal_ones():
    draw = random.Random(4)
    for _ in range(200):
        scores = [draw.choice([-3.1, -1.7, -0.9, 0.45, 1.3, 2.2]) + draw.random() / 1000 for _ in range(draw.randrange(14))]

        def best(lo, hi):
            cuts = [(sum(scores[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
            top = max(cuts, default=(0, 0, 0))
            return [] if top[0] <= 0 else best(lo, top[1]) + [(top[1], top[2])] + best(top[2], hi)

        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == best(0, len(scores))


def test_toxicity_learns(spark):
    bad = ["scumbag", "moronic", "idiotics"]
    draw = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        w = text(i, 80).split()
        y = i % 3 == 0
        if y:
            for _ in range(3):
                w.insert(draw.randrange(len(w)), draw.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(y)))
    labels += [(5, None), (None, 1), (0, 0)]
    frame, marks = docs(spark, texts + ODD), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(toxicity.sample(frame.where("doc_id % 4 != 1"), marks))
    rows = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert len(rows) == len(texts) + len(ODD)
    held = [i for i in range(600) if i % 4 == 1]
    assert np.mean([(rows[i].score >= 0.7) == (i % 3 == 0) for i in held]) > 0.97
    assert all(rows[i].passages for i in held if i % 3 == 0)
    assert all(0 <= r.score < 0.7 for i, r in rows.items() if i >= 600)
    assert toxicity.train(toxicity.sample(frame, marks.limit(0))) is None
    assert {r.score for r in toxicity.score(frame, None).collect()} == {0.0}


def test_toxic_passages_count_alike_wherever_they_stand():
    score = {b"scumbag": 4.0, b"moronic": 3.0, b"idiotics": 3.5}
    cache = {w: score.get(w, -0.5) for w in [*score, *words(text(1, 4000))]}
    model = toxicity.Model(None, None, None)
    clean, bad = words(text(1, 4000)), [b"scumbag", b"moronic", b"idiotics"]
    want = sum(score.values())
    often = [w for i in range(10) for w in [*clean[i * 90 : i * 90 + 90], *bad]]
    assert model.passages(often, cache) == [(93 * i + 90, 93 * i + 93, want) for i in range(10)]
    late = [*bad, *clean, *bad]
    assert model.passages(late, cache) == [(0, 3, want), (4003, 4006, want)]
    assert sum(x for *_, x in model.passages(bad[:1] * 20, cache)) < 20  # the same word over and over is no passage of twenty


# personal data


def test_base_spans():
    t = "Mail a.b@c-d.example.org, +1 (624) 555-2408; 10.0.0.256 and 10.0.0.25, 4242 4242 4242 4242 or 4242 4242 4242 4241"
    assert [(personal.KINDS[k], t[a:b]) for a, k, b in personal.base_spans(t)] == [("email", "a.b@c-d.example.org"), ("phone", "+1 (624) 555-2408"), ("ip", "10.0.0.25"), ("card", "4242 4242 4242 4242")]


def test_personal_gradients():
    x, tags = personal.examples(["the end of it all "] * 3, 4, 1)
    tagger = personal.Tagger(2)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    grads = tagger.gradients(x, tags)[1]
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = tagger.w[name][at]
        both = []
        for d in (1e-4, -1e-4):
            tagger.w[name][at] = keep + d
            both.append(tagger.gradients(x, tags)[0])
        tagger.w[name][at] = keep
        assert abs((both[0] - both[1]) / 2e-4 - g[at]) < 1e-2 * abs(g[at]) + 1e-3


def test_personal_added_spans(spark):
    prose = "and so it was that they came to the river and went on to the town where all of them had been before "
    texts = [t for t in ODD[:7]] + [prose[i:] * 4 for i in range(60)] + ["Please call 624-555-2408 now", "server 10.0.0.7 and version 2.0.1.", "password=7602ad27cf5550de1c"]
    frame = docs(spark, texts)
    rows = {r.doc_id: r for r in personal.find(frame, personal.train(frame)).collect()}
    spans = {texts[i][s.start : s.end]: s.kind for i, r in rows.items() for s in r.spans}
    assert spans.get("624-555-2408") == "phone" and spans.get("10.0.0.7") == "ip"
    assert spans.get("7602ad27cf5550de1c") == "secret" and not any(rows[i].spans for i in range(7))
    for r in rows.values():
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


class KnowsAddresses(personal.Tagger):
    """Emissions of a tagger that is sure of every character: "~" is outside, a capital begins an address."""

    def emissions(self, x, keep=True):
        y = np.zeros((*x.shape, personal.TAGS), np.float32)
        tag = np.where((x == ord("~")), 0, np.where((x >= 65) & (x <= 90), 1, 2))
        np.put_along_axis(y, tag[:, :, None], 12, 2)
        return y, ()


@pytest.mark.parametrize("size", [20, 48, 60, 95, 96, 97, 120, 300])
def test_personal_spans_at_every_offset(size):
    tagger = KnowsAddresses()
    tagger.w |= {k: np.zeros_like(tagger.w[k]) for k in "ts"}
    user, host = "A" + "b" * (size // 2 - 5), "(dot)edu"
    item = user + "(at)" + "c" * (size - len(user) - 4 - len(host)) + host
    assert len(item) == size
    texts = ["~" * i + item + "~" * 150 for i in [0, *range(96, 96 + personal.STRIDE)]] + ["~" * 100 + item]
    _, spans = personal.spans_of(texts, tagger)
    assert [[t[a:b] for a, _, b in row] for t, row in zip(texts, spans, strict=True)] == [[item]] * len(texts)


def spelled_base(t):
    """The base patterns as they are worded, by the plain expressions."""
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, pattern in enumerate(plain):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1:
                fits = all(int(p) <= 255 for p in m[0].split("."))
            else:
                fits = k == 0 or (14 <= len(digits) <= 19 and personal.luhn(digits) if k == 2 else 10 <= len(digits) <= 15)
            out += [(m.start(), k, m.end())] if fits else []
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns():
    draw = random.Random(11)
    for _ in range(4000):
        t = "".join(draw.choice(["a", "@", ".", "1", "25", "+1", " ", "-", "(", ")", "b.c", "4242", "255", "_", "é", "@x.y"]) for _ in range(draw.randrange(40)))
        assert personal.base_spans(t) == spelled_base(t), t


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "1.1.1x" * 150_000, "+" * 1_000_000, "x" * 500_000 + "@b.c", "1.2.3.4 " * 20_000):
        personal.base_spans(t)
    found = [(i, i + 6, i % 5, -0.1) for i in range(0, 80_000, 3)]
    assert personal.reconcile(found, [(i, 0, i + 2) for i in range(0, 80_000, 40)])
    toxicity.segments([1.0, -2.0] * 200_000)
    assert time.time() - began < 30


def test_reconcile_is_the_best_choice():
    found = [(0, 10, 0, -0.1), (0, 10, 0, -0.3), (8, 20, 1, -0.05), (20, 25, 2, -0.01), (30, 31, 3, -1.9)]
    assert personal.reconcile(found, []) == [(8, 1, 20), (20, 2, 25)]
    assert personal.reconcile(found, [(15, 3, 16)]) == [(0, 0, 10), (20, 2, 25)]


def test_windows_hold_all_places():
    t = ("a" * 47 + "7") * 12
    assert all(sum(s <= p < s + personal.WINDOW for s in personal.window_starts(t)) >= 1 for p in range(len(t)) if t[p] == "7")


# mixing


def test_targets_are_shared_again():
    got = mixing.targets({"b": 100, "a": 10, None: 50, "c": 1000})
    assert got["a"] == 20  # 5 of 10 shares would be more than twice its size
    assert abs(sum(got.values()) - 1.5 * 1160) < 1e-6
    assert all(got[s] <= 2 * n + 1e-9 for s, n in {"b": 100, "a": 10, None: 50, "c": 1000}.items())


def brute_cost(patterns, wanted, repeats=2):
    """Least cost of the greatest flow, word by word over all ways."""
    import itertools

    names = list(patterns)
    ways = [[c for c in itertools.product(range(repeats * patterns[p] + 1), repeat=len(p)) if sum(c) <= repeats * patterns[p]] for p in names]
    best = (-1, 0)
    for choice in itertools.product(*ways):
        got = {}
        for p, c in zip(names, choice, strict=True):
            for s, x in zip(p, c, strict=True):
                got[s] = got.get(s, 0) + x
        if any(x > wanted[s] for s, x in got.items()):
            continue
        total = sum(got.values())
        cost = sum(max(0, sum(c) - patterns[p]) for p, c in zip(names, choice, strict=True))
        best = max(best, (total, -cost))
    return best


def test_flow_is_cheapest():
    draw = random.Random(3)
    for _ in range(25):
        patterns = {("a",): draw.randrange(1, 4), ("a", "b"): draw.randrange(1, 4), ("b",): draw.randrange(1, 3)}
        wanted = {"a": draw.randrange(8), "b": draw.randrange(8)}
        flow = mixing.min_cost_flow(patterns, wanted)
        total = sum(sum(f.values()) for f in flow.values())
        cost = sum(max(0, sum(f.values()) - patterns[p]) for p, f in flow.items())
        assert (total, -cost) == brute_cost(patterns, wanted)


def test_mix(spark):
    rows = [(i, text(i, 1 + i % 60), f"s{i % 4 if i % 3 else 0}" if i % 11 else None) for i in range(900)] + [(None, None, "s1"), (None, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame, bin_rows=50).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted, taken = mixing.targets(sizes), {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) < 1e-6
        assert r.taken in {0, r.size, 2 * r.size}
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - wanted[s]) <= 10 for s in wanted)
    again = mixing.mix(frame.repartition(5), bin_rows=50).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in out)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mix_overlapping_sources(spark):
    rows = [(i, text(i, 10), ["a", "b"] if i % 2 else ["a"]) for i in range(100)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), bin_rows=20).collect()
    assert len(out) == 100 and all(r.taken <= 2 * r.size for r in out)


# language


def test_language_gradients():
    net = language.ByteNetwork(["a", "b", "c"], 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    draw = np.random.default_rng(0)
    x, y = draw.integers(1, 256, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])

    def loss():
        hidden, _ = net.pooled(x)
        z = hidden @ net.w["o"] + net.w["c"]
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(5), y]).mean())

    for name, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, both = net.w[name][at], []
        for d in (1e-5, -1e-5):
            net.w[name][at] = keep + d
            both.append(loss())
        net.w[name][at] = keep
        assert abs((both[0] - both[1]) / 2e-5 - g[at]) < 1e-3 * abs(g[at]) + 1e-6


def test_language(spark):
    alphabets = {"xx": "aeioul", "yy": "bcdfgh", "zz": "äöüßst"}
    draw = random.Random(1)
    rows = [(i, " ".join("".join(draw.choice(alphabets[lang]) for _ in range(draw.randrange(2, 8))) for _ in range(draw.randrange(5, 200))), lang) for i, lang in enumerate(list(alphabets) * 100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame.where("doc_id % 4 != 2"))
    found = {r.doc_id: r for r in language.identify(frame, model).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2]) > 0.97
    odd = {r.doc_id: r for r in language.identify(docs(spark, [*ODD, "123 !?"]), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 3, 8)] == ["und"] * 5 and odd[4].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert language.train(frame.withColumn("lang", frame.lang.substr(9, 1)).where("lang = 'q'")) is None
    assert {r.lang_pred for r in language.identify(frame.limit(3), None).collect()} == {"und"}


# lines


def brute_lines(rows, t=0.8):
    seen, out = [], {}
    for ident, doc in sorted(rows, key=lambda r: r[0]):
        parts = doc.split("\n") if doc else []
        out[ident] = (len(parts), [])
        for i, line in enumerate(parts):
            s = {w for w in line.lower().split(" ") if w}
            if not s:
                continue
            if any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                out[ident][1].append(i)
            seen.append(s)
    return out


def test_duplicate_lines(spark):
    draw = random.Random(6)
    base = [text(i, 4 + i % 25, 60) for i in range(40)]

    def near(line):
        w = line.split()
        for _ in range(draw.randrange(4)):
            w[draw.randrange(len(w))] = f"n{draw.randrange(50)}"
        return " ".join(w)

    texts = ODD + ["\n".join(near(draw.choice(base)) if draw.random() < 0.8 else text(draw.random(), 12, 60) for _ in range(draw.randrange(1, 9))) for _ in range(150)]
    frame = docs(spark, texts)
    found = lines.duplicate_lines(frame)
    want = brute_lines(list(enumerate(texts)))
    assert {r.doc_id: (r.n_lines, r.removed) for r in found.collect()} == want
    assert sum(len(r) for _, r in want.values()) > 50
    clean = {r.doc_id: r.text for r in lines.remove_lines(frame).collect()}
    for i, t in enumerate(texts):
        gone = set(want[i][1])
        assert clean[i] == (t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    assert lines.duplicate_lines(frame.limit(0)).count() == 0 == lines.remove_lines(frame.limit(0)).count()


def test_duplicate_lines_of_one_group(spark):
    """2,000 near copies of a line, most of which are like the first ones, and some that are like later ones only."""
    draw = random.Random(16)
    base = text(5, 40, 300).split()

    def near(line, changes):
        w = list(line)
        for _ in range(changes):
            w[draw.randrange(len(w))] = f"n{draw.randrange(10_000)}"
        return w

    drifted = near(base, 12)
    texts = [" ".join(near(base if i % 9 else drifted, draw.randrange(5))) for i in range(2000)]
    found = lines.duplicate_lines(docs(spark, texts).repartition(5))
    assert {r.doc_id: (r.n_lines, r.removed) for r in found.collect()} == brute_lines(list(enumerate(texts)))


def test_lines_are_coded_once(spark):
    """Blank lines are left out without hashing the words of every line a second time."""
    texts = ["a b a", "  \n\n x  y \n\t\n", " ", "", None, "\u00a0", "A B"]
    coded = lines._lines(docs(spark, texts), "doc_id", "text")
    assert coded._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1
    assert sorted((r.d, r.l, len(r.words)) for r in coded.collect()) == [(0, 0, 2), (1, 2, 2), (1, 3, 1), (5, 0, 1), (6, 0, 2)]


def test_duplicate_lines_without_ids(spark):
    """Rows without an id come first; rows alike in id and text are one document, others that share an id are not."""
    rows = [(None, "a b c\nd e f", 1), (None, "a b c\nd e f", 2), (3, "d e f\nx", 3), (3, "y y\nx", 4), (3, None, 5), (1, "a b c", 6), (4, "x\nq", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, removed long")
    found = sorted((r.doc_id is None, r.doc_id, r.n_lines, r.removed) for r in lines.duplicate_lines(frame).collect())
    assert [r for r in found if r[0]] == [(True, None, 2, [])] * 2
    assert [r[1:] for r in found if not r[0]][0] == (1, 1, [0])
    third = [r[2:] for r in found if r[1] == 3]
    assert len(third) == 3 and (0, []) in third and sorted(third) in ([(0, []), (2, []), (2, [0, 1])], [(0, []), (2, [0]), (2, [1])])
    assert (4, 2, [0]) in [r[1:] for r in found if not r[0]]
    assert sorted(r.removed for r in lines.remove_lines(frame).collect()) == [1, 2, 3, 4, 5, 6, 7]


# fingerprints


def test_prefix_hashes():
    draw = random.Random(8)
    one, two = "".join(draw.choice("ab") for _ in range(300)), "".join(draw.choice("ab") for _ in range(300))
    a, b = (fingerprint.PrefixHash(fingerprint.code_points(t)) for t in (one, two))
    for _ in range(500):
        i, j, n = draw.randrange(290), draw.randrange(290), draw.randrange(1, 10)
        assert a.equal(i, b, j, n) == (one[i : i + n] == two[j : j + n])
        k = 0
        while i + k < 300 and j + k < 300 and one[i + k] == two[j + k]:
            k += 1
        assert a.common_extension(i, b, j) == k


@pytest.mark.parametrize("size", [500, 1 << 20])
def test_fingerprints(spark, size):
    texts = [*ODD, *(text(i, 30 + i) for i in range(60)), "𝔘nicode " * 20, "same " * 40, "same " * 40]
    rows = {r.doc_id: r for r in fingerprint.fingerprint(docs(spark, texts).repartition(3), range_bytes=size).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.near_edited == 1.0) == (changed == t) and 0 <= r.near_next <= 1
        if len(t) > 200:
            assert 0.4 <= r.near_edited <= 1 and (r.near_next < 0.2 or following[:50] == t[:50])
    assert rows[len(texts) - 1].fingerprint == rows[len(texts) - 2].fingerprint
    assert fingerprint.fingerprint(docs(spark, texts).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    assert fingerprint.fingerprint(twice).count() == 4


def test_fingerprints_of_ids_that_repeat(spark):
    """A third of the rows without an id, a third with one id: the next document is still the next, in many ranges."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(i, 20 + i % 50), "x") for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").repartition(5)
    tie = {r["text"]: r["t"] for r in frame.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = []
    for (ident, t, _), (_, following, _) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((ident is None, ident or 0, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    for size in (300, 5000, 1 << 20):
        got = [(r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in fingerprint.fingerprint(frame, range_bytes=size).collect()]
        assert sorted(got) == sorted(want)


def test_near_next_finds_shifted_spans(spark):
    t = text(21, 400)
    w = t.split()
    changed = ["new words here " + t, t[9:], " ".join(w[:30] + ["inserted"] + w[30:]), " ".join(w[:5] + w[6:]), " ".join(w[:200] + w[210:] + w[200:210]), t[: len(t) // 4] + "x" + t[len(t) // 4 : -7]]
    for other in changed:
        rows = fingerprint.fingerprint(docs(spark, [other, t])).collect()
        assert all(0.9 < r.near_next < 1 for r in rows)
        one, two = (set(r.fingerprint.split(":")[2].split(",")) for r in rows)
        assert len(one & two) >= 24
    a, b = (fingerprint.PrefixHash(fingerprint.code_points(x)) for x in ("a short text", "a shorter text"))
    assert (a.found_in(b), b.found_in(a)) == (12, 12) and fingerprint.likeness(a, b, False) == 12 / 14


# similarity


def brute_classes(texts, t=0.8):
    def sh(doc):
        w = words(doc)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None

    same = {}
    for i, doc in enumerate(texts):
        same.setdefault(b" ".join(words(doc)) or i, []).append(i)
    reps = {v[0]: (sh(texts[v[0]]), v) for v in same.values()}
    links = {i: [j for j in reps if j != i and s and reps[j][0] and len(s & reps[j][0]) >= t * len(s | reps[j][0])] for i, (s, _) in reps.items()}
    out = {}
    for i in reps:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        for k in reps[i][1]:
            out[k] = (min(seen), len(links[i]), len(reps[i][1]))
    return out


def test_near_duplicates(spark):
    draw = random.Random(9)

    def near(doc, edits):
        w = doc.split()
        for _ in range(edits):
            w[draw.randrange(len(w))] = f"n{draw.randrange(1000)}"
        return " ".join(w)

    base = [text(i, 150) for i in range(6)]
    texts = ODD + [near(draw.choice(base), draw.randrange(7)) for _ in range(250)] + [text(1000 + i, 60) for i in range(30)] + [base[0]] * 20 + ["short one", "Short, one"]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in similarity.near_duplicates(docs(spark, texts), block=40).collect()}
    assert got == brute_classes(texts)
    assert similarity.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_one_of_each_class_stays(spark, monkeypatch):
    base, other = text(1, 150), text(2, 150)
    near = base.replace(base.split()[70], "changed", 1)
    rows = [(5, base)] * 40 + [(5, near)] * 3 + [(None, base), (9, base)]  # one class, its least id repeated
    rows += [(None, other)] * 30 + [(None, other.upper()), (None, other + " more")]  # a class without ids
    rows += [(5, text(3, 60)), (6, "alone"), (None, None), (7, ""), (7, "--")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    links = similarity._links
    seen = spark.sparkContext.accumulator(0)

    def counted(threshold):
        run = links(threshold)

        def group(table):
            seen.add(table.num_rows)
            return run(table)

        return group

    monkeypatch.setattr(similarity, "_links", counted)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, frame, "").collect()]
    assert seen.value == 4  # a row for each text: base and near, other and the longer one
    assert sorted((i or 0, t or "") for i, t in got if t not in (base, near)) == sorted([(0, ""), (7, ""), (7, "--"), (6, "alone"), (5, text(3, 60)), *[(i or 0, t) for i, t in got if t and t.lower().startswith(other)]])
    assert [i for i, t in got if t in (base, near)] == [5]
    assert sum(bool(t) and t.lower().startswith(other) for _, t in got) == 1
    again = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, frame.repartition(2), "").collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_posterior_keeps_links():
    least = similarity.least_matches()
    assert least[0] == 0 and all(a <= b for a, b in zip(least, least[1:], strict=False))
    assert least[-1] < 0.8 * similarity.HASHES


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {x: top(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == want
