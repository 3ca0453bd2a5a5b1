"""Merkle manifest, collision join and whitening against brute force, with odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.llm import collisions, merkle, whitening
from tests.llm.test_corpus import ODD, docs, text

# Merkle manifest


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """Root, and for each node its siblings from below, all by the definition."""
    proofs, at = [""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        proofs = [p + "".join(n for j, n in enumerate(nodes) if j // fanout == i // fanout and j != i) for p, i in zip(proofs, at, strict=True)]
        at = [i // fanout for i in at]
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return (nodes or [""])[0], proofs


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (3, 2)])
def test_manifest(spark, fanout, levels):
    sizes = {None: 9, "": 1, "a": 30, "é": 3, "b": 2, "z": 17, "A": 1}
    rows = [(i * 7 % 1000, s, None if i % 4 == 0 else "en", i if i % 3 else None, ODD[i % len(ODD)] if i % 5 else f"Text {i} ÄB") for s, n in sizes.items() for i in range(n)]
    rows += [(None, "a", "en", 1, "X"), (7, "a", "en", 1, "again"), (7, "a", "en", 1, "again")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = merkle.manifest(df, tampered, fanout=fanout, levels=levels, proofs=True).collect()
    expected, subroots, by = [], [], {}
    for s in sorted(sizes, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[1] == s), key=lambda x: x[:3])
        root, proofs = tree([x[2] for x in own], fanout)
        subroots.append(root)
        by[s] = list(zip(own, proofs, strict=True))
    top, upper = tree(subroots, fanout)
    for (_, own), subroot, above in zip(by.items(), subroots, upper, strict=True):
        for (_, _, digest, r), proof in own:
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None and leaf(*r[:4], r[4].translate({i: i + 32 for i in range(65, 91)})) != digest
            expected.append((r[0], digest, subroot, top, h(proof + above), not bad))
    key = lambda x: (x[0] is not None, x[0] or 0, *map(str, x[1:]))
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in found), key=key) == sorted(expected, key=key)
    for r in found:
        assert r.verified == (r.folded_root == r.root)
        assert merkle.fold(r.leaf, r.before, r.after) == r.root


def test_manifest_of_nothing_and_of_one(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
    (row,) = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf(1, None, None, None, None) and row.proof_sha256 == h("") and row.verified


# collision join


def shingle_set(t):
    w = (t or "").translate({i: i + 32 for i in range(65, 91)})
    for blank in "\t\n\x0b\x0c\r":
        w = w.replace(blank, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    """Set size, least id and kept of each row, from all pairs."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (ident, _) in enumerate(rows):
        ids = [r for k, (r, _) in enumerate(rows) if group[k] == group[i] and r is not None]
        least = min(ids, default=None)
        out.append((ident, len(sets[i]), least, ident == least))
    return out


def near(seed, base, edits):
    words = base.split(" ")
    for k in range(edits):
        words[(seed * 37 + k * 61) % len(words)] = f"n{seed}x{k}"
    return " ".join(words)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_collisions(spark, block_bytes):
    bases = [text(s, n) for s, n in ((1, 150), (2, 300), (3, 60), (4, 12))]
    texts = ODD + [near(s, b, e) for i, b in enumerate(bases) for e in range(4) for s in range(i * 100 + e * 20, i * 100 + e * 20 + (12 if i == 0 else 4))]
    texts += [bases[0].upper(), bases[0].replace(" ", "\t\n"), "a b c d", "a b c d e", "A B C D", " ".join(bases), *[text(500 + i, 80) + " " + bases[2] for i in range(6)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, bases[1]), (None, "alone without an id but with words"), (3, "other text of one id"), (3, "other text of one id")]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id long, text string, component_id string, kept string").repartition(3)
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in collisions.near_duplicates(df, block_bytes=block_bytes).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, *map(str, x[1:]))
    assert sorted(out, key=key) == sorted(brute(rows), key=key)


def test_collisions_of_nothing(spark):
    assert collisions.near_duplicates(docs(spark, [])).collect() == []
    assert [tuple(r) for r in collisions.near_duplicates(docs(spark, [None, " \t"])).orderBy("doc_id").collect()] == [(0, 0, 0, True), (1, 0, 1, True)]


def test_least_matches():
    draw = np.random.default_rng(3)
    assert collisions.least_matches() == 63
    assert (draw.binomial(collisions.HASHES, 0.85, 200_000) < collisions.least_matches()).mean() < 1e-4
    assert collisions.least_matches(missed=0.01) > collisions.least_matches(missed=1e-9)


def test_differences_decide_as_sets_do():
    draw = np.random.default_rng(5)
    reference = set(range(100))
    sets = [(reference - set(draw.integers(0, 100, k).tolist())) | set(draw.integers(100, 130, k).tolist()) for k in range(1, 20)]
    e = [np.array(sorted(s ^ reference), np.int64) for s in sets]
    same = np.zeros((len(sets), collisions.HASHES), np.uint32)
    every = np.arange(len(sets))
    found = collisions.linked(every, np.array([len(s) for s in sets]), same, e, every, every, 85, 63)
    top = collisions._Union()
    for a, b in found:
        top.root[top.top(a)] = top.top(b)
    got = {frozenset(k for k in range(len(sets)) if top.top(k) == top.top(i)) for i in range(len(sets))}
    expected = {i: {i} for i in range(len(sets))}
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and expected[i] is not expected[j]:
                expected[i] |= expected[j]
                for k in expected[j]:
                    expected[k] = expected[i]
    assert got == {frozenset(v) for v in expected.values()}


# whitening


def exact(vectors):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize(("d", "components", "extra"), [(6, 16, 48), (40, 5, 6), (40, 16, 48)])
def test_whitening(spark, d, components, extra):
    draw = np.random.default_rng(d)
    vectors = (draw.normal(size=(150, d)) * np.linspace(3, 0.3, d)).tolist()
    vectors += vectors[:30] + [vectors[0]] * 20
    odd = [(900, None), (901, [float("nan")] * d), (902, [1.0] * (d - 1) + [float("inf")]), (903, [None] * d), (904, [])]
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(vectors)] + [(i, v, "x") for i, v in odd] + [(None, vectors[1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(3)
    out = whitening.whiten(df, components=components, extra=extra, keep=["vec_id"]).collect()
    x, n, sums, values, axes = exact(vectors)
    k = min(components, d)
    assert len(out) == (len(vectors) + 1) * k and {r.component for r in out} == set(range(1, k + 1))
    got = {(r.vec_id, r.component): r for r in out}
    for j in range(1, k + 1):
        column = np.array([got[i, j].whitened for i in range(len(vectors))])
        expected = (np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in x], float) / n) @ axes[:, j - 1] / np.sqrt(values[j - 1])
        sign = np.sign(column @ expected)
        np.testing.assert_allclose(column * sign, expected, rtol=0, atol=1e-8)
        assert got[0, j].explained == pytest.approx(values[j - 1] / values.sum(), rel=1e-9)
    for i in range(len(vectors)):
        r = got[i, 1]
        assert (r.n, r.deviation) == (n, sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))) and r.identity_error < 1e-8


def test_whitening_without_spread(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(rows).count() == 0 and whitening.whiten(rows.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    out = whitening.whiten(line).collect()
    assert {r.component for r in out} == {1} and all(r.explained == pytest.approx(1) for r in out)
    with pytest.raises(ValueError, match="1 to 2"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "vec_id long, embedding array<float>"))


def test_exact_beyond_64_bits():
    x = np.array([[1 << 40, 3]], np.int64)
    offsets = whitening.exact_offsets(x, 1 << 30, [5, 7])
    assert whitening.deviations(offsets) == [((1 << 70) - 5) ** 2 + (3 * (1 << 30) - 7) ** 2]


def test_subspace_reaches_the_floor():
    draw = np.random.default_rng(8)
    q = np.linalg.qr(draw.normal(size=(60, 60)))[0]
    values = np.linspace(10, 1, 60)
    matrix = (q * values) @ q.T
    vectors, found, passes, residual = whitening.subspace(lambda b: matrix @ b, 60, 8, 12)
    np.testing.assert_allclose(found, values[:8], rtol=1e-12)
    assert np.abs(np.abs((vectors * q[:, :8]).sum(0)) - 1).max() < 1e-12 and passes > 3 and residual < 1e-10
