"""Token counts against the library; whitening against NumPy's eigenvectors and exact fractions."""

import math
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from trellis.llm import queries, tokencount, whitening

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = "doc_id long, text string, n_bytes string, n_tokens double, w int"


def expected(rows, limit=2048):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    n = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    return sorted(((i, b, k, k > limit) for i, b, k in n), key=str)


ODD = [
    None, "", " \t\n", "a", "It's they'll I'm 'S  don’t", "ΑΣ ΟΔΟΣ Σ", "é é ́ ́x", "İstanbul ŉ ß ǅ", "x\x1cy\x00z\x7f \x85 \xa0 　q", "1234 ²³ ٣ ⅷ 漢字かな 🙂👩‍👩‍👧",
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> <|endoftext|><|startoftext|>é", "<|endoftext|> " * 3, "!" * 500, "zq" * 400, "é" * 3000, "a​b­c﻿", "क्षत्रिय ไทย 한국어",
]


def test_counts_are_those_of_the_library(spark):
    rows = [(i, t, "x", 1.0, 2) for i, t in enumerate(ODD)] + [(None, "one two", "x", 1.0, 2)] * 2 + [(3, "a", "x", 1.0, 2), (99, "lorem ipsum, dolor " * 90_000, "x", 1.0, 2), (98, "café olé " * 70_000, "x", 1.0, 2)]
    got = tokencount.count(spark.createDataFrame(rows, SPEC).repartition(3), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert tokencount.count(spark.createDataFrame([], SPEC), PATH).collect() == []


def test_counts_of_random_texts(monkeypatch):
    rng = np.random.default_rng(5)
    signs = [*"aAbzZ019 \t\n'.,<|>-_", "'s", "'LL", "é", "é", "Σ", "ß", "漢", "　", "\x1d", "🙂", "<|endoftext|>", "ﬁ", "Ω"]
    monkeypatch.setattr(tokencount, "WINDOW", 50)
    sizes = tokencount.Sizes(tokencount.Tokenizer(PATH), {})
    assert sizes.tokenizer.local
    texts = ["".join(rng.choice(signs, rng.integers(0, 300))) for _ in range(300)]
    assert [sizes.count(t) for t in texts] == [n for _, _, n, _ in sorted(expected([(i, t) for i, t in enumerate(texts)]), key=lambda r: r[0])]


def test_a_file_of_another_kind_goes_through_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["Hello  there,\n\n it's 12345", "  é ", "a<|endoftext|> b"]
    got = {r.doc_id: r.n_tokens for r in tokencount.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        tokencount.Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))


def test_frequent_ones_are_not_encoded_again_and_misses_once(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = tokencount.frequent(docs, PATH, most=2000)
    assert len(known) == 2000 and max(map(len, known)) <= tokencount.LONGEST
    assert known == tokencount.frequent(docs.repartition(5), PATH, most=2000)
    sizes = tokencount.Sizes(tokencount.Tokenizer(PATH), known)
    texts = [r.text for r in docs.select("text").collect()]
    for t in texts:
        sizes.count(t or "")
    words = {w for t in texts for whole, g in sizes.tokenizer.pre_tokens(t or "") for w in (g if whole else tokencount._words(sizes.tokenizer, g))}
    assert sizes.kept.missed == len(words - known.keys()) and sizes.runs.missed == len({r for t in texts for whole, g in sizes.tokenizer.pre_tokens(t or "") if not whole for r in g})
    monkeypatch.setattr(tokencount, "CACHED", 10)
    small = tokencount.Sizes(sizes.tokenizer, {})
    assert [small.count(t or "") for t in texts[:20]] == [sizes.count(t or "") for t in texts[:20]] and len(small.kept) <= 10 and len(small.runs) <= 10


def test_query_counts_whole_texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_two_tier_counts(spark, sf).collect()), key=str) == expected(rows)


# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("d", [0, 1, 2, 3, 8, 21, 64])
def test_rotations_find_eigenvectors(d):
    rng = np.random.default_rng(d)
    m = rng.normal(size=(3 * d + 1, d))
    a = m.T @ m
    e, v = whitening.jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=0)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(a @ v, v * e, atol=1e-11 * max(1, np.abs(a).max() if d else 1))


def test_rotations_keep_small_eigenvalues():
    """A matrix of entries over 24 orders of magnitude: exact values by fractions of its 2 x 2 blocks."""
    scale = np.array([1e12, 1.0, 1e-6, 1e-12])
    a = np.outer(scale, scale) * (np.eye(4) + 0.2)
    e, _ = whitening.jacobi(a)
    c = np.linalg.cholesky(np.eye(4) + 0.2)
    exact = np.linalg.svd((scale[:, None] * c)[::-1, ::-1], compute_uv=False) ** 2
    assert np.allclose(np.prod(e / scale**2), np.linalg.det(np.eye(4) + 0.2), rtol=1e-10)
    assert np.allclose(e[:2], exact[:2], rtol=1e-10) and (e > 0).all()
    for held in (np.zeros((5, 5)), np.ones((6, 6)), np.diag([3.0, 3.0, 1.0])):
        got, v = whitening.jacobi(held)
        assert np.allclose(got, np.linalg.eigvalsh(held)[::-1], atol=1e-13) and np.allclose(v.T @ v, np.eye(len(held)))


def brute(rows, most=4):
    """From the definition, with exact fractions for everything before the eigenvectors."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[float(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / Fraction(n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in kept:
        for k in range(min(most, d)):
            w = sum(float(Fraction(n * x[j] - s[j], n)) * v[j, k] for j in range(d)) / math.sqrt(e[k])
            out.setdefault((i, k + 1), []).append((n, sum((n * x[j] - s[j]) ** 2 for j in range(d)), abs(w), e[k] / e.sum()))
    return out


VECTORS = "vec_id long, embedding array<float>, label int, x string, dim double, component string"


def check(got, rows, most=4):
    want, found = brute(rows, most), {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append((r.n, int(r.deviation), abs(r.whitened), r.explained))
        assert r.identity_error <= 1e-9
    assert found.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(found[k]), sorted(want[k]), strict=True):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-8, atol=1e-8)


def test_whitening_is_that_of_the_definition(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(60, 6)) * [3, 2, 1.2, 0.7, 0.2, 0.05] @ whitening_rotation(6)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(200, [0.0, -0.0, 1e-9, -1e-9, 200.0, -300.0]), (None, rows[3][1]), (5, rows[5][1])]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] + [0.0] * 5), (303, [float("-inf")] + [0.0] * 5)]
    table = spark.createDataFrame([(i, v, 1, "y", 2.0, "z") for i, v in rows + odd], VECTORS).repartition(4)
    got = whitening.whiten(table).collect()
    check(got, rows)
    one = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert all(r.whitened == one[r.component] for r in got if r.vec_id == 117)
    assert whitening.whiten(table, components=2).count() == 2 * len(rows)


def whitening_rotation(d):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(d, d)))
    return q


def test_whitening_of_odd_tables(spark):
    def rows(*vs, dims=VECTORS):
        return whitening.whiten(spark.createDataFrame([(i, v, 1, "y", 2.0, "z") for i, v in enumerate(vs)], dims)).collect()

    assert rows() == [] and rows(None, [], []) == [] and rows([1.0, 2.0], [1.0, 2.0]) == []
    flat = rows([1.0, 5.0], [2.0, 5.0], [4.0, 5.0])
    assert [r.component for r in flat] == [1, 1, 1] and all(abs(r.explained - 1) < 1e-12 for r in flat)
    longer = rows([1.0, 5.0], [2.0, 5.0], [4.0], [3.0], [3.0, 1.0, 1.0])
    assert {r.vec_id for r in longer} == {0, 1}
    assert {r.vec_id for r in rows([1.0, 2.0], [3.0, 5.0], [1e30, 0.0])} == {0, 1}


def test_deviations_beyond_a_long_are_exact(spark):
    big = [[1e15, 2.0], [-3e15, 1.0], [2e15, 7.0]]
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")).collect()
    check(got, list(enumerate(big)), 1)
    assert all(r.deviation > 2**63 for r in got)


def test_query_of_whitening(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.limit(120).collect()]
    check(whitening.whiten(spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<float>")).collect(), rows)
    got = queries.op13_jacobi_whitening(spark, sf)
    assert got.count() == 4 * table.count() and dict(got.dtypes)["deviation"] == "bigint" and got.where("identity_error > 0.0001 or deviation is null").count() == 0
