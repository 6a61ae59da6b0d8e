"""Queries that have no SQL against plain Python on the same rows, and positions against a plain sort."""

import hashlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from trellis.operators import batching, credit, ranges, sampling
from trellis.operators import sequences as seq
from trellis.plans import registry

QUERIES = registry.queries()


def spread(lengths, parts, k):
    sums = [0] * k
    for x, p in zip(lengths, parts, strict=True):
        sums[p] += x
    return max(sums) - min(sums)


@pytest.mark.parametrize(("name", "parts"), [("balanced_partitions", lambda n, total: 8), ("micro_batches", lambda n, total: max(1, min(n, -(-total // 40000))))])
def test_balanced_batches(name, parts, spark, sf):
    rows = QUERIES[name](spark, sf).toPandas()
    want = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert sorted(rows.doc_id) == sorted(want.doc_id) and dict(zip(rows.doc_id, rows.n_chars, strict=True)) == dict(zip(want.doc_id, want.n_chars, strict=True))
    for batch, g in rows.groupby(rows.doc_id // 64):
        lengths, k = g.n_chars.tolist(), parts(len(g), int(g.n_chars.sum()))
        assert (g.batch == batch).all() and g.part.between(0, k - 1).all() and (len(g) < k or g.part.nunique() == k)
        # differencing beats giving the longest first to the lightest part by construction of its bound
        assert spread(lengths, g.part, k) <= max(lengths)


def test_differencing_against_all_ways():
    import numpy as np

    worse = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        lengths, k = rng.integers(1, 40, int(rng.integers(2, 8))).tolist(), int(rng.integers(2, 4))
        got = batching.differencing(lengths, k)
        assert sorted(i for p in got for i in p) == list(range(len(lengths)))
        best = min(spread(lengths, p, k) for p in product(range(k), repeat=len(lengths)))
        mine = spread(lengths, [next(j for j, p in enumerate(got) if i in p) for i in range(len(lengths))], k)
        assert best <= mine <= max(lengths)
        worse += mine > best
    assert worse < 30


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_places_in_an_order(spark, size):
    df = spark.range(size).select(F.when(F.col("id") % 50 != 7, F.concat(F.lit("k"), (F.col("id") * 7919 % 5003).cast("string"))).alias("k"), (F.col("id") % 3).alias("g"))
    got = sorted((r.at, r.k) for r in ranges.numbered(df, "k", "at").collect())
    want = sorted((r.k for r in df.collect()), key=lambda k: (k is not None, k or ""))
    assert [k for _, k in got] == want and [a for a, _ in got] == list(range(size))
    assert ranges.numbered(df.limit(0), "k", "at").count() == 0
    held = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))  # a null stratum too
    got = defaultdict(list)
    for r in sampling.hash_rank(held, "g", "k", 5).collect():
        got[r.g].append((r["rank"], r.k))
    for g, rows in got.items():
        key = lambda k: (hashlib.sha256(":".join(x for x in ("5", None if g is None else str(g), k) if x is not None).encode()).hexdigest(), k is not None, k or "")  # noqa: B023, E731
        assert [a for a, _ in sorted(rows)] == list(range(1, len(rows) + 1))
        assert [key(k)[0] for _, k in sorted(rows)] == sorted(key(k)[0] for _, k in rows)


def test_repeats_and_pads(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("id"))
    got = sorted((r.position, r.id, r.copy) for r in seq.repeat(df, "id", 2, interleave=False).collect())
    assert got == [(c * 50 + i, 3 * i, c) for c in range(2) for i in range(50)]
    assert sorted(r.id for r in seq.pad_rows(df, "id", 32).where("is_pad").collect()) == [3 * i for i in range(14)]
    assert seq.pad_rows(df.limit(3), "id", 8).where("is_pad").count() == 5


def test_moments_far_from_zero(spark):
    df = spark.createDataFrame([("a", 1e9 + i, 1) for i in range(5)] + [("a", 5.0, 0), ("b", 1.0, 1)], "g string, v double, m int")
    got = {r.g: r for r in credit.masked_moments(df, "v", "m", ["g"]).collect()}
    assert got["a"].masked_var == pytest.approx(2.5) and got["b"].masked_var is None


def test_resample_keeps_every_draw(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", (F.rand(1) * 0.1).alias("w"))
    got = batching.resample(df, "g", "id", "w", 200, 4).groupBy("g", "draw").count().collect()
    assert len(got) == 600 and all(r["count"] == 1 for r in got)
