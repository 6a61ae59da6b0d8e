"""Best, worst and majority of n draws against all possible draws."""

import itertools
from collections import Counter

import numpy as np
import pytest

from trellis.operators import validation


def drawn(rows, n):
    """(best, worst, majority's value) of every sequence of n draws."""
    out = []
    for pick in itertools.product(range(len(rows)), repeat=n):
        votes = Counter(rows[i][1] for i in pick)
        top = max(votes.values())
        lead = next(rows[i][1] for i in pick if votes[rows[i][1]] == top)
        out.append((max(rows[i][0] for i in pick), min(rows[i][0] for i in pick), next(rows[i][0] for i in pick if rows[i][1] == lead)))
    return np.array(out)


GROUPS = {
    "a": [(1.0, "x"), (0.0, "y"), (0.5, "x"), (1.0, "z"), (0.25, None)], "b": [(1.0, "x"), (0.0, "y")], "c": [(2.0, "x")], "d": [(3.0, "x")] * 3, None: [(1.0, "x"), (0.0, "y"), (0.0, "y"), (1.0, "w"), (4.0, "x"), (2.0, "v")],
}


def test_moments_of_all_draws(spark):
    df = spark.createDataFrame([(g, v, p) for g, rows in GROUPS.items() for v, p in rows] + [("a", None, "x"), ("e", None, None)], "g string, v double, p string").repartition(3)
    got = {(r.g, r.n): r for r in validation.series(df, ["g"], "v", "p").collect()}
    assert sorted(got, key=str) == sorted([("a", 2), ("a", 4), ("a", 5), ("b", 2), ("d", 2), ("d", 3), (None, 2), (None, 4), (None, 6)], key=str)
    for (g, n), r in got.items():
        values = [v for v, _ in GROUPS[g]]
        assert (r.n_rows, r.mean, r.std) == (len(values), pytest.approx(np.mean(values)), pytest.approx(np.std(values), abs=1e-9))
        every = drawn(GROUPS[g], n)
        assert (r.best_mean, r.worst_mean, r.maj_mean) == pytest.approx(tuple(every.mean(axis=0)), abs=1e-9)
        assert (r.best_std, r.worst_std, r.maj_std) == pytest.approx(tuple(every.std(axis=0)), abs=1e-7)
    assert validation.series(df.limit(0), ["g"], "v", "p").collect() == []
    assert "maj_mean" not in validation.series(df, ["g"], "v").columns


@pytest.mark.parametrize("counts", [[1], [5, 5], [9, 3, 2, 2], [1] * 16, [40, 17, 4, 3]])
@pytest.mark.parametrize("draws", [1, 2, 7, 16, 64])
def test_majorities_like_many_draws(counts, draws):
    p = validation.majority(counts, draws)
    assert p.sum() == pytest.approx(1, abs=1e-9) and (np.diff([p[counts.index(c)] for c in sorted(set(counts))]) > -1e-12).all()
    rng = np.random.default_rng(42)
    picks = rng.choice(len(counts), size=(4000, draws), p=np.array(counts) / sum(counts))
    wins = np.zeros(len(counts))
    for row in picks.tolist():
        votes = Counter(row)
        top = max(votes.values())
        wins[next(x for x in row if votes[x] == top)] += 1
    assert np.abs(wins / 4000 - p).max() < 0.04


def test_names_and_means_by_source(spark):
    df = spark.createDataFrame([("s", "p", 1.0, "x"), ("s", "p", 0.0, "y"), ("s", "q", 1.0, "x"), ("s", "q", 1.0, "x"), ("s", "r", 5.0, "x")], "s string, q string, v double, l string")
    got = {r.metric: r.value for r in validation.by_source(validation.series(df, ["s", "q"], "v", "l"), "s").collect()}
    assert got == pytest.approx({"mean@2": 0.75, "std@2": 0.25, "best@2/mean": 0.875, "best@2/std": np.sqrt(3) / 8, "worst@2/mean": 0.625, "worst@2/std": np.sqrt(3) / 8, "maj@2/mean": 0.75, "maj@2/std": 0.25})


def test_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(validation, "MOST_DRAWS", 4)
    df = spark.range(10).selectExpr("'g' AS g", "cast(id AS double) AS v", "id % 2 AS l")
    assert {r.n: r.maj_mean is None for r in validation.series(df, ["g"], "v", "l").collect()} == {2: False, 4: False, 8: True, 10: True}
