"""Validation by resampling, in closed form: best, worst and majority of n draws, for n = 2, 4, ... up to all."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Draws up to which the chances of a majority are worked out; the work grows with their third power.
MOST_DRAWS = 128


def sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n itself; empty for fewer than two."""
    powers = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))), F.lit(1)).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("long"))
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.array_append(F.filter(powers, lambda x: x < n), n.cast("bigint")))


def majority(counts: list[int], draws: int) -> np.ndarray:
    """The chance of each label to be drawn most often in ``draws`` draws with replacement, where equals are
    decided by who was drawn first.

    Which of equal labels comes first is a matter of chance alone, so each label gets a rank u between 0 and
    1, and the one with the most draws, then the highest rank, wins. For m draws of a label the others have
    fewer, or m and a lower rank: coefficients of a product of polynomials over the other labels, in which
    u stands to a power below 1 + draws / m, so that a few Gauss points integrate it exactly.
    """
    p = np.array(counts, float) / sum(counts)
    power = np.array([lgamma(c + 1) for c in range(draws + 1)])
    terms = np.exp(np.arange(draws + 1) * np.log(p)[:, None] - power)
    out = np.zeros(len(p))
    for m in range(1, draws + 1):
        rest = draws - m
        points, weights = np.polynomial.legendre.leggauss(min(len(p), rest // m + 1) // 2 + 1)
        for u, w in zip((points + 1) / 2, weights / 2, strict=True):
            poly = np.where(np.arange(rest + 1) < m, terms[:, : rest + 1], 0.0)
            if m <= rest:
                poly[:, m] = u * terms[:, m]
            out += w * terms[:, m] * _others(poly, rest)
    return out * np.exp(power[draws])


def _others(poly: np.ndarray, at: int) -> np.ndarray:
    """Of each row, the coefficient at ``at`` of the product of all other rows."""
    one = np.zeros(at + 1)
    one[0] = 1
    before, after = [one], [one]
    for x in poly[:-1]:
        before.append(np.convolve(before[-1], x)[: at + 1])
    for x in poly[:0:-1]:
        after.append(np.convolve(after[-1], x)[: at + 1])
    return np.array([np.dot(a, b[::-1]) for a, b in zip(before, after[::-1], strict=True)])


def _chances(counts: pd.Series, draws: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for c, n in zip(counts, draws, strict=True):
        key = (tuple(sorted(int(x) for x in c)), int(n))
        if n <= MOST_DRAWS and key not in known:
            known[key] = dict(zip(key[0], majority(list(key[0]), key[1]).tolist(), strict=True))
        out.append([known[key][int(x)] for x in c] if n <= MOST_DRAWS else None)
    return pd.Series(out)


def series(df: DataFrame, group: list[str], value: str, label: str | None = None) -> DataFrame:
    """One row a group and n: n, n_rows, mean and std of the rows, best_mean, best_std, worst_mean, worst_std and,
    with a label, maj_mean and maj_std: the exact moments of what n draws with replacement give.

    A majority's value is that of its first draw. Rows with a null value take no part; a null label is a
    label. Groups of one row have no n and give none. More than MOST_DRAWS draws have no majority (null).
    Values and labels are counted before anything is sorted; a group's counts are what one task holds.
    """
    keys = [F.col(f"`{c}`") for c in group]
    held = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), *([F.col(label).alias("_l")] if label else []))
    moments = held.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    counts = held.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "n_rows": F.sum("_c").over(w)}).select("*", F.explode(sizes(F.col("n_rows"))).alias("n"))
    share = lambda c: F.pow(c / F.col("n_rows"), F.col("n").cast("double"))
    top = share(F.col("_upto")) - share(F.col("_upto") - F.col("_c"))
    low = share(F.col("n_rows") - F.col("_upto") + F.col("_c")) - share(F.col("n_rows") - F.col("_upto"))
    e = lambda x, p: F.sum(x * p)
    v = F.col("_v")
    out = ranked.groupBy(*keys, "n").agg(e(v, top).alias("best_mean"), _spread(e(v * v, top), e(v, top)).alias("best_std"), e(v, low).alias("worst_mean"), _spread(e(v * v, low), e(v, low)).alias("worst_std"))
    out = _joined(out, moments, group)
    if not label:
        return out
    votes = held.groupBy(*keys, "_l").agg(F.count("*").alias("_c"), F.avg("_v").alias("_m"), F.avg(F.col("_v") * F.col("_v")).alias("_q")).groupBy(*keys).agg(F.collect_list(F.struct("_c", "_m", "_q")).alias("_votes"))
    out = _joined(out, votes, group).withColumn("_p", F.pandas_udf(_chances, "array<double>")(F.col("_votes._c"), F.col("n")))
    total = lambda f: F.aggregate(F.arrays_zip("_p", "_votes"), F.lit(0.0), lambda a, x: a + x["_p"] * x["_votes"][f])
    seen = F.col("_p").isNotNull()
    out = out.withColumns({"maj_mean": F.when(seen, total("_m")), "_q": F.when(seen, total("_q"))})
    return out.withColumn("maj_std", _spread(F.col("_q"), F.col("maj_mean"))).drop("_votes", "_p", "_q")


def _spread(square: Column, mean: Column) -> Column:
    return F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def _joined(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    on = F.lit(True)
    for i, c in enumerate(group):
        right = right.withColumnRenamed(c, f"_g{i}")
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    return left.join(right, on).drop(*[f"_g{i}" for i in range(len(group))])


def by_source(per_group: DataFrame, source: str) -> DataFrame:
    """Means over the groups of a source, one row a source and metric: metric (mean@N, std@N, best@n/mean, ...,
    with the group's own numbers) and value. Metrics that a group lacks don't count."""
    name = lambda kind, n, part: F.concat(F.lit(f"{kind}@"), F.col(n).cast("string"), F.lit(f"/{part}" if part else ""))
    every = [F.struct(name(k, "n", p).alias("metric"), F.col(f"{k}_{p}").alias("value")) for k in ("best", "worst", "maj") for p in ("mean", "std") if f"{k}_{p}" in per_group.columns]
    own = [F.when(F.col("n") == F.col("n_rows"), F.struct(name(k, "n_rows", "").alias("metric"), F.col(k).alias("value"))) for k in ("mean", "std")]
    rows = per_group.select(F.col(f"`{source}`"), F.explode(F.array(*every, *own)).alias("_m")).where("_m.value is not null")
    return rows.groupBy(source, F.col("_m.metric").alias("metric")).agg(F.avg("_m.value").alias("value"))
