"""Length-balanced partitions and batches. Heap algorithms have no relational form, so each batch, which
is bounded by its size, is one group of an Arrow function."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sampling import hash_key


def differencing(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k parts of nearly equal sum by the largest differencing method (Karmarkar and Karp, 1982).

    A state is a tuple of parts with their sums; the two states of widest spread are merged, the
    heaviest part of one with the lightest of the other. With ``equal`` all parts get as many items:
    the states begin as k items each.
    """
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal:
        if len(lengths) % k:
            raise ValueError("the number of items isn't a multiple of the number of parts")
        states = [[(lengths[i], [i]) for i in order[s : s + k]] for s in range(0, len(order), k)]
    else:
        states = [[(lengths[i], [i])] + [(0, [])] * (k - 1) for i in order]
    heap = []
    for n, s in enumerate(states):
        s = sorted(s, key=lambda p: (-p[0], -len(p[1]), p[1]))
        heap.append((s[-1][0] - s[0][0], n, s))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        s = sorted(((p[0] + q[0], p[1] + q[1]) for p, q in zip(a, reversed(b), strict=True)), key=lambda p: (-p[0], -len(p[1]), p[1]))
        heapq.heappush(heap, (s[-1][0] - s[0][0], n, s))
        n += 1
    return sorted(sorted(p[1]) for p in heap[0][2]) if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Items in their order, each to the part of least sum (of those not full, if ``equal``)."""
    most = -(-len(lengths) // k) if equal else len(lengths)
    parts: list[list[int]] = [[] for _ in range(k)]
    sums = [0] * k
    for i, x in enumerate(lengths):
        j = min((p for p in range(k) if len(parts[p]) < most), key=lambda p: (sums[p], p))
        parts[j].append(i)
        sums[j] += x
    return parts


def balanced(df: DataFrame, batch: str, key: str, length: str, k: int, *, method=differencing) -> DataFrame:
    """Add part, a number in [0, k), within each batch."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key).reset_index(drop=True)
        part = np.zeros(len(f), int)
        for p, items in enumerate(method(f[length].tolist(), k)):
            part[items] = p
        return f.assign(part=part)

    return df.groupBy(batch).applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", part int")


def micro_batches(df: DataFrame, batch: str, key: str, length: str, cap: int) -> DataFrame:
    """Add part: micro-batches of balanced sums, as many as the batch's sum needs under ``cap``."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key).reset_index(drop=True)
        k = max(1, min(len(f), -(-int(f[length].sum()) // cap)))
        part = np.zeros(len(f), int)
        for p, items in enumerate(differencing(f[length].tolist(), k)):
            part[items] = p
        return f.assign(part=part)

    return df.groupBy(batch).applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", part int")


def length_grouped(df: DataFrame, key: str, length: str, size: int, windows: int, seed: int) -> DataFrame:
    """Add batch: rows permuted by hash, cut into windows of ``size * windows``, sorted in each by
    length (longest first) and cut into batches. Windows are hash ranges, so no task sorts all rows."""
    total = df.count()
    n = max(1, -(-total // (size * windows)))
    held = df.withColumn("_w", F.pmod(F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("long"), F.lit(n)))
    rank = F.row_number().over(W.partitionBy("_w").orderBy(F.desc(length), key)) - 1
    return held.withColumn("batch", F.concat_ws("-", F.col("_w").cast("string"), F.floor(rank / size).cast("string"))).drop("_w")


def resample(df: DataFrame, group: str, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` rows a group with replacement, with chances as their weights (at least 1e-8): uniform
    numbers from a hash fall between prefix sums.

    Rows lie in the order of a hash of their key, in ranges by its prefix. A draw first finds its range
    among a group's range totals, then its row inside the range, so that no task sorts or scans a
    whole group.
    """
    digest = F.sha2(F.col(key).cast("string"), 256)
    held = df.withColumn("_x", F.greatest(F.abs(weight), F.lit(1e-8)).cast("double")).withColumn("_d", digest).withColumn("_step", F.substring("_d", 1, 3))
    w = W.partitionBy("_g").orderBy("_at")
    sums = held.groupBy(F.col(group).alias("_g"), F.col("_step").alias("_at")).agg(F.sum("_x").alias("_sum"))
    upto = F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, 0))
    sums = sums.withColumns({"_from": upto - F.col("_sum"), "_upto": upto, "_all": F.sum("_sum").over(W.partitionBy("_g"))})
    u = (F.conv(F.substring(hash_key(seed, group, "draw"), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / float(1 << 32)
    ask = held.select(group).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_u", u)
    ask = ask.join(sums, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_t", F.col("_u") * F.col("_all")).where("_t >= _from and _t < _upto")
    ask = ask.select(F.col("_g").alias("_gg"), F.col("_at"), "_from", "_t", "draw")
    own = W.partitionBy(group, "_step").orderBy("_d", key).rowsBetween(W.unboundedPreceding, 0)
    rows = held.withColumns({"_hi": F.sum("_x").over(own), "_last": F.lead("_x").over(W.partitionBy(group, "_step").orderBy("_d", key)).isNull()})
    found = rows.join(ask, F.col(group).eqNullSafe(F.col("_gg")) & (F.col("_step") == F.col("_at")))
    found = found.where((F.col("_t") - F.col("_from") >= F.col("_hi") - F.col("_x")) & ((F.col("_t") - F.col("_from") < F.col("_hi")) | F.col("_last")))  # the last takes what rounding leaves
    return found.select("draw", *df.columns)
