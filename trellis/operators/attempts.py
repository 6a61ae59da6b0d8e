"""Attempts at tasks: pass@k, best and first attempts, checkpoints, bootstrap, streaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_task(df: DataFrame, task: str, attempt: str, success: Column, valid: Column, metrics: list[str], k: int) -> DataFrame:
    """One row a task over its first ``k`` attempts: n_attempts, passed, passed_first, n_valid, early
    (stopped before k) and for each metric first_, mean_ and best_ (over valid attempts, over all if
    none is valid). Success means exactly 1."""
    ok, good = F.coalesce(success, F.lit(0.0)) == 1.0, F.coalesce(valid, F.lit(1.0)) != 0
    held = df.where(F.col(attempt) <= k).withColumns({"_ok": ok.cast("int"), "_v": good.cast("int")})
    aggs = [F.count("*").alias("n_attempts"), F.max("_ok").alias("passed"), F.min_by("_ok", attempt).alias("passed_first"), F.sum("_v").alias("n_valid"), (F.count("*") < k).cast("int").alias("early")]
    for m in metrics:
        aggs += [F.min_by(m, attempt).alias(f"first_{m}"), F.avg(m).alias(f"mean_{m}"), F.coalesce(F.max(F.when(F.col("_v") == 1, F.col(m))), F.max(m)).alias(f"best_{m}")]
    return held.groupBy(task).agg(*aggs)


def summary(tasks: DataFrame, metrics: list[str]) -> DataFrame:
    """One row over all tasks: pass_at_k, pass_at_1, n_tasks, n_attempts, n_early, valid_rate and the
    means of the tasks' metrics."""
    aggs = [F.avg("passed").alias("pass_at_k"), F.avg("passed_first").alias("pass_at_1"), F.count("*").alias("n_tasks"), F.sum("n_attempts").alias("n_attempts"), F.sum("early").alias("n_early"), F.try_divide(F.sum("n_valid"), F.sum("n_attempts")).alias("valid_rate")]
    return tasks.agg(*aggs, *[F.avg(f"{p}_{m}").alias(f"{p}_{m}") for m in metrics for p in ("first", "mean", "best")])


def majority(df: DataFrame, group: str, label: str, value: str, order: str) -> DataFrame:
    """Per group the value at the first place of the most frequent label; ties go to the label seen first."""
    labels = df.groupBy(group, label).agg(F.count("*").alias("n"), F.min(order).alias("_at"), F.min_by(value, order).alias("value"))
    return labels.groupBy(group).agg(F.max_by(F.struct(label, "n", "value"), F.struct("n", -F.col("_at"))).alias("x")).select(group, f"x.{label}", "x.n", "x.value")


def expected_best(df: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """The exact mean of the best of ``k`` draws with replacement, and of the worst."""
    n, i = F.count("*").over(W.partitionBy(group)), F.row_number().over(W.partitionBy(group).orderBy(score))
    up = F.pow(i / n, F.lit(k)) - F.pow((i - 1) / n, F.lit(k))
    down = F.pow((n - i + 1) / n, F.lit(k)) - F.pow((n - i) / n, F.lit(k))
    held = df.withColumns({"_up": F.col(score) * up, "_down": F.col(score) * down})
    return held.groupBy(group).agg(F.sum("_up").alias("best_mean"), F.sum("_down").alias("worst_mean"))


def zero_streaks(df: DataFrame, task: str, step: str, zero: Column, *, least: int = 3) -> DataFrame:
    """Add streak, the number of zero steps in a row so far, and first_admitted, the step at which the
    streak first reached ``least``. Any other step ends the streak."""
    w = W.partitionBy(task).orderBy(step)
    held = df.withColumn("_z", zero.cast("int")).withColumn("_island", F.sum(1 - F.col("_z")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    held = held.withColumn("streak", F.sum("_z").over(W.partitionBy(task, "_island").orderBy(step).rowsBetween(W.unboundedPreceding, 0)))
    return held.withColumn("first_admitted", F.min(F.when(F.col("streak") >= least, F.col(step))).over(W.partitionBy(task))).drop("_z", "_island")


def best_checkpoint(df: DataFrame, epoch: str, loss: str, rates: list[str]) -> DataFrame:
    """The epoch of least loss among those whose rates didn't fall below the epoch before."""
    w = W.orderBy(epoch)
    held = F.lit(True)
    for r in rates:
        held = held & F.coalesce(F.col(r) >= F.lag(r).over(w), F.lit(True))
    return df.withColumn("_held", held).where("_held").orderBy(loss, epoch).limit(1).drop("_held")


def reduce_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    """Metrics named ...max... by maximum, else ...min... by minimum, else by mean."""
    big, small = F.lower(name).contains("max"), F.lower(name).contains("min")
    return df.groupBy(name).agg(F.when(F.first(big), F.max(value)).when(F.first(small), F.min(value)).otherwise(F.avg(value)).alias("value"))


def retry_until_varied(df: DataFrame, uid: str, batch: str, score: str, *, most: int = 3, least: float = 5e-3) -> DataFrame:
    """Per uid the first of ``most`` batches whose scores vary by ``least``; skip where none does."""
    each = df.where(F.col(batch) < most).groupBy(uid, batch).agg((F.max(score) - F.min(score)).alias("spread"))
    out = each.groupBy(uid).agg(F.min(F.when(F.col("spread") >= least, F.col(batch))).alias("used_batch"), F.max("spread").alias("spread"))
    return out.withColumn("skip", F.col("used_batch").isNull())


def nll(df: DataFrame, row: str, loss: str, weight: str) -> DataFrame:
    """Weighted mean loss over all tokens, its perplexity (exponent 50 at most), and the mean over rows
    of their own weighted means."""
    rows = df.groupBy(row).agg(F.sum(F.col(loss) * F.col(weight)).alias("s"), F.sum(weight).alias("w"))
    micro = F.try_divide(F.sum("s"), F.sum("w"))
    return rows.agg(micro.alias("nll"), F.exp(F.least(F.lit(50.0), micro)).alias("perplexity"), F.avg(F.try_divide(F.col("s"), F.col("w"))).alias("macro_nll"))


#: Groups whose draws are held at once, times draws: 512 groups of 1,000.
DRAWN = 512_000


def _draws(x: np.ndarray, draws: int, k: int, seed: int) -> Iterator[np.ndarray]:
    """(best mean, best deviation, worst mean, worst deviation) of each row of ``x``: groups of one size, which
    have the same places drawn. What different draws of the same places give is worked out once."""
    places = np.sort(np.random.RandomState(seed).choice(x.shape[1], size=(draws, k), replace=True), axis=1)
    kinds, which = np.unique(places, axis=0, return_inverse=True)
    which, step = which.reshape(-1), max(1, DRAWN // draws)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        best, worst = part[:, kinds[:, 0]], part[:, kinds[:, 0]]
        for j in range(1, k):
            best, worst = np.maximum(best, part[:, kinds[:, j]]), np.minimum(worst, part[:, kinds[:, j]])
        best, worst = (np.ascontiguousarray(y[:, which]) for y in (best, worst))
        yield np.stack([best.mean(axis=1), best.std(axis=1), worst.mean(axis=1), worst.std(axis=1)], axis=1)


def bootstrap(df: DataFrame, group: str, score: str, order: str, k: int, *, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Seeded draws of ``k`` scores with replacement: mean and deviation of their best and worst.

    A group is the responses to one prompt, in ``order`` (nulls last, then by score); each is one array.
    The places drawn hang on a group's size alone, so groups of one size are drawn together, batch by
    batch. For groups without such a bound there is ``expected_best``, which is exact and needs no draws.
    """
    names = ["best_mean", "best_std", "worst_mean", "worst_std"]

    def run(scores: pa.Array) -> pa.Array:
        sizes, flat = scores.value_lengths().to_numpy(zero_copy_only=False), scores.flatten().to_numpy(zero_copy_only=False)
        starts, out = np.cumsum(sizes) - sizes, np.empty((len(sizes), 4))
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            out[rows] = np.concatenate(list(_draws(flat[starts[rows][:, None] + np.arange(n)], draws, k, seed)))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(out[:, i])) for i in range(4)], names)

    place = F.struct(F.col(order).isNull(), F.col(order).alias("o"), F.col(score).cast("double").alias("s"))
    held = df.where(F.col(score).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(place)).alias("_x"))
    drawn = F.arrow_udf(run, ", ".join(f"{n} double" for n in names))(F.transform("_x", lambda x: x["s"]))
    return held.select(group, drawn.alias("_d")).select(group, "_d.*")


def usage(tasks: DataFrame, calls: DataFrame, task: str, counts: list[str]) -> DataFrame:
    """Per task the number of calls and the sums of ``counts``; zeros for tasks without calls."""
    sums = calls.groupBy(F.col(task).alias("_task")).agg(F.count("*").alias("n_calls"), *[F.sum(c).alias(c) for c in counts])
    return tasks.select(task).join(sums, F.col(task) == F.col("_task"), "left").select(task, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_calls", *counts)])


def match_rates(df: DataFrame, by: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per ``by`` the rows and, for each name, the share whose two columns agree (nulls agree with nulls)."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias(name) for name, (a, b) in pairs.items()])
