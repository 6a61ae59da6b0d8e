"""Token rows as arrays: masks, turns, padding, repeats, chunks, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import numbered


def mask_until_end(tokens: Column, end: int) -> Column:
    """1 up to the first ``end`` and on it, 0 after."""
    at = F.array_position(tokens, F.lit(end))
    return F.transform(tokens, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def pad(tokens: Column, size: int, by: int = 0, *, left: bool = False) -> Column:
    """Cut to ``size`` (the first tokens stay, or the last if ``left``) and filled up on that side."""
    fill = F.array_repeat(F.lit(by), F.greatest(F.lit(0), F.lit(size) - F.size(tokens)))
    n = F.least(F.size(tokens), F.lit(size))
    return F.concat(fill, F.slice(tokens, F.size(tokens) - n + 1, n)) if left else F.concat(F.slice(tokens, F.lit(1), n), fill)


def truncate(tokens: Column, size: int, side: str) -> Column:
    """The last tokens ('left' is cut), the first ('right'), or both ends ('middle')."""
    n = F.size(tokens)
    if side == "left":
        return F.slice(tokens, F.greatest(n - size, F.lit(0)) + 1, F.lit(size))
    if side == "right":
        return F.slice(tokens, F.lit(1), F.lit(size))
    if side == "middle":
        return F.when(n <= size, tokens).otherwise(F.concat(F.slice(tokens, F.lit(1), F.lit(size // 2)), F.slice(tokens, n - (size - size // 2) + 1, F.lit(size - size // 2))))
    raise ValueError(side)


def round_up(c: Column, to: int = 128) -> Column:
    return (F.ceil(c / to) * to).cast("long")


def place_last(size: Column, value: Column) -> Column:
    """``value`` at the last of ``size`` places, 0 before."""
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i == size, value).otherwise(0.0))


def repeat(df: DataFrame, key: str, n: int, *, interleave: bool = True) -> DataFrame:
    """Each row ``n`` times, with copy and position: aabb if ``interleave``, else abab."""
    total = df.count()
    held = numbered(df, key, "_rid").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.col("_rid") * n + F.col("copy") if interleave else F.col("copy") * total + F.col("_rid")
    return held.withColumn("position", at).drop("_rid")


def chunks(df: DataFrame, array: str, size: int) -> DataFrame:
    """One row a chunk of ``size`` elements of an array, with its number; empty arrays give none."""
    n = F.ceil(F.size(array) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(array), i * size + 1, F.lit(size)))
    return df.where(F.size(array) > 0).select(*[c for c in df.columns if c != array], F.posexplode(cut).alias("chunk", array))


def turns(df: DataFrame, row: str, pos: str, starts: Column) -> DataFrame:
    """Add turn: the number of starts up to a position; a row whose first position is no start has one there."""
    w = W.partitionBy(row).orderBy(pos)
    first = F.row_number().over(w) == 1
    return df.withColumn("_s", (starts | first).cast("int")).withColumn("turn", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_s")


def reverse_sums(df: DataFrame, row: str, pos: str, value: str) -> DataFrame:
    """Add return: the sum of a row's values from a position to its end, by a frame that grows from the end."""
    w = W.partitionBy(row).orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("return", F.sum(value).over(w))


def fragments(df: DataFrame, array: str, reward: str) -> DataFrame:
    """One row a fragment of a rollout, with number, count and is_last; the reward stands on the last only."""
    n = F.size(array)
    out = df.withColumn("_n", n).select(*[c for c in df.columns if c not in (array, reward)], "_n", reward, F.posexplode_outer(array).alias("fragment", array))
    last = F.col("fragment") == F.col("_n") - 1
    return out.withColumn("is_last", last).withColumn(reward, F.when(last, F.col(reward)).otherwise(0.0)).withColumnRenamed("_n", "n_fragments")


def offsets(df: DataFrame, group: str, key: str, length: str) -> DataFrame:
    """Add start and end of each row when a group's rows are laid end to end."""
    w = W.partitionBy(group).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(length).over(w)).withColumn("start", F.col("end") - F.col(length))


def pad_rows(df: DataFrame, key: str, divisor: int) -> DataFrame:
    """Rows until their number divides, taken again from the first; is_pad tells copies."""
    n = df.count()
    missing = -n % divisor if n else 0
    held = df.withColumn("is_pad", F.lit(False))
    if not missing:
        return held
    rounds = -(-missing // n)
    first = numbered(df, key, "_rid").where(F.col("_rid") < missing).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    again = first.where(F.col("_copy") * n + F.col("_rid") < missing).drop("_rid", "_copy")
    return held.unionByName(again.withColumn("is_pad", F.lit(True)))
