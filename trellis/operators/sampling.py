"""Deterministic samples, quotas, splits and pools, by hashes rather than random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import in_order, quantiles, ranked


def hash_key(seed: int | str, *cols: str) -> Column:
    """Hex sha256 of seed:col:col..., the order in which strata are drawn."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def hash_rank(df: DataFrame, stratum: str, key: str, seed: int | str) -> DataFrame:
    """Add rank, from 1, in each stratum by hash: a stratum's rows are ranked in ranges of the hash, so a
    large one is many tasks."""
    return ranked(df, [stratum], hash_key(seed, stratum, key), [F.col(key)], "rank").withColumn("rank", F.col("rank") + 1)


def quotas(sizes: DataFrame, stratum: str, size: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total``: floors, and one more for the largest remainders, ties to
    the later stratum. ``sizes`` is one row a stratum, so the window without a key is small."""
    every = W.partitionBy()
    share = F.col(size) * total / F.sum(size).over(every)
    held = sizes.withColumn("_f", F.floor(share)).withColumn("_r", F.round(share - F.col("_f"), 9))
    left = F.lit(total) - F.sum("_f").over(every)
    rank = F.row_number().over(W.orderBy(F.desc("_r"), F.desc(stratum)))
    return held.withColumn("_left", left).withColumn("_rank", rank).withColumn("quota", F.col("_f") + (F.col("_rank") <= F.col("_left")).cast("int")).drop("_f", "_r", "_left", "_rank")


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: int | str) -> DataFrame:
    """``total`` rows with largest-remainder quotas, the first of each stratum by hash."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    return hash_rank(df, stratum, key, seed).join(quotas(sizes, stratum, "_size", total).select(stratum, "quota"), stratum).where(F.col("rank") <= F.col("quota"))


def fraction(df: DataFrame, stratum: str, key: str, share: float, seed: int | str) -> DataFrame:
    """The first max(1, floor(n * share)) rows of each stratum by hash."""
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    held = hash_rank(df, stratum, key, seed).join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    return held.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n", "_s")


def share_split(df: DataFrame, digest: Column, key: str, share: float) -> DataFrame:
    """Add split: train for the first floor(n * share) rows by ``digest``, then key; test for the rest."""
    n = df.count()
    return ranked(df, [], digest, [F.col(key)], "_rank").withColumn("split", F.when(F.col("_rank") < int(share * n), "train").otherwise("test")).drop("_rank")


def group_split(df: DataFrame, group: str, seed: int | str, *, held_out: int, of: int) -> DataFrame:
    """Add split: validation for groups whose hash falls in ``held_out`` parts ``of`` all, so no group
    is on both sides. Needs no shuffle."""
    part = F.conv(F.substring(hash_key(seed, group), 1, 8), 16, 10).cast("long") % of
    return df.withColumn("split", F.when(part < held_out, "validation").otherwise("train"))


def length_buckets(df: DataFrame, group: str, length: str) -> DataFrame:
    """short, mid or long by the order statistics at (n-1)//3 and min(n-1, 2n//3); ties are short. Both are
    read off a group's counts by length, so no task sorts a group's rows."""
    sizes = df.where(F.col(length).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(length).alias("_l")).agg(F.count("*").alias("_c"))
    w = W.partitionBy("_g")
    sizes = sizes.withColumns({"_n": F.sum("_c").over(w), "_upto": F.sum("_c").over(w.orderBy("_l").rowsBetween(W.unboundedPreceding, 0))})
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_l")))
    edges = sizes.groupBy("_g").agg(at(F.floor((F.col("_n") - 1) / 3)).alias("_lo"), at(F.least(F.col("_n") - 1, F.floor(2 * F.col("_n") / 3))).alias("_hi"))
    held = df.join(edges, F.col(group).eqNullSafe(F.col("_g")), "left")
    return held.withColumn("bucket", F.when(F.col(length) <= F.col("_lo"), "short").when(F.col(length) >= F.col("_hi"), "long").otherwise("mid")).drop("_g", "_lo", "_hi")


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key and n_copies, the rows it stands for. Only the key and the order are
    compared; partial aggregation holds one row a key."""
    held = df.withColumn("_key", key)
    first = held.groupBy("_key").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"), F.count("*").alias("n_copies"))
    return first.select("_row.*", "n_copies")


def representatives(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Per group the row whose score is nearest to the group's exact median; ties go to the smaller key. No
    task holds a group: the median comes by ranges of values, the nearest row by a partial aggregate."""
    med = quantiles(df, [group], score, {"median": 0.5}).withColumnRenamed(group, "_g")
    near = df.join(med, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    row = F.struct(*[F.col(c) for c in near.columns])
    best = near.groupBy(group).agg(F.min_by(row, F.struct(F.round(F.abs(F.col(score) - F.col("median")), 9), F.col(key))).alias("_row"))
    return best.select("_row.*")


def pools(df: DataFrame, stratum: str, key: str, seed: int | str, sizes: dict[str, int]) -> DataFrame:
    """Add pool: disjoint pools of the given sizes a stratum, in order of hash rank; the rest is 'rest'."""
    out = F.lit("rest")
    rank = F.col("rank")
    for name, n in reversed(list(sizes.items())):
        lo = sum(list(sizes.values())[: list(sizes).index(name)])
        out = F.when((rank > lo) & (rank <= lo + n), name).otherwise(out)
    return hash_rank(df, stratum, key, seed).withColumn("pool", out)


def pick_validation(groups: DataFrame, env: str, key: str, length: str, count: int, seed: int | str) -> DataFrame:
    """``count`` task groups for validation: of each environment the first by hash, then the first of
    each length bucket still missing, then the first of the rest. Adds reason.

    ``groups`` has one row a group; the stages number the whole choice by (stage, hash), so it is one
    window over what may be chosen.
    """
    held = length_buckets(groups.withColumn("_all", F.lit(1)), "_all", length).drop("_all")
    first = F.row_number().over(W.partitionBy(env).orderBy(hash_key(f"env:{seed}", env, key), key)) == 1
    held = held.withColumn("_env", first)
    have = held.where("_env").select("bucket").distinct().withColumn("_have", F.lit(True))
    held = held.join(F.broadcast(have), "bucket", "left")
    by_bucket = F.row_number().over(W.partitionBy("bucket", "_env").orderBy(hash_key(f"bucket:{seed}", "bucket", key), key)) == 1
    stage = F.when(F.col("_env"), 0).when(F.col("_have").isNull() & by_bucket, 1).otherwise(2)
    held = held.withColumn("_stage", stage).withColumn("_h", hash_key(f"extra:{seed}", key))
    chosen = held.orderBy("_stage", "_h").limit(count)
    return chosen.withColumn("reason", F.element_at(F.array(F.lit("environment"), F.lit("length"), F.lit("extra")), F.col("_stage") + 1)).drop("_env", "_have", "_stage", "_h")


def spaced(df: DataFrame, group: str, score: str, key: str, n: int, *, least: float = 5e-3, constant: float = 1e-6) -> DataFrame:
    """``n`` rows a group over the range of scores: the lowest, the highest, and evenly spaced ones of the rows
    between these (their ranks rounded half to even); what falls together counts once, and the next rows
    in order fill up. Groups of fewer rows, or whose scores differ by too little, give none. Equal
    scores are ordered by ``key``; rows with a null score take no part.
    """
    held = in_order(df.where(F.col(score).isNotNull()), [group], [score, key], "_at")
    sizes = held.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_m"), (F.max(score) - F.min(score)).alias("_spread"))
    sizes = sizes.where((F.col("_m") >= n) & (F.col("_spread") > constant) & (F.col("_spread") + constant >= least))
    held = held.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g", "_spread")
    between, free = F.col("_m") - 2, max(n - 2, 0)
    few = F.transform(F.sequence(F.lit(1), F.greatest(between, F.lit(1))), lambda i: i)
    spread = F.array(*[1 + F.bround(F.lit(float(i + 1)) * (between - 1) / (free + 1)).cast("long") for i in range(free)])
    middles = F.when(between <= 0, F.array().cast("array<bigint>")).when(between <= free, few.cast("array<bigint>")).otherwise(spread.cast("array<bigint>")) if free else F.array().cast("array<bigint>")
    wanted = F.slice(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint"), F.col("_m") - 1), middles)), 1, n)
    held = held.withColumn("_first", (~F.array_contains(wanted, F.col("_at"))).cast("int")).where((F.col("_first") == 0) | (F.col("_at") < n))
    return held.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy("_first", "_at"))).where(F.col("_k") <= n).drop("_at", "_m", "_first", "_k")
