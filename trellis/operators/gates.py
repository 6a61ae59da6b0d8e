"""Checks that must hold before rows go on: pools, list lengths, conserved sums, cache keys, task keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .credit import conservation
from .ranges import ranked
from .sampling import hash_key, hash_rank, quotas


class Broken(ValueError):
    """A check that doesn't hold; the message names what breaks it."""


def pool_violations(rows: DataFrame, pool: str, key: str, *, disjoint: list[str], parents: dict[str, str] | None = None, opaque: str = "opaque::") -> DataFrame:
    """(kind, key, pools) of every breach: a key twice in one pool (duplicate), in two of the ``disjoint``
    pools (overlap), in a pool but not in its parent (outside_parent), or an opaque key in any. One
    aggregate by key, so that pools are never compared with each other."""
    held = rows.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_set(pool)).alias("pools"), F.count("*").alias("_n"), F.count_distinct(pool).alias("_p"))
    active = F.array_intersect("pools", F.array(*[F.lit(p) for p in disjoint]))
    outside = F.lit(False)
    for child, parent in (parents or {}).items():
        outside = outside | (F.array_contains("pools", child) & ~F.array_contains("pools", parent))
    kinds = F.array(
        F.when(F.col("_n") > F.col("_p"), "duplicate"), F.when(F.size(active) > 1, "overlap"), F.when(outside, "outside_parent"), F.when(F.col("key").startswith(opaque), "opaque"),
    )
    return held.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"), "key", F.concat_ws(",", "pools").alias("pools"))


def misaligned(df: DataFrame, arrays: list[str], size: Column) -> DataFrame:
    """(name, length, expected, n_rows) of the lists whose length isn't ``size``; a null list has -1."""
    rows = F.array(*[F.struct(F.lit(a).alias("name"), F.coalesce(F.size(a), F.lit(-1)).alias("length"), size.cast("int").alias("expected")) for a in sorted(arrays)])
    return df.select(F.explode(rows).alias("x")).select("x.*").where("length <> expected").groupBy("name", "length", "expected").agg(F.count("*").alias("n_rows"))


def require_none(found: DataFrame, what: str, shown: int = 5) -> None:
    """Raise if a check found anything; the first few rows say what."""
    rows = found.limit(shown).collect()
    if rows:
        raise Broken(f"{what}: {[tuple(r) for r in rows]}")


def credit_diagnostics(df: DataFrame, row: str, before: str, after: str) -> DataFrame:
    """One row over tokens: the largest error of a row's sum, absolute, relative and by token, and whether
    all values are finite."""
    sums = conservation(df, row, before, after)
    tokens = df.groupBy(row).agg(F.count("*").alias("_n"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    finite = df.agg((F.count(F.when(bad(before) | bad(after), 1)) == 0).alias("finite"))
    worst = sums.join(tokens, row).agg(F.max("error").alias("absolute"), F.max("relative_error").alias("relative"), F.max(F.col("error") / F.col("_n")).alias("by_token"))
    return worst.join(F.broadcast(finite))


def stage_gate(df: DataFrame, row: str, before: str, after: str, stage: str, *, atol: float = 1e-5, rtol: float = 1e-6, missing: Column | None = None) -> tuple[DataFrame, dict]:
    """(rows with advantage, diagnostics) of the stages off, shadow and train.

    Off and shadow keep the values before; shadow measures too. Train takes the values after, but
    only if no row misses its events and sums are kept to ``atol`` or, relative to the larger L1, to
    ``rtol``; else it is an error. One small aggregate comes to the driver.
    """
    if stage not in ("off", "shadow", "train"):
        raise Broken(f"no stage is named {stage}")
    if not (0 <= atol < float("inf") and 0 <= rtol < float("inf")):
        raise Broken("tolerances must be finite and not negative")
    if stage == "off":
        return df.withColumn("advantage", F.col(before)), {"applied": False}
    found = credit_diagnostics(df, row, before, after).first()
    said = {"absolute": found.absolute or 0.0, "relative": found.relative or 0.0, "by_token": found.by_token or 0.0, "finite": found.finite, "applied": False}
    if stage == "shadow":
        return df.withColumn("advantage", F.col(before)), said
    gone = df.where(missing).select(row).distinct().count() if missing is not None else 0
    if gone:
        raise Broken(f"{gone} rows miss their events")
    if not (said["finite"] and (said["absolute"] <= atol or said["relative"] <= rtol)):
        raise Broken(f"sums aren't kept: {said}")
    return df.withColumn("advantage", F.col(after)), said | {"applied": True}


def training_pools(tasks: DataFrame, *, env: str, key: str, split: str, known: DataFrame, target: int, smoke: dict[str, int], seed: int | str) -> DataFrame:
    """(env, key, pool, role) of the training tasks: the pool for supervised training is what is ``known``
    (env, key) and, up to each environment's largest-remainder share of ``target``, the first of the
    rest by hash; smoke is its first few by a salted hash, in addition; all other tasks are for
    rollouts. A share below what is known, or too few tasks for smoke, is an error.
    """
    train = tasks.where(F.col(split) == "train").select(env, key)
    held = train.join(known.select(env, key).distinct().withColumn("_known", F.lit(True)), [env, key], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    sizes = held.groupBy(env).agg(F.count("*").alias("_size"), F.sum(F.col("_known").cast("int")).alias("_have"))
    shares = quotas(sizes, env, "_size", target).withColumn("_more", F.col("quota") - F.col("_have"))
    require_none(shares.where("_more < 0").select(env, "quota", "_have").orderBy(env), "more tasks are known than the target's share")
    require_none(shares.where("quota > _size").select(env, "quota", "_size").orderBy(env), "the target exceeds the tasks")
    fresh = hash_rank(held.where("not _known"), env, key, seed).join(shares.select(env, "_more"), env)
    sft = held.where("_known").select(env, key, F.lit("known").alias("role")).unionByName(fresh.where("rank <= _more").select(env, key, F.lit("expansion").alias("role")))
    rest = fresh.where("rank > _more").select(env, key, F.lit("rollout").alias("pool"), F.lit("rollout").alias("role"))
    first = ranked(sft, [env], hash_key(f"{seed}:sft-smoke", env, key), [F.col(key)], "_rank")
    want = F.lit(0)
    for name, n in smoke.items():
        want = F.when(F.col(env) == name, n).otherwise(want)
    short = first.groupBy(env).agg(F.count("*").alias("n")).where(F.col("n") < want).select(env, "n")
    require_none(short.orderBy(env), "too few tasks for smoke")
    return sft.withColumn("pool", F.lit("sft")).select(env, key, "pool", "role").unionByName(first.where(F.col("_rank") < want).select(env, key, F.lit("sft_smoke").alias("pool"), "role")).unionByName(rest.select(env, key, "pool", "role"))


def cache_violations(entries: DataFrame, key: str, own: list[str], others: dict[str, str], run: str, run_id: Column) -> DataFrame:
    """(key, kind) of cache rows whose key isn't the hash of their own provenance (key), whose recorded
    values differ from what they should be (the name of the pair), or that another run wrote (run)."""
    digest = F.sha2(F.concat_ws("::", *[F.col(c).cast("string") for c in own]), 256)
    kinds = [F.when(~F.col(key).eqNullSafe(digest), "key"), *[F.when(~F.col(a).eqNullSafe(F.col(b)), a) for a, b in sorted(others.items())], F.when(~F.col(run).eqNullSafe(run_id), "run")]
    return entries.select(F.col(key).alias("key"), F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("kind"))


def task_keys(df: DataFrame, names: list[Column], env: Column, *, strict: bool = True) -> DataFrame:
    """Add task_key: the first of ``names`` that isn't null, after its environment where there is one.
    With ``strict``, a missing or repeated key is an error."""
    name = F.coalesce(*[n.cast("string") for n in names])
    held = df.withColumn("task_key", F.when(name.isNotNull(), F.concat_ws("::", env.cast("string"), name)))
    if strict:
        require_none(held.groupBy("task_key").agg(F.count("*").alias("n")).where("task_key is null or n > 1").orderBy("task_key"), "task keys are missing or repeated")
    return held


def reward_signals(df: DataFrame, reward: str, valid: str) -> DataFrame:
    """Add signal and invalid from text or number columns: a reward that is no finite number is 0 and
    invalid, a missing validity counts as valid, and one that is no number or 0 is invalid. Lists of one
    come unwrapped, as their element."""
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    value = number(reward)
    good = F.when(F.col(valid).isNull(), True).otherwise(F.coalesce(number(valid) != 0, F.lit(False)))
    return df.withColumns({"signal": F.when(finite(value), value).otherwise(0.0), "invalid": ~F.coalesce(finite(value), F.lit(False)) | ~good})


def length_events(df: DataFrame, key: str, phase: Column, values: dict[str, Column]) -> DataFrame:
    """(key, phase, name, value): one row for each length that is a number, in whole units."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), c.try_cast("double").cast("long").alias("value")) for n, c in sorted(values.items())])
    return df.select(key, phase.alias("phase"), F.explode(rows).alias("x")).select(key, "phase", "x.*").where("value is not null")
