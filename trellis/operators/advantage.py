"""Group-relative statistics of rewards: one row a rollout, a group of rollouts answers one prompt.

All are window expressions over the group, so a plan needs one shuffle on the group key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import scan

EPS = 1e-6


def _over(c: Column, group: str) -> Column:
    return c.over(W.partitionBy(group))


def finite(c: Column) -> Column:
    """Null and non-finite numbers are false."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def grpo(df: DataFrame, group: str, score: str, *, scale: bool = True, eps: float = EPS) -> DataFrame:
    """(s - mean) / (sample std + eps); a group of one has mean 0 and std 1. ``scale=False`` only centres."""
    n, mean, std = _over(F.count(score), group), _over(F.avg(score), group), _over(F.stddev_samp(score), group)
    centred = F.when(n == 1, F.col(score)).otherwise(F.col(score) - mean)
    return df.withColumn("advantage", centred / (F.when(n == 1, 1.0).otherwise(std) + eps) if scale else centred)


def terminal_grpo(df: DataFrame, group: str, score: str, valid: Column, *, eps: float = EPS) -> DataFrame:
    """Only valid finite rows make the mean and population std, and the others get 0; a lone valid row
    gets 0 as well."""
    ok = F.coalesce(valid, F.lit(True)) & finite(F.col(score))
    held = F.when(ok, F.col(score))
    n, mean, std = _over(F.count(held), group), _over(F.avg(held), group), _over(F.stddev_pop(held), group)
    return df.withColumn("advantage", F.when(ok, (F.col(score) - mean) / (F.when(n == 1, 1.0).otherwise(std) + eps)).otherwise(0.0))


def best_of_group(df: DataFrame, group: str, score: str, order: str, *, scale: bool = True, eps: float = EPS) -> DataFrame:
    """The best row (the first by ``order`` among equals) gets its lead over the second; others get 0.
    Groups of one are an error in the caller's data and give null."""
    w = W.partitionBy(group)
    by = w.orderBy(F.desc(score), F.asc(order))
    second = F.nth_value(score, 2).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    lead = F.max(score).over(w) - second
    lead = lead / (F.stddev_samp(score).over(w) + eps) if scale else lead
    return df.withColumn("advantage", F.when(F.count(score).over(w) < 2, None).when(F.row_number().over(by) == 1, lead).otherwise(0.0))


def leave_one_out(df: DataFrame, group: str, score: str) -> DataFrame:
    """s n/(n-1) - mean n/(n-1); a group of one is unchanged."""
    n, mean = _over(F.count(score), group), _over(F.avg(score), group)
    return df.withColumn("advantage", F.when(n > 1, (F.col(score) - mean) * n / F.greatest(n - 1, F.lit(1))).otherwise(F.col(score)))


def length_weighted(df: DataFrame, group: str, score: str, length: str) -> DataFrame:
    """s minus the length-weighted mean; a group of one has baseline 0."""
    base = _over(F.sum(F.col(length) * F.col(score)), group) / _over(F.sum(length), group)
    return df.withColumn("advantage", F.col(score) - F.when(_over(F.count("*"), group) > 1, base).otherwise(0.0))


def centred_whitened(df: DataFrame, group: str, score: str, *, eps: float = 1e-8) -> DataFrame:
    """Centred by group (a lone row by 0), then whitened over all rows. The global moments are one
    aggregate row, joined back by broadcast."""
    n, mean = _over(F.count(score), group), _over(F.avg(score), group)
    held = df.withColumn("_c", F.col(score) - F.when(n == 1, 0.0).otherwise(mean))
    moments = held.agg(F.avg("_c").alias("_m"), F.var_samp("_c").alias("_v"))
    return held.crossJoin(F.broadcast(moments)).withColumn("advantage", (F.col("_c") - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_c", "_m", "_v")


def by_component(df: DataFrame, group: str, components: list[str], *, eps: float = EPS) -> DataFrame:
    """Each component centred in its group over the population std of the total; the last component
    takes what the others leave of the total's advantage, so they sum to it exactly."""
    w = W.partitionBy(group)
    total = sum((F.col(c) for c in components[1:]), F.col(components[0]))
    held = df.withColumn("_t", total)
    std = F.when(F.count("*").over(w) == 1, 1.0).otherwise(F.stddev_pop("_t").over(w)) + eps
    held = held.withColumn("advantage", (F.col("_t") - F.avg("_t").over(w)) / std)
    for c in components[:-1]:
        held = held.withColumn(f"adv_{c}", (F.col(c) - F.avg(c).over(w)) / std)
    rest = F.col("advantage")
    for c in components[:-1]:
        rest = rest - F.col(f"adv_{c}")
    return held.withColumn(f"adv_{components[-1]}", rest).drop("_t")


def spread_reason(df: DataFrame, group: str, score: str, valid: Column, *, size: int, least: float = 5e-3, constant: float = 1e-6) -> DataFrame:
    """Add reason and kept: why a group teaches nothing, the gravest reason first. A group of fewer than
    ``size`` rows is incomplete, a larger one isn't. All rows of a useful group are kept, and the valid
    rows of one that is incomplete or partly invalid, for diagnostics."""
    w = W.partitionBy(group)
    ok = F.coalesce(valid, F.lit(True)) & finite(F.col(score))
    held = F.when(ok, F.col(score)).otherwise(0.0)
    spread = F.max(held).over(w) - F.min(held).over(w)
    reason = (
        F.when(F.count("*").over(w) < size, "incomplete_group")
        .when(~F.min(ok).over(w), "reward_invalid")
        .when(spread <= constant, "constant_reward")
        .when(spread + constant < least, "insufficient_reward_spread")
        .otherwise("useful")
    )
    return df.withColumn("reason", reason).withColumn("kept", (F.col("reason") == "useful") | (F.col("reason").isin("incomplete_group", "reward_invalid") & ok))


#: Named estimators, each DataFrame -> DataFrame; callers may add their own.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Add an estimator under a name; a name that is taken is an error."""

    def put(f: Callable[..., DataFrame]):
        if name in ESTIMATORS:
            raise ValueError(f"an estimator is named {name}")
        ESTIMATORS[name] = f
        return f

    return put


for _name, _f in {"grpo": grpo, "terminal_grpo": terminal_grpo, "passk": best_of_group, "rloo": leave_one_out, "opo": length_weighted, "reinforce_pp_baseline": centred_whitened, "components": by_component}.items():
    register(_name)(_f)


# ---------------------------------------------------------------- token recurrences, one row a token


def discounted_returns(df: DataFrame, record: str, pos: str, reward: str, mask: str, gamma: float) -> DataFrame:
    """Add return: from the end, r + gamma * the next one's, starting anew after a masked token (mask 0). One
    pass from the last token of a record to its first; null rewards count as 0, null masks as 1."""

    def step(run, r, m):
        now = (r or 0.0) + gamma * run
        return now * (1 if m is None else m), (now,)

    held = df.withColumns({"_r": F.col(reward).cast("double"), "_m": F.col(mask).cast("double")})
    return scan(held, [record], [pos], ["_r", "_m"], float, step, "`return` double", descending=True).drop("_r", "_m")


def gae(df: DataFrame, record: str, pos: str, reward: str, value: str, gamma: float, lam: float) -> DataFrame:
    """Add advantage A_t = delta_t + gamma * lam * A_(t+1), delta_t = r_t + gamma V_(t+1) - V_t, and return,
    A_t + V_t. One pass from the last token of a record to its first; nulls count as 0."""

    def step(state, r, v):
        run, after = state
        v = v or 0.0
        now = (r or 0.0) + gamma * after - v + gamma * lam * run
        return (now, v), (now, now + v)

    held = df.withColumns({"_r": F.col(reward).cast("double"), "_v": F.col(value).cast("double")})
    return scan(held, [record], [pos], ["_r", "_v"], lambda: (0.0, 0.0), step, "advantage double, `return` double", descending=True).drop("_r", "_v")


def kl_penalty(a: Column, b: Column, kind: str) -> Column:
    """Per-token estimate of KL from log probabilities of the policy (a) and the reference (b)."""
    return {
        "k1": a - b,
        "abs": F.abs(a - b),
        "k2": 0.5 * (a - b) * (a - b),
        "k3": F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(b - a) - (b - a) - 1.0)),
    }[kind]


def clipped_policy_loss(log_ratio: Column, adv: Column, *, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Per-token clipped loss; for negative advantages no more than ``dual`` times the advantage."""
    ratio = F.exp(log_ratio)
    loss = F.greatest(-adv * ratio, -adv * F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)))
    return F.when(adv < 0, F.least(loss, -adv * dual)).otherwise(loss)
