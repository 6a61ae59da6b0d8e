"""Credit over turns and tokens, the terminal reward, and checks that sums are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a turn's choice weighs.
CHOICE_WEIGHTS = {"search": 0.25, "action": 0.45, "answer": 0.30}
OTHER_WEIGHT = 1.0
#: Weights of the terminal reward's parts and what they are divided by.
REWARD_WEIGHTS = {"correct": 3.00, "quality": 0.30, "legal": 0.20, "hidden": 0.15, "efficiency": 0.05}
REWARD_SCALE = 3.70


def choice_weight(choice: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, w in CHOICE_WEIGHTS.items():
        out = F.when(choice == name, w).otherwise(out)
    return out


def redistribute(df: DataFrame, row: str, advantage: str, tokens: str, weight: Column) -> DataFrame:
    """Add token_credit, the credit of each token of a turn: the row's advantage times its tokens,
    shared over turns by weight and over a turn's tokens evenly, so the row's sum is kept."""
    w = W.partitionBy(row)
    held = df.withColumn("_w", weight)
    total = F.sum(F.col(advantage) * F.col(tokens)).over(w)
    return held.withColumn("token_credit", F.try_divide(total * F.col("_w") / F.sum("_w").over(w), F.col(tokens))).drop("_w")


def conserve(df: DataFrame, row: str, value: str, target: str, order: str) -> DataFrame:
    """Put what a row's values miss of its target on the value of least size (the first among equals)."""
    w = W.partitionBy(row)
    first = F.row_number().over(w.orderBy(F.abs(value), order)) == 1
    return df.withColumn(value, F.when(first, F.col(value) + F.col(target) - F.sum(value).over(w)).otherwise(F.col(value)))


def conservation(df: DataFrame, row: str, before: str, after: str) -> DataFrame:
    """Per row: error of the sum, and that relative to the larger L1 (1 at least)."""
    out = df.groupBy(row).agg(F.sum(before).alias("_b"), F.sum(after).alias("_a"), F.sum(F.abs(before)).alias("_lb"), F.sum(F.abs(after)).alias("_la"))
    return out.select(row, F.abs(F.col("_b") - F.col("_a")).alias("error"), (F.abs(F.col("_b") - F.col("_a")) / F.greatest(F.lit(1.0), "_lb", "_la")).alias("relative_error"))


def terminal_reward(c: dict[str, Column]) -> dict[str, Column]:
    """Parts and total of the terminal reward from counts: total (aspects), answered, correct, best,
    legal, elicited, prefs, steps, max_steps, invalid, wrong, plan_errors, redundant, reason, valid."""
    share = lambda x: F.coalesce(F.try_divide(x, c["total"]), F.lit(0.0))
    parts = {
        "correct": share(c["correct"]),
        "quality": share(c["best"]),
        "legal": share(c["legal"]),
        "hidden": F.when(c["prefs"] == 0, 1.0).otherwise(F.coalesce(F.try_divide(c["elicited"], c["prefs"]), F.lit(0.0))),
        "efficiency": F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.coalesce(F.try_divide(c["steps"], c["max_steps"]), F.lit(1.0)))),
    }
    coverage = share(c["answered"])
    policy = F.least(F.lit(1.0), 0.05 * c["invalid"] + 0.10 * c["wrong"] + F.least(F.lit(0.60), 0.05 * c["plan_errors"]))
    redundant = F.least(F.lit(0.60), 0.05 * F.least(F.lit(3), c["redundant"]) + 0.10 * F.greatest(F.lit(0), c["redundant"] - 3))
    penalty = policy + redundant + (1 - coverage) + F.when((c["total"] > 0) & (c["answered"] == 0), 0.5).otherwise(0.0) + F.when(c["reason"] == "max_steps", 0.75).otherwise(0.0)
    total = -penalty
    for name, w in REWARD_WEIGHTS.items():
        total = total + w * parts[name]
    reward = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / REWARD_SCALE))
    return parts | {"coverage": coverage, "penalty": penalty, "reward": F.when(F.coalesce(c["valid"], F.lit(True)), reward).otherwise(0.0)}


def masked_moments(df: DataFrame, value: str, mask: str, group: list[str]) -> DataFrame:
    """Masked sum, mean (over the mask's sum + 1e-8) and Bessel variance (null under two values) for masks
    of 0 and 1; the variance is updated around running means, so that it doesn't cancel."""
    m, v = F.col(mask), F.col(value)
    n, total = F.sum(m), F.sum(v * m)
    return df.groupBy(*group).agg(n.alias("n"), total.alias("masked_sum"), (total / (n + 1e-8)).alias("masked_mean"), F.when(n > 1, F.var_samp(F.when(m > 0, v))).alias("masked_var"))


def aggregate_loss(df: DataFrame, row: str, loss: str, mask: str, mode: str, horizon: float = 1.0) -> DataFrame:
    """One loss from token losses: token-mean, seq-mean-token-sum, seq-mean-token-mean or
    seq-mean-token-sum-norm (sums over ``horizon``)."""
    rows = df.groupBy(row).agg(F.sum(F.col(loss) * F.col(mask)).alias("s"), F.sum(mask).alias("n"))
    out = {
        "token-mean": F.try_divide(F.sum("s"), F.sum("n")),
        "seq-mean-token-sum": F.avg("s"),
        "seq-mean-token-mean": F.avg(F.try_divide(F.col("s"), F.col("n"))),
        "seq-mean-token-sum-norm": F.sum("s") / horizon,
    }[mode]
    return rows.agg(out.alias("loss"))


def mixed_component_credit(df: DataFrame, row: str, turn: str, advantage: str, components: dict[str, tuple[str, Column]], *, mix: float = 0.30) -> DataFrame:
    """Add turn_credit over the turns of a row: (1 - mix) of the row's advantage spread evenly, and mix
    of each component (column of its value, weight of a turn) spread over the turns that caused it; a
    component that no turn caused is spread evenly. What the parts miss of the row's advantage goes
    evenly to all turns, so its sum is kept."""
    w = W.partitionBy(row)
    n = F.count("*").over(w)
    credit = (1 - mix) * F.col(advantage) / n
    for value, weight in components.values():
        total = F.sum(weight).over(w)
        credit = credit + mix * F.col(value) * F.when(total > 0, weight / total).otherwise(1 / n)
    held = df.withColumn("_c", credit)
    return held.withColumn("turn_credit", F.col("_c") + (F.col(advantage) - F.sum("_c").over(w)) / n).drop("_c")


#: Components whose gains go to the answers that a flag marks, and the shares of the search
#: that opened the aspect, of the actions that helped, and of the answer.
ANSWER_ROUTES = {
    "correct_completion": ("correct_answer", (0.15, 0.25, 0.60)),
    "coverage_adjusted_answer_quality": ("best_answer", (0.10, 0.35, 0.55)),
    "coverage_adjusted_legal_chain_rate": ("legal_answer", (0.25, 0.35, 0.40)),
}
#: Penalties for what a rollout left undone, and the share that its last turn bears.
ENDING, LAST_SHARE = ("incomplete_penalty", "zero_answer_penalty", "max_steps_penalty"), 0.30


def _shares(weights: Column) -> Column:
    """Weights over their sum; all zero where there is none."""
    def run(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        return F.transform(w, lambda x: F.when(total > 0, x / total).otherwise(0.0))

    return F.transform(F.array(F.transform(weights, lambda x: F.greatest(F.lit(0.0), x.cast("double")))), run)[0]


def _answer_chain(events: Column, flag: str, split: tuple[float, float, float]) -> Column:
    """For each answer that ``flag`` marks: a share to the first search of its aspect before it, one over
    the useful actions on it before it, and one to itself, with the shares that have no turn."""
    search, action, answer = split
    numbered = F.transform(events, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    answers = F.filter(numbered, lambda x: x["e"][flag])

    def routed(a: Column) -> Column:
        before = lambda mark: F.transform(F.filter(numbered, lambda x: (x["i"] < a["i"]) & (x["e"]["aspect"] == a["e"]["aspect"]) & x["e"][mark]), lambda x: x["i"])
        return F.struct(a["i"].alias("i"), F.coalesce(F.array_min(before("new_search")), a["i"]).alias("search"), before("useful_action").alias("actions"))

    def weights(chains: Column) -> Column:
        def of(c: Column, i: Column) -> Column:
            helped = F.when(F.size(c["actions"]) > 0, F.when(F.array_contains(c["actions"], i), action / F.size(c["actions"])).otherwise(0.0)).otherwise(F.when(c["i"] == i, action).otherwise(0.0))
            return F.when(c["search"] == i, search).otherwise(0.0) + helped + F.when(c["i"] == i, answer).otherwise(0.0)

        return F.transform(events, lambda _, i: F.aggregate(chains, F.lit(0.0), lambda acc, c: acc + of(c, i)))

    return F.transform(F.array(F.transform(answers, routed)), weights)[0]


def route(component: str, value: Column, events: Column, routes: dict[str, tuple[float, float, float]] | None = None) -> Column:
    """Weights over a rollout's turns, summing to 1, by which turn caused a component of its advantage.

    ``events`` has one struct a turn: aspect, accepted, new_search, useful_action, new_preference_count,
    no_gain_action, duplicate_action, redundant_action, invalid_call, completed_aspect, correct_answer,
    best_answer, legal_answer, wrong_answer. Gains of answers go down the chain that led to them; losses
    go to the turns that wasted something, weighted by how; what nothing explains goes to the turns
    that made progress, or to all, or, if a loss, to the last. No turns give an empty array.
    """
    n = F.size(events)
    one = lambda test: F.transform(events, lambda e: F.when(F.coalesce(test(e), F.lit(False)), 1.0).otherwise(0.0))
    some = lambda w: F.exists(w, lambda x: x > 0)
    last = F.transform(events, lambda _, i: F.when(i == n - 1, 1.0).otherwise(0.0))
    loss = value < 0
    again = lambda e: e["redundant_action"] | e["duplicate_action"]
    offends = lambda e: e["invalid_call"] | e["wrong_answer"]
    wasted = F.transform(events, lambda e: F.when(offends(e), 1.0).otherwise(0.0) + F.when(again(e), 1.0).otherwise(0.0) + F.when(e["no_gain_action"] & ~again(e), 0.5).otherwise(0.0))
    progress = one(lambda e: e["accepted"] & (e["new_search"] | e["useful_action"] | e["completed_aspect"]))
    forward = F.when(some(progress), progress).otherwise(F.transform(events, lambda _: F.lit(1.0)))
    blamed = F.when(some(wasted), wasted).otherwise(last)
    out = F.when(loss, blamed).otherwise(forward)
    if component in ANSWER_ROUTES:
        flag, split = ANSWER_ROUTES[component]
        chain = _answer_chain(events, flag, (routes or {}).get(component, split))
        out = F.when(~loss & some(chain), chain).otherwise(out)
    elif component == "hidden_preference_hit_rate":
        useful = F.transform(events, lambda e: F.when(e["useful_action"], F.greatest(F.lit(1.0), F.coalesce(e["new_preference_count"], F.lit(0)).cast("double"))).otherwise(0.0))
        out = F.when(some(useful), useful).otherwise(out)
    elif component == "policy_penalty":
        guilty = F.transform(events, lambda e: F.when(e["wrong_answer"], 2.0).when(e["invalid_call"], 1.0).otherwise(0.0))
        out = F.when(loss & some(guilty), guilty).otherwise(out)
    elif component == "redundant_action_penalty":
        out = F.when(loss & some(one(again)), one(again)).otherwise(out)
    elif component in ENDING:
        count = F.size(F.filter(wasted, lambda x: x > 0))
        ends = F.when(count > 0, F.transform(F.arrays_zip(wasted.alias("w"), last.alias("l")), lambda x: F.when(x["w"] > 0, (1 - LAST_SHARE) / count).otherwise(0.0) + LAST_SHARE * x["l"])).otherwise(last)
        done = one(lambda e: e["completed_aspect"])
        out = F.when(loss, ends).when(some(done), done).otherwise(progress)
    elif component == "clip_residual":
        out = last
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(_shares(out))


def equal_credits(history: Column, reward: Column) -> Column:
    """Struct (credits, reward): 1 for every turn, and the last terminal reward that is told, else 0."""
    told = F.filter(reward, lambda r: r.isNotNull())
    return F.struct(F.transform(history, lambda _: F.lit(1.0)).alias("credits"), F.coalesce(F.try_element_at(told, F.lit(-1)).cast("double"), F.lit(0.0)).alias("reward"))
