"""Token rows as arrays: masks from exact prefixes and roles, training rows, log probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_length(full: Column, candidate: Column) -> Column:
    """The length of ``candidate`` if it is an exact prefix of ``full``, else null: no common prefix is
    sought, which would hide a template that differs."""
    return F.when(F.slice(full, F.lit(1), F.size(candidate)) == candidate, F.size(candidate))


def span_masks(full: Column, spans: Column) -> Column:
    """Struct (loss, reasoning, call) of 0/1 arrays over the tokens of ``full``.

    ``spans`` has one struct a message: trained (0/1), before (the ids up to it with the prompt for an
    answer), plain (without), thought (up to the end of its reasoning, null without one) and after. A
    message begins where ``before`` ends, or else ``plain``; what isn't an exact prefix is an error. Its
    thought's tokens are reasoning and the rest are the call's.
    """
    start = lambda s: F.coalesce(prefix_length(full, s["before"]), prefix_length(full, s["plain"]), F.raise_error("a message doesn't begin at an exact prefix").cast("int"))
    end = lambda s: F.coalesce(prefix_length(full, s["after"]), F.raise_error("a message doesn't end at an exact prefix").cast("int"))
    split = lambda s: F.coalesce(prefix_length(full, s["thought"]), F.lit(0))
    cuts = F.transform(F.filter(spans, lambda s: s["trained"] == 1), lambda s: F.struct(start(s).alias("start"), end(s).alias("end"), split(s).alias("thought")))

    def masks(at: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(full) - 1)
        over = lambda test: F.transform(F.filter(places, lambda i: i >= 0), lambda i: F.exists(at, lambda c: test(i, c)).cast("int"))
        inside = lambda i, c: (i >= c["start"]) & (i < c["end"])
        return F.struct(
            over(inside).alias("loss"),
            over(lambda i, c: inside(i, c) & (i < c["thought"])).alias("reasoning"),
            over(lambda i, c: inside(i, c) & (i >= c["thought"])).alias("call"),
        )

    none = F.array().cast("array<int>")
    return F.when(F.size(full) == 0, F.struct(none.alias("loss"), none.alias("reasoning"), none.alias("call"))).otherwise(F.transform(F.array(cuts), masks)[0])


def causal_shift(mask: Column) -> Column:
    """A mask over tokens as one over the places that predict them."""
    return F.slice(mask, F.lit(2), F.greatest(F.size(mask), F.lit(1)))


def collapse_runs(roles: Column, role: str = "tool") -> Column:
    """Adjacent entries of ``role`` as one."""
    return F.filter(roles, lambda x, i: (x != role) | (i == 0) | (F.coalesce(F.try_element_at(roles, i), F.lit("")) != role))


def mask_tool_turns(tokens: Column, attention: Column, roles: Column, end: int, role: str = "tool") -> Column:
    """``attention`` with 0 in the turns of ``role``: the n-th ``end`` token closes the n-th turn, where
    adjacent turns of ``role`` are one. Tokens after the last turn's end stay as they are."""
    turns = collapse_runs(roles, role)
    ends = F.filter(F.transform(tokens, lambda t, i: F.when(t == end, i)), lambda i: i.isNotNull())
    both = F.struct(turns.alias("turns"), ends.alias("ends"))

    def run(x: Column) -> Column:
        turn = lambda i: F.size(F.filter(x["ends"], lambda e: e < i))
        return F.transform(attention, lambda a, i: F.when((turn(i) < F.size(x["ends"])) & (F.coalesce(F.try_element_at(x["turns"], turn(i) + 1), F.lit("")) == role), 0).otherwise(a))

    return F.transform(F.array(both), run)[0]


def training_row(ids: Column, mask: Column, size: int, *, pad: int = 0, side: str = "error", dynamic: bool = False) -> Column:
    """Struct (input_ids, attention_mask, position_ids, loss_mask): cut to ``size`` on a side ('left' keeps
    the last tokens, 'right' the first; 'error' refuses) and, unless ``dynamic``, padded on the right."""
    over = F.size(ids) > size
    if side == "error":
        ids = F.when(over, F.raise_error(f"a row is longer than {size} tokens").cast("array<int>")).otherwise(ids)
        cut = lambda x: x
    elif side in ("left", "right"):
        cut = lambda x: F.when(F.size(x) > size, F.slice(x, F.size(x) - size + 1 if side == "left" else F.lit(1), F.lit(size))).otherwise(x)
    else:
        raise ValueError(side)
    more = lambda x, by: x if dynamic else F.concat(x, F.array_repeat(F.lit(by), F.greatest(F.lit(0), F.lit(size) - F.size(x))))
    shown = F.transform(cut(ids), lambda _: F.lit(1))
    attention = more(shown, 0)
    return F.struct(more(cut(ids), pad).alias("input_ids"), attention.alias("attention_mask"), F.transform(attention, lambda a, i: a * i).alias("position_ids"), more(cut(mask), 0).alias("loss_mask"))


def single_turn_mask(prompt: Column, response: Column, size: int) -> Column:
    """The loss mask of a prompt and its response in ``size`` places, right cut: 1 where the next token is
    of the response, so 0 for the first prompt - 1 places, for the last token and for padding."""
    last = F.least(prompt + response, F.lit(size)) - 1
    first = F.when(prompt > 1, F.least(prompt, F.lit(size)) - 1).otherwise(0)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((i >= first) & (i < last)).cast("int"))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))


def log_prob(logits: Column, label: Column) -> Column:
    """The log probability of the label (from 0) under a softmax."""
    return F.element_at(logits, label + 1) - log_sum_exp(logits)


def entropy(logits: Column) -> Column:
    """The entropy of a softmax: its log normaliser less the mean logit."""
    def run(z: Column) -> Column:
        return z - F.aggregate(F.transform(logits, lambda x: F.exp(x - z) * x), F.lit(0.0), lambda a, x: a + x)

    return F.transform(F.array(log_sum_exp(logits)), run)[0]
