"""Making room in a context: whole groups of turns on completed aspects give way to short memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def turn_records(turns: DataFrame, episode: str, turn: str, events: str) -> DataFrame:
    """Add aspect, cleanable, blocked and owner to turns with an array of events (choice, aspect, accepted,
    completed_aspect).

    A turn closes an aspect if its only event is an accepted answer that completed it. It is cleanable if
    also every turn up to it has exactly one event, on a named aspect; otherwise it is blocked, since
    nobody knows whose turns those are. owner is the first cleanable turn on the same aspect at or after
    a turn: the turn that may be removed with it. Null events count as none, a null flag as false.
    """
    few = F.coalesce(F.size(events), F.lit(0)) == 1
    event = F.when(few, F.element_at(events, 1))
    named = F.coalesce(F.trim(event["aspect"]), F.lit(""))
    closes = few & (named != "") & F.coalesce((F.lower(event["choice"]) == "answer") & event["accepted"] & event["completed_aspect"], F.lit(False))
    upto = W.partitionBy(episode).orderBy(turn).rowsBetween(W.unboundedPreceding, 0)
    held = turns.withColumns({"aspect": named, "_closes": closes, "_sure": F.min(few & (named != "")).over(upto)})
    held = held.withColumns({"cleanable": F.col("_closes") & F.col("_sure"), "blocked": F.col("_closes") & ~F.col("_sure")})
    later = W.partitionBy(episode, "aspect").orderBy(F.desc(turn)).rowsBetween(W.unboundedPreceding, 0)
    return held.withColumn("owner", F.when(F.col("aspect") != "", F.min(F.when(F.col("cleanable"), F.col(turn))).over(later))).drop("_closes", "_sure")


def compacted(turns: DataFrame, episode: str, turn: str, events: str, length: str, memory: str, *, base: int, most: int, reserve: int, target: int, next_turn: bool = True) -> tuple[DataFrame, DataFrame]:
    """(turns, episodes). An episode whose context and ``reserve`` don't fit ``most`` gives up groups of turns on
    completed aspects, whole and in order of completion, until the context is at ``target`` or below and
    (with ``next_turn``) the reserve fits. If all of them aren't enough, nothing is removed.

    ``length`` is a turn's size, ``memory`` the size of what stands for the group that a turn closes,
    ``base`` the size of what always stays. Turns are those of ``turn_records`` with removed; episodes have
    attempted, success, before, after, released, n_cleaned, memory and failure: no_completed_aspect_history,
    still_unsafe or null. Sizes that are null count as 0. Only sums over groups are compared, so an
    episode is never one array.
    """
    held = turn_records(turns, episode, turn, events).withColumns({"_len": F.coalesce(F.col(length), F.lit(0)).cast("long"), "_mem": F.coalesce(F.col(memory), F.lit(0)).cast("long")})
    limit = min(max(1, target), most)
    whole = held.groupBy(F.col(episode).alias("_e")).agg((F.sum("_len") + base).alias("before"))
    groups = held.where("owner is not null").groupBy(F.col(episode).alias("_e"), F.col("owner").alias("_owner")).agg(F.sum("_len").alias("_freed"), F.max(F.when(F.col(turn) == F.col("owner"), F.col("_mem"))).alias("_memory"))
    order = W.partitionBy("_e").orderBy("_owner").rowsBetween(W.unboundedPreceding, 0)
    steps = groups.withColumns({"_n": F.count("*").over(order), "_net": F.sum(F.col("_freed") - F.col("_memory")).over(order), "_kept": F.sum("_memory").over(order)})
    steps = _by_episode(steps, whole, "inner")
    after = F.col("before") - F.col("_net")
    safe, small = after + reserve <= most, after <= limit
    enough = small & safe if next_turn else small | safe
    steps = steps.withColumns({"_after": after, "_enough": enough, "_fits": safe if next_turn else after <= most})
    pick = F.struct("_n", "_owner", "_after", "_kept", "_fits")
    best = steps.groupBy("_e").agg(F.coalesce(F.min(F.when(F.col("_enough"), pick)), F.max(pick)).alias("_p"))
    out = _by_episode(whole, best).withColumn("attempted", F.col("before") + reserve > most)
    out = out.withColumn("success", F.col("attempted") & F.coalesce(F.col("_p._fits"), F.lit(False)))
    done = lambda x, instead: F.when(F.col("success"), x).otherwise(instead)
    failure = F.when(F.col("attempted") & F.col("_p").isNull(), "no_completed_aspect_history").when(F.col("attempted") & ~F.col("success"), "still_unsafe")
    out = out.withColumns({"after": done(F.col("_p._after"), F.col("before")), "n_cleaned": done(F.col("_p._n"), F.lit(0)), "memory": done(F.col("_p._kept"), F.lit(0)), "failure": failure, "_upto": F.when(F.col("success"), F.col("_p._owner"))})
    out = out.withColumn("released", F.greatest(F.col("before") - F.col("after"), F.lit(0)))
    cut = out.select("_e", "_upto")
    held = held.join(cut, F.col(episode).eqNullSafe(F.col("_e"))).withColumn("removed", F.coalesce(F.col("owner") <= F.col("_upto"), F.lit(False))).drop("_e", "_upto", "_len", "_mem")
    return held, out.select(F.col("_e").alias(episode), "attempted", "success", "before", "after", "released", "n_cleaned", "memory", "failure")


def _by_episode(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    right = right.withColumnRenamed("_e", "_b")
    return left.join(right, F.col("_e").eqNullSafe(F.col("_b")), how).drop("_b")


def boundaries(starts: Column, length: Column) -> Column:
    """Where the turns of a fragment of ``length`` tokens begin: ``starts`` sorted, each once, those below 0 at 0
    and those at or beyond the end left out; 0 alone where none is left, and none in an empty fragment.
    Null starts and null entries count as none."""
    inside = F.filter(F.coalesce(starts, F.array().cast("array<int>")), lambda x: x < length)
    held = F.array_sort(F.array_distinct(F.transform(inside, lambda x: F.greatest(F.lit(0), x).cast("int"))))
    return F.when(length <= 0, F.array().cast("array<int>")).when(F.size(held) == 0, F.array(F.lit(0))).otherwise(held)
