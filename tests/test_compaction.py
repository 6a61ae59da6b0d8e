"""Contexts against a plain walk over each episode's turns."""

import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import compaction

SPEC = "e string, t int, ev array<struct<choice:string,aspect:string,accepted:boolean,completed_aspect:boolean>>, n int, m int, removed0 int"


def walk(turns, base, most, reserve, target, next_turn):
    """What becomes of one episode: (attempted, success, after, cleaned), removed turns, cleanable turns."""
    groups, sure, named = [], True, []
    for t, ev, _, _ in turns:
        one = len(ev or []) == 1
        aspect = (ev[0][1] or "").strip() if one else ""
        named.append(aspect)
        sure = sure and one and aspect != ""
        if one and aspect and (ev[0][0] or "").lower() == "answer" and ev[0][2] and ev[0][3] and sure:
            groups.append((t, {turns[i][0] for i, a in enumerate(named) if a == aspect}))
    sizes = {t: n or 0 for t, _, n, _ in turns}
    memory = {t: m or 0 for t, _, _, m in turns}
    before = base + sum(sizes.values())
    if before + reserve <= most:
        return (False, False, before, 0), set(), {t for t, _ in groups}
    gone, kept, k, after = set(), 0, 0, before
    for k, (t, members) in enumerate(groups, 1):
        gone |= members
        kept += memory[t]
        after = before - sum(sizes[x] for x in gone) + kept
        safe, small = after + reserve <= most, after <= min(max(1, target), most)
        if (small and (safe or not next_turn)) or (safe and not next_turn):
            break
    ok = bool(groups) and (after + reserve <= most if next_turn else after <= most)
    return (True, ok, after if ok else before, k if ok else 0), gone if ok else set(), {t for t, _ in groups}


@pytest.mark.parametrize("next_turn", [True, False])
def test_random_episodes(spark, next_turn):
    draw = random.Random(5)
    episodes = {}
    for e in range(120):
        turns = []
        for t in range(draw.randint(1, 14)):
            event = (draw.choice(["answer", "Answer", "action", None]), draw.choice(["a", "b", " c "] + ["", None] * (draw.random() < 0.1)), draw.random() < 0.9, draw.choice([True, True, None]))
            turns.append((t * 2, draw.choice([[event]] * 30 + [[event, event], [], None]), draw.choice([10, 60, 200, None]), draw.choice([5, 20, None])))
        episodes[f"e{e}"] = turns
    limits = {"base": 40, "most": 700, "reserve": 80, "target": 450, "next_turn": next_turn}
    df = spark.createDataFrame([(e, *t, 0) for e, v in episodes.items() for t in v], SPEC).repartition(4)
    turns, whole = compaction.compacted(df, "e", "t", "ev", "n", "m", **limits)
    got = {r.e: r for r in whole.collect()}
    removed, cleanable = {}, {}
    for r in turns.collect():
        removed.setdefault(r.e, set()).update({r.t} if r.removed else ())
        cleanable.setdefault(r.e, set()).update({r.t} if r.cleanable else ())
    seen = set()
    for e, v in episodes.items():
        want, gone, clean = walk(v, **limits)
        r = got[e]
        assert (r.attempted, r.success, r.after, r.n_cleaned) == want and removed[e] == gone and cleanable[e] == clean
        assert r.failure == (None if not want[0] or want[1] else "still_unsafe" if clean else "no_completed_aspect_history")
        seen.add((want[:2], r.failure))
    assert len(seen) == 4


def test_empty_and_null_episodes(spark):
    turns, whole = compaction.compacted(spark.createDataFrame([], SPEC), "e", "t", "ev", "n", "m", base=1, most=1, reserve=1, target=1)
    assert turns.collect() == [] and whole.collect() == []
    df = spark.createDataFrame([(None, 0, [("answer", "a", True, True)], 50, 5, 0)], SPEC)
    turns, whole = compaction.compacted(df, "e", "t", "ev", "n", "m", base=1, most=30, reserve=1, target=20)
    assert [r.removed for r in turns.collect()] == [True] and [tuple(r) for r in whole.collect()] == [(None, True, True, 51, 6, 45, 1, 5, None)]


def test_boundaries(spark):
    cases = [([5, 0, 5, -3, 9, 10], 10, [0, 5, 9]), ([], 4, [0]), (None, 4, [0]), ([7], 4, [0]), ([1, None], 4, [1]), ([0], 0, []), (None, 0, [])]
    df = spark.createDataFrame(cases, "s array<int>, n int, want array<int>")
    assert [r[0] for r in df.select(compaction.boundaries(F.col("s"), F.col("n"))).collect()] == [w for *_, w in cases]
