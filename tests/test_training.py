"""Gates, masks, routed credit, graded answers, scorers and table rewrites."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from trellis.functions import grading, messages, scorers, tokens
from trellis.operators import credit, gates
from trellis.sources import io


def test_pools(spark):
    rows = spark.createDataFrame([("sft", "a"), ("sft", "a"), ("sft", "b"), ("validation", "b"), ("smoke", "c"), ("smoke", "d"), ("validation", "d"), ("sft", "opaque::x"), ("sft", "e")], "pool string, key string")
    bad = gates.pool_violations(rows, "pool", "key", disjoint=["sft", "validation"], parents={"smoke": "validation"})
    assert sorted((r.kind, r.key) for r in bad.collect()) == [("duplicate", "a"), ("opaque", "opaque::x"), ("outside_parent", "c"), ("overlap", "b")]
    with pytest.raises(gates.Broken, match="pools"):
        gates.require_none(bad, "pools")
    gates.require_none(bad.where("kind = 'none'"), "pools")


def test_stages(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 1.0, 1.5), ("b", 2.0, 2.0)], "row string, x double, y double")
    off, _ = gates.stage_gate(df, "row", "x", "y", "off")
    shadow, said = gates.stage_gate(df, "row", "x", "y", "shadow")
    train, done = gates.stage_gate(df, "row", "x", "y", "train")
    assert sorted(r.advantage for r in off.collect()) == sorted(r.advantage for r in shadow.collect()) == [1.0, 1.0, 2.0]
    assert sorted(r.advantage for r in train.collect()) == [0.5, 1.5, 2.0] and done["applied"] and not said["applied"] and said["absolute"] == 0
    for change, what in ((F.col("y") + 0.1, "sums"), (F.lit(math.nan), "sums")):
        with pytest.raises(gates.Broken, match=what):
            gates.stage_gate(df.withColumn("y", change), "row", "x", "y", "train")
        assert not gates.stage_gate(df.withColumn("y", change), "row", "x", "y", "shadow")[1]["applied"]
    with pytest.raises(gates.Broken, match="miss"):
        gates.stage_gate(df, "row", "x", "y", "train", missing=F.col("row") == "b")
    for args in ({"stage": "on"}, {"stage": "train", "atol": -1.0}):
        with pytest.raises(gates.Broken):
            gates.stage_gate(df, "row", "x", "y", **args)


def test_training_pools_refuse(spark):
    tasks = spark.createDataFrame([("e", i, "train") for i in range(10)] + [("f", i, "train") for i in range(10)] + [("e", 99, "test")], "env string, key long, split string")
    known = spark.createDataFrame([("e", i) for i in range(6)], "env string, key long")
    args = {"env": "env", "key": "key", "split": "split", "known": known, "seed": 1}
    with pytest.raises(gates.Broken, match="known"):
        gates.training_pools(tasks, target=8, smoke={}, **args)
    with pytest.raises(gates.Broken, match="exceeds"):
        gates.training_pools(tasks, target=22, smoke={}, **args)
    with pytest.raises(gates.Broken, match="smoke"):
        gates.training_pools(tasks, target=14, smoke={"f": 9}, **args)
    rows = gates.training_pools(tasks, target=14, smoke={"f": 2}, **args).collect()
    assert sum(r.pool == "sft" for r in rows) == 14 and sum(r.pool == "rollout" for r in rows) == 6 and sum(r.pool == "sft_smoke" for r in rows) == 2 and all(r.key != 99 for r in rows)


def test_task_keys(spark):
    df = spark.createDataFrame([("e", "1", None), (None, None, "2")], "env string, a string, b string")
    names = [F.col("a"), F.col("b")]
    assert sorted(r.task_key for r in gates.task_keys(df, names, F.col("env")).collect()) == ["2", "e::1"]
    with pytest.raises(gates.Broken):
        gates.task_keys(df.union(df), names, F.col("env"))
    with pytest.raises(gates.Broken):
        gates.task_keys(df, names[:1], F.col("env"))


def test_masks(spark):
    span = "array<struct<trained:int,before:array<int>,plain:array<int>,thought:array<int>,after:array<int>>>"
    rows = [([1, 2, 3, 4, 5], [(1, [1, 2], [1], None, [1, 2, 3, 4]), (0, [9], [9], [9], [9])]), ([], [])]
    df = spark.createDataFrame(rows, f"t array<int>, s {span}")
    got = [r.m.asDict() for r in df.select(tokens.span_masks(F.col("t"), F.col("s")).alias("m")).collect()]
    assert got == [{"loss": [0, 0, 1, 1, 0], "reasoning": [0] * 5, "call": [0, 0, 1, 1, 0]}, {"loss": [], "reasoning": [], "call": []}]
    for wrong in ((1, [7], [7], None, [1]), (1, [1], [1], None, [1, 9])):
        with pytest.raises(Exception, match="exact prefix"):
            spark.createDataFrame([([1, 2], [wrong])], f"t array<int>, s {span}").select(tokens.span_masks(F.col("t"), F.col("s"))).collect()
    r = spark.createDataFrame([([5, 2, 6, 6, 2, 7, 2, 8], ["assistant", "tool", "tool", "assistant"])], "t array<int>, r array<string>")
    r = r.select(tokens.collapse_runs(F.col("r")).alias("c"), tokens.mask_tool_turns(F.col("t"), F.transform("t", lambda _: F.lit(1)), F.col("r"), 2).alias("m"), tokens.causal_shift(F.col("t")).alias("s")).first()
    assert (r.c, r.m, r.s) == (["assistant", "tool", "assistant"], [1, 1, 0, 0, 0, 1, 1, 1], [2, 6, 6, 2, 7, 2, 8])


def test_training_row(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 1, 1])], "t array<int>, m array<int>")
    of = lambda **k: df.select(tokens.training_row(F.col("t"), F.col("m"), **k).alias("r")).first().r
    assert tuple(of(size=5, pad=9)) == ([1, 2, 3, 9, 9], [1, 1, 1, 0, 0], [0, 1, 2, 0, 0], [0, 1, 1, 0, 0])
    assert tuple(of(size=2, side="left")) == ([2, 3], [1, 1], [0, 1], [1, 1]) and tuple(of(size=2, side="right"))[0] == [1, 2]
    assert tuple(of(size=5, dynamic=True))[0] == [1, 2, 3]
    with pytest.raises(Exception, match="longer than 2"):
        of(size=2)
    one = lambda p, r, n: spark.range(1).select(tokens.single_turn_mask(F.lit(p), F.lit(r), n).alias("m")).first().m
    assert one(3, 2, 7) == [0, 0, 1, 1, 0, 0, 0] and one(3, 9, 5) == [0, 0, 1, 1, 0] and one(1, 1, 2) == [1, 0]


FLAGS = ("accepted", "new_search", "useful_action", "no_gain_action", "duplicate_action", "redundant_action", "invalid_call", "completed_aspect", "correct_answer", "best_answer", "legal_answer", "wrong_answer")


def routed(name, value, events):
    """The same rules on plain rows."""
    n = len(events)
    share = lambda w: [x / sum(w) for x in w] if sum(w) > 0 else [0.0] * n
    again = [e["redundant_action"] or e["duplicate_action"] for e in events]
    wasted = [(e["invalid_call"] or e["wrong_answer"]) + a + (0.5 if e["no_gain_action"] and not a else 0) for e, a in zip(events, again, strict=True)]
    progress = [float(e["accepted"] and (e["new_search"] or e["useful_action"] or e["completed_aspect"])) for e in events]
    last = [float(i == n - 1) for i in range(n)]
    if name in credit.ANSWER_ROUTES and value >= 0:
        flag, (s, a, w) = credit.ANSWER_ROUTES[name]
        out = [0.0] * n
        for j in (j for j in range(n) if events[j][flag]):
            mine = [i for i in range(j) if events[i]["aspect"] == events[j]["aspect"]]
            searches, actions = [i for i in mine if events[i]["new_search"]], [i for i in mine if events[i]["useful_action"]]
            out[searches[0] if searches else j] += s
            for i in actions or [j]:
                out[i] += a / max(len(actions), 1)
            out[j] += w
        if any(out):
            return share(out)
    if name == "hidden_preference_hit_rate" and any(e["useful_action"] for e in events):
        return share([max(1.0, e["new_preference_count"]) * e["useful_action"] for e in events])
    if name == "policy_penalty" and value < 0 and any(e["invalid_call"] or e["wrong_answer"] for e in events):
        return share([2.0 if e["wrong_answer"] else float(e["invalid_call"]) for e in events])
    if name == "redundant_action_penalty" and value < 0 and any(again):
        return share([float(a) for a in again])
    if name in credit.ENDING:
        if value < 0:
            guilty = [i for i in range(n) if wasted[i] > 0]
            return share([(0.7 / len(guilty) if i in guilty else 0.0) + 0.3 * last[i] for i in range(n)]) if guilty else last
        done = [float(e["completed_aspect"]) for e in events]
        return share(done if any(done) else progress)
    if name == "clip_residual":
        return last
    if value < 0:
        return share(wasted) if any(wasted) else last
    return share(progress if any(progress) else [1.0] * n)


def test_routes_against_plain_rules(spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        events = [{f: rng.random() < 0.25 for f in FLAGS} | {"aspect": rng.choice("ab"), "new_preference_count": rng.randrange(4)} for _ in range(rng.randrange(1, 7))]
        rows.append((i, rng.choice([-1.0, 0.0, 2.0]), events))
    spec = "struct<" + ",".join(f"{f}:boolean" for f in FLAGS) + ",aspect:string,new_preference_count:int>"
    df = spark.createDataFrame(rows, f"i int, v double, e array<{spec}>")
    for name in [*credit.ANSWER_ROUTES, *credit.ENDING, "hidden_preference_hit_rate", "policy_penalty", "redundant_action_penalty", "clip_residual", "other"]:
        got = {r.i: r.w for r in df.select("i", credit.route(name, F.col("v"), F.col("e")).alias("w")).collect()}
        for i, v, events in rows:
            assert got[i] == pytest.approx(routed(name, v, events)), (name, v, events)
    assert df.limit(1).select(credit.route("other", F.col("v"), F.filter("e", lambda _: F.lit(False))).alias("w")).first().w == []


def test_graded(spark):
    right = [("12 hours", "12"), ("\\text{1,200}", "1200"), ("3 million", "3*10^6"), ("$5", "5.0"), ("(1, 2/3)", "(1,2/3)"), ("\\begin{pmatrix} 1 & 2 \\\\ 3 & 4 \\end{pmatrix}", "\\begin{bmatrix}1&2.0\\\\3&4\\end{bmatrix}"), ("A or B", "a , b"), ("50\\%", "0.5"), ("7 3/4", "7+3/4"), ("{-  4}", "-4")]
    wrong = [("12", "13"), ("", ""), (None, "1"), ("(1, 2/4)", "(1,1/2)"), ("(1,2]", "(1,2)"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}"), ("3 million", "3*10^9"), ("(1.5,2)", "(1,2)")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(right + wrong)], "i int, a string, b string")
    got = {r.i: r.x for r in df.select("i", grading.graded(F.col("a"), F.col("b")).alias("x")).collect()}
    assert [i for i in range(len(right)) if not got[i]] == [] and [i for i in range(len(right), len(right + wrong)) if got[i]] == []
    t = spark.createDataFrame([("I think\nAnswer: 3\nso the answer is 42.",), ("Answer: none",), (None,)], "t string")
    assert [r.x for r in t.select(grading.marked_answer(F.col("t")).alias("x")).collect()] == ["42", None, None]


def test_scorers(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "xyz"), ("c", "slow"), ("d", None)], "s string, t string").coalesce(1)
    calls = scorers.batched(lambda s, t: [float(len(x or "")) for x in t])
    assert [r.x for r in df.select(calls(F.col("s"), F.col("t")).alias("x")).collect()] == [1.0, 3.0, 4.0, 0.0]
    with pytest.raises(Exception, match="scores for"):
        df.select(scorers.batched(lambda s: [1.0])(F.col("s"))).collect()

    def one(text):
        if text == "slow":
            time.sleep(20)
        return {1: 0.5, 3: math.inf}[len(text)]

    assert [r.x for r in df.select(scorers.guarded(one, timeout=0.3)(F.col("t")).alias("x")).collect()] == [0.5, 0.0, 0.0, 0.0]
    assert scorers.register("t.len")(F.length) is F.length and scorers.scorer("t.len") is F.length
    with pytest.raises(ValueError):
        scorers.register("t.len")(F.upper)
    with pytest.raises(ValueError):
        scorers.scorer("none")
    assert [r.x for r in df.select(scorers.dispatch(F.col("s"), {"a": "t.len", "b": "t.len"}, F.col("t")).alias("x")).collect()] == [1.0, 3.0, None, None]


def test_public_texts(spark):
    old = json.dumps([{"name": messages.TOOL_NAME, "parameters": {"properties": {"choice": {"description": "reward"}}}}, {"name": "other"}])
    df = spark.createDataFrame([(old,), ("{",), (None,), ("3",)], "t string")
    got = [r.x for r in df.select(messages.public_tools(F.col("t")).alias("x")).collect()]
    tool = json.loads(got[0])[0]
    assert tool["description"] == messages.TOOL_SAYS and tool["parameters"]["properties"]["choice"]["description"] == messages.CHOICE_SAYS and json.loads(got[0])[1] == {"name": "other"} and got[1:] == ["{", None, "3"]
    assert messages.tool_schema()[0]["function"]["parameters"]["required"] == ["choice", "content"]
    r = spark.createDataFrame([(" hi \n\nPublic control: x", [("ab", None), (None, "c")])], "t string, m array<struct<content:string,reasoning_content:string>>")
    r = r.select(messages.public_reply(F.col("t")).alias("a"), messages.trajectory_chars(F.col("m")).alias("b"), credit.equal_credits(F.col("m"), F.array(F.lit(1.0), F.lit(None))).alias("c")).first()
    assert (r.a, r.b, r.c.credits, r.c.reward) == ("hi", 3, [1.0, 1.0], 1.0)


def test_rewrite_and_places(spark, tmp_path):
    spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(6)], "id long, t string").coalesce(1).write.parquet(f"{tmp_path}/x")
    assert io.rewrite_column(spark, f"{tmp_path}/x", f"{tmp_path}/y", "t", lambda c: F.replace(c, F.lit("a"), F.lit("c"))) == 3
    assert sorted(r.t for r in spark.read.parquet(f"{tmp_path}/y").collect()) == ["b"] * 3 + ["c"] * 3
    assert io.rewrite_column(spark, f"{tmp_path}/y", f"{tmp_path}/z", "t", F.trim) == 0 and not (tmp_path / "z").exists()
    rows = io.with_row_index(spark.read.parquet(f"{tmp_path}/x"))
    name = rows.first().source_path
    manifest = spark.createDataFrame([(name, 1, "1"), (name, 2, "5"), (name, 77, "7")], "source_path string, source_index long, task_id string")
    assert sorted((r.source_index, r.match) for r in io.at_places(manifest, rows, "task_id", "id").collect()) == [(1, True), (2, False), (77, False)]
