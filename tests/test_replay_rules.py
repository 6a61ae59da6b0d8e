"""The rules of transcripts on hand-written episodes: what feedback tells, what repairs what, cuts, masks, classes."""

import itertools
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from trellis.functions import text as tx
from trellis.operators import advantage, ranges, replay, sampling

CALL = "record string, pos int, choice string, content string, feedback string"
TASK = [("flight", ["F1"])]
FLIGHT = [("search", "Search flight", "Here are all the options for <flight>: F1 F2"), ("action", "Which amenities matter most?", "I prefer a direct flight.")]
DONE = [*FLIGHT, ("answer", "F1", "Your answer was recorded.")]
ANSWERED = ("answer", "F1", "recorded")
NO = "Tool call rejected: {}."


def run(spark, episodes, tasks=None, **options):
    """{name: (faults, kept, supervised, repaired_by)} and {name: (class, n_repaired, fault)}."""
    calls = spark.createDataFrame([(k, i, *c) for k, v in episodes.items() for i, c in enumerate(v)], CALL)
    tasks = tasks or dict.fromkeys(episodes, TASK)
    spec = spark.createDataFrame([(k, a, ids) for k, v in tasks.items() for a, ids in v], "record string, aspect string, correct array<string>")
    done = replay.cleaned(calls.repartition(3), spec, **options)
    rows = {k: sorted(v, key=lambda r: r.pos) for k, v in itertools.groupby(sorted(done.collect(), key=lambda r: r.record), key=lambda r: r.record)}
    return rows, {r.record: r for r in replay.outcomes(done, spec).collect()}


def test_refused_calls_and_their_repairs(spark):
    early = [("action", "ask before searching", NO.format("action-before-search")), *DONE]
    rows, got = run(
        spark,
        {
            "repaired": early, "unrepaired": early[:1], "wrong": [*FLIGHT, ("answer", "F2", "recorded")], "right": DONE,
            "answer-early": [("answer", "F1", NO.format("answer-before-search")), *DONE], "twice": [*FLIGHT[:1], ("search", "Search flight", "already searched"), *DONE[1:]],
            "twice-cut": [*FLIGHT[:1], ("search", "Search flight", "already searched")], "quiet": [("action", "Which amenities matter?", "fine"), *DONE],
            "vague": [*FLIGHT[:1], ("action", "hm", "too vague"), ("action", "and?", "yes"), *DONE[1:]], "vague-cut": [*FLIGHT[:1], ("action", "hm", "too vague"), ("action", "and?", "yes"), ANSWERED],
            "unknown-choice": [*FLIGHT, ("fly", "x", "missing required choice"), ANSWERED], "invisible": [*FLIGHT, ("answer", "F7", "F7 is not visible"), ANSWERED],
            "failed": [*FLIGHT, ("action", "What else is there?", "The backend is experiencing some issues"), ANSWERED], "no-options": [("search", "Search flight", "none found"), *DONE], "no-feedback": [*FLIGHT, ("answer", "F1", None)],
        },
    )
    assert [r.repaired_by for r in rows["repaired"]] == [1, None, None, None] and [r.supervised for r in rows["repaired"]] == [False, True, True, True]
    assert {k: (r["class"], r.fault, r.n_kept) for k, r in got.items()} == {
        "repaired": ("recoverable_correct", None, 4), "unrepaired": ("totally_wrong", "action-before-search", 0), "wrong": ("totally_wrong", "wrong-terminal-answer", 2), "right": ("strict_gold", None, 3),
        "answer-early": ("recoverable_correct", None, 4), "twice": ("recoverable_correct", None, 4), "twice-cut": ("totally_wrong", "repeated-search", 1), "quiet": ("totally_wrong", "unrepaired-recoverable-error", 0),
        "vague": ("recoverable_correct", None, 5), "vague-cut": ("totally_wrong", "vague-action", 1), "unknown-choice": ("recoverable_correct", None, 4), "invisible": ("recoverable_correct", None, 4),
        "failed": ("totally_wrong", "environment-failure", 2), "no-options": ("totally_wrong", "environment-failure", 0), "no-feedback": ("totally_wrong", "tool_observation_misaligned", 2),
    }


def test_two_aspects(spark):
    hotel = [("search", "Search hotel", "Here are all the options for <hotel>: H1"), ("answer", "H1", "recorded")]
    two = [("flight", ["F2"]), ("hotel", ["H1"])]
    episodes = {
        "early-wrong": [*DONE, *hotel], "again": [*FLIGHT, ("answer", "F2", "recorded"), ("answer", "F2", "duplicate answer"), *hotel], "again-cut": [*FLIGHT, ("answer", "F2", "recorded"), ("answer", "F2", "duplicate answer")],
        "across": [*FLIGHT, ("search", "Search hotel", NO.format("one tool call may target only one aspect")), ("answer", "F2", "recorded"), *hotel],
        "after-the-cut": [*FLIGHT, ("action", "fine here?", "evaluation_timeout"), ("search", "Search flight", "already searched"), ("action", "Which are the best ones?", "x"), ("answer", "F2", "recorded")],
    }
    rows, got = run(spark, episodes, dict.fromkeys(episodes, two))
    assert [r.supervised for r in rows["early-wrong"]] == [True, True, False, True, True]
    assert {k: (r["class"], r.fault, r.n_right, r.n_repaired) for k, r in got.items()} == {
        "early-wrong": ("partial_correct", None, 1, 0), "again": ("recoverable_correct", None, 2, 1), "again-cut": ("partial_correct", "duplicate-answer", 1, 0),
        "across": ("recoverable_correct", None, 2, 1), "after-the-cut": ("totally_wrong", "environment-failure", 0, 0),
    }


def test_public_state_counts_from_where_it_is_told(spark):
    told = "ok\nCurrent aspect: Hotel\nSearched aspects: flight, Hotel\nAnswered aspects: none\nVisible option IDs for current aspect: h3, H4"
    rows, _ = run(spark, {"told": [*FLIGHT[:1], ("action", "Which amenities matter?", told), ("answer", "H3", "recorded"), ("answer", "H4", "x")], "closed": [*FLIGHT[:1], ("action", "Which amenities?", "Current aspect: none"), ("action", "More of it, please?", "x")]})
    assert [(r.accepted, r.kind, r.on) for r in rows["told"]] == [(True, None, None), (True, None, "flight"), (True, None, "hotel"), (False, "answer-before-search", None)]
    assert [r.kind for r in rows["closed"]] == [None, None, "action-before-search"]


def test_odd_transcripts(spark):
    rows, got = run(spark, {"odd": [(None, None, None), ("search", "", ""), ("answer", "F1 F2", "x")], "broken": DONE}, {"odd": [], "broken": TASK}, broken=F.when((F.col("record") == "broken") & (F.col("pos") == 1), "tool_call_json_invalid"))
    assert [r.kind for r in rows["odd"]] == ["invalid-parameters", "invalid-parameters", "answer-before-search"]
    assert got["odd"]["class"] == "infrastructure_invalid" and (got["broken"].n_kept, got["broken"].fault) == (1, "tool_call_json_invalid")
    empty = spark.createDataFrame([], CALL)
    spec = spark.createDataFrame([], "record string, aspect string, correct array<string>")
    assert replay.outcomes(replay.cleaned(empty, spec), spec).collect() == []


def test_kinds_of_feedback(spark):
    cases = {
        "Tool call rejected: action-before-search.": "action-before-search", "Answer-Before-Search": "answer-before-search", "one tool call may target only one aspect": "cross-aspect", "Internal error": "environment-failure",
        "an environment/api problem, action-before-search": "environment-failure", "that visible option is invalid": "invisible-id", "the same aspect has an answer": "duplicate-answer", "same initial option": "duplicate-answer",
        "a parameter was rejected": "invalid-parameters", "a parameter": None, "visible option": None, "": None, "all good": None, "too broad": "vague-action",
    }
    df = spark.createDataFrame([*cases.items(), (None, None)], "t string, want string")
    assert df.where(~replay.rejection_kind(F.col("t")).eqNullSafe(F.col("want"))).collect() == []


@pytest.mark.parametrize("length", [3000, 12000])
def test_long_records_take_time_in_proportion(spark, length):
    """A record four times as long must not take sixteen times as long; each is scanned by one task."""
    pick = [("action", "What about the view?", "nice"), ("search", "Search flight", "already searched"), ("answer", "F9", "F9 is not visible")]
    rows = [("x", 0, *FLIGHT[0])] + [("x", i, *pick[i % 3]) for i in range(1, length)]
    calls = spark.createDataFrame(rows, CALL)
    replay.repaired(replay.replayed(calls.limit(5))).collect()
    began = time.perf_counter()
    got = replay.repaired(replay.replayed(calls)).where("not accepted").groupBy("kind").agg(F.count("*").alias("n"), F.count("repaired_by").alias("r")).collect()
    seconds = time.perf_counter() - began
    assert {r.kind: r.n for r in got} == {"repeated-search": sum(i % 3 == 1 for i in range(1, length)), "invisible-id": sum(i % 3 == 2 for i in range(1, length))}
    assert seconds < 6 + length / 1000
    tokens = spark.range(40_000).select(F.lit("x").alias("k"), "id", F.lit(1.0).alias("r"), F.lit(0.5).alias("v"))
    began = time.perf_counter()
    assert advantage.gae(tokens, "k", "id", "r", "v", 1.0, 1.0).where("id = 0").first().advantage == 40_000 - 0.5
    assert time.perf_counter() - began < 8


def test_actions_that_gain_nothing(spark):
    rows = [(1, "a", "What  about A?", True), (2, "a", "what about a", False), (3, "a", "B", False), (4, "b", "B", False), (5, "b", "?!", False), (6, "b", "", False), (7, "b", None, None)]
    df = spark.createDataFrame([("e", *r) for r in rows], "e string, o int, s string, q string, g boolean")
    got = {r.o: (r.outcome, r.redundant) for r in replay.action_outcomes(df, "e", "s", "q", "o", F.col("g")).collect()}
    assert got == {1: ("useful", False), 2: ("duplicate", True), 3: ("no_gain", True), 4: ("no_gain_first", False), 5: ("no_gain", True), 6: ("no_gain", True), 7: ("no_gain", True)}


def test_kept_rows_of_groups(spark):
    rows = [("a", 0.0, True), ("a", 1.0, True), ("b", 0.0, True), ("c", 0.0, True), ("c", 1.0, False), ("d", 1.0, True), ("d", 1.0, True), ("e", 0.0, True), ("e", 1.0, True), ("e", 2.0, None), ("f", None, True), ("f", 1.0, True), ("g", 0.0, True), ("g", 0.001, True)]
    df = spark.createDataFrame(rows, "u string, r double, ok boolean")
    got = {}
    for r in advantage.spread_reason(df, "u", "r", F.col("ok"), size=2).collect():
        got.setdefault(r.u, []).append((r.reason, r.kept))
    assert {k: (v[0][0], sum(x for _, x in v)) for k, v in got.items()} == {"a": ("useful", 2), "b": ("incomplete_group", 1), "c": ("reward_invalid", 1), "d": ("constant_reward", 0), "e": ("useful", 3), "f": ("reward_invalid", 1), "g": ("insufficient_reward_spread", 0)}


def test_private_text(spark):
    said = "see P1, p12.\nReward: 3\n step reward = 2\ncorrect_ids: F2\nbest ids=F1\nReward_Report: x\ndiagnostic: y\nfine: 1 "
    tracked = "<think>secret\nchain</think>\npreference_ids: [P1]\npublic scalar p12 xP3\nscratchpad: no\nkept: yes"
    df = spark.createDataFrame([(said, tracked, "sk-1", "my API_KEY here"), (None, None, None, None), ("", "", "", "")], "a string, b string, c string, d string")
    got = df.select(tx.redact_public(F.col("a")), *[tx.redact_tracking(F.col(c)) for c in "bcd"]).collect()
    public = re.sub(tx.PREFERENCE, "that preference", re.sub(tx.PRIVATE_LINE, "", re.sub(tx.REWARD_LINE, "", said, flags=re.I | re.M), flags=re.I | re.M), flags=re.I).strip()
    assert got[0][0] == public and public.split() == "see that preference, that preference. fine: 1".split()
    assert tuple(got[0])[1:] == ("[REASONING_REDACTED]\n[PRIVATE_REDACTED]\npublic scalar [PRIVATE_ID] xP3\n[REASONING_REDACTED]\nkept: yes", "[REDACTED]", "[REDACTED]")
    assert tuple(got[1]) == (None,) * 4 and tuple(got[2]) == ("",) * 4


def test_private_keys_at_any_depth(spark):
    tracked = {"api_key": "sk-secret", "preference_id": "P1", "raw_reward_ledger": {"x": 1}, "collection/api_errors": 2, "trainer": {"Messages": [{"content": "private"}], "steps": 200, "list": [{"COT": 1, "t": "<think>x</think>P1"}]}}
    public = {"Reward": 1, "a": [{"best_IDS": 2, "t": "Reward: 3\nP1 é"}], "rewards": 4, "n": None}
    df = spark.createDataFrame([(json.dumps(tracked), json.dumps(public)), ("{", "nope"), (None, None)], "a string, b string")
    got = df.select(tx.redact_tracking_json(F.col("a")), tx.redact_public_json(F.col("b"))).collect()
    assert json.loads(got[0][0]) == {"collection/api_errors": 2, "trainer": {"steps": 200, "list": [{"t": "[REASONING_REDACTED][PRIVATE_ID]"}]}}
    assert json.loads(got[0][1]) == {"a": [{"t": "that preference é"}], "rewards": 4, "n": None}
    assert tuple(got[1]) == tuple(got[2]) == (None, None)


def test_violations(spark):
    message = "struct<role:string,tool_calls:array<struct<id:string,function:struct<arguments:string>>>,tool_call_id:string>"
    ask, call, reply = ("user", None, None), ("assistant", [("c1", ('{"choice": "search"}',))], None), ("tool", None, "c1")
    rows = [
        ("travelgym-canonical-v1", [("system", None, None), ask, call, reply, ("system", None, None), ask, ask], [0] * 7, ["t"]),
        (None, [("gpt", None, None), reply, ("assistant", [("a", ('{"GROUND_truth": 1}',)), ("b", None), ("c", ("[]",)), None], None), ("tool", None, "b"), ("tool", None, None), call, ("tool", None, "b")], [1], []),
        ("travelgym-canonical-v1", None, None, None), ("travelgym-canonical-v1", [], [], ["t"]),
    ]
    df = spark.createDataFrame(rows, f"v string, m array<{message}>, k array<int>, t array<string>")
    got = [r[0] for r in df.select(replay.violations(F.col("v"), F.col("m"), F.col("k"), F.col("t"))).collect()]
    assert got[0] == [] and got[3] == [] and got[2] == ["messages_not_list", "tools_schema_missing"]
    assert got[1] == [
        "schema_version_mismatch", "assistant_train_mask_length", "message_0_role", "message_1_tool_call_id", "message_2_tool_arguments_0_private_keys", "message_2_tool_function_1",
        "message_2_tool_arguments_2", "message_2_tool_call_3_not_object", "message_4_tool_call_id", "message_6_tool_call_id", "tools_schema_missing",
    ]


def test_order_statistics_of_hot_groups(spark, monkeypatch):
    """A group with nearly all rows is cut into ranges; equal values are one row; nulls don't count."""
    for name, value in (("HOT_ROWS", 50), ("RANGES", 8), ("HOT_SAMPLE", 400)):
        monkeypatch.setattr(ranges, name, value)
    rows = [("hot", float((i * 7919) % 1000)) for i in range(1000)] + [("hot", 5.0)] * 400 + [("small", 1.0), ("small", 2.0), (None, 4.0), ("nulls", None), ("hot", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, g string, v double").repartition(5)
    got = {r.g: (r.a, r.b) for r in ranges.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.95}).collect()}
    import numpy as np

    hot = [v for g, v in rows if g == "hot" and v is not None]
    assert got == {"hot": (np.quantile(hot, 0.5), pytest.approx(np.quantile(hot, 0.95))), "small": (1.5, pytest.approx(1.95)), None: (4.0, 4.0)}
    placed = ranges.in_order(df, ["g"], ["v", "k"], "at").where("g = 'hot'").collect()
    order = sorted(placed, key=lambda r: (r.v is not None, r.v or 0, r.k))
    assert [r.at for r in order] == list(range(1401))
    steps = sampling.spaced(df, "g", "v", "k", 4)
    assert sorted(r.v for r in steps.collect()) == sorted([min(hot), max(hot), sorted(hot)[1 + round(1397 / 3)], sorted(hot)[1 + round(2 * 1397 / 3)]])
    assert ranges.quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).collect() == []


def stack_boxed(t):
    if t is None:
        return None
    if "\\boxed " in t:
        return t.split("\\boxed ")[-1].split("$")[0]
    at = t.rfind("\\boxed")
    if at < 0 or not t[at + 6 :].startswith("{"):
        return None
    depth = 0
    for i in range(at + 6, len(t)):
        depth += {"{": 1, "}": -1}.get(t[i], 0)
        if depth == 0:
            return t[at + 7 : i]
    return None


def test_braces_of_any_depth(spark):
    import random

    draw = random.Random(9)
    texts = ["".join(draw.choice(["{", "}", "{", "}", "\\boxed", "\\boxed{", "\\frac", "x", "🙂", "é", "\n", "$", " "]) for _ in range(draw.randint(0, 30))) for _ in range(600)]
    texts += ["\\boxed{" + "{" * 300 + "a" + "}" * 300 + "} end", "\\boxed{}", "\\boxed 5$ x", "\\boxed", "", None, "\\fbox{1}", "\\boxed{1}\\boxed{2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.boxed(F.col("t"))).collect()] == [stack_boxed(t) for t in texts]
    began = time.perf_counter()
    assert spark.range(1).select(F.length(tx.boxed(F.concat(F.lit("\\boxed{"), F.repeat(F.lit("{x}"), 200_000), F.lit("}"))))).first()[0] == 600_000
    assert time.perf_counter() - began < 20
