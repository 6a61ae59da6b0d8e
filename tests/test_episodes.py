"""Graded answers, record helpers and replayed episodes against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from trellis.functions import grading, messages, records
from trellis.operators import environment, replay

PLAN = ["flight", "hotel"]
OFFERS = {"flight": (["F1", "F2"], ["f2"], {"F1": '{"cost":1}'}), "hotel": (["H1"], ["H1"], {})}
SAID = {"flight": ["I like mornings.", "And windows."]}
CALLS = "array<struct<kind:string,content:string,aspect:string>>"


def simulate(calls, most):
    """What the environment does, call by call, without messages' states."""
    s = {"steps": 0, "invalid": 0, "wrong": 0, "terminated": False, "truncated": False, "valid": True, "reason": ""}
    searched, answered, current, acted, out = set(), set(), PLAN[0], [], []

    def run(kind, content, aspect):
        nonlocal current
        if s["terminated"] or s["truncated"]:
            return "finished"
        if kind in ("search", "action", "answer", "finish", "external"):
            s["steps"] += 1
        if kind not in ("search", "action", "answer", "finish"):
            return "parameters"
        if kind == "finish":
            s.update(terminated=True, reason="finish")
            return None
        if not content:
            return "parameters"
        if aspect not in PLAN or (current and aspect != current):
            return "cross"
        if kind == "search":
            if aspect in searched:
                return "repeated"
            searched.add(aspect)
            return None
        if aspect not in searched:
            return "early_action" if kind == "action" else "early_answer"
        if kind == "action":
            need = sum(1 + (a not in searched) for a in PLAN if a not in answered)
            if most - s["steps"] <= need:
                return "deadline"
            acted.append(aspect)
            return None
        if not (content[:1].isalpha() and content[1:].isdigit()):
            return "parameters"
        if content.upper() not in OFFERS[aspect][0]:
            return "invisible"
        answered.add(aspect)
        s["wrong"] += content.upper() not in [x.upper() for x in OFFERS[aspect][1]]
        current = next((a for a in PLAN if a not in answered), None)
        if current is None:
            s.update(terminated=True, reason="all_aspects_answered")
        return None

    for kind, content, aspect in calls:
        if kind == "failure":
            s.update(valid=False, truncated=True, reason="user_simulator_api_error")
            out.append((False, None, dict(s)))
            continue
        error = run(kind, content, aspect)
        s["invalid"] += error is not None
        if s["steps"] >= most and not s["terminated"]:
            s.update(truncated=True, reason="max_steps")
        out.append((error is None, error, dict(s)))
    return out


def test_episodes_match_a_plain_simulator(spark):
    rng = random.Random(7)
    kinds = ["search"] * 4 + ["action"] * 3 + ["answer"] * 4 + ["finish", "external", "failure", None]
    episodes = [[(rng.choice(kinds), rng.choice(["F1", "f2", "H1", "F9", "x", "", None]), rng.choice(["flight", "flight", "hotel", None])) for _ in range(rng.randint(0, 9))] for _ in range(150)]
    good = [("search", "s", "flight"), ("action", "a", "flight"), ("answer", "f1", "flight"), ("search", "s", "hotel"), ("answer", "H1", "hotel"), ("search", "late", "hotel")]
    episodes += [good, []]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(episodes)], f"id int, calls {CALLS}")
    offers = F.create_map(*[x for k, (every, right, shown) in OFFERS.items() for x in (F.lit(k), F.struct(F.lit(every).alias("every"), F.lit(right).alias("correct"), F.create_map(*[F.lit(v) for kv in (shown or {"-": ""}).items() for v in kv]).alias("shown")))])
    said = F.create_map(F.lit("flight"), F.lit(SAID["flight"]))
    got = {r["id"]: r["r"] for r in df.select("id", environment.play(F.col("calls"), F.lit(PLAN), offers, said, most=6).alias("r")).collect()}
    seen = set()
    for i, e in enumerate(episodes):
        want = simulate(e, 6)
        assert len(got[i]) == len(want)
        for row, (ok, error, state) in zip(got[i], want, strict=True):
            assert (row["accepted"], {k: row[k] for k in state}) == (ok, state)
            if error and row["kind"] != "external":
                assert row["message"].startswith(environment.REPLIES[error])
            seen.add(error)
    assert seen >= {None, "finished", "parameters", "cross", "repeated", "early_action", "deadline", "early_answer", "invisible"}
    told = [r["message"] for r in got[150]]
    assert told[0].startswith('Search results for flight; all candidates are shown:\n- F1: {"cost":1}\n- F2: {}\nCurrent aspect: flight\nSearched aspects: flight\nAnswered aspects: none\nVisible option IDs for current aspect: F1, F2\n')
    assert told[1].startswith("The traveler says: I like mornings.\n") and told[1].endswith("Action count by aspect: flight=1, hotel=0")
    assert told[2].startswith("Your answer was recorded for flight.\nCurrent aspect: hotel\n")
    assert told[4].startswith("Your answer was recorded for hotel.\nCurrent aspect: none\n")


def test_parsed_actions(spark):
    texts = [" [Search] a flight\nnow ", "[finish]", "[answer]F1", "search x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(environment.parse_action(F.col("t")).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [("search", "a flight\nnow"), ("finish", ""), ("answer", "F1"), (None, ""), (None, "")]


#: Transcripts as 'role choice aspect content' lines; - for null. A + before a line that stays.
LEGACY = """
+user - - hello
-assistant action flight too early
-tool - - dropped with its call
+assistant search flight flights
+tool - - options
-assistant search hotel across
-observation - - dropped
-assistant search flight again
+assistant action - cheaper
+tool - - still seen
-assistant answer flight F1 F2
+assistant answer flight f1
+tool - - recorded
+user - - go on
-assistant action flight closed
-assistant answer flight F1
-tool - - nothing
+assistant search hotel hotels
+observation - - options
+assistant answer hotel H2
--
+assistant search - anything
+tool - - options
-assistant search - once more
+assistant answer hotel H2
+tool - - recorded
-assistant search - a second unnamed one
-assistant - - no call
-tool - - dropped
+- - - no role
--
-assistant answer flight F1
+assistant search - -
"""


def test_legacy_transcripts(spark):
    runs, kept = [[]], [[]]
    for line in LEGACY.strip().splitlines():
        if line == "--":
            runs.append([])
            kept.append([])
            continue
        role, choice, aspect, content = (None if x == "-" else x for x in line[1:].split(" ", 3))
        runs[-1].append((role, choice, aspect, content))
        kept[-1].append(line[0] == "+")
    df = spark.createDataFrame([*enumerate(runs), (9, []), (10, None)], "id int, m array<struct<role:string,choice:string,aspect:string,content:string>>")
    got = {r["id"]: r["x"] for r in df.select("id", replay.legacy_kept(F.col("m")).alias("x")).collect()}
    for i, want in enumerate(kept):
        assert [x["kept"] for x in got[i]] == want
    texts = [x["content"] for x in got[0]]
    assert texts[12] == "Your answer was recorded." and texts[4] == "options" and texts[18] == "options"
    assert got[1][4]["content"] == "Your answer was recorded."
    assert got[9] == [] and got[10] is None


def test_curation_counts_add_up(spark):
    good = [("search", "Search flight", "F1"), ("answer", "F1", "recorded")]
    bad = [("answer", "F1", "Tool call rejected: answer-before-search"), *good]
    raw = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, None), (6, True), (7, True), (8, True)], "record int, d boolean")
    calls = [(k, i, *x) for k, v in {1: good, 2: bad, 3: bad[:1], 4: good, 5: good, 6: good, 8: bad}.items() for i, x in enumerate(v)]
    calls = spark.createDataFrame(calls, "record int, pos int, choice string, content string, feedback string")
    spec = spark.createDataFrame([(k, "flight", ["F1"]) for k in range(1, 9)], "record int, aspect string, correct array<string>")
    kept, audits, counts = replay.curate(raw, calls, spec, domain=F.col("d"), quarantined=F.col("record") == 6, infra=F.col("record") == 8)
    assert {r.record: (r.n_kept, r["class"], r.weight) for r in kept.collect()} == {1: (2, "strict_gold", 1.0), 2: (3, "recoverable_correct", 1.0), 3: (0, "totally_wrong", 0.0), 7: (0, "totally_wrong", 0.0), 8: (3, "infrastructure_invalid", 0.0)}
    assert audits.where("record = 2 and pos = 0").first().repaired_by == 1
    assert counts.first().asDict() == {"source_records": 8, "outside_domain": 2, "quarantined": 1, "accepted": 5, "infrastructure_invalid": 1, "recoverable_correct": 1, "strict_gold": 1, "partial_correct": 0, "totally_wrong": 2}


FINAL = [("x = \\$1,234 dollars", "1234"), ("\\frac12", "\\frac{1}{2}"), ("the answer is $5$ km", "5"), ("\\sqrt3", "\\sqrt{3}"), ("\\boxed{7}", "7"), ("12 \\text{m}", "12"), ("90^\\circ", "90"), ("", ""), (None, None)]


@pytest.mark.parametrize("given,want", FINAL)
def test_final_answers(spark, given, want):
    assert spark.range(1).select(grading.final_answer(F.lit(given).cast("string")).alias("x")).first()["x"] == want


def test_solution_scores(spark):
    rows = [("Answer: 3\nanswer : 4", "4", 1.0), ("no", "4", -1.0), (None, "4", -1.0), ("Answer: 4", None, -1.0), ("Answer: 4" + "." * 400, "4", -1.0)]
    df = spark.createDataFrame(rows, "s string, t string, w double")
    assert df.where(grading.solution_score(F.col("s"), F.col("t"))["score"] != F.col("w")).isEmpty()
    strict = spark.createDataFrame([("so \\boxed{x{1}}", "x{1}", True), ("\\boxed{1}" + " " * 100, "1", False)], "s string, t string, w boolean")
    assert strict.where(grading.solution_score(F.col("s"), F.col("t"), strict=True)["acc"] != F.col("w")).isEmpty()


def test_answers_agree(spark):
    cases = [("50%", "0.5", True), ("1,000", "1000", True), ("(1, 2.00001)", "(1,2)", True), ("(1,2)", "[1,2]", False), ("(1,2)", "(2,1)", False), ("1,2", "1, 2", True), ("1d", "1", False), ("X", "x", True), ("\\dfrac{1}{2}", "\\frac{1}{2}", True), ("", "", False), (None, "1", False), ("0", "0.0", True)]
    df = spark.createDataFrame(cases, "g string, t string, w boolean")
    bad = df.where(grading.answers_agree(F.col("g"), F.col("t")) != F.col("w")).collect()
    assert not bad


def test_records(spark):
    df = spark.range(1).select(
        messages.passages(F.array(F.lit("Title\nbody\nmore"), F.lit("Only"))).alias("p"),
        records.provenance(F.lit(" env "), F.lit(3), F.lit(0), F.lit("m"), F.lit("r"), F.lit("c"), endpoint=F.lit("e")).alias("v"),
        records.invalid_report(F.lit("timeout"), "v2").alias("i"),
        records.manifest(F.lit("path"), F.create_map(F.lit("k"), F.lit("1")), F.lit("c"), contract="one", version="v2").alias("m"),
        F.array(*[records.retry_delay(F.lit(a), F.lit(0.5)) for a in (-1, 0, 2, 9)]).alias("d"), records.transient(F.lit("ReadTimeout")).alias("t"),
    )
    r = df.first()
    assert r["p"] == "Doc 1 (Title: Title)\nbody\nmore\n\nDoc 2 (Title: Only)"
    assert r["v"].asDict() == {"task_key": "env::3", "env_name": "env", "task_id": "3", "pass_index": 0, "model": "m", "thinking": "enabled", "reasoning_effort": "high", "max_turns": 25, "code_revision": "c", "collection_run_id": "r", "api_endpoint_label": "e"}
    assert (r["i"]["terminal_reward"], r["m"]["contract_version"], r["d"], r["t"]) == (0.0, "one", [1.25, 1.25, 4.25, 8.0], True)
    with pytest.raises(Exception, match="grades in its environment"):
        spark.range(1).select(records.refused("interaction")).collect()


def test_plain_values_search_for_a_word_before_its_pattern(spark):
    from trellis.functions import grading

    # Arrange
    cases = [("5 minutes", "5"), ("\\text{12,000}", "12000"), ("3 million dollars", "3 *10^6 dollars"), ("{- 7.0}", "-7"), ("1 3/4 Inches", "1+3/4 inches"), ("2 feet^2 or 3 days", "2  , 3 "), ("$90^ \\circ", "90"), ("50\\%", "50"), ("centimeters", ""), ("", ""), (None, None)]
    value = grading.plain_value(F.col("a"))

    # Act
    got = spark.createDataFrame(cases, "a string, b string").select("a", "b", value.alias("c")).collect()

    # Assert
    assert [(r.a, r.c) for r in got] == [(a, b) for a, b in cases]
    assert str(value).count("regexp_replace") < 5
