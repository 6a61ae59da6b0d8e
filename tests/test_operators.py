import math
import re

import pytest
from pyspark.sql import functions as F

from trellis.functions import text as tx
from trellis.operators import advantage, attempts, batching, credit, joins, replay, sampling
from trellis.operators import sequences as seq
from trellis.operators.scan import scan


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(c.alias("x")).first().x


def test_pass_at_k(spark):
    data = [("a", 1, 0.0, 1.0, 0.1), ("a", 2, 1.0, 1.0, 0.9), ("b", 1, 1.0, 1.0, 0.8), ("c", 1, 0.0, 0.0, 0.0), ("c", 2, 0.0, 1.0, 0.2), ("c", 3, 0.0, 1.0, 0.3)]
    df = spark.createDataFrame(data, "task string, attempt int, s double, v double, reward double")
    r = attempts.summary(attempts.per_task(df, "task", "attempt", F.col("s"), F.col("v"), ["reward"], 3), ["reward"]).first()
    assert (r.pass_at_k, r.pass_at_1, r.n_attempts, r.n_early) == (pytest.approx(2 / 3), pytest.approx(1 / 3), 6, 2)
    assert r.valid_rate == pytest.approx(5 / 6) and r.first_reward == pytest.approx(0.3) and r.best_reward == pytest.approx(2 / 3)


def test_best_falls_back_to_invalid_attempts(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.4)], "task string, attempt int, s double, v double, m double")
    assert attempts.per_task(df, "task", "attempt", F.col("s"), F.col("v"), ["m"], 3).first().best_m == 0.4


def test_reward_spread(spark):
    groups = {"constant": (0.5, 0.5000005), "small": (0.5, 0.503), "useful": (0.5, 0.505), "edge": (0.25, 0.255), "below": (0.1, 0.1049)}
    df = spark.createDataFrame([(g, x, True) for g, xs in groups.items() for x in xs] + [("lone", 1.0, True), ("bad", 1.0, None), ("bad", math.nan, True)], "uid string, r double, ok boolean")
    got = {r.uid: r.reason for r in advantage.spread_reason(df, "uid", "r", F.col("ok"), size=2).collect()}
    assert got == {"constant": "constant_reward", "small": "insufficient_reward_spread", "useful": "useful", "edge": "useful", "below": "insufficient_reward_spread", "lone": "incomplete_group", "bad": "reward_invalid"}


def test_singletons(spark):
    df = spark.createDataFrame([("a", 2.0, 3.0)], "g string, s double, n double")
    assert advantage.grpo(df, "g", "s").first().advantage == pytest.approx(2.0, rel=1e-5)
    assert advantage.terminal_grpo(df, "g", "s", F.lit(True)).first().advantage == 0
    assert advantage.leave_one_out(df, "g", "s").first().advantage == 2
    assert advantage.length_weighted(df, "g", "s", "n").first().advantage == 2
    assert advantage.best_of_group(df, "g", "s", "s").first().advantage is None


def test_components_sum(spark):
    data = [("u", 0.9, 0.2, -0.3), ("u", 0.5, 0.1, -0.2), ("u", 0.2, 0.0, -0.2), ("u", -0.1, 0.0, -0.3)]
    for r in advantage.by_component(spark.createDataFrame(data, "g string, a double, b double, c double"), "g", ["a", "b", "c"]).collect():
        assert r.adv_a + r.adv_b + r.adv_c == pytest.approx(r.advantage, abs=1e-9)


def test_recurrences(spark):
    df = spark.createDataFrame([("x", 0, 1.0, 1, 0.0), ("x", 1, 2.0, 1, 0.0), ("x", 2, 4.0, 1, 0.0), ("y", 0, 8.0, 0, 1.0), ("y", 1, None, 0, None), (None, 3, 1.0, None, 0.5)], "k string, t int, r double, m int, v double")
    at = lambda d, c: {k: [r[c] for r in sorted(d.collect(), key=lambda r: r.t) if r.k == k] for k in ("x", "y", None)}
    assert at(advantage.discounted_returns(df, "k", "t", "r", "m", 0.5), "return") == {"x": [3.0, 4.0, 4.0], "y": [8.0, 0.0], None: [1.0]}
    got = advantage.gae(df, "k", "t", "r", "v", 1.0, 0.5)
    assert at(got, "advantage") == {"x": [3.0, 4.0, 4.0], "y": [7.0, 0.0], None: [0.5]} and at(got, "return")["y"] == [8.0, 0.0]
    assert advantage.gae(df.where("t > 9"), "k", "t", "r", "v", 1.0, 0.5).collect() == []


def test_estimators_by_name():
    assert advantage.ESTIMATORS["rloo"] is advantage.leave_one_out
    with pytest.raises(ValueError):
        advantage.register("rloo")(advantage.grpo)


def test_streak_and_checkpoint(spark):
    df = spark.createDataFrame([("a", i, z) for i, z in enumerate([1, 1, 0, 1, 1, 1, 1])], "t string, s int, z int")
    got = attempts.zero_streaks(df, "t", "s", F.col("z") == 1).orderBy("s").collect()
    assert [r.streak for r in got] == [1, 2, 0, 1, 2, 3, 4] and {r.first_admitted for r in got} == {5}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    right = spark.createDataFrame([("a", 5, 2), ("a", 6, 1)], "k string, v long, o long")
    hit, miss = joins.first_match(left, right, "k", "o")
    assert [(r.id, r.v) for r in hit.collect()] == [(1, 6)] and [r.id for r in miss.collect()] == [2]
    tiers = joins.tiered(left, [(right.where("o = 2").select(F.col("k").alias("k1"), "v"), F.col("k") == F.col("k1"), "v"), (spark.createDataFrame([(2, 9)], "i long, v long"), F.col("id") == F.col("i"), "v")], "id")
    assert sorted((r.id, r.match, r.tier) for r in tiers.collect()) == [(1, 5, 1), (2, 9, 2)]


def test_rows_join_by_position(spark):
    a = spark.createDataFrame([(3, "c", None), (1, "a", 1), (2, "b", 2)], "x int, s string, k int")
    b = spark.createDataFrame([(9, "r", 2), (8, "q", 1), (10, "s", None)], "y int, t string, k int")
    got = joins.by_position(a, b, ["x"], ["y"], ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 1, 8, "q"), (2, "b", 2, 9, "r"), (3, "c", None, 10, "s")]
    assert joins.by_position(a.limit(0), b.limit(0), ["x"], ["y"], ["k"]).collect() == []
    with pytest.raises(Exception, match="different k at row 0"):
        joins.by_position(a, b.replace(1, 5, "k"), ["x"], ["y"], ["k"]).collect()
    with pytest.raises(Exception, match="different length"):
        joins.by_position(a, b.where("y < 10"), ["x"], ["y"], ["k"]).collect()


def test_deadline_and_counters(spark):
    from trellis.operators import replay

    a = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    r = spark.range(1).select(replay.steps_needed(a("f", "h", "c"), a("f", "h"), a("f")).alias("n"), replay.deadline_blocks(10, F.lit(7), a("f", "h", "c"), a("f", "h"), a("f")).alias("at"), replay.deadline_blocks(10, F.lit(6), a("f", "h", "c"), a("f", "h"), a("f")).alias("before")).first()
    assert (r.n, r.at, r.before) == (3, True, False)
    said = [("search", "flight", "F1"), ("action", "what?", "ok"), ("search", "flight", "F1"), ("answer", "F9", "no"), ("answer", "F1", "yes"), ("fly", None, None)]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(said)] + [(None, 0, "search", "hotel", "H1")], "record long, pos int, choice string, content string, feedback string")
    c = {r.record: r for r in replay.counters(replay.replayed(df)).collect()}
    assert tuple(c[1][1:6]) == (6, 1, 1, 1, 3) and tuple(c[None][1:]) == (1, 1, 0, 0, 0, {})
    assert c[1].by_kind == {"repeated-search": 1, "invisible-id": 1, "invalid-parameters": 1}
    spec = spark.range(1).select(replay.task_spec(a("flight", "car"), {"flight": (a("f1"), a("f1", " f2"), F.lit("f1")), "hotel": (a("h1"), a("h1"), F.lit("h1"))}).alias("s")).first().s
    assert [(x.aspect, x.correct, x.every, x.best) for x in spec] == [("flight", ["F1"], ["F1", "F2"], "F1")]


def test_bootstrap_draws_like_one_at_a_time(spark):
    import numpy as np

    from trellis.operators import attempts

    scores = [0.3, 0.9, 0.1, 0.5]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(scores)] + [("b", 0, 2.0), ("c", 0, None)], "g string, i int, s double")
    got = {r.g: r for r in attempts.bootstrap(df, "g", "s", "i", 3).collect()}
    random = np.random.RandomState(42)
    best = [max(scores[i] for i in random.choice(4, size=3, replace=True)) for _ in range(1000)]
    assert set(got) == {"a", "b"} and got["b"].best_std == 0
    assert got["a"].best_mean == pytest.approx(np.mean(best)) and got["a"].best_std == pytest.approx(np.std(best))


def test_bootstrap_draws_work_out_groups_of_one_size_together(spark):
    import numpy as np

    from trellis.operators import attempts

    # Arrange
    random = np.random.RandomState(5)
    groups = [random.rand(n) * 100 for n in [*range(1, 18), 3000, *[4] * 1100]]
    df = spark.createDataFrame([(g, len(x) - i, float(s)) for g, x in enumerate(groups) for i, s in enumerate(x)], "g int, i int, s double").coalesce(1)
    # Act
    got = {r.g: r for r in attempts.bootstrap(df, "g", "s", "i", 2).collect()}
    n = sum(len(x) for x in attempts._draws(np.ones((1100, 4)), 1000, 2, 42))

    # Assert: the same to the last bit as one group at a time
    assert n == 1100 and len(got) == len(groups)
    for g, x in enumerate(groups):
        drawn = x[::-1][np.random.RandomState(42).choice(len(x), size=(1000, 2), replace=True)]
        best, worst = drawn.max(axis=1), drawn.min(axis=1)
        assert (got[g].best_mean, got[g].best_std, got[g].worst_mean, got[g].worst_std) == (best.mean(), best.std(), worst.mean(), worst.std())


def test_case_folds_as_python_folds_it_without_python(spark):
    import sys

    from trellis.functions import text as tx

    # Arrange: every letter that changes its case, between others and at the end of a word
    odd = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (chr(i).casefold() != chr(i) or chr(i).isspace())]
    texts = [f"{x}a {x}{x} b{x}" for x in odd] + ["GEẞSCH  Straße\x1f\xa0x ", " \u3000", "", None]

    # Act
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.normalise_folded(F.col("t")).alias("t"))
    got = {r.i: r.t for r in df.collect()}

    # Assert
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    wrong = [(t, got[i]) for i, t in enumerate(texts) if got[i] != re.sub(r"\s+", " ", (t or "").casefold()).strip()]
    assert not wrong, wrong[:20]


def test_latex_answers_and_domains(spark):
    from trellis.functions import messages as ms
    from trellis.functions import text as tx

    cases = [(r"\tfrac12", r"\frac{1}{2}"), ("0.5", "1/2"), (r"90^\circ", "90"), ("12 \\text{ cm}", "12"), (r"\sqrt2", r"\sqrt{2}"), ("n=3", "3"), (".25", "0.25"), ("7\\%", "7"), (r"\frac3{x}", r"\frac{3}{x}"), ("", ""), (None, None)]
    df = spark.createDataFrame(cases, "a string, b string")
    assert df.where(~tx.same_answer(F.col("a"), F.col("b"))).count() == 0
    assert df.where(tx.same_answer(F.col("a"), F.lit("none of them"))).count() == 0
    said = spark.range(1).select(ms.training_message(F.lit("{}"), F.lit(" "), F.lit("<think>why</think>x")).alias("a"), ms.training_message(F.lit("{}"), F.lit(None).cast("string"), F.lit("plain")).alias("b"), ms.training_message(F.lit("{}"), F.lit(None).cast("string"), F.lit("plain"), fallback="content").alias("c")).first()
    assert said.a == "<think>\nwhy\n</think>\n\n<tool_call>\n{}\n</tool_call>" and said.b == "<tool_call>\n{}\n</tool_call>" and said.c.startswith("<think>\nplain\n")


def test_a_scan_after_a_join_on_its_key_sees_whole_groups(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 10).alias("k"), F.col("id").alias("pos"))
        held = rows.join(rows.select("k").distinct(), "k")
        out = scan(held, ["k"], ["pos"], ["pos"], int, lambda n, _: (n + 1, (n + 1,)), "n long")
        got = out.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("x")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r.k: [x.n for x in r.x] for r in got} == {k: list(range(1, 401)) for k in range(10)}
