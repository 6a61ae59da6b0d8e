import pytest
from pyspark.sql import functions as F

from trellis.functions import messages as ms
from trellis.operators import credit, sampling


def test_messages(spark):
    one = spark.range(1)
    r = one.select(
        ms.role(F.lit(" GPT ")).alias("a"), ms.call_id(F.lit(3), F.lit(1)).alias("b"), ms.call_arguments(F.lit('{"arguments": "{\\"choice\\": \\"Search\\", \\"content\\": \\"x\\"}"}')).alias("c"),
        ms.call_arguments(F.lit('bad {"choice": "fly", "content": "y"')).alias("d"), ms.json_object(F.lit('so ```json\n{"k": 1}\n``` ok'), "k int").alias("e"), ms.listed(F.lit("Searched: a, b\nLeft: none"), "Searched").alias("f"),
        ms.listed(F.lit("Searched: a, b\nLeft: none"), "Left").alias("g"), ms.state_text(F.lit(None).cast("string"), {"Seen": F.array(F.lit("a"))}).alias("h"), ms.tail_answer(F.lit("Answer: 1\nanswer : 22 ")).alias("i"),
        ms.tail_answer(F.lit("none")).alias("j"), ms.prompt_loss_mask(F.lit(5), F.lit(3)).alias("k"), ms.aspect(F.lit("a flight"), {"f": ["flight"], "h": ["hotel"]}).alias("l"),
        ms.off_topic(F.array(F.lit(False), F.lit(False), F.lit(True), F.lit(False)), 2).alias("m"), ms.geometry_score(F.lit(True), F.lit("<think>x</think> \\boxed{1}")).alias("n"),
    ).first()
    assert (r.a, r.b, tuple(r.c), tuple(r.d), r.e.k, r.f, r.g) == ("assistant", "call_0301", ("search", "x"), (None, "y"), 1, ["a", "b"], [])
    assert (r.h, r.i, r.j, r.k, r.l) == ("Current aspect: none\nSeen: a", "22", "[INVALID]", [0, 0, 1, 1, 0], "f")
    assert [tuple(x) for x in r.m] == [(1, False), (2, True), (0, False), (1, False)] and r.n == pytest.approx(1.0)


def test_spaced(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)] + [("b", i, float(i)) for i in range(5)] + [("c", i, 1.0) for i in range(5)] + [("d", 1, None), (None, 1, 0.0), (None, 2, 0.0), (None, 3, 9.0)], "g string, k int, s double")
    picked = lambda n, g: sorted(r.k for r in sampling.spaced(df, "g", "s", "k", n).collect() if r.g == g)
    assert picked(3, "a") == [0, 4, 8] and picked(3, None) == [1, 2, 3]
    assert picked(4, "b") == [0, 1, 2, 4]
    assert picked(4, "c") == [] and picked(4, None) == [] and picked(10, "a") == [] and picked(9, "a") == list(range(9))
    assert sampling.spaced(df.limit(0), "g", "s", "k", 3).collect() == []


def test_component_credit_is_kept(spark):
    df = spark.createDataFrame([("r", i, 1.5, 0.4, w) for i, w in enumerate((0.0, 1.0, 3.0))], "r string, t int, a double, c double, w double")
    got = credit.mixed_component_credit(df, "r", "t", "a", {"c": ("c", F.col("w"))}).orderBy("t").collect()
    assert sum(x.turn_credit for x in got) == pytest.approx(1.5) and got[2].turn_credit > got[1].turn_credit > got[0].turn_credit


def test_long_call_ids(spark):
    df = spark.createDataFrame([(0, 1), (3, 2), (123, 4)], "m int, o int")
    assert [r.x for r in df.select(ms.call_id(F.col("m"), F.col("o")).alias("x")).collect()] == ["call_0001", "call_0302", "call_12304"]
