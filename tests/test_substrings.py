"""Needles in texts against Python's own search; tasks by map, id and text."""

import random

from pyspark.sql import functions as F

from trellis.operators import substrings


def pairs(texts, needles):
    return {(k, n) for k, t in texts for n, x in needles if t is not None and x and x in t}


def found(spark, texts, needles):
    t = spark.createDataFrame(texts, "k long, t string").repartition(3)
    n = spark.createDataFrame(needles, "n string, x string")
    rows = [tuple(r) for r in substrings.contains_pairs(t, "k", "t", n, "n", "x").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_needles_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    draw = random.Random(6)
    letters = "aab é漢\n"
    texts = [(i, "".join(draw.choice(letters) for _ in range(draw.choice([0, 3, 40, 400, 1500])))) for i in range(60)] + [(7, "twice"), (None, "aab" * 40), (90, None), (91, "")]
    needles = []
    for n in range(160):
        src = draw.choice(texts)[1] or "zz"
        at = draw.randrange(max(1, len(src)))
        piece = src[at : at + draw.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 31, 33, 63, 64, 65, 200])]
        needles.append((str(n), piece if draw.random() < 0.7 else piece + "q"))
    needles += [("null", None), ("empty", ""), (None, "aab"), ("same", "aab"), ("same", "é")]
    assert found(spark, texts, needles) == pairs(texts, needles)
    monkeypatch.setattr(substrings, "HOT", 3)
    assert found(spark, texts, needles) == pairs(texts, needles)


def test_empty_sides(spark):
    assert found(spark, [(1, "a")], []) == set() == found(spark, [], [("n", "a")]) and found(spark, [(1, "a")], [("n", "")]) == set()


def test_a_passage_in_nearly_all_texts(spark):
    common = "a common passage that stands nearly everywhere, " * 3
    texts = [(i, f"text {i} {common if i % 3 else ''} end {i * 7919}") for i in range(3000)]
    needles = [("all", common), ("some", common + " end 55433"), ("none", common + "!"), ("one", "text 17 ")]
    assert found(spark, texts, needles) == pairs(texts, needles)


def test_tasks_by_map_id_and_text(spark):
    options = lambda *x: [("flight", list(x), ["F1", "F2", "F3"])]
    tasks = spark.createDataFrame([("t1", "Book a  FLIGHT to Rome", options("F1")), ("t2", "book a flight to rome", options("F2")), ("t3", "find a hotel", []), ("t4", "", [])], "task string, initial string, options array<struct<aspect:string,correct:array<string>,every:array<string>>>")
    chosen = spark.createDataFrame([("p#1", "t3"), ("1", "t1"), ("9", "gone")], "place string, task string")
    rome = "Please book a flight\nto Rome now"
    records = [
        ("map", ["p#1", "1"], "t2", rome), ("index", ["q#1", "1"], None, ""), ("lost", ["9"], "t2", rome), ("id", None, "t2", "x"), ("bad-id", [], "zz", "we FIND a hotel"), ("both", [], None, rome), ("right", [], None, rome),
        ("option", [], None, rome), ("draw", [], None, rome), ("none", [], None, "hello"), (None, None, None, None), ("other", [], None, rome + " and find a hotel"),
    ]
    answers = [("right", "flight", " f2"), ("draw", "flight", "F3"), ("option", "hotel", "F1"), ("other", "flight", "F1"), ("other", "flight", "F3")]
    df = spark.createDataFrame(records, "record string, places array<string>, said string, users string")
    got = substrings.resolved(df, "record", tasks, chosen, spark.createDataFrame(answers, "record string, aspect string, answer string"))
    assert {r.record: (r.task, r.tier) for r in got.collect()} == {
        "map": ("t3", "map"), "index": ("t1", "map"), "lost": (None, None), "id": ("t2", "id"), "bad-id": ("t3", "text"), "both": (None, None), "right": ("t2", "text"), "option": (None, None), "draw": (None, None), "none": (None, None), None: (None, None),
        "other": ("t1", "text"),
    }
    assert got.count() == len(records) and F is not None


def test_tasks_are_found_whatever_the_case_of_a_sharp_s(spark):
    # Arrange
    records = spark.createDataFrame([(1, None, None, "Die Stra\u00dfe nach Gie\u00dfen bitte"), (2, None, None, "STRASSE NACH GIESSEN"), (3, None, None, "Die Strase nach Giesen")], "r long, places array<string>, said string, users string")
    tasks = spark.createDataFrame([("t", "STRA\u1e9eE  nach\nGiessen", [])], "task string, initial string, options array<struct<aspect:string,correct:array<string>,every:array<string>>>")
    chosen = spark.createDataFrame([], "place string, task string")
    answers = spark.createDataFrame([], "r long, aspect string, answer string")

    # Act
    got = {x.r: (x.task, x.tier) for x in substrings.resolved(records, "r", tasks, chosen, answers).collect()}

    # Assert
    assert got == {1: ("t", "text"), 2: ("t", "text"), 3: (None, None)}


def test_grams_are_arrays_for_every_class_and_no_text(spark):
    kinds = list(range(len(substrings.CLASSES)))
    texts = ["", None, "abc", "\u00e4" * 40, "the quick brown fox jumps over the lazy dog " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", substrings._grams(kinds)(F.col("t")).alias("g"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString() and str(substrings._grams(kinds).evalType) == "250"
    for r in df.collect():
        data = substrings.np.frombuffer((texts[r.i] or "").encode(), substrings.np.uint8)
        assert [tuple(x) for x in r.g] == [(k, h) for k in kinds for h in substrings._window_minima(data, *substrings.CLASSES[k][1:]).tolist()]
