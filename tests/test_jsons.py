"""JSON of any shape against Python's own."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from trellis.functions import jsons
from trellis.functions import text as tx


def grown(draw, depth=0):
    kind = draw.random()
    if depth < 5 and kind < 0.3:
        return {draw.choice(['a', 'B"q', "c/d", "é", "task", "\\", "k:"]) + str(draw.randint(0, 3)): grown(draw, depth + 1) for _ in range(draw.randint(0, 4))}
    if depth < 5 and kind < 0.5:
        return [grown(draw, depth + 1) for _ in range(draw.randint(0, 4))]
    return draw.choice([None, True, 0, -7, 10**15, 1.5, -0.25, "", 'say "x": 1', "line\nbreak\t", "漢字🙂", "\\", 'k":'])


def flat(x, path=""):
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in flat(v, f"{path}/{k}")]
    if isinstance(x, list):
        return [(f"{path}/list_len"[1:], len(x)), *[y for i, v in enumerate(x) for y in flat(v, f"{path}/{i}")]]
    return [(path[1:], x)]


def names(x):
    if isinstance(x, dict):
        return set(x) | {k for v in x.values() for k in names(v)}
    return {k for v in x for k in names(v)} if isinstance(x, list) else set()


def test_random_documents(spark):
    draw = random.Random(8)
    docs = [{"d": grown(draw)} for _ in range(150)] + [[grown(draw)] for _ in range(20)] + ["text", 5, None]
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(docs)] + [(900, "{"), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r for r in df.select("i", jsons.keys_anywhere(F.col("t")).alias("k"), jsons.canonical_json(F.col("t")).alias("c"), jsons.canonical_hash(F.col("t")).alias("h")).collect()}
    walked = {}
    for r in jsons.flattened(df, ["i"], "t").collect():
        walked.setdefault(r.i, []).append((r.key, json.loads(r.value)))
    for i, d in enumerate(docs):
        want = json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert set(got[i].k) == names(d) and got[i].c == want and got[i].h == hashlib.sha256(want.encode()).hexdigest()
        assert sorted(walked.get(i, []), key=str) == (sorted(flat(d), key=str) if isinstance(d, dict | list) else [])
    assert all((got[i].k, got[i].c, got[i].h) == (None, None, None) for i in (900, 901, 902)) and not {900, 901, 902} & walked.keys()


def test_one_value_and_nothing_else(spark):
    texts = ["1", " {} ", '{"a": 1},', '{"a": 1}{"b": 2}', "1, 2", '1, "y": 2', '1, "v": 2', "1] [2", '1} {"v": 2', "[1,]", "nul", "null", "", " ", '"a" b', "[1]\n[2]", None, "tru e", "-1.5e3", "01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(jsons.parsed(F.col("t")).isNotNull()).collect()] == [t in ("1", " {} ", "null", "-1.5e3") for t in texts]


def test_hashes_tell_rows_apart(spark):
    df = spark.createDataFrame([("1", 'x,"b":y', None), ("x", None, [1]), ('x","b":"y', None, [1])], "a string, b string, c array<int>").withColumn("n", F.lit(1))
    rows = df.select(tx.content_hash("a", "b").alias("h"), tx.content_hash("b", "a").alias("g"), tx.content_hash("n").alias("n"), tx.content_hash("c", "a").alias("c")).collect()
    assert len({r.h for r in rows}) == 3 and all(r.h == r.g for r in rows)
    assert rows[0].h == hashlib.sha256(json.dumps({"a": "1", "b": 'x,"b":y'}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert rows[0].n != spark.range(1).select(tx.content_hash("id")).first()[0] and rows[1].c == hashlib.sha256(b'{"a":"x","c":[1]}').hexdigest()


def test_record_hash_leaves_private_parts_out(spark):
    one = {"messages": [{"role": "user", "_canonical_errors": ["x"], "content": "é"}], "tools": [1], "assistant_train_mask": [0]}
    other = {"tools": [1], "messages": [{"content": "é", "role": "user"}], "enable_thinking": True, "schema_version": "v"}
    df = spark.createDataFrame([(json.dumps(x),) for x in (one, other, {**other, "enable_thinking": False})] + [("[]",), (None,)], "t string")
    h = [r[0] for r in df.select(jsons.record_hash(F.col("t"), schema="v")).collect()]
    assert h[0] == h[1] != h[2] and h[3] is None and h[4] is None


def test_observations(spark):
    cases = [
        ('{"a": 1, "b": {"Gold": 1}}', ["forbidden:Gold"]), ('{"a": {"g\\u006fld": []}}', ["missing:b", "forbidden:gold"]), ('{"a": "gold\\": 1", "b": "gold"}', []), ("[]", ["not_an_object"]), (None, ["not_an_object"]), ("{", ["not_an_object"]),
        ('{"a": "terminal reward : 1", "b": "p7"}', ["reward", "preference"]), ('{"b": "xP7", "a": "rewards"}', []),
    ]
    df = spark.createDataFrame(cases, "t string, want array<string>")
    assert [r[0] for r in df.select(jsons.observation_faults(F.col("t"), ["a", "b"], ["gold"])).collect()] == [w for _, w in cases]


def test_depth_has_a_bound_and_empty_tables_none(spark):
    import pytest

    df = spark.createDataFrame([(1, '{"a":' * 9 + "1" + "}" * 9)], "i int, t string")
    assert [(r.key, r.number) for r in jsons.flattened(df, ["i"], "t").collect()] == [("/".join("a" * 9), 1.0)]
    with pytest.raises(ValueError, match="deeper"):
        jsons.flattened(df, ["i"], "t", deepest=4)
    none = jsons.flattened(df.limit(0), ["i"], "t")
    assert none.collect() == [] and none.columns == ["i", "key", "value", "number"]


def test_guards_parse_a_text_once(spark):
    df = spark.createDataFrame([('{"a": 1, "GOLD": {"t\\u0061sk": []}, "say": "reward: 2"}',), ('{"a": 1}, "v": 2',), ("7",), (None,)], "t string")
    got = df.select(jsons.observation_faults(F.col("t"), ["a", "b"], ["gold", "task"]).alias("x"))
    assert [r.x for r in got.collect()] == [["missing:b", "forbidden:GOLD", "forbidden:task", "reward"], ["not_an_object"], ["not_an_object"], ["not_an_object"]]
    assert str(jsons.observation_faults(F.col("t"), ["a", "b"], ["gold", "task"])).count("try_parse_json") == 1


def test_hashes_are_made_text_by_text(spark):
    df = spark.createDataFrame([('{"b": 1.50, "a": "\u00df\\u001f"}',), ("no",), (None,)], "t string")
    got = [r.h for r in df.select(jsons.canonical_hash(F.col("t")).alias("h")).collect()]
    assert got == [hashlib.sha256('{"a":"\u00df\\u001f","b":1.5}'.encode()).hexdigest(), None, None]
    plan = df.select(jsons.canonical_hash(F.col("t")).alias("h"))._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and "run(" in plan


def test_walk_parses_once_and_keeps_no_level(spark):
    df = spark.createDataFrame([(i, json.dumps({"a": [i, {"b": [None, "x"]}], "c": {}})) for i in range(20)], "i int, t string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = jsons.flattened(df, ["i"], "t")
    assert {(r.key, r.value) for r in out.where("i = 3").collect()} == {("a/list_len", "2"), ("a/0", "3"), ("a/1/b/list_len", "2"), ("a/1/b/0", "null"), ("a/1/b/1", '"x"')}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before and plan.count("parseJson") == 1
    assert not any(word in plan for word in ("InMemoryTableScan", "Exchange", "Union"))


def test_walk_of_empty_parts_brackets_in_texts_and_bounds(spark):
    texts = ['[]', '{}', '[[]]', '{"": []}', '{"": {"": 1}}', '[[[], 1], {"a": {}}]', '{"[{": "[[[[[[[[\\"{{{"}', '{"a": "' + "[" * 99 + '"}', "[" * 99, "[" * 99 + "]" * 98, '"[["', "[1] [[[[[", None, "[[[[1]]]]"]
    df = spark.createDataFrame(list(enumerate(texts)), "pos int, key_ string").toDF("pos", "a.b")
    got = {}
    for r in jsons.flattened(df, ["pos"], "a.b", deepest=4).collect():
        got.setdefault(r.pos, []).append((r.key, json.loads(r.value)))
    for i, t in enumerate(texts):
        try:
            want = json.loads(t or "1")
        except ValueError:
            want = 1
        assert sorted(got.get(i, []), key=str) == (sorted(flat(want), key=str) if isinstance(want, dict | list) else []), t
    assert df.select(jsons.nesting(F.col("`a.b`"))).first()[0] == 1


def test_numbers_of_flat_keys(spark):
    df = spark.createDataFrame([(1, '[1, -0.5, 1e3, 12345678901234567890, true, false, null, "7", "null", "Infinity"]')], "i int, t string")
    got = {r.key: r.number for r in jsons.flattened(df, ["i"], "t").collect()}
    assert [got[str(k)] for k in range(10)] == [1.0, -0.5, 1000.0, 12345678901234567890.0, None, None, None, None, None, None] and got["list_len"] == 10.0
