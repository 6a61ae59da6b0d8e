"""Repeated batches, two writers and killed writers change nothing that they mustn't."""

import json

import pytest
from pyspark.sql import functions as F

from trellis.sources import once


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "k string, v long")


def held(table):
    df = table.read()
    return [] if df is None else sorted((tuple(r) for r in df.collect()), key=str)


def test_batches_and_keys_come_once(spark, tmp_path):
    t = once.OnceTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.commits() == []
    assert t.insert(rows(spark, ("a", 1), ("b", 2), (None, 3), (None, 4)), "s/0", "k") == 3
    assert t.insert(rows(spark, ("c", 9)), "s/0", "k") == 0
    assert t.insert(rows(spark, ("a", 5), ("c", 6), (None, 7)), "s/1", "k") == 1
    assert t.insert(rows(spark, ("a", 5)), "s/2", "k") == 0 and t.insert(rows(spark).limit(0), "s/3", "k") == 0
    got = held(t)
    assert [k for k, _ in got] == ["a", "b", "c", None] and ("a", 1) in got and ("c", 6) in got
    assert [c["n"] for c in t.commits()] == [3, 1, 0, 0]
    log = once.OnceTable(spark, str(tmp_path / "log"))
    assert log.insert(rows(spark, ("a", 1)), "x") == 1 and log.insert(rows(spark, ("a", 1)), "y") == 1 and len(held(log)) == 2


@pytest.mark.parametrize("others,want", [([("a", 7), ("d", 8)], ["a7", "b2", "d8"]), ([("x", 7)], ["a1", "b2", "x7"]), ([("aa", 7)], ["a1", "aa7", "b2"])])
def test_two_writers(spark, tmp_path, monkeypatch, others, want):
    """Another writer commits between our writing and our commit."""
    t = once.OnceTable(spark, str(tmp_path))
    commit, write, state = t._commit, t._write, {"late": True, "writes": 0}

    def late(number, entry):
        if state["late"]:
            state["late"] = False
            assert once.OnceTable(spark, str(tmp_path)).insert(rows(spark, *others), "other/0", "k") == len(others)
        return commit(number, entry)

    def counted(*a):
        state["writes"] += 1
        return write(*a)

    monkeypatch.setattr(t, "_commit", late)
    monkeypatch.setattr(t, "_write", counted)
    t.insert(rows(spark, ("a", 1), ("b", 2)), "mine/0", "k")
    assert [f"{k}{v}" for k, v in held(t)] == want and state["writes"] == (1 if others == [("x", 7)] else 2)


def test_a_killed_writer_and_hopeless_ones(spark, tmp_path, monkeypatch):
    t = once.OnceTable(spark, str(tmp_path))
    t.insert(rows(spark, ("a", 1)), "s/0", "k")
    t._write(rows(spark, ("b", 2)), "part-dead", "k", t.commits())
    assert held(t) == [("a", 1)] and t.insert(rows(spark, ("b", 3)), "s/1", "k") == 1 and held(t) == [("a", 1), ("b", 3)]
    monkeypatch.setattr(once, "TRIES", 2)
    monkeypatch.setattr(t, "_commit", lambda *a: False)
    with pytest.raises(once.Conflict):
        t.insert(rows(spark, ("c", 3)), "s/2", "k")
    assert held(t) == [("a", 1), ("b", 3)]


def test_a_stream_that_repeats_its_batches(spark, tmp_path):
    spec = "k string, v long, secret string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def run(checkpoint):
        put = once.once_sink(target, "events", "k", keep=["k", "v"])
        q = spark.readStream.schema(spec).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()

    spark.createDataFrame([("a", 1, "s"), ("b", 2, "s"), ("a", 3, "s")], spec).coalesce(1).write.parquet(source)
    run("c")
    first = held(once.OnceTable(spark, target))
    spark.createDataFrame([("b", 9, "s"), ("c", 4, "s")], spec).coalesce(1).write.mode("append").parquet(source)
    run("c")
    run("lost")  # a new checkpoint gives batch 0 again, with all rows
    t = once.OnceTable(spark, target)
    assert [k for k, _ in held(t)] == ["a", "b", "c"] and set(first) < set(held(t)) and t.read().columns == ["k", "v"]
    assert json.dumps(t.commits()) and t.read().agg(F.count("*")).first()[0] == 3
