"""Keyed work and retry state: a stream that stops and goes on agrees with a scan of the whole table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trellis.streaming import keyed

EPOCH = dt.datetime(2024, 1, 1)
EVENTS = "key string, event string, at timestamp, n long"


def drain(df, where, sink):
    """Run all there is, from the checkpoint on; rows in the order in which batches gave them."""
    q = df.writeStream.foreachBatch(lambda b, i: b.withColumn("batch_id", F.lit(i)).write.mode("append").parquet(f"{where}/{sink}")).option("checkpointLocation", f"{where}/c-{sink}").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()


def test_work_goes_on_from_a_checkpoint(spark, tmp_path):
    keyed.use_store(spark)
    draw = random.Random(3)
    rows, at = [], 0
    for n in range(600):
        at += draw.randint(1, 240)
        rows.append((f"k{draw.randint(0, 11)}", draw.choice([*keyed.EVENTS, "claim", "claim", "nonsense"]), EPOCH + dt.timedelta(seconds=at), n))
    rows.append(("z", "claim", EPOCH + dt.timedelta(seconds=at), 601))
    rows.append(("late", "claim", EPOCH + dt.timedelta(seconds=at - 20_000), 602))
    for part in (rows[:250], rows[250:], [("end", None, EPOCH + dt.timedelta(seconds=at + 900), 700)]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        drain(keyed.work_stream(src, "key", "event", "at", "n", ttl="1 hour", late="5 minutes"), tmp_path, "work")
    out = spark.read.parquet(str(tmp_path / "work"))
    assert out.select("batch_id").distinct().count() >= 3
    last = {}
    for r in sorted(out.collect(), key=lambda r: (r.n_events, r.batch_id)):
        last[r.key] = (r.status, r.reconcile_required, r.n_events, r.n_refused)
    until = EPOCH + dt.timedelta(seconds=at + 900 - 300)
    table = keyed.work_table(spark.read.parquet(str(tmp_path / "in")), "key", "event", "at", "n", ttl="1 hour", until=until)
    assert last == {r.key: tuple(r)[1:] for r in table.collect()}
    assert {"success", "in_flight", "abandoned"} <= {s for s, *_ in last.values()} and last["late"][0] == "abandoned" and last["z"][0] == "in_flight"


def test_rules_of_work():
    def run(*events, ttl=100):
        state, taken = keyed.NEW, []
        for e in events:
            e, at = e if isinstance(e, tuple) else (e, 0)
            state, ok = keyed.work_step(state, e, at, ttl)
            taken.append(ok)
        return state[0], state[2], taken

    assert run("claim", "claim", "success", "invalid", "error", "claim") == ("success", False, [True, False, True, False, False, False])
    assert run("invalid", "claim", "success") == ("success", False, [True, False, True])
    assert run("error", "claim", "abandon", "claim") == ("abandoned", False, [True, True, True, False])
    assert run("claim", "error_final", "claim", "retry", "claim") == ("in_flight", False, [True, True, False, True, True])
    assert run("error_final", "settle", "claim")[0] == "in_flight" and run("settle", "retry", None, "x") == (None, False, [False] * 4)
    assert run(("claim", 0), ("claim", 99)) == ("in_flight", False, [True, False]) and run(("claim", 0), ("claim", 100)) == ("abandoned", False, [True, False])
    assert run(("claim", 0), ("success", 100)) == ("success", False, [True, True]) and run(("claim", None)) == (None, False, [False])


def test_empty_and_null_tables(spark):
    none = spark.createDataFrame([], EVENTS)
    assert keyed.work_table(none, "key", "event", "at", "n").collect() == []
    odd = spark.createDataFrame([(None, "claim", EPOCH, 1), (None, "success", None, 0), ("a", None, None, None)], EVENTS)
    assert {r.key: tuple(r)[1:] for r in keyed.work_table(odd, "key", "event", "at", "n").collect()} == {None: ("in_flight", False, 2, 1), "a": (None, False, 1, 1)}
    assert keyed.retry_table(spark.createDataFrame([], "k string, u long, b long, g long"), "k", "u", "b", "g").collect() == []


RETRY = [("a", 1, 0, 0), ("a", 1, 1, 1), ("a", 1, 2, 1), ("a", 2, 0, 0), ("a", 2, 1, None), ("a", 3, 0, 0), ("a", 4, 0, 1), ("b", 1, 0, 1), ("b", 2, 0, 0), ("b", 3, 0, 2), ("b", 4, 0, 0)]


def test_retries_end_after_too_many_skips(spark, tmp_path):
    limits = {"required": 1, "batches": 2, "skips": 1}
    spec = "k string, u long, b long, g long"
    want = {
        ("a", 1, 0): (True, False, 0, False), ("a", 1, 1): (True, True, 0, False), ("a", 1, 2): (False, True, 0, False), ("a", 2, 0): (True, False, 0, False), ("a", 2, 1): (True, False, 0, False),
        ("a", 3, 0): (True, False, 1, False), ("a", 4, 0): (False, False, 2, True), ("b", 1, 0): (True, True, 0, False), ("b", 2, 0): (True, False, 0, False), ("b", 3, 0): (True, True, 1, False), ("b", 4, 0): (True, False, 0, False),
    }
    df = spark.createDataFrame([*RETRY, ("a", None, 0, 1)], spec)
    assert {(r.k, r.update, r.batch): tuple(r)[3:] for r in keyed.retry_table(df, "k", "u", "b", "g", **limits).collect()} == want
    keyed.use_store(spark)
    for part in (RETRY[:5] + RETRY[7:9], RETRY[5:7] + RETRY[9:]):
        spark.createDataFrame(part, spec).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(keyed.retry_stream(spark.readStream.schema(spec).parquet(str(tmp_path / "in")), "k", "u", "b", "g", **limits), tmp_path, "retry")
    assert {(r.k, r.update, r.batch): tuple(r)[3:7] for r in spark.read.parquet(str(tmp_path / "retry")).collect()} == want


@pytest.mark.parametrize("span,ms", [("10 minutes", 600_000), ("1 hour", 3_600_000), ("0.5 second", 500)])
def test_spans(span, ms):
    assert keyed._millis(span) == ms
