import json

from pyspark.sql import functions as F

from trellis.sources import io
from trellis.streaming import incremental


def test_bad_rows_are_set_apart(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    good, bad = io.read_records(spark, str(p), "id long")
    assert sorted(r.id for r in good.collect()) == [1, 2] and bad.count() == 1
    (tmp_path / "b.json").write_text('[{"id": 1},\n {"id": 2}]')
    good, bad = io.read_records(spark, str(tmp_path / "b.json"), "id long")
    assert sorted(r.id for r in good.collect()) == [1, 2] and bad.count() == 0


def test_provenance_and_pairs(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "set22_rows"))
    df = io.with_provenance(spark.read.parquet(str(tmp_path / "set22_rows")), r"/(set\d+)_rows/", "env")
    assert {r.env for r in df.collect()} == {"set22"}
    pairs = io.paired(spark.createDataFrame([(1, [1, 2], ["a"])], "id long, x array<long>, y array<string>"), "x", "y")
    assert [(r.position, r.x, r.y) for r in pairs.collect()] == [(0, 1, "a"), (1, 2, None)]


def test_keyed_documents_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(json.dumps({"a": 1, "_b": 2}),)], "doc string")
    assert [(r.key, r.value) for r in io.keyed_documents(df, "doc", "long").collect()] == [("a", 1)]
    path = str(tmp_path / "cache")
    assert io.insert_new(spark, spark.createDataFrame([("k", 1), ("k", 2)], "key string, v long"), path, "key") == 1
    assert io.insert_new(spark, spark.createDataFrame([("k", 3), ("m", 4)], "key string, v long"), path, "key") == 1


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [(1, "k1", 1, True), (1, "k1", 2, True), (1, "k2", 3, True), (2, "k3", 1, True), (2, "k4", 2, False)]
    src = _stream(spark, tmp_path, rows, "task long, key string, step long, zero boolean")
    got = {r.task: (r.streak, r.admitted_at) for r in _run(incremental.streaks(src, "task", "step", "zero"), tmp_path, "streaks", "update").collect()}
    assert got == {1: (3, 3), 2: (0, None)}
    timed = src.withColumn("ts", F.timestamp_seconds("step"))
    assert _run(incremental.first_writes(timed, "key", "ts", late="1 hour"), tmp_path, "firsts", "append").count() == 4
    counts = _run(incremental.tumbling(timed.withColumn("value", F.lit(1.0)), "ts", "2 seconds", ["task"]), tmp_path, "tumbling", "complete")
    assert sum(r.n for r in counts.collect()) == 5
