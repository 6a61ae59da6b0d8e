"""Files of all shapes in one folder: every record and every bad line is found where it stands."""

import json

from pyspark.sql import functions as F

from trellis.sources import records


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    text = "".join(f"line {i} " + "x" * (i % 50) + ("\r\n" if i % 7 == 0 else "\n") for i in range(1, 6001))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("\n\nlast")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = records.numbered_lines(spark, str(tmp_path))
        assert lines.select(F.spark_partition_id()).distinct().count() >= 1
        got = {(r.file[-5:], r.line): r.text for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 6003 and all(got["a.txt", i].split(" ")[1] == str(i) for i in range(1, 6001)) and got["b.txt", 3] == "last" and got["b.txt", 1] == ""


CACHE = {"schema_version": "travelgym-teacher-cache-v1", "records": {"e::t::0": {"status": "success", "trajectory": {"m": 1}, "provenance": {"task_key": "e::t", "env_name": "e", "task_id": "t", "pass_index": 0}}, "e::t::1": {"status": "error"}, "x": {"status": "success", "trajectory": 5}}}
ENVS = {"_meta": {"t": {"data": [{"no": 1}]}}, "env": {"t1": {"gold": "g", "data": [{"a": 1}, 7, {"a": 2}], "reward_report": [{"r": 1}]}, "t2": {"data": {"single": True}, "reward_report": {"r": 2}}, "t3": {}}, "other": 3}


def test_a_mixed_folder(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("list.json", json.dumps([{"i": 0}, "text", {"i": 2, "t": 'é "{'}], indent=1, ensure_ascii=False))
    put("data.json", json.dumps({"data": [{"i": 0}, None], "other": 1}))
    put("cache.json", json.dumps(CACHE, indent=2))
    put("envs.json", json.dumps(ENVS))
    put("rows.jsonl", '{"i": 0}\n\n  \n{"i": 3}\n[1]\n{"i": \n"x"\n{"i": 7}')
    put("cut.json", '[\n{"i": 0},\n{"i": 1}\n')
    put("one.jsonl", '{"i": 9}')
    put("empty.json", "")
    put("blank.jsonl", "\n \n")
    good, bad = records.read_any(spark, str(tmp_path))
    found = {}
    for r in good.collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.source_index, r.env_name, r.key, r.gold, r.pass_index, json.loads(r.record), json.loads(r.report) if r.report else None))
    none = (None,) * 4
    assert {k: sorted(v, key=str) for k, v in found.items()} == {
        "list.json": [(None, 0, *none, {"i": 0}, None), (None, 2, *none, {"i": 2, "t": 'é "{'}, None)], "data.json": [(None, 0, *none, {"i": 0}, None)],
        "cache.json": [(None, 0, "e", "e::t::0", "t", 0, {"m": 1}, None)],
        "envs.json": [(None, 0, "env", "t1", "g", None, {"a": 1}, {"r": 1}), (None, 0, "env", "t2", None, None, {"single": True}, {"r": 2}), (None, 2, "env", "t1", "g", None, {"a": 2}, None)],
        "rows.jsonl": [(1, 0, *none, {"i": 0}, None), (4, 3, *none, {"i": 3}, None), (8, 7, *none, {"i": 7}, None)], "cut.json": [(3, 2, *none, {"i": 1}, None)],
    }
    wrong = {}
    for r in bad.collect():
        wrong.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.reason.split(":")[0]))
    assert {k: sorted(v, key=str) for k, v in wrong.items()} == {
        "list.json": [(None, "not_an_object")], "data.json": [(None, "not_an_object")], "cache.json": [(None, "not_an_object")], "envs.json": [(None, "not_an_object")],
        "rows.jsonl": [(5, "not_an_object"), (6, "Expecting value"), (7, "not_an_object")], "cut.json": [(1, "Expecting value"), (2, "Extra data")], "one.jsonl": [(None, "no_records")],
    }


def test_documents_in_a_table(spark):
    df = spark.createDataFrame([(1, "[]"), (2, None), (3, '{"data": []}'), (4, "5"), (5, '[{"a": 1}]'), (6, "{")], "id int, t string")
    got = {r.id: (r.source_index, r.reason if r.reason is None else r.reason.split(":")[0]) for r in records.unpacked(df, "t").collect()}
    assert got[1] == got[3] == got[4] == (None, "no_records") and got[5] == (0, None) and got[6][1].startswith("Expecting property name") and got[2][0] is None and got[2][1]
    assert records.unpacked(df.limit(0), "t").collect() == []
