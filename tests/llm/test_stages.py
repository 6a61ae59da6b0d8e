"""Every stage of the pipeline on tables with nulls, blanks, long texts, repeated rows and extra columns, and on none."""

import pytest

import corpus_pipeline

SPEC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 3000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t", None, "a", 2), (4, "one two three", "en", "b", 13), (4, "one two three", "en", "b", 13), (None, "no id here at all", "en", "b", 5), (5, LONG, "en", "b", 9),
    (6, "password = abcdefgh12", "fr", None, 20), (7, "same words as the next one has them", "en", "c", 1), (8, "same words as the next one has them", "en", "c", 1),
]


@pytest.fixture(params=["labels", "no labels"])
def folder(request, spark, tmp_path):
    labels = [(1, 1, 0), (4, 1, 0), (5, 1, 0), (2, 0, 0), (None, None, None), (7, 1, 0)] if request.param == "labels" else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ROWS, SPEC).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_odd_rows(spark, folder):
    docs = spark.createDataFrame(ROWS, SPEC)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name != "pack":
            assert out.columns == docs.columns
        if name == "quality":
            assert set(ids) <= {r[0] for r in ROWS}
        if name == "near_dedup":
            assert sorted(map(str, ids)) == ["1", "2", "3", "4", "5", "6", "7", "None"]
        if name == "secrets":
            held = {r.doc_id: r.text for r in out.collect()}
            assert len(ids) == len(ROWS) and held[1] is None and held[4] == "one two three" and "abcdefgh12" not in held[6] and held[5] == LONG
        if name == "mix":
            assert ids.count(1) == ids.count(2) == ids.count(3) == 1 and {4, 5, 6, 7, 8, None} <= set(ids)
        if name == "pack":
            assert {r[0] for r in ROWS} == set(ids) and ids.count(1) == 1 and ids.count(4) == 2 and ids.count(5) > 10


def test_no_rows(spark, folder):
    docs = spark.createDataFrame([], SPEC)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_whole_run_on_odd_rows(spark, folder):
    placed = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert placed and all(sum(n for _, n in v) <= 1024 and sorted(v)[0][0] == 0 for v in placed.values())
