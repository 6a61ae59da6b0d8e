"""Records out of JSON files of any of the usual shapes, with the place and the reason of what is no record."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.jsons import parsed

#: Fixed value: what a teacher's cache says of itself.
CACHE = "travelgym-teacher-cache-v1"
_OUT = "struct<source_index:long,env_name:string,key:string,gold:string,pass_index:long,record:string,report:string>"


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files as file, line (from 1) and text.

    A large file is read by many tasks. A line's number is its place in its block and the lines of the
    blocks before it: a task's rows are numbered without gaps, and only counts of blocks are summed.
    """
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    blocks = rows.groupBy("file", "_b").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "_b", (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(blocks, ["file", "_b"]).select("file", (F.col("_i") + F.col("_shift")).alias("line"), F.col("value").alias("text"))


def _why(text: Column) -> Column:
    """Why a text is no JSON, with line and column; only bad texts come here."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                json.loads(t)
            except (TypeError, ValueError) as e:
                return str(e)
            return "too large or too deep"

        return texts.map(one)

    return F.pandas_udf(run, "string")(text)


def unpacked(df: DataFrame, text: str) -> DataFrame:
    """The records of whole documents: the other columns, source_index, env_name, key, gold, pass_index, record, report
    (JSON texts) and reason (null for a record).

    A document is a list of records, an object with a list under data, a teacher's cache (its successes), or
    an evaluator's cache of environments (names that don't begin with _), tasks and attempts. What stands
    where a record should and is no object is a row with reason not_an_object; a document of another shape
    is one with no_records. A text that is no JSON is a row with the parser's words. Null texts are no JSON.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    t = F.col(f"`{text}`")
    entry = lambda i, record, env=None, key=None, gold=None, pass_index=None, report=None: F.struct(
        i.cast("long").alias("source_index"), *[(F.lit(None).cast("string") if x is None else x).alias(n) for n, x in (("env_name", env), ("key", key), ("gold", gold))],
        (F.lit(None).cast("long") if pass_index is None else pass_index).alias("pass_index"), record.alias("record"), (F.lit(None).cast("string") if report is None else report).alias("report"),
    ).cast(_OUT)
    listed = lambda xs: F.transform(xs, lambda x, i: entry(i, x))
    top = F.from_json(t, "schema_version string, data string, records string")
    whole = F.from_json(t, "array<string>")
    data = F.when(top["data"].startswith("["), F.from_json(top["data"], "array<string>"))
    teacher = F.map_entries(F.from_json(top["records"], "map<string,struct<status:string,trajectory:string,provenance:struct<task_key:string,env_name:string,task_id:string,pass_index:long>>>"))
    won = F.filter(F.transform(teacher, lambda e, i: F.struct(i.alias("i"), e["key"].alias("k"), e["value"].alias("v"))), lambda x: F.coalesce(x["v"]["status"] == "success", F.lit(False)))
    passes = F.transform(won, lambda x: entry(x["i"], x["v"]["trajectory"], x["v"]["provenance"]["env_name"], x["k"], x["v"]["provenance"]["task_id"], x["v"]["provenance"]["pass_index"]))
    several = lambda x: F.when(x.isNull(), F.array().cast("array<string>")).when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    envs = F.filter(F.map_entries(F.from_json(t, "map<string,string>")), lambda e: ~e["key"].startswith("_") & F.coalesce(e["value"].startswith("{"), F.lit(False)))
    tasks = F.flatten(F.transform(envs, lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,struct<gold:string,data:string,reward_report:string>>")), lambda k: F.struct(e["key"].alias("env"), k["key"].alias("task"), k["value"].alias("v")))))
    attempts = F.flatten(F.transform(F.filter(tasks, lambda k: k["v"].isNotNull()), lambda k: F.transform(several(k["v"]["data"]), lambda r, i: entry(i, r, k["env"], k["task"], k["v"]["gold"], None, F.get(several(k["v"]["reward_report"]), i)))))
    plain = F.to_json(parsed(t))
    is_teacher = (top["schema_version"] == CACHE) & F.coalesce(top["records"].startswith("{"), F.lit(False))
    found = F.when(plain.startswith("["), listed(whole)).when(plain.startswith("{") & data.isNotNull(), listed(data)).when(plain.startswith("{") & is_teacher, passes).when(plain.startswith("{"), attempts)
    held = df.select(*rest, t.alias("_t"), plain.isNull().alias("_bad"), found.alias("_f"))
    good = held.where(~F.col("_bad")).select(*rest, F.explode_outer("_f").alias("_r")).select(*rest, "_r.*")
    shape = F.when(F.col("source_index").isNull(), "no_records").when(~F.coalesce(F.ltrim("record").startswith("{"), F.lit(False)), "not_an_object")
    bad = held.where("_bad").select(*rest, *[F.lit(None).cast(k).alias(n) for n, k in (("source_index", "long"), ("env_name", "string"), ("key", "string"), ("gold", "string"), ("pass_index", "long"))], F.col("_t").alias("record"), F.lit(None).cast("string").alias("report"), _why(F.col("_t")).alias("reason"))
    return good.withColumn("reason", shape).unionByName(bad)


def read_any(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, bad) of a folder or files of JSON documents and JSON Lines together.

    Records are as ``unpacked``, with file, line (null in documents) and source_index (the record's place in its
    document, or its line from 0); bad rows are file, line, reason and text. A file is a document if its
    first line that isn't blank isn't a whole object, or is the only line, and the file parses as a whole;
    all others are read line by line, by as many tasks as they have blocks. Blank lines don't count. Only
    documents are read whole, each by one task. Empty files give nothing.
    """
    lines = numbered_lines(spark, paths).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")
    one = lambda c: F.coalesce(F.to_json(parsed(c)).startswith("{"), F.lit(False))
    files = lines.groupBy("file").agg(F.min_by("text", "line").alias("_head"), F.count("*").alias("_n"))
    maybe = [r.file for r in files.where(~one(F.col("_head")) | (F.col("_n") == 1)).select("file").collect()]
    none = lines.select("file", F.lit("").alias("text")).limit(0)
    texts = spark.read.text(maybe, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")) if maybe else none
    whole = texts.where(parsed(F.col("text")).isNotNull())
    documents = unpacked(whole, "text").withColumn("line", F.lit(None).cast("long"))
    rows = lines.join(whole.select("file"), "file", "left_anti").withColumn("_plain", F.to_json(parsed(F.col("text"))))
    empty = {c: F.lit(None).cast("long" if c == "pass_index" else "string") for c in ("env_name", "key", "gold", "pass_index", "report")}
    good = rows.where(F.col("_plain").startswith("{")).select("file", "line", (F.col("line") - 1).alias("source_index"), F.col("text").alias("record"), *[v.alias(k) for k, v in empty.items()])
    bad_lines = rows.where(F.col("_plain").isNotNull() & ~F.col("_plain").startswith("{")).select("file", "line", F.lit("not_an_object").alias("reason"), "text")
    broken = rows.where("_plain is null").select("file", "line", _why(F.col("text")).alias("reason"), "text")
    records = documents.where("reason is null").drop("reason").unionByName(good)
    bad = documents.where("reason is not null").select("file", "line", "reason", F.col("record").alias("text")).unionByName(bad_lines).unionByName(broken)
    return records, bad
