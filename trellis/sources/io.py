"""Readers and writers: typed, with bad rows set apart rather than dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .once import OnceTable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows) of JSON Lines (.jsonl), JSON documents (.json, a list or one object) or parquet."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path), spark.createDataFrame([], "_corrupt string")
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = path.endswith(".json")
    text = spark.read.text(path, wholetext=whole).withColumn("_file", F.col("_metadata.file_path")).where(F.trim("value") != "")
    if whole:
        parsed = text.withColumn("_r", F.from_json("value", T.ArrayType(kind)))
        bad, good = parsed.where("_r is null"), parsed.select(F.explode("_r").alias("_r"))
    else:
        held = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
        parsed = text.withColumn("_r", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        bad, good = parsed.where("_r._corrupt is not null"), parsed.where("_r._corrupt is null")
    return good.select(*[F.col(f"_r.`{c}`") for c in kind.names]), bad.select("_file", F.col("value").alias("_corrupt"))


def with_provenance(df: DataFrame, pattern: str, *names: str) -> DataFrame:
    """Add a column for each group of ``pattern`` in the path of a row's file; null where it doesn't match."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def keyed_documents(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of a JSON object column: one for each key that doesn't begin with _, its value by schema."""
    parsed = F.from_json(F.col(column), f"map<string,{value}>")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(parsed).alias("key", "value")).where(~F.col("key").startswith("_"))


def paired(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row for each position of two arrays; the shorter has nulls."""
    rest = [c for c in df.columns if c not in (left, right)]
    return df.select(*rest, F.posexplode(F.arrays_zip(left, right)).alias("position", "_p")).select(*rest, "position", f"_p.{left}", f"_p.{right}")


def write_by_class(df: DataFrame, path: str, column: str) -> None:
    """One folder a class; the committer makes the write whole or nothing."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def insert_new(spark: SparkSession, df: DataFrame, path: str, key: str) -> int:
    """Add rows whose key the table at ``path`` lacks, one a key; their number. Two writers may do so at once: see
    ``once.OnceTable``, which also reads the table."""
    return OnceTable(spark, path).insert(df, uuid.uuid4().hex, key)


def tree_digest(spark: SparkSession, path: str) -> str:
    """The first 16 hex digits of a sha256 over names and contents of a folder, in order of name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = files.select(F.sha2(F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)), 256).alias("h"), "path")
    return one.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"])), 256).alias("d")).first().d[:16]


def rewrite_column(spark: SparkSession, path: str, target: str, column: str, change) -> int:
    """Write the parquet table at ``path`` to ``target`` with ``change`` of a column, compressed by zstd;
    the number of rows that change. Where none does, nothing is written: the table is as it should be."""
    df = spark.read.parquet(path)
    new = change(F.col(f"`{column}`"))
    changed = df.where(~new.eqNullSafe(F.col(f"`{column}`"))).count()
    if changed:
        df.withColumn(column, new).write.mode("errorifexists").option("compression", "zstd").parquet(target)
    return changed


def with_row_index(df: DataFrame) -> DataFrame:
    """A parquet table's rows with source_path (the file's name) and source_index (the row's place in it)."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return df.select("*", name.alias("source_path"), F.col("_metadata.row_index").alias("source_index"))


def at_places(manifest: DataFrame, rows: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of ``rows`` (with source_path and source_index) at a manifest's places, with match: whether the
    manifest's id (``own``) is the row's (``other``). A place without a row has match false."""
    held = rows.withColumn("_id", F.col(other).cast("string"))
    out = manifest.join(held.drop(*[c for c in held.columns if c in manifest.columns and c not in ("source_path", "source_index")]), ["source_path", "source_index"], "left")
    return out.withColumn("match", F.coalesce(F.col(own).cast("string") == F.col("_id"), F.lit(False))).drop("_id")
