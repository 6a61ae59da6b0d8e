"""From raw documents to packed sequences: five stages, each of which calls one operator of trellis.llm.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of documents, other columns untouched. Null ids, languages and sources stay as
they are; a null text is an empty one; ties are decided by ids and hashes, so that reruns agree; an empty
table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import dsir, minhash, mixing, packing, secrets
from trellis.llm.common import Workspace
from trellis.llm.queries import label_weights, tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps. A text without words, null ones too, has a log weight of 0 and
    stays or goes by the cut; without any labels all documents stay. Repeated rows are weighed alike."""
    return dsir.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; of rows that repeat
    it, one. Documents without words are like no other and all stay; a document without an id stays."""
    return minhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; rows without a finding are as they were, null texts stay null."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a source cut to the words that it is short of.
    Null sources are a source. Documents without words stay once; documents without labels weigh as
    good ones."""
    return mixing.apply_mix(docs, quality=label_weights(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies. An empty or null text is one piece, its end; repeated rows have
    pieces of their own."""
    return packing.pack(tokens(docs))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mix", mix), ("pack", pack)]

#: Importance resampling and the linear program have no SQL form; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again. No documents give no pieces."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
