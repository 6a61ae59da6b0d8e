"""Joins by identity, content and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import in_order


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): each left row with the first right row of its key, and rows without one."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*[c for c in right.columns if c != key]), order).alias("_r"))
    return left.join(first, key).select(*left.columns, "_r.*"), left.join(first, key, "left_anti")


def tiered(left: DataFrame, tiers: list[tuple[DataFrame, Column, str]], key: str) -> DataFrame:
    """Add match and tier: the value of the first tier (table, condition, column) that has one; a tier's
    table holds one row for each left row at most."""
    held = left
    for i, (right, on, value) in enumerate(tiers):
        held = held.join(right.withColumnRenamed(value, f"_m{i}"), on, "left").select(*left.columns, *[f"_m{j}" for j in range(i + 1)])
    tier = F.lit(None).cast("int")
    for i in reversed(range(len(tiers))):
        tier = F.when(F.col(f"_m{i}").isNotNull(), i + 1).otherwise(tier)
    return held.withColumns({"match": F.coalesce(*[F.col(f"_m{i}") for i in range(len(tiers))]), "tier": tier}).drop(*[f"_m{i}" for i in range(len(tiers))])


def same_rows(left: DataFrame, right: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """Join two halves of a batch on the row key; rows whose shared columns differ come out flagged."""
    other = right.select(key, *[F.col(c).alias(f"_o_{c}") for c in shared], *[c for c in right.columns if c != key and c not in shared])
    same = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return left.join(other, key).withColumn("conflict", ~same).drop(*[f"_o_{c}" for c in shared])


def by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], shared: list[str]) -> DataFrame:
    """Join the rows of two tables one by one, the first of each in its order with the first of the other. Columns
    that both have must be named in ``shared`` and be equal in every row, and the tables equally long;
    otherwise reading the result fails. Places come by ranges, so neither table is one task; rows that are
    equal in their order may trade places."""
    a, b = in_order(left, [], left_order, "_at"), in_order(right, [], right_order, "_bt")
    both = b.select(F.col("_bt"), *[F.col(c).alias(f"_o_{c}") for c in shared], *[c for c in right.columns if c not in shared])
    out = a.join(both, F.col("_at") == F.col("_bt"), "full")
    fault = F.when(F.col("_at").isNull() | F.col("_bt").isNull(), F.lit("tables of different length"))
    for c in shared:
        fault = fault.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.concat(F.lit(f"different {c} at row "), F.col("_at").cast("string")))
    ok = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.lit(True))
    return out.where(ok.cast("boolean")).drop("_at", "_bt", *[f"_o_{c}" for c in shared])


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")
