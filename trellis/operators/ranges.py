"""Positions in an order, without one task that sorts a whole table or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that an order is cut into, and keys that their edges are taken from.
RANGES, SAMPLE = 256, 4096
#: A stratum with more rows than this, and more than this part of all rows, is cut into ranges: at most so many
#: strata are. Rows that the edges of all of them are taken from.
HOT_ROWS, HOT_PART, HOT_SAMPLE = 1 << 16, 1000, 1 << 16
#: Hex digits of a hash that tell its range: 4,096 ranges.
DIGITS = 3


def numbered(df: DataFrame, key: str, into: str) -> DataFrame:
    """Add ``into``: the place of each row from 0 in the order of ``key``.

    Edges of about RANGES ranges come from a bounded sample of keys by a hash; rows before a range are
    counted, and only rows of one range are sorted together. Equal keys share a range, in any order.
    """
    n = df.count()
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    keys = sorted(r[0] for r in df.where(F.col(key).isNotNull() & (draw < min(1.0, SAMPLE / max(n, 1)))).select(key).limit(2 * SAMPLE).collect())
    edges = sorted(set(keys[:: max(1, len(keys) // RANGES)]))
    kind = df.schema[key].dataType
    held = F.array(*[F.lit(e).cast(kind) for e in edges]) if edges else F.array().cast(f"array<{kind.simpleString()}>")
    step = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(held, lambda e: e <= F.col(key))))
    return _placed(df.withColumn("_step", step), [], [F.col(key)], into)


def ranked(df: DataFrame, stratum: list[str], digest: Column, order: list[Column], into: str) -> DataFrame:
    """Add ``into``: the place of each row from 0 in its stratum by ``digest`` (hex), then ``order``. A
    range is a prefix of the digest, which spreads the rows of any stratum evenly."""
    held = df.withColumn("_digest", digest).withColumn("_step", F.conv(F.substring("_digest", 1, DIGITS), 16, 10).cast("int"))
    return _placed(held, stratum, [F.col("_digest"), *order], into).drop("_digest")


def in_order(df: DataFrame, stratum: list[str], order: list[str], into: str, *, weight: str | None = None) -> DataFrame:
    """Add ``into``: how many rows of its stratum (or what sum of ``weight``) come before each row in the
    order of ``order`` (nulls first).

    Strata of more than HOT_ROWS rows and a HOT_PART-th of all, which are HOT_PART at most, are cut into
    RANGES ranges or less, with edges from a bounded sample of their rows; the edges are what is
    broadcast. Rows of one range are sorted together, never a large stratum. Rows that are equal in
    ``order`` share a range, so name enough columns, or give equal rows as one with a weight.
    """
    keys = [F.col(f"`{c}`") for c in stratum]
    key, place = F.struct(F.lit(0).alias("_"), *keys), F.struct(*[F.col(f"`{c}`") for c in order])
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = sizes.where(F.col("_n") > max(HOT_ROWS, total // HOT_PART)).select(key.alias("_key"), "_n").limit(HOT_PART)
    held = df.withColumns({"_key": key, "_place": place})
    share = HOT_SAMPLE / max(total, 1)
    edges = None
    if total > HOT_ROWS:
        drawn = held.join(F.broadcast(hot), "_key").where(F.rand(7) < share).limit(4 * HOT_SAMPLE)
        every = drawn.groupBy("_key").agg(F.array_sort(F.collect_list("_place")).alias("_e"))
        step = F.greatest(F.lit(1), (F.size("_e") / RANGES).cast("int"))
        edges = every.select("_key", F.array_distinct(F.filter("_e", lambda x, i: i % step == 0)).alias("_e"))
        rows = edges.collect()
        edges = df.sparkSession.createDataFrame(rows, edges.schema) if rows else None
    if edges is None:
        held = held.withColumn("_step", F.lit(0))
    else:
        held = held.join(F.broadcast(edges), "_key", "left").withColumn("_step", F.coalesce(F.size(F.filter("_e", lambda e: e <= F.col("_place"))), F.lit(0))).drop("_e")
    return _placed(held.drop("_key"), stratum, [F.col("_place")], into, weight).drop("_place")


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row a group with its exact quantiles, linear between the two nearest values; nulls don't count, and a
    group of nulls alone has none. Equal values are counted first, so a frequent one is one row."""
    keys = [F.col(f"`{c}`") for c in group]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_w"))
    held = in_order(counts, group, ["_v"], "_before", weight="_w")
    sizes = counts.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    on = F.lit(True)
    for i, c in enumerate(group):
        sizes = sizes.withColumnRenamed(c, f"_g{i}")
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    held = held.join(sizes, on)
    at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_w")), F.col("_v")))
    exact = {name: F.lit(q) * (F.col("_n") - 1) for name, q in shares.items()}
    picked = held.groupBy(*keys).agg(F.first("_n").alias("_n"), *[at(f(x)).alias(f"_{side}_{name}") for name, x in exact.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    mixed = {name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (x - F.floor(x)) for name, x in exact.items()}
    return picked.select(*keys, *[x.alias(name) for name, x in mixed.items()])


def _placed(df: DataFrame, stratum: list[str], order: list[Column], into: str, weight: str | None = None) -> DataFrame:
    sizes = df.groupBy(*stratum, "_step").agg((F.sum(weight) if weight else F.count("*")).alias("_r_size"))
    before = F.sum("_r_size").over(W.partitionBy(*stratum).orderBy("_step").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(stratum)], F.col("_step").alias("_r_at"), F.coalesce(before, F.lit(0)).alias("_r_before"))
    own = W.partitionBy(*stratum, "_step").orderBy(*order)
    rows = df.withColumn("_r_own", F.coalesce(F.sum(weight).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(own) - 1)
    on = F.col("_step") == F.col("_r_at")
    for i, c in enumerate(stratum):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    out = rows.join(sizes, on).withColumn(into, (F.col("_r_before") + F.col("_r_own")).cast("long"))
    return out.drop("_step", "_r_own", "_r_at", "_r_before", *[f"_s{i}" for i in range(len(stratum))])
