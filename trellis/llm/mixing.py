"""Mix sources to target weights: Efraimidis-Spirakis sampling after complete epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, boundary_sums, row_back, with_row

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
#: Ranges of the sampling keys, and halvings of the weights that are told apart when ranges are laid.
STEPS, HALVINGS = 4096, 40


def n_words(text) -> F.Column:
    """Runs of characters that aren't ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size) with a target: shares of ``budget`` times all sizes by weight, none above
    ``most`` times its size, the excess reshared by weight.

    The weights repeat over sources by code point, null last. Resharing until none is above ends at
    one level: a target is min(most * size, weight * level). With the first i sources by most * size /
    weight capped, the level would be (words - their caps) / (weights of the rest), which never
    exceeds the level sought and equals it at the right i: prefix sums and a maximum find it. All
    sources are sorted in one task; they are one short row each.
    """
    w = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    ranked = (
        ranked.withColumn("_words", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_free", F.sum("_w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_words") - F.col("_capped")) / F.col("_free"))
        .withColumn("_level", F.max("_level").over(every))
    )
    return ranked.select("source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def key_ranges(rows: DataFrame, key: F.Column) -> F.Column:
    """The range of a sampling key, from the distribution of all keys: those of weight q are exponential
    with rate q, so that the mixture over the rows' weights (to the nearest half of a halving) spreads
    all rows evenly over STEPS ranges, whatever the weights are. It rises with the key."""
    power = F.greatest(F.lit(-2 * HALVINGS), F.least(F.lit(2 * HALVINGS), F.round(F.log2("_q") * 2))).cast("int")
    found = rows.groupBy(power.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    total, spread = sum(r.n for r in found) or 1, F.lit(0.0)
    for r in found:
        spread = spread + F.lit(r.n / total) * (1 - F.exp(-key * F.lit(2.0 ** (r.p / 2))))
    return F.least(F.floor(spread * STEPS), F.lit(STEPS - 1)).cast("int")


def _taken(docs: DataFrame, id_col: str, seed: int, quality: DataFrame | None, weights, budget: float, most: float) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), tie_of(id_col, seed).alias("tie"), draw_of(id_col, seed).alias("_u"))
    if quality is None:
        rows = rows.withColumn("_q", F.lit(1.0))
    else:
        best = quality.groupBy(F.col("doc_id").alias("_qid")).agg(F.max(F.col("weight").cast("double")).alias("_q"))
        rows = rows.join(best, F.col("doc_id") == F.col("_qid"), "left").drop("_qid").withColumn("_q", F.when(F.col("_q") > 0, F.col("_q")).otherwise(1.0))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, budget, most)
    goal = goal.select(F.col("source").alias("_src"), "source_size", "target")
    key = -F.log("_u") / F.col("_q")
    keyed = rows.withColumn("_key", key).withColumn("step", key_ranges(rows, key) if quality is not None else F.least(F.floor((1 - F.exp(-key)) * STEPS), F.lit(STEPS - 1)).cast("int"))
    ordered = boundary_sums(keyed, "source", ["_key", "tie"], "size")
    joined = ordered.join(goal, F.col("source").eqNullSafe(F.col("_src")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), F.col("_key").alias("sampling_key"), "tie")


def draw_of(id_col: str, seed: int) -> F.Column:
    """A number between 0 and 1 from the first 52 bits of md5 of seed|id|text, which any engine can repeat."""
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), part(id_col), F.lit("|"), part("text")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def tie_of(id_col: str, seed: int) -> F.Column:
    """Tells rows apart that have one key, and is what the mixed rows are joined by."""
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col("text"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", seed: int = 0, quality: DataFrame | None = None, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Words that the mix takes of each document.

    A source's target first buys complete epochs of all its documents. The rest is bought in the order
    of exponential keys -ln(u) / quality, smallest first, u from a hash of the id and the text, so
    reruns agree; the document that crosses the target gives only its first words. ``quality`` has
    (doc_id, weight), the largest of an id counts; the weight is 1 where absent, null or not positive.

    One row per input row: doc_id, source, size, source_size, target, taken, sampling_key. A null or blank
    text has size 0 and gives nothing; null sources are one source; an empty table gives no rows;
    repeated rows are told apart by their place among equals.
    """
    return _taken(docs, id_col, seed, quality, weights, budget, most).drop("tie")


def apply_mix(docs: DataFrame, *, seed: int = 0, quality: DataFrame | None = None, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: each document as often as it is taken whole, and
    the crossing document once more, cut after its taken words, which one space parts. n_chars, where
    present, follows. Rows with equal ids and texts share what they are taken evenly, in whole words."""
    taken = _taken(docs, "doc_id", seed, quality, weights, budget, most)
    taken = taken.groupBy(F.col("tie").alias("_tie")).agg(F.min("size").alias("_n"), F.floor(F.sum("taken") / F.count("*")).cast("long").alias("_t"))
    at = with_row(docs, "doc_id", "text").withColumn("_at", tie_of("doc_id", seed)).join(taken, F.col("_at") == F.col("_tie"))
    whole = F.when(F.col("_n") > 0, F.floor(F.col("_t") / F.col("_n"))).otherwise(F.lit(1)).cast("int")
    part = F.when(F.col("_n") > 0, F.col("_t") % F.col("_n")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = at.withColumn("_copy", F.explode(copies))
    first_words = F.expr(r"concat_ws(' ', slice(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0), 1, greatest(_copy, 0)))")
    out = out.withColumn("_kept", F.when(F.col("_copy") < 0, F.col("text")).otherwise(first_words))
    changed = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_copy") < 0, F.col(f"{ROW}.n_chars")).otherwise(F.length("_kept"))
    return row_back(out, docs, **changed)
