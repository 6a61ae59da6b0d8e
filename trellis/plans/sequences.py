"""Queries on ordered rows: turns, events, returns, masks, repeats, windows of time."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import advantage as adv
from ..operators import credit, replay
from ..operators import sequences as seq
from ..sources.io import table
from ..streaming import incremental
from .registry import query


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("SELECT conv_id, turn, n - coalesce(lag(n) OVER w, 0) AS d_n FROM (SELECT conv_id, turn, length(text) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, n)")
def turn_events_lag_delta(spark, sf):
    t = _turns(spark, sf).withColumn("o", F.struct("turn", "n"))
    return replay.deltas(t, "conv_id", "o", ["n"]).select("conv_id", "turn", F.col("d_n").cast("long"))


@query("SELECT conv_id, turn, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM conversations")
def first_later_event(spark, sf):
    return replay.later_event(_turns(spark, sf), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "later")


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM conversations")
def last_earlier_event(spark, sf):
    return replay.earlier_event(_turns(spark, sf), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "earlier")


@query("SELECT conv_id, turn, coalesce(bool_or(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS has_later_user FROM conversations")
def exists_later_role(spark, sf):
    out = replay.later_event(_turns(spark, sf), "conv_id", "turn", F.col("role") == "user")
    return out.select("conv_id", "turn", F.col("later").isNotNull().alias("has_later_user"))


@query("""
WITH w AS (SELECT conv_id, turn, role, length(text) AS n, CASE role WHEN 'user' THEN 0.25 WHEN 'assistant' THEN 0.45 ELSE 1.0 END AS w FROM conversations)
SELECT conv_id, turn, round(sum(0.5 * n) OVER c * w / sum(w) OVER c / n, 6) AS token_credit FROM w WHERE n > 0 WINDOW c AS (PARTITION BY conv_id)""")
def turn_credit_choice_weights(spark, sf):
    t = _turns(spark, sf).where("n > 0").withColumn("adv", F.lit(0.5))
    weight = credit.choice_weight(F.when(F.col("role") == "user", "search").when(F.col("role") == "assistant", "action").otherwise(F.col("role")))
    return credit.redistribute(t, "conv_id", "adv", "n", weight).select("conv_id", "turn", F.round("token_credit", 6).alias("token_credit"))


@query("SELECT conv_id, CAST(0 AS DOUBLE) AS error, true AS kept FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def credit_conservation(spark, sf):
    t = _turns(spark, sf).where("n > 0").withColumn("adv", F.lit(0.5))
    out = credit.redistribute(t, "conv_id", "adv", "n", F.when(F.col("role") == "user", 0.25).otherwise(0.45))
    out = out.withColumns({"before": F.col("adv") * F.col("n"), "after": F.col("token_credit") * F.col("n")})
    return credit.conservation(out, "conv_id", "before", "after").select("conv_id", F.round("error", 6).alias("error"), (F.col("relative_error") < 1e-6).alias("kept"))


_POS = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity) AS pos, l_discount AS r, l_tax AS v, CAST(l_quantity > 5 AS INT) AS m FROM lineitem)"


def _steps(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("pos"), F.col("l_discount").alias("r"), F.col("l_tax").alias("v"), (F.col("l_quantity") > 5).cast("int").alias("m"))


def _arrays(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("pos", "r", "v", "m")))
    return _steps(spark, sf).groupBy("l_orderkey").agg(rows.alias("x"))


@query(f"SELECT l_orderkey, pos, round(sum(r) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS ret FROM {_POS}")
def reverse_cumulative_return(spark, sf):
    return seq.reverse_sums(_steps(spark, sf), "l_orderkey", "pos", "r").select("l_orderkey", "pos", F.round("return", 6).alias("ret"))


@query(f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT *, max(pos) OVER (PARTITION BY l_orderkey) AS n FROM {_POS}),
t(l_orderkey, pos, run, ret) AS (SELECT l_orderkey, pos, r * m, r FROM p WHERE pos = n UNION ALL SELECT p.l_orderkey, p.pos, (p.r + 0.9 * t.run) * p.m, p.r + 0.9 * t.run FROM p JOIN t ON p.l_orderkey = t.l_orderkey AND p.pos = t.pos - 1)
SELECT l_orderkey, pos, round(ret, 6) AS ret FROM t""")
def discounted_return(spark, sf):
    return adv.discounted_returns(_steps(spark, sf), "l_orderkey", "pos", "r", "m", 0.9).select("l_orderkey", "pos", F.round("return", 6).alias("ret"))


@query(f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT *, max(pos) OVER (PARTITION BY l_orderkey) AS n FROM {_POS}),
t(l_orderkey, pos, v, a) AS (SELECT l_orderkey, pos, v, r - v FROM p WHERE pos = n UNION ALL SELECT p.l_orderkey, p.pos, p.v, p.r + 0.99 * t.v - p.v + 0.99 * 0.95 * t.a FROM p JOIN t ON p.l_orderkey = t.l_orderkey AND p.pos = t.pos - 1)
SELECT l_orderkey, pos, round(a, 6) AS advantage, round(a + v, 6) AS ret FROM t""")
def gae(spark, sf):
    return adv.gae(_steps(spark, sf), "l_orderkey", "pos", "r", "v", 0.99, 0.95).select("l_orderkey", "pos", F.round("advantage", 6).alias("advantage"), F.round("return", 6).alias("ret"))


@query(f"SELECT l_orderkey, pos, CAST(coalesce(sum(1 - m) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS INT) AS mask FROM {_POS}")
def response_mask_until_eos(spark, sf):
    mask = seq.mask_until_end(F.expr("transform(x, a -> a.m)"), 0)
    return _arrays(spark, sf).select("l_orderkey", F.posexplode(mask).alias("pos", "mask")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@query(f"SELECT l_orderkey, pos, CAST(sum(CAST(m = 0 OR pos = 1 AS INT)) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS turn FROM {_POS}")
def segment_turns(spark, sf):
    return seq.turns(_steps(spark, sf), "l_orderkey", "pos", F.col("m") == 0).select("l_orderkey", "pos", "turn")


@query(f"SELECT l_orderkey, CAST(pos - 1 AS INT) AS fragment, r, pos = n AS is_last, CASE WHEN pos = n THEN 1.5 ELSE 0.0 END::DOUBLE AS reward FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {_POS})")
def explode_segments(spark, sf):
    out = seq.fragments(_arrays(spark, sf).withColumn("reward", F.lit(1.5)), "x", "reward")
    return out.select("l_orderkey", "fragment", F.col("x.r").alias("r"), "is_last", "reward")


@query("SELECT r_regionkey, copy, (row_number() OVER (ORDER BY r_regionkey, copy)) - 1 AS position FROM region, (SELECT unnest(range(0, 3)) AS copy)")
def repeat_interleave(spark, sf):
    return seq.repeat(table(spark, sf, "region").select("r_regionkey"), "r_regionkey", 3).select("r_regionkey", F.col("copy").cast("long"), F.col("position").cast("long"))


@query("SELECT vec_id, i AS chunk, round(list_sum(embedding[i * 16 + 1:i * 16 + 16]::DOUBLE[]), 5) AS total FROM embeddings, (SELECT unnest(range(0, 4)) AS i)")
def unfold_chunks(spark, sf):
    out = seq.chunks(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 16)
    return out.select("vec_id", F.col("chunk").cast("long"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("SELECT n_nationkey, false AS is_pad FROM nation UNION ALL SELECT n_nationkey, true FROM nation WHERE n_nationkey < 7")
def pad_to_divisor(spark, sf):
    return seq.pad_rows(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", 32)


@query(f"SELECT l_orderkey, pos, CAST(sum(m) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) - m AS BIGINT) AS start FROM {_POS}")
def pack_offsets(spark, sf):
    return seq.offsets(_steps(spark, sf), "l_orderkey", "pos", "m").select("l_orderkey", "pos", "start")


@query("""
SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, string_agg(event_type, '>' ORDER BY event_id) AS path FROM events GROUP BY user_id""")
def history_text(spark, sf):
    path = F.concat_ws(">", F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]))
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"), path.alias("path"))


@query("SELECT role, count(*) AS n, CAST(count(*) FILTER (contains(lower(text), 'invalid')) AS BIGINT) AS n_invalid FROM conversations GROUP BY role")
def rejection_counts(spark, sf):
    t = table(spark, sf, "conversations")
    kind = replay.rejection_kind(F.col("text"))
    return t.groupBy("role").agg(F.count("*").alias("n"), F.count(F.when(kind == "invalid-parameters", 1)).alias("n_invalid"))


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def telemetry_tumbling(spark, sf):
    out = incremental.tumbling(_events(spark, sf), "ts", "1 hour", ["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT s AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1""")
def telemetry_sliding(spark, sf):
    out = incremental.sliding(_events(spark, sf), "ts", "1 hour", "30 minutes", [])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CAST(coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS INT) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS window_start, count(*) AS n FROM s GROUP BY user_id, k""")
def telemetry_session(spark, sf):
    out = incremental.sessions(_events(spark, sf), "ts", "6 hours", ["user_id"])
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""
SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'success' WHEN arg_max(event_type, event_id) = 'error' THEN 'in_flight' ELSE arg_max(event_type, event_id) END AS state,
  arg_max(event_type, event_id) = 'error' AS reconcile_required, count(*) AS n_events FROM events GROUP BY user_id""")
def work_ledger(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error_final").otherwise(F.col("event_type"))
    return incremental.ledger(table(spark, sf, "events").withColumn("status", status), "user_id", "status", "event_id")
