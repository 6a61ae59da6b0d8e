"""Queries on rows as such: slices, halves of a batch, fragments, picks, roles, records, thoughts, files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import messages, records
from ..functions import text as tx
from ..operators import advantage as adv
from ..operators import joins, ranges, sampling
from ..operators import sequences as seq
from ..sources import io
from ..sources.io import table
from .registry import query


@query("SELECT doc_id AS id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) WHERE position >= 5 AND position < n - 5 AND (position - 5) % 3 = 0")
def row_slice(spark, sf):
    """Rows [5:-5:3] of a table in the order of their ids, renamed."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    n = d.count()
    at = F.col("position")
    return ranges.numbered(d, "id", "position").where((at >= 5) & (at < n - 5) & ((at - 5) % 3 == 0))


@query("SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_linenumber, l_partkey, l_returnflag), ',') AS lines, array_to_string(list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag), ',') AS flags FROM lineitem GROUP BY l_orderkey")
def rows_to_lists(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    held = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    listed = lambda c: F.concat_ws(",", F.transform("r", lambda x: x[c].cast("string")))
    return held.select("l_orderkey", listed("l_linenumber").alias("lines"), listed("l_returnflag").alias("flags"))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_custkey <> CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS conflict FROM orders""")
def joined_halves(spark, sf):
    o = table(spark, sf, "orders")
    other = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_totalprice")
    return joins.same_rows(o.select("o_orderkey", "o_custkey", "o_orderstatus"), other, "o_orderkey", ["o_custkey"])


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), b AS (SELECT o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice FROM a JOIN b USING (k)""")
def positional_join(spark, sf):
    o = table(spark, sf, "orders")
    other = o.select((-F.col("o_totalprice")).alias("down"), F.col("o_orderkey").alias("key"), "o_custkey", "o_totalprice")
    return joins.by_position(o.select("o_orderkey", "o_orderstatus"), other, ["o_orderkey"], ["down", "key"], []).drop("down", "key")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 997 AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1 AS last, l_orderkey % 50 AS g FROM lineitem),
m AS (SELECT g, avg(s) AS m, stddev_pop(s) AS sd, count(*) AS n FROM f WHERE last GROUP BY g)
SELECT l_orderkey, round(any_value((s - m) / (CASE WHEN n = 1 THEN 1.0 ELSE sd END + 1e-6)) FILTER (last), 5) AS advantage, (SELECT count(*) FROM f x WHERE x.l_orderkey = f.l_orderkey) AS n_fragments FROM f JOIN m USING (g) GROUP BY l_orderkey""")
def segmented_advantage(spark, sf):
    """One statistic for each rollout, by its last fragment's reward, given to all its fragments."""
    line = table(spark, sf, "lineitem").withColumn("score", F.col("l_extendedprice") / 997)
    rollouts = line.groupBy("l_orderkey").agg(F.max_by("score", F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("reward"), F.count("*").alias("n_fragments")).withColumn("g", F.col("l_orderkey") % 50)
    return adv.terminal_grpo(rollouts, "g", "reward", F.lit(True)).select("l_orderkey", F.round("advantage", 5).alias("advantage"), "n_fragments")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN n > 1 THEN (score - m) * n / (n - 1) ELSE score END, 5) AS advantage FROM (SELECT *, l_extendedprice / 997 AS score, avg(l_extendedprice / 997) OVER w AS m, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))")
def advantage_by_name(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 997).alias("score"))
    return adv.ESTIMATORS["rloo"](line, "l_orderkey", "score").select("l_orderkey", "l_linenumber", F.round("advantage", 5).alias("advantage"))


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS m, max(c_acctbal) OVER (PARTITION BY c_nationkey) - min(c_acctbal) OVER (PARTITION BY c_nationkey) AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)),
p AS (SELECT *, CASE WHEN m - 2 <= 2 THEN place ELSE CASE WHEN place IN (0, m - 1, 1 + round_even((m - 3) / 3.0, 0), 1 + round_even(2 * (m - 3) / 3.0, 0)) THEN place END END AS hit FROM r WHERE m >= 4 AND d > 1e-6 AND d + 1e-6 >= 5e-3)
SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY hit IS NULL, place) AS k FROM p) WHERE k <= 4""")
def spaced_picks(spark, sf):
    return sampling.spaced(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey", 4).select("c_nationkey", "c_custkey")


@query("SELECT c_nationkey, list(c_acctbal ORDER BY c_acctbal DESC)[1] AS best, list(c_acctbal ORDER BY c_acctbal DESC)[2] AS second FROM customer GROUP BY c_nationkey")
def top_two(spark, sf):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    held = table(spark, sf, "customer").withColumn("k", F.row_number().over(w)).where("k <= 2")
    return held.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"), F.min(F.when(F.col("k") == 2, F.col("c_acctbal"))).alias("second"))


@query("SELECT event_id, least(8.0, 2.0 ** (event_id % 6) + (event_id % 10) / 10.0 * 0.5) AS delay, event_type = 'error' AS again FROM events")
def retry_delays(spark, sf):
    i = F.col("event_id")
    error = F.when(F.col("event_type") == "error", "ConnectionError").otherwise("ValueError")
    return table(spark, sf, "events").select("event_id", records.retry_delay(i % 6, (i % 10) / 10).alias("delay"), records.transient(error).alias("again"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND role = 'user' THEN 'user' WHEN turn % 3 = 1 THEN 'assistant' ELSE role END AS role, 'call_' || lpad(CAST(turn * 100 + 1 AS VARCHAR), CAST(greatest(4, length(CAST(turn * 100 + 1 AS VARCHAR))) AS INTEGER), '0') AS call FROM conversations""")
def usual_roles(spark, sf):
    said = F.when((F.col("turn") % 3 == 0) & (F.col("role") == "user"), " Human").when(F.col("turn") % 3 == 1, "GPT").otherwise(F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", messages.role(said).alias("role"), messages.call_id(F.col("turn"), F.lit(1)).alias("call"))


@query("""
SELECT o_orderpriority || '::' || o_orderkey AS task_key, o_orderpriority AS env_name, CAST(o_orderkey AS VARCHAR) AS task_id, CAST(o_custkey % 4 AS INT) AS pass_index, 'm' AS model, 'enabled' AS thinking, 'high' AS reasoning_effort,
  25 AS max_turns, 'r1' AS code_revision, o_orderstatus AS collection_run_id, sha256(o_orderpriority) AS task_pool_hash FROM orders""")
def provenance_records(spark, sf):
    p = records.provenance(F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey") % 4, F.lit("m"), F.col("o_orderstatus"), F.lit("r1"), pool_hash=F.sha2("o_orderpriority", 256))
    return table(spark, sf, "orders").select(p.alias("p")).select("p.*")


@query("SELECT event_id, 'v2' AS reward_version, false AS reward_valid, false AS reward_valid_for_training, 0.0 AS terminal_reward, event_type AS termination_reason FROM events WHERE event_type = 'error'")
def invalid_reports(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.select("event_id", records.invalid_report(F.col("event_type"), "v2").alias("r")).select("event_id", "r.*")


@query(r"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN nullif(text, '') END AS thought, CASE WHEN turn % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN role = 'user' THEN 0.9 ELSE 0 END AS score FROM conversations""")
def thoughts_and_form(spark, sf):
    whole = F.coalesce("text", F.lit(""))
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>"), whole, F.lit("</think> so \\boxed{1}"))).otherwise(whole)
    held = table(spark, sf, "conversations").withColumn("said", text)
    return held.select("conv_id", "turn", tx.between(F.col("said"), "think").alias("thought"), messages.geometry_score(F.col("role") == "user", F.col("said")).alias("score"))


@query("""
WITH t AS (SELECT conv_id, turn, role, sum(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM conversations),
c AS (SELECT conv_id, turn, CAST(sum(CAST(role <> 'assistant' AS INT)) OVER (PARTITION BY conv_id, island ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INT) AS n FROM t)
SELECT conv_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY turn) AS counts, count(*) FILTER (n >= 2) AS due FROM c GROUP BY conv_id""")
def off_topic_counts(spark, sf):
    revealed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"] == "assistant")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(messages.off_topic(revealed, 2).alias("x"))
    return c.select("conv_id", F.concat_ws(",", F.transform("x", lambda x: x["n"].cast("string"))).alias("counts"), F.size(F.filter("x", lambda x: x["due"])).cast("long").alias("due"))


@query("""
WITH l AS (SELECT conv_id, list(role ORDER BY turn) FILTER (role = 'user') AS u, list(role ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, 'Current aspect: ' || CASE WHEN conv_id % 2 = 0 THEN 'flight' ELSE 'none' END || chr(10) || 'Asked: ' || coalesce(array_to_string(u, ', '), 'none') || chr(10) || 'Answered: ' || coalesce(array_to_string(a, ', '), 'none') AS state FROM l""")
def state_texts(spark, sf):
    of = lambda r: F.transform(F.filter("t", lambda x: x["role"] == r), lambda x: x["role"])
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", messages.state_text(F.when(F.col("conv_id") % 2 == 0, "flight"), {"Asked": of("user"), "Answered": of("assistant")}).alias("state"))


@query("SELECT 'events' AS name, event_type, count(*) AS n FROM events GROUP BY event_type")
def file_provenance(spark, sf):
    return io.with_provenance(table(spark, sf, "events"), r"/([a-z]+)\.parquet", "name").groupBy("name", "event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, array_to_string(list_transform(range(1, count(*) + 1), lambda i: CASE WHEN i = count(*) THEN max(l_quantity) ELSE 0.0 END), ',') AS rewards FROM lineitem GROUP BY l_orderkey")
def placed_rewards(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.max("l_quantity").alias("q"))
    return g.select("l_orderkey", F.concat_ws(",", F.transform(seq.place_last(F.col("n"), F.col("q")), lambda x: x.cast("string"))).alias("rewards"))


@query("""
SELECT o_orderkey, coalesce(c_name, n_name, 'none') AS match, CASE WHEN c_name IS NOT NULL THEN 1 WHEN n_name IS NOT NULL THEN 2 END AS tier
FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 40""")
def tiered_match(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    out = joins.tiered(o, [(rich, F.col("o_custkey") == F.col("c_custkey"), "c_name"), (nations, F.col("o_orderkey") % 40 == F.col("n_nationkey"), "n_name")], "o_orderkey")
    return out.select("o_orderkey", F.coalesce("match", F.lit("none")).alias("match"), "tier")
