"""Queries on groups of rollouts, attempts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import advantage as adv
from ..operators import attempts, credit, joins, ranges, sampling
from ..sources.io import table
from .registry import query


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as rollouts of one prompt: score from the price, valid unless pending."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderstatus") != "P").alias("valid"))


ORDERS = "(SELECT o_orderkey, o_custkey, o_totalprice / 1000 AS score, o_orderstatus <> 'P' AS valid FROM orders)"


@query(f"""
WITH s AS (SELECT *, avg(CASE WHEN valid THEN score END) OVER w AS m, stddev_pop(CASE WHEN valid THEN score END) OVER w AS sd,
  count(CASE WHEN valid THEN score END) OVER w AS n FROM {ORDERS} WINDOW w AS (PARTITION BY o_custkey))
SELECT o_orderkey, o_custkey, round(CASE WHEN valid THEN (score - m) / (CASE WHEN n = 1 THEN 1.0 ELSE sd END + 1e-6) ELSE 0 END, 5) AS advantage FROM s""")
def group_terminal_advantage(spark, sf):
    out = adv.terminal_grpo(_orders(spark, sf), "o_custkey", "score", F.col("valid"))
    return out.select("o_orderkey", "o_custkey", F.round("advantage", 5).alias("advantage"))


@query(f"""
WITH s AS (SELECT *, avg(score) OVER w AS m, stddev_samp(score) OVER w AS sd, count(*) OVER w AS n FROM {ORDERS} WINDOW w AS (PARTITION BY o_custkey))
SELECT o_orderkey, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (sd + 1e-6) END, 5) AS advantage FROM s""")
def group_advantage_sample_std(spark, sf):
    return adv.grpo(_orders(spark, sf), "o_custkey", "score").select("o_orderkey", F.round("advantage", 5).alias("advantage"))


LINES = "(SELECT l_orderkey, l_linenumber, l_extendedprice / 997 AS score, l_quantity AS len, l_tax FROM lineitem)"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 997).alias("score"), F.col("l_quantity").alias("len"), "l_tax")


def _line(df, *more):
    return df.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), F.round("advantage", 5).alias("advantage"), *more)


@query(f"""
SELECT l_orderkey, l_linenumber, round(score, 6) AS score, round(CASE WHEN n > 1 THEN (score - m) * n / (n - 1) ELSE score END, 5) AS advantage
FROM (SELECT *, avg(score) OVER w AS m, count(*) OVER w AS n FROM {LINES} WINDOW w AS (PARTITION BY l_orderkey))""")
def advantage_rloo(spark, sf):
    return _line(adv.leave_one_out(_lines(spark, sf), "l_orderkey", "score"))


@query(f"""
SELECT l_orderkey, l_linenumber, round(score, 6) AS score, round(score - CASE WHEN n > 1 THEN b ELSE 0 END, 5) AS advantage
FROM (SELECT *, sum(len * score) OVER w / sum(len) OVER w AS b, count(*) OVER w AS n FROM {LINES} WINDOW w AS (PARTITION BY l_orderkey))""")
def advantage_opo(spark, sf):
    return _line(adv.length_weighted(_lines(spark, sf), "l_orderkey", "score", "len"))


_KEYED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, score, len) AS pos FROM " + LINES + ")"


def _keyed(spark, sf):
    return _lines(spark, sf).withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "score", "len")).cast("long"))


@query(f"""
WITH g AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {_KEYED}),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, pos) AS k, max(score) OVER w - nth_value(score, 2) OVER (PARTITION BY l_orderkey ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lead_,
  stddev_samp(score) OVER w AS sd FROM g WHERE n > 1 WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, pos, round(CASE WHEN k = 1 THEN lead_ / (sd + 1e-6) ELSE 0 END, 4) AS advantage FROM r""")
def advantage_passk(spark, sf):
    rows = _keyed(spark, sf).withColumn("n", F.count("*").over(W.partitionBy("l_orderkey"))).where("n > 1")
    return adv.best_of_group(rows, "l_orderkey", "score", "pos").select("l_orderkey", "pos", F.round("advantage", 4).alias("advantage"))


@query(f"""
WITH c AS (SELECT *, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS c FROM {_KEYED} WINDOW w AS (PARTITION BY l_orderkey)),
m AS (SELECT avg(c) AS m, var_samp(c) AS v FROM c)
SELECT l_orderkey, pos, round((c - m) / sqrt(v + 1e-8), 4) AS advantage FROM c, m""")
def advantage_whitened(spark, sf):
    return adv.centred_whitened(_keyed(spark, sf), "l_orderkey", "score").select("l_orderkey", "pos", F.round("advantage", 4).alias("advantage"))


@query(f"""
WITH p AS (SELECT *, score AS a, -len / 10 AS b, l_tax AS c, score - len / 10 + l_tax AS t FROM {_KEYED}),
s AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_pop(t) OVER w END + 1e-6 AS sd, avg(t) OVER w AS mt, avg(a) OVER w AS ma, avg(b) OVER w AS mb FROM p WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, pos, round((t - mt) / sd, 4) AS advantage, round((a - ma) / sd, 4) AS adv_a, round((b - mb) / sd, 4) AS adv_b,
  round((t - mt) / sd - (a - ma) / sd - (b - mb) / sd, 4) AS adv_c FROM s""")
def component_advantages(spark, sf):
    rows = _keyed(spark, sf).select("l_orderkey", "pos", F.col("score").alias("a"), (-F.col("len") / 10).alias("b"), F.col("l_tax").alias("c"))
    out = adv.by_component(rows, "l_orderkey", ["a", "b", "c"])
    return out.select("l_orderkey", "pos", *[F.round(x, 4).alias(x) for x in ("advantage", "adv_a", "adv_b", "adv_c")])


_DAYS = "(SELECT user_id, CAST(ts AS DATE) AS day, event_id, value, event_type <> 'error' AS valid FROM events)"


def _days(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", F.to_date("ts").alias("day"), "event_id", "value", (F.col("event_type") != "error").alias("valid"))


_REASON = f"""
SELECT *, CASE WHEN n < 3 THEN 'incomplete_group' WHEN NOT ok THEN 'reward_invalid' WHEN hi - lo <= 1e-6 THEN 'constant_reward'
  WHEN hi - lo + 1e-6 < 5e-3 THEN 'insufficient_reward_spread' ELSE 'useful' END AS reason
FROM (SELECT *, count(*) OVER w AS n, bool_and(valid) OVER w AS ok, max(CASE WHEN valid THEN value ELSE 0 END) OVER w AS hi,
  min(CASE WHEN valid THEN value ELSE 0 END) OVER w AS lo FROM {_DAYS} WINDOW w AS (PARTITION BY user_id, day))"""


def _reasons(spark, sf):
    rows = _days(spark, sf).withColumn("uid", F.concat_ws("|", F.col("user_id").cast("string"), F.col("day").cast("string")))
    return adv.spread_reason(rows, "uid", "value", F.col("valid"), size=3)


@query(f"SELECT event_id, reason, reason = 'useful' OR (reason IN ('incomplete_group', 'reward_invalid') AND valid) AS kept FROM ({_REASON})")
def reward_spread_groups(spark, sf):
    return _reasons(spark, sf).select("event_id", "reason", "kept")


@query(f"SELECT reason, count(*) AS n_rows, count(DISTINCT (user_id, day)) AS n_groups FROM ({_REASON}) GROUP BY reason")
def reward_spread_reasons(spark, sf):
    return _reasons(spark, sf).groupBy("reason").agg(F.count("*").alias("n_rows"), F.countDistinct("uid").alias("n_groups"))


_TRIES = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CAST(event_type = 'purchase' AS DOUBLE) AS success, CAST(event_type <> 'error' AS DOUBLE) AS valid, value, event_type, event_id FROM events)"


def _tries(spark, sf):
    e = table(spark, sf, "events")
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", at.alias("attempt"), (F.col("event_type") == "purchase").cast("double").alias("success"), (F.col("event_type") != "error").cast("double").alias("valid"), "value", "event_type", "event_id")


_PER_TASK = f"""
SELECT user_id, count(*) AS n_attempts, max(CAST(success = 1 AS INT)) AS passed, arg_min(CAST(success = 1 AS INT), attempt) AS passed_first,
  CAST(sum(CAST(valid <> 0 AS INT)) AS BIGINT) AS n_valid, CAST(count(*) < 3 AS INT) AS early, arg_min(value, attempt) AS first_value,
  avg(value) AS mean_value, coalesce(max(CASE WHEN valid <> 0 THEN value END), max(value)) AS best_value FROM {_TRIES} WHERE attempt <= 3 GROUP BY user_id"""


def _per_task(spark, sf):
    return attempts.per_task(_tries(spark, sf), "user_id", "attempt", F.col("success"), F.col("valid"), ["value"], 3)


@query(f"SELECT * REPLACE (round(mean_value, 6) AS mean_value) FROM ({_PER_TASK})")
def metric_mean_best(spark, sf):
    return _per_task(spark, sf).withColumn("mean_value", F.round("mean_value", 6))


@query(f"""
SELECT round(avg(passed), 6) AS pass_at_k, round(avg(passed_first), 6) AS pass_at_1, count(*) AS n_tasks, CAST(sum(n_attempts) AS BIGINT) AS n_attempts,
  CAST(sum(early) AS BIGINT) AS n_early, round(sum(n_valid) / sum(n_attempts), 6) AS valid_rate, round(avg(first_value), 4) AS first_value,
  round(avg(mean_value), 4) AS mean_value, round(avg(best_value), 4) AS best_value FROM ({_PER_TASK})""")
def pass_at_k_summary(spark, sf):
    out = attempts.summary(_per_task(spark, sf), ["value"])
    return out.select(*[F.round(c, 6).alias(c) if c in ("pass_at_k", "pass_at_1", "valid_rate") else F.round(c, 4).alias(c) if c.endswith("_value") else F.col(c) for c in out.columns])


@query(f"""
WITH t AS (SELECT c_mktsegment AS model, CASE WHEN o_custkey % 10 = 0 THEN 'seen' ELSE 'unseen' END AS split, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT model, split, avg(v) AS score, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT model, 'all', avg(v), count(*) FROM t GROUP BY ALL)
SELECT model, split, round(score, 2) AS score, n, row_number() OVER (PARTITION BY split ORDER BY score DESC, model) = 1 AS winner FROM g""")
def model_split_comparison(spark, sf):
    t = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.select(F.col("c_mktsegment").alias("model"), F.when(F.col("o_custkey") % 10 == 0, "seen").otherwise("unseen").alias("split"), F.col("o_totalprice").alias("v"))
    each = t.withColumn("split", F.explode(F.array("split", F.lit("all")))).groupBy("model", "split").agg(F.avg("v").alias("score"), F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy("split").orderBy(F.desc("score"), "model")) == 1
    return each.withColumn("winner", first).withColumn("score", F.round("score", 2))


@query(f"""
WITH l AS (SELECT user_id, event_type, count(*) AS n, min(attempt) AS place, arg_min(value, attempt) AS value FROM {_TRIES} GROUP BY ALL)
SELECT user_id, event_type, n, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, place) AS k FROM l) WHERE k = 1""")
def majority_vote_value(spark, sf):
    return attempts.majority(_tries(spark, sf), "user_id", "event_type", "value", "attempt")


@query("""
WITH m AS (SELECT event_type || CASE user_id % 3 WHEN 0 THEN '/max' WHEN 1 THEN '/min' ELSE '/mean' END AS name, value FROM events)
SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 5) AS value FROM m GROUP BY name""")
def metric_reduce_by_name(spark, sf):
    tail = F.when(F.col("user_id") % 3 == 0, "/max").when(F.col("user_id") % 3 == 1, "/min").otherwise("/mean")
    m = table(spark, sf, "events").select(F.concat("event_type", tail).alias("name"), "value")
    return attempts.reduce_by_name(m, "name", "value").withColumn("value", F.round("value", 5))


@query(f"""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * (pow(i / n, 4) - pow((i - 1) / n, 4))), 4) AS best_mean, round(sum(value * (pow((n - i + 1) / n, 4) - pow((n - i) / n, 4))), 4) AS worst_mean FROM r GROUP BY user_id""")
def bootstrap_best_of_n(spark, sf):
    out = attempts.expected_best(table(spark, sf, "events"), "user_id", "value", 4)
    return out.select("user_id", F.round("best_mean", 4).alias("best_mean"), F.round("worst_mean", 4).alias("worst_mean"))


@query("""
WITH d AS (SELECT user_id, event_id, event_type <> 'purchase' AS z FROM events),
i AS (SELECT *, sum(CAST(NOT z AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM d),
s AS (SELECT *, CAST(sum(CAST(z AS INT)) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i)
SELECT user_id, event_id, streak, min(CASE WHEN streak >= 3 THEN event_id END) OVER (PARTITION BY user_id) AS first_admitted FROM s""")
def zero_streak_admission(spark, sf):
    out = attempts.zero_streaks(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") != "purchase")
    return out.select("user_id", "event_id", "streak", "first_admitted")


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS loss, avg(CAST(event_type = 'purchase' AS INT)) AS r FROM events GROUP BY 1),
h AS (SELECT *, coalesce(r >= lag(r) OVER (ORDER BY day), true) AS held FROM e)
SELECT day, round(loss, 6) AS loss, round(r, 6) AS r FROM h WHERE held ORDER BY loss, day LIMIT 1""")
def best_checkpoint(spark, sf):
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("r"))
    return attempts.best_checkpoint(e, "day", "loss", ["r"]).select("day", F.round("loss", 6).alias("loss"), F.round("r", 6).alias("r"))


@query("""
WITH u AS (SELECT user_id, count(*) AS steps, count(*) FILTER (event_type = 'error') AS invalid, count(DISTINCT event_type) AS answered, 5 AS total,
  count(DISTINCT CASE WHEN value > 50 THEN event_type END) AS correct, count(DISTINCT CASE WHEN value > 150 THEN event_type END) AS best,
  count(DISTINCT CASE WHEN value > 5 THEN event_type END) AS legal, count(*) FILTER (value < 1) AS redundant, count(*) FILTER (event_type = 'signup' AND value > 60) AS elicited,
  count(*) FILTER (event_type = 'signup') AS prefs, count(*) FILTER (value > 300) AS wrong FROM events GROUP BY user_id),
p AS (SELECT *, CASE WHEN prefs = 0 THEN 1.0 ELSE elicited / prefs END AS hidden, greatest(0.0, 1 - least(1.0, steps / 100)) AS eff,
  least(1.0, 0.05 * invalid + 0.10 * wrong) AS policy, least(0.60, 0.05 * least(3, redundant) + 0.10 * greatest(0, redundant - 3)) AS redund FROM u)
SELECT user_id, round(greatest(-1, least(1, (3.0 * correct / total + 0.3 * best / total + 0.2 * legal / total + 0.15 * hidden + 0.05 * eff
  - policy - redund - (1 - answered / total) - CASE WHEN steps >= 80 THEN 0.75 ELSE 0 END) / 3.70)), 5) AS reward, round(hidden, 5) AS hidden, round(eff, 5) AS efficiency FROM p""")
def terminal_reward_v2(spark, sf):
    kind, v = F.col("event_type"), F.col("value")
    n = lambda c: F.count(F.when(c, 1))
    u = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("steps"), n(kind == "error").alias("invalid"), F.countDistinct("event_type").alias("answered"), F.countDistinct(F.when(v > 50, kind)).alias("correct"),
        F.countDistinct(F.when(v > 150, kind)).alias("best"), F.countDistinct(F.when(v > 5, kind)).alias("legal"), n(v < 1).alias("redundant"),
        n((kind == "signup") & (v > 60)).alias("elicited"), n(kind == "signup").alias("prefs"), n(v > 300).alias("wrong"),
    )
    c = {x: F.col(x) for x in u.columns} | {"total": F.lit(5), "max_steps": F.lit(100), "plan_errors": F.lit(0), "reason": F.when(F.col("steps") >= 80, "max_steps"), "valid": F.lit(True)}
    c["reason"] = F.coalesce(c["reason"], F.lit("done"))
    r = credit.terminal_reward(c)
    return u.select("user_id", F.round(r["reward"], 5).alias("reward"), F.round(r["hidden"], 5).alias("hidden"), F.round(r["efficiency"], 5).alias("efficiency"))


@query(f"""
SELECT l_orderkey, CAST(sum(m) AS BIGINT) AS n, round(sum(score * m), 6) AS masked_sum, round(sum(score * m) / (sum(m) + 1e-8), 5) AS masked_mean,
  CASE WHEN sum(m) > 1 THEN round((sum(score * score * m) - sum(score * m) * sum(score * m) / sum(m)) / (sum(m) - 1), 3) END AS masked_var
FROM (SELECT *, CAST(len > 10 AS INT) AS m FROM {LINES}) GROUP BY l_orderkey""")
def masked_moments(spark, sf):
    rows = _lines(spark, sf).withColumn("m", (F.col("len") > 10).cast("int"))
    out = credit.masked_moments(rows, "score", "m", ["l_orderkey"])
    return out.select("l_orderkey", "n", F.round("masked_sum", 6).alias("masked_sum"), F.round("masked_mean", 5).alias("masked_mean"), F.round("masked_var", 3).alias("masked_var"))


@query(f"""
WITH r AS (SELECT l_orderkey, sum(score * m) AS s, sum(m) AS n FROM (SELECT *, CAST(len > 10 AS INT) AS m FROM {LINES}) GROUP BY 1)
SELECT 'seq-mean-token-mean' AS mode, round(avg(CASE WHEN n > 0 THEN s / n END), 4) AS loss FROM r UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 4) FROM r
UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / 1000, 4) FROM r UNION ALL SELECT 'token-mean', round(sum(s) / sum(n), 4) FROM r""")
def loss_aggregation(spark, sf):
    rows = _lines(spark, sf).withColumn("m", (F.col("len") > 10).cast("int"))
    out = None
    for mode in ("seq-mean-token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "token-mean"):
        one = credit.aggregate_loss(rows, "l_orderkey", "score", "m", mode, 1000.0).select(F.lit(mode).alias("mode"), F.round("loss", 4).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT l_returnflag, round(avg(a - b), 6) AS k1, round(avg(abs(a - b)), 6) AS abs_, round(avg(0.5 * (a - b) * (a - b)), 6) AS k2, round(avg(greatest(-10, least(10, exp(b - a) - (b - a) - 1))), 6) AS k3
FROM (SELECT l_returnflag, l_discount * 10 AS a, l_tax * 10 AS b FROM lineitem) GROUP BY 1""")
def kl_estimates(spark, sf):
    a, b = F.col("l_discount") * 10, F.col("l_tax") * 10
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.round(F.avg(adv.kl_penalty(a, b, k)), 6).alias(n) for k, n in (("k1", "k1"), ("abs", "abs_"), ("k2", "k2"), ("k3", "k3"))])


@query("""
SELECT l_returnflag, round(avg(CASE WHEN adv < 0 THEN least(l, -adv * 3) ELSE l END), 5) AS loss, round(avg(CAST(abs(r - 1) > 0.2 AS INT)), 5) AS clip_fraction
FROM (SELECT *, greatest(-adv * r, -adv * least(greatest(r, 0.8), 1.2)) AS l FROM (SELECT l_returnflag, exp(l_discount * 10 - l_tax * 10) AS r, (l_quantity - 25) / 10 AS adv FROM lineitem)) GROUP BY 1""")
def clipped_loss(spark, sf):
    lr, a = F.col("l_discount") * 10 - F.col("l_tax") * 10, (F.col("l_quantity") - 25) / 10
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(adv.clipped_policy_loss(lr, a)), 5).alias("loss"), F.round(F.avg((F.abs(F.exp(lr) - 1) > 0.2).cast("int")), 5).alias("clip_fraction"))


@query("""
SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(avg(value), 4) AS mean, max(value) AS max, min(value) AS min,
  round(var_samp(value), 3) AS var FROM events GROUP BY event_type""")
def metric_statistics(spark, sf):
    v, e = F.col("value"), table(spark, sf, "events")
    moments = e.groupBy("event_type").agg(F.round(F.avg(v), 4).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.round(F.var_samp(v), 3).alias("var"))
    places = ranges.quantiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return moments.join(places, "event_type").select("event_type", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "mean", "max", "min", "var")


@query("""
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def last_attempt(spark, sf):
    return joins.latest(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("""
WITH s AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS v FROM customer GROUP BY ALL), m AS (SELECT c_mktsegment, quantile_cont(v, 0.5) AS median FROM s GROUP BY 1)
SELECT c_mktsegment, c_nationkey, round(v, 4) AS v, round(median, 4) AS median FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(abs(v - median), 9), c_nationkey) AS k FROM s JOIN m USING (c_mktsegment)) WHERE k = 1""")
def median_representative(spark, sf):
    s = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    out = sampling.representatives(s, "c_mktsegment", "v", "c_nationkey")
    return out.select("c_mktsegment", "c_nationkey", F.round("v", 4).alias("v"), F.round("median", 4).alias("median"))


@query("""
SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS p, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def status_summary(spark, sf):
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(n("F").alias("f"), n("O").alias("o"), n("P").alias("p"), F.countDistinct("o_custkey").alias("customers"))


@query("""
SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2""")
def complete_in_all_passes(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("k")).where("k = 2").drop("k")
