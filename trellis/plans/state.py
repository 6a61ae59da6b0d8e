"""Queries on keyed state and on resampled validation: work ledgers and bounded retries as recursions in SQL,
majorities by adding up all vote counts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import validation
from ..sources.io import table
from ..streaming import keyed
from .registry import query

_EVENT = "CASE WHEN event_type = 'view' THEN 'claim' WHEN event_id % 11 = 0 THEN 'success' WHEN event_type = 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'retry' ELSE 'claim' END WHEN event_id % 13 = 0 THEN 'abandon' WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'error_final' ELSE 'error' END WHEN event_id % 29 = 0 THEN 'invalid' ELSE 'settle' END"


@query(f"""
WITH RECURSIVE e AS (SELECT concat(user_id, '/', event_id % 6) AS task, epoch_ms(ts) AS ms, {_EVENT} AS ev, row_number() OVER (PARTITION BY user_id, event_id % 6 ORDER BY epoch_ms(ts), event_id) AS n FROM events),
run AS (SELECT DISTINCT task, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::BIGINT AS due, false AS rec, true AS taken FROM e
  UNION ALL SELECT task, n, CASE WHEN NOT taken THEN status WHEN ev = 'claim' OR ev = 'error_final' THEN 'in_flight' WHEN ev = 'abandon' THEN 'abandoned' WHEN ev = 'retry' THEN NULL WHEN ev = 'settle' THEN 'error' ELSE ev END,
    CASE WHEN NOT taken THEN due WHEN ev = 'claim' THEN ms + 21600000 END, CASE WHEN NOT taken THEN rec ELSE ev = 'error_final' END, taken
  FROM (SELECT *, coalesce(CASE WHEN ev = 'claim' THEN coalesce(status, '') NOT IN ('success', 'in_flight', 'invalid', 'abandoned') WHEN status = 'success' THEN false WHEN ev IN ('success', 'invalid', 'error', 'error_final') THEN true WHEN ev IN ('abandon', 'retry', 'settle') THEN coalesce(status, '') = 'in_flight' END, false) AS taken
    FROM (SELECT r.task, e.n, ms, ev, CASE WHEN status = 'in_flight' AND ms >= due THEN 'abandoned' ELSE status END AS status, CASE WHEN status = 'in_flight' AND ms >= due THEN NULL ELSE due END AS due, rec AND NOT coalesce(status = 'in_flight' AND ms >= due, false) AS rec FROM run r JOIN e ON e.task = r.task AND e.n = r.n + 1)))
SELECT task, CASE WHEN arg_max(CASE WHEN status = 'in_flight' AND due <= epoch_ms(TIMESTAMP '2024-01-20') THEN 'abandoned' ELSE coalesce(status, '') END, n) = '' THEN NULL ELSE arg_max(CASE WHEN status = 'in_flight' AND due <= epoch_ms(TIMESTAMP '2024-01-20') THEN 'abandoned' ELSE coalesce(status, '') END, n) END AS status,
  arg_max(rec, n) AS reconcile_required, max(n) AS n_events, count(*) FILTER (NOT taken) AS n_refused FROM run GROUP BY task""")
def work_state(spark, sf):
    task = F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 6).cast("string"))
    e = table(spark, sf, "events").select(task.alias("task"), F.expr(_EVENT).alias("event"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return keyed.work_table(e, "task", "event", "ts", "event_id", ttl="6 hours", until="2024-01-20 00:00:00")


@query("""
WITH RECURSIVE b AS (SELECT user_id, (k - 1) // 4 AS u, (k - 1) % 4 AS b, CASE WHEN event_type <> 'error' THEN CAST(value > 100 AS BIGINT) END AS g, k AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)),
run AS (SELECT DISTINCT user_id, 0::BIGINT AS n, -1::BIGINT AS u, NULL::BIGINT AS b, 0::BIGINT AS took, 0::BIGINT AS got, 0::BIGINT AS skipped, false AS ended, false AS used FROM b
  UNION ALL SELECT user_id, n, u, b, took + used::INT, got + CASE WHEN used THEN coalesce(g, 0) ELSE 0 END, skipped, ended, used
  FROM (SELECT *, NOT ended AND took < 3 AND got < 1 AS used FROM (SELECT user_id, n, u, b, g, CASE WHEN fresh THEN 0 ELSE took END AS took, CASE WHEN fresh THEN 0 ELSE got END AS got, skipped, ended OR skipped > 2 AS ended
    FROM (SELECT b.user_id, b.n, b.u, b.b, b.g, b.u > r.u AS fresh, r.took, r.got, r.ended, CASE WHEN b.u > r.u AND r.u >= 0 AND NOT r.ended THEN CASE WHEN r.got >= 1 THEN 0 ELSE r.skipped + 1 END ELSE r.skipped END AS skipped FROM run r JOIN b ON b.user_id = r.user_id AND b.n = r.n + 1))))
SELECT user_id, u AS update, b AS batch, used, got >= 1 AS enough, skipped, ended FROM run WHERE n > 0""")
def retry_state(spark, sf):
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    useful = F.when(F.col("event_type") != "error", (F.col("value") > 100).cast("long"))
    b = table(spark, sf, "events").select("user_id", F.floor(k / 4).alias("u"), (k % 4).alias("b"), useful.alias("g"))
    return keyed.retry_table(b, "user_id", "u", "b", "g", required=1, batches=3, skips=2)


_ROLLOUTS = "(SELECT event_type AS source, user_id AS prompt, round(value / 20) AS v, event_id % 3 AS l FROM events)"


@query(f"""
WITH e AS (SELECT *, count(*) OVER (PARTITION BY source, prompt) AS k FROM {_ROLLOUTS}),
ns AS (SELECT DISTINCT source, prompt, k, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256], lambda x: x < k), k)) AS n FROM e WHERE k > 1),
cdf AS (SELECT DISTINCT source, prompt, v, k, count(*) OVER (PARTITION BY source, prompt ORDER BY v) AS le, count(*) OVER (PARTITION BY source, prompt ORDER BY v DESC) AS ge, count(*) OVER (PARTITION BY source, prompt, v) AS c FROM e),
ends AS (SELECT source, prompt, n, sum(v * ((le / k) ^ n - ((le - c) / k) ^ n)) AS b, sum(v * v * ((le / k) ^ n - ((le - c) / k) ^ n)) AS bb, sum(v * ((ge / k) ^ n - ((ge - c) / k) ^ n)) AS w, sum(v * v * ((ge / k) ^ n - ((ge - c) / k) ^ n)) AS ww FROM cdf JOIN ns USING (source, prompt, k) GROUP BY ALL),
labels AS (SELECT source, prompt, l, count(*) / any_value(k) AS p, avg(v) AS m, avg(v * v) AS q FROM e GROUP BY source, prompt, l),
three AS (SELECT ns.*, coalesce(a.p, 0) AS pa, coalesce(b.p, 0) AS pb, coalesce(c.p, 0) AS pc, coalesce(a.m, 0) AS ma, coalesce(b.m, 0) AS mb, coalesce(c.m, 0) AS mc, coalesce(a.q, 0) AS qa, coalesce(b.q, 0) AS qb, coalesce(c.q, 0) AS qc FROM ns
  LEFT JOIN labels a ON a.source = ns.source AND a.prompt = ns.prompt AND a.l = 0 LEFT JOIN labels b ON b.source = ns.source AND b.prompt = ns.prompt AND b.l = 1 LEFT JOIN labels c ON c.source = ns.source AND c.prompt = ns.prompt AND c.l = 2),
x AS (SELECT *, unnest(range(0, n + 1)) AS i FROM three), y AS (SELECT *, unnest(range(0, n - i + 1)) AS j FROM x), z AS (SELECT *, n - i - j AS h, greatest(i, j, n - i - j) AS top FROM y),
chance AS (SELECT *, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(j + 1) - lgamma(h + 1)) * pa ^ i * pb ^ j * pc ^ h / ((i = top)::INT + (j = top)::INT + (h = top)::INT) AS p FROM z),
maj AS (SELECT source, prompt, n, sum(p * ((i = top)::INT * ma + (j = top)::INT * mb + (h = top)::INT * mc)) AS m, sum(p * ((i = top)::INT * qa + (j = top)::INT * qb + (h = top)::INT * qc)) AS q FROM chance GROUP BY ALL)
SELECT source, n, count(*) AS n_prompts, round(avg(b), 5) AS best_mean, round(avg(sqrt(greatest(bb - b * b, 0))), 5) AS best_std, round(avg(w), 5) AS worst_mean, round(avg(sqrt(greatest(ww - w * w, 0))), 5) AS worst_std, round(avg(m), 5) AS maj_mean, round(avg(sqrt(greatest(q - m * m, 0))), 5) AS maj_std
FROM ends JOIN maj USING (source, prompt, n) GROUP BY source, n""")
def majority_series(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("prompt"), F.round(F.col("value") / 20).alias("v"), (F.col("event_id") % 3).alias("l"))
    per = validation.series(e, ["source", "prompt"], "v", "l")
    means = [F.round(F.avg(f"{k}_{p}"), 5).alias(f"{k}_{p}") for k in ("best", "worst", "maj") for p in ("mean", "std")]
    return per.groupBy("source", "n").agg(F.count("*").alias("n_prompts"), *means)
