"""Queries on validation, work queues, outcomes and summaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions import messages as ms
from ..functions import text as tx
from ..operators import attempts, replay, sampling
from ..operators import sequences as seq
from ..sources.io import table
from .registry import query

_ROLE = "CASE WHEN conv_id % 19 = 3 AND turn = 2 THEN 'human' WHEN role = 'user' AND turn > 1 AND conv_id % 3 > 0 THEN 'tool' ELSE role END"
_ID, _ANSWERS = "concat('call_', turn)", "CASE WHEN conv_id % 11 = 1 THEN concat('call_', turn) WHEN conv_id % 13 = 1 THEN '' ELSE concat('call_', turn - 1) END"
_ARGS = """CASE WHEN conv_id % 5 = 1 AND turn % 3 = 1 THEN '{"choice": "answer", "Reward": 1}' WHEN conv_id % 7 = 1 THEN '["search"]' WHEN conv_id % 17 = 2 THEN NULL ELSE '{"choice": "search", "content": {"best_id": 1}}' END"""
_RECORD = f"(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, {_ROLE} AS role, {_ID} AS id, {_ANSWERS} AS answers, {_ARGS} AS args FROM conversations)"


@query(f"""
WITH m AS (SELECT *, max(CASE WHEN role = 'assistant' THEN i END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {_RECORD}),
found AS (SELECT conv_id, 1 + i AS spot, CASE WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN '_role' WHEN role = 'assistant' AND args IS NULL THEN '_tool_function_0' WHEN role = 'assistant' AND json_type(args) <> 'OBJECT' THEN '_tool_arguments_0'
    WHEN role = 'assistant' AND len(list_intersect(list_transform(json_keys(args), lambda k: lower(k)), ['preference_id', 'preference_ids', 'correct_id', 'correct_ids', 'best_id', 'best_ids', 'reward', 'step_reward', 'terminal_reward', 'reward_report', 'ground_truth'])) > 0 THEN '_tool_arguments_0_private_keys'
    WHEN role = 'tool' AND (answers = '' OR last IS NULL OR answers <> (SELECT id FROM m c WHERE c.conv_id = m.conv_id AND c.i = m.last)) THEN '_tool_call_id' END AS code FROM m),
codes AS (SELECT conv_id, spot, concat('message_', spot - 1, code) AS code FROM found WHERE code IS NOT NULL
  UNION ALL SELECT DISTINCT conv_id, -2, 'schema_version_mismatch' FROM conversations WHERE conv_id % 23 = 0 UNION ALL SELECT DISTINCT conv_id, -1, 'assistant_train_mask_length' FROM conversations WHERE conv_id % 29 = 0
  UNION ALL SELECT DISTINCT conv_id, 1000000, 'tools_schema_missing' FROM conversations WHERE conv_id % 31 = 0)
SELECT c.conv_id, coalesce(string_agg(code, ',' ORDER BY spot), '') AS codes FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN codes USING (conv_id) GROUP BY c.conv_id""")
def canonical_violations(spark, sf):
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf, "conversations").select("conv_id", place.alias("i"), *[F.expr(sql).alias(c) for c, sql in (("role", _ROLE), ("id", _ID), ("answers", _ANSWERS), ("args", _ARGS))])
    function = F.when(F.col("args").isNotNull(), F.struct(F.col("args").alias("arguments")))
    call = F.when(F.col("role") == "assistant", F.array(F.struct("id", function.alias("function"))))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", call.alias("tool_calls"), F.col("answers").alias("tool_call_id")))).alias("m"))
    mask = F.slice(F.transform("m", lambda x: F.lit(1)), 1, F.size("m") - (F.col("conv_id") % 29 == 0).cast("int"))
    version = F.when(F.col("conv_id") % 23 != 0, replay.SCHEMA_VERSION)
    codes = replay.violations(version, F.col("m"), mask, F.when(F.col("conv_id") % 31 != 0, F.array(F.lit("tool"))))
    return held.select("conv_id", F.concat_ws(",", codes).alias("codes"))


_SHOWN = """concat('{"current_aspect": "', event_type, '", ', CASE WHEN event_id % 5 = 0 THEN '' ELSE '"step": 1, ' END, '"notes": [{"say": "he said \\\\"Gold\\\\": ', CASE event_id % 7 WHEN 0 THEN 'P12' WHEN 1 THEN 'reward = 3' ELSE 'xP1' END, '"}, ',
  CASE event_id % 11 WHEN 0 THEN '{"GOLD": 1}' WHEN 1 THEN '{"a": {"t\\\\u0061sk": []}}' WHEN 2 THEN '{"tasks": "task"}' WHEN 3 THEN '{' ELSE '7' END, ']}')"""


@query("""
WITH d AS (SELECT event_id, @ AS t FROM events)
SELECT event_id, CASE WHEN NOT json_valid(t) THEN 'not_an_object' ELSE concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'missing:step' END, CASE event_id % 11 WHEN 0 THEN 'forbidden:GOLD' WHEN 1 THEN 'forbidden:task' END,
  CASE event_id % 7 WHEN 0 THEN 'preference' WHEN 1 THEN 'reward' END) END AS faults FROM d""".replace("@", _SHOWN.replace("\\\\", "\\")))
def forbidden_key_guard(spark, sf):
    faults = jsons.observation_faults(F.expr(_SHOWN), ["step", "current_aspect"], ["gold", "task"])
    return table(spark, sf, "events").select("event_id", F.concat_ws(",", faults).alias("faults"))


@query("""
SELECT o_orderkey, pass FROM (SELECT DISTINCT o_orderkey FROM orders) o, (SELECT unnest([0, 1]) AS pass) p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber % 2 = pass AND l.l_returnflag IN ('A', 'R'))""")
def pending_work(spark, sf):
    tasks = table(spark, sf, "orders").select("o_orderkey").distinct().withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    done = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 2).cast("int").alias("pass"))
    return tasks.join(done, ["o_orderkey", "pass"], "left_anti")


_BATCHES = "(SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 2 AS batch, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0 ELSE value END AS score FROM events)"


@query(f"""
WITH e AS (SELECT user_id, batch, max(score) - min(score) AS spread FROM {_BATCHES} WHERE batch < 3 GROUP BY ALL)
SELECT user_id, min(CASE WHEN spread >= 5e-3 THEN batch END) AS used_batch, round(max(spread), 6) AS spread, min(CASE WHEN spread >= 5e-3 THEN batch END) IS NULL AS skip FROM e GROUP BY user_id""")
def bounded_retry(spark, sf):
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf, "events").select("user_id", F.floor(at / 2).alias("batch"), F.when(F.col("event_type").isin("view", "click", "signup"), 0.0).otherwise(F.col("value")).alias("score"))
    return attempts.retry_until_varied(e, "user_id", "batch", "score").withColumn("spread", F.round("spread", 6))


@query("""
WITH t AS (SELECT event_id, user_id, event_id % 3 AS aspect, trim(regexp_replace(lower(concat(event_type, CASE WHEN event_id % 2 = 0 THEN '?!' ELSE ' ' END, floor(value / 30))), '[^a-z0-9_]+', ' ', 'g')) AS q, value > 60 AS gained FROM events),
d AS (SELECT *, EXISTS (SELECT 1 FROM t b WHERE b.user_id = a.user_id AND b.aspect = a.aspect AND b.q = a.q AND b.event_id < a.event_id) AS dup,
  (SELECT count(*) FROM t b WHERE b.user_id = a.user_id AND b.aspect = a.aspect AND NOT b.gained AND b.event_id <= a.event_id) AS misses FROM t a)
SELECT event_id, CASE WHEN dup THEN 'duplicate' WHEN gained THEN 'useful' WHEN misses > 1 THEN 'no_gain' ELSE 'no_gain_first' END AS outcome, dup OR (NOT gained AND misses > 1) AS redundant FROM d""")
def action_outcomes(spark, sf):
    said = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "?!").otherwise(" "), F.floor(F.col("value") / 30).cast("string"))
    t = table(spark, sf, "events").withColumns({"aspect": F.col("event_id") % 3, "q": said})
    return replay.action_outcomes(t, "user_id", "aspect", "q", "event_id", F.col("value") > 60).select("event_id", "outcome", "redundant")



@query("""
WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 40))) AS v, list_distinct(list(event_type) FILTER (value > 250)) AS g, list_distinct(list(event_type) FILTER (value < 1)) AS p FROM events GROUP BY user_id),
r AS (SELECT user_id, coalesce(v, []) AS v, coalesce(g, []) AS g, coalesce(p, []) AS p FROM a),
s AS (SELECT *, CASE WHEN len(list_intersect(g, v)) > 0 THEN list_intersect(g, v) ELSE list_intersect(p, v) END AS got FROM r)
SELECT user_id, array_to_string(list_sort(got), ',') AS revealed, CAST(len(v) - len(got) AS INT) AS n_left FROM s""")
def preference_reveal(spark, sf):
    some = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    v = F.col("value")
    a = table(spark, sf, "events").groupBy("user_id").agg(some(v > 40).alias("v"), some(v > 250).alias("g"), some(v < 1).alias("p"))
    got, left = replay.reveal(F.col("v"), F.col("g"), F.col("p"))
    return a.select("user_id", F.concat_ws(",", F.array_sort(got)).alias("revealed"), F.size(left).alias("n_left"))


@query("""
WITH p AS (SELECT user_id, event_type, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS best, min(value) AS worst, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, round(avg(mean), 5) AS mean_at_n, round(avg(std), 5) AS std_at_n, round(avg(best), 5) AS best, round(avg(worst), 5) AS worst, max(n) AS n FROM p GROUP BY event_type""")
def validation_statistics(spark, sf):
    v = F.col("value")
    p = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("best"), F.min(v).alias("worst"), F.count("*").alias("n"))
    return p.groupBy("event_type").agg(*[F.round(F.avg(a), 5).alias(b) for a, b in (("mean", "mean_at_n"), ("std", "std_at_n"), ("best", "best"), ("worst", "worst"))], F.max("n").alias("n"))


@query("SELECT c_mktsegment, round(avg(m), 4) AS source_mean, count(*) AS n FROM (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def source_mean(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.round(F.avg("m"), 4).alias("source_mean"), F.count("*").alias("n"))


@query("""
WITH r AS (SELECT l_orderkey, sum(l_discount * l_quantity) AS s, sum(l_quantity) AS w FROM lineitem GROUP BY 1)
SELECT round(sum(s) / sum(w), 7) AS nll, round(exp(least(50.0, sum(s) / sum(w))), 7) AS perplexity, round(avg(s / w), 7) AS macro_nll FROM r""")
def weighted_nll(spark, sf):
    out = attempts.nll(table(spark, sf, "lineitem"), "l_orderkey", "l_discount", "l_quantity")
    return out.select(*[F.round(c, 7).alias(c) for c in out.columns])


@query("SELECT l_returnflag, round(1 - var_samp(l_tax - l_discount) / (var_samp(l_tax) + 1e-5), 6) AS explained_variance, round(sum(l_extendedprice) / sum(l_quantity), 5) AS per_token FROM lineitem GROUP BY 1")
def explained_variance(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(1 - F.var_samp(F.col("l_tax") - F.col("l_discount")) / (F.var_samp("l_tax") + 1e-5), 6).alias("explained_variance"),
        F.round(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")), 5).alias("per_token"),
    )


@query("""
SELECT user_id, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS parse_rate, round(coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type <> 'error'), 0), 0), 6) AS choice_rate FROM events GROUP BY user_id""")
def call_rates(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    ok = n(F.col("event_type") != "error")
    rates = (F.try_divide(ok, F.count("*")).alias("parse_rate"), F.coalesce(F.try_divide(n(F.col("event_type") == "purchase"), ok), F.lit(0.0)).alias("choice_rate"))
    return table(spark, sf, "events").groupBy("user_id").agg(*rates).select("user_id", F.round("parse_rate", 6).alias("parse_rate"), F.round("choice_rate", 6).alias("choice_rate"))


@query("""
SELECT user_id, round(0.01 * exp(sum(ln(1 + greatest(-0.2, least(0.2, value / 50 - 1)) * 0.1))), 7) AS beta FROM events GROUP BY user_id""")
def kl_controller(spark, sf):
    steps = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    clip = lambda x: F.greatest(F.lit(-0.2), F.least(F.lit(0.2), x["value"] / 50 - 1))
    beta = F.aggregate(steps, F.lit(0.01), lambda b, x: b * (1 + clip(x) * 0.1))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(beta, 7).alias("beta"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('9:' || lang || ':' || doc_id), doc_id) <= floor(0.85 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def train_test_rows(spark, sf):
    return sampling.share_split(table(spark, sf, "documents").select("doc_id", "lang"), sampling.hash_key(9, "lang", "doc_id"), "doc_id", 0.85).select("doc_id", "split")


@query("""
WITH g AS (SELECT lang, source, max(n_chars) AS n, lang || '::' || source AS key FROM documents GROUP BY lang, source),
o AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS place, count(*) OVER () AS m FROM g),
e AS (SELECT max(CASE WHEN place = (m - 1) // 3 THEN n END) AS lo, max(CASE WHEN place = least(m - 1, 2 * m // 3) THEN n END) AS hi FROM o),
b AS (SELECT lang, source, n, key, CASE WHEN n <= lo THEN 'short' WHEN n >= hi THEN 'long' ELSE 'mid' END AS bucket FROM g, e),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('env:20260801:' || lang || ':' || key), key) = 1 AS first FROM b),
k AS (SELECT *, bucket IN (SELECT bucket FROM f WHERE first) AS have, row_number() OVER (PARTITION BY bucket, first ORDER BY sha256('bucket:20260801:' || bucket || ':' || key), key) = 1 AS by_bucket FROM f),
s AS (SELECT *, CASE WHEN first THEN 0 WHEN NOT have AND by_bucket THEN 1 ELSE 2 END AS stage FROM k)
SELECT lang, source, n, key, bucket, ['environment', 'length', 'extra'][stage + 1] AS reason FROM s ORDER BY stage, sha256('extra:20260801:' || key) LIMIT 10""")
def validation_pick(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang", "source").agg(F.max("n_chars").alias("n"))
    return sampling.pick_validation(g.withColumn("key", F.concat_ws("::", "lang", "source")), "lang", "key", "n", 10, 20260801)


@query("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def ordered_unique(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("first_seen"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'seen' ELSE 'unseen' END AS part FROM customer")
def seen_unseen(spark, sf):
    seen = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("part", F.lit("seen"))
    return table(spark, sf, "customer").select("c_custkey").join(seen, "c_custkey", "left").fillna("unseen", ["part"])


@query("SELECT event_id, coalesce(CASE WHEN isfinite(x) THEN x END, -1.0) AS x FROM (SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS x FROM events)")
def finite_coercion(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, "nan").when(F.col("event_id") % 4 == 1, "n/a").otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", tx.finite_or(raw, -1.0).alias("x"))


@query("SELECT doc_id, CAST(ceil(n_chars / 128) * 128 AS BIGINT) AS padded FROM documents")
def padded_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", seq.round_up(F.col("n_chars")).alias("padded"))


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) ON o_custkey = c_custkey AND k = 1""")
def first_match_join(spark, sf):
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("x"))
    return table(spark, sf, "customer").select("c_custkey").join(first, "c_custkey", "left").select("c_custkey", "x.o_orderkey", "x.o_totalprice")


@query("""
SELECT n_name, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def star_join_summary(spark, sf):
    line = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return line.groupBy("n_name").agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"), F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"))


@query("""
SELECT user_id, count(*) % 25 AS steps, 25 - count(*) % 25 <= 8 - count(DISTINCT CASE WHEN value > 180 THEN event_id % 4 END) - count(DISTINCT CASE WHEN value > 230 THEN event_id % 4 END) AS blocked
FROM events GROUP BY user_id""")
def deadline_guard(spark, sf):
    aspect = (F.col("event_id") % 4).cast("string")
    aspects = F.array(*[F.lit(str(a)) for a in range(4)])
    aggs = {"steps": F.count("*") % 25, "searched": F.collect_set(F.when(F.col("value") > 180, aspect)), "answered": F.collect_set(F.when(F.col("value") > 230, aspect))}
    per = table(spark, sf, "events").groupBy("user_id").agg(*[c.alias(n) for n, c in aggs.items()])
    return per.select("user_id", "steps", replay.deadline_blocks(25, F.col("steps"), aspects, F.col("searched"), F.col("answered")).alias("blocked"))


@query("""
SELECT c.c_custkey, count(o.o_orderkey) AS n_calls, coalesce(sum(length(o.o_orderpriority)), 0)::BIGINT AS tokens
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def usage_totals(spark, sf):
    calls = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.length("o_orderpriority").alias("tokens"))
    return attempts.usage(table(spark, sf, "customer"), calls, "c_custkey", ["tokens"])


@query("SELECT l_suppkey, count(*) AS n, avg(CASE WHEN (l_returnflag = 'N') = (l_linestatus = 'O') THEN 1.0 ELSE 0 END) AS same_flag, avg(CASE WHEN l_linenumber = CAST(l_quantity AS INT) THEN 1.0 ELSE 0 END) AS same_number FROM lineitem GROUP BY l_suppkey")
def match_rates(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"q": F.col("l_quantity").cast("int"), "kept": F.col("l_returnflag") == "N", "open": F.col("l_linestatus") == "O"})
    return attempts.match_rates(rows, "l_suppkey", {"same_flag": ("kept", "open"), "same_number": ("l_linenumber", "q")})


@query()
def bootstrap_draws(spark, sf):
    return attempts.bootstrap(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber", 2)


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 1 AND trim(coalesce(text, ''), ' ') <> '' THEN '<think>' || chr(10) || trim(text, ' ') || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END
  || '<tool_call>' || chr(10) || '{"turn": ' || turn || '}' || chr(10) || '</tool_call>' AS message FROM conversations WHERE role = 'assistant'""")
def training_messages(spark, sf):
    call = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))
    thought = F.when(F.col("turn") % 2 == 1, F.col("text"))
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", ms.training_message(call, thought, F.lit("")).alias("message"))


@query("""
SELECT doc_id, coalesce(lang, '') = 'de' OR lower(coalesce(source, '')) = 'web' OR contains(coalesce(text, ''), 'password') OR contains(coalesce(source, ''), 'password') AS ours FROM documents""")
def domain_rows(spark, sf):
    row = F.struct("text", "lang", "source")
    return table(spark, sf, "documents").select("doc_id", tx.belongs(row, ["password"], F.col("lang") == "de", F.lower("source") == "web").alias("ours"))


@query(r"""
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '\frac{' || q || '}{7}' WHEN 2 THEN '\frac{1}{' || q || '}' WHEN 3 THEN '\sqrt{3}' || q WHEN 4 THEN '\frac{1}{2}' WHEN 5 THEN '(' || q || ',1)' ELSE q::VARCHAR END AS answer
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem)""")
def latex_answers(spark, sf):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    said = (
        F.when(n == 1, F.concat(F.lit("x="), q, F.lit("/7"))).when(n == 2, F.concat(F.lit(r"\dfrac1{"), q, F.lit("}"))).when(n == 3, F.concat(F.lit(r"\sqrt3 "), q))
        .when(n == 4, F.lit(".5")).when(n == 5, F.concat(F.lit(r"\left( "), q, F.lit(r", 1\right)"))).when(n == 6, F.concat(q, F.lit(r"\%"))).otherwise(F.concat(q, F.lit(r"\text{ cm}")))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tx.latex_answer(said).alias("answer"))
