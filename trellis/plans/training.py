"""Queries on what goes into training: pools, gates, masks, routed credit, graded values, scorers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grading, messages, scorers, tokens
from ..operators import credit, gates
from ..sources.io import table
from .registry import query


@query("""
WITH r AS (SELECT lang AS pool, CASE WHEN n_chars % 97 = 0 THEN 'opaque::' ELSE 's::' END || source || '::' || (n_chars % 50) AS key FROM documents),
g AS (SELECT key, list_sort(list(DISTINCT pool)) AS pools, count(*) AS n, count(DISTINCT pool) AS p FROM r GROUP BY key)
SELECT kind, key, array_to_string(pools, ',') AS pools FROM (
  SELECT 'duplicate' AS kind, * FROM g WHERE n > p UNION ALL SELECT 'overlap', * FROM g WHERE list_contains(pools, 'en') AND list_contains(pools, 'fr')
  UNION ALL SELECT 'outside_parent', * FROM g WHERE list_contains(pools, 'es') AND NOT list_contains(pools, 'en') UNION ALL SELECT 'opaque', * FROM g WHERE starts_with(key, 'opaque::'))""")
def pool_invariants(spark, sf):
    kind = F.when(F.col("n_chars") % 97 == 0, "opaque").otherwise("s")
    rows = table(spark, sf, "documents").select(F.col("lang").alias("pool"), F.concat_ws("::", kind, "source", (F.col("n_chars") % 50).cast("string")).alias("key"))
    return gates.pool_violations(rows, "pool", "key", disjoint=["en", "fr"], parents={"es": "en"})


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users, count(*) FILTER (length(text) > 200) AS longs FROM conversations GROUP BY conv_id)
SELECT name, CAST(length AS INT) AS length, CAST(n AS INT) AS expected, count(*) AS n_rows FROM (SELECT 'users' AS name, users AS length, n FROM c UNION ALL SELECT 'longs', longs, n FROM c) WHERE length <> n GROUP BY ALL""")
def list_alignment(spark, sf):
    some = lambda test: F.collect_list(F.when(test, F.col("text")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), some(F.col("role") == "user").alias("users"), some(F.length("text") > 200).alias("longs"))
    return gates.misaligned(c, ["users", "longs"], F.col("n"))


@query("SELECT l_orderkey, l_linenumber, round(avg(l_tax) OVER (PARTITION BY l_orderkey), 9) AS advantage FROM lineitem")
def gated_credit(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").cast("double").alias("before"))
    line = line.withColumn("after", F.avg("before").over(W.partitionBy("l_orderkey")))
    out, _ = gates.stage_gate(line, "l_orderkey", "before", "after", "train")
    return out.select("l_orderkey", "l_linenumber", F.round("advantage", 9).alias("advantage"))


@query("""
WITH t AS (SELECT o_orderpriority AS env, o_orderkey AS key, o_orderkey % 37 = 0 AS known FROM orders WHERE o_orderstatus <> 'P'),
g AS (SELECT count(*) // 4 AS target FROM t), s AS (SELECT env, count(*) AS size, sum(CAST(known AS INT)) AS have FROM t GROUP BY env),
f AS (SELECT env, have, floor(size * target / sum(size) OVER ()) AS f, round(size * target / sum(size) OVER () - floor(size * target / sum(size) OVER ()), 9) AS r, target FROM s, g),
q AS (SELECT env, f + CAST(row_number() OVER (ORDER BY r DESC, env DESC) <= target - sum(f) OVER () AS INT) - have AS more FROM f),
n AS (SELECT env, key, row_number() OVER (PARTITION BY env ORDER BY sha256('7:' || env || ':' || key), key) <= more AS taken FROM t JOIN q USING (env) WHERE NOT known),
sft AS (SELECT env, key, 'known' AS role FROM t WHERE known UNION ALL SELECT env, key, 'expansion' FROM n WHERE taken),
m AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY sha256('7:sft-smoke:' || env || ':' || key), key) AS k FROM sft)
SELECT env, key, 'sft' AS pool, role FROM sft UNION ALL SELECT env, key, 'sft_smoke', role FROM m WHERE k <= CASE env WHEN '1-URGENT' THEN 3 WHEN '5-LOW' THEN 2 ELSE 0 END
UNION ALL SELECT env, key, 'rollout', 'rollout' FROM n WHERE NOT taken""")
def training_pools(spark, sf):
    split = F.when(F.col("o_orderstatus") == "P", "test").otherwise("train")
    tasks = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("env"), F.col("o_orderkey").alias("key"), split.alias("split"))
    train = tasks.where("split = 'train'")
    return gates.training_pools(tasks, env="env", key="key", split="split", known=train.where("key % 37 = 0"), target=train.count() // 4, smoke={"1-URGENT": 3, "5-LOW": 2}, seed=7)


@query("""
WITH k AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'stale' ELSE sha256(c_custkey || '::' || c_name) END AS key, CASE c_custkey % 7 WHEN 0 THEN 'x' ELSE c_mktsegment END AS pool, c_mktsegment, 'run' || (c_custkey % 3 > 0) AS run FROM customer)
SELECT key, kind FROM (SELECT key, 'key' AS kind FROM k WHERE c_custkey % 5 = 0 UNION ALL SELECT key, 'pool' FROM k WHERE pool <> c_mktsegment UNION ALL SELECT key, 'run' FROM k WHERE run <> 'runtrue')""")
def cache_integrity(spark, sf):
    c, i = table(spark, sf, "customer"), F.col("c_custkey")
    key = F.when(i % 5 == 0, "stale").otherwise(F.sha2(F.concat_ws("::", i.cast("string"), "c_name"), 256))
    held = c.select("c_custkey", "c_name", "c_mktsegment", key.alias("key"), F.when(i % 7 == 0, "x").otherwise(F.col("c_mktsegment")).alias("pool"), F.concat(F.lit("run"), (i % 3 > 0).cast("string")).alias("run"))
    return gates.cache_violations(held, "key", ["c_custkey", "c_name"], {"pool": "c_mktsegment"}, "run", F.lit("runtrue"))


_TOKENS = "(SELECT l_orderkey, list(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 10 + CAST(l_quantity AS INT) END ORDER BY l_linenumber, l_partkey, l_quantity) AS t FROM lineitem GROUP BY l_orderkey)"


def _tokens(spark, sf):
    token = F.when(F.col("l_returnflag") == "R", 2).otherwise(10 + F.col("l_quantity").cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", token.alias("t"))))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["t"]).alias("t"))


def _flat(name):
    return F.concat_ws(",", F.transform(name, lambda x: x.cast("string"))).alias(name if isinstance(name, str) else "x")


@query(f"""
WITH e AS (SELECT l_orderkey, t, list_filter(range(0, len(t)), lambda i: t[i + 1] = 2) AS e FROM {_TOKENS})
SELECT l_orderkey, array_to_string(list_transform(range(0, len(t)), lambda i: CASE WHEN len(e) > 1 AND i > e[1] AND i <= e[2] THEN 0 ELSE 1 END), ',') AS mask FROM e""")
def tool_turn_mask(spark, sf):
    roles = F.array(*[F.lit(r) for r in ("assistant", "tool", "tool", "assistant")])
    t = _tokens(spark, sf).withColumn("mask", tokens.mask_tool_turns(F.col("t"), F.transform("t", lambda _: F.lit(1)), roles, 2))
    return t.select("l_orderkey", _flat("mask"))


@query(f"""
SELECT l_orderkey, array_to_string(list_transform(range(0, len(t)), lambda i: CAST(i >= 1 AND i < 4 AS INT)), ',') AS loss, array_to_string(list_transform(range(0, len(t)), lambda i: CAST(i >= 1 AND i < 2 AS INT)), ',') AS reasoning,
  array_to_string(list_transform(range(0, len(t)), lambda i: CAST(i >= 2 AND i < 4 AS INT)), ',') AS call FROM {_TOKENS}""")
def message_span_masks(spark, sf):
    upto = lambda n: F.slice("t", F.lit(1), F.lit(n))
    wrong = F.array(F.lit(-1))
    spans = F.array(F.struct(F.lit(1).alias("trained"), wrong.alias("before"), upto(1).alias("plain"), upto(2).alias("thought"), upto(4).alias("after")), F.struct(F.lit(0).alias("trained"), wrong.alias("before"), wrong.alias("plain"), wrong.alias("thought"), wrong.alias("after")))
    m = _tokens(spark, sf).select("l_orderkey", tokens.span_masks(F.col("t"), spans).alias("m")).select("l_orderkey", "m.*")
    return m.select("l_orderkey", _flat("loss"), _flat("reasoning"), _flat("call"))


@query(f"""
WITH c AS (SELECT l_orderkey, t[1:4] AS t FROM {_TOKENS}), p AS (SELECT l_orderkey, t, 4 - len(t) AS n FROM c)
SELECT l_orderkey, array_to_string(list_concat(t, list_transform(range(0, n), lambda i: 0)), ',') AS input_ids,
  array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i < len(t) THEN i ELSE 0 END), ',') AS position_ids,
  array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i < len(t) AND t[i + 1] > 30 THEN 1 ELSE 0 END), ',') AS loss_mask FROM p""")
def training_rows(spark, sf):
    row = tokens.training_row(F.col("t"), F.transform("t", lambda x: (x > 30).cast("int")), 4, side="right")
    r = _tokens(spark, sf).select("l_orderkey", row.alias("r")).select("l_orderkey", "r.*")
    return r.select("l_orderkey", _flat("input_ids"), _flat("position_ids"), _flat("loss_mask"))


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8) AS z FROM embeddings),
n AS (SELECT *, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS lse FROM e)
SELECT vec_id, round(z[label % 64 + 1] - lse, 6) AS log_prob, round(lse - list_sum(list_transform(z, lambda x: exp(x - lse) * x)), 6) AS entropy FROM n""")
def log_probs(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("z", F.transform("embedding", lambda x: x.cast("double") * 8))
    return e.select("vec_id", F.round(tokens.log_prob(F.col("z"), (F.col("label") % 64).cast("int")), 6).alias("log_prob"), F.round(tokens.entropy(F.col("z")), 6).alias("entropy"))


_TURNS = """(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i, CASE WHEN l_partkey % 2 = 0 THEN 'flight' ELSE 'hotel' END AS aspect,
  l_returnflag = 'N' AS s, l_quantity > 25 AS u, l_linenumber % 3 = 0 AS c FROM lineitem)"""


@query(f"""
WITH t AS (SELECT * FROM {_TURNS}),
a AS (SELECT a.l_orderkey, a.i, min(CASE WHEN b.s THEN b.i END) AS search, count(CASE WHEN b.u THEN 1 END) AS n FROM t a LEFT JOIN t b ON b.l_orderkey = a.l_orderkey AND b.i < a.i AND b.aspect = a.aspect WHERE a.c GROUP BY ALL),
w AS (SELECT l_orderkey, coalesce(search, i) AS i, 0.15 AS w FROM a UNION ALL SELECT l_orderkey, i, 0.60 FROM a UNION ALL SELECT l_orderkey, i, 0.25 FROM a WHERE n = 0
  UNION ALL SELECT a.l_orderkey, b.i, 0.25 / n FROM a JOIN t x ON x.l_orderkey = a.l_orderkey AND x.i = a.i JOIN t b ON b.l_orderkey = a.l_orderkey AND b.i < a.i AND b.aspect = x.aspect AND b.u),
s AS (SELECT l_orderkey, i, sum(w) AS w FROM w GROUP BY ALL),
p AS (SELECT l_orderkey, sum(CAST(s OR u AS INT)) AS n, count(*) AS m, bool_or(c) AS answered FROM t GROUP BY l_orderkey)
SELECT l_orderkey, t.i, round(CASE WHEN answered THEN coalesce(w, 0) / sum(coalesce(w, 0)) OVER (PARTITION BY l_orderkey) WHEN n > 0 THEN CAST(t.s OR u AS INT) / n ELSE 1.0 / m END, 7) AS weight
FROM t JOIN p USING (l_orderkey) LEFT JOIN s USING (l_orderkey, i)""")
def causal_routing(spark, sf):
    line = table(spark, sf, "lineitem")
    flags = {"accepted": F.lit(True), "new_search": F.col("l_returnflag") == "N", "useful_action": F.col("l_quantity") > 25, "correct_answer": F.col("l_linenumber") % 3 == 0}
    others = ("no_gain_action", "duplicate_action", "redundant_action", "invalid_call", "completed_aspect", "best_answer", "legal_answer", "wrong_answer")
    event = F.struct("l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_partkey") % 2 == 0, "flight").otherwise("hotel").alias("aspect"), *[c.alias(n) for n, c in flags.items()], *[F.lit(False).alias(n) for n in others], F.lit(0).alias("new_preference_count"))
    e = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(event)).alias("e"))
    return e.select("l_orderkey", F.posexplode(credit.route("correct_completion", F.lit(1.0), F.col("e"))).alias("i", "w")).select("l_orderkey", F.col("i").cast("long"), F.round("w", 7).alias("weight"))


def _plain_sql(c: str) -> str:
    """The plain value in SQL, from the same fixed values."""
    c = rf"regexp_replace(regexp_replace(regexp_replace({c}, '^\\text\{{(.+?)\}}$', '\1'), '\\?[%$]', '', 'g'), ' (or|and) ', ' , ', 'g')"
    for word, power in grading.POWERS:
        c = f"replace({c}, '{word}', '{power}')"
    for unit in grading.UNITS:
        c = rf"regexp_replace({c}, '{unit}(es)?(s)? *(\^[0-9]+)?', '', 'g')"
    c = rf"regexp_replace(regexp_replace(regexp_replace({c}, '\^ *\\circ', '', 'g'), '^\{{(.*)\}}$', '\1'), '- *', '-', 'g')"
    c = rf"lower(regexp_replace({c}, '([0-9]) +([0-9])', '\1+\2', 'g'))"
    return rf"list_transform([{c}], lambda x: CASE WHEN regexp_matches(replace(trim(x), ',', ''), '^[+-]?[0-9]+(\.0*)?$') THEN CAST(CAST(replace(trim(x), ',', '') AS DECIMAL(18, 3))::BIGINT AS VARCHAR) ELSE x END)[1]"


_VALUE = r"""CASE l_linenumber % 6 WHEN 0 THEN q || ' hours' WHEN 1 THEN '\text{' || q || ',000}' WHEN 2 THEN q || ' million dollars' WHEN 3 THEN '{- ' || q || '.0}' WHEN 4 THEN q || ' 3/4 Inches and 2 feet^2' ELSE '$' || q || '^ \circ' END"""


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, {_VALUE} AS v FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem))
SELECT l_orderkey, l_linenumber, {_plain_sql("v")} AS value FROM v""")
def plain_values(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string"))
    return line.select("l_orderkey", "l_linenumber", grading.plain_value(F.expr(_VALUE.replace("\\", "\\\\"))).alias("value"))


@query("""
WITH n AS (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'training/' WHEN 1 THEN 'val-core/' WHEN 2 THEN 'grpo/' ELSE 'smoke20/' END || event_type AS name FROM events)
SELECT CASE WHEN starts_with(name, 'grpo/') THEN name WHEN starts_with(name, 'training/') THEN 'grpo/train/' || event_type WHEN starts_with(name, 'val') THEN 'grpo/val/' || event_type ELSE 'grpo/val/' || name END AS name, count(*) AS n FROM n GROUP BY 1""")
def metric_names(spark, sf):
    k = F.col("event_id") % 4
    name = F.concat(F.when(k == 0, "training/").when(k == 1, "val-core/").when(k == 2, "grpo/").otherwise("smoke20/"), "event_type")
    return table(spark, sf, "events").groupBy(messages.metric_name(name).alias("name")).agg(F.count("*").alias("n"))


@scorers.register("length_share")
def _length_share(text, most):
    return F.least(F.lit(1.0), F.length(text) / most)


@scorers.register("is_short")
def _is_short(text, most):
    return (F.length(text) < most).cast("double")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN least(1.0, length(text) / 1000.0) WHEN 'fr' THEN CAST(length(text) < 1000 AS DOUBLE) END AS score FROM documents")
def scores_by_source(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scorers.dispatch(F.col("lang"), {"en": "length_share", "fr": "is_short"}, F.col("text"), F.lit(1000)).alias("score"))


@query("""
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'none' ELSE CAST(value AS VARCHAR) END AS reward, CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '1.0' END AS ok, value FROM events)
SELECT event_id, CASE WHEN event_id % 4 > 1 THEN value ELSE 0.0 END AS signal, event_id % 4 <= 1 OR coalesce(ok, '1') = '0' AS invalid FROM r""")
def reward_signals(spark, sf):
    i = F.col("event_id")
    reward = F.when(i % 4 == 0, "nan").when(i % 4 == 1, "none").otherwise(F.col("value").cast("string"))
    held = table(spark, sf, "events").select("event_id", reward.alias("reward"), F.when(i % 3 == 0, "0").when(i % 3 == 1, "1.0").alias("ok"))
    return gates.reward_signals(held, "reward", "ok").select("event_id", "signal", "invalid")


@query("""
SELECT conv_id, role AS phase, name, CAST(value AS BIGINT) AS value FROM (SELECT conv_id, role, 'chars' AS name, length(text) AS value FROM conversations
  UNION ALL SELECT conv_id, role, 'words', len(list_filter(string_split(text, ' '), lambda w: w <> '')) FROM conversations)""")
def length_events(spark, sf):
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    return gates.length_events(table(spark, sf, "conversations"), "conv_id", F.col("role"), {"chars": F.length("text"), "words": words})
