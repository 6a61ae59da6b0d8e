"""Queries on contexts and documents: which turns give way, what an episode's context comes to, which records a
document holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compaction, substrings
from ..sources import records
from ..sources.io import table
from .registry import query

_BASE, _MOST, _RESERVE, _TARGET = 120, 2200, 300, 1500
_ASPECT = "CASE WHEN (conv_id + turn) % 37 = 0 THEN ' ' ELSE concat('a', CASE WHEN conv_id % 6 = 2 THEN turn % 2 ELSE (turn - turn % 3) // 3 END) END"
_CHOICE = "CASE WHEN turn % 3 = 2 OR conv_id % 9 = 4 THEN 'Answer' ELSE 'action' END"
_ONE, _TAKEN, _DONE = "(conv_id + turn) % 29 <> 0", "conv_id % 11 <> 5 OR turn > 3", "conv_id % 7 <> 0 OR turn % 2 = 0"

_PLAN = f"""
WITH t AS (SELECT conv_id, turn, length(text) AS len, 20 + turn AS mem, {_ONE} AS one, CASE WHEN {_ONE} THEN trim({_ASPECT}) ELSE '' END AS aspect, {_CHOICE} = 'Answer' AND ({_TAKEN}) AND ({_DONE}) AS done FROM conversations),
c AS (SELECT *, one AND aspect <> '' AND done AS closes, NOT EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND (NOT b.one OR b.aspect = '')) AS sure FROM t a),
o AS (SELECT *, CASE WHEN aspect <> '' THEN (SELECT min(b.turn) FROM c b WHERE b.conv_id = a.conv_id AND b.aspect = a.aspect AND b.turn >= a.turn AND b.closes AND b.sure) END AS owner FROM c a),
w AS (SELECT conv_id, {_BASE} + sum(len) AS before FROM t GROUP BY conv_id),
k AS (SELECT x.conv_id, x.turn AS owner, (SELECT sum(len) FROM o y WHERE y.conv_id = x.conv_id AND y.owner <= x.turn) AS freed, (SELECT sum(mem) FROM o y WHERE y.conv_id = x.conv_id AND y.turn = y.owner AND y.turn <= x.turn) AS mem,
  (SELECT count(*) FROM o y WHERE y.conv_id = x.conv_id AND y.turn = y.owner AND y.turn <= x.turn) AS n FROM o x WHERE x.turn = x.owner),
s AS (SELECT k.*, before - freed + mem AS after FROM k JOIN w USING (conv_id)),
p AS (SELECT conv_id, coalesce(min(n) FILTER (after <= {_TARGET} AND after + {_RESERVE} <= {_MOST}), max(n)) AS n FROM s GROUP BY conv_id),
f AS (SELECT w.conv_id, before, before + {_RESERVE} > {_MOST} AS attempted, s.owner, s.after, s.mem, s.n, before + {_RESERVE} > {_MOST} AND coalesce(s.after + {_RESERVE} <= {_MOST}, false) AS success FROM w LEFT JOIN p USING (conv_id) LEFT JOIN s ON s.conv_id = w.conv_id AND s.n = p.n)"""


def _compacted(spark, sf):
    said = table(spark, sf, "conversations")
    x = lambda sql: F.expr(sql.replace("//", "div"))
    event = F.struct(x(_CHOICE).alias("choice"), x(_ASPECT).alias("aspect"), x(_TAKEN).alias("accepted"), x(_DONE).alias("completed_aspect"))
    turns = said.select("conv_id", "turn", F.when(x(_ONE), F.array(event)).otherwise(F.array(event, event)).alias("events"), F.length("text").alias("len"), (F.col("turn") + 20).alias("mem"))
    return compaction.compacted(turns, "conv_id", "turn", "events", "len", "mem", base=_BASE, most=_MOST, reserve=_RESERVE, target=_TARGET)


@query(f"{_PLAN} SELECT o.conv_id, turn, closes AND sure AS cleanable, closes AND NOT sure AS blocked, o.owner, coalesce(success AND o.owner <= f.owner, false) AS removed FROM o JOIN f USING (conv_id)")
def context_compaction(spark, sf):
    return _compacted(spark, sf)[0].select("conv_id", "turn", "cleanable", "blocked", "owner", "removed")


@query(f"""{_PLAN} SELECT conv_id, attempted, success, before::BIGINT AS before, CASE WHEN success THEN after ELSE before END::BIGINT AS after, CASE WHEN success THEN greatest(before - after, 0) ELSE 0 END::BIGINT AS released, CASE WHEN success THEN n ELSE 0 END AS n_cleaned, CASE WHEN success THEN mem ELSE 0 END::BIGINT AS memory,
  CASE WHEN attempted AND n IS NULL THEN 'no_completed_aspect_history' WHEN attempted AND NOT success THEN 'still_unsafe' END AS failure FROM f""")
def context_episodes(spark, sf):
    return _compacted(spark, sf)[1]


@query("""
WITH s AS (SELECT conv_id, greatest(0, length(text) - 400) AS s FROM conversations WHERE length(text) - 400 < 900 - 10 * (conv_id % 91)),
d AS (SELECT conv_id, string_agg(s, ',' ORDER BY s) AS starts FROM (SELECT DISTINCT conv_id, s FROM s) WHERE conv_id % 91 < 90 GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 91 = 90 THEN '' ELSE coalesce(starts, '0') END AS starts FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN d USING (conv_id)""")
def fragment_boundaries(spark, sf):
    starts = F.collect_list((F.length("text") - 400).cast("int"))
    held = table(spark, sf, "conversations").groupBy("conv_id").agg(starts.alias("s"))
    return held.select("conv_id", F.array_join(F.transform(compaction.boundaries(F.col("s"), (900 - 10 * (F.col("conv_id") % 91)).cast("int")), lambda x: x.cast("string")), ",").alias("starts"))


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, i AS source_index, CASE WHEN conv_id % 4 = 2 THEN 'env' END AS env_name, CASE WHEN conv_id % 4 = 2 THEN concat('task', conv_id) END AS key, CASE WHEN conv_id % 4 = 2 THEN 'g"1' END AS gold, CASE WHEN turn % 3 > 0 THEN turn END AS turn,
  CASE WHEN conv_id % 4 = 2 THEN turn * 2 END AS report, CASE WHEN turn % 3 = 0 THEN 'not_an_object' END AS reason FROM r WHERE conv_id % 4 <> 3
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, NULL, NULL, 'no JSON' FROM conversations WHERE conv_id % 4 = 3""")
def unpacked_documents(spark, sf):
    turn, kind = F.col("turn"), F.col("conv_id") % 4
    items = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(turn % 3 == 0, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).otherwise(F.to_json(F.struct("turn", F.col("text").alias("t")))).alias("x")))), lambda x: x["x"]), ","), F.lit("]"))
    reports = F.to_json(F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.struct((x * 2).alias("r"))))
    docs = table(spark, sf, "conversations").groupBy("conv_id").agg(items.alias("x"), reports.alias("r"))
    env = F.concat(F.lit('{"_old": {"a": {"data": [{}]}}, "env": {"task'), F.col("conv_id").cast("string"), F.lit('": {"gold": "g\\"1", "data": '), F.col("x"), F.lit(', "reward_report": '), F.col("r"), F.lit("}}}"))
    text = F.when(kind == 0, F.col("x")).when(kind == 1, F.concat(F.lit('{"n": 1, "data": '), F.col("x"), F.lit("}"))).when(kind == 2, env).otherwise(F.concat(F.col("x"), F.lit("]")))
    out = records.unpacked(docs.select("conv_id", text.alias("text")), "text")
    number = lambda c, path: F.get_json_object(c, path).cast("long")
    reason = F.when(F.col("reason").isNull() | (F.col("reason") == "not_an_object"), F.col("reason")).otherwise("no JSON")
    return out.select("conv_id", "source_index", "env_name", "key", "gold", F.when(F.col("source_index").isNotNull(), number("record", "$.turn")).alias("turn"), number("report", "$.r").alias("report"), reason.alias("reason"))


_ASKED = "concat('  ', upper(substr(text, 1, 30)), ' ', substr(text, 31, 10))"


@query(rf"""
WITH u AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id),
tasks AS (SELECT conv_id AS n, concat('t', conv_id) AS task, trim(regexp_replace(lower({_ASKED}), '\s+', ' ', 'g')) AS asked FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') WHERE k = 1 AND conv_id % 3 = 0),
hits AS (SELECT u.conv_id, n, task, CASE WHEN n % 4 = u.conv_id % 4 THEN 3 ELSE 1 END AS p FROM u JOIN tasks ON asked <> '' AND contains(trim(regexp_replace(lower(said), '\s+', ' ', 'g')), asked)),
best AS (SELECT conv_id, min(task) AS task FROM (SELECT *, max(p) OVER (PARTITION BY conv_id) AS top FROM hits) WHERE p = top GROUP BY conv_id HAVING count(*) = 1),
x AS (SELECT c.conv_id, CASE WHEN c.conv_id % 13 = 0 THEN 'map' WHEN m.task IS NOT NULL AND c.conv_id % 5 = 0 THEN 'id' WHEN b.task IS NOT NULL THEN 'text' END AS tier, m.task AS own, b.task AS hit, o.task AS mapped
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN tasks m ON m.n = c.conv_id LEFT JOIN best b ON b.conv_id = c.conv_id LEFT JOIN tasks o ON o.n = c.conv_id // 2)
SELECT conv_id, CASE tier WHEN 'map' THEN mapped WHEN 'id' THEN own ELSE hit END AS task, CASE WHEN tier = 'map' AND mapped IS NULL THEN NULL ELSE tier END AS tier FROM x""")
def resolved_tasks(spark, sf):
    said = table(spark, sf, "conversations")
    user, name = said.where("role = 'user'"), lambda c: F.concat(F.lit("t"), c.cast("string"))
    texts = user.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("users"))
    ids = said.select("conv_id").distinct()
    n = F.col("conv_id")
    records = ids.join(texts, "conv_id", "left").select("conv_id", F.when(n % 13 == 0, F.array(F.lit("unknown"), F.concat(F.lit("p#"), n.cast("string")))).alias("places"), F.when(n % 5 == 0, name(n)).alias("said"), "users")
    options = F.array(F.struct(F.lit("flight").alias("aspect"), F.array(F.concat(F.lit("F"), (n % 4).cast("string"))).alias("correct"), F.array(*[F.lit(f"F{i}") for i in range(4)]).alias("every")))
    first = user.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).where(n % 3 == 0)
    tasks = first.select(name(n).alias("task"), F.expr(_ASKED).alias("initial"), options.alias("options"))
    chosen = ids.select(F.concat(F.lit("p#"), n.cast("string")).alias("place"), name(F.floor(n / 2)).alias("task"))
    answers = ids.select("conv_id", F.lit("flight").alias("aspect"), F.concat(F.lit("f"), (n % 4).cast("string")).alias("answer"))
    return substrings.resolved(records, "conv_id", tasks, chosen, answers)
