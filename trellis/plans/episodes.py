"""Queries on graded answers and replayed episodes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grading
from ..operators import environment, replay
from ..sources.io import table
from .registry import query


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _normal_sql(c: str) -> str:
    """The normal form of a final answer in SQL, from the same fixed values."""
    c = f"string_split({c}, '=')[-1]"
    for before, after in (*grading.SUBSTITUTIONS, *((x, "") for x in grading.REMOVED)):
        c = f"replace({c}, {_quoted(before)}, {_quoted(after)})"
    for pattern, by in (
        (r"[^\n$]*\$([^\n]*?)\$[^\n]*", r"$\1$"), (r"\\text\{([^\n]*?)\}", r"\1"), (r"\\textbf\{([^\n]*?)\}", r"\1"), (r"\\overline\{([^\n]*?)\}", r"\1"),
        (r"\\boxed\{([^\n]*)\}", r"\1"), (r"frac([^{])([^\n])", r"frac{\1}{\2}"), (r"sqrt([^{])", r"sqrt{\1}"),
    ):
        c = f"regexp_replace({c}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    c = f"replace({c}, '$', '')"
    return f"trim(list_transform([{c}], lambda x: CASE WHEN regexp_full_match(replace(x, ',', ''), '[0-9]+') THEN replace(x, ',', '') ELSE x END)[1], e' \\t\\n\\r')"


_SOLUTION = r"""concat(
  'Answer: 7\nThe order takes ', l_orderkey, ' steps.\nAnswer: ', CASE l_linenumber % 4 WHEN 0 THEN concat('x = \$', q, ',000 dollars') WHEN 1 THEN concat('\frac', l_linenumber, '9 an hours')
  WHEN 2 THEN concat('y=\text{about }$', q, '^\circ$') ELSE concat(q, '\text{m}') END)"""
_TRUTH = r"""CASE l_linenumber % 4 WHEN 0 THEN concat(q, '000') WHEN 1 THEN concat('\frac{', l_linenumber, '}{', q % 10, '}') WHEN 2 THEN concat('', q) ELSE concat('', q + q % 2) END"""


def _spark_text(sql: str) -> str:
    """The same expression with Spark's escapes: a backslash twice, but for line ends."""
    return sql.replace("\\n", "\0").replace("\\", "\\\\").replace("\0", "\\n")


@query(f"""
WITH t AS (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, replace({_SOLUTION}, '\\n', chr(10)) AS solution, {_TRUTH} AS truth FROM t),
p AS (SELECT l_orderkey, l_linenumber, {_normal_sql("trim(regexp_extract_all(right(solution, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1])")} AS pred, {_normal_sql("truth")} AS truth FROM s)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN pred = truth THEN 1 ELSE -1 END AS DOUBLE) AS score, pred = truth AS acc, pred FROM p""")
def final_answer_score(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    score = grading.solution_score(F.expr(_spark_text(_SOLUTION)), F.expr(_spark_text(_TRUTH)))
    return t.select("l_orderkey", "l_linenumber", score.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, round(l_discount * 100) AS g, CASE l_linenumber % 3 WHEN 0 THEN round(l_discount * 100) WHEN 1 THEN round(l_discount * 100) / 100 ELSE round(l_tax * 100) END AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, abs(g / 100 - w) <= 1e-4 * greatest(abs(g / 100), abs(w)) OR abs(g / 100 - w / 100) <= 1e-4 * greatest(abs(g / 100), abs(w / 100)) OR abs(g / 100 - w * 100) <= 1e-4 * greatest(abs(g / 100), abs(w * 100)) AS agree FROM t""")
def answers_agree(spark, sf):
    percent = lambda c: F.round(F.col(c) * 100).cast("int")
    at = F.col("l_linenumber") % 3
    given = F.concat(percent("l_discount").cast("string"), F.lit("\\%"))
    truth = F.when(at == 0, percent("l_discount").cast("string")).when(at == 1, (percent("l_discount") / 100).cast("string")).otherwise(percent("l_tax").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", grading.answers_agree(given, truth).alias("agree"))


def _calls(spark, sf):
    """The lines of an order, a few, as calls on two aspects."""
    n = F.col("n")
    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    aspect = F.when(n <= 3, "flight").otherwise("hotel")
    kind = F.when((n == 1) | (n == 4), "search").when(F.col("l_returnflag") == "A", "action").when(F.col("l_returnflag") == "R", "answer").when(F.col("l_quantity") > 25, "answer").otherwise("search")
    return table(spark, sf, "lineitem").withColumn("n", rank).select("l_orderkey", "n", kind.alias("kind"), aspect.alias("aspect"), F.concat(F.upper(F.substring(aspect, 1, 1)), (n % 4).cast("string")).alias("content"))


def _by_order(calls, *fields):
    rows = F.array_sort(F.collect_list(F.struct("n", *fields)))
    return calls.groupBy("l_orderkey").agg(rows.alias("calls"))


@query()
def environment_episodes(spark, sf):
    ids = lambda x: F.array(*[F.lit(f"{x}{i}") for i in (1, 2, 3)])
    offer = lambda x: F.struct(ids(x).alias("every"), F.array(F.lit(f"{x}2")).alias("correct"), F.create_map(F.lit(f"{x}1"), F.lit('{"cost":1}')).alias("shown"))
    offers = F.create_map(F.lit("flight"), offer("F"), F.lit("hotel"), offer("H"))
    said = F.create_map(F.lit("flight"), F.array(F.lit("I like mornings.")))
    plan = F.array(F.lit("flight"), F.lit("hotel"))
    out = _by_order(_calls(spark, sf), "kind", "aspect", "content").withColumn("r", F.explode(environment.play(F.col("calls"), plan, offers, said, most=6)))
    return out.select("l_orderkey", "r.*")


@query()
def legacy_transcripts(spark, sf):
    calls = _calls(spark, sf)
    both = F.array(F.struct((F.col("n") * 2).alias("n"), F.lit("assistant").alias("role"), F.col("kind").alias("choice"), F.when(F.col("n") != 1, F.col("aspect")).alias("aspect"), F.col("content")), F.struct((F.col("n") * 2 + 1).alias("n"), F.lit("tool").alias("role"), F.lit(None).cast("string").alias("choice"), F.lit(None).cast("string").alias("aspect"), F.lit("seen").alias("content")))
    rows = calls.select("l_orderkey", F.explode(both).alias("m")).select("l_orderkey", "m.*")
    out = _by_order(rows, "role", "choice", "aspect", "content").withColumn("r", F.explode(replay.legacy_kept(F.col("calls"))))
    return out.select("l_orderkey", "r.*")
