"""Queries on documents, pages and conversations: sampling, splits, dedup, joins, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons
from ..functions import text as tx
from ..operators import batching, joins, ranges, sampling, substrings
from ..sources.io import table
from .registry import query


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("""
SELECT lang, round(quantile_cont(n_chars, 0.5), 4) AS p50, CAST(round_even(quantile_cont(n_chars, 0.9), 0) AS BIGINT) AS p90, CAST(round_even(quantile_cont(n_chars, 0.95), 0) AS BIGINT) AS p95,
  CAST(round_even(quantile_cont(n_chars, 0.99), 0) AS BIGINT) AS p99, max(n_chars) AS longest FROM documents GROUP BY lang""")
def length_percentiles(spark, sf):
    d = _docs(spark, sf)
    places = ranges.quantiles(d, ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    whole = [F.bround(c).cast("long").alias(c) for c in ("p90", "p95", "p99")]
    return places.join(d.groupBy("lang").agg(F.max("n_chars").alias("longest")), "lang").select("lang", F.round("p50", 4).alias("p50"), *whole, "longest")


@query("""
WITH o AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents),
b AS (SELECT lang, max(CASE WHEN place = (n - 1) // 3 THEN n_chars END) AS lo, max(CASE WHEN place = least(n - 1, 2 * n // 3) THEN n_chars END) AS hi FROM o GROUP BY lang)
SELECT doc_id, CASE WHEN n_chars <= lo THEN 'short' WHEN n_chars >= hi THEN 'long' ELSE 'mid' END AS bucket FROM o JOIN b USING (lang)""")
def length_buckets(spark, sf):
    return sampling.length_buckets(_docs(spark, sf), "lang", "n_chars").select("doc_id", "bucket")


_QUOTA = """(SELECT lang, size, f + CAST(row_number() OVER (ORDER BY r DESC, lang DESC) <= 50 - sum(f) OVER () AS INT) AS quota FROM
  (SELECT lang, size, CAST(floor(size * 50 / sum(size) OVER ()) AS BIGINT) AS f, round(size * 50 / sum(size) OVER () - floor(size * 50 / sum(size) OVER ()), 9) AS r FROM (SELECT lang, count(*) AS size FROM documents GROUP BY lang)))"""


@query(f"SELECT lang, size, CAST(quota AS BIGINT) AS quota FROM {_QUOTA}")
def largest_remainder_quotas(spark, sf):
    sizes = _docs(spark, sf).groupBy("lang").agg(F.count("*").alias("size"))
    return sampling.quotas(sizes, "lang", "size", 50).select("lang", "size", F.col("quota").cast("long"))


_RANKED = "(SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('20260801:' || lang || ':' || doc_id), doc_id) AS rank FROM documents)"


@query(f"SELECT doc_id, lang, rank FROM {_RANKED} JOIN {_QUOTA} USING (lang) WHERE rank <= quota")
def stratified_hash_sample(spark, sf):
    return sampling.stratified(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 50, 20260801).select("doc_id", "lang", F.col("rank").cast("long"))


@query(f"SELECT doc_id, lang FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM {_RANKED}) WHERE rank <= greatest(1, floor(n * 0.35))")
def fraction_sample(spark, sf):
    return sampling.fraction(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 0.35, 20260801).select("doc_id", "lang")


@query(f"SELECT doc_id, CASE WHEN rank <= 10 THEN 'smoke' WHEN rank <= 40 THEN 'validation' WHEN rank <= 90 THEN 'train' ELSE 'rest' END AS pool FROM {_RANKED}")
def pool_partition(spark, sf):
    return sampling.pools(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 20260801, {"smoke": 10, "validation": 30, "train": 50}).select("doc_id", "pool")


@query("SELECT source, CAST(('0x' || substr(sha256('7:' || source), 1, 8)) AS BIGINT) % 10 < 2 AS held_out, count(*) AS n FROM documents GROUP BY ALL")
def task_grouped_split(spark, sf):
    out = sampling.group_split(_docs(spark, sf), "source", 7, held_out=2, of=10)
    return out.groupBy("source", (F.col("split") == "validation").alias("held_out")).agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY sha256(text)")
def exact_dedup_keep_first(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    return sampling.keep_first(d, F.col("h"), ["doc_id"]).select("doc_id", "n_copies")


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_texts, count(*) - count(DISTINCT text) AS n_dropped FROM documents")
def dedup_stats(spark, sf):
    g = _docs(spark, sf).groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.count("h").alias("n_texts"), (F.sum("n") - F.count("h")).alias("n_dropped"))


@query("""
SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'gold' WHEN quality = 1 THEN 'partial' WHEN quality = 0 THEN 'wrong' ELSE 'unlabelled' END AS class, count(*) AS n_records,
  CAST(sum(n_chars) AS BIGINT) AS n_chars, round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0 END)::DOUBLE, 3) AS weight FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def manifest_by_class(spark, sf):
    d = _docs(spark, sf).select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "gold").when(F.col("quality") == 1, "partial").when(F.col("quality") == 0, "wrong").otherwise("unlabelled")
    weight = F.when(F.col("class") == "gold", 1.0).when(F.col("class") == "partial", 0.5).otherwise(0.0)
    return d.withColumn("class", kind).groupBy("source", "class").agg(F.count("*").alias("n_records"), F.sum("n_chars").alias("n_chars"), F.round(F.sum(weight), 3).alias("weight"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_pool(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_pool(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""
WITH a AS (SELECT sha256(text) AS h, max(doc_id) AS audit_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT doc_id, audit_id FROM documents JOIN a ON sha256(text) = h""")
def hash_join_audit(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    audits = d.join(table(spark, sf, "labels"), "doc_id", "left_semi").groupBy("h").agg(F.max("doc_id").alias("audit_id"))
    return d.join(audits, "h").select("doc_id", "audit_id")


@query("SELECT doc_id, item_id FROM documents JOIN (SELECT item_id, text AS needle FROM benchmark) ON contains(text, needle)")
def theta_contains_match(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    return substrings.contains_pairs(d, "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")


_MADE = "(SELECT doc_id, 'reward: ' || n_chars || chr(10) || 'Trip for P' || doc_id || ' in ' || lang || ', <think>see F' || doc_id || '</think> options f12, H' || doc_id || ' and xA1' || chr(10) || '#### ' || n_chars || ',5 or $' || doc_id AS t FROM documents)"


def _made(spark, sf):
    s = lambda c: F.col(c).cast("string")
    t = F.concat(F.lit("reward: "), s("n_chars"), F.lit("\nTrip for P"), s("doc_id"), F.lit(" in "), F.col("lang"), F.lit(", <think>see F"), s("doc_id"), F.lit("</think> options f12, H"), s("doc_id"), F.lit(" and xA1\n#### "), s("n_chars"), F.lit(",5 or $"), s("doc_id"))
    return _docs(spark, sf).select("doc_id", t.alias("t"))


_PRIVATE = r"""concat('Trip for P', doc_id, ' and p', n_chars, ', not xP1 or P1x.\n Reward : ', n_chars, '\nterminal reward = 3\nstep_reward: 1\nCorrect_IDs: F', doc_id, '\nbest ids = H1\nPreference id: 4\nrewardreport: x\nDiagnostics = y\nground truth: z\nrewards: shown\n<Think>see F', doc_id,
  '\nmore</think>, <analysis>a</analysis> options F12\nscratchpad: hidden\nmore hidden\nNext step: shown\n', CASE doc_id % 7 WHEN 0 THEN 'key sk-1' WHEN 1 THEN 'API_KEY=1' WHEN 2 THEN 'reasoning_content = to the end' ELSE '' END)"""
_PRIVATE_SQL = f"(SELECT doc_id, replace({_PRIVATE}, '\\n', chr(10)) AS t FROM documents)"


def _private(spark, sf):
    return _docs(spark, sf).select("doc_id", F.expr(_PRIVATE.replace("\\n", "\n")).alias("t"))


@query(rf"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?im)^\s*(reward|step[_ ]?reward|terminal[_ ]?reward)\s*[:=].*$', '', 'g'),
  '(?im)^\s*(preference[_ ]?ids?|correct[_ ]?ids?|best[_ ]?ids?|ground[_ ]?truth|reward[_ ]?report|diagnostics?)\s*[:=].*$', '', 'g'), '(?i)\bP\d+\b', 'that preference', 'g'), e' \n') AS t FROM {_PRIVATE_SQL}""")
def redact_public_text(spark, sf):
    return _private(spark, sf).select("doc_id", tx.redact_public(F.col("t")).alias("t"))


@query(rf"""
SELECT doc_id, CASE WHEN contains(x, 'sk-') OR contains(lower(x), 'api_key') THEN '[REDACTED]' ELSE x END AS t FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '(?is)<(think|analysis|reasoning)>.*?</(think|analysis|reasoning)>', '[REASONING_REDACTED]', 'g'), '(?is)(reasoning_content|chain_of_thought|scratchpad)\s*[:=]\s*.*?(\n\s*[A-Za-z_][\w -]*\s*[:=]|$)', '[REASONING_REDACTED]\2', 'g'),
  '(?im)^\s*(preference[_ ]?ids?|correct[_ ]?ids?|best[_ ]?ids?|ground[_ ]?truth|reward[_ ]?report|diagnostics?)\s*[:=].*$', '[PRIVATE_REDACTED]', 'g'), '(?i)(^|[^A-Za-z0-9])P\d+($|[^A-Za-z0-9])', '\1[PRIVATE_ID]\2', 'g') AS x FROM {_PRIVATE_SQL})""")
def redact_tracking(spark, sf):
    return _private(spark, sf).select("doc_id", tx.redact_tracking(F.col("t")).alias("t"))


@query(f"SELECT doc_id, 'F' || doc_id || ',F12,H' || doc_id AS ids, 'see F' || doc_id AS thought FROM {_MADE}")
def option_ids(spark, sf):
    return _made(spark, sf).select("doc_id", F.concat_ws(",", tx.option_ids(F.col("t"))).alias("ids"), tx.between(F.col("t"), "think").alias("thought"))


@query(rf"SELECT doc_id, replace(regexp_extract(t, '#### (-?[0-9.,]+)', 1), ',', '') AS strict, CAST(doc_id AS VARCHAR) AS flexible FROM {_MADE}")
def gsm8k_extract(spark, sf):
    return _made(spark, sf).select("doc_id", tx.number_answer(F.col("t")).alias("strict"), tx.number_answer(F.col("t"), strict=False).alias("flexible"))


_QA = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


@query(f"SELECT item_id, {_QA.format('text')} AS t FROM benchmark")
def normalize_answer(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.qa_normalise(F.col("text")).alias("t"))


@query(f"""
WITH p AS (SELECT item_id, {_QA.format("'The ' || text || '!'")} AS p, {_QA.format('text')} AS g FROM benchmark)
SELECT a.item_id, bool_or(a.p = b.g) AS em, bool_or(contains(a.p, b.g)) AS sub_em FROM p a JOIN p b ON b.item_id // 2 = a.item_id // 2 GROUP BY a.item_id""")
def em_score(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("pair", F.floor(F.col("item_id") / 2))
    golds = b.groupBy("pair").agg(F.collect_list("text").alias("golds"))
    said = F.concat(F.lit("The "), F.col("text"), F.lit("!"))
    return b.join(golds, "pair").select("item_id", tx.exact_match(said, F.col("golds")).alias("em"), tx.sub_match(said, F.col("golds")).alias("sub_em"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://)[^/@]*@', '\1') AS label FROM pages")
def page_url_label(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.endpoint(F.col("url")).alias("label"))


@query("SELECT doc_id, least(-(n_chars - (5000 - 1000)) / 1000.0 * 0.5, 0.0) AS penalty FROM documents")
def overlong_penalty(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.overlong_penalty(F.col("n_chars"), 5000, 1000, 0.5).alias("penalty"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def flatten_json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_REPORT = """concat('{"train": {"loss": ', value, ', "k": ', event_id % 9, ', "none": {}, "notes": [', CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('"', event_type, '", {"deep/er": [null, true, ', event_id % 4, '.25]}') END, ']}, "id": "', event_id, '"}')"""


@query(f"""
WITH RECURSIVE d AS (SELECT event_id, ({_REPORT})::JSON AS t FROM events),
walk AS (SELECT event_id, '' AS p, t AS v FROM d
  UNION ALL SELECT event_id, p || CASE WHEN p = '' THEN '' ELSE '/' END || k, json_extract(v, CASE WHEN json_type(v) = 'ARRAY' THEN '$[' || k || ']' ELSE '$."' || k || '"' END)
  FROM (SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: i::VARCHAR) ELSE [] END) AS k FROM walk)),
flat AS (SELECT event_id, p AS key, v::VARCHAR AS value FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') UNION ALL SELECT event_id, p || '/list_len', json_array_length(v)::VARCHAR FROM walk WHERE json_type(v) = 'ARRAY')
SELECT event_id, key, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS value, try_cast(value AS DOUBLE) AS number FROM flat""")
def flattened_reports(spark, sf):
    out = jsons.flattened(table(spark, sf, "events").select("event_id", F.expr(_REPORT).alias("t")), ["event_id"], "t")
    return out.select("event_id", "key", F.when(F.col("number").isNull(), F.col("value")).alias("value"), "number")


@query("SELECT event_id, 'value' AS name, value FROM events UNION ALL SELECT event_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events")
def metric_long_form(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.from_json("props", "k double")["k"].alias("k"))
    return e.unpivot("event_id", ["value", "k"], "name", "value")


@query("SELECT max(n_chars) AS longest, CAST(sum(CAST(n_chars > 10000 AS INT)) AS BIGINT) AS n_over FROM documents")
def prompt_budget(spark, sf):
    return _docs(spark, sf).agg(F.max("n_chars").alias("longest"), F.sum((F.col("n_chars") > 10000).cast("int")).alias("n_over"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_prompts(spark, sf):
    return _docs(spark, sf).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("SELECT lang, source FROM documents EXCEPT SELECT lang, source FROM documents WHERE n_chars > 3000")
def set_difference(spark, sf):
    d = _docs(spark, sf)
    return d.select("lang", "source").subtract(d.where("n_chars > 3000").select("lang", "source"))


@query("SELECT lang, source FROM documents WHERE n_chars < 500 INTERSECT SELECT lang, source FROM documents WHERE n_chars > 3000")
def set_intersection(spark, sf):
    d = _docs(spark, sf)
    return d.where("n_chars < 500").select("lang", "source").intersect(d.where("n_chars > 3000").select("lang", "source"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) >= 64 AND len(list_distinct(string_split(regexp_replace(text, '\\s+', '', 'g'), ''))) <= 2 AS collapsed FROM documents")
def collapsed_output(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.collapsed(F.col("text")).alias("collapsed"))


@query()
def balanced_partitions(spark, sf):
    d = _docs(spark, sf).select("doc_id", "n_chars").withColumn("batch", F.floor(F.col("doc_id") / 64))
    return batching.balanced(d, "batch", "doc_id", "n_chars", 8)


@query()
def micro_batches(spark, sf):
    d = _docs(spark, sf).select("doc_id", "n_chars").withColumn("batch", F.floor(F.col("doc_id") / 64))
    return batching.micro_batches(d, "batch", "doc_id", "n_chars", 40000)


@query("""
WITH h AS (SELECT doc_id, n_chars, CAST('0x' || substr(sha256('1:' || doc_id), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(count(*) OVER () / 400) AS BIGINT)) AS w FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n_chars DESC, doc_id) - 1 AS k FROM h)
SELECT doc_id, n_chars, w || '-' || (k // 8) AS batch FROM r""")
def length_grouped_batches(spark, sf):
    return batching.length_grouped(_docs(spark, sf).select("doc_id", "n_chars"), "doc_id", "n_chars", 8, 50, 1)


@query("""
WITH x AS (SELECT doc_id, lang, n_chars, CAST(greatest(abs(n_chars), 1e-8) AS DOUBLE) AS x, sha256(CAST(doc_id AS VARCHAR)) AS d FROM documents),
s AS (SELECT *, sum(x) OVER (PARTITION BY lang ORDER BY d, doc_id ROWS UNBOUNDED PRECEDING) AS hi, sum(x) OVER (PARTITION BY lang) AS total FROM x),
u AS (SELECT lang AS l, draw, (CAST('0x' || substr(sha256('3:' || lang || ':' || draw), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest(range(1, 101)) AS draw))
SELECT CAST(draw AS INT) AS draw, doc_id, lang, n_chars FROM s JOIN u ON lang = l AND u * total >= hi - x AND u * total < hi""")
def weighted_resample(spark, sf):
    return batching.resample(_docs(spark, sf).select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", 100, 3)


@query("""SELECT doc_id // 64 AS batch, CAST(sum(n_chars) AS BIGINT) AS total, CAST(sum(n_chars * n_chars) AS BIGINT) AS squares, count(*) AS n FROM documents GROUP BY 1""")
def flops_terms(spark, sf):
    n = F.col("n_chars")
    return _docs(spark, sf).groupBy(F.floor(F.col("doc_id") / 64).alias("batch")).agg(F.sum(n).alias("total"), F.sum(n * n).alias("squares"), F.count("*").alias("n"))


@query("SELECT doc_id, lang || '::' || doc_id AS task_key, sha256('{\"doc_id\":' || doc_id || ',\"lang\":' || to_json(lang) || ',\"text\":' || to_json(text) || '}') AS h FROM documents")
def keys_and_hashes(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.task_key(F.col("lang"), F.col("doc_id")).alias("task_key"), tx.content_hash("lang", "text", "doc_id").alias("h"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS t FROM documents")
def normalized_text(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.normalise_folded(F.col("text")).alias("t"))
