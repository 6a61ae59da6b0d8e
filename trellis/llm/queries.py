"""The registered queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, dsir, embdedup, html, langid, minhash, mixing, packing, pii, prefixtrie, secrets, tokencount, whitening
from .common import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op2_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsir.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality weights of the sampling keys: texts labelled bad are drawn a quarter as readily."""
    return _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, 0.25).otherwise(1.0).alias("weight"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), quality=label_weights(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def tokens(docs: DataFrame, **options) -> DataFrame:
    """Pieces under the 50k byte-level vocabulary, whose rank file encodes the same ids faster."""
    path = public_tokenizers.path
    return packing.pieces(docs, path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, **options)


def op9_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens(_table(spark, sf_dir, "documents")))


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Workspace(spark, "turns").keep(prefixtrie.ordered(_table(spark, sf_dir, "conversations")), "ordered")
    return prefixtrie.trie(*prefixtrie.share_heads(turns))


def op12_two_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds is null; the operator itself gives decimals."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_adaptive_scan, op2_multi_index_dedup, op3_blob_ledger, op4_importance_resampling, op5_bayes_minhash,
        op6_source_mix, op7_skip_chain_pii, op8_host_suffix_array, op9_configuration_packing, op10_ppm_language,
        op11_prefix_trie, op12_two_tier_counts, op13_jacobi_whitening,
    )
}


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS ord,
      list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS s,
      length(hits[i]) AS n, length(held[i]) AS m, {least} AS least
    FROM (SELECT doc_id, gaps, hits, held, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS gaps, regexp_extract_all(coalesce(text, ''), '{pattern}') AS hits,
        regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS held FROM documents))"""


_rules = [(r.kind, i, r.pattern.replace("++", "+"), r.group, r.least) for i, r in enumerate(secrets.RULES)]
SECRETS_SQL = f"""
WITH spans AS ({" UNION ALL ".join(_spans_sql(*r) for r in _rules)}),
kept AS (SELECT doc_id, kind, ord, s, kind || ':' || s || ':' || (s + n) AS t FROM spans WHERE m >= least),
found AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(t, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
  string_agg(t, ',' ORDER BY s, ord) AS spans, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_secrets
FROM documents d LEFT JOIN found USING (doc_id)"""

MINHASH_SQL = r"""
WITH RECURSIVE lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM lowered WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN sizes USING (doc_id)"""

COSINE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, e, list_inner_product(e, e) AS q FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE q > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / sqrt(a.q * b.q) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)"""

MIX_SQL = r"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 0.25 ELSE 1.0 END)::DOUBLE AS q FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size, md5('0|' || coalesce(d.doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h, coalesce(q, 1.0) AS q
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS words FROM s),
l AS (SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
g AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
k AS (SELECT doc_id, d.source, size, source_size, target, epochs, round(target - epochs * source_size)::BIGINT AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY -ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / q, d.doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, source FROM k"""

TRIE_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, w: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
b AS (SELECT c.conv_id, p, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h UNION ALL SELECT conv_id, p, r, x FROM t JOIN c USING (conv_id) WHERE p > h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, r, x FROM b),
path AS (SELECT conv_id, d, length(x) AS chars, sha256(string_agg(length(r) || ':' || length(x) || ':' || r || x, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM q
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY k),
step AS (SELECT DISTINCT a.k AS pk, b.k AS k FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
kids AS (SELECT pk, count(*) AS n FROM step GROUP BY pk),
under AS (SELECT DISTINCT a.k AS top, b.k AS k FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.d >= a.d),
sub AS (SELECT top, count(*) FILTER (kids.n IS NULL) AS leaves, sum((node.n - 1) * chars) AS saved FROM under JOIN node ON node.k = under.k LEFT JOIN kids ON kids.pk = under.k GROUP BY top),
ends AS (SELECT k, string_agg(conv_id, ',' ORDER BY conv_id) AS e FROM path JOIN (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id) USING (conv_id, d) GROUP BY k)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM node JOIN sub ON sub.top = node.k LEFT JOIN kids ON kids.pk = node.k LEFT JOIN step ON step.k = node.k LEFT JOIN node up ON up.k = step.pk LEFT JOIN ends ON ends.k = node.k"""

ORACLES = {"op2_multi_index_dedup": COSINE_SQL, "op3_blob_ledger": SECRETS_SQL, "op5_bayes_minhash": MINHASH_SQL, "op6_source_mix": MIX_SQL, "op11_prefix_trie": TRIE_SQL}
