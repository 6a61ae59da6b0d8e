"""Queries on transcripts of tool calls. The tables have none, so that calls and feedback are texts made of events,
by one expression for both engines; the protocol's rules are written out in SQL for themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay
from ..sources.io import table
from .registry import query

_CHOICE = "CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'Action' WHEN 'signup' THEN 'action' WHEN 'purchase' THEN 'answer' ELSE CASE event_id % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'answer' WHEN 2 THEN 'fly' WHEN 3 THEN NULL ELSE 'action' END END"
_CONTENT = """CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 < 2 THEN 'Search flight' ELSE 'Find a HOTEL' END WHEN event_type = 'purchase' THEN CASE WHEN event_id % 17 = 3 THEN 'F1 or F2' ELSE concat(CASE WHEN event_id % 5 < 4 THEN 'f' ELSE ' H' END, event_id % 3) END
  WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'hm' WHEN event_id % 19 = 1 THEN '  ' ELSE 'Which amenities matter most?' END WHEN event_id % 23 = 5 THEN 'A flight or a hotel?' ELSE 'What else should I know?' END"""
_FEEDBACK = r"""CASE WHEN event_id % 61 = 7 THEN NULL WHEN event_type = 'error' THEN CASE event_id % 9 WHEN 0 THEN 'Tool call rejected: action-before-search.' WHEN 1 THEN 'A PARAMETER is missing; reject.' WHEN 2 THEN 'You already searched this.' WHEN 3 THEN 'That question is too general.'
    WHEN 4 THEN 'Tool call rejected: one tool call may target only one aspect.' WHEN 5 THEN 'That visible option is invalid here.' WHEN 6 THEN 'The same initial says another option.' WHEN 7 THEN CASE WHEN event_id % 4 = 0 THEN 'The environment could not complete it.' ELSE 'answer-before-search' END ELSE 'rejected' END
  WHEN event_type = 'view' THEN CASE WHEN event_id % 41 = 4 THEN 'Nothing found.' WHEN event_id % 5 = 1 THEN 'Duplicate search' ELSE 'All options: F0, F1, F2; H0 H1 H2.' END
  WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 1 THEN 'Recorded.' ELSE 'Tool call rejected: option not visible.' END
  WHEN event_id % 7 = 3 THEN 'Noted.\nCurrent aspect: Flight\nSearched aspects: flight, Hotel\nAnswered aspects: none\nVisible option IDs for current aspect: F1, F2' WHEN event_id % 7 = 4 THEN 'Noted. Current aspect: none'
  WHEN event_id % 2 = 0 THEN 'Tool call rejected: action-before-search.' ELSE 'I like mornings.' END"""

_IDS = "list_filter(string_split_regex(upper(coalesce({0}, '')), '[^A-Z0-9]+'), lambda t: regexp_full_match(t, '[ACFHR][0-9]+'))"
_WORDS = "list_filter(['flight', 'hotel', 'apartment', 'rental_car', 'restaurant'], lambda a: len(list_filter(CASE a WHEN 'flight' THEN ['flight', 'airline', 'airport'] WHEN 'rental_car' THEN ['rental car', 'car rental', 'rental vehicle'] WHEN 'restaurant' THEN ['restaurant', 'dining', 'reservation'] ELSE [a] END, lambda w: contains(lower(coalesce(content, '')), w))) > 0)"
_OF_ID = "CASE {0}[1] WHEN 'F' THEN 'flight' WHEN 'H' THEN 'hotel' WHEN 'A' THEN 'apartment' WHEN 'C' THEN 'rental_car' ELSE 'restaurant' END"
_LINE = r"regexp_extract(feedback, '(?i){0}:\s*([^\n]*)', 1)"


def _list(label: str) -> str:
    line = _LINE.format(label)
    return f"CASE WHEN contains(coalesce(feedback, ''), '{label}:') THEN list_filter(list_transform(string_split(lower({line}), ','), lambda x: trim(x)), lambda x: x <> '' AND x <> 'none') END"


#: The replay as a recursion over the calls of a record, then its repairs and its cut, as the protocol words them.
_REPLAY = rf"""
RECURSIVE raw AS (SELECT user_id AS record, event_id AS pos, lower({_CHOICE}) AS choice, {_CONTENT} AS content, replace({_FEEDBACK}, '\n', chr(10)) AS feedback FROM events),
low AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY pos) AS n, lower(coalesce(feedback, '')) AS fb, {_IDS.format("content")} AS ids, {_WORDS} AS words, trim(content) AS solid FROM raw),
said AS (SELECT *, CASE WHEN choice = 'answer' AND len(ids) = 1 AND upper(solid) = ids[1] THEN ids[1] END AS answer,
  CASE WHEN choice = 'answer' AND len(ids) = 1 THEN {_OF_ID.format("ids[1]")} WHEN len(words) = 1 THEN words[1] END AS about,
  len(list_distinct(list_concat(words, list_transform(ids, lambda i: {_OF_ID.format("i")})))) > 1 AS many, feedback IS NOT NULL AS seen, {_IDS.format("feedback")} AS shown,
  CASE WHEN contains(fb, 'environment operation failed') OR contains(fb, 'environment could not complete') OR contains(fb, 'environment/api') OR contains(fb, 'internal error') OR contains(fb, 'backend is experiencing some issues')
      OR contains(fb, 'responding system met some issues') OR contains(fb, 'not sure how to respond to your latest utterance right now') OR contains(fb, 'evaluation_timeout') OR contains(fb, 'evaluation_error') THEN 'environment-failure'
    WHEN contains(fb, 'action-before-search') THEN 'action-before-search' WHEN contains(fb, 'answer-before-search') THEN 'answer-before-search'
    WHEN contains(fb, 'cross-aspect') OR contains(fb, 'one tool call may target only one aspect') THEN 'cross-aspect'
    WHEN contains(fb, 'repeated tool call') OR contains(fb, 'already searched') OR contains(fb, 'duplicate search') THEN 'repeated-search'
    WHEN contains(fb, 'invisible') OR contains(fb, 'not visible') OR (contains(fb, 'visible option') AND contains(fb, 'invalid')) THEN 'invisible-id'
    WHEN contains(fb, 'already answered') OR contains(fb, 'duplicate answer') OR contains(fb, 'already recommended') OR (contains(fb, 'same initial') AND contains(fb, 'option')) OR (contains(fb, 'same aspect') AND contains(fb, 'answer')) THEN 'duplicate-answer'
    WHEN contains(fb, 'vague') OR contains(fb, 'too general') OR contains(fb, 'too broad') THEN 'vague-action'
    WHEN contains(fb, 'invalid') OR contains(fb, 'missing required') OR (contains(fb, 'parameter') AND contains(fb, 'reject')) OR contains(fb, 'rejected') THEN 'invalid-parameters' END AS refusal,
  contains(fb, 'tool call rejected') OR contains(fb, 'operation failed') AS loud,
  CASE WHEN contains(coalesce(feedback, ''), 'Current aspect:') THEN lower(regexp_extract(feedback, '(?i)Current aspect:\s*([A-Za-z_]+)', 1)) END AS p_current,
  {_list("Searched aspects")} AS p_searched, {_list("Answered aspects")} AS p_answered,
  CASE WHEN contains(coalesce(feedback, ''), 'Visible option IDs') THEN {_IDS.format(_LINE.format("Visible option IDs for current aspect"))} END AS p_visible FROM low),
run AS (
  SELECT DISTINCT record, 0::BIGINT AS n, NULL::BIGINT AS pos, NULL::VARCHAR AS choice, NULL::VARCHAR AS content, NULL::VARCHAR AS aspect, false AS accepted, NULL::VARCHAR AS kind, NULL::VARCHAR AS held_on, true AS fresh0, NULL::VARCHAR AS answer, false AS seen, false AS refused,
    NULL::VARCHAR AS current, []::VARCHAR[] AS searched, []::VARCHAR[] AS answered, []::VARCHAR[] AS visible, true AS fresh FROM said
  UNION ALL
  SELECT record, n, pos, choice, content, aspect, accepted, kind, held_on, fresh0, answer, seen, refused,
    CASE WHEN accepted AND choice = 'search' AND aspect IS NOT NULL THEN aspect WHEN accepted AND choice = 'answer' AND aspect IS NOT NULL AND answer IS NOT NULL THEN NULL WHEN p_current IS NULL THEN current WHEN p_current IN ('', 'none') THEN NULL ELSE p_current END,
    CASE WHEN accepted AND choice = 'search' AND aspect IS NOT NULL THEN list_append(coalesce(p_searched, searched), aspect) ELSE coalesce(p_searched, searched) END,
    CASE WHEN accepted AND choice = 'answer' AND aspect IS NOT NULL AND answer IS NOT NULL THEN list_append(coalesce(p_answered, answered), aspect) ELSE coalesce(p_answered, answered) END,
    CASE WHEN accepted AND choice = 'search' AND aspect IS NOT NULL THEN shown ELSE coalesce(p_visible, visible) END, fresh AND NOT (accepted AND aspect IS NOT NULL)
  FROM (SELECT * EXCLUDE (kind0), CASE WHEN kind0 IS NULL AND seen AND NOT loud AND choice = 'search' AND len(shown) = 0 THEN 'environment-failure' ELSE kind0 END AS kind,
      kind0 IS NULL AND seen AND NOT loud AND NOT (choice = 'search' AND len(shown) = 0) AS accepted, loud OR refusal IS NOT NULL AS refused
    FROM (SELECT *, coalesce(refusal, CASE WHEN choice IS NULL OR choice NOT IN ('search', 'action', 'answer') OR coalesce(solid, '') = '' THEN 'invalid-parameters' WHEN many THEN 'cross-aspect'
          WHEN held_on IS NOT NULL AND aspect IS NOT NULL AND aspect <> held_on THEN 'cross-aspect' WHEN choice = 'search' THEN CASE WHEN list_contains(searched, held_on) THEN 'repeated-search' END
          WHEN choice = 'action' THEN CASE WHEN held_on IS NULL OR NOT list_contains(searched, held_on) THEN 'action-before-search' END
          WHEN held_on IS NULL OR NOT list_contains(searched, held_on) THEN 'answer-before-search' WHEN answer IS NULL THEN 'invalid-parameters' WHEN NOT list_contains(visible, answer) THEN 'invisible-id' WHEN list_contains(answered, held_on) THEN 'duplicate-answer' END) AS kind0
      FROM (SELECT s.*, coalesce(s.about, r.current) AS aspect, coalesce(r.current, nullif(nullif(s.p_current, ''), 'none')) AS held_on, r.fresh AS fresh0, r.current, r.searched, r.answered, r.visible, r.fresh FROM run r JOIN said s ON s.record = r.record AND s.n = r.n + 1)))),
e AS (SELECT *, coalesce(held_on, aspect) AS ref FROM run WHERE n > 0),
mended AS (SELECT e.*, CASE WHEN NOT accepted THEN (SELECT min(c.pos) FROM e c WHERE c.record = e.record AND c.pos > e.pos AND c.accepted AND CASE e.kind
    WHEN 'action-before-search' THEN c.choice = 'search' AND ((e.ref IS NOT NULL AND coalesce(c.aspect, e.ref) = e.ref) OR (e.ref IS NULL AND e.fresh0))
    WHEN 'answer-before-search' THEN (c.choice = 'search' AND ((e.ref IS NOT NULL AND coalesce(c.aspect, e.ref) = e.ref) OR (e.ref IS NULL AND e.fresh0))) OR (c.choice = 'answer' AND c.aspect = e.ref)
    WHEN 'cross-aspect' THEN c.aspect = e.ref WHEN 'repeated-search' THEN c.choice IN ('action', 'answer') AND e.ref IS NOT NULL AND coalesce(c.aspect, e.ref) = e.ref
    WHEN 'invalid-parameters' THEN (c.choice = e.choice OR e.choice IS NULL OR e.choice NOT IN ('search', 'action', 'answer')) AND e.ref IS NOT NULL AND coalesce(c.aspect, e.ref) = e.ref
    WHEN 'invisible-id' THEN c.choice = 'answer' AND c.aspect = e.ref WHEN 'duplicate-answer' THEN c.choice = 'search' AND e.ref IS NOT NULL AND c.aspect IS DISTINCT FROM e.ref
    WHEN 'vague-action' THEN c.choice = 'action' AND length(trim(c.content)) >= 12 AND e.ref IS NOT NULL AND coalesce(c.aspect, e.ref) = e.ref END) END AS repaired_by,
  EXISTS (SELECT 1 FROM e c WHERE c.record = e.record AND c.pos > e.pos AND c.accepted AND c.aspect IS NOT NULL AND c.aspect IS DISTINCT FROM e.aspect) AS other FROM e),
spec AS (SELECT DISTINCT user_id AS record, a AS aspect, CASE a WHEN 'flight' THEN ['F1'] ELSE ['H0', 'H2'] END AS correct FROM events, (SELECT unnest(['flight', 'hotel']) AS a) WHERE user_id % 5 <> 0 AND (a = 'flight' OR user_id % 3 = 0)),
judged AS (SELECT m.*, coalesce(choice = 'answer' AND NOT list_contains(correct, answer), false) AS wrong, record % 13 = 0 AS infra FROM mended m LEFT JOIN spec USING (record, aspect)),
faults AS (SELECT *, CASE WHEN NOT seen THEN 'tool_observation_misaligned' WHEN kind = 'environment-failure' THEN kind WHEN NOT accepted AND NOT refused THEN 'unrepaired-recoverable-error' WHEN NOT accepted AND repaired_by IS NULL THEN coalesce(kind, 'unrepaired-recoverable-error')
    WHEN accepted AND wrong AND NOT other THEN 'wrong-terminal-answer' END AS fault FROM judged),
cut AS (SELECT record, min(pos) FILTER (fault IS NOT NULL) AS cut_pos FROM faults GROUP BY record),
kept AS (SELECT *, pos < coalesce(cut_pos, pos + 1) OR infra AS kept FROM faults JOIN cut USING (record)),
answers AS (SELECT record, aspect, arg_max(answer, pos) AS answer FROM kept WHERE kept AND accepted AND choice = 'answer' AND answer IS NOT NULL GROUP BY record, aspect),
rights AS (SELECT s.record, count(*) AS total, count(*) FILTER (list_contains(correct, answer)) AS n_right FROM spec s LEFT JOIN answers USING (record, aspect) GROUP BY s.record),
per AS (SELECT record, count(*) AS n_events, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (kept) AS n_kept, count(*) FILTER (kept AND accepted AND NOT wrong AND NOT infra) AS n_supervised, count(*) FILTER (kept AND NOT accepted AND NOT infra) AS n_repaired,
  CASE WHEN NOT any_value(infra) THEN arg_min(fault, pos) FILTER (fault IS NOT NULL) END AS fault, any_value(infra) AS infra FROM kept GROUP BY record),
classed AS (SELECT per.*, coalesce(n_right, 0) AS n_right, coalesce(total, 0) AS n_aspects, CASE WHEN infra OR total IS NULL THEN 'infrastructure_invalid' WHEN n_right = total AND n_repaired > 0 THEN 'recoverable_correct' WHEN n_right = total THEN 'strict_gold' WHEN n_right > 0 THEN 'partial_correct' ELSE 'totally_wrong' END AS class FROM per LEFT JOIN rights USING (record))"""


def _made(spark, sf):
    """Calls made of events, and the right options of each user."""
    e = table(spark, sf, "events")
    text = lambda sql: F.expr(sql.replace("\\n", "\n"))
    calls = e.select(F.col("user_id").alias("record"), F.col("event_id").alias("pos"), text(_CHOICE).alias("choice"), text(_CONTENT).alias("content"), text(_FEEDBACK).alias("feedback"))
    users = e.select(F.col("user_id").alias("record")).distinct()
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    asked = F.array(F.struct(F.lit("flight").alias("aspect"), ids("F1").alias("correct")), F.struct(F.lit("hotel").alias("aspect"), ids("H0", "H2").alias("correct")))
    spec = users.where("record % 5 <> 0").select("record", F.explode(asked).alias("s")).select("record", "s.*").where("aspect = 'flight' OR record % 3 = 0")
    return users, calls, spec


@query(f"WITH {_REPLAY} SELECT record AS user_id, n_events, n_accepted, n_kept, n_supervised, n_repaired, fault, n_right, n_aspects, class, CASE class WHEN 'infrastructure_invalid' THEN 0.0 WHEN 'totally_wrong' THEN 0.0 WHEN 'partial_correct' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM classed")
def replay_classification(spark, sf):
    _, calls, spec = _made(spark, sf)
    out = replay.outcomes(replay.cleaned(calls, spec), spec, infra=F.col("record") % 13 == 0)
    return out.select(F.col("record").alias("user_id"), "n_events", "n_accepted", "n_kept", "n_supervised", "n_repaired", "fault", "n_right", "n_aspects", "class", "weight")


@query(f"WITH {_REPLAY} SELECT pos AS event_id, choice, aspect, kind, refused, repaired_by FROM mended WHERE NOT accepted")
def replay_repairs(spark, sf):
    _, calls, _ = _made(spark, sf)
    return replay.repaired(replay.replayed(calls)).where(~F.col("accepted")).select(F.col("pos").alias("event_id"), "choice", "aspect", "kind", "refused", "repaired_by")


@query(f"""
WITH {_REPLAY}, w AS (SELECT DISTINCT user_id AS record, CASE WHEN user_id % 7 = 0 THEN 'outside_domain' WHEN user_id % 11 = 0 THEN 'quarantined' ELSE 'accepted' END AS place FROM events),
k AS (SELECT place, class FROM w LEFT JOIN classed USING (record))
SELECT count(*) AS source_records, count(*) FILTER (place = 'outside_domain') AS outside_domain, count(*) FILTER (place = 'quarantined') AS quarantined, count(*) FILTER (place = 'accepted') AS accepted,
  {", ".join(f"count(*) FILTER (place = 'accepted' AND class = '{c}') AS {c}" for c in replay.CLASS_WEIGHTS)} FROM k""")
def curation_counts(spark, sf):
    users, calls, spec = _made(spark, sf)
    key = F.col("record")
    return replay.curate(users, calls, spec, domain=key % 7 != 0, quarantined=key % 11 == 0, infra=key % 13 == 0)[2]
