"""Transcripts of tool calls: what the protocol accepts, what repairs what, where to cut, how to classify.

A transcript is rows (record, pos, choice, content, feedback), one for each call; feedback is null where no
observation followed it. Records are scanned row by row, forward for the state of the protocol and
backward for the next accepted call of each kind, so that a record's length costs time only in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PRIVATE_KEYS, option_ids
from .scan import scan

_TEXTS = "array<string>"

#: What feedback says and the kind that it tells of, in the order in which they are tried;
#: every text of a tuple must stand in the feedback.
REJECTIONS = (
    ("environment-failure", (("environment operation failed",), ("environment could not complete",), ("environment/api",), ("internal error",), ("backend is experiencing some issues",), ("responding system met some issues",), ("not sure how to respond to your latest utterance right now",), ("evaluation_timeout",), ("evaluation_error",))),
    ("action-before-search", (("action-before-search",),)),
    ("answer-before-search", (("answer-before-search",),)),
    ("cross-aspect", (("cross-aspect",), ("one tool call may target only one aspect",))),
    ("repeated-search", (("repeated tool call",), ("already searched",), ("duplicate search",))),
    ("invisible-id", (("invisible",), ("not visible",), ("visible option", "invalid"))),
    ("duplicate-answer", (("already answered",), ("duplicate answer",), ("already recommended",), ("same initial", "option"), ("same aspect", "answer"))),
    ("vague-action", (("vague",), ("too general",), ("too broad",))),
    ("invalid-parameters", (("invalid",), ("missing required",), ("parameter", "reject"), ("rejected",))),
)
#: Kinds that a later call may repair; a longer action repairs a vague one.
RECOVERABLE = ("action-before-search", "answer-before-search", "cross-aspect", "repeated-search", "invalid-parameters", "invisible-id", "duplicate-answer", "vague-action")
LONG_ACTION = 12
#: Aspects by the first letter of an option id, and by words.
ASPECT_OF = {"F": "flight", "H": "hotel", "A": "apartment", "C": "rental_car", "R": "restaurant"}
ASPECT_WORDS = {
    "flight": ("flight", "airline", "airport"),
    "hotel": ("hotel",),
    "apartment": ("apartment",),
    "rental_car": ("rental car", "car rental", "rental vehicle"),
    "restaurant": ("restaurant", "dining", "reservation"),
}
#: Classes, the gravest first, and their sample weights.
CLASS_WEIGHTS = {"infrastructure_invalid": 0.0, "recoverable_correct": 1.0, "strict_gold": 1.0, "partial_correct": 0.5, "totally_wrong": 0.0}
CHOICES = ("search", "action", "answer")


# ---------------------------------------------------------------- what texts say


def rejection_kind(feedback: Column) -> Column:
    """The kind of rejection that a feedback text tells of; null if it tells of none."""
    text, out = F.lower(feedback), F.lit(None).cast("string")
    for kind, marks in reversed(REJECTIONS):
        hit = F.lit(False)
        for together in marks:
            every = F.lit(True)
            for mark in together:
                every = every & text.contains(mark)
            hit = hit | every
        out = F.when(hit, kind).otherwise(out)
    return out


def is_rejected(feedback: Column) -> Column:
    """Whether a feedback text is a refusal."""
    text = F.lower(feedback)
    return F.coalesce(text.contains("tool call rejected") | text.contains("operation failed") | rejection_kind(feedback).isNotNull(), F.lit(False))


def _named(text: Column) -> Column:
    low = F.lower(text)
    hits = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w)), F.lit(a)) for a, words in ASPECT_WORDS.items()]
    return F.array_compact(F.array(*hits))


def _of_ids(ids: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in ASPECT_OF.items() for x in kv])
    return F.array_compact(F.transform(ids, lambda i: kinds[F.substring(i, 1, 1)]))


def mentioned(text: Column) -> Column:
    """The aspects that a text names, by words or by option ids."""
    return F.array_union(_named(text), _of_ids(option_ids(text)))


def aspect_said(text: Column, choice: Column) -> Column:
    """The aspect that a call is about: that of an answer's only option id, else the one aspect that is
    named; null where none or several are."""
    ids, named = option_ids(text), _named(text)
    by_word = F.when(F.size(named) == 1, F.element_at(named, 1))
    return F.when((choice == "answer") & (F.size(ids) == 1), F.element_at(_of_ids(ids), 1)).otherwise(by_word)


def _line(feedback: Column, label: str) -> Column:
    return F.regexp_extract(feedback, rf"(?i){label}:\s*([^\n]*)", 1)


def _names(feedback: Column, label: str) -> Column:
    line = F.regexp_replace(_line(feedback, label), r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(F.lower(line), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.lower(line) == "none", F.array().cast(_TEXTS)).otherwise(parts)


def public_state(feedback: Column) -> Column:
    """(current, searched, answered, visible) as a feedback tells them; a list is null where the feedback
    doesn't tell it, current is empty where it says none and null where it says nothing."""
    said = F.coalesce(feedback, F.lit(""))
    current = F.lower(F.regexp_extract(said, r"(?i)Current aspect:\s*([A-Za-z_]+)", 1))
    told = lambda value, label: F.when((F.size(value) > 0) | said.contains(label), value)
    return F.struct(
        F.when((current != "") & (current != "none"), current).when(said.contains("Current aspect:"), "").alias("current"),
        told(_names(said, "Searched aspects"), "Searched aspects:").alias("searched"),
        told(_names(said, "Answered aspects"), "Answered aspects:").alias("answered"),
        told(option_ids(_line(said, "Visible option IDs for current aspect")), "Visible option IDs").alias("visible"),
    )


# ---------------------------------------------------------------- forward and backward


def _call(state, choice, known, filled, about, many, answer, refusal, refused, seen, told, shown):
    """The protocol's next state, and (aspect, accepted, kind, on, fresh) of a call."""
    current, searched, answered, visible, fresh = state
    aspect = about if about is not None else current
    on = current if current is not None else (told["current"] or None)
    kind = refusal
    if kind is None:
        kind = "invalid-parameters" if not known or not filled else "cross-aspect" if many else _fault(choice, aspect, on, answer, searched, visible, answered)
    accepted = seen and not refused and kind is None
    if accepted and choice == "search" and not shown:
        accepted, kind = False, "environment-failure"
    out = (aspect, accepted, kind, on, fresh)
    after = current if told["current"] is None else (told["current"] or None)
    searched, answered, visible = (x if t is None else frozenset(t) for x, t in zip((searched, answered, visible), (told["searched"], told["answered"], told["visible"]), strict=True))
    if accepted:
        if choice == "search" and aspect:
            after, searched, visible = aspect, searched | {aspect}, frozenset(shown)
        if choice == "answer" and aspect and answer:
            after, answered = None, answered | {aspect}
        fresh = fresh and not aspect
    return (after, searched, answered, visible, fresh), out


def _fault(choice, aspect, on, answer, searched, visible, answered):
    """The rule of the protocol that a call breaks; None for none."""
    if on is not None and aspect is not None and aspect != on:
        return "cross-aspect"
    open_ = on is not None and on in searched
    if choice == "search":
        return "repeated-search" if open_ else None
    if not open_:
        return f"{choice}-before-search"
    if choice == "action":
        return None
    if answer is None:
        return "invalid-parameters"
    if answer not in visible:
        return "invisible-id"
    return "duplicate-answer" if on in answered else None


def replayed(calls: DataFrame, record: str = "record", pos: str = "pos") -> DataFrame:
    """Add choice and content in their plain form, answer (the only option id of an answer), seen, refused,
    aspect, accepted, kind (null if nothing is wrong), on (the aspect open at the time) and fresh (no call
    was accepted on any aspect before).

    A refusal that the feedback tells comes first, then missing or unknown parameters and calls on more
    than one aspect, then what the state implies. A search whose feedback shows no option is a failure of
    the environment. What a feedback says of the state holds from there on. Records without calls give no
    rows; a null choice or content counts as missing; repeated positions keep no order of their own.
    """
    said = F.col("content")
    ids, solid = option_ids(said), F.regexp_replace(said, r"^\s+|\s+$", "")
    answer = F.when((F.col("choice") == "answer") & (F.size(ids) == 1) & (F.upper(solid) == F.element_at(ids, 1)), F.element_at(ids, 1))
    held = calls.withColumn("choice", F.lower("choice"))
    held = held.withColumns(
        {
            "answer": answer, "seen": F.col("feedback").isNotNull(), "refused": is_rejected(F.col("feedback")),
            "_known": F.coalesce(F.col("choice").isin(*CHOICES), F.lit(False)), "_filled": F.coalesce(solid != "", F.lit(False)), "_about": aspect_said(said, F.col("choice")),
            "_many": F.coalesce(F.size(mentioned(said)) > 1, F.lit(False)), "_refusal": rejection_kind(F.col("feedback")), "_told": public_state(F.col("feedback")),
            "_shown": option_ids(F.coalesce("feedback", F.lit(""))),
        }
    )
    start = lambda: (None, frozenset(), frozenset(), frozenset(), True)
    reads = ["choice", "_known", "_filled", "_about", "_many", "answer", "_refusal", "refused", "seen", "_told", "_shown"]
    out = scan(held, [record], [pos], reads, start, _call, "aspect string, accepted boolean, kind string, on string, fresh boolean")
    return out.drop("_known", "_filled", "_about", "_many", "_refusal", "_told", "_shown")


def _soonest(*places):
    return min((p for p in places if p is not None), default=None)


def _repair(state, pos, choice, aspect, accepted, kind, on, fresh, lengthy):
    """Places of the next accepted calls, and (repaired_by, other) of a call: what repairs it, and the next
    accepted call on another aspect."""
    at = state.get
    other = _soonest(*(p for (c, a), p in state.items() if c == "any" and a not in (None, aspect)))
    by, ref = None, on or aspect
    if not accepted and kind in RECOVERABLE:
        same = lambda c: _soonest(at((c, ref)), at((c, None))) if ref else None
        first = _soonest(*(p for (c, _), p in state.items() if c == "search")) if not ref and fresh else None
        if kind == "action-before-search":
            by = _soonest(same("search"), first)
        elif kind == "answer-before-search":
            by = _soonest(same("search"), first, at(("answer", ref)) if ref else None)
        elif kind == "cross-aspect":
            by = at(("any", ref)) if ref else None
        elif kind == "repeated-search":
            by = _soonest(same("action"), same("answer"))
        elif kind == "invalid-parameters":
            by = same(choice if choice in CHOICES else "any")
        elif kind == "invisible-id":
            by = at(("answer", ref)) if ref else None
        elif kind == "duplicate-answer":
            by = _soonest(*(p for (c, a), p in state.items() if c == "search" and a != ref)) if ref else None
        else:
            by = same("long")
    if accepted:
        state[choice, aspect] = state["any", aspect] = pos
        if choice == "action" and lengthy:
            state["long", aspect] = pos
    return state, (by, other)


def repaired(calls: DataFrame, record: str = "record", pos: str = "pos") -> DataFrame:
    """Add repaired_by, the place of the accepted call that first repairs a rejected one by the rule of its
    kind, and other, that of the next accepted call on another aspect; null for none. ``calls`` is what
    ``replayed`` gives. One backward pass keeps the next accepted place of each choice and aspect.
    """
    held = calls.withColumns({"_at": F.col(pos).cast("long"), "_long": F.coalesce(F.length(F.regexp_replace("content", r"^\s+|\s+$", "")) >= LONG_ACTION, F.lit(False))})
    reads = ["_at", "choice", "aspect", "accepted", "kind", "on", "fresh", "_long"]
    return scan(held, [record], [pos], reads, dict, _repair, "repaired_by long, other long", descending=True).drop("_at", "_long")


# ---------------------------------------------------------------- cut and class


def cleaned(calls: DataFrame, spec: DataFrame, record: str = "record", pos: str = "pos", *, broken: Column | None = None) -> DataFrame:
    """Add fault (why the record is cut at a call, null if it isn't), kept (the call comes before the first
    fault of its record) and supervised (it is kept, accepted and no wrong answer).

    ``spec`` (record, aspect, correct) has the right option ids of each aspect of a record. ``broken`` is a
    code for calls that couldn't be read at all. A refused call stays, without being trained on, if the
    refusal was said aloud and a later call repairs it; a wrong answer stays if an accepted call on another
    aspect follows; an aspect without a row in ``spec`` has no wrong answers.
    """
    right = spec.select(F.col(record).alias("_r"), F.col("aspect").alias("_a"), "correct")
    held = repaired(replayed(calls, record, pos), record, pos).join(right, F.col(record).eqNullSafe(F.col("_r")) & (F.col("aspect") == F.col("_a")), "left").drop("_r", "_a")
    wrong = F.coalesce((F.col("choice") == "answer") & ~F.array_contains("correct", F.col("answer")), F.lit(False))
    mendable = F.col("kind").isin(*RECOVERABLE)
    fault = (
        F.when(F.lit(False) if broken is None else broken.isNotNull(), F.lit(None).cast("string") if broken is None else broken)
        .when(~F.col("seen"), "tool_observation_misaligned")
        .when(F.col("kind").isNotNull() & ~mendable, F.col("kind"))
        .when(~F.col("accepted") & F.col("refused") & mendable & F.col("repaired_by").isNotNull(), None)
        .when(~F.col("accepted") & F.col("refused"), F.coalesce("kind", F.lit("unrepaired-recoverable-error")))
        .when(~F.col("accepted"), "unrepaired-recoverable-error")
        .when(wrong & F.col("other").isNull(), "wrong-terminal-answer")
    )
    held = held.withColumns({"fault": fault, "_wrong": wrong})
    cut = F.min(F.when(F.col("fault").isNotNull(), F.col(pos))).over(W.partitionBy(record))
    held = held.withColumn("kept", F.coalesce(F.col(pos) < cut, F.lit(True)))
    return held.withColumn("supervised", F.col("kept") & F.col("accepted") & ~F.col("_wrong")).drop("_wrong", "correct")


def classify(infra: Column, repaired: Column, answered: Column, right: Column, total: Column) -> Column:
    """The class of a cleaned record from how many calls were repaired, aspects answered, answers right and
    aspects there are; records without aspects can't be judged."""
    success = (total > 0) & (right == total) & (answered >= total)
    return F.when(infra | (total <= 0), "infrastructure_invalid").when(success & (repaired > 0), "recoverable_correct").when(success, "strict_gold").when(right > 0, "partial_correct").otherwise("totally_wrong")


def class_weight(c: Column) -> Column:
    return F.create_map(*[x for k, v in CLASS_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[c]


def outcomes(calls: DataFrame, spec: DataFrame, record: str = "record", pos: str = "pos", *, infra: Column | None = None) -> DataFrame:
    """One row a record of what ``cleaned`` gave: n_events, n_accepted, n_kept, n_supervised, n_repaired, fault
    (the first one), n_right, n_aspects, class, weight. Only the last kept answer of an aspect counts.

    ``infra`` says of a call's row whether its record's reward is invalid: such records are neither cut nor
    trained on. Records without a row in ``spec`` are infrastructure_invalid.
    """
    bad = F.lit(False) if infra is None else F.coalesce(infra, F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    per_aspect = calls.withColumn("_bad", bad).groupBy(record, "aspect").agg(
        F.max("_bad").alias("_bad"), F.count("*").alias("n_events"), n(F.col("accepted")).alias("n_accepted"), n(F.col("kept")).alias("n_kept"), n(F.col("supervised")).alias("n_supervised"),
        n(F.col("kept") & ~F.col("accepted")).alias("n_repaired"), F.min(F.when(F.col("fault").isNotNull(), F.struct(pos, "fault"))).alias("_fault"),
        F.max(F.when((F.col("kept") | F.col("_bad")) & F.col("accepted") & F.col("answer").isNotNull(), F.struct(pos, "answer")))["answer"].alias("_answer"),
    )
    asked = spec.select(F.col(record).alias("_r"), F.col("aspect").alias("_a"), "correct")
    judged = per_aspect.join(asked, F.col(record).eqNullSafe(F.col("_r")) & (F.col("aspect") == F.col("_a")), "left")
    totals = asked.groupBy("_r").agg(F.count("*").alias("_total"))
    out = judged.groupBy(record).agg(
        *[F.sum(c).alias(c) for c in ("n_events", "n_accepted", "n_kept", "n_supervised", "n_repaired")], F.min("_fault")["fault"].alias("fault"),
        n(F.col("_answer").isNotNull()).alias("_answered"), n(F.array_contains("correct", F.col("_answer"))).alias("n_right"), F.max("_bad").alias("_bad"),
    )
    out = out.join(totals, F.col(record).eqNullSafe(F.col("_r")), "left").drop("_r").withColumn("n_aspects", F.coalesce("_total", F.lit(0)))
    kind = classify(F.col("_bad"), F.col("n_repaired"), F.col("_answered"), F.col("n_right"), F.col("n_aspects"))
    whole = lambda c, instead: F.when(F.col("_bad"), instead).otherwise(F.col(c))
    out = out.withColumns({"class": kind, "n_kept": whole("n_kept", F.col("n_events")), "n_supervised": whole("n_supervised", F.lit(0)), "n_repaired": whole("n_repaired", F.lit(0)), "fault": whole("fault", F.lit(None).cast("string"))})
    return out.withColumn("weight", class_weight(F.col("class"))).drop("_bad", "_answered", "_total")


def later_event(df: DataFrame, group: str, order: str, wanted: Column) -> DataFrame:
    """Add later: the order of the first row after each that is ``wanted``. One window in falling order, whose
    frame grows row by row; no self-join."""
    w = W.partitionBy(group).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("later", F.min(F.when(wanted, F.col(order))).over(w))


def earlier_event(df: DataFrame, group: str, order: str, wanted: Column) -> DataFrame:
    """Add earlier: the order of the last row before each that is ``wanted``."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("earlier", F.max(F.when(wanted, F.col(order))).over(w))


def deltas(df: DataFrame, group: str, order: str, counters: list[str]) -> DataFrame:
    """Add d_<counter>: the change since the row before; the first row counts from 0."""
    w = W.partitionBy(group).orderBy(order)
    return df.withColumns({f"d_{c}": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in counters})


def action_outcomes(df: DataFrame, episode: str, aspect: str, text: str, order: str, gained: Column) -> DataFrame:
    """Add outcome, duplicate and redundant. An action is useful if it gained something; of those that didn't,
    duplicates too, the first on an aspect is no_gain_first and the others no_gain. A duplicate has the
    text of an earlier action on the aspect, but for case and what is neither letter, digit nor underscore;
    blank texts are none. Redundant are duplicates and no_gain. outcome is duplicate for a duplicate,
    whatever it gained."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text)), r"(?U)\W+", " "))
    held = df.withColumns({"_text": plain, "_none": (~F.coalesce(gained, F.lit(False))).cast("int")})
    again = (F.row_number().over(W.partitionBy(episode, aspect, "_text").orderBy(order)) > 1) & F.coalesce(F.col("_text") != "", F.lit(False))
    before = F.sum("_none").over(W.partitionBy(episode, aspect).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    held = held.withColumns({"duplicate": again, "_k": before})
    late = (F.col("_none") == 1) & (F.col("_k") > 1)
    held = held.withColumn("outcome", F.when(F.col("duplicate"), "duplicate").when(F.col("_none") == 0, "useful").when(late, "no_gain").otherwise("no_gain_first"))
    return held.withColumn("redundant", F.col("duplicate") | late).drop("_text", "_none", "_k")


def reveal(available: Column, agent: Column, proactive: Column) -> tuple[Column, Column]:
    """(revealed, left): ids of the agent's question that are still available, else of the proactive one."""
    mine, theirs = F.array_intersect(agent, available), F.array_intersect(proactive, available)
    got = F.when(F.size(mine) > 0, mine).otherwise(theirs)
    return got, F.array_except(available, got)


#: The schema of a canonical record, and the roles of its messages.
SCHEMA_VERSION = "travelgym-canonical-v1"
ROLES = ("system", "user", "assistant", "tool")
_FOUND = f"struct<i:int,ids:{_TEXTS},out:{_TEXTS}>"


def violations(version: Column, messages: Column, mask: Column, tools: Column, *, schema: str = SCHEMA_VERSION) -> Column:
    """Codes of what is wrong with a canonical record, the first found first; empty if nothing is.

    ``messages`` is an array of (role, tool_calls, tool_call_id), tool_calls an array of (id, function) with
    the JSON of its arguments in function.arguments; ``mask`` has one entry a message, ``tools`` one or
    more. A tool's message answers a call of the last assistant message before it. A null array of
    messages, mask or tools is as wrong as one that is missing.
    """
    name = lambda acc, *more: F.concat(F.lit("message_"), acc["i"].cast("string"), *more)

    def of_call(acc, call, j):
        args = call["function"]["arguments"]
        at = (F.lit("_"), j.cast("string"))
        whole = F.coalesce(F.get_json_object(args, "$").startswith("{"), F.lit(False))
        private = F.exists(F.coalesce(F.json_object_keys(args), F.array().cast(_TEXTS)), lambda k: F.lower(k).isin(*PRIVATE_KEYS))
        return (
            F.when(call.isNull(), name(acc, F.lit("_tool_call"), *at, F.lit("_not_object"))).when(call["function"].isNull(), name(acc, F.lit("_tool_function"), *at))
            .when(~whole, name(acc, F.lit("_tool_arguments"), *at)).when(private, name(acc, F.lit("_tool_arguments"), *at, F.lit("_private_keys")))
        )

    def step(acc, m):
        calls = F.when(m["role"] == "assistant", F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,function:struct<arguments:string>>>")))
        ids = F.when(m["role"] == "assistant", F.transform(F.filter(calls, lambda c: c.isNotNull()), lambda c: F.coalesce(c["id"], F.lit("None")))).otherwise(acc["ids"])
        lost = (m["role"] == "tool") & ((F.coalesce(m["tool_call_id"], F.lit("")) == "") | ~F.array_contains(acc["ids"], F.coalesce(m["tool_call_id"], F.lit(""))))
        found = F.when(m.isNull(), F.array(name(acc, F.lit("_not_object")))).when(~F.coalesce(m["role"].isin(*ROLES), F.lit(False)), F.array(name(acc, F.lit("_role"))))
        found = found.when(m["role"] == "assistant", F.array_compact(F.transform(calls, lambda c, j: of_call(acc, c, j)))).when(lost, F.array(name(acc, F.lit("_tool_call_id"))))
        more = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.concat(acc["out"], found)).otherwise(acc["out"])
        return F.struct((acc["i"] + 1).alias("i"), F.coalesce(ids, F.array().cast(_TEXTS)).alias("ids"), more.alias("out")).cast(_FOUND)

    none = F.array().cast(_TEXTS)
    inner = F.aggregate(messages, F.struct(F.lit(0), none, none).cast(_FOUND), step, lambda acc: acc["out"])
    head = F.array_compact(F.array(
        F.when(~version.eqNullSafe(F.lit(schema)), "schema_version_mismatch"), F.when(messages.isNull(), "messages_not_list"),
        F.when(messages.isNotNull() & (F.coalesce(F.size(mask), F.lit(-1)) != F.size(messages)), "assistant_train_mask_length"),
    ))
    return F.concat(head, F.coalesce(inner, none), F.array_compact(F.array(F.when(F.coalesce(F.size(tools), F.lit(0)) <= 0, "tools_schema_missing"))))


def steps_needed(aspects: Column, searched: Column, answered: Column) -> Column:
    """The fewest steps that complete the aspects: an answer each, and a search where there was none."""
    return F.aggregate(F.array_except(aspects, answered), F.lit(0), lambda n, a: n + F.when(F.array_contains(searched, a), 1).otherwise(2))


def deadline_blocks(most: int, step: Column, aspects: Column, searched: Column, answered: Column) -> Column:
    """Whether the steps left are only enough to complete what is open, so that no other action may be taken."""
    return F.lit(max(1, most)) - step <= steps_needed(aspects, searched, answered)


def counters(calls: DataFrame, record: str = "record") -> DataFrame:
    """What replays come to: steps, accepted calls by choice, rejected ones, and rejections by kind."""
    ok = lambda choice: F.coalesce(F.sum(F.when(F.col("accepted") & (F.col("choice") == choice), F.col("_n"))), F.lit(0))
    per = calls.groupBy(record, "choice", "accepted", "kind").agg(F.count("*").alias("_n"))
    bad = per.where(~F.col("accepted")).groupBy(record, "kind").agg(F.sum("_n").alias("_n")).groupBy(F.col(record).alias("_r")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "_n")))).alias("by_kind"))
    out = per.groupBy(record).agg(F.sum("_n").alias("steps"), ok("search").alias("searches"), ok("action").alias("actions"), ok("answer").alias("answers"), F.coalesce(F.sum(F.when(~F.col("accepted"), F.col("_n"))), F.lit(0)).alias("rejected"))
    return out.join(bad, F.col(record).eqNullSafe(F.col("_r")), "left").drop("_r").withColumn("by_kind", F.coalesce("by_kind", F.create_map().cast("map<string,bigint>")))


def task_spec(dimensions: Column, options: dict[str, tuple[Column, Column, Column]]) -> Column:
    """(aspect, correct, every, best) of each dimension, ids in upper case. ``options`` has the columns
    of each aspect; dimensions without options drop."""
    upper = lambda ids: F.transform(F.coalesce(ids, F.array().cast(_TEXTS)), lambda x: F.upper(F.trim(x)))
    rows = [F.when(F.array_contains(dimensions, a), F.struct(F.lit(a).alias("aspect"), upper(right).alias("correct"), upper(every).alias("every"), F.upper(F.trim(best)).alias("best"))) for a, (right, every, best) in options.items()]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


#: The aspect of a search that names none, and what follows a kept answer.
UNKNOWN, RECORDED = "__unknown__", "Your answer was recorded."
_KEPT = "array<struct<idx:int,kept:boolean,content:string>>"
_LEGACY = f"struct<current:string,unnamed:boolean,searched:{_TEXTS},answered:{_TEXTS},open:boolean,last:string,out:{_KEPT}>"


def legacy_kept(messages: Column) -> Column:
    """Fold an array of (role, choice, aspect, content) structs, in order, into (idx, kept, content): which
    messages of an old transcript stay, and their texts.

    A call that breaks the protocol goes, and so do the observations up to the next call that stays;
    what follows a kept answer says only that it was recorded. One search may name no aspect; the
    answer after it names it. Other roles stay. Null and empty arrays give null and no rows.
    """
    empty = F.array().cast(_TEXTS)
    zero = F.struct(F.lit(None).cast("string"), F.lit(False), empty, empty, F.lit(False), F.lit(None).cast("string"), F.array().cast(_KEPT)).cast(_LEGACY)

    def step(acc, m):
        call, seen = (F.coalesce(m["role"].isin(*names), F.lit(False)) for names in (["assistant"], ["tool", "observation"]))
        search, action, answer = (call & m["choice"].eqNullSafe(c) for c in ("search", "action", "answer"))
        named = m["aspect"].isNotNull()
        resolved = answer & (acc["current"] == UNKNOWN) & named
        current = F.when(search & named, F.coalesce(acc["current"], m["aspect"])).when(search & ~acc["unnamed"], F.coalesce(acc["current"], F.lit(UNKNOWN))).when(resolved, m["aspect"]).otherwise(acc["current"])
        searched = F.when(resolved, F.array_append(acc["searched"], m["aspect"])).otherwise(acc["searched"])
        on, about = F.coalesce(current, F.lit("")), F.coalesce(m["aspect"], F.lit(""))
        ids = option_ids(m["content"])
        single = (F.size(ids) == 1) & (F.upper(F.trim(m["content"])) == F.try_element_at(ids, F.lit(1)))
        first = search & ~named & ~acc["unnamed"] & acc["current"].isNull()
        keep = F.coalesce(
            F.when(search & named, (m["aspect"] == current) & ~F.array_contains(searched, about))
            .when(search, first)
            .when(action, F.array_contains(searched, on) & ~F.array_contains(acc["answered"], on) & (~named | (about == on)))
            .when(answer, single & named & (about == on) & F.array_contains(searched, about) & ~F.array_contains(acc["answered"], about)),
            F.lit(False),
        )
        stays = F.when(call, keep).when(seen, acc["open"]).otherwise(True)
        text = F.when(seen & (acc["last"] == "answer"), RECORDED).otherwise(m["content"])
        return F.struct(
            F.when(keep & answer, F.lit(None).cast("string")).otherwise(current), acc["unnamed"] | first,
            F.when(keep & search, F.array_append(searched, F.coalesce(m["aspect"], F.lit(UNKNOWN)))).otherwise(searched),
            F.when(keep & answer, F.array_append(acc["answered"], m["aspect"])).otherwise(acc["answered"]),
            F.when(call, keep).otherwise(acc["open"]), F.when(call, F.when(keep, m["choice"])).otherwise(acc["last"]),
            F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("idx"), stays.alias("kept"), text.alias("content")))),
        ).cast(_LEGACY)

    return F.aggregate(messages, zero, step, lambda acc: acc["out"])


def curate(raw: DataFrame, calls: DataFrame, spec: DataFrame, record: str = "record", pos: str = "pos", *, domain: Column, quarantined: Column, infra: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, audits, counts) of raw transcripts: rows outside the domain and quarantined ones go, the
    rest are replayed, cut and classified.

    ``raw`` has one row a record; ``domain``, ``quarantined`` and ``infra`` are conditions on it, null for
    false. ``records`` are the accepted rows with what ``outcomes`` says (records without calls have zeros);
    ``audits`` are their calls, as ``cleaned``; ``counts`` is one row: source_records, outside_domain,
    quarantined, accepted and a count for each class.
    """
    said = lambda c: F.coalesce(c, F.lit(False))
    where = F.when(~said(domain), "outside_domain").when(said(quarantined), "quarantined").otherwise("accepted")
    held = raw.withColumns({"_where": where, "_infra": said(infra)})
    inside = held.where(F.col("_where") == "accepted").drop("_where")
    audits = cleaned(calls.join(inside.select(record, "_infra"), record), spec, record, pos)
    judged = outcomes(audits, spec, record, pos, infra=F.col("_infra"))
    records = inside.join(judged, record, "left")
    zero = ["n_events", "n_accepted", "n_kept", "n_supervised", "n_repaired", "n_right"]
    asked = spec.select(record).distinct().withColumn("_asked", F.lit(True))
    records = records.join(asked, record, "left").fillna(0, zero)
    records = records.withColumn("class", F.coalesce("class", F.when(F.col("_infra") | F.col("_asked").isNull(), "infrastructure_invalid").otherwise("totally_wrong")))
    records = records.withColumn("weight", class_weight(F.col("class"))).drop("_infra", "_asked")
    is_at = lambda x: F.count(F.when(F.col("_where") == x, 1)).alias(x)
    of = lambda c: F.count(F.when(F.col("class") == c, 1)).alias(c)
    before = held.agg(F.count("*").alias("source_records"), *[is_at(x) for x in ("outside_domain", "quarantined", "accepted")])
    return records, audits.drop("_infra"), before.crossJoin(F.broadcast(records.agg(*[of(c) for c in CLASS_WEIGHTS])))
