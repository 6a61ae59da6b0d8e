"""Episodes of a planning environment, replayed from their logged actions by one fold a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.messages import state_text
from .replay import deadline_blocks

#: What the environment says of a rejected call.
REPLIES = {
    "finished": "Tool call rejected: the episode is already finished.",
    "parameters": "Tool call rejected: invalid tool parameters.",
    "cross": "Tool call rejected: cross-aspect operation.",
    "answered": "Tool call rejected: the aspect was already answered.",
    "no_options": "Tool call rejected: no options are available for this aspect.",
    "repeated": "Tool call rejected: repeated tool call.",
    "early_action": "Tool call rejected: action-before-search.",
    "deadline": "Tool call rejected: remaining turn budget must be used to complete unanswered aspects.",
    "early_answer": "Tool call rejected: answer-before-search.",
    "invisible": "Tool call rejected: answer ID was not visible in Search results.",
}
#: Ends of an episode.
FINISH, COMPLETE, LIMIT, FAILURE = "finish", "all_aspects_answered", "max_steps", "user_simulator_api_error"

_ROW = "struct<idx:int,kind:string,aspect:string,accepted:boolean,message:string,steps:int,invalid:int,wrong:int,terminated:boolean,truncated:boolean,valid:boolean,reason:string>"
_STATE = f"struct<steps:int,invalid:int,wrong:int,current:string,searched:array<string>,answered:array<string>,acted:array<string>,done:boolean,cut:boolean,valid:boolean,reason:string,out:array<{_ROW}>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_action(text: Column) -> Column:
    """(kind, content) of '[search] what', '[action] ...', '[answer] id' or '[finish]'; kind null for
    any other text, content empty where there is none."""
    pattern = r"(?is)^\s*\[(search|action|answer|finish)\](?:\s*(.*))?$"
    held = F.coalesce(text, F.lit(""))
    kind = F.nullif(F.lower(F.regexp_extract(held, pattern, 1)), F.lit(""))
    return F.struct(kind.alias("kind"), F.trim(F.regexp_extract(held, pattern, 2)).alias("content"))


def play(actions: Column, plan: Column, offers: Column, said: Column, *, most: int = 25) -> Column:
    """Fold an array of (kind, content, aspect) structs, in order, into one row an action: whether it was
    accepted, the message, the counters after it and whether and why the episode has ended.

    ``plan`` lists the aspects in order; ``offers`` maps an aspect to (every, correct, shown): option
    ids, the right ones, and public facts by id; ``said`` maps an aspect to what the traveller says
    there, one text an action. Kinds: search, action, answer, finish; external is a malformed call that
    something else rejected, failure a broken simulator, which makes the episode invalid; null is a
    text that can't be parsed. An aspect that is null was none or ambiguous. Only the first aspect
    without an answer may be touched. Null and empty action arrays give null and no rows.
    """
    none = F.array().cast("array<string>")
    zero = F.struct(
        F.lit(0).alias("steps"), F.lit(0).alias("invalid"), F.lit(0).alias("wrong"), F.try_element_at(plan, F.lit(1)).alias("current"), none.alias("searched"), none.alias("answered"), none.alias("acted"),
        F.lit(False).alias("done"), F.lit(False).alias("cut"), F.lit(True).alias("valid"), F.lit("").alias("reason"), F.array().cast(f"array<{_ROW}>").alias("out"),
    ).cast(_STATE)

    def ids(aspect: Column) -> Column:
        return F.coalesce(F.try_element_at(offers, F.coalesce(aspect, F.lit("")))["every"], none)

    def upper(x: Column) -> Column:
        return F.transform(x, lambda v: F.upper(v))

    def times(acc: Column, aspect: Column) -> Column:
        return F.size(F.filter(acc["acted"], lambda x: x == aspect))

    def lines(s: Column) -> Column:
        shown = F.when(F.array_contains(s["searched"], F.coalesce(s["current"], F.lit(""))), ids(s["current"])).otherwise(none)
        counts = F.transform(plan, lambda a: F.concat(a, F.lit("="), times(s, a).cast("string")))
        inside = lambda xs: F.filter(plan, lambda a: F.array_contains(xs, a))
        return state_text(s["current"], {"Searched aspects": inside(s["searched"]), "Answered aspects": inside(s["answered"]), "Visible option IDs for current aspect": shown, "Action count by aspect": counts})

    def judged(acc: Column, e: Column) -> Column:
        """The name of the reply that rejects a call; null for one that holds."""
        aspect, kind = F.coalesce(e["aspect"], F.lit("")), F.coalesce(e["kind"], F.lit(""))
        content = F.coalesce(e["content"], F.lit(""))
        searched = F.array_contains(acc["searched"], aspect)
        late = deadline_blocks(most, acc["steps"] + 1, plan, acc["searched"], acc["answered"])
        return (
            F.when(kind == "failure", None)
            .when(acc["done"] | acc["cut"], "finished")
            .when(~kind.isin("search", "action", "answer", "finish"), "parameters")
            .when(kind == "finish", None)
            .when(content == "", "parameters")
            .when(~F.array_contains(plan, aspect) | (acc["current"].isNotNull() & (aspect != acc["current"])), "cross")
            .when(F.array_contains(acc["answered"], aspect), "answered")
            .when(~F.map_contains_key(offers, aspect), "no_options")
            .when(kind == "search", F.when(searched, "repeated"))
            .when(kind == "action", F.when(~searched, "early_action").when(late, "deadline"))
            .when(~searched, "early_answer")
            .when(~content.rlike(r"^[A-Za-z][0-9]+\z"), "parameters")
            .when(~F.array_contains(upper(ids(aspect)), F.upper(content)), "invisible")
        )

    def moved(acc: Column, e: Column, error: Column) -> Column:
        """The state after a call, but for the step limit and its row."""
        kind, ok, over = F.coalesce(e["kind"], F.lit("")), error.isNull(), acc["done"] | acc["cut"]
        search, act, answer = ok & (kind == "search"), ok & (kind == "action"), ok & (kind == "answer")
        counts = ~over & kind.isin("search", "action", "answer", "finish", "external")
        answered = F.when(answer, F.array_append(acc["answered"], e["aspect"])).otherwise(acc["answered"])
        following = F.try_element_at(F.filter(plan, lambda a: ~F.array_contains(answered, a)), F.lit(1))
        right = F.array_contains(upper(F.coalesce(F.try_element_at(offers, F.coalesce(e["aspect"], F.lit("")))["correct"], none)), F.upper(e["content"]))
        complete, finish, failure = answer & following.isNull(), ok & (kind == "finish"), kind == "failure"
        return F.struct(
            (acc["steps"] + counts.cast("int")).alias("steps"), (acc["invalid"] + (~ok).cast("int")).alias("invalid"), (acc["wrong"] + (answer & ~right).cast("int")).alias("wrong"),
            F.when(answer, following).otherwise(acc["current"]).alias("current"),
            F.when(search, F.array_append(acc["searched"], e["aspect"])).otherwise(acc["searched"]).alias("searched"), answered.alias("answered"),
            F.when(act, F.array_append(acc["acted"], e["aspect"])).otherwise(acc["acted"]).alias("acted"),
            (acc["done"] | finish | complete).alias("done"), (acc["cut"] | failure).alias("cut"), (acc["valid"] & ~failure).alias("valid"),
            F.when(finish, FINISH).when(complete, COMPLETE).when(failure, FAILURE).otherwise(acc["reason"]).alias("reason"),
        )

    def replied(before: Column, s: Column, e: Column, error: Column) -> Column:
        facts = F.try_element_at(offers, F.coalesce(e["aspect"], F.lit("")))["shown"]
        options = F.transform(ids(e["aspect"]), lambda i: F.concat(F.lit("- "), i, F.lit(": "), F.coalesce(F.try_element_at(facts, i), F.lit("{}"))))
        found = F.concat_ws("\n", F.concat(F.lit("Search results for "), e["aspect"], F.lit("; all candidates are shown:")), options)
        told = F.try_element_at(F.try_element_at(said, F.coalesce(e["aspect"], F.lit(""))), times(before, e["aspect"]) + 1)
        heard = F.coalesce(F.concat(F.lit("The traveler says: "), told), F.concat(F.lit("The traveler has no additional preference details for "), e["aspect"], F.lit("; compare the complete Search results.")))
        says = F.when(error.isNotNull(), F.create_map(*[x for k, v in REPLIES.items() for x in (F.lit(k), F.lit(v))])[error])
        says = says.when(e["kind"] == "search", found).when(e["kind"] == "action", heard).when(e["kind"] == "answer", F.concat(F.lit("Your answer was recorded for "), e["aspect"], F.lit("."))).when(e["kind"] == "finish", "Travel planning finished.")
        return F.when(~F.coalesce(e["kind"].isin("external", "failure"), F.lit(False)), F.concat_ws("\n", says, lines(s)))

    def step(acc: Column, e: Column) -> Column:
        def after(error: Column, s: Column) -> Column:
            limit = (s["steps"] >= most) & ~s["done"] & ~F.coalesce(e["kind"] == "failure", F.lit(False))
            cut, reason = s["cut"] | limit, F.when(limit, LIMIT).otherwise(s["reason"])
            row = F.struct(F.size(acc["out"]), e["kind"], e["aspect"], error.isNull() & ~F.coalesce(e["kind"] == "failure", F.lit(False)), replied(acc, s, e, error), s["steps"], s["invalid"], s["wrong"], s["done"], cut, s["valid"], reason).cast(_ROW)
            return F.struct(*[s[k].alias(k) for k in ("steps", "invalid", "wrong", "current", "searched", "answered", "acted", "done")], cut.alias("cut"), s["valid"].alias("valid"), reason.alias("reason"), F.concat(acc["out"], F.array(row)).alias("out")).cast(_STATE)

        return _let(judged(acc, e), lambda error: _let(moved(acc, e, error), lambda s: after(error, s)))

    return F.aggregate(actions, zero, step, lambda acc: acc["out"])
