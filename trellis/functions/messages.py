"""Messages and tool calls as columns: roles, call ids, arguments, public state, scores of answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "observation": "tool", "function_call": "assistant"}
CHOICES = ("search", "action", "answer")


def role(c: Column) -> Column:
    """A role by its usual name, in lower case."""
    low = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))])[low], low)


def call_id(message: Column, offset: Column) -> Column:
    """The id of a call that has none: call_ and index * 100 + offset in four digits at least."""
    number = (message * 100 + offset).cast("string")
    return F.concat(F.lit("call_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def call_arguments(c: Column) -> Column:
    """(choice, content) of a call in any of its forms: a JSON object, one under arguments (as an
    object or as text), or the text of one; a choice that isn't known is null."""
    inner = F.coalesce(F.get_json_object(c, "$.function.arguments"), F.get_json_object(c, "$.arguments"), c)
    choice = F.lower(F.coalesce(F.get_json_object(inner, "$.choice"), F.nullif(F.regexp_extract(c, r'"choice"\s*:\s*"([^"]*)"', 1), F.lit(""))))
    content = F.coalesce(F.get_json_object(inner, "$.content"), F.nullif(F.regexp_extract(c, r'"content"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")))
    return F.struct(F.when(choice.isin(*CHOICES), choice).alias("choice"), content.alias("content"))


def json_object(c: Column, schema: str) -> Column:
    """The object that a text holds: all of it, in a fence, or between its outermost braces."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    parse = lambda x: F.when(F.get_json_object(x, "$").startswith("{"), F.from_json(x, schema))
    return F.coalesce(parse(c), parse(fenced), parse(braced))


def listed(text: Column, label: str) -> Column:
    """The names that a line '<label>: a, b' of a public state lists; empty for none."""
    line = F.trim(F.regexp_extract(text, rf"(?im)^\s*{label}\s*:\s*(.*)$", 1))
    return F.when((line == "") | (F.lower(line) == "none"), F.array().cast("array<string>")).otherwise(F.transform(F.split(line, ","), lambda x: F.trim(x)))


def state_text(current: Column, lists: dict[str, Column]) -> Column:
    """A public state as lines, the current aspect first; empty lists say none."""
    line = lambda label, x: F.concat(F.lit(f"{label}: "), F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise("none"))
    return F.concat_ws("\n", F.concat(F.lit("Current aspect: "), F.coalesce(current, F.lit("none"))), *[line(k, v) for k, v in lists.items()])


def numbered(preferences: Column, least: int = 4) -> Column:
    """(id, preference) with ids P1, P2, ... in order, of those with ``least`` fields or more."""
    whole = F.filter(preferences, lambda p: F.size(p) >= least)
    return F.transform(whole, lambda p, i: F.struct(F.concat(F.lit("P"), (i + 1).cast("string")).alias("id"), p.alias("preference")))


def aspect(text: Column, hints: dict[str, list[str]]) -> Column:
    """The one aspect whose hints a text holds; null if none or several do."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(F.exists(F.array(*[F.lit(h) for h in hs]), lambda h: low.contains(h)), F.lit(a)) for a, hs in hints.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def tail_answer(text: Column, chars: int = 300) -> Column:
    """What the last 'Answer: ...' line in the last ``chars`` characters says; [INVALID] without one."""
    got = F.regexp_extract_all(F.substring(text, -chars, chars), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.trim(F.try_element_at(got, F.lit(-1))), F.lit("[INVALID]"))


def geometry_score(right: Column, text: Column) -> Column:
    """0.9 for the answer and 0.1 for a think block before a boxed answer."""
    form = text.rlike(r"(?s)<think>.*</think>.*\\boxed\{.*\}")
    return 0.9 * right.cast("double") + 0.1 * form.cast("double")


def prompt_loss_mask(length: Column, prompt: Column) -> Column:
    """1 where the next token is of the response: 0 for the first prompt - 1 places and the last."""
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.when((i < prompt) | (i == length), 0).otherwise(1))


def off_topic(counts: Column, interval: int) -> Column:
    """Counter after each of an array of turns (true: a preference was revealed): reset on reveal, else
    one more; due where it has reached ``interval``."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<n:int,due:boolean>>").alias("out")).cast("struct<n:int,out:array<struct<n:int,due:boolean>>>")

    def step(acc, revealed):
        n = F.when(revealed, 0).otherwise(acc["n"] + 1)
        return F.struct(n.alias("n"), F.concat(acc["out"], F.array(F.struct(n.alias("n"), (n >= interval).alias("due")))).alias("out")).cast("struct<n:int,out:array<struct<n:int,due:boolean>>>")

    return F.aggregate(counts, zero, step, lambda acc: acc["out"])


def training_message(call: Column, reasoning: Column, content: Column, *, fallback: str = "omit") -> Column:
    """An assistant turn as a text to train on: a think block where there is a thought, then the call.
    The thought is the reasoning, else a think block of the content, else (fallback 'content') all of it."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    thought = F.coalesce(filled(reasoning), filled(F.regexp_extract(content, r"(?s)<think>(.*?)</think>", 1)))
    if fallback == "content":
        thought = F.coalesce(thought, filled(content))
    block = F.concat(F.lit("<tool_call>\n"), call, F.lit("\n</tool_call>"))
    return F.when(thought.isNull(), block).otherwise(F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), block))


def passages(contents: Column) -> Column:
    """Retrieved texts as numbered passages; the first line of each is its title."""
    split = lambda x: F.split(F.coalesce(x, F.lit("")), "\n")
    body = lambda x: F.array_join(F.slice(split(x), 2, F.greatest(F.size(split(x)), F.lit(1))), "\n")
    texts = F.transform(contents, lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.element_at(split(x), 1), F.lit(")\n"), body(x), F.lit("\n\n")))
    return F.trim(F.regexp_replace(F.array_join(texts, ""), r"^\s+|\s+\z", ""))


#: The public tool and what it says; callers may have their own. What its parameters say, and
#: where the public part of a reply ends.
TOOL_NAME = "interact_with_env"
TOOL_SAYS = (
    "Public protocol: Search returns the complete candidate list; "
    "Action gathers natural-language evidence without filtering; Answer submits "
    "exactly one option ID visible in the current Search result."
)
CHOICE_SAYS = "Use search, action, or answer in the public protocol."
CONTENT_SAYS = "Search query, natural-language evidence question, or exactly one visible option ID."
CONTROL = "\n\nPublic control:"


def tool_schema(name: str = TOOL_NAME, says: str = TOOL_SAYS) -> list[dict]:
    """The one tool of the public protocol."""
    fields = {"choice": {"type": "string", "enum": ["search", "action", "answer"], "description": CHOICE_SAYS}, "content": {"type": "string", "description": CONTENT_SAYS}}
    parameters = {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    return [{"type": "function", "function": {"name": name, "description": says, "parameters": parameters}}]


def public_tools(schema: Column, tool_name: str = TOOL_NAME, says: str = TOOL_SAYS) -> Column:
    """Tool schemas (JSON of one function or a list) whose public tool says what the protocol says; what is
    no JSON, or no function, stays as it is. JSON of any shape has no column form, so this is an Arrow
    function."""

    def rewrite(text):
        try:
            parsed = json.loads(text)
        except (TypeError, ValueError):
            return text
        tools = parsed if isinstance(parsed, list) else [parsed]
        if not isinstance(parsed, dict | list):
            return text
        for tool in tools:
            if isinstance(tool, dict) and tool.get("name") == tool_name:
                tool["description"] = says
                fields = tool.setdefault("parameters", {}).setdefault("properties", {})
                for name, said in (("choice", CHOICE_SAYS), ("content", CONTENT_SAYS)):
                    if isinstance(fields.get(name), dict):
                        fields[name]["description"] = said
        return json.dumps(parsed, ensure_ascii=False)

    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(rewrite)

    return F.pandas_udf(whole, "string")(schema)


def public_reply(text: Column) -> Column:
    """A reply up to its control block, trimmed."""
    return F.trim(F.regexp_replace(F.substring_index(F.coalesce(text, F.lit("")), CONTROL, 1), r"^\s+|\s+\z", ""))


def trajectory_chars(messages: Column) -> Column:
    """Characters of all contents and reasonings of an array of messages (content, reasoning_content)."""
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    return F.aggregate(messages, F.lit(0), lambda a, m: a + size(m["content"]) + size(m["reasoning_content"]))


def metric_name(name: Column, *, validation: bool = False) -> Column:
    """A metric's name in its stable place: grpo/train/ or grpo/val/, without its old first part."""
    bare = name
    for old in ("training/", "val-core/", "val-aux/"):
        bare = F.regexp_replace(bare, rf"^(.*?){old}(.*)$", "$1$2")
    held = name.startswith("val") | name.startswith("smoke20/") | F.lit(validation)
    return F.when(name.startswith("grpo/"), name).otherwise(F.concat(F.when(held, "grpo/val/").otherwise("grpo/train/"), bare))
