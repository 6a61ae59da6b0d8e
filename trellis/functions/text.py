"""Text functions as column expressions: normalising, redacting, extracting, scoring."""

from __future__ import annotations

import json
import re
import sys
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound
from .jsons import canonical_hash

#: Lines that tell a reward, lines that tell a private label, blocks and fields of reasoning, and
#: numbers of preferences, as patterns that Java and Python read alike but for flags.
REWARD_LINE = r"^\s*(?:reward|step[_ ]?reward|terminal[_ ]?reward)\s*[:=].*$"
PRIVATE_LINE = r"^\s*(?:preference[_ ]?ids?|correct[_ ]?ids?|best[_ ]?ids?|ground[_ ]?truth|reward[_ ]?report|diagnostics?)\s*[:=].*$"
REASONING_BLOCK = r"<(?:think|analysis|reasoning)>.*?</(?:think|analysis|reasoning)>"
REASONING_FIELD = r"(?:reasoning_content|chain_of_thought|scratchpad)\s*[:=]\s*.*?(?=\n\s*[A-Za-z_][\w -]*\s*[:=]|$)"
PREFERENCE, PREFERENCE_ALONE = r"\bP\d+\b", r"(?<![A-Za-z0-9])P\d+(?![A-Za-z0-9])"
#: Keys that public records don't have, keys that tracking doesn't have, and parts of such keys.
PRIVATE_KEYS = ("preference_id", "preference_ids", "correct_id", "correct_ids", "best_id", "best_ids", "reward", "step_reward", "terminal_reward", "reward_report", "ground_truth")
UNTRACKED_KEYS = (
    "api_key", "apikey", "authorization", "token", "preference_id", "preference_ids", "correct_id", "correct_ids", "best_id", "best_ids", "hidden_ids", "hidden_labels",
    "reward_ledger", "raw_reward", "reasoning_content", "cot", "messages", "transcript",
)
UNTRACKED_PARTS = ("api_key", "preference_id", "correct_id", "best_id", "reward_ledger", "reasoning_content")


def normalise(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


#: What white space is to Python, within Latin-1 and beyond it, and ranges of all characters that ``_folds`` names:
#: a class of few ranges is tested for first, since every range costs time at every character.
_WHITE, _WIDE = r"\t-\r\x1c-\x20\x85\xa0", r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE = r"[\xb5\u0130-\u03ff\u0530-\u058f\u13a0-\u1fff\uab70-\uabbf\ufb00-\ufb17]"


@cache
def _folds() -> dict[str, str]:
    """Characters that stay as they are in lower case but not when case is folded; ß, the frequent one, apart."""
    return {x: f for i in range(sys.maxunicode + 1) for x in chr(i).lower() if (f := x.casefold()) != x and x != "ß"}


def folded(c: Column) -> Column:
    """Case folded as Python folds it: ß is ss, final sigma is sigma. Lower case, then what that leaves."""
    one = {x: f for x, f in _folds().items() if len(f) == 1}
    many = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(f).alias("b")) for x, f in _folds().items() if len(f) > 1])

    def rest(x: Column) -> Column:
        single = F.translate(x, "".join(one), "".join(one.values()))
        return F.when(x.rlike(_RARE), F.aggregate(many, single, lambda acc, r: F.replace(acc, r["a"], r["b"]))).otherwise(x)

    return bound(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), rest)


def normalise_folded(c: Column) -> Column:
    """Case folded as Python folds it (ß is ss), runs of Unicode white space as one space, trimmed; null
    counts as empty. No Python."""
    white = lambda x: F.when(x.rlike(r"[\u1680-\u3000]"), F.regexp_replace(x, f"[{_WHITE}{_WIDE}]+", " ")).otherwise(F.regexp_replace(x, f"[{_WHITE}]+", " "))
    return F.coalesce(F.trim(bound(folded(c), white)), F.lit(""))


def _without(c: Column, *rules: tuple[str, str, str]) -> Column:
    for flags, pattern, by in rules:
        c = F.regexp_replace(c, f"(?dU{flags})" + pattern, by)
    return c


def redact_public(c: Column) -> Column:
    """A public text: lines that tell a reward or a private label are blanked, numbered preferences are "that
    preference", white space at both ends goes. Null stays null."""
    return _without(c, ("im", REWARD_LINE, ""), ("im", PRIVATE_LINE, ""), ("i", PREFERENCE, "that preference"), ("", r"^\s+|\s+\z", ""))


def redact_tracking(c: Column) -> Column:
    """A text that may be logged: reasoning, private lines and numbered preferences are marked as redacted; a
    text that still looks like it holds a credential goes whole. Null stays null."""
    marked = "[REASONING_REDACTED]"
    kept = _without(c, ("is", REASONING_BLOCK, marked), ("is", REASONING_FIELD, marked), ("im", PRIVATE_LINE, "[PRIVATE_REDACTED]"), ("i", PREFERENCE_ALONE, "[PRIVATE_ID]"))
    return F.when(kept.contains("sk-") | F.lower(kept).contains("api_key"), F.lit("[REDACTED]")).otherwise(kept)


def _redacted(value, text, drops):
    if isinstance(value, str):
        return text(value)
    if isinstance(value, list):
        return [_redacted(x, text, drops) for x in value]
    return {k: _redacted(v, text, drops) for k, v in value.items() if not drops(k.casefold())} if isinstance(value, dict) else value


def _json_redactor(text, drops):
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(_redacted(json.loads(t), text, drops), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return F.pandas_udf(run, "string")


def redact_public_json(c: Column) -> Column:
    """A JSON text with private keys gone at any depth, whatever their case, and every text value redacted as
    ``redact_public`` does; null for what is no JSON. JSON of any shape has no column form."""
    rules = [(re.compile(REWARD_LINE, re.I | re.M), ""), (re.compile(PRIVATE_LINE, re.I | re.M), ""), (re.compile(PREFERENCE, re.I), "that preference")]

    def text(t):
        for pattern, by in rules:
            t = pattern.sub(by, t)
        return t.strip()

    return _json_redactor(text, lambda k: k in PRIVATE_KEYS)(c)


def redact_tracking_json(c: Column) -> Column:
    """A JSON text that may be logged: untracked keys and keys with an untracked part are gone at any depth,
    every text value is redacted as ``redact_tracking`` does; null for what is no JSON."""
    marked = "[REASONING_REDACTED]"
    rules = [(re.compile(REASONING_BLOCK, re.I | re.S), marked), (re.compile(REASONING_FIELD, re.I | re.S), marked), (re.compile(PRIVATE_LINE, re.I | re.M), "[PRIVATE_REDACTED]"), (re.compile(PREFERENCE_ALONE, re.I), "[PRIVATE_ID]")]

    def text(t):
        for pattern, by in rules:
            t = pattern.sub(by, t)
        return "[REDACTED]" if "sk-" in t or "api_key" in t.casefold() else t

    return _json_redactor(text, lambda k: k in UNTRACKED_KEYS or any(p in k for p in UNTRACKED_PARTS))(c)


def option_ids(c: Column) -> Column:
    """Option numbers such as F12, upper-cased, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?<![A-Za-z0-9])([ACFHR]\d+)(?![A-Za-z0-9])"), F.lit(1)), F.upper)


def between(c: Column, tag: str) -> Column:
    """What the first <tag>...</tag> holds; null without one."""
    return F.nullif(F.regexp_extract(c, rf"(?is)<{tag}>(.*?)</{tag}>", 1), F.lit(""))


def qa_normalise(c: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, single spaces."""
    plain = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: qa_normalise(g) == qa_normalise(prediction))


def sub_match(prediction: Column, golds: Column) -> Column:
    """One of the answers stands somewhere in the prediction."""
    return F.exists(golds, lambda g: qa_normalise(prediction).contains(qa_normalise(g)))


def last_answer(c: Column) -> Column:
    """What the last <answer> tag holds; null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1))


def number_answer(c: Column, *, strict: bool = True) -> Column:
    """The number after the first ####, or (not strict) the last number in the text; commas and dollar
    signs go."""
    if strict:
        got = F.nullif(F.regexp_extract(c, r"#### (-?[0-9.,]+)", 1), F.lit(""))
    else:
        got = F.try_element_at(F.filter(F.regexp_extract_all(c, F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", ".", ",")), F.lit(-1))
    return F.regexp_replace(got, r"[,$]", "")


def closing_brace(c: Column) -> Column:
    """The place, from 1, of the brace that closes the first character's; null if that is no brace or none does.
    One fold over a text of braces and dots, whose state is a depth and a place, so that any depth is
    matched and a long text takes time in proportion."""
    plain = F.split(F.regexp_replace(c, r"(?s)[^{}]", "."), "")
    state = "struct<depth:int,at:int,end:int>"

    def step(acc, x):
        depth, at = acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0), acc["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.coalesce(acc["end"], F.when(depth == 0, at)).alias("end")).cast(state)

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end")).cast(state)
    return F.when(c.startswith("{"), F.aggregate(plain, start, step)["end"])


def boxed(c: Column) -> Column:
    r"""The answer of a text: what follows the last "\boxed " up to a dollar sign, where that form occurs; else what
    the braces of the last \boxed{...} hold, at any depth. Null without one, or where its braces stay open."""
    spaced = F.substring_index(F.substring_index(c, "\\boxed ", -1), "$", 1)
    tail = F.substring_index(c, "\\boxed", -1)
    end = closing_brace(tail)
    return F.when(c.contains("\\boxed "), spaced).when(c.contains("\\boxed") & end.isNotNull(), F.substring(tail, F.lit(2), end - 2))


def math_normalise(c: Column) -> Column:
    """A light normal form of a LaTeX answer: no spaces, text wrappers, units' backslashes, degree and
    percent signs, dfrac as frac."""
    for pattern, by in ((r"\\(left|right|!|,|;|:)", ""), (r"\\(dfrac|tfrac)", r"\\frac"), (r"\\text\{[^{}]*\}", ""), (r"(\\%|%|\^\{?\\circ\}?|\\\$|\$)", ""), (r"^[a-zA-Z]{1,2}=", ""), (r"\s+", ""), (r"\.$", "")):
        c = F.regexp_replace(c, pattern, by)
    return c


def collapsed(c: Column) -> Column:
    """64 characters that aren't white space or more, but two different ones at most."""
    solid = F.regexp_replace(c, r"\s+", "")
    return (F.length(solid) >= 64) & (F.size(F.array_distinct(F.split(solid, ""))) <= 2)


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 up to ``most - buffer``, then falling by ``factor`` a buffer."""
    return F.least(-(length - (most - buffer)) / float(buffer) * factor, F.lit(0.0))


def endpoint(url: Column) -> Column:
    """Scheme, host and path of an address: no credentials, query or fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-z]+://)[^/@]*@", "$1")


def task_key(*parts: Column) -> Column:
    return F.concat_ws("::", *[p.cast("string") for p in parts])


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1", "yes", "y")


def finite_or(c: Column, default: float) -> Column:
    """The number a text or number holds; ``default`` if it holds none or isn't finite."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def content_hash(*cols: str) -> Column:
    """sha256 of the columns as one JSON object in its canonical form: keys sorted, texts quoted and escaped, nulls
    written, so that different rows give different texts. Nested columns count at every depth."""
    return canonical_hash(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(cols)]), {"ignoreNullFields": "false"}))


#: What the normal form of a LaTeX answer rewrites, in order (Java patterns).
LATEX_REWRITES = (
    (r"\n|\\!", ""),
    (r"\\\\", r"\\"),
    (r"\\[td]frac", r"\\frac"),
    (r"\\left|\\right", ""),
    (r"\^\{\\circ\}|\^\\circ", ""),
    (r"\\\$", ""),
    (r"\\text\{ .*$", ""),
    (r"\\?%", ""),
    (r"(^|[ {])\.", "$10."),
    (r"^[^=]{0,2}=([^=]*)$", "$1"),
    (r"\\sqrt([^{])", r"\\sqrt{$1}"),
    (r" ", ""),
    (r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"),
    (r"\\frac([^{])\{", r"\\frac{$1}{"),
    (r"^0\.5$", r"\\frac{1}{2}"),
    (r"^(-?[1-9][0-9]*|0)/(-?[1-9][0-9]*|0)$", r"\\frac{$1}{$2}"),
)


def latex_answer(c: Column) -> Column:
    """The normal form of a LaTeX answer: white space, units, degrees, percents and size commands go,
    fractions and roots get their braces, a name of one or two characters before = goes."""
    for pattern, by in LATEX_REWRITES:
        c = F.regexp_replace(c, pattern, by)
    return c


def same_answer(a: Column, b: Column) -> Column:
    """Whether two LaTeX answers have one normal form; null answers equal each other only."""
    return latex_answer(a).eqNullSafe(latex_answer(b))


def belongs(row: Column, marks: list[str], *known: Column) -> Column:
    """Whether a row is of a domain: any of the ``known`` conditions holds, or the JSON of the whole
    row has one of ``marks`` anywhere. Nulls don't count."""
    said = F.to_json(row)
    hit = F.lit(False)
    for x in (*known, *[said.contains(m) for m in marks]):
        hit = hit | F.coalesce(x, F.lit(False))
    return hit
