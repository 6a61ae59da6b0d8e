"""JSON texts of any shape: keys at any depth, guards, a canonical form and its hash, flat keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bound

#: A whole string of JSON and the colon after it, if it is a key. Strings are read from the left one after
#: another, so that what looks like a key inside a text isn't one.
_STRING = r'"(?:[^"\\]++|\\.)*+":?'
#: What stands between the brackets of objects and lists: whole strings and all else.
_NO_BRACKET = r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++|"'
#: What must not stand in a public text (Java patterns).
SIDE_CHANNELS = {
    "reward": r"(?iU)\b(?:terminal[_ ]?reward|reward)\s*[:=]",
    "preference": r"(?iU)(?<![A-Za-z0-9])P\d+(?![A-Za-z0-9])",
    "private_line": r"(?imU)^\s*(?:preference[_ ]?ids?|correct[_ ]?ids?|best[_ ]?ids?|ground[_ ]?truth|reward[_ ]?report|diagnostics?)\s*[:=]",
}


def parsed(document: Column) -> Column:
    """A JSON text as a VARIANT; null for what isn't one JSON value and nothing else. Spark's parser stops at the
    end of the first value, so the text is put into a list whose second item, the text's own hash, must
    still be read."""
    end = F.md5(document)
    held = F.try_parse_json(F.concat(F.lit("["), document, F.lit(',"'), end, F.lit('"]')))
    return bound(held, lambda h: F.when(F.try_variant_get(h, "$[1]", "string") == end, F.try_variant_get(h, "$[0]", "variant")))


def keys_anywhere(document: Column) -> Column:
    """The distinct keys at any depth of a JSON text, as the text means them (escapes read); null for what is no
    JSON. No Python: the text is parsed and written anew, which leaves one form, and its strings are read."""
    return _keys_of(F.to_json(parsed(document)))


def _keys_of(plain: Column) -> Column:
    """The keys of a JSON text that ``to_json`` wrote; only those with an escape are parsed."""
    strings = F.regexp_extract_all(plain, F.lit(_STRING), F.lit(0))
    read = lambda s: F.from_json(F.concat(F.lit('{"k":'), F.substring(s, F.lit(1), F.length(s) - 1), F.lit("}")), "k string")["k"]
    keys = F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.when(s.contains("\\"), read(s)).otherwise(F.substring(s, F.lit(2), F.length(s) - 3)))
    return F.array_distinct(keys)


def forbidden_keys(document: Column, names: list[str]) -> Column:
    """Keys at any depth of a JSON text that are in ``names`` but for case, sorted; null for what is no JSON."""
    return _forbidden(keys_anywhere(document), names)


def _forbidden(keys: Column, names: list[str]) -> Column:
    low = F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>")
    return F.array_sort(F.filter(keys, lambda k: F.array_contains(low, F.lower(k))))


def observation_faults(document: Column, required: list[str], forbidden: list[str]) -> Column:
    """What keeps a JSON text from being shown, in order: not_an_object, missing:<key>, forbidden:<key>, and the
    names of side channels in its compact form; empty if nothing does."""
    need = F.array(*[F.lit(k) for k in sorted(required)]).cast("array<string>")

    def faults(plain: Column) -> Column:
        missing = F.transform(F.array_except(need, F.json_object_keys(plain)), lambda k: F.concat(F.lit("missing:"), k))
        bad = F.transform(_forbidden(_keys_of(plain), forbidden), lambda k: F.concat(F.lit("forbidden:"), k))
        said = F.array_compact(F.array(*[F.when(plain.rlike(p), name) for name, p in SIDE_CHANNELS.items()]))
        return F.when(F.coalesce(plain.startswith("{"), F.lit(False)), F.concat(missing, bad, said)).otherwise(F.array(F.lit("not_an_object")))

    return bound(F.to_json(parsed(document)), faults)


# ---------------------------------------------------------------- one form


def by_text(one: Callable[[str | None], str | None]) -> Callable[[Column], Column]:
    """A column function of one text, given one after another off the Arrow batch: beside the batch and what
    comes out, one text is held."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array((one(t.as_py()) for t in texts), pa.string(), size=len(texts))

    return F.arrow_udf(run, "string")


def _canonical(text: str | None) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError):
        return None


def canonical_json(document: Column) -> Column:
    """A JSON text with keys sorted at every depth, no spaces, and numbers and escapes in one form, as Python's
    json writes them; null for what is no JSON. Of keys that stand twice, the last counts. Number forms
    have no column function, so this is an Arrow function."""

    return by_text(_canonical)(document)


def canonical_hash(document: Column) -> Column:
    """sha256 of the canonical form, made where the form is, so that no second batch of texts is held."""

    def one(text):
        form = _canonical(text)
        return None if form is None else hashlib.sha256(form.encode()).hexdigest()

    return by_text(one)(document)


def record_hash(document: Column, *, schema: str) -> Column:
    """sha256 of the public content of a record's JSON: schema_version, messages without keys that begin with _,
    tools and enable_thinking, with defaults where they are missing; masks and metadata don't count. Null
    for what is no JSON object."""

    def one(text):
        try:
            record = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(record, dict):
            return None
        plain = lambda m: {k: v for k, v in m.items() if not k.startswith("_")} if isinstance(m, dict) else m
        public = {"schema_version": record.get("schema_version", schema), "messages": [plain(m) for m in record.get("messages", [])], "tools": record.get("tools", []), "enable_thinking": bool(record.get("enable_thinking", True))}
        return hashlib.sha256(json.dumps(public, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return by_text(one)(document)


# ---------------------------------------------------------------- flat keys


def nesting(document: Column) -> Column:
    """How many objects and lists of a JSON text lie in one another at most: brackets outside of strings, counted
    without a parse. For what is no JSON it is just the brackets' count, null for null."""
    brackets = F.split(F.regexp_replace(document, _NO_BRACKET, ""), "")
    count = lambda now, most: F.struct(now.alias("now"), F.greatest(most, now).alias("most"))
    step = lambda held, c: count(F.when(c.isin("{", "["), held["now"] + 1).when(c.isin("}", "]"), held["now"] - 1).otherwise(held["now"]), held["most"])
    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda held: held["most"])


def flattened(df: DataFrame, ids: list[str], document: str, *, sep: str = "/", deepest: int = 64) -> DataFrame:
    """One row for each value of a JSON text that isn't an object or list itself: the ids, key (its path), value (as
    JSON) and number (null if it is none).

    Lists give their length under list_len and their items under their places from 0. Empty objects give
    nothing; a text that is a single value or no JSON gives nothing. One job counts how deep the texts nest,
    and more than ``deepest`` levels are an error. The rows are then made in one pass, without shuffle or
    cache: each text is parsed once, as a VARIANT, and a level is one explode, which lets pass what is
    no object or list. A list's length goes with its first item and gets its row at the end.
    """
    spark, text = df.sparkSession, F.col(f"`{document}`")
    depth = df.agg(F.max(nesting(text))).first()[0] or 0
    if depth > deepest:
        depth = df.agg(F.max(F.when(parsed(text).isNotNull(), nesting(text)))).first()[0] or 0
        if depth > deepest:
            raise ValueError(f"documents nest deeper than {deepest} levels")
    kept = [F.col(f"`{c}`").alias(f"_id{i}") for i, c in enumerate(ids)]
    held = [f"_id{i}" for i in range(len(ids))]
    entries = "array<struct<key:string,value:string>>"
    none = F.array().cast(entries)
    one = lambda key, value: F.array(F.struct(key.alias("key"), value.alias("value")))
    place, length = F.col("pos"), F.size(F.try_variant_get("_v", "$", "array<variant>")).cast("string")
    # _p is a value's path with a separator after each step, _n the lengths of the lists it comes first in.
    level = df.select(*kept, F.lit("").alias("_p"), none.alias("_n"), parsed(text).alias("_v"))
    for i in range(max(depth, 1)):
        level = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer())).select(
            *held,
            F.when(place.isNull(), F.col("_p")).otherwise(F.concat("_p", F.coalesce("key", place.cast("string")), F.lit(sep))).alias("_p"),
            F.when(place.isNull(), F.col("_n")).when(place > 0, none).when(F.col("key").isNotNull(), F.col("_n")).otherwise(F.concat("_n", one(F.concat("_p", F.lit("list_len")), length))).alias("_n"),
            F.when(place.isNotNull(), F.col("value")).when(F.lit(i > 0) | (F.to_json("_v") == "[]"), F.col("_v")).alias("_v"),
        )
    value = F.col("_x")
    own = (
        F.when(value.isNull() | (value == "{}"), none).when(value == "[]", one(F.concat("_p", F.lit("list_len")), F.lit("0")))
        .when(value.startswith("{") | value.startswith("["), F.raise_error(F.lit("documents nest deeper than they did when they were counted")).cast(entries))
        .otherwise(one(F.substring("_p", F.lit(1), F.length("_p") - len(sep)), value))
    )
    rows = level.select(*held, "_p", "_n", F.to_json("_v").alias("_x")).select(*held, F.explode_outer(F.concat("_n", own)).alias("_e")).where(F.col("_e").isNotNull())
    back = [F.col(h).alias(c) for h, c in zip(held, ids, strict=True)]
    out = rows.select(*back, F.col("_e.key").alias("key"), F.col("_e.value").alias("value"))
    # Words aren't cast, as each failed cast costs an exception.
    return out.withColumn("number", F.when(~F.col("value").startswith('"') & ~F.col("value").isin("null", "true", "false"), F.col("value").try_cast("double")))
