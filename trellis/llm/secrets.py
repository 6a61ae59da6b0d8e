"""Secret scans with an incremental ledger of text blobs, in DataFrame functions only."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, Workspace, row_back, with_row


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is under ``least``
    characters drop. Any text with a match holds one of ``marks``, in any case if ``fold``, or, if there
    are none, a match of the cheaper pattern ``hint``."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    marks: tuple[str, ...] = ()
    hint: str = ""
    fold: bool = False


#: Base rules first; the rest are spans that the ledger adds. Java patterns; (?i:) is ASCII only.
BASE = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, ("passw", "secret", "token", "apikey", "api_key"), fold=True),
    # runs that are too short are no matches in the first place: a run's inside is no longer than the run
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, hint=r"[0-9a-f]{32}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("-----BEGIN ",)),
    # a header that nothing follows is a match too, whose group is empty: it drops, and is read once, not from every start
    Rule("jwt", 3, r"eyJ[A-Za-z0-9_-]++(\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?", 1, 10, ("eyJ",)),
    Rule("hub", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, tuple(f"gh{x}_" for x in "pousr")),
)
RULES = BASE + MORE


SPANS = "array<struct<start:int,end:int,kind:string>>"
#: Findings that may be broadcast to the texts; more go to parts of each content's rows by shuffle.
BROADCAST_SPANS, SALTS = 100_000, 16


def let(value: F.Column, f) -> F.Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def blocked(items: F.Column, f) -> F.Column:
    """``f`` of an array cut into blocks of about the square root of its size. A fold that appends to an
    array copies it each time; over blocks that costs n times the root of n, not n times n."""
    cut = lambda p, b: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(p) / b).cast("int"), F.lit(1)) - 1), lambda i: F.slice(p, i * b + 1, b))
    return let(items, lambda p: let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(p))).cast("int")), lambda b: let(cut(p, b), f)))


def prefixes(blocks: F.Column, size, join) -> F.Column:
    """What comes before each block: ``join`` over ``size`` of the blocks before it, from 0; and the whole
    at the end."""
    kind = "struct<at:int,all:array<int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all")).cast(kind)

    def step(acc, x):
        at = join(acc["at"], size(x))
        return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all")).cast(kind)

    return F.aggregate(blocks, zero, step)["all"]


def rule_spans(text: F.Column, rule: Rule) -> F.Column:
    """Array of (start, end, kind) in code points, end exclusive, of one rule in a text.

    The pieces between matches (split) and the matches themselves alternate, so their lengths give
    every position without a search for it.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("match"),
        F.transform(kept, F.length).alias("held"),
    )
    kind = f"struct<at:int,spans:{SPANS}>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")).cast(kind)

    def step(acc, x):
        start = acc["at"] + F.coalesce(x["gap"], F.lit(0))
        end = start + F.coalesce(x["match"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["held"] >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")).cast(kind)

    def shifted(block, by):
        return F.transform(block["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind")))

    def joined(folded):
        return let(prefixes(folded, lambda x: x["at"], lambda a, b: a + b), lambda before: F.flatten(F.transform(folded, lambda x, i: shifted(x, before[i]))))

    spans = blocked(parts, lambda bs: let(F.transform(bs, lambda x: F.aggregate(x, zero, step)), joined))
    return F.when(any_hint(text, (rule,)), spans).otherwise(F.array().cast(SPANS))


def any_hint(text: F.Column, rules) -> F.Column:
    """Whether a text may hold a finding of any rule: a search for literals, which is far cheaper than
    the patterns. A text is lower-cased once for all rules that fold."""
    found = F.lit(False)
    folded = [m for r in rules if r.fold for m in r.marks]
    if folded:
        found = found | F.exists(F.array(F.lower(text)), lambda t: reduce(operator.or_, [t.contains(m) for m in folded]))
    for m in [m for r in rules if not r.fold for m in r.marks]:
        found = found | text.contains(m)
    for r in rules:
        if not r.marks:
            found = found | text.rlike(r.hint)
    return F.coalesce(found, F.lit(False))


def blob_of(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, *, text_col: str = "text", rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Findings of the (blob, rule-version) pairs of ``versions`` that ``ledger`` lacks.

    Returns the ledger's new rows, one a pair: blob, rule, version, spans (array of start, end; may be
    empty, which is what marks the pair as seen). Every distinct content is scanned once, however
    many paths or versions hold it. Only texts that may hold a finding move, to meet the chosen row of
    their content; of others the content's address does.
    """
    spark: SparkSession = versions.sparkSession
    known = spark.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")
    text = F.col(f"`{text_col}`")
    rows = versions.select(blob_of(text).alias("blob"), F.when(any_hint(text, rules), text).otherwise("").alias("text"))
    if ledger is None:
        todo = rows.withColumn("need", F.lit(None).cast("array<string>"))
    else:
        blobs = rows.select("blob").distinct()
        pairs = blobs.join(F.broadcast(known)).join(ledger.select("blob", "rule", "version").distinct(), ["blob", "rule", "version"], "left_anti")
        need = pairs.groupBy("blob").agg(F.sort_array(F.collect_set("rule")).alias("need"))
        todo = rows.join(need, "blob")
    once = todo.dropDuplicates(["blob"])  # equal contents merge before they move
    arrays = [F.when(F.col("need").isNull() | F.array_contains("need", r.kind), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.transform(rule_spans(F.col("text"), r), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))) for r in rules]
    return once.select("blob", F.explode(F.filter(F.array(*arrays), lambda x: x.isNotNull())).alias("f")).select("blob", "f.rule", "f.version", "f.spans")


def findings_by_path(versions: DataFrame, ledger: DataFrame, *, keys: list[str], text_col: str = "text", rules=RULES) -> DataFrame:
    """Join the ledger's findings under the current rule versions back to every path of a blob.

    Returns ``keys`` and ``found``: an array of (start, end, ord, kind), by start, then rule order.
    Paths whose content has no finding get an empty array.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    live = F.lit(False)
    for r in rules:
        live = live | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("ord"), s["end"].alias("end"), F.col("rule").alias("kind")))
    by_blob = ledger.where(live & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), spans.alias("s")).groupBy("_blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("found"))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    paths = versions.select(*[F.col(f"`{k}`") for k in keys], blob_of(F.col(f"`{text_col}`")).alias("_blob"))
    return paths.join(by_blob, "_blob", "left").withColumn("found", F.coalesce("found", empty)).drop("_blob")


def span_text(found: F.Column) -> F.Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Secrets of every whole text: doc_id, n_<kind> of the base rules, base_sha256, spans, n_secrets.

    One row per input row, repeated rows included. Null and empty texts have no finding; null ids stay
    null; an empty table gives no rows. ``ledger`` holds earlier findings; without it all is unseen.
    """
    fresh = scan_unseen(docs, text_col=text_col, rules=rules, ledger=ledger)
    full = fresh if ledger is None else fresh.unionByName(ledger.select(*fresh.columns))
    out = findings_by_path(docs, full, keys=[id_col], text_col=text_col, rules=rules)
    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        F.col(id_col).alias("doc_id"),
        *[of(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_secrets"),
    )


def masked(text: F.Column, spans: F.Column, mark: str) -> F.Column:
    """``text`` with ``mark`` for every one of the sorted ``spans``; what overlaps is one. Blocks of spans
    cut their part of the text out first, so that pieces are looked up in a short one."""
    kind = "struct<at:int,out:array<string>>"

    def block(x, since, upto):
        part = F.substring(text, since + 1, F.greatest(upto - since, F.lit(0)))
        zero = F.struct(since.alias("at"), F.array().cast("array<string>").alias("out")).cast(kind)

        def pieces(chunk):
            def step(acc, s):
                piece = F.concat(F.substring(chunk, acc["at"] - since + 1, s["start"] - acc["at"]), F.lit(mark))
                out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out")).cast(kind)

            return F.array_join(F.aggregate(x, zero, step)["out"], "")

        return let(part, pieces)

    def joined(bs):
        ends = prefixes(bs, lambda x: F.array_max(F.transform(x, lambda s: s["end"])), F.greatest)
        return let(ends, lambda e: F.concat(F.array_join(F.transform(bs, lambda x, i: block(x, e[i], e[i + 1])), ""), F.substring(text, e[F.size(e) - 1] + 1, F.length(text))))

    return blocked(spans, joined)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES, ledger: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans merge. Texts
    without findings, null ones too, stay as they are; n_chars, where present, follows.

    ``ledger`` holds earlier findings; blobs and rule versions that it lacks are scanned and written to
    a ledger of this run. Texts get their spans by broadcast where there are few; else those that may
    hold a finding get them in parts of each content's rows, so that the copies of one text don't meet
    in one task, and the others go through.
    """
    work = Workspace(docs.sparkSession, "ledger")
    fresh = work.keep(scan_unseen(docs, text_col=text_col, rules=rules, ledger=ledger), "fresh")
    full = fresh if ledger is None else fresh.unionByName(ledger.select(*fresh.columns))
    live = F.lit(False)
    for r in rules:
        live = live | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
    spans = work.keep(full.where(live & (F.size("spans") > 0)).groupBy(F.col("blob").alias("_blob")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans")), "findings")
    few = (spans.agg(F.sum(F.size("_spans"))).first()[0] or 0) <= BROADCAST_SPANS
    held = with_row(docs).withColumn("_text", F.col(f"{ROW}.`{text_col}`"))
    some = held.withColumn("_blob", blob_of(F.col("_text")))
    if few:
        some = some.join(F.broadcast(spans), "_blob", "left")
    else:
        may = any_hint(F.col("_text"), rules)
        salt = F.pmod(F.xxhash64(F.col(f"{ROW}.`{id_col}`")), F.lit(SALTS)).cast("int")
        spread = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = some.where(may).withColumn("_salt", salt).join(spread, ["_blob", "_salt"], "left").drop("_salt")
        some = hit.unionByName(some.where(~may).withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType)))
    none = F.col("_spans").isNull()
    out = some.select(ROW, F.when(none, F.col("_text")).otherwise(masked(F.col("_text"), F.col("_spans"), mark)).alias("_clean"), none.alias("_same"))
    changed = {text_col: F.col("_clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_same"), F.col(f"{ROW}.n_chars")).otherwise(F.length("_clean"))
    return row_back(out, docs, **changed)
