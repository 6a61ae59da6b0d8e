"""Final answers as columns: their normal form, scores of whole solutions, and numeric agreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound
from .messages import tail_answer
from .text import boxed, latex_answer

#: What a final answer's texts turn into, in order.
SUBSTITUTIONS = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
#: What goes after that, in order.
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def final_answer(c: Column) -> Column:
    """The normal form of a final answer: what stands after the last =, without the words, units and
    LaTeX wrappers above, with braces for short fractions and roots and no commas in whole numbers."""
    c = F.element_at(F.split(c, "="), -1)
    for before, after in (*SUBSTITUTIONS, *((x, "") for x in REMOVED)):
        c = F.replace(c, F.lit(before), F.lit(after))
    c = F.regexp_replace(c, r"[^\n$]*\$([^\n]*?)\$[^\n]*", r"\$$1\$")
    for wrapper in ("text", "textbf", "overline"):
        c = F.regexp_replace(c, rf"\\{wrapper}\{{([^\n]*?)\}}", "$1")
    c = F.regexp_replace(c, r"\\boxed\{([^\n]*)\}", "$1")
    c = F.regexp_replace(c, r"frac([^{])([^\n])", r"frac{$1}{$2}")
    c = F.regexp_replace(c, r"sqrt([^{])", r"sqrt{$1}")
    c = F.replace(c, F.lit("$"), F.lit(""))
    bare = F.replace(c, F.lit(","), F.lit(""))
    return F.regexp_replace(F.when(bare.rlike(r"^[0-9]+\z"), bare).otherwise(c), r"^\s+|\s+\z", "")


def solution_score(solution: Column, truth: Column, *, strict: bool = False, truth_boxed: bool = False) -> Column:
    """(score, acc, pred): 1 or -1 for the last 'Answer: ...' in the last 300 characters ([INVALID]
    without one) against the truth, in normal form. Strict takes the box in the last 100 characters as
    it stands. Null solutions and truths are never right."""
    if strict:
        pred, want = boxed(F.right(solution, F.lit(100))), truth
    else:
        pred, want = final_answer(tail_answer(solution)), final_answer(boxed(truth) if truth_boxed else truth)
    acc = F.coalesce(pred == want, F.lit(False))
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def number(c: Column) -> Column:
    """The number that a text is, thousands commas and a percent sign allowed; null if it is none."""
    bare = F.replace(c, F.lit(","), F.lit(""))
    share = F.regexp_replace(bare, r"\\?%\s*\z", "")
    read = lambda x: F.when(x.rlike(_NUMBER), F.trim(x).try_cast("double"))
    return F.coalesce(read(bare), F.when(bare != share, read(share) / 100))


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def _same_part(given: Column, truth: Column, tolerance: float, percent: bool) -> Column:
    """Texts that are equal but for case or spaces; numbers that are close, as they are or by 100."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    text = (F.lower(F.trim(given)) == F.lower(F.trim(truth))) | (bare(given) == bare(truth))
    a, b = number(given), number(truth)
    near = close(a, b, tolerance)
    if percent:
        near = near | close(a, b / 100, tolerance) | close(a, b * 100, tolerance)
    return F.coalesce(text, F.lit(False)) | F.coalesce(near, F.lit(False))


def answers_agree(given: Column, truth: Column, *, tolerance: float = 1e-4, percent: bool = True) -> Column:
    """Whether an answer says what the truth says, by text, LaTeX form, number, or part by part for
    tuples, intervals and lists with equal brackets. Text isn't evaluated and no symbols are solved;
    nulls and empty answers agree with nothing."""
    inner = lambda x: F.regexp_replace(F.trim(x), r"^[(\[]|[)\]]\z", "")
    parts = lambda x: F.split(inner(x), ",")
    edge = lambda x: F.regexp_replace(F.trim(x), r"^([(\[]?).*?([)\]]?)\z", "$1$2")
    pairs = F.arrays_zip(parts(given).alias("a"), parts(truth).alias("b"))
    listed = given.contains(",") & truth.contains(",") & (edge(given) == edge(truth)) & (F.size(parts(given)) == F.size(parts(truth)))
    each = F.forall(pairs, lambda p: _same_part(p["a"], p["b"], tolerance, percent))
    whole = _same_part(given, truth, tolerance, percent) | (latex_answer(given) == latex_answer(truth))
    return F.coalesce((F.trim(given) != "") & (whole | (listed & each)), F.lit(False))


#: Units that a value may end in, and words that stand for powers of ten.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
POWERS = (("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
_WHOLE = r"^[+-]?([0-9]+(\.0*)?|\.0+)$"

#: What a plain value loses, in order: two texts without both of which a pattern can't match, the
#: pattern, and what comes in its place. A text is searched for by far faster than a pattern.
_PLAIN = (
    (r"\text{", r"\text{", r"^\\text\{(.+?)\}$", "$1"), ("%", "$", r"\\?[%$]", ""), (" or ", " and ", r" (or|and) ", " , "),
    *((w, w, w, by.replace("$", r"\$")) for w, by in POWERS),
    *((u, u, rf"{u}(es)?(s)? *(\^[0-9]+)?", "") for u in UNITS),
    (r"\circ", r"\circ", r"\^ *\\circ", ""), ("{", "{", r"^\{(.*)\}$", "$1"), (r",\!", r",\!", r",\\! *", ""), ("- ", "- ", r"- *", "-"), (" ", " ", r"([0-9]) +([0-9])", "$1+$2"),
)


def plain_value(c: Column) -> Column:
    """A value without what doesn't change it: a text wrapper, dollar and percent signs, units, degree
    signs, outer braces, thousands commas, case; 'or' and 'and' part a list, words are powers of ten, a
    mixed number is a sum, and whole numbers lose their zeros. Nulls stay null."""
    rules = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("a", "b", "pattern", "by"), r, strict=True)]) for r in _PLAIN])
    c = F.aggregate(rules, c, lambda x, r: F.when(x.contains(r["a"]) | x.contains(r["b"]), F.regexp_replace(x, r["pattern"], r["by"])).otherwise(x))

    def whole(x: Column) -> Column:
        bare = F.trim(x)
        bare = F.when(bare.contains(","), F.regexp_replace(bare, r"([0-9]),(?=[0-9]{3}([^0-9]|$))", "$1")).otherwise(bare)
        return bound(bare, lambda y: F.when(y.rlike(_WHOLE), F.round(y.try_cast("decimal(38,9)")).cast("decimal(38,0)").cast("string")).otherwise(x))

    return bound(F.lower(c), whole)


def marked_answer(text: Column, marks: tuple[str, ...] = ("Answer:", "answer is")) -> Column:
    """What stands after the last of ``marks`` up to the end of its line, if that holds a digit, without a
    full stop; null without one."""
    pattern = "(?:" + "|".join(marks) + r")\s*:?\s*([^\n]*[0-9][^\n]*)"
    got = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
    return F.regexp_replace(F.trim(got), r"\.$", "")


def matrix_parts(c: Column) -> Column:
    r"""Rows of the entries of a LaTeX matrix (pmatrix, bmatrix or matrix), trimmed; null if it is none."""
    body = F.nullif(F.regexp_extract(c, r"(?s)\\begin\{[pb]?matrix\}(.*)\\end\{[pb]?matrix\}", 1), F.lit(""))
    return F.transform(F.split(body, r"\\\\"), lambda row: F.transform(F.split(row, "&"), F.trim))


def graded(given: Column, truth: Column, *, tolerance: float = 1e-4) -> Column:
    """Whether an answer is right: as ``answers_agree`` says, by plain values, by the entries of a matrix,
    or part by part for tuples of plain values, where a fraction must be the same text and a whole
    number needs a whole one. No text is evaluated."""
    a, b = plain_value(given), plain_value(truth)
    rows = F.arrays_zip(F.flatten(matrix_parts(given)).alias("a"), F.flatten(matrix_parts(truth)).alias("b"))
    shape = F.transform(matrix_parts(given), F.size) == F.transform(matrix_parts(truth), F.size)
    matrix = shape & F.forall(rows, lambda x: _same_part(x["a"], x["b"], tolerance, False))
    inner = lambda x: F.transform(F.split(F.regexp_replace(x, r"^[(\[]|[)\]]$", ""), ","), F.trim)
    tuples = a.rlike(r"^[(\[][^()\[\]]*[)\]]$") & b.rlike(r"^[(\[][^()\[\]]*[)\]]$") & (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (F.right(a, F.lit(1)) == F.right(b, F.lit(1))) & (F.size(inner(a)) == F.size(inner(b)))
    exact = lambda x: x.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$") | x.rlike(_WHOLE)
    each = F.forall(F.arrays_zip(inner(a).alias("a"), inner(b).alias("b")), lambda x: F.when(exact(x["b"]), x["a"] == x["b"]).otherwise(_same_part(x["a"], x["b"], tolerance, False)))
    no, bare = (lambda x: F.coalesce(x, F.lit(False))), (lambda x: F.replace(x, F.lit(" "), F.lit("")))
    return no(F.trim(given) != "") & (no(answers_agree(given, truth, tolerance=tolerance)) | no((bare(a) == bare(b)) & (a != "")) | no(matrix) | no(tuples & each))
