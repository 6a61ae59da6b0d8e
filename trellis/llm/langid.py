"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, trimmed

#: Bytes of context at most.
ORDER = 3
#: Labelled texts of each language that the statistics are taken from, in expectation.
SAMPLE_TEXTS = 1500
#: Languages that share a table. A table has a cost for each of them after each gram that one of them has,
#: so all tables hold at most this many times as many costs as the languages have grams.
TOGETHER = 8
HELD_OUT, FOLDS = 1, 3


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _grams(data: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """Every n bytes in a row of one text, as one number, first byte highest; texts begin after zeros."""
    sizes = np.diff(offs)
    at = offs[:-1] + n * np.arange(1, len(offs))
    out = np.zeros(len(data) + n * len(sizes), np.uint64)
    put = np.repeat(at - offs[:-1], sizes) + np.arange(len(data))
    out[put] = data
    code = out.copy()
    for k in range(1, n):
        code[k:] |= out[:-k] << np.uint64(8 * k)
    return code[put]


def count_grams(batches):
    """(lang, gram of ORDER + 1 bytes, count) of a partition's texts."""
    total: dict[str, list] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for i, j, data, offs in text_slices(batch.column(0)):
            if not len(data):
                continue
            code, row = _grams(data, offs, ORDER + 1), np.repeat(np.arange(j - i), np.diff(offs))
            for lang in set(langs[i:j]):
                g, c = np.unique(code[(langs[i:j] == lang)[row]], return_counts=True)
                total.setdefault(lang, []).append((g, c))
    for lang, parts in total.items():
        g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(at, np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])


class Table:
    """Frozen counts of a few languages as sorted arrays, order by order.

    A byte after a context that a language has seen costs -log2 n / (total + kinds) where it followed
    that context, else the escape -log2 kinds / (total + kinds) and then what it costs after the
    context less its oldest byte; below the empty context all 256 bytes cost the same. These are
    the exact code lengths of PPM with escape method C, without exclusion.
    """

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.width, self.levels = len(langs), []
        for n in range(1, ORDER + 2):
            per = []
            for lang in langs:
                g, c = counts[lang]
                u, at = np.unique(g & np.uint64((1 << 8 * n) - 1), return_inverse=True)
                per.append((u, np.bincount(at, c, minlength=len(u))))
            grams = np.unique(np.concatenate([p[0] for p in per]))
            ctx = np.unique(grams >> np.uint64(8))
            cost = np.full((len(grams), len(langs)), np.nan)
            escape = np.zeros((len(ctx) + 1, len(langs)), np.float32)  # the last row: a context that none has seen
            for k, (u, c) in enumerate(per):
                own = np.searchsorted(ctx, u >> np.uint64(8))
                total = np.bincount(own, c, minlength=len(ctx))
                kinds = np.bincount(own, minlength=len(ctx)).astype(float)
                seen = kinds > 0
                escape[:-1][seen, k] = -np.log2(kinds[seen] / (total + kinds)[seen])
                cost[np.searchsorted(grams, u), k] = -np.log2(c / (total + kinds)[own])
            low = self._cost(grams, n - 2)
            cost = np.where(np.isnan(cost), low + escape[np.searchsorted(ctx, grams >> np.uint64(8))], cost)
            self.levels.append((grams, ctx, cost.astype(np.float32), escape))

    def _cost(self, code: np.ndarray, level: int) -> np.ndarray:
        if level < 0:
            return np.full((len(code), self.width), 8.0, np.float32)
        grams, ctx, cost, escape = self.levels[level]
        code = code & np.uint64((1 << 8 * (level + 1)) - 1)
        at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
        out = cost[at]
        miss = np.flatnonzero(grams[at] != code)
        if len(miss):
            before = code[miss] >> np.uint64(8)
            of = np.minimum(np.searchsorted(ctx, before), len(ctx) - 1)
            out[miss] = self._cost(code[miss], level - 1) + escape[np.where(ctx[of] == before, of, len(ctx))]
        return out

    def bits(self, data: np.ndarray, offs: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        cost = np.take(self._cost(grams, ORDER), at, axis=0)
        sums = np.add.reduceat(np.vstack([cost, np.zeros((1, self.width), cost.dtype)]), np.minimum(offs[:-1], len(data)), axis=0, dtype=np.float64)
        sums[np.diff(offs) == 0] = 0
        return sums


class Model:
    """Frozen counts of all languages, TOGETHER to a table."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], together: int = TOGETHER):
        self.langs = langs
        self.tables = [Table(langs[i : i + together], counts) for i in range(0, len(langs), together)]

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of every text in every language."""
        if not len(data):
            return np.zeros((len(offs) - 1, len(self.langs)))
        # each distinct gram is looked up once
        grams, at = np.unique(_grams(data, offs, ORDER + 1), return_inverse=True)
        return np.hstack([t.bits(data, offs, grams, at) for t in self.tables])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Model | None:
    """Statistics of labelled texts outside the held-out third; None if there are none.

    Of each language about ``sample_texts`` whole texts count, chosen by a hash of id and text, all if
    there are no more. Every label value is a language, and every gram of those texts counts. Grams are
    counted on the executors; the driver gets one row for each language and gram.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("lang")).where("lang is not null and text is not null and text <> ''").where(~held_out("doc_id"))
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > sample_texts).collect()}
    share = F.lit(1.0)
    if sizes:
        share = F.coalesce(F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(sample_texts / n))])[F.col("lang")], share)
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = own.where(draw < share).select("text", "lang")
    table = sample.mapInArrow(trimmed(count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not table.num_rows:
        return None
    held = table.column("lang").combine_chunks().dictionary_encode()
    which = held.indices.to_numpy()
    order = np.argsort(which, kind="stable")
    g, c = table.column("gram").to_numpy().astype(np.uint64)[order], table.column("n").to_numpy()[order]
    ends = np.cumsum(np.bincount(which))
    counts = {x: (g[i:j], c[i:j]) for x, i, j in zip(held.dictionary.to_pylist(), [0, *ends[:-1]], ends, strict=True)}
    return Model(sorted(counts), counts)


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and the code length of the text in the predicted language.

    One row per input row. ``und`` with score 0 where the text is null or has no letter, or no
    language was learned; score is the posterior of the language under equal priors, at the mean
    code length a byte raised to 32 bytes (a longer text is no surer). Ties go to the first language
    by code point.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    spec = "doc_id long, held_out boolean, lang_pred string, score double, code_bits double"

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score, bits = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if m is not None:
                for i, j, data, offs in text_slices(batch.column(1), 1 << 20):
                    cost = m.bits(data, offs)
                    best = cost.argmin(axis=1)
                    per = (cost - cost.min(axis=1, keepdims=True)) / np.maximum(np.diff(offs), 1)[:, None] * np.minimum(np.maximum(np.diff(offs), 1), 32)[:, None]
                    prob = np.exp2(-per)
                    prob /= prob.sum(axis=1, keepdims=True)
                    rows = np.arange(j - i)
                    pred[i:j], score[i:j], bits[i:j] = np.array(m.langs, object)[best], prob[rows, best], cost[rows, best]
            pred[~letters], score[~letters], bits[~letters] = "und", 0.0, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(pred, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "held_out", "lang_pred", "score", "code_bits"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(trimmed(run), spec)
