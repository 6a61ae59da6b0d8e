"""Quality classification by importance resampling: hashed n-gram models of target and raw text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, _STEP2, Workspace, mix64, row_back, run_hashes, text_slices, trimmed, with_row

BUCKETS = 1 << 16
#: Labelled rows that the target model and the share to keep are fitted on, in expectation.
SAMPLE_ROWS = 20_000
#: What wrongly rejecting a good labelled text weighs against wrongly keeping a bad one.
CARE = 20.0
#: Sampling steps between the cut and the median of good labelled texts: a step is what makes a text e
#: times as likely to be drawn. More steps come nearer to a plain cut, fewer to a uniform draw.
STEPS = 6.0
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_CLASS = np.where(_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.uint8)
#: Stands for every bigram of one token twice, so that repetition is one feature and not as many as words.
_TWICE = 77


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of all tokens (runs of word characters or of punctuation,
    A-Z in lower case), and the row of each."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offs[:-1][offs[:-1] < n]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], n) - 1
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = run_hashes(_LOWER[data], start, end)
    row = np.searchsorted(offs, start, "right") - 1
    with np.errstate(over="ignore"):
        pair = mix64(hashes[:-1] * _STEP2 + hashes[1:])
    pair[hashes[:-1] == hashes[1:]] = _TWICE
    same = row[:-1] == row[1:]
    codes = np.concatenate([hashes, pair[same]]) & np.uint64(BUCKETS - 1)
    return codes.astype(np.int64), np.concatenate([row, row[1:][same]])


def _count(batches):
    """Counts of a partition by bucket: of all texts, and of those of the target."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, offs in text_slices(batch.column(0)):
            code, row = features(data, offs)
            total[0] += np.bincount(code, minlength=BUCKETS)
            total[1] += np.bincount(code[target[i:j][row]], minlength=BUCKETS)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "raw", "target"])


class Ratio:
    """log p_target - log p_raw of every bucket, as the mean over a text's features: the sum grows with
    the text, so that length would decide. A text's own counts are left out of the models that
    score it, so texts of the target have no advantage over unseen ones. Unseen buckets are neutral."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target = raw, target
        self.share = max(float(target.sum()), 1.0) / max(float(raw.sum()), 1.0)

    def scores(self, col: pa.Array, in_target: np.ndarray) -> np.ndarray:
        out = np.zeros(len(col))
        for i, j, data, offs in text_slices(col):
            code, row = features(data, offs)
            key, n = np.unique(row * BUCKETS + code, return_counts=True)
            code, row = key % BUCKETS, key // BUCKETS
            raw = self.raw[code] - n + 1.0
            target = self.target[code] - n * in_target[i:j][row] + self.share
            out[i:j] = np.bincount(row, n * (np.log(target / self.share) - np.log(raw)), minlength=j - i) / np.maximum(np.bincount(row, n, minlength=j - i), 1)
        return out


def labelled(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (doc_id, ...) with _good: true or false for a sample of labelled rows, else null.

    The sample is drawn by a hash of the id, about ``rows`` ids, so it may be broadcast. An id with
    several labels is good only if all are.
    """
    known = labels.where("doc_id is not null and quality is not null")
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < min(1.0, rows / max(n, 1))).groupBy(F.col("doc_id").alias("_lid")).agg((F.min("quality") > 0).alias("_good"))
    return docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_lid"), "left").drop("_lid")


def fit(rows: DataFrame) -> Ratio:
    """Both models of ``rows`` (text, _good): raw counts cover all texts, target those that are good."""
    got = rows.select("text", F.col("_good")).mapInArrow(trimmed(_count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return Ratio(raw, target)


def with_scores(rows: DataFrame, model: Ratio, seed: int = 3) -> DataFrame:
    """Add _score, the mean log importance weight, and _noise, a Gumbel number from a hash."""
    from pyspark.sql.functions import arrow_udf

    raw, target = model.raw, model.target

    @arrow_udf("double")
    def score(text: pa.Array, good: pa.Array) -> pa.Array:
        inside = good.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        return pa.array(Ratio(raw, target).scores(text, inside))

    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return rows.withColumns({"_score": score("text", "_good"), "_noise": -F.log(-F.log(u))})


def key_of(step: float) -> F.Column:
    """Gumbel's key: the largest k are a sample without replacement, with chances as exp(_score / step)."""
    return F.col("_score") / F.lit(float(step)) + F.col("_noise")


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value, by histograms of ever smaller ranges: no sort, bounded driver rows."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or n == 0:
        return float("inf")
    if k >= n:
        return lo
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            break
        step = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))
        got = df.where((F.col(col) >= lo) & (F.col(col) <= hi)).groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(got, key=lambda r: -r.b):
            if above + r.n >= k:
                if len(got) == 1 and (r.lo, r.hi) == (lo, hi) and r.n == n:
                    return lo
                lo, hi, n = r.lo, r.hi, r.n
                break
            above += r.n
    return lo


def cut_score(good: np.ndarray, bad: np.ndarray, care: float = CARE) -> float:
    """The score below which to reject: the best of (share of bad texts below) - care * (share of good
    texts below); halfway into the gap that it lies in. Without either kind nothing is rejected."""
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    gain = np.searchsorted(np.sort(bad), at) / len(bad) - care * np.searchsorted(np.sort(good), at) / len(good)
    k = int(np.flatnonzero(gain == gain.max())[-1])
    return float(at[k] if k == 0 else (at[k] + at[k - 1]) / 2) if gain[k] > 0 else -np.inf


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", steps: float = STEPS, seed: int = 3) -> tuple[DataFrame, Ratio, float, float]:
    """doc_id, _score, _noise and _good of every row, the models, the sampling step, and the key from
    which rows are kept.

    The number to keep is how many rows score over the cut that labelled rows show; Gumbel top-k
    then samples so many rows without replacement, with chances as exp(score / step). The step is
    the distance from the cut to the median of good labelled texts over ``steps``. Rows
    with equal ids and texts have equal keys and stay or go together. Null and blank texts score 0,
    as good as an average text. Without labels of both kinds all rows are kept.
    """
    rows = docs.withColumns({"doc_id": F.col(f"`{id_col}`"), "text": F.coalesce(F.col(f"`{text_col}`"), F.lit(""))})
    rows = labelled(rows.select("doc_id", "text"), labels.select("doc_id", "quality"))
    scored = Workspace(docs.sparkSession, "dsir").keep(with_scores(rows, model := fit(rows), seed).select("doc_id", "_score", "_noise", "_good"), "scores")
    seen = scored.where("_good is not null").select("_score", "_good").toArrow()
    value, good = seen.column(0).to_numpy(), seen.column(1).to_numpy(zero_copy_only=False).astype(bool)
    cut = cut_score(value[good], value[~good])
    if not np.isfinite(cut):
        return scored, model, 1.0, -np.inf
    step = max((float(np.median(value[good])) - cut) / steps, 1e-9)
    return scored, model, step, kth_largest(scored.withColumn("_key", key_of(step)), "_key", scored.where(F.col("_score") >= cut).count())


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, log_weight, resample_key and kept for every row; see ``classify``."""
    scored, _, step, least = classify(docs, labels, id_col=id_col, text_col=text_col, **options)
    key = key_of(step)
    return scored.select("doc_id", (F.col("_score") / F.lit(float(step))).alias("log_weight"), key.alias("resample_key"), (key >= F.lit(float(least))).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that ``classify`` keeps, in their own columns."""
    _, model, step, least = classify(docs, labels)
    plain = with_row(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_scores(labelled(plain, labels.select("doc_id", "quality")), model)
    return row_back(rows.where(key_of(step) >= F.lit(float(least))), docs)
