"""Which texts hold which needles, by an inverted index of sampled grams; and tasks found by what their users say."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise_folded

#: Classes of needles: the fewest UTF-8 bytes of a needle, bytes of a gram, grams of a window. A needle holds a
#: whole window (gram + window - 1 bytes) of its class. Shorter ones have grams of their own length.
CLASSES = ((64, 16, 49), (32, 16, 17), (16, 8, 9), (8, 4, 5), *((n, n, 1) for n in range(7, 0, -1)))
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20
#: An anchor in more texts than this is hot, and so many hot ones at most are broadcast.
HOT, MOST_HOT = 100_000, 50_000


def _window_minima(data: np.ndarray, gram: int, window: int) -> np.ndarray:
    """The distinct smallest gram hashes of all windows. A window's smallest gram depends on its bytes alone, so
    a text that holds a needle has every one of the needle's."""
    found = []
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + gram + window - 2].astype(np.uint64)
        n = len(part) - gram + 1
        if n < window:
            break
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(gram):
                h = h * np.uint64(0x100000001B3) + part[k : k + n] + np.uint64(1)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        span = 1
        while span < window:
            step = min(span, window - span)
            h = np.minimum(h[:-step], h[step:])
            span += step
        found.append(np.unique(h))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def _grams(kinds: list[int]):
    """A column function: (class, hash) of a text's sampled grams in the given classes. Grams stay arrays of 12 bytes
    each; no object is made of one."""
    wanted = [(k, *CLASSES[k][1:]) for k in kinds]

    def run(texts: pa.Array) -> pa.Array:
        ends, classes, hashes = [0], [], []
        for t in texts:
            data = np.frombuffer(t.as_py().encode(), np.uint8) if t.is_valid else np.zeros(0, np.uint8)
            found = [_window_minima(data, gram, window) for _, gram, window in wanted]
            classes += [np.full(len(h), k, np.int32) for (k, *_), h in zip(wanted, found, strict=True)]
            hashes += found
            ends.append(ends[-1] + sum(map(len, found)))
        flat = [np.concatenate([np.zeros(0, kind), *x]) for kind, x in ((np.int32, classes), (np.int64, hashes))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["c", "h"]))

    return F.arrow_udf(run, "array<struct<c:int,h:bigint>>")


def _class(needle: Column) -> Column:
    out = F.lit(None).cast("int")
    for k in reversed(range(len(CLASSES))):
        out = F.when(F.octet_length(needle) >= CLASSES[k][0], k).otherwise(out)
    return out


def contains_pairs(texts: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str) -> DataFrame:
    """(key, needle key) of each text and each needle that it holds as it stands, once a pair.

    Both sides give sampled grams: about one in half a window of the needle's class. A needle's anchor is
    that of its grams which the fewest texts have; texts meet needles by anchor, and each pair that meets
    is compared. Needles of which a gram is in no text meet nothing. Anchors in very many texts are
    broadcast, where there are few of them; all else moves by hash, and no needle goes through the
    driver. Null texts and null or empty needles match nothing; null keys are keys.
    """
    held = needles.where(F.octet_length(needle) > 0).select(F.col(f"`{needle_key}`").alias("_nk"), F.col(f"`{needle}`").alias("_n")).withColumn("_class", _class(F.col("_n")))
    kinds = sorted(r[0] for r in held.select("_class").distinct().collect())
    rows = texts.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))
    if not kinds:
        return rows.select("_k").crossJoin(held.select("_nk").limit(0)).toDF(key, needle_key)
    own = None
    for k in kinds:
        part = held.where(F.col("_class") == k).select("_nk", "_n", F.explode(_grams([k])(F.col("_n"))).alias("_g"))
        own = part if own is None else own.unionByName(part)
    own = own.select("_nk", "_n", "_g.*")
    asked = own.select("c", "h").distinct()
    met = rows.select("_k", F.explode(_grams(kinds)(F.col("_t"))).alias("_g")).select("_k", "_g.*").join(asked, ["c", "h"], "left_semi").persist()
    counts = met.groupBy("c", "h").agg(F.count("*").alias("_in"))
    every = own.join(counts, ["c", "h"], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    anchors = every.groupBy("_nk", "_n").agg(F.min(F.struct("_in", "c", "h")).alias("_a")).select("_nk", "_n", "_a.*").where("_in > 0")
    hot = anchors.where(F.col("_in") > HOT)
    if 0 < hot.limit(MOST_HOT + 1).count() <= MOST_HOT:
        pairs = met.join(F.broadcast(hot), ["c", "h"]).unionByName(met.join(F.broadcast(hot.select("c", "h").distinct()), ["c", "h"], "left_anti").join(anchors.where(F.col("_in") <= HOT), ["c", "h"]))
    else:
        pairs = met.join(anchors, ["c", "h"])
    pairs = pairs.select(F.col("_k").alias("_pk"), "_nk", "_n")
    found = pairs.join(rows, F.col("_pk").eqNullSafe(F.col("_k"))).where(F.col("_t").contains(F.col("_n")))
    return found.select(F.col("_k").alias(key), F.col("_nk").alias(needle_key)).distinct()


# ---------------------------------------------------------------- tasks


def normal(c: Column) -> Column:
    """Case folded (ß is ss in either case), runs of white space as one space, trimmed; null counts as empty."""
    return normalise_folded(c)


def resolved(records: DataFrame, record: str, tasks: DataFrame, chosen: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a record with task and tier: map, id, text or null.

    ``records`` has places (keys under which a reviewed map may know the record, the first that it has
    counts), said (an explicit task id) and users (the text of its users). ``chosen`` is that map (place,
    task): what it says stands, and a task that it names but ``tasks`` lacks is no task. Then an explicit
    id that is a task counts. Else the tasks whose ``initial`` request stands in the users' text, both
    normalised: one alone is it; of several, the one for which the record's ``answers`` (record, aspect,
    answer) tell most, 3 for each right one and 1 for each that is an option, if no other has as much.
    ``tasks`` has task, initial, and options, an array of (aspect, correct, every).
    """
    key = F.col(record)
    placed = records.select(key.alias("_r"), F.posexplode("places").alias("_at", "place")).join(chosen.select("place", F.col("task").alias("_task")), "place")
    mapped = placed.groupBy("_r").agg(F.min_by(F.struct(F.col("_task").alias("t")), "_at")["t"].alias("_mapped"), F.lit(True).alias("_known"))
    known = tasks.select(F.col("task").alias("_is")).distinct()
    with_map = records.join(mapped, key.eqNullSafe(F.col("_r")), "left").drop("_r")
    by_map = with_map.where("_known").join(known, F.col("_mapped") == F.col("_is"), "left").select(key, F.col("_is").alias("task"), F.when(F.col("_is").isNotNull(), "map").alias("tier"))
    rest = with_map.where("_known IS NULL").join(known, F.col("said") == F.col("_is"), "left")
    by_id = rest.where("_is IS NOT NULL").select(key, F.col("_is").alias("task"), F.lit("id").alias("tier"))
    asking = rest.where("_is IS NULL").select(key.alias("_r"), normal(F.col("users")).alias("_u"))
    hits = contains_pairs(asking, "_r", "_u", tasks.select("task", normal(F.col("initial")).alias("_i")), "task", "_i")
    options = tasks.select("task", F.explode("options").alias("o")).select("task", "o.*")
    said = answers.select(F.col(record).alias("_s"), F.col("aspect").alias("_as"), F.upper(F.trim("answer")).alias("_an"))
    points = hits.join(said, F.col("_r").eqNullSafe(F.col("_s"))).join(options.withColumnRenamed("task", "_o"), (F.col("task") == F.col("_o")) & (F.col("aspect") == F.col("_as")))
    points = points.groupBy("_r", "task").agg(F.sum(F.when(F.array_contains("correct", F.col("_an")), 3).when(F.array_contains("every", F.col("_an")), 1).otherwise(0)).alias("_p"))
    scored = hits.join(points.select(F.col("_r").alias("_pr"), F.col("task").alias("_pt"), "_p"), F.col("_r").eqNullSafe(F.col("_pr")) & (F.col("task") == F.col("_pt")), "left").select("_r", "task", F.coalesce("_p", F.lit(0)).alias("_p"))
    w = W.partitionBy("_r")
    best = scored.withColumns({"_top": F.max("_p").over(w)}).where("_p = _top").groupBy("_r").agg(F.count("*").alias("_n"), F.min("task").alias("_t")).where("_n = 1")
    by_text = asking.select("_r").join(best.withColumnRenamed("_r", "_b"), F.col("_r").eqNullSafe(F.col("_b")), "left").select(F.col("_r").alias(record), F.col("_t").alias("task"), F.when(F.col("_t").isNotNull(), "text").alias("tier"))
    return by_map.unionByName(by_id).unionByName(by_text)
