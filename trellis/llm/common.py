"""Shared pieces: the shared work folder, Arrow text batches as NumPy arrays, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass covers; a longer document is a pass of its own.
SLICE_BYTES = 1 << 20
#: Edges that one task may hold in its union-find (16-byte keys: about 100 MB).
FOREST_EDGES = 400_000


#: Bytes of an Arrow batch between the JVM and Python while a table is written.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_used: list[str] = []


class Workspace:
    """Tables in the folder that ``spark.checkpoint.dir`` names, which all executors share.

    Results read these tables, so they stay until ``sweep``. Where the setting is absent, a local
    session (as in tests) gets a folder beside its warehouse, and any other session an error: no
    other folder is known to be shared.
    """

    def __init__(self, spark: SparkSession, name: str):
        sc = spark.sparkContext
        root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
            sc.setCheckpointDir(root)
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0
        _used.append(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage is cut and survives lost executors. Rows go to Python in
        batches of ARROW_BYTES at most, which bounds the buffers on both sides."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        conf = self.spark.conf
        before = conf.get(_ARROW)
        conf.set(_ARROW, min(ARROW_BYTES, int(self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))))
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            conf.set(_ARROW, before)
        return self.spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Delete the tables of all workspaces of this process, once what reads them is written; their number."""
    n = 0
    while _used:
        path = spark._jvm.org.apache.hadoop.fs.Path(_used.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


#: Holds a whole input row while other columns are worked on, so that names can't clash.
ROW = "__row"


def with_row(df: DataFrame, *names: str) -> DataFrame:
    """The whole row as one column, and the named columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[F.col(f"`{c}`") for c in names])


def row_back(df: DataFrame, like: DataFrame, **changed) -> DataFrame:
    """The columns of ``like`` out of the row, but for those that changed."""
    return df.select(*[changed[c].cast(like.schema[c].dataType).alias(c) if c in changed else F.col(f"{ROW}.`{c}`").alias(c) for c in like.columns])


# ---------------------------------------------------------------- memory of workers


def release() -> None:
    """Give freed memory back to the system: a worker that idles after its task would keep it beside the
    tasks of the JVM that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def trimmed(run):
    """A function over batches that gives memory back when a partition is done."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


# ---------------------------------------------------------------- texts as arrays

#: A multiplier that is odd, so that its powers have inverses modulo 2**64.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the SplitMix64 one) that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
#: Sets the first token of a pair off from the second.
_STEP2 = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (one more than rows); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes."""
    data, offs = buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, their row, and words per row."""
    n = len(data)
    rows = len(offs) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n, bool)
    edge[offs[:-1][offs[:-1] < n]] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(offs, start, "right") - 1
    return run_hashes(_LOWER[data], start, end), row, np.bincount(row, minlength=rows)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every run of bytes [start, end], the same wherever it stands."""
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[data] * _power(_P, len(data)))
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        return mix64((total[end] - before) * _power(_PINV, len(data))[start] + (end - start + 1).astype(np.uint64))


# ---------------------------------------------------------------- connected components


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest_batches(batches):
    parts = [x for x in batches if len(x)]
    if not parts:
        return
    df = pd.concat(parts)
    nodes, root = forest(df["u"].to_numpy().astype("U32"), df["v"].to_numpy().astype("U32"))
    yield pd.DataFrame({"u": nodes, "v": root})


def components(edges: DataFrame, work: Workspace, most: int = FOREST_EDGES) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: strings of 32 characters at most); root is the
    smallest node reachable.

    Bounded tasks first replace their edges with a spanning forest, as often as that shrinks them.
    What fits one task's bound ends there; a larger rest goes on with alternating large-star and
    small-star steps, which need no task to hold a component. No edges give no rows.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = work.keep(edges.select("u", "v").where("u <> v").distinct(), "edges")
    n = edges.count()
    while n > most:
        less = work.keep(edges.repartition(-(-n // most)).mapInPandas(trimmed(_forest_batches), "u string, v string").where("u <> v").distinct(), "forest")
        m = less.count()
        if m > 0.6 * n:
            break
        edges, n = less, m
    if n <= most:
        out = edges.coalesce(1).mapInPandas(trimmed(_forest_batches), "u string, v string")
        return work.keep(out.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
    seen = None
    while True:
        e = both(edges)
        low = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = e.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = work.keep(small.select("e.u", "e.v").where("u <> v").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return work.keep(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct(), "components")


# ---------------------------------------------------------------- prefix sums over a hot key


def boundary_sums(df: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """Add ``before``: the sum of ``size`` over the rows of a group that come earlier by ``order``.

    ``df`` has a column ``step``, the number of a row's range, which never falls as ``order`` rises.
    Range totals are prefix-summed (groups x ranges rows), and only rows of one range are sorted
    together, so a hot group is never one task if its rows are spread over ranges.
    """
    from pyspark.sql import Window as W

    totals = df.groupBy(group, "step").agg(F.sum(size).alias("_sum"))
    w = W.partitionBy(group).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(F.col(group).alias("_g"), F.col("step").alias("_s"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    own = W.partitionBy(group, "step").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("_own", F.coalesce(F.sum(size).over(own), F.lit(0)))
    return rows.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("step") == F.col("_s")), "left").withColumn("before", F.col("_base") + F.col("_own")).drop("_g", "_s", "_base", "_own", "step")
