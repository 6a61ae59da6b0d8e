"""Near-duplicate vectors through an inverted multi-index: codebooks on both halves, a grid of cells."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components

COSINE = 0.9
#: Rows that the codebooks are fitted on, and codewords of a half at most.
SAMPLE = 8192
MOST_WORDS = 256
#: Rows of a cell, and visitors of a cell, that are compared as one block.
BLOCK = 1024
#: Rows that a cell of the grid has on average; codewords of a half follow from it.
CELL_ROWS = 1024
#: Blocks at home that share a task, which a row visits once for all of them; bits of a mask.
BUNDLE = 8
#: Rows with the bundles they visit that are built at once.
VISITS = 1 << 16


def valid(col: str) -> F.Column:
    """Not null, no null or non-finite component, and not zero."""
    c = F.col(f"`{col}`")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def usual_size(df: DataFrame, col: str) -> int:
    """The most frequent length of valid vectors, 0 if there are none; ties go to the longer."""
    row = df.where(valid(col)).groupBy(F.size(f"`{col}`").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def matrix(col, dim: int) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:k]]
    for _ in range(rounds):
        at = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def planes(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and the squared distance of the row to the plane between
    that codeword and every other: no point beyond the plane is nearer than that."""
    d = (c * c).sum(axis=1) - 2 * x @ c.T
    home = d.argmin(axis=1)
    gap = np.sqrt(np.maximum((c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * c @ c.T, 0))
    far = np.maximum(d - d[np.arange(len(x)), home][:, None], 0) / np.maximum(2 * gap[home], 1e-12)
    far[np.arange(len(x)), home] = 0
    return home, far**2


def traverse(a: np.ndarray, b: np.ndarray, reach: float):
    """Cells (i, j) with a[i] + b[j] <= reach, nearest first (the multi-sequence order of one row)."""
    i, j = np.flatnonzero(a <= reach), np.flatnonzero(b <= reach)
    total = a[i][:, None] + b[j][None, :]
    r, s = np.nonzero(total <= reach)
    order = np.argsort(total[r, s], kind="stable")
    return i[r][order], j[s][order]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the largest component first becomes one."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _block_links(v: np.ndarray, h: np.ndarray, same: bool, bound: float) -> np.ndarray:
    out = v @ h.T >= bound
    if same:
        np.fill_diagonal(out, False)
    return out


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", bound: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; links are pairs with cosine >= ``bound``.

    Equal unit vectors are one class with a count. Each class has a home cell on the grid of the two
    codebooks and visits the cells nearest to it whose home numbers are lower; cells lie beyond planes
    between codewords, and the traversal ends where the planes are farther than any linking difference
    is long, so no link is lost. Members and visitors of a cell meet in blocks, which give counts and a
    forest of the links, never the pairs. A crowded cell is many blocks, none is skipped. Vectors travel
    once to each bundle of blocks that they visit.

    Rows that are null, zero, hold null or non-finite components, or aren't as long as most rows link
    with nothing. Repeated rows count as rows. Rows without an id never name a component that has
    another. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "multi-index")
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    number = np.float32 if single else np.float64  # vectors travel as they came
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("v"))
    dim = usual_size(rows, "v")
    good = valid("v") & (F.size("v") == dim)
    half = (dim + 1) // 2

    def read(col) -> np.ndarray:
        return np.frombuffer(b"".join(col), number).reshape(-1, dim)

    def prepare(batches):
        for b in batches:
            v = matrix(b.column(1), dim)
            raw = [hashlib.blake2b(r.tobytes(), digest_size=16).hexdigest() for r in unit(v) + 0.0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw), pa.array([r.tobytes() for r in v.astype(number)], pa.binary())], ["vec_id", "cls", "x"])

    if dim:
        table = work.keep(rows.where(good).mapInArrow(prepare, "vec_id long, cls string, x binary"), "unit")
        classes = work.keep(table.groupBy("cls").agg(F.count("*").alias("n"), F.min("x").alias("x")), "classes")
        total = classes.count()
        draw = F.pmod(F.xxhash64(F.lit(2), "cls"), F.lit(1 << 30)) / float(1 << 30)
        got = classes.where(draw < min(1.0, 1.1 * SAMPLE / total)).select("x").limit(SAMPLE).toArrow().column("x").to_pylist()
        sample = unit(read(got)) if got else np.zeros((0, dim))
        k = int(np.clip(round((total / CELL_ROWS) ** 0.5), 1, min(MOST_WORDS, max(len(sample), 1))))
        books = (kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)) if len(sample) and half < dim else (np.zeros((1, half)), np.zeros((1, dim - half)))
        width = len(books[1])
        # a linking difference has squared length 2 - 2 * bound at most, and all of it may lie along the
        # planes' normals; what rounding may add is far below the last term
        reach = 2 - 2 * bound + 1e-9

        def places(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The home cell of each row, and the squared distances of the row to the planes of both halves."""
            x = unit(read(f["x"]))
            (h1, d1), (h2, d2) = planes(x[:, :half], books[0]), planes(x[:, half:], books[1])
            return h1 * width + h2, d1, d2

        def tally(frames):
            for f in frames:
                cell, n = np.unique(places(f)[0], return_counts=True)
                yield pd.DataFrame({"cell": cell, "n": n})

        # at most a row a cell of the grid, whose size MOST_WORDS bounds
        counts = {r.cell: r.n for r in classes.select("x").mapInPandas(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        n_blocks = np.zeros(len(books[0]) * width, np.int64)
        n_blocks[list(counts)] = [-(-n // BLOCK) for n in counts.values()]
        first = np.cumsum(n_blocks) - n_blocks  # blocks are numbered through, cell by cell
        n_bundles = int(n_blocks.sum()) // BUNDLE + 1

        def visits(frames):
            for whole in frames:
                for start in range(0, len(whole), max(VISITS // n_bundles, 1)):
                    f = whole.iloc[start : start + max(VISITS // n_bundles, 1)]
                    home, d1, d2 = places(f)
                    own = first[home] + np.array([int(c[:8], 16) for c in f["cls"]]) % n_blocks[home]
                    at, bundle, mask = [np.arange(len(f))], [own // BUNDLE], [np.zeros(len(f), np.int64)]
                    for r in range(len(f)):
                        i, j = traverse(d1[r], d2[r], reach)
                        c = i * width + j
                        c = c[c < home[r]]
                        n = n_blocks[c]
                        blocks = np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        blocks = np.concatenate([blocks, np.arange(first[home[r]], own[r])])
                        to, group = np.unique(blocks // BUNDLE, return_inverse=True)
                        at.append(np.full(len(to), r))
                        bundle.append(to)
                        mask.append(np.bincount(group, 1 << blocks % BUNDLE, len(to)).astype(np.int64))
                    at, bundle, mask = np.concatenate(at), np.concatenate(bundle), np.concatenate(mask)
                    g = f.iloc[at]
                    stays = np.arange(len(at)) < len(f)
                    yield pd.DataFrame({"bundle": bundle, "origin": own[at] // BUNDLE, "home": stays, "mark": np.where(stays, own[at] % BUNDLE, mask), "cls": g["cls"].to_numpy(), "n": g["n"].to_numpy(), "x": g["x"].to_numpy()})

        dealt = classes.select("cls", "n", "x").mapInPandas(visits, "bundle int, origin int, home boolean, mark int, cls string, n long, x binary")

        def stack(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("cls")
            return pd.DataFrame([{"bundle": f["bundle"].iloc[0], "home": f["home"].iloc[0], "mark": f["mark"].tolist(), "cls": f["cls"].tolist(), "n": f["n"].tolist(), "x": b"".join(f["x"])}])

        stacks = work.keep(dealt.groupBy("bundle", "origin", "home").applyInPandas(stack, "bundle int, home boolean, mark array<int>, cls array<string>, n array<long>, x binary"), "bundles")
        homes = stacks.where("home").select("bundle", F.col("mark").alias("hmark"), F.col("cls").alias("hcls"), F.col("n").alias("hn"), F.col("x").alias("hx"))
        meet = stacks.join(homes, "bundle")

        def forest_of(link: np.ndarray, same: bool, vc, vn, hc, hn) -> pd.DataFrame:
            nodes = np.concatenate([vc, hc])
            lv, lh = np.arange(len(vc)), np.arange(len(vc), len(nodes))
            if same:
                lh = lv.copy()
            while True:  # the least label on either side of any link, until none changes
                nv = np.minimum(lv, np.where(link, lh[None, :], len(nodes)).min(axis=1))
                nh = np.minimum(lh, np.where(link, nv[:, None], len(nodes)).min(axis=0))
                if (nv == lv).all() and (nh == lh).all():
                    break
                lv, lh = nv, nh
            count = np.concatenate([link @ hn, np.zeros(len(hc), int) if same else link.T @ vn])
            root = nodes[np.concatenate([lv, lh])]
            on = count > 0
            return pd.DataFrame({"cls": nodes[on], "links": count[on], "root": root[on]})

        def compare(frames):
            for f in frames:
                for r in f.itertuples():
                    v, h = (unit(np.frombuffer(b, number).reshape(-1, dim)) for b in (r.x, r.hx))
                    vc, hc = np.array(r.cls, "U32"), np.array(r.hcls, "U32")
                    vn, hn, mark, hmark = np.array(r.n), np.array(r.hn), np.array(r.mark), np.array(r.hmark)
                    for k in range(BUNDLE):
                        there = np.flatnonzero(hmark == k)
                        come = there if r.home else np.flatnonzero(mark >> k & 1)
                        for i in range(0, len(come), max(len(come), 1) if r.home else BLOCK):
                            here = come[i:] if r.home else come[i : i + BLOCK]
                            link = _block_links(v[here], h[there], r.home, bound)
                            if link.any():
                                yield forest_of(link, r.home, vc[here], vn[here], hc[there], hn[there])

        found = work.keep(meet.select("cls", "n", "x", "home", "mark", "hmark", "hcls", "hn", "hx").mapInPandas(compare, "cls string, links long, root string"), "links")
        links = found.groupBy("cls").agg(F.sum("links").alias("links"))
        roots = components(found.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v")), work)
        per = classes.select("cls", "n").join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
        per = per.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("comp"))
        out = table.select("vec_id", "cls").join(per, "cls")
        first = out.groupBy(F.col("comp").alias("_comp")).agg(F.min("vec_id").alias("_first"))
        linked = out.join(first, F.col("comp") == F.col("_comp")).select("vec_id", "n_links", F.col("_first").alias("component_id"))
        alone = rows.where(~good)
    else:
        linked, alone = None, rows
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = alone if linked is None else linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
