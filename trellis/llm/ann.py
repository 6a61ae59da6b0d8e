"""Approximate nearest neighbours: an adaptive dimension scan over column blocks of rotated vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace
from .embdedup import kmeans, matrix, usual_size, valid

#: Rows that centroids, probes and first thresholds are fitted on.
SAMPLE = 8192
MOST_LISTS = 1024
#: Rotated dimensions that are summed between two tests.
COLUMNS = 16
#: How many standard errors a partial distance must exceed the threshold by.
ERRORS = 3.0
#: Mean recall that the number of probed lists is chosen for, on the sample.
RECALL = 0.98
#: Rows of a list and queries of a bundle that are compared as one block; lists of a bundle (bits of a
#: mask), which a query visits once for all of them; blocks of a bundle that share a task.
LIST_BLOCK, QUERY_BLOCK, BUNDLE, PART = 2048, 256, 16, 32
#: Sample queries that thresholds are worked out for at once.
SLICE = 256
#: Norms of one band are within this factor of each other.
BAND = 2.0


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by their largest component, and that; no square of what remains can overflow."""
    most = np.abs(v).max(axis=1, keepdims=True)
    return v / most, most[:, 0]


def bands(v: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Norms in multiples of ``unit`` (the table's largest component), and their bands from 0 down."""
    x, most = scaled(v)
    norm = np.maximum(np.sqrt((x * x).sum(axis=1)) * (most / unit), 1e-300)
    return norm, np.floor(np.log(v.shape[1] ** 0.5 / norm) / np.log(BAND)).astype(int)


class Space:
    """Largest inner product as smallest distance: one more dimension lifts every vector to the norm
    of the longest one in its band, and a rotation spreads what distinguishes vectors over all
    dimensions. Bands of norms have lists of their own, so that a vector that is out of all
    proportion takes no precision from the rest; norms are in multiples of ``unit``."""

    def __init__(self, sample: np.ndarray, unit: float, found: dict[int, tuple[int, float]], k: int):
        """``found`` has rows and the largest norm of each band."""
        self.unit, self.turn = unit, rotation(sample.shape[1] + 1)
        self.order = np.array(sorted(found))
        self.tops = np.array([found[b][1] for b in self.order.tolist()])
        x, band, _ = self.base(sample)
        total = sum(n for n, _ in found.values())
        parts, where = [], []
        for i, b in enumerate(self.order.tolist()):
            rows = x[band == i]
            n = int(np.clip(round(found[b][0] ** 0.5), 1, max(min(MOST_LISTS, len(rows)), 1)))
            c = kmeans(rows, n) if len(rows) else np.zeros((1, x.shape[1]))
            parts.append(c)
            where.append(np.full(len(c), i))
        self.centroids, self.where = np.concatenate(parts), np.concatenate(where)
        self._bundle()
        self.sample, self.homes = self._flat(sample), self.lists(x, band)
        self.probes = self._probes(sample, max(1, round(k * len(sample) / total)))

    def _bundle(self) -> None:
        """Number lists so that those of one bundle are near each other."""
        groups = -(-len(self.centroids) // BUNDLE)
        near = kmeans(self.centroids, groups)
        label = ((near * near).sum(axis=1) - 2 * self.centroids @ near.T).argmin(axis=1)
        order = np.lexsort((label, self.where))
        self.centroids, self.where = self.centroids[order], self.where[order]

    def _flat(self, v: np.ndarray) -> np.ndarray:
        """Vectors in multiples of the unit: their inner products with unit queries can't overflow."""
        return v / self.unit

    def base(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lifted and rotated rows, the place of their band, and its longest norm."""
        _, band = bands(v, self.unit)
        band = np.minimum(np.searchsorted(self.order, band), len(self.order) - 1)
        top = self.tops[band]
        w = (v / self.unit) / top[:, None]
        lift = np.sqrt(np.maximum(1 - (w * w).sum(axis=1), 0))
        return np.column_stack([w, lift]) @ self.turn, band, top

    def query(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries needn't be short: their length doesn't change the order, so it is set to 1. Rotated
        rows, and rows of length 1."""
        x, _ = scaled(v)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.column_stack([x, np.zeros(len(v))]) @ self.turn, x

    def lists(self, x: np.ndarray, band: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), int)
        for b in np.unique(band):
            rows, of = np.flatnonzero(band == b), np.flatnonzero(self.where == b)
            c = self.centroids[of]
            out[rows] = of[((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)]
        return out

    def near_lists(self, q: np.ndarray) -> np.ndarray:
        """Lists by the inner product that a row at their centroid's distance would have, largest first."""
        c = self.centroids
        return np.argsort(-self.tops[self.where] * (1 - (c * c).sum(axis=1) + 2 * q @ c.T), axis=1, kind="stable")

    def _probes(self, sample: np.ndarray, k: int) -> int:
        """The fewest lists whose recall over sample queries, against a scan of the sample, is RECALL;
        ``k`` is as many rows of the sample as stand for the neighbours in the whole table."""
        some = np.arange(0, len(sample), max(1, len(sample) // 512))
        q, u = self.query(sample[some])
        score = u @ self.sample.T
        score[np.arange(len(some)), some] = -np.inf
        k = min(k, max(len(sample) - 1, 1))
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        rank = np.argsort(self.near_lists(q), axis=1)
        need = np.sort(np.take_along_axis(rank, self.homes[top], axis=1).ravel())
        return int(min(len(self.centroids), need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))] + 1))

    def threshold(self, u: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
        """The (k+1)-th largest inner product with those sample rows that lie in the probed lists (the
        query may be one): k rows found there are no less, so what is less needn't be found."""
        out = np.full(len(u), -np.inf)
        for s in range(0, len(u), SLICE):
            score = u[s : s + SLICE] @ self.sample.T
            probed = np.zeros((len(score), len(self.centroids)), bool)
            np.put_along_axis(probed, lists[s : s + SLICE], True, axis=1)
            score[~probed[:, self.homes]] = -np.inf
            if score.shape[1] > k:
                out[s : s + SLICE] = -np.partition(-score, k, axis=1)[:, k]
        return out


def distance_bound(least: np.ndarray, top: float) -> np.ndarray:
    """Squared distance within which a row of a band must lie to have the inner product ``least``;
    below zero if none can."""
    with np.errstate(over="ignore"):
        return np.minimum(2 * (1 - least / top), 4.0) * (1 + 1e-5) + 2e-5


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, errors: float = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) whose distance isn't shown to exceed the query's bound.

    After every block of columns the partial sum, scaled to all dimensions, is held against the bound:
    under a random rotation it is off by a relative 1/sqrt(columns seen) or so, and a candidate that
    exceeds the bound by ``errors`` such steps is abandoned. The last test is the full distance.
    """
    dim = q.shape[1]
    left = [(q[:, s : s + COLUMNS], x[:, s : s + COLUMNS]) for s in range(0, dim, COLUMNS)]
    qb, xb = left[0]
    part = (qb * qb).sum(axis=1)[:, None] + (xb * xb).sum(axis=1) - 2 * qb @ xb.T
    seen = qb.shape[1]
    slack = (1 + errors / np.sqrt(seen)) ** 2 if seen < dim else 1.0
    i, j = np.nonzero(part * (dim / seen) <= (bound * slack)[:, None])
    part = part[i, j]
    for qb, xb in left[1:]:
        d = qb[i] - xb[j]
        part = part + np.einsum("ij,ij->i", d, d)
        seen += qb.shape[1]
        slack = (1 + errors / np.sqrt(seen)) ** 2 if seen < dim else 1.0
        live = part * (dim / seen) <= bound[i] * slack
        i, j, part = i[live], j[live], part[live]
    return i, j


def search(base: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of ``base`` with the largest inner product for each query: query_id, rank, vec_id, score.

    Every valid row of ``base`` is in one list; a query probes the lists nearest to it, as many as give
    the wanted recall on the sample, but for those whose band of norms can't reach its threshold. A
    query travels once to each bundle of lists that it probes; lists and queries meet in blocks of
    bounded size, so a crowded list is many blocks and many tasks. What a query has found in a bundle
    tightens its threshold for the blocks that follow. Scores are inner products of the original
    vectors in double precision; ties go to the smaller vec_id. A query's own id is no candidate.

    Null, zero, non-finite or unusually long or short vectors, and rows without an id, take no part on
    either side; any finite length of a vector is served. Repeated rows of ``base`` are candidates of
    their own; repeated queries are answered once. Without valid rows there are no answers.
    """
    spark = base.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    single = all(dict(df.dtypes)[vec_col] == "array<float>" for df in (base, queries))
    number = np.float32 if single else np.float64  # vectors travel as they came
    plain = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("v")).where("id is not null")
    dim = usual_size(plain(base), "v")
    if not dim:
        return empty
    fit = lambda df: plain(df).where(valid("v") & (F.size("v") == dim))
    rows, asked = fit(base), fit(queries).dropDuplicates(["id"])
    total, unit = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    rows_of = lambda col: np.array(col.tolist(), np.float64).reshape(-1, dim)

    def tally(frames):
        for f in frames:
            if len(f):
                norm, band = bands(rows_of(f["v"]), unit)
                yield pd.DataFrame({"band": band, "top": norm}).groupby("band", as_index=False).agg(n=("top", "size"), top=("top", "max"))

    counts = rows.select("v").mapInPandas(tally, "band int, n long, top double").groupBy("band").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()
    draw = F.pmod(F.xxhash64(F.lit(4), "id", "v"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < min(1.0, 1.1 * SAMPLE / total)).select("v").limit(SAMPLE).toArrow()
    sample = matrix(sample.column("v"), dim) if sample.num_rows else matrix(rows.select("v").limit(1).toArrow().column("v"), dim)
    space = Space(sample, float(unit), {r.band: (r.n, r.top) for r in counts}, k)
    work = Workspace(spark, "adaptive-scan")
    shared = spark.sparkContext.broadcast(space.__dict__)

    def restored() -> Space:
        s = Space.__new__(Space)
        s.__dict__ = shared.value
        return s

    def deal(frames):
        s = restored()
        for f in frames:
            v = rows_of(f["v"])
            x, band, _ = s.base(v)
            yield pd.DataFrame({"list": s.lists(x, band), "id": f["id"], "v": [r.tobytes() for r in v.astype(number)]})

    def probe(frames):
        s = restored()
        for f in frames:
            v = rows_of(f["v"])
            q, u = s.query(v)
            lists = s.near_lists(q)[:, : s.probes]
            least = s.threshold(u, lists, k)
            with np.errstate(invalid="ignore"):
                reached = s.tops[s.where[lists]] * (1 + 1e-5) >= least[:, None]
            at, which = np.nonzero(reached)
            mask = np.zeros((len(v), -(-len(s.centroids) // BUNDLE)), np.int64)
            np.bitwise_or.at(mask, (at, lists[at, which] // BUNDLE), np.int64(1) << (lists[at, which] % BUNDLE))
            at, bundle = np.nonzero(mask)
            raw = np.array([r.tobytes() for r in v.astype(number)], object)
            yield pd.DataFrame({"bundle": bundle, "id": f["id"].to_numpy()[at], "v": raw[at], "mask": mask[at, bundle], "least": least[at]})

    def stack(key: str, more: tuple[str, ...] = ()):
        def run(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("id")
            return pd.DataFrame([{key: f[key].iloc[0], "block": f["block"].iloc[0], "ids": f["id"].tolist(), "vs": b"".join(f["v"])} | {c: f[c].tolist() for c in more}])

        return run

    def blocks(df: DataFrame, key: str, rows_each: int, spec: str, more: tuple[str, ...] = ()) -> DataFrame:
        sizes = df.groupBy(key).count().select(key, F.ceil(F.col("count") / rows_each).cast("int").alias("blocks"))
        dealt = df.join(F.broadcast(sizes), key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        return dealt.groupBy(key, "block").applyInPandas(stack(key, more), f"{key} int, block int, ids array<long>, vs binary" + spec)

    # lists and bundles are bounded by MOST_LISTS and the bands of doubles, so their counts are small
    index = work.keep(blocks(work.keep(rows.mapInPandas(deal, "list int, id long, v binary"), "lists"), "list", LIST_BLOCK, ""), "index")
    units = work.keep(blocks(work.keep(asked.mapInPandas(probe, "bundle int, id long, v binary, mask long, least double"), "probes"), "bundle", QUERY_BLOCK, ", mask array<long>, least array<double>", ("mask", "least")), "queries")
    index = index.withColumn("bundle", F.floor(F.col("list") / BUNDLE).cast("int"))
    parts = index.groupBy("bundle").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    held = index.join(F.broadcast(parts), "bundle").withColumn("part", F.pmod(F.xxhash64("list", "block"), F.col("parts")).cast("int")).drop("parts")
    asks = units.join(F.broadcast(parts), "bundle").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = asks.select("bundle", "part", F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vs").alias("qvs"), "mask", "least")

    def compare(frames):
        s, on, state = restored(), None, None

        def answers():
            ids, kept = state["ids"], state["kept"]
            found = [(ids[i], v, x) for i, best in enumerate(kept) if best is not None for v, x in zip(*best, strict=True)]
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        for f in frames:
            for r in f.itertuples():
                if on != (r.bundle, r.part, r.qblock):
                    if state:
                        yield answers()
                    on, w = (r.bundle, r.part, r.qblock), np.frombuffer(r.qvs, number).reshape(-1, dim).astype(np.float64)
                    with np.errstate(over="ignore"):
                        norm = np.sqrt((scaled(w)[0] ** 2).sum(axis=1)) * scaled(w)[1]
                    state = {"ids": np.array(r.qids), "w": w, "q": s.query(w)[0].astype(np.float32), "mask": np.array(r.mask), "least": np.array(r.least, float), "norm": norm, "kept": [None] * len(w)}
                here = np.flatnonzero(state["mask"] >> (r.list % BUNDLE) & 1)
                top = float(s.tops[s.where[r.list]])
                here = here[distance_bound(state["least"][here], top) >= 0]
                if not len(here):
                    continue
                v, ids = np.frombuffer(r.vs, number).reshape(-1, dim).astype(np.float64), np.array(r.ids)
                i, j = scan(state["q"][here], s.base(v)[0].astype(np.float32), distance_bound(state["least"][here], top))
                i = here[i]
                own = state["ids"][i] != ids[j]
                i, j = i[own], j[own]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,ij->i", state["w"][i], v[j])
                for q in np.unique(i):
                    at = i == q
                    new = ids[j[at]], score[at]
                    if state["kept"][q] is not None:
                        new = tuple(np.concatenate(x) for x in zip(state["kept"][q], new, strict=True))
                    best = np.lexsort((new[0], -new[1]))[:k]
                    state["kept"][q] = new = new[0][best], new[1][best]
                    if len(best) == k:  # what comes must reach the k-th found so far
                        with np.errstate(over="ignore", invalid="ignore"):
                            reached = new[1][-1] / state["norm"][q] / unit
                        if np.isfinite(reached):
                            state["least"][q] = max(state["least"][q], reached - 1e-9 * abs(reached))
        if state:
            yield answers()

    met = asks.join(held.select("bundle", "part", "list", "ids", "vs"), ["bundle", "part"])
    found = met.select("bundle", "part", "qblock", "qids", "qvs", "mask", "least", "list", "ids", "vs").mapInPandas(compare, "query_id long, vec_id long, score double")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
