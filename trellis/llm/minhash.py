"""Near-duplicate texts: banded MinHash candidates, Bayesian pruning by signature batches, exact checks."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Workspace, components, mix64, row_back, text_slices, trimmed, with_row, words

WORDS = 5
LEAST, OF = 75, 100
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
#: Chance to prune a pair whose similarity reaches the bound, over all batches.
MISS = 1e-5
#: Classes of one bucket that are compared as one block, and bytes of their shingle sets on average.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Locators that may be broadcast to fetch texts again; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240501)
_MULT = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_STEP = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; fewer words are one shingle."""
    hashes, row, per = words(data, offs)
    ends = np.cumsum(per)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
        for k in range(n):
            runs += hashes[k : k + len(runs)] * _STEP[k]
        runs = mix64(runs)
        out = []
        for i, m in enumerate(per.tolist()):
            at = int(ends[i]) - m
            if m >= n:
                out.append(np.unique(runs[at : at + m - n + 1]))
            elif m:
                out.append(mix64((hashes[at : at + m] * _STEP[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of affine permutations of the shingles' high halves."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 256):
            np.minimum(low, (_MULT[:, None] * x[None, i : i + 256] + _ADD[:, None]).min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (sig.reshape(BANDS, ROWS).astype(np.uint64) * _STEP[None, :ROWS]).sum(axis=1, dtype=np.uint64)
        return mix64(mixed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def least_matches(upto: int, bound: float = LEAST / OF, miss: float = MISS) -> int:
    """The fewest equal hashes of ``upto`` at which similarity >= bound isn't yet ruled out: under a
    uniform prior its posterior chance, a tail of Beta(m + 1, upto - m + 1), stays over ``miss``."""
    for m in range(upto + 1):
        # P(Beta(m+1, n-m+1) >= s) = P(Binomial(n+1, s) <= m)
        tail = sum(comb(upto + 1, k) * bound**k * (1 - bound) ** (upto + 1 - k) for k in range(m + 1))
        if tail > miss:
            return m
    return upto


#: The fewest equal hashes after each batch. Each batch has half its part of the chance, since the
#: posterior's tail understates how often a pair at the bound itself falls short.
_BOUNDS = {n: least_matches(n, miss=MISS * BATCH / HASHES / 2) for n in range(BATCH, HASHES + 1, BATCH)}


def surviving(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two arrays of signatures may reach the bound, batch after batch; their equal hashes."""
    live, equal = np.arange(len(a)), np.zeros(len(a), int)
    for upto in range(BATCH, HASHES + 1, BATCH):
        equal[live] += (a[live, upto - BATCH : upto] == b[live, upto - BATCH : upto]).sum(axis=1)
        live = live[equal[live] >= _BOUNDS[upto]]
    return live, equal


def _class_key(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def _prepare(batches):
    for batch in batches:
        n = batch.num_rows
        cls, size, sigs, keys = [None] * n, np.zeros(n, np.int64), [None] * n, [None] * n
        for i, j, data, offs in text_slices(batch.column(1)):
            for k, s in zip(range(i, j), shingle_sets(data, offs), strict=True):
                if len(s):
                    sig = signature(s)
                    cls[k], size[k], sigs[k], keys[k] = _class_key(s), len(s), sig.tobytes(), band_keys(sig)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cls, pa.string()), pa.array(size), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "loc", "cls", "n", "sig", "keys"])


def _sets(batches):
    for batch in batches:
        cls, sets = [], []
        for _, _, data, offs in text_slices(batch.column(0)):
            for s in shingle_sets(data, offs):
                if len(s):
                    cls.append(_class_key(s))
                    sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.string()), pa.array(sets, pa.binary())], ["cls", "shingles"])


def _stack(col) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in col), np.uint32).reshape(-1, HASHES)


def _prune(frames):
    for f in frames:
        if len(f):
            live, equal = surviving(_stack(f["sig_a"]), _stack(f["sig_b"]))
            yield pd.DataFrame({"a": f["a"].to_numpy()[live], "b": f["b"].to_numpy()[live], "equal": equal[live]})


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """OF * |a and b| >= LEAST * |a or b| for sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LEAST * (len(a) + len(b) - both)


def _verify(frames):
    for f in frames:
        if len(f):
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(f["set_a"], f["set_b"], strict=True)]
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "ok": ok})


def _pack(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("cls")
    out = {"bkey": f["bkey"].iloc[0], "chunk": f["chunk"].iloc[0], "cls": f["cls"].tolist(), "comp": f["comp"].tolist(), "sigs": b"".join(bytes(x) for x in f["sig"])}
    return pd.DataFrame([out | ({"sets": f["shingles"].tolist()} if "shingles" in f else {})])


def _crossing(r):
    """(i, j, equal hashes) of the pairs of two blocks of a bucket that lie in different components and
    survive the pruning, each in the first band that both share only."""
    a, b = np.frombuffer(r.sigs, np.uint32).reshape(-1, HASHES), np.frombuffer(r.sigs_b, np.uint32).reshape(-1, HASHES)
    ca, cb = np.array(r.comp, "U32"), np.array(r.comp_b, "U32")
    na, nb = np.array(r.cls, "U32"), np.array(r.cls_b, "U32")
    band = int(np.flatnonzero(band_keys(a[0]) == r.bkey)[0])
    for i in range(len(a)):
        js = np.flatnonzero((cb != ca[i]) & ((nb > na[i]) if r.chunk == r.chunk_b else True))
        if len(js) and band:
            early = (b[js, : band * ROWS].reshape(len(js), band, ROWS) == a[i, : band * ROWS].reshape(1, band, ROWS)).all(axis=2).any(axis=1)
            js = js[~early]
        if len(js):
            live, equal = surviving(np.broadcast_to(a[i], (len(js), HASHES)), b[js])
            if len(live):
                yield i, js[live], equal[live]


def _concerned(frames):
    """Members of a bucket that have a surviving pair across components."""
    for f in frames:
        for r in f.itertuples():
            on = set()
            for i, js, _ in _crossing(r):
                on.add(r.cls[i])
                on.update(r.cls_b[j] for j in js)
            if on:
                yield pd.DataFrame({"bkey": r.bkey, "cls": sorted(on)})


def _join_across(frames):
    """Exact links across components, as many as it takes to join what two blocks can join: pairs with
    most equal hashes first, and none between what is already joined here."""
    for f in frames:
        for r in f.itertuples():
            found = [(-e, i, j) for i, js, equal in _crossing(r) for j, e in zip(js.tolist(), equal.tolist(), strict=True)]
            if not found:
                continue
            sets_a, sets_b = ([np.frombuffer(x, np.uint64) for x in col] for col in (r.sets, r.sets_b))
            above: dict[str, str] = {}

            def top(x: str, above=above) -> str:
                while x in above:
                    x = above[x]
                return x

            links = []
            for _, i, j in sorted(found):
                p, q = top(r.comp[i]), top(r.comp_b[j])
                if p != q and linked(sets_a[i], sets_b[j]):
                    above[max(p, q)] = min(p, q)
                    links.append((r.cls[i], r.cls_b[j]))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"]).assign(ok=True)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash for every row: links are pairs of shingle sets with
    similarity >= 0.75, found over all rows and confirmed on the full sets.

    Equal sets are one class. A bucket of a band first offers each member with the bucket's smallest
    class (as many pairs as members); pairs whose posterior rules the bound out go, the rest are
    checked exactly, and what is linked is joined into components. Buckets that still hold several
    components are then compared in full, block against block, but only across components: links inside one can't change
    it. Blocks give only the exact links that join components, so no bucket's pairs are ever written
    out, and none is skipped.

    Null and blank texts have no shingles and form components of their own. Repeated rows stay rows;
    a null id never names a component that has another id; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("loc"))
    table = work.keep(rows.mapInArrow(trimmed(_prepare), "doc_id long, loc long, cls string, n long, sig binary, keys array<long>"), "signatures")

    band = table.where("n > 0").select("cls", F.explode("keys").alias("bkey"))
    shared = band.groupBy("bkey").agg(F.min("cls").alias("rep"), F.max("cls").alias("_last")).where("rep <> _last").select("bkey", "rep")
    members = work.keep(band.join(shared, "bkey").distinct(), "members")
    star = members.where("cls <> rep").select(F.col("cls").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = members.select("cls").distinct()
    # one row a class before rows move: copies merge where they are read
    single = table.where("n > 0").groupBy("cls").agg(F.min(F.struct("loc", "sig")).alias("x")).select("cls", "x.loc", "x.sig")
    classes = work.keep(single.join(wanted, "cls", "left_semi"), "classes")
    by = lambda side: classes.select(F.col("cls").alias(side), F.col("sig").alias(f"sig_{side}"))
    pairs = work.keep(star.join(by("a"), "a").join(by("b"), "b").mapInPandas(trimmed(_prune), "a string, b string, equal int"), "survivors")

    sets: DataFrame | None = None

    def fetch(pairs: DataFrame) -> DataFrame:
        """Shingle sets of the classes in ``pairs``, from one text of each."""
        need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        at = work.keep(classes.join(need, "cls", "left_semi").select("cls", "loc"), "wanted")
        hint = F.broadcast if at.count() <= BROADCAST_ROWS else (lambda x: x.hint("shuffle_hash"))
        found = rows.join(hint(at.select("loc").distinct()), "loc", "left_semi")
        got = found.select("text").mapInArrow(trimmed(_sets), "cls string, shingles binary")
        return work.keep(got.join(at.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    def check(pairs: DataFrame) -> DataFrame:
        side = lambda s: sets.select(F.col("cls").alias(s), F.col("shingles").alias(f"set_{s}"))
        return work.keep(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(trimmed(_verify), "a string, b string, ok boolean"), "checked")

    roots: DataFrame | None = None
    tested: DataFrame | None = None

    def join_up() -> DataFrame:
        good = tested.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
        return components(good, work)

    def across(pairs: DataFrame) -> DataFrame:
        """Pairs that are untested and lie in different components."""
        out = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        for side in ("a", "b"):
            out = out.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
        return out.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)

    def settle(pairs: DataFrame) -> None:
        """Check the best pair of each class, join up, then check what still lies across."""
        nonlocal tested, roots
        best = pairs.groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b"))
        for chosen in (lambda: best, lambda: across(pairs)):
            now = work.keep(chosen(), "chosen")
            if now.isEmpty():
                break
            done = check(now)
            tested = done if tested is None else tested.unionByName(done)
            roots = join_up()

    if not pairs.isEmpty():
        sets = fetch(pairs)
        settle(pairs)

    def placed() -> DataFrame:
        """(bkey, cls, comp) of the buckets that hold several components and more than one pair."""
        comp = members.select("bkey", "cls")
        if roots is not None:
            comp = comp.join(roots, F.col("cls") == F.col("node"), "left").select("bkey", "cls", F.coalesce("root", "cls").alias("comp"))
        else:
            comp = comp.withColumn("comp", F.col("cls"))
        split = comp.groupBy("bkey").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi and _n > 2")
        return work.keep(comp.join(split.select("bkey", "_n"), "bkey"), "split")

    def blocks(rows: DataFrame, chunks: F.Column, more: str = "") -> DataFrame:
        """Two blocks of a bucket's members side by side, every two of them once."""
        packed = rows.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.ceil(chunks)).cast("int")).drop("_n", "_bytes").groupBy("bkey", "chunk").applyInPandas(_pack, "bkey long, chunk int, cls array<string>, comp array<string>, sigs binary" + more)
        packed = work.keep(packed, "blocks")
        other = packed.select(F.col("bkey").alias("_bkey"), *[F.col(c).alias(f"{c}_b") for c in packed.columns if c != "bkey"])
        return packed.join(other, (F.col("bkey") == F.col("_bkey")) & (F.col("chunk") <= F.col("chunk_b"))).drop("_bkey")

    left = placed().join(classes.select("cls", "sig"), "cls")
    concerned = work.keep(blocks(left, F.col("_n") / BLOCK).mapInPandas(trimmed(_concerned), "bkey long, cls string").distinct(), "concerned")
    if not concerned.isEmpty():
        sets = fetch(concerned.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
        held = left.drop("_n").join(concerned, ["bkey", "cls"]).join(sets, "cls")
        sizes = concerned.join(sets.select("cls", F.length("shingles").alias("_b")), "cls").groupBy("bkey").agg(F.count("*").alias("_n"), F.sum("_b").alias("_bytes"))
        chunks = F.greatest(F.col("_n") / (BLOCK // 2), F.col("_bytes") / BLOCK_BYTES)
        done = work.keep(blocks(held.join(sizes, "bkey"), chunks, ", sets array<binary>").mapInPandas(trimmed(_join_across), "a string, b string, ok boolean"), "joined")
        tested = done if tested is None else tested.unionByName(done)
        roots = join_up()

    out = table.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.col("loc").alias("text_hash"))
    if roots is not None:
        out = out.join(roots, F.col("cls") == F.col("node"), "left").withColumn("_comp", F.coalesce("root", "cls")).drop("node", "root")
    else:
        out = out.withColumn("_comp", F.col("cls"))
    names = out.where("_comp is not null").groupBy(F.col("_comp").alias("_c")).agg(F.min("doc_id").alias("_first"))
    out = out.join(names, F.col("_comp") == F.col("_c"), "left").withColumn("component_id", F.coalesce("_first", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that represent their component, in their own columns:
    one row a component, the one with the smallest id, then text hash."""
    work = Workspace(docs.sparkSession, "representatives")
    rows = work.keep(near_duplicates(docs).where("kept"), "kept")
    # null ids are components of their own, told apart by their text
    chosen = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("text_hash").alias("_hash")).where("_id is not null")
    chosen = chosen.unionByName(rows.where("doc_id is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    at = with_row(docs, "doc_id").withColumn("_loc", F.xxhash64(F.coalesce(F.col(f"{ROW}.text"), F.lit(""))))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_loc") == F.col("_hash"))
    out = at.join(chosen.hint("shuffle_hash"), on, "left_semi")
    if not rows.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_loc"])
    return row_back(out, docs)
