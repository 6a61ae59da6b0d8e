"""Pack token sequences: a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, trimmed

CAPACITY = 1024
END = 2
Pattern = tuple[tuple[int, int], ...]

# ---------------------------------------------------------------- tokens

_encoders: dict = {}


def encoder(tokenizer: str, ranks: str | None = None, pattern: str | None = None):
    """A function from a text to its ids. With a rank file of the same vocabulary the faster library
    encodes, but for texts that spell an added token, which the tokenizer's own file decides."""
    if (tokenizer, ranks) not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(tokenizer)
        own = lambda text: slow.encode(text, add_special_tokens=False).ids
        if ranks is None:
            _encoders[tokenizer, ranks] = own
        else:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            added = [t.content for t in slow.get_added_tokens_decoder().values()]
            _encoders[tokenizer, ranks] = lambda text: own(text) if any(a in text for a in added) else fast.encode_ordinary(text)
    return _encoders[tokenizer, ranks]


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Cut every document into pieces of ``capacity`` tokens at most: doc_id, piece, start, length,
    ids_crc32 and, on request, ids. A document is its ids and then ``end``; a null text is an empty
    one. The first piece takes what the full ones leave. Repeated rows are documents of their own."""
    spec = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        encode = encoder(tokenizer, ranks, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                at, n = 0, len(ids)
                upto = (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    part = ids[at:upto]
                    row = [doc, k, at, len(part), zlib.crc32(part.tobytes())] + [part.astype(np.int32).tolist()] * keep_ids
                    for held, x in zip(out, row, strict=True):
                        held.append(x)
                    at, upto = upto, upto + capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(trimmed(run), spec)


# ---------------------------------------------------------------- the linear program

#: Passes over the weights, and how near to the bound two passes without gain end the search.
PASSES, NEAR = 8, 1.001
#: How much waste raises a weight, and the power of its length by which a length weighs more at first: what is long
#: is hard to place.
GAIN, LONG = 0.5, 0.3
#: What is left of a length counts as nothing below this.
TINY = 1e-9


def _table(lengths: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]]]:
    """The highest total price that fits each capacity, ``most`` copies of a length at most, and the choices that
    lead there. Copies go in as powers of two, so each length is a few passes over all capacities."""
    best, rows = np.zeros(capacity + 1), []
    for i in np.flatnonzero((price > 0) & (most > 0) & (lengths <= capacity)).tolist():
        length, copies, k = int(lengths[i]), min(int(most[i]), capacity // int(lengths[i])), 1
        while copies > 0:
            n = min(k, copies)
            copies, k = copies - n, 2 * k
            new = best[: capacity + 1 - n * length] + n * price[i]
            up = new > best[n * length :] + 1e-12
            if up.any():
                rows.append((i, n, n * length, up))
                best = best.copy()
                best[n * length :][up] = new[up]
    return best, rows


def _filled(rows: list[tuple[int, int, int, np.ndarray]], rooms: np.ndarray, kinds: int) -> np.ndarray:
    """Copies of each length in the best filling of each room, one row a room: all are traced back together."""
    take, room = np.zeros((len(rooms), kinds), np.int64), rooms.copy()
    for i, n, size, up in reversed(rows):
        hit = np.zeros(len(room), bool)
        on = room >= size
        hit[on] = up[room[on] - size]
        take[hit, i] += n
        room[hit] -= size
    return take


def knapsack(lengths: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """(place in ``lengths``: copies) of the highest total price that fit, ``most`` copies at most; and
    that price."""
    best, rows = _table(lengths, price, most, capacity)
    take = _filled(rows, np.array([capacity]), len(lengths))[0]
    return {int(i): int(take[i]) for i in np.flatnonzero(take)}, float(best[capacity])


def cover(lengths: np.ndarray, need: np.ndarray, capacity: int, price: np.ndarray, *, whole: bool) -> tuple[Counter, float]:
    """(uses of patterns that cover ``need`` exactly, the bound that the prices prove): in fractions, or in whole
    numbers.

    A sweep prices patterns by one knapsack over what is left: for each length that is left the best
    pattern that holds it. They are used in order of their price, each as often as what is left of its
    scarcest length allows. The dearest can always be used, so every sweep gets further, until nothing is
    left; there is no other rule that places anything.
    """
    left, used, bound = need.astype(float), Counter(), None
    while (left > 0).any():
        most = np.ceil(left - TINY).astype(np.int64)
        best, rows = _table(lengths, price, most, capacity)
        if bound is None:
            bound = float((price * need).sum() / best[capacity])
        lead = np.flatnonzero(most > 0)
        take = _filled(rows, capacity - lengths[lead], len(lengths))
        take[np.arange(len(lead)), lead] += 1
        take = np.minimum(take, most)
        for row in take[np.argsort(-(take @ price), kind="stable")]:
            on = np.flatnonzero(row)
            n = float((left[on] / row[on]).min())
            n = np.floor(n + TINY) if whole else n
            if n > TINY:
                left[on] -= n * row[on]
                left[left < TINY] = 0
                used[tuple(zip(lengths[on][::-1].tolist(), row[on][::-1].tolist(), strict=True))] += n
    return used, bound or 0.0


def _rounded(used: Counter, lengths: np.ndarray, need: np.ndarray, capacity: int, price: np.ndarray) -> Counter:
    """Whole uses of patterns: a fractional solution rounded down, and what that leaves solved by the same prices
    in whole numbers."""
    place = {x: i for i, x in enumerate(lengths.tolist())}
    down = Counter({p: int(n + TINY) for p, n in used.items() if n + TINY >= 1})
    left = need.copy()
    for pattern, n in down.items():
        for x, k in pattern:
            left[place[x]] -= n * k
    some = left > 0
    rest, _ = cover(lengths[some], left[some], capacity, price[some], whole=True)
    down.update({p: int(n) for p, n in rest.items()})
    return down


def program(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter, int, float]:
    """(uses of patterns that place all of ``counts`` (length: number), a lower bound on the sequences that any
    packing needs, the fewest sequences of a fractional solution found).

    Minimise the uses of configurations so that every length is covered as often as it is needed. The
    weights of lengths are the dual prices: the best configurations under them come from a knapsack by
    dynamic programming, and total price over the best one's price bounds every packing from below, as
    the volume does. Weights start near the lengths. After each pass the weights of lengths that stand in
    wasteful patterns are multiplied up, so that the next pass places them while what fills their gaps
    is still there. Each pass's fractional solution is rounded; the best of PASSES passes counts.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    if not counts:
        return Counter(), 0, 0.0
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths.tolist()])
    place = {x: i for i, x in enumerate(lengths.tolist())}
    weight = (lengths / capacity) ** LONG / capacity
    best, fraction, since, bound = None, float("inf"), 0, -(-int((lengths * need).sum()) // capacity)
    for _ in range(PASSES):
        price = lengths * weight
        used, proved = cover(lengths, need, capacity, price, whole=False)
        bound, fraction, since = max(bound, int(np.ceil(proved - 1e-6))), min(fraction, sum(used.values())), since + 1
        got = _rounded(used, lengths, need, capacity, price)
        if best is None or sum(got.values()) < sum(best.values()):
            best, since = got, 0
        n = sum(best.values())
        if n <= bound or since >= 2 and n <= NEAR * bound:
            break
        for pattern, n in used.items():
            waste = 1 - sum(x * k for x, k in pattern) / capacity
            for x, k in pattern:
                weight[place[x]] *= 1 + GAIN * waste * n * k / counts[x]
    return best, bound, fraction


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """How often to use which pattern, so that all of ``counts`` (length: number) is placed."""
    return program(counts, capacity)[0]


# ---------------------------------------------------------------- placing


def pack(parts: DataFrame, *, capacity: int = CAPACITY, chunk_rows: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to ``parts`` (a table with length, and doc_id, piece to order by).

    The histogram (at most ``capacity`` rows) is solved on the driver, in a second or two; each length's rows are then
    numbered in bounded chunks, and number ranges, a table as small, say which copy of which pattern
    a row goes to. Full rows are sequences of their own. Rows over ``capacity`` or without length are
    an error; an empty table gives no rows.
    """
    spark = parts.sparkSession
    parts = Workspace(spark, "packing").keep(parts, "pieces")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError("a length is missing or doesn't fit")
    ranges, base = [], 0
    if counts.get(capacity):
        ranges, base = [(capacity, 0, counts[capacity], 1, 0, 0)], counts[capacity]
    at: Counter = Counter()
    for pattern, n in sorted(solve({k: v for k, v in counts.items() if k < capacity}, capacity).items()):
        place = 0
        for length, k in pattern:
            ranges.append((length, at[length], at[length] + n * k, k, base, place))
            at[length] += n * k
            place += length * k
        base += n
    table = spark.createDataFrame(ranges, "length_ long, lo long, hi long, each long, base long, place long")
    chunks = max(1, -(-sum(counts.values()) // chunk_rows))
    dealt = parts.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    own = W.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    sums = dealt.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    sums = sums.select(F.col("length").alias("_l"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = dealt.withColumn("_row", F.row_number().over(own) - 1).join(sums, (F.col("length") == F.col("_l")) & (F.col("_chunk") == F.col("_c")))
    rows = rows.withColumn("_at", F.col("_before") + F.col("_row"))
    placed = rows.join(F.broadcast(table), (F.col("length") == F.col("length_")) & (F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi")))
    held = F.col("_at") - F.col("lo")
    return placed.select(*parts.columns, (F.col("base") + F.floor(held / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + held % F.col("each") * F.col("length")).cast("long").alias("offset"))
