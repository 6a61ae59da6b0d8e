"""The prefix trie of conversations: partial tries of partitions, merged by hashed keys, rolled up to the root."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, release

#: Bytes of the hash that stands for a turn, and for a node (the turns from the root to it).
KEY = 16
ROOT = bytes(KEY)
#: Nodes and ends that a task holds before it hands its partial trie on.
LOCAL = 50_000
#: Bits of an id within one piece of an end list, so that a piece holds 65,536 ids at most; bits by which a
#: round of merges widens the pieces; ids of a merged block; pieces of a node that need no further round.
PIECE, WIDEN, BLOCK, FEW = 16, 12, 1 << 16, 64
#: Depths of the first band of the rollup; each band below is this many times as deep.
BAND = 8
#: A parent with more than this share of all nodes as children, and so many, is broadcast: 1,000 at most.
HOT_SHARE, HOT_LEAST = 1000, 256

_PARTS = "key binary, depth long, n long, lo long, chars long, jumps binary, bin long, ids array<long>"


# ---------------------------------------------------------------- turns


def ordered(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Turns as conv_id, pos (from 1), mark (a hash of role and text), chars (code points of the text) and, on
    request, role and text.

    Turns are ordered by number, null first; equal numbers by mark, so that repeated rows are turns one
    after another. Null role or text is empty. Rows without an id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, KEY)
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), mark.alias("mark"), F.length(text).cast("long").alias("chars"), *([role.alias("role"), text.alias("text")] if texts else []))
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark")
    return rows.where("conv_id is not null").withColumn("pos", F.row_number().over(w).cast("long")).drop("turn")


def share_heads(turns: DataFrame, *, block: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as the first one of their block: the first h turns of that one, then their own
    turns after the first h, where h is the CRC-32 of the decimal id modulo ``most`` + 1. Gives the turns,
    with pos as order only, and the ids, of which some may have no turns. A block's first conversation
    has an id that ``block`` divides; where it is absent, nothing stands for its turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    ids = turns.where("pos = 1").select("conv_id")
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") <= most)).withColumnRenamed("conv_id", "head")
    given = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("head"), h.alias("h")).join(heads, "head").where("pos <= h")
    return turns.where(F.col("pos") > h).unionByName(given.drop("head", "h")), ids


# ---------------------------------------------------------------- partial tries


class Partial:
    """The nodes that a task has met so far, and the conversations that end at each by ranges of ids."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.ends: dict[tuple[bytes, int], list[int]] = {}
        self.held = 0

    def member(self, path: list[bytes], conv: int, chars: int) -> None:
        node = self.nodes.get(path[-1])
        if node is None:
            depth, jumps, step = len(path) - 1, [], 1
            while step <= depth:
                jumps.append(path[depth - step])
                step *= 2
            self.nodes[path[-1]] = [depth, 1, conv, chars, b"".join(jumps)]
        else:
            node[1] += 1
            node[2] = min(node[2], conv)

    def end(self, path: list[bytes], conv: int) -> None:
        self.ends.setdefault((path[-1], conv >> PIECE), []).append(conv)
        self.held += 1

    def full(self) -> bool:
        return len(self.nodes) > LOCAL or self.held > LOCAL

    def rows(self) -> pa.RecordBatch:
        at, ends = list(self.nodes.values()), list(self.ends)
        blank = [None] * len(ends)
        held = [list(self.nodes) + [k for k, _ in ends], *([x[i] for x in at] + blank for i in range(5))]
        held += [[None] * len(at) + [b for _, b in ends], [None] * len(at) + [sorted(x) for x in self.ends.values()]]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, kinds, strict=True)], ["key", "depth", "n", "lo", "chars", "jumps", "bin", "ids"])


def _partial_tries(batches):
    """Rows (conv_id, mark, chars), the turns of a conversation together and in order, each conversation
    headed by a row without a mark."""
    trie, path, conv = Partial(), [ROOT], None
    for batch in batches:
        for c, mark, chars in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if mark is None:
                if conv is not None:
                    trie.end(path, conv)
                    if trie.full():
                        yield trie.rows()
                        trie = Partial()
                conv, path = c, [ROOT]
            else:
                path.append(hashlib.sha256(path[-1] + mark).digest()[:KEY])
            trie.member(path, conv, chars)
    if conv is not None:
        trie.end(path, conv)
        yield trie.rows()
    release()


# ---------------------------------------------------------------- end lists


def _blocks(batches):
    """Pieces (key, wide, bin, ids) in order become blocks of the same key and ``wide`` of BLOCK ids."""
    key, first, ids = None, 0, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["key", "bin", "ids"])

    for batch in batches:
        for k, wide, b, more in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != (k, wide) or len(ids) + len(more) > BLOCK:
                if ids:
                    yield out()
                key, first, ids = (k, wide), b, []
            ids = ids + more
    if ids:
        yield out()


def _digests(batches):
    """SHA-256 of each key's comma-joined ids; its pieces come in order."""
    key, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = ",".join(map(str, ids))
            if k == key:
                state.update(b"," + text.encode())
            else:
                if key is not None:
                    yield out()
                key, state = k, hashlib.sha256(text.encode())
    if key is not None:
        yield out()


def end_digests(lists: DataFrame, work: Workspace) -> DataFrame:
    """(key, ends_sha256) of partial end lists (key, bin, ids).

    Lists of the same key and range of ids are merged first, so that a merged piece holds at most 2^PIECE
    ids. Rounds keyed by node and ever wider ranges then join neighbouring pieces into blocks, until no
    node has many small ones. A node's last hash reads its blocks in order and holds one at a time.
    """
    pieces = work.keep(lists.groupBy("key", "bin").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids")), "pieces")

    def most() -> int:
        return pieces.groupBy("key").count().agg(F.max("count")).first()[0] or 0

    n, shift = most(), WIDEN
    if n <= 1:
        return pieces.select("key", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary"), 256).alias("ends_sha256"))
    while n > FEW and shift + PIECE < 64:
        wide = pieces.select("key", F.shiftright("bin", shift).alias("wide"), "bin", "ids")
        pieces = work.keep(wide.repartition("key", "wide").sortWithinPartitions("key", "bin").mapInArrow(_blocks, "key binary, bin long, ids array<long>"), "blocks")
        n, shift = most(), shift + WIDEN
    return pieces.repartition("key").sortWithinPartitions("key", "bin").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")


# ---------------------------------------------------------------- rollup


def roll_up(nodes: DataFrame, work: Workspace) -> DataFrame:
    """(key, leaves, saved): sums over the subtree of each node (key, depth, jumps, leaves, saved).

    Bands of depths are summed from the deepest up. In a band, round k adds what a node has gathered to its
    ancestor 2^k above, so that a band of d depths takes log2(d) merges; the whole sums of a band's tops
    go to their parents in the band above. A node takes part in the rounds of its own band only.
    """
    top = nodes.agg(F.max("depth")).first()[0]
    if top is None:
        return nodes.select("key", "leaves", "saved")
    edges = [0, BAND]
    while edges[-1] <= top:
        edges.append(edges[-1] * BAND)
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    merged = lambda df: df.groupBy("key").agg(F.max("depth").alias("depth"), F.first("jumps", ignorenulls=True).alias("jumps"), *sums)
    carried, out = None, None
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        band = nodes.where((F.col("depth") >= low) & (F.col("depth") < high)).select("key", "depth", "jumps", "leaves", "saved")
        if carried is not None:
            band = merged(band.unionByName(carried, allowMissingColumns=True))
        for k in range((min(high, top + 1) - low - 1).bit_length()):
            above = F.when(F.col("depth") - 2**k >= low, F.substring("jumps", KEY * k + 1, KEY))
            both = F.array(F.struct("key", "depth", "jumps", "leaves", "saved"), F.struct(above.alias("key"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("binary").alias("jumps"), "leaves", "saved"))
            band = merged(band.select(F.explode(both).alias("e")).select("e.*").where("key is not null"))
        band = work.keep(band, f"band{low}")
        carried = band.where(F.col("depth") == low).groupBy(F.substring("jumps", 1, KEY).alias("key")).agg(*sums)
        part = band.select("key", "leaves", "saved")
        out = part if out is None else out.unionByName(part)
    return out


def _parents(nodes: DataFrame, total: int) -> DataFrame:
    """Nodes with the smallest member of their parent. Parents of very many children are at most
    HOT_SHARE, and broadcast, so that no task reads all the children of one."""
    hot = F.col("n_children") > max(HOT_LEAST, total // HOT_SHARE)
    names = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    few, rest = F.broadcast(names.where(hot).drop("n_children")), names.where(~hot).drop("n_children")
    below = nodes.where("depth > 0").withColumn("parent", F.substring("jumps", 1, KEY))
    known = below.join(few, "parent").unionByName(below.join(few, "parent", "left_anti").join(rest, "parent")).drop("parent")
    return known.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, pos, mark, chars, as ``ordered`` gives them):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, all but the last long.

    ``ids`` (conv_id) may name conversations without turns; they are members of the root alone. A node is
    a distinct sequence of turns, known by a hash of 128 bits; only hashes and sizes move, no texts. Tasks
    combine what they hold before anything is shuffled, whole sums by node follow. The turns of one
    conversation pass through one task in order, which keeps 16 bytes a turn of it. A table without
    conversations has no root and gives no rows; the root has no parent (null) and no text.
    """
    work = Workspace(turns.sparkSession, "trie")
    first = (turns if ids is None else ids).select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("chars"))
    rows = turns.select("conv_id", "pos", "mark", "chars").unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    parts = work.keep(rows.select("conv_id", "mark", "chars").mapInArrow(_partial_tries, _PARTS), "parts")
    nodes = parts.where("bin is null").groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("lo").alias("conv_id"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.first("jumps").alias("jumps"))
    nodes = work.keep(nodes, "merged")
    children = nodes.where("depth > 0").groupBy(F.substring("jumps", 1, KEY).alias("key")).agg(F.count("*").alias("n_children"))
    nodes = work.keep(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    sums = roll_up(nodes.select("key", "depth", "jumps", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), work)
    ends = end_digests(parts.where("bin is not null").select("key", "bin", "ids"), work)
    out = _parents(nodes, nodes.count()).join(sums, "key").join(ends, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def with_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn, null at the root. ``turns`` are those that the trie was
    built from, with texts, and with pos counted from 1 without gaps."""
    last = turns.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")
