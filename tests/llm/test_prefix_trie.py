"""The prefix trie against a plain one in Python, and against SQL on the given tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from trellis.llm import prefixtrie, queries

from tests.conftest import rows as table_rows

SPEC = "conv_id long, turn long, role string, text string, pos string, mark int, key double"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SPEC)


def plain(convs):
    """Nodes of a dict id -> list of (role, text), each by itself."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)

    sums = {}
    for n in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids[n]]
        own = (len(members[n]) - 1) * len(n[-1][1]) if n else 0
        sums[n] = (sum(x for x, _ in below) or 1, own + sum(y for _, y in below))
    out = []
    for n, who in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(kids[n]), *sums[n], digest))
    return sorted(out, key=str)


def rebuilt(rows):
    """The contract's conversations, from rows without ties."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in by}
    return {c: by.get(c - int(np.fmod(c, 100)), [])[: h[c]] + v[h[c] :] for c, v in by.items()}


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in df.dtypes[:-1]} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=str)


def check(spark, rows):
    turns = prefixtrie.ordered(made(spark, rows))
    assert got(prefixtrie.trie(*prefixtrie.share_heads(turns))) == plain(rebuilt(rows))


def test_rebuilt_conversations(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), t, str(rng.choice(["user", "tool"])), str(rng.choice(["a", "bé", "🙂", "", "long text"]))) for c in [*range(0, 40), *range(100, 130), *range(205, 215), 7_000_000_001, 99_999_999_900] for t in range(rng.integers(1, 9))]
    rows += [(0, None, None, None), (17, None, "user", None), (None, 1, "user", "a"), (None, None, None, None), (-3, 0, "a", "b"), (-105, 1, "a", "b"), (-100, 0, "c", "d")]
    order = rng.permutation(len(rows))
    check(spark, [rows[i] for i in order])
    assert any(not v for v in rebuilt(rows).values())


def test_empty_table_and_repeated_rows(spark):
    assert prefixtrie.trie(*prefixtrie.share_heads(prefixtrie.ordered(made(spark, [])))).collect() == []
    assert prefixtrie.trie(prefixtrie.ordered(made(spark, [(None, 1, "a", "b")]))).collect() == []
    twice = prefixtrie.trie(prefixtrie.ordered(made(spark, [(1, 0, "a", "x"), (1, 0, "a", "x"), (2, 5, "a", "x")])))
    assert got(twice) == plain({1: [("a", "x")] * 2, 2: [("a", "x")]})


def test_role_and_text_do_not_run_together(spark):
    assert got(prefixtrie.trie(prefixtrie.ordered(made(spark, [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc")])))) == plain({1: [("ab", "c")], 2: [("a", "bc")], 3: [("", "abc")]})


@pytest.mark.parametrize("length", [7, 8, 9, 63, 64, 65, 600])
def test_deep_conversations(spark, length):
    convs = {1: [("u", str(i % 7)) for i in range(length)], 2: [("u", str(i % 7)) for i in range(length // 2)], 3: [("u", str(i % 7)) for i in range(length // 2)] + [("v", "w")] * 3}
    turns = prefixtrie.ordered(made(spark, [(c, i, *t) for c, v in convs.items() for i, t in enumerate(v)]))
    assert got(prefixtrie.trie(turns)) == plain(convs)


def test_hot_nodes_and_end_lists(spark, monkeypatch):
    """One text begins and ends most conversations; ids dense, sparse and negative; small pieces and parts."""
    for name, value in (("LOCAL", 20), ("PIECE", 3), ("WIDEN", 2), ("BLOCK", 16), ("FEW", 2), ("HOT_LEAST", 5), ("HOT_SHARE", 20)):
        monkeypatch.setattr(prefixtrie, name, value)
    rng = np.random.default_rng(4)
    ids = [*range(-70, 150), *(int(x) for x in rng.integers(-(2**62), 2**62, 60)), 2**63 - 1, -(2**63)]
    convs = {c: [("u", "hi")] * (k % 3 > 0) + [("v", str(k))] * (k % 5 == 0) for k, c in enumerate(ids)}
    turns = prefixtrie.ordered(made(spark, [(c, i, *t) for c, v in convs.items() for i, t in enumerate(v)]))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert got(prefixtrie.trie(turns.repartition(6), ids.repartition(3))) == plain(convs)


def test_texts_of_nodes(spark):
    turns = prefixtrie.ordered(made(spark, [(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "a", "x")]), texts=True)
    got = prefixtrie.with_texts(prefixtrie.trie(turns), turns)
    assert sorted(((r.depth, r.role, r.text) for r in got.collect()), key=str) == [(0, None, None), (1, "a", "x"), (2, "b", "y")]


def test_query_equals_sql_and_a_plain_trie(spark, sf, duck):
    df = queries.op11_prefix_trie(spark, sf)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(df) == plain(rebuilt(rows))
    assert table_rows(df.toPandas()) == table_rows(duck.sql(queries.TRIE_SQL).df())
