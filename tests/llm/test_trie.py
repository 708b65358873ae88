"""The prefix trie against rebuilt texts."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from restgrid.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """{(conv_id, depth, ...)} by rebuilding every conversation."""
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(set)
    for n in members:
        if n:
            children[n[:-1]].add(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    )


def nodes(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in df.collect())


def messy(n=60, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for c in [*range(n), 1001, 1003, -7]:
        if c % 10 == 5:
            continue  # an absent base
        for t in range(int(r.integers(1, 14))):
            rows.append((c, t, "user" if t % 2 == 0 else None, ["hello", "", None, "ünï", f"own {c}"][int(r.integers(0, 5))] if t else "hello"))
    rows += [(40, None, "system", "first"), (40, None, None, None), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 1, "user", "nobody's")]
    return rows


def test_nodes_are_those_of_rebuilt_texts(spark):
    rows = messy()
    df = spark.createDataFrame([(*x, "b", 7) for x in rows], SCHEMA + ", base string, d int")
    assert nodes(trie.prefix_trie(df)) == brute(rows)


def test_long_conversations_in_small_pieces(spark, monkeypatch):
    """Runs, blocks of sums and pieces of ids of a few rows each give the same."""
    monkeypatch.setattr(trie, "RUN", 4)
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE_BITS", 1)
    rows = [(c, t, "user", f"turn {t}" if t < 90 + c % 7 else f"{c} {t}") for c in range(25) for t in range(100)]
    rows += [(c, 0, "user", "alone") for c in range(100, 140)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert nodes(trie.prefix_trie(df)) == brute(rows)


def test_order_of_files_does_not_matter(spark):
    rows = messy(30, 5)
    assert nodes(trie.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5))) == brute(rows)


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_products_compose():
    """The product of two sequences is that of the whole, and own suffixes come by division."""
    base, a, b = trie.BASES[0], [5, 7, 2**63 + 1], [11, 2**64 - 1]
    whole = trie._products(a + b, base)
    left, right = trie._products(a, base)[-1], trie._products(b, base)[-1]
    assert whole[-1] == (left + trie._power(base, len(a)) * right) & trie._M
    assert right == ((whole[-1] - whole[len(a)]) * trie._power(base, -len(a))) & trie._M
    got = trie._powers_at(base, np.array([0, 1, 4096, 10**9]))
    assert got.tolist() == [trie._power(base, n) for n in (0, 1, 4096, 10**9)]


def test_collisions_are_found(spark, monkeypatch):
    """Where different turns have one key, no node is taken for verified, and other keys are tried."""
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(12) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    real, seeds = trie.stored_turns, []

    def poor(conversations, seed):
        seeds.append(seed)
        turns = real(conversations, seed)
        if len(seeds) > 1:
            return turns
        return common.stage(turns.withColumns({"k1": turns.n, "k2": turns.n}), "trie-poor")

    monkeypatch.setattr(trie, "stored_turns", poor)
    assert nodes(trie.prefix_trie(df)) == brute(rows)
    assert len(seeds) == 2
    monkeypatch.setattr(trie, "stored_turns", lambda conversations, seed: common.stage(real(conversations, 1).selectExpr("conv_id", "at", "n as k1", "n as k2", "n", "role", "text"), "trie-poor"))
    with pytest.raises(RuntimeError):
        trie.prefix_trie(df)
