"""The prefix trie of rebuilt conversations, by composable fingerprints.

A sequence of turns has a fingerprint in a monoid: its length and the sum of key(turn i) * B**i
modulo 2**64, twice.  Products need only these numbers, so a rebuilt conversation's fingerprints
come from those of its base's head and of its own turns, an affine step for a run of its own
turns, and no rebuilt text is made.  Equal fingerprints of equal depth make a node.  Every node is
verified: its members must agree on the parent's fingerprint and the last turn's key, and where
they refer to different stored turns, role and text of those are compared with the smallest
reference's.  Should that fail, all is done again under other keys, so the result is exact.

Turns are dealt by ranges of (conv_id, turn), so a long conversation stands in several tasks: each
contiguous run has its own product, and these are multiplied.  Subtree sums need no walk by
depth: a node's shared words are counted at its smallest member, and a member hands the sum of
what lies below to each node on its path.

Defined cases: rows without a conv_id belong to no conversation; null roles and texts are empty;
turns that tie (or are null) stand by role, then text, and repeated rows one after another; an empty
table has no nodes; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, WORD_STEP, inverse, powers, small_batches, stage

GROUP, HEAD = 5, 8
BASES = (BASE, WORD_STEP)
#: Turns of a run, depths of a block of sums, ids of a piece of a hashed list.
RUN = 1 << 20
BLOCK = 1 << 10
PIECE_BITS = 12
TRIES = 4
_M = (1 << 64) - 1
KEY = ["d", "f1", "f2"]
_ROWS = "c bigint, d bigint, f1 bigint, f2 bigint, p1 bigint, p2 bigint, k1 bigint, k2 bigint, n bigint, ref bigint, is_end boolean"


def _signed(x: int) -> int:
    x &= _M
    return x - (1 << 64) if x >> 63 else x


def _power(base: int, n: int) -> int:
    return pow(base if n >= 0 else inverse(base), abs(n), 1 << 64)


def _powers_at(base: int, n: np.ndarray) -> np.ndarray:
    """base**n for an array of exponents of any size."""
    high, which = np.unique(n >> 12, return_inverse=True)
    top = np.array([_power(base, int(x) << 12) for x in high], np.uint64)
    return top[which] * powers(base, 4096)[n & 4095]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, at, k1, k2, n, role, text), staged: ``at`` follows (conv_id, turn) and names a turn."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    keys = [F.xxhash64(F.lit(seed), "role", "text").alias("k1"), F.xxhash64(F.lit(~seed), "text", "role").alias("k2")]
    return stage(rows.select("conv_id", F.monotonically_increasing_id().alias("at"), *keys, F.octet_length("text").cast("long").alias("n"), "role", "text"), "trie-turns")


def runs(turns: DataFrame) -> DataFrame:
    """Adds ``run`` (the first ``at`` of a contiguous run of a conversation's turns), s1 and s2 (the
    run's product up to the turn) and ``last`` (the run's end)."""
    names = ["conv_id", "at", "k1", "k2", "n", "run", "s1", "s2", "last"]

    def scan(batches):
        before, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.ones(len(at), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (at[1:] != at[:-1] + 1)
            if before is not None:
                new[0] = conv[0] != before[0] or at[0] != before[1] + 1
            new |= at % RUN == 0
            begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
            run = np.where(begin >= 0, at[begin], before[2] if before is not None else 0)
            sums = []
            for j in (0, 1):
                total = np.cumsum(_unsigned(batch.column(2 + j)) * powers(BASES[j], RUN)[at - run])
                less = np.where(begin > 0, total[begin - 1], np.uint64(0))
                if before is not None:
                    less[begin < 0] = np.uint64(-before[3 + j] & _M)
                sums.append(total - less)
            before = (conv[-1], at[-1], run[-1], int(sums[0][-1]), int(sums[1][-1]))
            last = np.append(new[1:], True)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(run), *(pa.array(s.view(np.int64)) for s in sums), pa.array(last)], names=names)
            if held is not None:
                yield held if new[0] else held.set_column(8, "last", pa.array([False]))
            yield out.slice(0, len(at) - 1)
            held = out.slice(len(at) - 1)
        if held is not None:
            yield held

    made = turns.select(*names[:5]).mapInArrow(scan, ", ".join([*(f"{c} bigint" for c in names[:-1]), "last boolean"]))
    return stage(made, "trie-runs")


def conversations_of(rows: DataFrame) -> DataFrame:
    """(c, h, marks, base), staged: each conversation's first HEAD turns and ends of runs, and its base's
    first turns."""
    mark = F.struct("at", "run", "k1", "k2", "n", "s1", "s2", "last")
    marks = rows.where(f"last or at - run < {HEAD}").groupBy("conv_id").agg(F.sort_array(F.collect_list(mark)).alias("marks"))
    head = marks.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base_id"), F.slice("marks", 1, HEAD).alias("base"))
    own = marks.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base_id"), (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).alias("h"), "marks")
    return stage(own.join(head, "base_id", "left").select("c", "h", "marks", "base"), "trie-conversations")


def _products(letters: list[int], base: int) -> list[int]:
    out, step = [0], 1
    for k in letters:
        out.append((out[-1] + k * step) & _M)
        step = step * base & _M
    return out


def _plan(row: dict) -> tuple[list[dict], int, int]:
    """(the base's head, turns of the conversation itself, turns of the rebuilt one)"""
    own = sum(m["at"] - m["run"] + 1 for m in row["marks"] if m["last"])
    head = (row["base"] or [])[: row["h"]]
    return head, own, len(head) + max(0, own - row["h"])


def head_rows(conversations: DataFrame) -> DataFrame:
    """The root and the nodes of the base's head on each rebuilt conversation's path."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                head, _, length = _plan(row)
                made = [_products([m[k] for m in head], base) for k, base in zip(("k1", "k2"), BASES)]
                out.append((row["c"], 0, 0, 0, None, None, 0, 0, 0, -1, length == 0))
                for d, m in enumerate(head, 1):
                    out.append((row["c"], d, *(_signed(x[d]) for x in made), *(_signed(x[d - 1]) for x in made), m["k1"], m["k2"], m["n"], m["at"], d == length))
            kinds = [pa.int64()] * 10 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["c", *KEY, "p1", "p2", "k1", "k2", "n", "ref", "is_end"])

    return conversations.mapInArrow(run, _ROWS)


def steps(conversations: DataFrame) -> DataFrame:
    """For each run of own turns the affine step from its products to the rebuilt ones."""
    names = ["conv_id", "run", "offset", "skip", "head", "length", "x1", "y1", "x2", "y2"]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                head, own, length = _plan(row)
                if own <= row["h"]:
                    continue
                first = row["marks"][: row["h"]]
                start = [(_products([m[k] for m in head], base)[-1], _products([m[k] for m in first], base)[-1]) for k, base in zip(("k1", "k2"), BASES)]
                offset, product = 0, [0, 0]
                for m in row["marks"]:
                    if not m["last"]:
                        continue
                    step = []
                    for j, base in enumerate(BASES):
                        move = _power(base, len(head) - row["h"])
                        step += [_signed(start[j][0] + move * (product[j] - start[j][1])), _signed(move * _power(base, offset))]
                    out.append((row["c"], m["run"], offset, row["h"], len(head), length, *step))
                    product = [(p + _power(base, offset) * m[s]) & _M for p, base, s in zip(product, BASES, ("s1", "s2"))]
                    offset += m["at"] - m["run"] + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names=names)

    return conversations.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def own_rows(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """The nodes of own turns on each rebuilt conversation's path."""
    depth = F.col("offset") + F.col("at") - F.col("run") - F.col("skip") + 1
    kept = rows.drop("last").join(moves, ["conv_id", "run"]).withColumn("d", depth).where("d > 0").withColumn("d", F.col("d") + F.col("head"))
    names = ["conv_id", "d", "k1", "k2", "n", "at", "length", "s1", "s2", "x1", "y1", "x2", "y2"]

    def run(batches):
        for batch in batches:
            col = dict(zip(names, batch.columns))
            d = col["d"].to_numpy(zero_copy_only=False)
            f, p = [], []
            for j, base in zip("12", BASES):
                f.append(_unsigned(col["x" + j]) + _unsigned(col["y" + j]) * _unsigned(col["s" + j]))
                p.append(f[-1] - _unsigned(col["k" + j]) * _powers_at(base, d - 1))
            made = [pa.array(x.view(np.int64)) for x in (*f, *p)]
            yield pa.RecordBatch.from_arrays([col["conv_id"], col["d"], *made, col["k1"], col["k2"], col["n"], col["at"], pa.array(d == col["length"].to_numpy(zero_copy_only=False))], names=["c", *KEY, "p1", "p2", "k1", "k2", "n", "ref", "is_end"])

    return kept.select(*names).mapInArrow(run, _ROWS)


def nodes_of(paths: DataFrame) -> DataFrame:
    """A row for each node, staged; ``even``: its members agree on parent and last turn."""
    same = ["p1", "p2", "k1", "k2", "n"]
    made = paths.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.count_if("is_end").alias("n_ends"), F.min("ref").alias("ref"), F.max("ref").alias("_ref"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"_{c}") for c in same],
    )
    even = F.lit(True)
    for c in same:
        even = even & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stage(made.withColumn("even", even).withColumn("apart", F.col("ref") != F.col("_ref")).drop("_ref", *[f"_{c}" for c in same]), "trie-nodes")


def verified(turns: DataFrame, paths: DataFrame, nodes: DataFrame) -> bool:
    """Every node's members have equal last turns: by one stored turn, or by the texts of several."""
    if not nodes.where("not even").isEmpty():
        return False
    apart = nodes.where("apart").select(*KEY, F.col("ref").alias("low"))
    pairs = paths.select(*KEY, "ref").join(apart, KEY).where("ref <> low").select("ref", "low").distinct()
    mine = turns.select(F.col("at").alias("ref"), "role", "text")
    other = turns.select(F.col("at").alias("low"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    return pairs.join(mine, "ref").join(other, "low").where("role <> _role or text <> _text").isEmpty()


def sums_below(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(d, f1, f2, n_leaves, saved_tokens) of the nodes with several members."""
    shared = nodes.where("n_convs > 1").select(*KEY, "conv_id", "n_convs", (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    first = F.col("c") == F.col("conv_id")
    own = paths.select("c", *KEY, "n", "is_end").join(shared, KEY).select(
        "c", *KEY, F.shiftright("d", BLOCK.bit_length() - 1).alias("block"), F.when(first, (F.col("n_convs") - 1) * F.col("n")).otherwise(0).alias("saved"),
        (F.col("is_end") & ~(first & F.col("leaf"))).cast("long").alias("lost"),
    )
    own = stage(own, "trie-shared")
    later = Window.partitionBy("c").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("c", "block").agg(F.sum("saved").alias("s"), F.sum("lost").alias("l"))
    blocks = blocks.select("c", "block", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("after"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("gone"))
    below = Window.partitionBy("c", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    handed = own.withColumns({"saved": F.sum("saved").over(below), "lost": F.sum("lost").over(below)}).join(blocks, ["c", "block"])
    return handed.groupBy(*KEY).agg(F.sum(1 - F.col("lost") - F.col("gone")).alias("n_leaves"), F.sum(F.col("saved") + F.col("after")).alias("saved_tokens"))


def end_hashes(paths: DataFrame) -> DataFrame:
    """(d, f1, f2, ends_sha256) of nodes at which rebuilt conversations end; the ids are sent in
    pieces of bounded length, in order, and hashed as they come."""
    piece = F.shiftright("c", PIECE_BITS).alias("piece")
    pieces = paths.where("is_end").groupBy(*KEY, piece).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield _hashes(out)
        if key is not None:
            yield _hashes([(*key, digest.hexdigest())])

    def _hashes(rows):
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=[*KEY, "ends_sha256"])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids").mapInArrow(run, "d bigint, f1 bigint, f2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: int = 17) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and ref (the last turn's stored reference, -1 at the root)."""
    small_batches(conversations.sparkSession)
    for attempt in range(TRIES):
        turns = stored_turns(conversations, seed + attempt)
        rows = runs(turns)
        each = conversations_of(rows)
        paths = stage(head_rows(each).unionByName(own_rows(rows, steps(each))), "trie-paths")
        nodes = nodes_of(paths)
        if verified(turns, paths, nodes):
            break
    else:
        raise RuntimeError("keys of turns collided under every seed")
    up = [F.col("d") - 1, F.col("p1"), F.col("p2")]
    children = nodes.where("d > 0").groupBy(*[c.alias(k) for c, k in zip(up, KEY)]).agg(F.count("*").alias("n_children"))
    parents = nodes.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, KEY, "left").join(sums_below(paths, nodes), KEY, "left").join(end_hashes(paths), KEY, "left")
    out = out.join(parents, (up[0] == F.col("_d")) & (up[1] == F.col("_f1")) & (up[2] == F.col("_f2")), "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "ref",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("ref")
