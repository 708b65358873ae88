"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another.

A text (with a space before it) is cut into units where both tokenizers always end a token: at the
first one's pre-tokens, between two characters that stand side by side in no piece of the second.
Equal units have equal tokens, groups and links, so each worker encodes a unit once and keeps
it in a cache.  The first pass links every document's tokens and counts, for each distinct pair of
ids, the documents that hold it: tasks send sorted pairs with counts, these are merged in a tree,
and every shard of A ids gets a minimal perfect hash of its pairs, by which its count vector is
indexed.  The second pass aligns the documents again and looks the counts up, comparing the key that
stands at each index.  Tables go to tasks in blocks of at most BLOCK pairs; a further block is a
further pass.  A shard has at most 1/SHARDS of the pairs that two vocabularies can make.

Defined cases: null and empty texts, and texts that either tokenizer's tokens don't give back byte by
byte (a literal piece marker), have no tokens: zeros, '' for the groups, and no part in counts; rows
that repeat an id, or have none, are documents of their own; very long texts are aligned in
windows, a unit as a whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain, repeat
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Bytes, documents, mix, small_batches, stage
from .pretokens import BLANK, char_kinds, classes, code_points, distinct, split, tokenizer, windows

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: A pair is a << B_BITS | b.
B_BITS = 15
SHARDS = 64
BLOCK = 1 << 24
#: Pairs that a task holds before it sends them, cached units and their links.
HELD = 1 << 21
CACHED = 1 << 19
CACHED_LINKS = 1 << 23
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_PAIR_SHIFT = np.int64(21)


class Pair:
    """Two tokenizers, the bytes of each one's tokens, and where units may be cut."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers.pre_tokenizers import ByteLevel

        self.a, self.b = tokenizer(a_path, True), sentencepiece.SentencePieceProcessor(model_file=b_path)
        # characters that stand for bytes: those of printable Latin-1 for themselves, others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelt = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
        assert set(spelt) == set(ByteLevel.alphabet())
        words = [w for w, _ in sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])]
        self.a_raw = [bytes(spelt.get(c, 0) for c in w) for w in words]
        n = self.b.get_piece_size()
        if n > 1 << B_BITS or len(words) > 1 << (31 - B_BITS):
            raise ValueError("ids must fit in 31 bits together")
        byte, pieces = self.b.piece_to_id("<0x00>"), [self.b.id_to_piece(i) for i in range(n)]
        self.b_raw = [bytes([i - byte]) if self.b.is_byte(i) else w.replace(MARKER, " ").encode() for i, w in enumerate(pieces)]
        self.tables = [(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)) for raw in (self.a_raw, self.b_raw)]
        self.names = [[str(i) for i in range(max(n, len(words)))]] * 2
        inner = {(x, y) for i, w in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for x, y in zip(w, w[1:])}
        # a line feed ends a token on both sides, and cuts at a space between letters are safe
        if any("\n" in p for p in inner) or any(y == MARKER and x.isascii() and x.isalpha() for x, y in inner):
            raise ValueError("pieces that go on beyond a line feed or into a space")
        self.inner = np.array(sorted(ord(x) << 21 | ord(y) for x, y in inner), np.int64)
        self.store = Store(self)

    def may_cut(self, before: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Whether no piece has the two characters side by side."""
        pairs = (np.where(before == 0x20, ord(MARKER), before).astype(np.int64) << _PAIR_SHIFT) | np.where(here == 0x20, ord(MARKER), here)
        at = np.minimum(np.searchsorted(self.inner, pairs), len(self.inner) - 1)
        return self.inner[at] != pairs

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B the ids of all units one after another, and how many each has."""
        # units are words that are split on their own; A gives back every byte, which tells whose a token is
        a = np.array(self.a.encode_batch_fast([texts], add_special_tokens=False, is_pretokenized=True)[0].ids, np.int64)
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        a = a, np.diff(np.searchsorted(np.cumsum(self.tables[0][1][a]), ends, "right"), prepend=0)
        # the space that B adds and a line feed stand before a unit, and are taken off
        return [a, _flat([x[2:] for x in self.b.encode(["\n" + t for t in texts], num_threads=1)])]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x in order, and where a new value begins."""
    x, new = np.sort(x), np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x, new


def _distinct(x: np.ndarray) -> np.ndarray:
    x, new = _sorted(x)
    return x[new]


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _spread(values: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values[off[r]:off[r + 1]] of all rows one after another, and how many each has."""
    size = off[rows + 1] - off[rows]
    ends = np.cumsum(size)
    return values[np.repeat(off[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros((2 * n, *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


class Store:
    """A worker's cache of aligned units, a row for each: counts (n_a, n_b, n_groups; all 0 where the
    tokens don't give the unit), links[off[i]:off[i + 1]], and groups as text where wanted."""

    def __init__(self, known: Pair):
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.counts, self.off, self.links, self.groups = np.zeros((1024, 3), np.int64), np.zeros(1025, np.int64), np.zeros(4096, np.uint32), []

    def find(self, units: list[bytes], text: bool) -> np.ndarray:
        """The row of each of some distinct units; rows hold until the next call."""
        if text and len(self.groups) < len(self.rows):
            self.clear()  # aligned without their groups before
        rows = np.fromiter(map(self.rows.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(rows < 0)
        if len(self.rows) + len(new) > CACHED or self.off[len(self.rows)] > CACHED_LINKS:
            self.clear()
            new = np.arange(len(units))
        rows[new] = np.arange(len(self.rows), len(self.rows) + len(new))
        fresh = [units[i] for i in new.tolist()]
        for k in range(0, len(fresh), 8192):
            self._add(fresh[k : k + 8192], text)
        return rows

    def _add(self, units: list[bytes], text: bool) -> None:
        size = np.array([len(u) for u in units], np.int64)
        ids = self.known.encode([u.decode() for u in units])
        right = np.ones(len(units), bool)
        for (flat, n), (raw, sizes) in zip(ids, self.known.tables):
            right &= self._gives(flat, n, raw, sizes, units, size)
        if not right.all():
            ids = [(flat[np.repeat(right, n)], np.where(right, n, 0)) for flat, n in ids]
        ends = np.cumsum(np.where(right, size, 0))
        flat, n = zip(*ids)
        stop = [np.cumsum(sizes[x]) for x, (_, sizes) in zip(flat, self.known.tables)]
        every, new = _sorted(np.concatenate(stop))
        every, both = every[new], every[~new]
        links = (flat[0][np.searchsorted(stop[0], every)] << B_BITS | flat[1][np.searchsorted(stop[1], every)]).astype(np.uint32)
        until, grouped = np.searchsorted(every, ends, "right"), np.searchsorted(both, ends, "right")
        at, off = len(self.rows), self.off[len(self.rows)]
        self.counts, self.off, self.links = _grown(self.counts, at + len(units)), _grown(self.off, at + len(units) + 1), _grown(self.links, off + len(links))
        self.counts[at : at + len(units)] = np.stack([*n, np.diff(grouped, prepend=0)], axis=1)
        self.off[at + 1 : at + len(units) + 1] = off + until
        self.links[off : off + len(links)] = links
        if text:
            cuts = [[0, *np.searchsorted(s, both, "right").tolist()] for s in stop]
            words = [[names[i] for i in x.tolist()] for names, x in zip(self.known.names, flat)]
            made = [f"{','.join(words[0][a:z])}|{','.join(words[1][b:y])}" for a, z, b, y in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])]
            self.groups += [made[a] if z == a + 1 else ";".join(made[a:z]) for a, z in zip([0, *grouped[:-1].tolist()], grouped.tolist())]
        self.rows.update(zip(units, range(at, at + len(units))))

    @staticmethod
    def _gives(ids: np.ndarray, n: np.ndarray, raw: np.ndarray, sizes: np.ndarray, units: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the bytes of each unit's tokens are the unit."""
        made = _spread(raw, np.concatenate([[0], np.cumsum(sizes)]), ids)[0].tobytes()
        if made == b"".join(units):
            return np.ones(len(units), bool)
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(n)]
        return np.array([made[a:z] == u for a, z, u in zip([0, *ends[:-1].tolist()], ends.tolist(), units)])


def unit_windows(column: pa.Array, packed: bytes, paths: tuple[str, str], text: bool):
    """(owner, first, which, rows, store) for the windows of a column of texts: the units of piece i of a
    window are which[first[i]:first[i + 1]], numbers of distinct units with these rows of the store,
    and piece i is of text owner[i]."""
    known = pair(*paths)
    b = Bytes(column, lower=False)
    full = np.diff(b.off) > 0
    spaced = Bytes.of(np.insert(b.data, b.off[:-1][full], 0x20), b.off + np.concatenate([[0], np.cumsum(full)]))
    for w, owner in windows(spaced):
        starts = split(w, packed)[0]
        lead = np.flatnonzero((w.data & 0xC0) != 0x80)
        cp, at = code_points(w.data, lead), np.searchsorted(lead, starts)
        before = cp[np.maximum(at - 1, 0)]
        safe, blank = known.may_cut(before, cp[at]), char_kinds(packed)[before] == BLANK
        begin = np.searchsorted(starts, w.off[:-1])
        safe[begin], blank[begin] = True, False
        # white space that is two pre-tokens before other text would be one at a unit's end
        after = np.append(True, safe[:-1]) | ~np.append(False, blank[:-1])
        cut = safe & (after | ~blank)
        cut[begin] = True
        starts = starts[cut]
        ends = np.append(starts[1:], len(w.data))
        _, one, which = distinct(w, starts, ends)
        raw = w.data.tobytes()
        rows = known.store.find([raw[x:y] for x, y in zip(starts[one].tolist(), ends[one].tolist())], text)
        yield owner, np.searchsorted(starts, w.off), which, rows, known.store


class Perfect:
    """Minimal perfect hash of distinct keys: at each level the keys that have a slot to themselves
    stay there, others go on to the next; a key's index is the rank of its slot."""

    def __init__(self, words: list[np.ndarray]):
        self.words, self.rank, before = words, [], 0
        for w in words:
            ends = before + np.cumsum(np.bitwise_count(w), dtype=np.int64)
            self.rank.append(np.concatenate([[before], ends[:-1]]).astype(np.int64))
            before = int(ends[-1])

    @staticmethod
    def _slots(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return ((mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> "Perfect":
        words, left = [], keys.astype(np.uint64)
        while len(left):
            n = -(-2 * len(left) // 64) * 64
            slots = cls._slots(left, len(words), n)
            alone = np.bincount(slots, minlength=n) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[slots]]
        return cls(words)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of others any index, or -1."""
        out, live, left = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys.astype(np.uint64)
        for level, (words, rank) in enumerate(zip(self.words, self.rank)):
            slots = self._slots(left, level, len(words) * 64)
            word, bit = words[slots >> 6], (slots & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[live[hit]] = rank[slots[hit] >> 6] + below
            live, left = live[~hit], left[~hit]
        return out


_PARTIAL = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("g", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("keys", "counts"))])
_PARTIAL_ARROW = pa.schema([("r", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TABLE = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("levels", T.ArrayType(T.BinaryType())), *(T.StructField(c, T.BinaryType()) for c in ("keys", "counts", "best"))])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    values, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, which, np.concatenate(counts))
    return values, total


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _summed([np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()], [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])


def pair_counts(docs: DataFrame, a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """(r, n, levels, keys, counts, best), staged: for each shard of A ids the levels of its pairs'
    perfect hash, and by index the key, its documents, and whether no pair of its A id has more."""
    small_batches(docs.sparkSession)
    paths, packed = (a_path, b_path), classes()
    fan = isqrt(max(1, docs.rdd.getNumPartitions() - 1)) + 1
    shard = lambda keys: (keys >> np.uint32(B_BITS)) % np.uint32(SHARDS)

    def send(keys, counts, g):
        r = shard(keys)
        order = np.argsort(r, kind="stable")
        cuts = np.searchsorted(r[order], np.arange(SHARDS + 1))
        rows = [(i, g, keys[order[a:z]].tobytes(), counts[order[a:z]].tobytes()) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PARTIAL_ARROW)], schema=_PARTIAL_ARROW) if rows else pa.RecordBatch.from_pylist([], schema=_PARTIAL_ARROW)

    def count(batches):
        from pyspark import TaskContext

        g = TaskContext.get().partitionId() % fan
        keys, counts, held = [], [], 0
        for batch in batches:
            found, lost = [], np.zeros(batch.num_rows, bool)
            for owner, first, which, rows, store in unit_windows(batch.column(0), packed, paths, False):
                n = len(rows)
                mine = _distinct(np.repeat(owner, np.diff(first)) * n + which)  # a document's distinct units
                of, unit = mine // n, rows[mine % n]
                lost[of[store.counts[unit, 0] == 0]] = True
                links, size = _spread(store.links, store.off, unit)
                found.append(_distinct(np.repeat(of, size).astype(np.uint64) << np.uint64(32) | links))
            if not found:
                continue
            each = _distinct(np.concatenate(found)) if len(found) > 1 else found[0]
            each = each[~lost[(each >> np.uint64(32)).astype(np.int64)]].astype(np.uint32)
            values, n = np.unique(each, return_counts=True)
            keys.append(values)
            counts.append(n)
            held += len(values)
            if held > HELD:
                merged = _summed(keys, counts)
                keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held > HELD // 2:
                    yield send(*merged, g)
                    keys, counts, held = [], [], 0
        if keys:
            yield send(*_summed(keys, counts), g)

    def join(table: pa.Table) -> pa.Table:
        keys, counts = _merge(table)
        return pa.table([table.column("r")[:1], table.column("g")[:1], pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=_PARTIAL_ARROW)

    def index(table: pa.Table) -> pa.Table:
        keys, counts = _merge(table)
        perfect, of = Perfect.of(keys), keys >> np.uint32(B_BITS)
        most = np.zeros(int(of.max()) + 1, np.int64)
        np.maximum.at(most, of, counts)
        place = np.empty(len(keys), np.int64)
        place[perfect.index(keys)] = np.arange(len(keys))
        made = keys[place].tobytes(), counts[place].tobytes(), (counts == most[of])[place].tobytes()
        return pa.table([table.column("r")[:1], pa.array([len(keys)], pa.int64()), pa.array([[w.tobytes() for w in perfect.words]], pa.list_(pa.binary())), *(pa.array([x], pa.binary()) for x in made)], names=["r", "n", "levels", "keys", "counts", "best"])

    partial = docs.select("text").mapInArrow(count, _PARTIAL)
    if fan > 1:
        partial = partial.groupBy("r", "g").applyInArrow(join, _PARTIAL)
    return stage(partial.groupBy("r").applyInArrow(index, _TABLE), "alignment-pairs")


class Counts:
    """Count vectors of a few shards, as they are sent to tasks."""

    def __init__(self, rows):
        self.shards = {row["r"]: tuple(map(bytes, (row["keys"], row["counts"], row["best"]))) for row in rows}
        self.levels = {row["r"]: [bytes(x) for x in row["levels"]] for row in rows}
        self.open: dict[int, tuple] = {}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, best) of each key; 0 for those of other blocks, and of texts without tokens."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        r = (keys >> np.uint32(B_BITS)) % np.uint32(SHARDS)
        for i, raw in self.shards.items():
            at = np.flatnonzero(r == i)
            if not len(at):
                continue
            if i not in self.open:
                self.open[i] = (Perfect([np.frombuffer(x, np.uint64) for x in self.levels[i]]), *(np.frombuffer(x, k) for x, k in zip(raw, (np.uint32, np.int64, bool))))
            perfect, own, counts, high = self.open[i]
            place = perfect.index(keys[at])
            seen = own[place] == keys[at]
            count[at], best[at] = np.where(seen, counts[place], 0), seen & high[place]
        return count, best


def _blocks(table: DataFrame) -> list[list[int]]:
    """Shards in blocks of at most BLOCK pairs (a shard of more stands alone)."""
    blocks, held = [], 0
    for r, n in sorted(map(tuple, table.select("r", "n").collect())):  # SHARDS rows at most
        if not blocks or held + n > BLOCK:
            blocks, held = [*blocks, []], 0
        blocks[-1].append(r)
        held += n
    return blocks or [[]]


def alignments(docs: DataFrame, a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 in place of
    columns of these names."""
    table = pair_counts(docs, a_path, b_path)
    paths, packed = (a_path, b_path), classes()
    row = [c for c in docs.columns if c.lower() not in (*NAMES, "groups_sha256")]
    names = [f"c{i}" for i in range(len(row))]
    text = names[row.index("text")]
    made = [*NAMES, "groups_sha256"]
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(row, names)])
    own = [f"{f.name} {f.dataType.simpleString()}" for f in out.schema]
    kinds = ", ".join([*own, *(f"{c} bigint" for c in NAMES), "groups_sha256 string"])

    def look_up(counts: Counts, more: bool):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                sums, lost, digests = np.zeros((len(NAMES), n), np.int64), np.zeros(n, bool), {}
                for owner, first, which, rows, store in unit_windows(batch.column(batch.schema.get_field_index(text)), packed, paths, not more):
                    links, size = _spread(store.links, store.off, rows)
                    values, of = np.unique(links, return_inverse=True)
                    found = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(np.stack(counts.find(values))[:, of], axis=1)], axis=1)
                    ends = np.cumsum(size)
                    linked = found[:, ends] - found[:, ends - size]
                    each = np.concatenate([store.counts[rows].T, size[None], linked[1:], linked[:1]])
                    total = np.concatenate([np.zeros((len(NAMES), 1), np.int64), np.cumsum(each[:, which], axis=1)], axis=1)
                    np.add.at(sums, (slice(None), owner), total[:, first[1:]] - total[:, first[:-1]])
                    bad = np.concatenate([[0], np.cumsum(each[0][which] == 0)])
                    lost[owner[bad[first[1:]] > bad[first[:-1]]]] = True
                    if more:
                        continue
                    groups = [store.groups[i] for i in rows.tolist()]
                    for i, a, z in zip(owner.tolist(), first[:-1].tolist(), first[1:].tolist()):
                        part = ";".join([groups[u] for u in which[a:z].tolist()]).encode()
                        if i in digests:
                            digests[i].update(b";" + part)
                        else:
                            digests[i] = hashlib.sha256(part)
                sums[:, lost] = 0
                if more:
                    old = [batch.column(batch.schema.get_field_index(c)) for c in made]
                    sums[:4] = 0
                    cols = [*(pa.array(s + o.to_numpy(zero_copy_only=False)) for s, o in zip(sums, old)), old[-1]]
                else:
                    cols = [*map(pa.array, sums), pa.array(["" if i not in digests or lost[i] else digests[i].hexdigest() for i in range(n)], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*names, *made])

        return run

    for k, block in enumerate(_blocks(table)):
        counts = Counts(table.where(F.col("r").isin(block)).collect() if block else [])  # BLOCK pairs at most
        if k:
            out = stage(out, "alignment-block")
        out = out.mapInArrow(look_up(counts, k > 0), kinds)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, row)], *made)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
