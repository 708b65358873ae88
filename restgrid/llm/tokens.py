"""Token counts by a map-side two-tier lookup.

A text's tokens are those of its pre-tokens, so its count is a sum of pre-token lengths.  One pass
over all documents keeps a bounded summary of frequent pre-tokens in each task (counters that are
lowered together when there are too many, so none with a share above 1 / HELD is lost); the
summaries, a row a task, are merged, and the library's lengths of the most frequent ones go to
every task as a compact hash table (first tier).  The counting pass looks up each distinct
pre-token of a window, compares its bytes, and encodes misses by the library through a cache that
lives as long as the worker (second tier).  No pre-token is shuffled; which are in the table decides
the time, never a count.

Defined cases: null and empty texts have no bytes and no tokens; null and repeated ids stay rows of
their own; a special string inside a text is one token, as the library's default has it; very long
texts are counted in windows; an empty table gives an empty result; columns with the names of
the results are replaced in ``token_counts``.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bytes, documents, pack, small_batches, unpack
from .pretokens import classes, distinct, same_bytes, split, tokenizer, windows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LIMIT = 1024
#: Pre-tokens in the table at most, and their bytes.
TABLE = 1 << 16
WIDTH = 64
#: Counters of a task, pre-tokens that its summary sends on, and tasks that merge summaries.
HELD = 1 << 17
SENT = 1 << 13
MERGERS = 16
#: Entries of a worker's cache, and the bytes of the longest pre-token that it keeps.
CACHED = 1 << 19
CACHED_WIDTH = 256


def special_of(path: str) -> bytes:
    """The special string of a vocabulary file (one at most), which its library finds inside texts."""
    found = [t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values()]
    if len(found) > 1:
        raise ValueError("a vocabulary with one special string is expected")
    return found[0] if found else b""


class Lengths:
    """Open-addressed hash table: pre-token -> number of tokens; keys are compared by their bytes."""

    def __init__(self, words: list[bytes], lengths: list[int]):
        size = np.array([len(w) for w in words], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        b = Bytes.of(np.frombuffer(b"".join(words), np.uint8), off)
        self.hash, at, _ = distinct(b, off[:-1], off[1:]) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), None)
        self.data, self.at, self.size, self.length = b.data, off[:-1][at], size[at], np.array(lengths, np.int32)[at]
        self.mask = np.uint64((1 << max(4, (2 * len(words)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        for i, place in enumerate((self.hash & self.mask).tolist()):
            while self.slots[place] >= 0:
                place = (place + 1) & int(self.mask)
            self.slots[place] = i

    def find(self, h: np.ndarray, b: Bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Lengths of the spans, -1 for those that are not in the table."""
        out, live, place = np.full(len(h), -1, np.int32), np.arange(len(h)), h & self.mask
        size = ends - starts
        while len(live):
            entry = self.slots[place]
            full = entry >= 0
            live, place, entry = live[full], place[full], entry[full]
            like = (self.hash[entry] == h[live]) & (self.size[entry] == size[live])
            own, hit = live[like], entry[like]
            same = same_bytes(b.data, starts[own], self.data, self.at[hit], size[own])
            out[own[same]] = self.length[hit[same]]
            on = out[live] < 0
            live, place = live[on], (place[on] + np.uint64(1)) & self.mask
        return out


_CACHES: dict[str, dict[bytes, int]] = {}


def encoded_lengths(path: str, words: list[bytes]) -> list[int]:
    """The library's number of tokens of each pre-token, through the worker's cache."""
    cache = _CACHES.setdefault(path, {})
    new = list({w for w in words if w not in cache})
    got = {}
    for a in range(0, len(new), 4096):
        part = new[a : a + 4096]
        got.update(zip(part, (len(e.ids) for e in tokenizer(path).encode_batch_fast([w.decode() for w in part], add_special_tokens=False))))
    out = [got[w] if w in got else cache[w] for w in words]
    if len(cache) + len(got) > CACHED:
        for w in list(islice(cache, CACHED // 2)):  # the oldest
            del cache[w]
    cache.update((w, n) for w, n in got.items() if len(w) <= CACHED_WIDTH)
    return out


def lower_all(counts: dict[bytes, int], most: int) -> dict[bytes, int]:
    """The ``most`` largest counters, all lowered by the largest of the rest."""
    if len(counts) <= most:
        return counts
    kept = heapq.nlargest(most + 1, counts.items(), key=lambda x: (x[1], x[0]))
    rest = kept.pop()[1]
    return {w: n - rest for w, n in kept if n > rest}


_SUMMARY = "n int, words binary, sizes binary, counts binary"


def _packed(counts: dict[bytes, int]) -> pa.RecordBatch:
    top = heapq.nlargest(SENT, counts.items(), key=lambda x: (x[1], x[0]))
    words = [w for w, _ in top]
    row = (len(top), b"".join(words), pack(np.array([len(w) for w in words], np.int32)), pack(np.array([n for _, n in top], np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["n", "words", "sizes", "counts"])


def _unpacked(row: dict):
    ends = np.cumsum(unpack(row["sizes"], row["n"], np.int32))
    for a, z, n in zip([0, *ends[:-1].tolist()], ends.tolist(), unpack(row["counts"], row["n"], np.int64).tolist()):
        yield row["words"][a:z], n


def frequent(docs: DataFrame, path: str = VOCABULARY) -> list[bytes]:
    """The most frequent pre-tokens of all documents by bounded summaries, at most TABLE."""
    special, known = special_of(path), classes()

    def summarise(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for b, _ in windows(Bytes(batch.column(0), lower=False)):
                starts, ends, _, fixed = split(b, known, special)
                _, at, which = distinct(b, starts, ends)
                often = np.bincount(which, minlength=len(at))
                often[which[fixed]] = 0
                short = np.flatnonzero((ends[at] - starts[at] <= WIDTH) & (often > 0))
                raw = b.data.tobytes()
                for x, y, n in zip(starts[at[short]].tolist(), ends[at[short]].tolist(), often[short].tolist()):
                    w = raw[x:y]
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > 2 * HELD:
                    counts = lower_all(counts, HELD)
        if counts:
            yield _packed(counts)

    def merge(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for w, n in _unpacked(row):
                    counts[w] = counts.get(w, 0) + n
            counts = lower_all(counts, HELD)
        if counts:
            yield _packed(counts)

    # a row of at most SENT pre-tokens for each task, then for each of MERGERS tasks
    rows = docs.select("text").mapInArrow(summarise, _SUMMARY).repartition(MERGERS).mapInArrow(merge, _SUMMARY).collect()
    counts: dict[bytes, int] = {}
    for row in rows:
        for w, n in _unpacked(row.asDict()):
            counts[bytes(w)] = counts.get(w, 0) + n
    return [w for w, _ in heapq.nlargest(TABLE, counts.items(), key=lambda x: (x[1], x[0]))]


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with n_bytes and n_tokens of ``text``."""
    small_batches(docs.sparkSession)
    words = frequent(docs, path)
    table, special, known = Lengths(words, encoded_lengths(path, words)), special_of(path), classes()
    row = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens")]
    names = [f"c{i}" for i in range(len(row))]
    text = names[row.index("text")]

    def run(batches):
        for batch in batches:
            whole = Bytes(batch.column(batch.schema.get_field_index(text)), lower=False)
            total = np.zeros(batch.num_rows, np.int64)
            for b, owner in windows(whole):
                starts, ends, first, fixed = split(b, known, special)
                h, at, which = distinct(b, starts, ends)
                length = table.find(h, b, starts[at], ends[at])
                length[which[fixed]] = 1
                miss = np.flatnonzero(length < 0)
                raw = b.data.tobytes()
                length[miss] = encoded_lengths(path, [raw[x:y] for x, y in zip(starts[at[miss]].tolist(), ends[at[miss]].tolist())])
                sums = np.concatenate([[0], np.cumsum(length[which])])
                np.add.at(total, owner, sums[first[1:]] - sums[first[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(whole.off)), pa.array(total)], names=[*batch.schema.names, "n_bytes", "n_tokens"])

    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(row, names)])
    made = df.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), "n_bytes bigint, n_tokens bigint"]))
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, row)], "n_bytes", "n_tokens")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than LIMIT tokens)."""
    got = token_counts(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
