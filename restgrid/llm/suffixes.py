"""Suffix-array dedup: a suffix sort finds the byte strings that earlier
documents hold.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id; strings are judged on the input.

1. Each window of LENGTH bytes has the least hash of its PIECE-byte pieces as key; windows in a row
   with one key are a run.  Equal windows have equal keys, so only runs whose key stands in two
   documents or more can hold a repeat (one packed exchange finds them).
2. A run's bytes with their LENGTH - 1 neighbours are a region.  Equal regions (equal keys and two
   further 64-bit hashes of other bases: bytes are not compared here) are one variant, held by its
   smallest doc_id; later holders lose the whole region.
3. The variants of a key range meet in one suffix sort (equal strings have equal keys, so it
   sorts within keys) by prefix doubling, up to LENGTH bytes.  The smallest doc_id of
   each set of equal suffixes keeps them; regions that stand several times in a variant's document
   lose the same windows.  Keys with more than ``MOST_VARIANTS`` variants would
   make a group without bound; the exact way for them is to aggregate whole windows.

Keys and variants with more than ``HOT`` rows are sent to all tasks, if they are at most MOST_SENT,
so that no task holds all rows of a passage that many documents share.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH lose nothing; equal
texts belong to the smallest doc_id, whose rows all stay as they are; rows with a null doc_id
neither lose nor hold anything; rows that repeat a doc_id with other texts are judged one by one
against smaller doc_ids (what goes is marked with the hash of its bytes); very long texts are cut
into regions like all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, WORD_STEP, Bytes, chunks, discard, documents, ids_of, inverse, mix, n_ranges, powers, shared_keys, stage

LENGTH = 50
PIECE = 20
LONGEST_RUN = 64
MOST_VARIANTS = 20_000
#: Key ranges of the suffix sort (at least), and variants for each beyond that.
SUFFIX_RANGES = 256
VARIANTS_A_RANGE = 2_000
#: Keys with more rows are sent to all tasks, if there are so many of them at most.
HOT = 1_000
MOST_SENT = 50_000


# --- candidate runs ------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, got = 1, x
    while have * 2 <= width:
        got = np.minimum(got[: len(got) - have], got[have:])
        have *= 2
    rest = width - have
    return np.minimum(got[: len(got) - rest], got[rest:]) if rest else got


def runs(b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, start, windows) of each run of each text."""
    n = len(b.data)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    sums, at = b.sums(), np.arange(n - PIECE + 1)
    least = _sliding_min(mix((sums[PIECE:] - sums[:-PIECE]) * powers(inverse(BASE), n)[at]), LENGTH - PIECE + 1)
    size = np.diff(b.off)
    new = np.zeros(len(least), bool)
    new[0] = True
    new[1:] = least[1:] != least[:-1]
    firsts = b.off[:-1][(size >= LENGTH) & (b.off[:-1] < len(least))]
    new[firsts] = True
    valid = np.zeros(len(least) + 1, np.int32)
    np.add.at(valid, firsts, 1)
    np.add.at(valid, np.minimum((b.off[:-1] + size - LENGTH + 1)[size >= LENGTH], len(least)), -1)
    valid = np.cumsum(valid[:-1]) > 0
    new[1:] |= valid[1:] != valid[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(least)))
    keep = valid[start]
    start, length = start[keep], length[keep]
    if len(length) and length.max() > LONGEST_RUN:
        parts = -(-length // LONGEST_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, length = np.repeat(start, parts) + nth * LONGEST_RUN, np.minimum(np.repeat(length, parts) - nth * LONGEST_RUN, LONGEST_RUN)
    text = np.searchsorted(b.off, start, "right") - 1
    return least[start], text, start - b.off[text], length


def shared_runs(docs: DataFrame, ranges: int) -> DataFrame:
    def found(batches):
        for part, b in chunks(batches, lower=False):
            key, text, start, n = runs(b)
            yield key, ids_of(part)[text], start.astype(np.int32), n.astype(np.int32)

    return shared_keys(docs, found, ranges)


def _hash(b: Bytes, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    return mix(b.span(sums, start, end) + (end - start).astype(np.uint64)).view(np.int64)


def matched(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows with a table of distinct keys and ``rows_of``, the number of their rows: hot
    keys by sending them to all tasks, the others by shuffle."""
    hot = keys.where(F.col("rows_of") > HOT)
    n = hot.count()
    if not n:
        return rows.join(keys.drop("rows_of"), on)
    if n > MOST_SENT:
        return rows.join(keys.drop("rows_of"), on)
    sent = F.broadcast(hot.drop("rows_of"))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(F.col("rows_of") <= HOT).drop("rows_of"), on)
    return rows.join(sent, on).unionByName(rest)


def regions(docs: DataFrame, wanted: DataFrame, whole: bool) -> DataFrame:
    """(key, h, g, doc, a, b) of wanted runs, h and g: hashes of their bytes; ``whole``: the bytes too."""
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "a", "b")).alias("runs"))
    joined = docs.join(by_doc, docs["doc_id"] == by_doc["doc"]).select("doc_id", "text", "runs")

    def cut(batches):
        for batch in batches:
            for part, b in chunks([batch], lower=False):
                lists = part.column(2)
                size = np.diff(lists.offsets.to_numpy())
                if not size.sum():
                    continue
                key, a, n = (x.to_numpy() for x in lists.flatten().flatten())
                text = np.repeat(np.arange(part.num_rows), size)
                start, end = b.off[text] + a, b.off[text] + a + n + LENGTH - 1
                ok = end <= b.off[text + 1]
                key, a, n, text, start, end = (x[ok] for x in (key, a, n, text, start, end))
                other = b.span(b.sums(WORD_STEP), start, end, WORD_STEP).view(np.int64)
                cols = [pa.array(key), pa.array(_hash(b, b.sums(), start, end)), pa.array(other), pa.array(ids_of(part)[text]), pa.array(a), pa.array(n)]
                if whole:
                    raw = b.data.tobytes()
                    cols.append(pa.array([raw[i:j] for i, j in zip(start.tolist(), end.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["key", "h", "g", "doc", "a", "b", *["bytes"] * whole]
    return joined.mapInArrow(cut, "key bigint, h bigint, g bigint, doc bigint, a bigint, b bigint" + ", bytes binary" * whole)


# --- the suffix sort -----------------------------------------------------------------------


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Place of each key among the distinct ones."""
    order = np.argsort(keys)
    at = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.append([0], at[1:] != at[:-1])) if len(keys) else 0
    return out


class Suffixes:
    """Suffixes of ``data`` at ``starts``, compared over ``limit`` bytes (WORD at least).

    Prefix doubling: places are ranked by their first WORD bytes, then by pairs of ranks of twice as many, until
    two overlapping ranks make up ``limit``; bytes are compared, not hashes."""

    WORD = 8

    def __init__(self, data: np.ndarray, starts: np.ndarray, limit: int = LENGTH):
        self.data, self.starts = data, starts
        padded, n = np.append(data, np.zeros(limit, np.uint8)), len(data) + limit - self.WORD + 1
        word = np.zeros(n, np.uint64)
        for j in range(self.WORD):
            word = word << np.uint64(8) | padded[j : j + n]
        rank, have = _ranks(word), self.WORD
        while have * 2 <= limit:
            rank = _ranks(rank[:-have] << 32 | rank[have:])
            have *= 2
        self.first, self.rest = rank[starts], rank[starts + limit - have]

    def order(self, sets: np.ndarray) -> np.ndarray:
        """Numbers of the suffixes in order within each set (equal numbers in a row of ``sets``); equal
        suffixes in order of their numbers."""
        return np.lexsort((self.rest, self.first, sets))

    def classes(self, sets: np.ndarray) -> np.ndarray:
        """For each suffix the number of its class of equal ones."""
        order = self.order(sets)
        out = np.empty(len(order), np.int64)
        same = np.all([x[order[1:]] == x[order[:-1]] for x in (sets, self.first, self.rest)], axis=0)
        out[order] = np.cumsum(np.append([0], ~same)) if len(order) else 0
        return out


def _earlier(table: pa.Table) -> pa.Table:
    """SPAN rows and ``a``, the variant's place: windows of these variants that a variant of a smaller doc holds."""
    table = table.sort_by("key")
    key, doc, a, n = (table[c].to_numpy() for c in ("key", "doc", "a", "b"))
    raw = table["bytes"].to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    at = np.cumsum(size) - size
    which = np.repeat(np.arange(len(doc)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    b = Bytes.of(np.frombuffer(b"".join(raw), np.uint8), np.append(at, size.sum()))
    places = at[which] + nth
    kind = Suffixes(b.data, places).classes(key[which])
    least = np.full(kind.max() + 1 if len(kind) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc[which])
    lost = np.flatnonzero(least[kind] < doc[which])
    d, start, place, own = doc[which][lost], (a[which] + nth)[lost], places[lost], a[which][lost]
    new = np.ones(len(lost), bool)
    new[1:] = (which[lost][1:] != which[lost][:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(lost)))
    h = _hash(b, b.sums(), place[first], place[first] + windows + LENGTH - 1)
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("doc", "start", "windows", "h", "a"), (d[first], start[first], windows, h, own[first]))})


SPAN = "doc bigint, start bigint, windows bigint, h bigint"


def removed_windows(docs: DataFrame) -> DataFrame:
    """SPAN rows: runs of LENGTH-byte windows that a smaller doc_id holds too, and the hash of their
    bytes; null h: the whole text, which is the only one of its doc_id."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n")).where(f"n >= {LENGTH}")
    whole = stage(whole, "suffix-texts")
    owner = whole.groupBy("sha").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner <> last").select("sha", "owner")
    # a doc_id with several texts is not left out of the search, as not all of them need be copies
    copies = whole.join(owner, "sha").where("doc_id > owner").select("doc_id", "sha", "n").distinct()
    single = whole.groupBy("doc_id").agg((F.min("sha") == F.max("sha")).alias("single")).where("single").select("doc_id")
    copies = stage(copies.join(single, "doc_id"), "suffix-copies")
    discard(whole)
    shared = shared_runs(docs, n_ranges(docs)).join(copies.select(F.col("doc_id").alias("doc")).distinct(), "doc", "left_anti")
    shared = stage(shared, "suffix-shared")
    two = stage(shared.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("rows_of")).where("low <> high").select("key", "rows_of"), "suffix-keys")
    cut = stage(regions(docs, matched(shared, two, ["key"]), False), "suffix-regions")
    discard(shared, two)
    # equal regions are one variant, its smallest document holds it
    same = ["key", "h", "g"]
    variant = cut.groupBy(*same).agg(F.min(F.struct("doc", "a", "b")).alias("v"), F.count("*").alias("rows_of")).select(*same, "v.*", "rows_of")
    variant = stage(variant, "suffix-variants")
    first = variant.where("rows_of > 1").select(*same, F.col("doc").alias("first"), F.col("a").alias("place"), "rows_of")
    met = stage(matched(cut, first, same).where("doc > first or a <> place").select("doc", "a", "b", "h", "first", "place"), "suffix-later")
    discard(cut)
    later = met.where("doc > first").select("doc", F.col("a").alias("start"), F.col("b").alias("windows"), "h")
    # the holder's own repeats of a region lose what its first one loses
    twins = met.where("doc = first").select("doc", F.col("place").alias("a"), (F.col("a") - F.col("place")).alias("moved")).distinct()
    # only keys with several variants are sorted: of the others all regions are equal
    several = variant.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sort = stage(variant.join(several, "key").drop("h", "g", "rows_of"), "suffix-sort")
    discard(variant)
    ranges = max(SUFFIX_RANGES, sort.count() // VARIANTS_A_RANGE)
    hold = lambda where: regions(docs, sort.where(where), True)
    dealt = lambda df: df.withColumn("r", F.pmod(F.xxhash64("key"), F.lit(ranges))).select("r", "key", "doc", "a", "b", "bytes").groupBy("r").applyInArrow(_earlier, SPAN + ", a bigint")
    few = stage(dealt(hold(f"n <= {MOST_VARIANTS}")), "suffix-lost")

    def everywhere(lost: DataFrame) -> DataFrame:
        return lost.drop("a").union(lost.join(twins, ["doc", "a"]).select("doc", F.col("start") + F.col("moved"), "windows", "h"))

    spans = later.union(everywhere(few)).union(copies.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("start"), (F.col("n") - LENGTH + 1).alias("windows"), F.lit(None).cast("long").alias("h")))
    if not sort.where(f"n > {MOST_VARIANTS}").limit(1).count():
        return spans
    window = hold(f"n > {MOST_VARIANTS}").select("doc", "a", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("k"), "bytes")
    window = window.select("doc", "a", (F.col("a") + F.col("k")).alias("start"), F.substring("bytes", F.col("k").cast("int") + 1, F.lit(LENGTH)).alias("w"))
    first = window.groupBy("w").agg(F.min("doc").alias("first"), F.count("*").alias("rows_of")).where("rows_of > 1")
    lost = matched(window, stage(first, "suffix-windows"), ["w"]).where("doc > first").select("doc", "start", "w", "a")

    def hashed(batches):
        for batch in batches:
            b = Bytes(pa.array([""]), lower=False)
            b.data = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
            at = np.arange(batch.num_rows) * LENGTH
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.ones(batch.num_rows, np.int64)), pa.array(_hash(b, b.sums(), at, at + LENGTH)), batch.column(3)], names=["doc", "start", "windows", "h", "a"])

    return spans.union(everywhere(stage(lost.mapInArrow(hashed, SPAN + ", a bigint"), "suffix-rest")))


def without_repeats(docs: DataFrame, row: list[str]) -> DataFrame:
    """``row`` columns as c0, c1, ..., then n_bytes, n_removed, n_spans, kept (binary): what stays
    of each text, and kept_text: the same without characters that lost some of their bytes."""
    spans = removed_windows(docs)
    spans = stage(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "h")).alias("spans")), "suffix-spans")
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(row)], F.col("doc_id").cast("long").alias("id"), "text")
    df = base.join(spans, base["id"] == spans["doc"], "left").select(*[f"c{i}" for i in range(len(row))], "text", "spans")
    width = len(row)

    def cut(batches):
        for batch in batches:
            for part, b in chunks([batch], lower=False):
                out, sums = [], b.sums()
                for i, spans in enumerate(part.column(width + 1)):
                    data = b.data[b.off[i] : b.off[i + 1]]
                    n = len(data)
                    edge = np.zeros(n + 1, np.int32)
                    if spans.is_valid and len(spans.values):
                        start, windows, h = spans.values.flatten()
                        whole = h.is_null().to_numpy(zero_copy_only=False)
                        start, windows, h = (x.fill_null(0).to_numpy() for x in (start, windows, h))
                        end = start + windows + LENGTH - 1
                        # a row whose id has other texts too loses only what stands in this one
                        fits = np.flatnonzero((end <= n) & ~whole)
                        mine = _hash(b, sums, b.off[i] + start[fits], b.off[i] + end[fits])
                        fits = np.concatenate([fits[mine == h[fits]], np.flatnonzero(whole & (end == n))])
                        np.add.at(edge, start[fits], 1)
                        np.add.at(edge, end[fits], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = data[~gone].tobytes()
                    out.append((n, int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), kept, kept.decode("utf-8", "ignore")))
                cols = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *cols], names=[*(f"c{i}" for i in range(width)), "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(row)), "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_text string"])
    return df.mapInArrow(cut, schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = without_repeats(documents(spark, sf_dir), ["doc_id"])
    return got.select(F.col("c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without what earlier documents hold (a character that loses some of
    its bytes goes); documents of which nothing stays are dropped."""
    names = docs.columns
    got = without_repeats(docs, names)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    cols = [F.when(changed, new[c]).otherwise(F.col(f"c{i}")).alias(c) if c in new else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return got.where("n_removed < n_bytes or n_bytes = 0").select(*cols)
