"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set is its distinct 5-word shingles; documents link when
100 * |intersection| >= 80 * |union|.  Tokens stand rarest first: a bounded table of the most
frequent shingles (``MOST_HEAVY``) goes last by frequency, all others go by hash.  Two
documents that link share a token among the first n - ceil(0.8 n) + 1 of each.

Documents of one word sequence are one class.  Among classes, each shared prefix token first
links its documents to its leader (linear in the group); then only pairs of documents whose
components still differ are compared, so a large group of near copies never makes all pairs.
The length filter and a bitmap filter (the parities of a set's hash buckets differ in no more
places than the sets do) stand in the joins; the positional filter and the least number of prefix
tokens that linking documents share come next, the suffix filter before the exact count, which
compares the words themselves.

Defined cases: null and empty texts, and texts without words, have an empty set and link with
nothing; fewer than five words are one shingle; rows that repeat a doc_id and text are one
document, and rows that repeat a doc_id with other texts link through that id; rows with a null
doc_id have the size of their set, no component and no links; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, components, documents, ids_of, mix, n_ranges, shared_keys, shingles, stage, word_hashes

N = 5
PERCENT = 80
#: The table of frequent shingles: so many at most, and in so many texts of a task at least.
MOST_HEAVY = 100_000
LEAST_IN_TASK = 2

#: 64-bit words of a document's bitmap.
BITS = 8

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sets(batches):
    """(doc_id, word hashes, sorted distinct shingle hashes) of each row."""
    for part, b in chunks(batches):
        words, first = word_hashes(b)
        for i, doc in enumerate(ids_of(part)):
            w = words[first[i] : first[i + 1]]
            yield int(doc), w, np.unique(shingles(w, N))


def profile(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, set size, two hashes of the word sequence, bitmap); kind 1: (shingle, texts)."""
    names = ["kind", "id", "n", "h1", "h2", *(f"b{i}" for i in range(BITS))]

    def rows(batches):
        out, held, n = [], [], 0

        def heavy():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count >= LEAST_IN_TASK
            return table([(1, int(k), int(c), 0, 0, *(0,) * BITS) for k, c in zip(keys[keep].view(np.int64), count[keep])])

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names), names=names)

        for doc, w, s in _sets(batches):
            at = np.arange(len(w), dtype=np.uint64)
            h1, h2 = (int(mix(w + mix(at + np.uint64(salt))).sum().view(np.int64)) if len(w) else 0 for salt in (11, 977))
            odd = np.bincount((s % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
            out.append((0, doc, len(s), h1, h2, *np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()))
            if len(s):
                held.append(s)
                n += len(s)
            if len(out) >= 5_000:
                yield table(out)
                out = []
            if n >= 4 << 20:
                yield heavy()
                held, n = [], 0
        if out:
            yield table(out)
        if held:
            yield heavy()

    return docs.select("doc_id", "text").mapInArrow(rows, ", ".join(f"{c} bigint" for c in names))


def prefix_length(n):
    return n - (n * PERCENT + 99) // 100 + 1


def prefixes(docs: DataFrame, heavy: list, ranges: int) -> DataFrame:
    """(key, doc, a: place, b: set size) of prefix tokens that two documents or more have."""
    keys = np.array([r.id for r in heavy], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, counts = keys[order], np.array([r.n for r in heavy], np.int64)[order]

    def tokens(batches):
        for doc, _, s in _sets(batches):
            n = len(s)
            if n:
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    count = np.where(keys[at] == s, counts[at], 0)
                    if count.any():
                        s = s[np.argsort(count, kind="stable")]
                s = s[: prefix_length(n)]
                yield s, np.full(len(s), doc), np.arange(len(s), dtype=np.int32), np.full(len(s), n, np.int32)

    return shared_keys(docs, tokens, ranges)


def _shingle_set(text: str | None) -> set:
    w = _WORDS.findall((text or "").translate(_ASCII))
    return set(zip(*(w[i:] for i in range(N)))) if len(w) >= N else ({tuple(w)} if w else set())


def _suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """Upper bound of the overlap of two sorted sets: halves around a pivot can't meet."""
    if not depth or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    return _suffix_bound(x[:i], y[:j], depth - 1) + _suffix_bound(x[i:], y[j:], depth - 1)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts link, by the words themselves."""
    left, right = docs.select(F.col("doc_id").alias("u"), F.col("text").alias("s")), docs.select(F.col("doc_id").alias("v"), F.col("text").alias("t"))

    def check(batches):
        last, kept = None, None  # pairs often come with the same u
        for batch in batches:
            found = []
            for u, v, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                if last != s or kept is None:
                    last, kept = s, _shingle_set(s)
                    hashed = np.sort(np.fromiter(map(hash, kept), np.int64, len(kept)))
                other = _shingle_set(t)
                least = -(-PERCENT * (len(kept) + len(other)) // (100 + PERCENT))
                if min(len(kept), len(other)) < least or _suffix_bound(hashed, np.sort(np.fromiter(map(hash, other), np.int64, len(other)))) < least:
                    continue
                both = len(kept & other)
                if both and 100 * both >= PERCENT * (len(kept) + len(other) - both):
                    found.append((u, v))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "s", "t")
    return both.mapInArrow(check, "u bigint, v bigint").distinct()


def _lengths(n: str, m: str) -> str:
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def _least_overlap(n: str, m: str) -> str:
    return f"ceil({PERCENT}.0 * ({n} + {m}) / {100 + PERCENT} - 1e-6)"


def _least_shared(n: str, m: str) -> str:
    """Prefix tokens that documents of n and m tokens share at least, if they link: the k-th
    token that both have stands behind k - 1 common ones and what only one of them has."""
    own = lambda x: f"{x} - ceil({PERCENT} * {x} / 100.0 - 1e-6) + 1 - {x} + {_least_overlap(n, m)}"
    return f"greatest(1, least({own(n)}, {own(m)}))"


def _bitmaps_near(n: str, m: str) -> str:
    """False where the bitmaps b and e rule a link out; true where one is missing."""
    apart = " + ".join(f"bit_count(b{i} ^ e{i})" for i in range(BITS))
    return f"coalesce({n} + {m} - ({apart}) >= 2 * {_least_overlap(n, m)}, true)"


def link_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile of every row: doc_id, n_shingles, class; verified links u, v of classes)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(profile(docs.where("doc_id is not null")), "jaccard-profile")
    heavy = found.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(MOST_HEAVY).collect()
    rows = found.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "h1", "h2")
    classes = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("class"))
    rows = stage(rows.join(classes, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("class")), "jaccard-rows")
    # of a doc_id with several texts there is no one bitmap
    maps = found.where("kind = 0").groupBy(F.col("id").alias("doc")).agg(*[F.when(F.min(f"b{i}") == F.max(f"b{i}"), F.min(f"b{i}")).alias(f"b{i}") for i in range(BITS)])
    ours = rows.where("class = doc_id and n_shingles > 0").select(F.col("doc_id").alias("doc")).distinct()
    shared = stage(prefixes(docs, heavy, n_ranges(docs)).join(ours, "doc"), "jaccard-prefixes")
    # each token's leader; a pair is looked at once, whatever the number of its tokens
    lead = shared.groupBy("key").agg(F.min(F.struct("doc", "a", "b")).alias("lead")).select("key", F.col("lead.doc").alias("u"), F.col("lead.a").alias("i"), F.col("lead.b").alias("n"))
    star = shared.join(lead, "key").where(f"doc <> u and {_lengths('n', 'b')}").groupBy("u", F.col("doc").alias("v")).agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("b").alias("m"))
    # pairs whose tokens mostly have other leaders are left to the second round
    star = star.where(f"k >= {_least_shared('n', 'm')}").select("u", "v")
    star = stage(star, "jaccard-star")
    links = stage(verified(star, docs), "jaccard-links")
    at = components(links, "jaccard-first")
    known = shared.join(at.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    left = stage(known.join(open_, "key").join(maps, "doc", "left"), "jaccard-open")
    x = left.select("key", F.col("doc").alias("u"), F.col("a").alias("i"), F.col("b").alias("n"), F.col("component").alias("c"), *[f"b{i}" for i in range(BITS)])
    y = left.select("key", F.col("doc").alias("v"), F.col("a").alias("j"), F.col("b").alias("m"), F.col("component").alias("d"), *[F.col(f"b{i}").alias(f"e{i}") for i in range(BITS)])
    pairs = x.join(y, "key").where(f"u < v and c <> d and {_lengths('n', 'm')} and {_bitmaps_near('n', 'm')}").groupBy("u", "v").agg(F.count("*").alias("k"), F.min("i").alias("i"), F.min("j").alias("j"), F.first("n").alias("n"), F.first("m").alias("m"))
    # all shared tokens of a pair are among its rows, the first one too: the positional filter
    pairs = pairs.where(f"k >= {_least_shared('n', 'm')} and 1 + least(n - i - 1, m - j - 1) >= {_least_overlap('n', 'm')}")
    pairs = pairs.join(star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    more = stage(verified(stage(pairs.select("u", "v"), "jaccard-pairs"), docs), "jaccard-more")
    return rows, links.union(more)


def set_sizes(docs: DataFrame) -> DataFrame:
    """(n_shingles) of each row, for rows without an id."""

    def sizes(batches):
        for part, b in chunks(batches):
            words, first = word_hashes(b)
            yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(shingles(words[a:z], N))) for a, z in zip(first, first[1:])], pa.int64())], names=["n_shingles"])

    return docs.select("text").mapInArrow(sizes, "n_shingles bigint")


def classes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_spanning_links) of every row; n_spanning_links: the
    verified links that were looked at, which join a component but are not all of its links."""
    rows, links = link_table(docs)
    links = links.union(rows.where("class <> doc_id").select(F.col("class").alias("u"), F.col("doc_id").alias("v")))
    links = stage(links, "jaccard-all")
    ends = links.select("u").union(links.select("v")).groupBy(F.col("u").alias("doc_id")).agg(F.count("*").alias("n_links"))
    at = components(links, "jaccard-components").withColumnRenamed("node", "doc_id")
    out = rows.join(at, "doc_id", "left").join(ends, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_spanning_links"))
    null = F.lit(None).cast("long")
    return out.union(set_sizes(docs.where("doc_id is null")).select(null, "n_shingles", null, F.lit(0).cast("long")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that of the smallest doc_id; of rows without one, or
    that repeat one, any one, but no copies.  Rows without words are alike to none and all stay."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = classes_of(docs).where("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*own)
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row = f"_{row}"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-stage")
    found = classes_of(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = rows.select("doc_id", row).join(found, row).groupBy("component_id").agg(F.min(first).getField(row).alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*own)
