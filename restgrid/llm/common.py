"""Shared helpers of the text operators: staged tables, vectorised words and hashes, and
the packed exchange that finds keys which occur in two documents or more.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  All hashing is numpy over
the bytes of an Arrow batch, so no Python object is made for a word.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

#: Fixed odd multipliers of the polynomial hashes, and the bytes of text handled at once.
BASE = 0x9E3779B97F4A7C15 | 1
WORD_STEP = 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
#: Key ranges of the packed exchange (at least), and bytes of text for each beyond that.
RANGES = 2048
RANGE_BYTES = 8 << 20
FLUSH = 1 << 19
#: Spark drops the shuffle files of a query at its end where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_M = (1 << 64) - 1
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set, a temporary folder will do
    only if there is but this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "restgrid-stage")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, as rows hold whole texts and a worker holds a few batches.
    Plans read this when they run, so it stays set; a limit of the session's own is kept."""
    if BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Results are read from staged tables lazily, so these go when the session's process ends.
    Only a path that exists can be named for that."""
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes once, and its
    shuffle files go as soon as it is written.  ``options`` are the writer's."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        discard_at_exit(spark, path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        files, at = _file_system(tables[0].sparkSession, path)
        files.delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, to size the key ranges."""
    return docs.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def n_ranges(docs: DataFrame) -> int:
    return max(RANGES, text_bytes(docs) // RANGE_BYTES)


# --- words and hashes ---------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    got = _POW.get(base)
    if got is None or len(got) <= n:
        size = max(n + 1, CHUNK_BYTES + 1 if n > 4096 else 4097)
        seed = np.full(size, base & _M, np.uint64)
        seed[0] = 1
        with np.errstate(over="ignore"):
            got = _POW[base] = np.cumprod(seed, dtype=np.uint64)
    return got[: n + 1]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Bytes:
    """Concatenated UTF-8 of a few texts: ``data`` (uint8), ``off`` (len+1 offsets)."""

    def __init__(self, column: pa.Array, lower: bool = True):
        column = column.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.off = off - off[0] if len(off) else np.zeros(1, np.int64)
        self.data = _LOWER[data] if lower else data

    @classmethod
    def of(cls, data: np.ndarray, off: np.ndarray) -> "Bytes":
        out = cls.__new__(cls)
        out.data, out.off = data, off
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first): byte spans of the words; words of text i are first[i]:first[i+1]."""
        if not len(self.data):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(self.off), np.int64)
        out = _SPACES[self.data]
        before, after = np.empty_like(out), np.empty_like(out)
        before[0] = after[-1] = True
        before[1:], after[:-1] = out[:-1], out[1:]
        edges = self.off[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        before[edges], after[edges - 1] = True, True
        starts, ends = np.flatnonzero(~out & before), np.flatnonzero(~out & after) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def sums(self, base: int = BASE) -> np.ndarray:
        """Prefix sums of (byte + 1) * base**i; see ``span``."""
        s = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(base, len(self.data))[:-1], out=s[1:])
        return s

    def span(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
        """Polynomial hash of each byte span, the same wherever the span stands."""
        back = powers(inverse(base), len(self.data))
        return (sums[ends] - sums[starts]) * back[starts]


def word_hashes(b: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first): see ``Bytes.words``."""
    starts, ends, first = b.words()
    h = b.span(b.sums(), starts, ends)
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), first


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row of one text; fewer words: all of them as one."""
    if not len(words):
        return words
    m = min(n, len(words))
    h = np.zeros(len(words) - m + 1, np.uint64)
    for j, p in enumerate(powers(WORD_STEP, n)[:m]):
        h += words[j : len(words) - m + 1 + j] * p
    return mix(h + np.uint64(m))


def chunks(batches, lower: bool = True, text: str = "text"):
    """(rows, Bytes) over pieces of Arrow batches whose texts hold about CHUNK_BYTES."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield batch.slice(a, z - a), Bytes(col.slice(a, z - a), lower)


def ids_of(batch, name: str = "doc_id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


# --- packed columns -----------------------------------------------------------------------


def pack(x: np.ndarray, width: int | None = None) -> bytes:
    """Integers as byte planes, lowest first: planes of zeros then compress to nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return np.ascontiguousarray(planes[:width]).tobytes()


def unpack(raw: bytes, n: int, dtype, width: int | None = None) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.zeros((size, n), np.uint8)
    planes[: width or size] = np.frombuffer(raw, np.uint8).reshape(-1, n) if n else 0
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def squeeze(x: np.ndarray) -> bytes:
    """``pack``, compressed: for counts, of which most are alike."""
    return pa.compress(pack(x), codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, n: int, dtype) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    return unpack(pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b"", n, dtype)


#: kind 0: keys to compare; 1: occurrences already known to be shared.  flag: the key is known
#: to be shared within its task.
PACKED = T.StructType(
    [
        T.StructField("r", T.IntegerType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        *(T.StructField(c, T.BinaryType()) for c in ("key", "doc", "a", "b", "flag")),
    ]
)
SHARED = T.StructType([*(T.StructField(c, T.LongType()) for c in ("key", "doc", "a", "b"))])
_PACKED_ARROW = pa.schema([("r", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("key", "doc", "a", "b", "flag"))])
_SHARED_ARROW = pa.schema([(c, pa.int64()) for c in ("key", "doc", "a", "b")])


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def by_range(ids: np.ndarray, order: np.ndarray):
    """(range, positions) of each run of equal ids along ``order``."""
    at = ids[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        if z > a:
            yield int(at[a]), order[a:z]


def _publish(keys, docs, a, b, ranges):
    """Packed rows of one task's occurrences.  A key in two documents of the task is shared:
    its occurrences go straight through, spread by document, and one marker tells others."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    new = np.empty(len(k), bool)
    new[:1], new[1:] = True, k[1:] != k[:-1]
    first = np.flatnonzero(new)
    both = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    local = np.repeat(both, np.diff([*first, len(k)]))
    keep = ~local | new
    at, flag = order[keep], (local[keep]).astype(np.uint8)
    r = range_of(keys[at], ranges)
    flags = np.zeros(len(keys), np.uint8)
    flags[at] = flag
    rows = [(i, 0, p) for i, p in by_range(r, np.arange(len(r)))]
    rows = [(i, 0, at[p]) for i, _, p in rows]
    rest = order[local]
    if len(rest):
        to = mix(docs[rest].astype(np.uint64)) % np.uint64(ranges)
        rows += [(i, 1, rest[p]) for i, p in by_range(to.astype(np.int64), np.argsort(to, kind="stable"))]
    out = {c: [] for c in _PACKED_ARROW.names}
    for i, kind, p in rows:
        got = (i, kind, len(p), pack(keys[p], None if kind else 8), pack(docs[p]), pack(a[p]), pack(b[p]), flags[p].tobytes())
        for c, v in zip(out, got):
            out[c].append(v)
    return pa.RecordBatch.from_pydict(out, _PACKED_ARROW)


def shared_keys(docs: DataFrame, occurrences, ranges: int, columns=("doc_id", "text")) -> DataFrame:
    """(key, doc, a, b): the occurrences of every key that stands in two documents or more.

    ``occurrences(batches)`` runs in tasks and yields arrays (key uint64, doc int64, a int32,
    b int32).  One packed exchange by key range; hot keys leave one marker for each task.
    """

    def publish(batches):
        held, n = [], 0
        for got in occurrences(batches):
            if len(got[0]):
                held.append(got)
                n += len(got[0])
            if n >= FLUSH:
                yield _publish(*map(np.concatenate, zip(*held)), ranges)
                held, n = [], 0
        if held:
            yield _publish(*map(np.concatenate, zip(*held)), ranges)

    def compare(table: pa.Table) -> pa.Table:
        cols, passed = [], []
        for row in table.to_pylist():
            n = row["n"]
            got = (unpack(row["key"], n, np.uint64), unpack(row["doc"], n, np.int64), unpack(row["a"], n, np.int32), unpack(row["b"], n, np.int32))
            if row["kind"]:
                passed.append(got)
            else:
                cols.append((*got, np.frombuffer(row["flag"], np.uint8)))
        out = passed
        if cols:
            key, doc, a, b, flag = map(np.concatenate, zip(*cols))
            order = np.argsort(key, kind="stable")
            k, d, f = key[order], doc[order], flag[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            both = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | (np.maximum.reduceat(f, first) > 0)
            # a marked occurrence is also among those that went straight through
            keep = order[np.repeat(both, np.diff([*first, len(k)])) & (f == 0)]
            out = [*passed, (key[keep], doc[keep], a[keep], b[keep])]
        if not out:
            return _SHARED_ARROW.empty_table()
        key, doc, a, b = map(np.concatenate, zip(*out))
        return pa.table([key.view(np.int64), doc, a.astype(np.int64), b.astype(np.int64)], schema=_SHARED_ARROW)

    packed = docs.select(*columns).mapInArrow(publish, PACKED)
    return packed.groupBy("r").applyInArrow(compare, SHARED)


# --- connected components ------------------------------------------------------------------


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): smallest node reachable over links (u, v), for nodes with a link.

    Large-star and small-star rounds on staged tables until the edges stand still; each round
    is two aggregations, and the number of rounds is logarithmic in the longest chain.
    """
    spark = links.sparkSession

    def neighbours(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both

    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    before = None
    for _ in range(60):
        both = neighbours(edges)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stage(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == before or now[0] == 0:
            break
        before = now
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
