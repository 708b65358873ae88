"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased runs without white space and ASCII punctuation, and their beginnings of
PREFIXES bytes, hashed to BUCKETS buckets: every term has one, none is cut.  A bucket's value
grows from 0 to 1 with how well it tells the classes apart (chi-square against CALM), so that
the many which tell nothing stay quiet.  The machine is fitted on a bounded sample of labelled
rows (``MOST_LABELLED``, the smallest seeded hashes) in one task, by STEPS batches of BATCH rows;
what that task holds is bounded by the sample and the buckets.  The model has the size of the
buckets.  Scoring covers every whole text.

score = sigmoid(b + sum w_i + sum over pairs of <v_i, v_j>) over a text's distinct buckets.

Defined cases: null and empty texts score the bias alone; rows with a null label or doc_id are
not learned from; with no labels at all every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bytes, chunks, documents, mix

MOST_LABELLED = 12_000
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
CALM = 200.0
FACTORS = 6
STEPS = 240
BATCH = 256
RATE = 0.03
SEED = 7
THRESHOLD = 0.3
#: Bytes of the word beginnings that stand beside whole terms: inflected words share them.
PREFIXES = (4, 5, 6)

_GAPS = np.zeros(256, bool)
_GAPS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True

#: weights: BUCKETS doubles; factors: BUCKETS x FACTORS doubles.
MODEL = "bias double, weights binary, factors binary"


def _terms(b: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each term and beginning."""
    if not len(b.data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = _GAPS[b.data]
    edge = np.zeros(len(b.data) + 1, bool)
    edge[b.off] = True
    before = np.concatenate([[True], out[:-1]]) | edge[:-1]
    after = np.concatenate([out[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~out & before), np.flatnonzero(~out & after) + 1
    sums, text = b.sums(), np.searchsorted(b.off, starts, "right") - 1
    hashes, texts = [], []
    for n in (0, *PREFIXES):  # 0: the whole term
        long = (ends - starts > n) if n else slice(None)
        to = starts[long] + n if n else ends
        hashes.append(mix(b.span(sums, starts[long], to) + np.uint64(n << 56)))
        texts.append(text[long])
    return np.concatenate(hashes), np.concatenate(texts)


def _buckets(b: Bytes, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number), each pair once, by text; ``used``: only buckets marked there."""
    h, text = _terms(b)
    at = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    if used is not None:
        hit = used[at]
        at, text = at[hit], text[hit]
    pair = np.unique((text << BUCKET_BITS) | at)
    return pair & (BUCKETS - 1), pair >> BUCKET_BITS


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def _machine(rows, cols, n, w, v, b):
    """Scores before the sigmoid, and the factor sums of each text."""
    s = np.stack([np.bincount(rows, v[cols, f], n) for f in range(v.shape[1])], 1)
    q = np.bincount(rows, (v[cols] ** 2).sum(1), n)
    return b + np.bincount(rows, w[cols], n) + 0.5 * ((s**2).sum(1) - q), s


def _values(rows, cols, y) -> np.ndarray:
    """Value of each bucket, 0 to 1: chi-square of bucket and label against CALM."""
    have, toxic = np.bincount(cols, minlength=BUCKETS), np.bincount(cols, y[rows], BUCKETS)
    expect = have * y.mean()
    apart = (toxic - expect) ** 2 / np.maximum(expect, 1e-9) / np.maximum(1 - y.mean(), 1e-9)
    return apart / (apart + CALM)


def _fit(rows, cols, y, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Adam on the logistic loss of seeded batches with a light L2 penalty; ``rows`` ascend.
    The buckets' values are multiplied into the weights and factors that are returned; buckets without
    a value stay 0, so only the others are held while the machine is fitted."""
    rng, n = np.random.default_rng(SEED), len(y)
    value = _values(rows, cols, y)
    live = value[cols] > 0
    rows, cols = rows[live], cols[live]
    kept = np.unique(cols)  # the buckets that are fitted
    cols, value, m = np.searchsorted(kept, cols), value[kept], len(kept)
    first_of = np.searchsorted(rows, np.arange(n + 1))
    p = {"w": np.zeros(m), "v": rng.normal(0, 0.01, (BUCKETS, FACTORS))[kept], "b": np.array(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))}
    first, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < min(BATCH, n):
            order = rng.permutation(n)
        some, order = order[:BATCH], order[BATCH:]
        size = first_of[some + 1] - first_of[some]
        at, to = np.repeat(np.arange(len(some)), size), np.cumsum(size)
        c = cols[np.arange(size.sum()) + np.repeat(first_of[some] - to + size, size)]
        x = value[c]
        vx = p["v"][c] * x[:, None]
        z, s = _machine(at, np.arange(len(c)), len(some), p["w"][c] * x, vx, p["b"])
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
        pull = g[at] * x
        grad = {"w": np.bincount(c, pull, m) + 1e-5 * p["w"], "b": g.sum()}
        grad["v"] = np.stack([np.bincount(c, pull * (s[at, f] - vx[:, f]), m) for f in range(FACTORS)], 1) + 1e-5 * p["v"]
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    weights, factors = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    weights[kept], factors[kept] = p["w"] * value, p["v"] * value[:, None]
    return weights, factors, float(p["b"])


def _train(table: pa.Table) -> pa.Table:
    """The model of one bounded sample; the order of its rows is that of their hashes."""
    table = table.sort_by("place")
    y = table["toxic"].to_numpy().astype(float)
    lists = table["buckets"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    w, v, b = _fit(np.repeat(np.arange(len(y)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), y)
    return pa.table({"bias": [b], "weights": [w.tobytes()], "factors": [v.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> list:
    """The model as one row; none without labels."""
    few = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    few = few.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "toxic").limit(MOST_LABELLED)

    def buckets(batches):
        for batch in batches:
            for part, b in chunks([batch]):
                at, text = _buckets(b)
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(np.zeros(part.num_rows, np.int32))], names=["place", "toxic", "buckets", "one"])

    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.xxhash64(F.lit(SEED), "doc_id", "toxic", "text").alias("place"), "toxic", "text")
    found = found.mapInArrow(buckets, "place bigint, toxic int, buckets array<int>, one int")
    # once more, as ids may repeat
    return found.orderBy("place").limit(MOST_LABELLED).groupBy("one").applyInArrow(_train, MODEL).collect()


def score(docs: DataFrame, model: list) -> DataFrame:
    """doc_id and score of every row."""
    bias = model[0].bias if model else -np.inf
    w = np.frombuffer(model[0].weights) if model else np.zeros(BUCKETS)
    v = np.frombuffer(model[0].factors).reshape(BUCKETS, FACTORS) if model else np.zeros((BUCKETS, FACTORS))

    def scores(batches):
        used = (w != 0) | (v != 0).any(1)
        for part, b in chunks(batches):
            cols, rows = _buckets(b, used)
            z, _ = _machine(rows, cols, part.num_rows, w, v, bias)
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scores, f"doc_id {kind}, score double")


def op9_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(docs, model)
    return got.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
