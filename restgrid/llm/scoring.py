"""LM scoring: a weighted backoff automaton of smoothed n-grams up to three words.

States are contexts: the empty one, the words, and the word pairs that training has twice or more.
A state's arcs are its seen n-grams; an arc holds log10 of the smoothed probability and leads to the
longest context that is a state.  Where a state has no arc for a word, its failure arc leads to the
context without its first word at the cost of the backoff weight; the empty state has an arc for
every word, unknown ones among them.

    p(w) = (c(w) - D) / N, unknown words together D * V / N;  D = n1 / (n1 + 2 n2)
    p(w | h) = l(h) * c(hw) / c(h) + (1 - l(h)) * p(w | h without its first word)
    l(h) = L * (c(h) - 1) / (c(h) - 1 + CALM), 1 - l(h): the weight of the failure arc

A context seen once tells of no text but its own, so l is 0 there and it is no state.  L of pairs is
MOST_WEIGHT times the share of training pairs that are not unique; L of triples is MOST_WEIGHT.

A text starts in the state of the end token.  It is read once from left to right, carrying the state
and adding weights.  As a state is settled by its last two words, long texts are cut into SEGMENT
tokens that start two tokens early, and all segments of a block step together.

Counts cover all training documents, without caps.  A task packs its documents into blocks of about
``BLOCK_BYTES``, staged once.  Each block sends its distinct n-grams with their training counts by
hash range, and gets the totals back in the same order; the automaton of a block is the part of the
corpus' automaton that its texts can reach.  n-grams are told apart by hashes, words by 48 bits within
a range, pairs and triples by 54 bits in all: of the n-grams of a terabyte fewer than one in ten thousand
share the count of another.

Defined cases: null and empty texts are one end token; a null doc_id counts as training, and such
rows stand in the blocks of their tasks; with no training tokens at all every score is 0; rows that
repeat are scored and counted one by one; a very long text is a block of its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_range, chunks, documents, mix, pack, range_of, squeeze, stage, text_bytes, unpack, unsqueeze, word_hashes
from .toxicity import held_out

ORDER = 3
BLOCK_BYTES = 4 << 20
RANGES = 128
SEGMENT = 126
CALM = 5.0
MOST_WEIGHT = 0.8
LEAST_CONTEXT = 2
KEY_BYTES = 6  # of 8; the range number adds its own bits
#: Keys of pairs and triples have 54 bits and are sent as differences in order, mostly of 5 bytes.
DROPPED_BITS = 10
STEP_BYTES = 5
END = np.uint64(0x5EED0E11D)
_STEP = np.uint64(0xD1342543DE82EF95)

BLOCK = "block bigint, docs int, tokens int, kinds int, ids binary, known binary, held binary, n binary, words binary, at binary"
REQUEST = "r int, size int, block bigint, n int, keys binary, counts binary"
TOTALS = "block bigint, size int, r int, n int, totals binary, known bigint, once bigint, twice bigint, tokens bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in text.split(", ")])


# --- blocks --------------------------------------------------------------------------------


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """BLOCK rows: a block's documents and its tokens as numbers of its distinct words."""

    def build(batches):
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            ids, known, held_, n, token = map(np.concatenate, zip(*held))
            words, at, count = np.unique(token, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # frequent words have small numbers
            number = np.empty(len(words), np.int32)
            number[order] = np.arange(len(words))
            got = (task << 20 | made, len(ids), len(token), len(words), pack(ids), known.tobytes(), held_.tobytes(), pack(n.astype(np.int32)), pack(words[order]), squeeze(number[at]))
            return pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(got, _schema(BLOCK))], schema=_schema(BLOCK))

        for part, b in chunks(batches):
            words, first = word_hashes(b)
            ids = part.column(0)
            held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), np.diff(first) + 1, np.insert(words, first[1:], END)))
            size += len(b.data)
            if size >= block_bytes:
                yield row()
                made, held, size = made + 1, [], 0
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(7, 2).alias("held_out"))
    return stage(rows.mapInArrow(build, BLOCK), "lm-blocks")


class Tokens:
    """The tokens of one block, and the keys of the n-grams that end in each."""

    def __init__(self, row: dict):
        self.ids, self.known = unpack(row["ids"], row["docs"], np.int64), np.frombuffer(row["known"], bool)
        self.held, self.n = np.frombuffer(row["held"], bool), unpack(row["n"], row["docs"], np.int32).astype(np.int64)
        self.words, self.at = unpack(row["words"], row["kinds"], np.uint64), unsqueeze(row["at"], row["tokens"], np.int32).astype(np.int64)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.nth = np.arange(len(self.at)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.end = int(np.flatnonzero(self.words == END)[0])
        self.before = np.append(self.end, self.at[:-1])  # a text's first token follows an end

    def grams(self):
        """(distinct keys, place of one that has it, number of each token's or -1) for 1, 2, 3 words."""
        key = mix(self.words)
        yield key, None, self.at
        own = mix(key[self.before] * _STEP + key[self.at])
        kinds, first, which = np.unique(own, return_index=True, return_inverse=True)
        yield kinds, first, which
        inner = np.flatnonzero(self.nth > 0)
        own = mix(own[inner - 1] * _STEP + key[self.at[inner]] + np.uint64(ORDER))
        kinds, first, got = np.unique(own, return_index=True, return_inverse=True)
        which = np.full(len(self.at), -1)
        which[inner] = got
        yield kinds, inner[first], which


# --- counts --------------------------------------------------------------------------------


def pack_keys(keys: np.ndarray, size: int) -> bytes:
    """Keys of one range; those of pairs and triples stand in order."""
    if size == 1:
        return pack(keys, KEY_BYTES)
    keys = keys >> np.uint64(DROPPED_BITS)
    steps = np.diff(keys, prepend=keys[:1])
    return pack(keys[:1]) + pack(steps, STEP_BYTES if int(steps.max()) < 1 << 8 * STEP_BYTES else 8)


def unpack_keys(raw: bytes, n: int, size: int) -> np.ndarray:
    if size == 1:
        return unpack(raw, n, np.uint64, KEY_BYTES)
    return unpack(raw[:8], 1, np.uint64) + np.cumsum(unpack(raw[8:], n, np.uint64, (len(raw) - 8) // n))


def requests(packed: DataFrame, ranges: int) -> DataFrame:
    """Each block's distinct n-grams of each size with their training counts."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row)
                learn = ~t.held[t.text]
                for size, (kinds, _, which) in enumerate(t.grams(), 1):
                    have = which >= 0
                    count = np.bincount(which[have], learn[have], len(kinds)).astype(np.int32)
                    r = range_of(kinds, ranges)
                    order = np.argsort(r, kind="stable")
                    out = [(i, size, row["block"], len(at), pack_keys(kinds[at], size), squeeze(count[at])) for i, at in by_range(r, order)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), _schema(REQUEST))], schema=_schema(REQUEST))

    return packed.mapInArrow(ask, REQUEST)


def totals(asked: DataFrame) -> DataFrame:
    """Corpus totals for each request, in its order, and what each range holds (block null)."""

    def add(table: pa.Table) -> pa.Table:
        r, size = table["r"][0].as_py(), table["size"][0].as_py()
        n, block = table["n"].to_pylist(), table["block"].to_pylist()
        keys = np.concatenate([unpack_keys(k, m, size) for k, m in zip(table["keys"].to_pylist(), n)])
        count = np.concatenate([unsqueeze(k, m, np.int32) for k, m in zip(table["counts"].to_pylist(), n)])
        kinds, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, count, len(kinds)).astype(np.int64)
        back = total[which]
        ends = np.cumsum(n)
        rows = [(b, size, r, m, squeeze(back[z - m : z]), None, None, None, None) for b, m, z in zip(block, n, ends.tolist())]
        rows.append((None, size, r, 0, None, int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()), int(total.sum())))
        return pa.table([pa.array(c, k.type) for c, k in zip(zip(*rows), _schema(TOTALS))], schema=_schema(TOTALS))

    return asked.groupBy("r", "size").applyInArrow(add, TOTALS)


# --- the automaton -------------------------------------------------------------------------


class Smoothing:
    """The corpus-wide constants of the weights."""

    def __init__(self, stats: list, ranges: int = RANGES):
        self.ranges = ranges
        by = {s.size: s for s in stats}
        uni, bi = by.get(1), by.get(2)
        self.tokens, self.known = (uni.tokens, uni.known) if uni else (0, 0)
        once, twice = (uni.once, uni.twice) if uni else (0, 0)
        self.discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5
        self.weight = {2: MOST_WEIGHT * (1 - bi.once / bi.tokens) if bi and bi.tokens else 0.0, 3: MOST_WEIGHT}

    def base(self, count):
        return np.log10((count + 1) / (self.tokens + self.known + 1))

    def word(self, count):
        return np.where(count > 0, count - self.discount, self.discount * self.known) / self.tokens

    def held(self, context, size: int):
        """l of contexts with these counts, for n-grams of ``size`` words."""
        more = np.maximum(context - 1.0, 0.0)
        return self.weight[size] * more / (more + CALM)


class Automaton:
    """States 0 (empty), 1 + word, 1 + words + pair, of those contexts that are states."""

    def __init__(self, t: Tokens, grams: list, counts: list, s: Smoothing):
        one, two, three = counts
        words = len(t.words)
        # the state of each word and pair, or of its longest end that is one
        self.of_word = np.where(one >= LEAST_CONTEXT, 1 + np.arange(words), 0)
        at2 = grams[1][1]
        a, b = t.before[at2], t.at[at2]
        own = (two >= LEAST_CONTEXT) & (b != t.end)
        of_pair = np.where(own, 1 + words + np.arange(len(two)), self.of_word[b])
        # arcs of the empty state are all words
        p1 = s.word(one)
        self.weight0 = np.log10(p1)
        # failure arcs
        self.fail = np.zeros(1 + words + len(two), np.int64)
        self.fail[1 + words :] = self.of_word[b]
        self.backoff = np.concatenate([[0.0], np.log10(1 - s.held(one, 2)), np.log10(1 - s.held(two, 3))])
        # arcs of words: the pairs that start with them
        l2 = s.held(one[a], 2)
        p2 = l2 * two / np.maximum(one[a], 1) + (1 - l2) * p1[b]
        seen2 = (two > 0) & (one[a] >= LEAST_CONTEXT)
        # arcs of pairs: the triples that start with them
        at3 = grams[2][1]
        pair, last = grams[1][2][at3 - 1], grams[1][2][at3]
        l3 = s.held(two[pair], 3)
        p3 = l3 * three / np.maximum(two[pair], 1) + (1 - l3) * p2[last]
        seen3 = (three > 0) & own[pair]
        self.words = words
        key = np.concatenate([(1 + a[seen2]) * words + b[seen2], (1 + words + pair[seen3]) * words + t.at[at3][seen3]])
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.weight = np.append(np.log10(np.concatenate([p2[seen2], p3[seen3]]))[order], 0.0)
        self.next = np.append(np.concatenate([of_pair[seen2], of_pair[last[seen3]]])[order], 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 weights) of taking one word each: its arc, or failure arcs up to one."""
        state, weight, to = state.copy(), np.zeros(len(word)), np.zeros(len(word), np.int64)
        todo = np.arange(len(word))
        while len(todo):
            s, w = state[todo], word[todo]
            empty = s == 0
            k = todo[empty]
            weight[k] += self.weight0[word[k]]
            to[k] = self.of_word[word[k]]
            todo, s, w = todo[~empty], s[~empty], w[~empty]
            want = s * self.words + w
            at = np.searchsorted(self.key, want)
            hit = self.key[at] == want
            k = todo[hit]
            weight[k] += self.weight[at[hit]]
            to[k] = self.next[at[hit]]
            todo, s = todo[~hit], s[~hit]
            weight[todo] += self.backoff[s]
            state[todo] = self.fail[s]
        return to, weight

    def traverse(self, t: Tokens, segment: int = SEGMENT) -> np.ndarray:
        """The sum of weights of each text, in one pass from left to right."""
        begin = np.cumsum(t.n) - t.n
        parts = -(-t.n // segment)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        text = np.repeat(np.arange(len(t.n)), parts)
        early = np.where(nth > 0, np.minimum(2, segment), 0)
        first = begin[text] + nth * segment - early
        stop = np.minimum(begin[text] + (nth + 1) * segment, begin[text] + t.n[text])
        order = np.argsort(first - stop, kind="stable")  # longest first, so that the live ones lead
        first, stop, text, early = first[order], stop[order], text[order], early[order]
        size = stop - first
        state, total = np.where(early > 0, 0, self.of_word[t.end]), np.zeros(len(first))
        for j in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -j))
            state[:live], weight = self.step(state[:live], t.at[first[:live] + j])
            total[:live] += np.where(j >= early[:live], weight, 0.0)
        return np.bincount(text, total, len(t.n))


def scores(packed: DataFrame, answered: DataFrame, smoothing: Smoothing) -> DataFrame:
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            t = Tokens(row)
            grams, counts = list(t.grams()), []
            for size, (kinds, _, _) in enumerate(grams, 1):
                own = answers.filter(pc.equal(answers["size"], size)).sort_by("r")
                # answers stand by range and within it in order of the keys, as ranges do
                got = [unsqueeze(k, m, np.int64) for k, m in zip(own["totals"].to_pylist(), own["n"].to_pylist())]
                order = np.argsort(range_of(kinds, smoothing.ranges), kind="stable")
                total = np.zeros(len(kinds), np.int64)
                total[order] = np.concatenate(got) if got else total
                counts.append(total)
            c = counts[0][t.at]
            base, score = np.zeros(len(t.n)), np.zeros(len(t.n))
            if smoothing.tokens:
                base = np.bincount(t.text, smoothing.base(c), len(t.n))
                score = Automaton(t, grams, counts, smoothing).traverse(t)
            cols = [pa.array(t.ids, mask=~t.known), pa.array(t.held), pa.array(t.n), pa.array(np.bincount(t.text, c > 0, len(t.n)).astype(np.int64)), pa.array(base), pa.array(score)]
            out.append(pa.table(cols, schema=_schema(SCORES)))
        return pa.concat_tables(out) if out else _schema(SCORES).empty_table()

    return packed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, SCORES)


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Smoothing]:
    """(SCORES rows of all documents, the model's constants)."""
    ranges = int(max(RANGES, text_bytes(docs) // BLOCK_BYTES))
    packed = blocks(docs, block_bytes)
    answered = stage(totals(requests(packed, ranges)), "lm-totals")
    stats = answered.where("block is null").groupBy("size").agg(*[F.sum(c).alias(c) for c in ("known", "once", "twice", "tokens")]).collect()
    smoothing = Smoothing(stats, ranges)
    return scores(packed, answered.where("block is not null").select("block", "size", "r", "n", "totals"), smoothing), smoothing


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, smoothing = score(documents(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("base_score", "score")]
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(smoothing.tokens)).cast("long").alias("train_tokens"), *rounded)
