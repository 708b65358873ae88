"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

A text gets a space before its first character; spaces are the white-space marker of the pieces.
Every path of pieces over the bytes is scored by the sum of its pieces' log scores, and the best
one wins (ties: the longer last piece).  A character that no chosen piece covers becomes one
byte piece for each of its bytes.  No piece has a marker but at its start and no piece has a line
feed, so the best path of a text is that of its parts between them; equal parts of a batch are
solved once, all parts of a batch at the same time.

The vocabulary file's scores are merge ranks, so a piece of rank r scores -log(r + ZIPF), as
the r-th most frequent piece of a Zipf law would; its path is a parameter.

The trained parts are the file's own: tokenizers are never trained here.

Defined cases: null and empty texts have no tokens and decode to the empty text; literal marker
characters become byte pieces, so decoding gives back every text as it was; repeated rows are
encoded one by one; very long texts are solved part by part, a run without white space as one part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, Bytes, chunks, documents, inverse, mix, powers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
ZIPF = 2.7
BYTE_PENALTY = 10.0
UNUSED = -1e8
#: Bytes of parts solved at once.
VITERBI_BYTES = 1 << 17


class Trie:
    """Double array over bytes: a child of node s by byte c is base[s] + c where check is s."""

    def __init__(self, words: list[tuple[bytes, int]]):
        words = sorted(words)
        size = 1 << 18
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0], low = False, 257  # so that a lone child always fits at the first free place
        todo = [(0, 0, len(words), 0)]  # node, first and last word, depth
        while todo:
            node, a, z, depth = todo.pop()
            if a < z and len(words[a][0]) == depth:
                self.value[node] = words[a][1]
                a += 1
            if a == z:
                continue
            cuts, last = [], -1
            for i in range(a, z):
                if words[i][0][depth] != last:
                    last = words[i][0][depth]
                    cuts.append((last, i))
            codes = np.array([c for c, _ in cuts])
            while not free[low]:
                low += 1
            at, seen = (max(low - cuts[0][0], 0) if len(cuts) == 1 else 0), low
            while not at:  # the first place where all children fit, looked for in windows
                slots = seen + np.flatnonzero(free[seen : seen + 1024]) - int(codes[0])
                slots = slots[slots > 0]
                fits = slots[free[slots[:, None] + codes].all(1)]
                at, seen = int(fits[0]) if len(fits) else 0, seen + 1024
            self.base[node] = at
            free[at + codes], self.check[at + codes] = False, node
            for (c, i), end in zip(cuts, [*(i for _, i in cuts[1:]), z]):
                todo.append((at + c, i, end, depth + 1))
        used = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = self.base[:used], self.check[:used], self.value[:used]

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(start, end, value) of every word at ``starts`` that ends by ``ends``."""
        node, at, last = np.zeros(len(starts), np.int32), starts, ends
        origin, out = starts, []
        while len(at):
            to = self.base[node] + data[at]
            ok = self.check[to] == node
            node, at, last, origin = to[ok], at[ok] + 1, last[ok], origin[ok]
            hit = self.value[node] >= 0
            out.append((origin[hit], at[hit], self.value[node[hit]]))
            more = at < last
            node, at, last, origin = node[more], at[more], last[more], origin[more]
        return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 3


class Pieces:
    """A vocabulary: its trie, log scores, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        words, score, raw = [], [], []
        self.byte0 = model.piece_to_id("<0x00>")
        for i in range(model.get_piece_size()):
            piece, rank = model.id_to_piece(i), model.get_score(i)
            ordinary = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
            as_bytes = piece.replace(MARKER, " ").encode()
            raw.append(bytes([i - self.byte0]) if model.is_byte(i) else as_bytes if ordinary else b"")
            score.append(-np.log(ZIPF - rank) if ordinary and rank > UNUSED else 0.0)
            if ordinary and rank > UNUSED and b" " not in as_bytes[1:] and b"\n" not in as_bytes:
                words.append((as_bytes, i))
        self.trie, self.score = Trie(words), np.array(score)
        self.byte_score = min(score) - BYTE_PENALTY
        self.size = np.array([len(x) for x in raw], np.int64)
        self.raw, self.at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.size) - self.size


@lru_cache(maxsize=2)
def pieces(path: str = VOCABULARY) -> Pieces:
    return Pieces(path)


def viterbi(p: Pieces, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, offsets) of the best path of each part data[off[i]:off[i + 1]]."""
    n, size = len(off) - 1, np.diff(off)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    part = np.repeat(np.arange(n), size)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    start, end, value = p.trie.matches(data, chars, off[part[chars] + 1])
    char_end = np.append(chars[1:], len(data))
    start, end = np.concatenate([chars, start]), np.concatenate([char_end, end])
    score = np.concatenate([(char_end - chars) * p.byte_score, p.score[value]])
    value = np.concatenate([np.full(len(chars), -1, np.int32), value])
    # places 0..size of part i stand at off[i] + i on
    shift = part[start]
    rel = end - off[shift]
    order = np.lexsort((end - start, rel))
    start, end, score, value = start[order] + shift[order], end[order] + shift[order], score[order], value[order]
    cuts = np.searchsorted(rel[order], np.arange(size.max() + 2))
    best, back = np.full(len(data) + n, -np.inf), np.full(len(data) + n, -1, np.int64)
    best[off[:-1] + np.arange(n)] = 0.0
    for j in range(1, size.max() + 1):
        a, z = cuts[j], cuts[j + 1]
        if a < z:
            got, to = best[start[a:z]] + score[a:z], end[a:z]
            np.maximum.at(best, to, got)
            win = got == best[to]
            back[to[win]] = np.arange(a, z)[win]  # the last written is the longest
    place, stop, who = off[1:] + np.arange(n), off[:-1] + np.arange(n), np.arange(n)
    edges, owners = [], []
    while True:
        live = place > stop
        place, stop, who = place[live], stop[live], who[live]
        if not len(place):
            break
        e = back[place]
        edges.append(e)
        owners.append(who)
        place = start[e]
    edge, owner = np.concatenate(edges)[::-1], np.concatenate(owners)[::-1]
    order = np.argsort(owner, kind="stable")
    edge, owner = edge[order], owner[order]
    width = np.where(value[edge] < 0, end[edge] - start[edge], 1)
    nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    ids, who = np.repeat(value[edge], width), np.repeat(owner, width)
    at = np.repeat(start[edge], width) + nth - who
    low = ids < 0
    ids[low] = p.byte0 + data[at[low]]
    return ids.astype(np.int32), np.searchsorted(who, np.arange(n + 1))


def _solved(p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``viterbi`` of the parts data[start:end], about VITERBI_BYTES at a time."""
    width = end - start
    group = (np.cumsum(width) - width) // VITERBI_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(width)]
    ids, count = [], []
    for a, z in zip(cuts, cuts[1:]):
        off = np.concatenate([[0], np.cumsum(width[a:z])])
        within = np.arange(off[-1]) - np.repeat(off[:-1], width[a:z])
        got, got_off = viterbi(p, data[np.repeat(start[a:z], width[a:z]) + within], off)
        ids.append(got)
        count.append(np.diff(got_off))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(count))])


def encode_batch(p: Pieces, b: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, offsets) of each text."""
    n, size = len(b.off) - 1, np.diff(b.off)
    full = size > 0
    data = np.insert(b.data, b.off[:-1][full], 0x20)
    off = b.off + np.concatenate([[0], np.cumsum(full)])
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    line = data == 0x0A
    new = (data == 0x20) | line
    new[1:] |= line[:-1]
    new[off[:-1][full]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[: len(data)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * powers(inverse(BASE), len(data))[start] + (end - start).astype(np.uint64))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    ids, ids_off = _solved(p, data, start[first], end[first])
    count = np.diff(ids_off)[which]
    to = np.concatenate([[0], np.cumsum(count)])
    take = np.repeat(ids_off[:-1][which], count) + np.arange(to[-1]) - np.repeat(to[:-1], count)
    return ids[take], to[np.searchsorted(start, off)]


def decode_batch(p: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the pieces' bytes without the first space of each text."""
    size = p.size[ids]
    to = np.concatenate([[0], np.cumsum(size)])
    data = p.raw[np.repeat(p.at[ids], size) + np.arange(to[-1]) - np.repeat(to[:-1], size)]
    cut, full = to[off], np.diff(off) > 0
    keep = np.ones(len(data), bool)
    first = cut[:-1][full]
    keep[first[data[first] == 0x20]] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], kept[cut]


def encode(docs: DataFrame, row: list[str], path: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """``row`` columns as c0, c1, ..., ``text`` if wanted, then ``ids`` (token ids), ``n_bytes`` (byte
    pieces) and ``round_trip`` (the ids decode to the text)."""

    p = pieces(path)  # a vocabulary's trie and scores: about 2 MB, sent with the function
    names = [f"c{i}" for i in range(len(row))]
    own = "text" in row and not with_text  # the text crosses to Python once
    text = names[row.index("text")] if own else "text"
    kept = names + ["text"] * with_text

    def run(batches):
        for part, b in chunks(batches, lower=False, text=text):
            ids, off = encode_batch(p, b)
            low = np.concatenate([[0], np.cumsum((ids >= p.byte0) & (ids < p.byte0 + 256))])
            data, cut = decode_batch(p, ids, off)
            same = [np.array_equal(data[cut[i] : cut[i + 1]], b.data[b.off[i] : b.off[i + 1]]) for i in range(part.num_rows)]
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], lists, pa.array(low[off[1:]] - low[off[:-1]]), pa.array(same)], names=[*kept, "ids", "n_bytes", "round_trip"])

    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(row, names)], *[F.col("text")] * (not own))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[: len(kept)]]
    return df.mapInArrow(run, ", ".join([*kinds, "ids array<int>, n_bytes bigint, round_trip boolean"]))


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; other columns stay."""

    p = pieces(path)  # a vocabulary's trie and scores: about 2 MB, sent with the function

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            step = max(1, 200_000 * len(lists) // max(1, len(lists.flatten())))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                lists = part.column(part.schema.get_field_index("ids"))
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                data, off = decode_batch(p, lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
                text = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], names=[*part.schema.names, "decoded"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{kinds}, decoded string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_hash, round_trip (the decoded text is the text)."""
    got = encode(documents(spark, sf_dir), ["doc_id"], with_text=False)
    return got.select(F.col("c0").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.col("n_bytes").alias("n_byte_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' columns with token_ids, n_tokens and round_trip, which take
    the place of columns of these names (in any case of letters)."""
    made = ("token_ids", "n_tokens", "round_trip")
    row = [c for c in docs.columns if c.lower() not in made]
    got = encode(docs, row, with_text=False)
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(row)], F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"), "round_trip")
