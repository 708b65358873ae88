"""Token counts and alignments against the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from restgrid.llm import alignment, common, pretokens, tokens

from . import plain

ALPHABET = ["a", "s", "t", "re", "'", "''", " ", "  ", "\n", "\t", "1", "22", "é", "日", "!", "-", "ve", "the", "m", "d", "'s", "'ll", " ", "́", "<|endoftext|>", "½", "😀", "<|", "<s>", "\x00", "<0x41>", "\x85", "   "]


def random_texts(n, seed, alphabet=ALPHABET):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(n)]


EDGES = [None, "", " ", "  ", "a ", "\n", " \n ", "x" * 5000, "\n" * 300 + "a", "word " * 3000, "it's we'll 'tis ''s", "<|endoftext|><|endoftext|> x <|endoftext|>"]


def library_counts(texts):
    return [len(e.ids) for e in pretokens.tokenizer(tokens.VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def frame(spark, texts):
    """Rows with columns whose names the operators use, in several tasks."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, c0 int, units string").repartition(5)


@pytest.mark.parametrize("size", [1 << 19, 64])
def test_pre_tokens_are_the_librarys(size):
    texts = [t for t in random_texts(4000, 1) + EDGES if t]
    parts, special = defaultdict(list), tokens.special_of(tokens.VOCABULARY)
    rule = pretokens.tokenizer(tokens.VOCABULARY).pre_tokenizer
    for b, owner in pretokens.windows(common.Bytes(pa.array(texts), lower=False), size):
        starts, ends, first, _ = pretokens.split(b, pretokens.classes(), special)
        for i, a, z in zip(owner.tolist(), first[:-1], first[1:]):
            parts[i] += [b.data[x:y].tobytes().decode() for x, y in zip(starts[a:z], ends[a:z])]
    for i, t in enumerate(texts):
        want = []
        for k, piece in enumerate(t.split("<|endoftext|>")):
            want += ["<|endoftext|>"] * (k > 0)
            at = 0
            for _, (a, z) in rule.pre_tokenize_str(piece) if piece else []:
                want.append(piece[a:z])
                at = z
            assert at == len(piece)
        assert parts[i] == want, t


def test_distinct_compares_bytes(monkeypatch):
    monkeypatch.setattr(pretokens, "mix", lambda h: h & np.uint64(1))
    b = common.Bytes(pa.array(["aa b aa c b d"]), lower=False)
    starts, ends, _ = b.words()
    _, at, which = pretokens.distinct(b, starts, ends)
    words = [b.data[x:y].tobytes() for x, y in zip(starts, ends)]
    assert [words[at[k]] for k in which] == words and len(at) == 4


def test_length_table():
    words = [b"the", b" the", b"x" * 64, "é".encode(), b"\n"]
    table = tokens.Lengths(words, [1, 2, 3, 4, 5])
    b = common.Bytes(pa.array(["the|x|é"]), lower=False)
    starts, ends = np.array([0, 4, 6]), np.array([3, 5, 8])
    h, at, which = pretokens.distinct(b, starts, ends)
    assert table.find(h, b, starts[at], ends[at])[which].tolist() == [1, -1, 4]
    table.hash = table.hash[::-1].copy()  # like hashes of other bytes are misses
    assert tokens.Lengths([], []).find(h, b, starts[at], ends[at]).tolist() == [-1] * 3


def test_summaries_keep_what_is_frequent():
    r = random.Random(2)
    counts, seen = {}, Counter()
    for _ in range(40):
        for w in [b"often"] * 30 + [b"%d" % r.randrange(10**6) for _ in range(200)]:
            counts[w] = counts.get(w, 0) + 1
            seen[w] += 1
        counts = tokens.lower_all(counts, 50)
    assert max(counts, key=counts.get) == b"often" and all(n <= seen[w] for w, n in counts.items()) and len(counts) <= 50
    row = tokens._packed(counts).to_pylist()[0]
    assert dict(tokens._unpacked(row)) == counts


@pytest.mark.parametrize("table", [1 << 16, 3])
def test_counts_are_the_librarys(spark, monkeypatch, table):
    """Also where most pre-tokens miss the table."""
    texts = random_texts(400, 5) + EDGES + [t for _, t, _, _ in plain.corpus()]
    words = tokens.frequent(frame(spark, texts))
    monkeypatch.setattr(tokens, "frequent", lambda *_: words[:table])
    got = sorted(tokens.token_counts(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in got] == library_counts(texts)
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert got[0].asDict().keys() == {"doc_id", "text", "c0", "units", "n_bytes", "n_tokens"}


def test_counts_of_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in tokens.token_counts(df).collect()) == [(0, 0), (0, 1), (1, 2), (1, 2)]
    assert tokens.token_counts(df.limit(0)).collect() == []


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 31, n)).astype(np.uint32)
        perfect = alignment.Perfect.of(keys)
        assert sorted(perfect.index(keys).tolist()) == list(range(len(keys)))
        assert len(perfect.index(np.arange(10, dtype=np.uint32))) == 10


def brute_alignment(texts):
    p = alignment.pair(alignment.BYTE_LEVEL, alignment.PIECES)
    made, documents = [], Counter()
    for t in texts:
        made.append(None)
        if not t:
            continue
        a, b = p.a.encode(" " + t, add_special_tokens=False).ids, p.b.encode(t)
        owners = []
        for ids, raw in ((a, p.a_raw), (b, p.b_raw)):
            owners.append([i for i, x in enumerate(ids) for _ in raw[x]])
            if b"".join(raw[x] for x in ids) != (" " + t).encode():
                break
        else:
            links = sorted(set(zip(*owners)))
            cuts = [0] + [k for k in range(1, len(owners[0])) if all(o[k] != o[k - 1] for o in owners)] + [len(owners[0])]
            groups = ["|".join(",".join(str(ids[i]) for i in sorted(set(o[x:y]))) for ids, o in zip((a, b), owners)) for x, y in zip(cuts, cuts[1:])]
            links = [(a[i], b[j]) for i, j in links]
            documents.update(set(links))
            made[-1] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    most = defaultdict(int)
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    return [(*m[:3], len(m[3]), sum(documents[k] == most[k[0]] for k in m[3]), sum(documents[k] for k in m[3]), m[4]) if m else (0, 0, 0, 0, 0, 0, "") for m in made]


def aligned(spark, texts):
    got = sorted(alignment.alignments(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    return [tuple(r[c] for c in (*alignment.NAMES, "groups_sha256")) for r in got]


def test_alignments_are_those_of_whole_texts(spark):
    texts = random_texts(500, 7) + random_texts(20, 8, [*ALPHABET, "▁"]) + EDGES + [t for _, t, _, _ in plain.corpus(n=20)]
    want = brute_alignment(texts)
    assert any(w[0] == 0 for w, t in zip(want, texts) if t)  # texts that B doesn't give back
    assert aligned(spark, texts) == want


def test_alignments_in_blocks_and_small_caches(spark, monkeypatch):
    """Tables in several blocks are looked up pass by pass; pairs are sent in pieces and merged in a tree."""
    texts = random_texts(150, 9) + EDGES
    monkeypatch.setattr(alignment, "BLOCK", 300)
    monkeypatch.setattr(alignment, "HELD", 64)
    assert aligned(spark, texts) == brute_alignment(texts)


def test_alignments_of_windows(monkeypatch):
    """A text in many windows has the units of the whole."""
    text = " ".join(plain.corpus()[0][1] or "x" for _ in range(3)) * 5 + " it's  \n  odd 1 2  x"
    args = (pretokens.classes(), (alignment.BYTE_LEVEL, alignment.PIECES))
    units = lambda: [store.groups[k] for _, _, which, rows, store in alignment.unit_windows(pa.array([text]), *args, True) for k in rows[which]]
    want, real = units(), pretokens.windows
    monkeypatch.setattr(alignment, "windows", lambda b: real(b, 50))
    assert units() == want


def test_alignments_of_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in alignment.alignments(df).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (1, 2, 4), (1, 2, 4)]
    assert alignment.alignments(df.limit(0)).collect() == []


def test_caches_are_bounded(monkeypatch):
    words = [t.encode() for t in dict.fromkeys(random_texts(300, 11)) if t and "<|endoftext|>" not in t]
    monkeypatch.setattr(tokens, "CACHED", 16)
    monkeypatch.setattr(tokens, "_CACHES", {})
    want = library_counts([w.decode() for w in words])
    for a, z in ((0, 5), (0, 12), (3, 40), (0, len(words)), (20, 30)):
        assert tokens.encoded_lengths(tokens.VOCABULARY, words[a:z]) == want[a:z]
    assert len(tokens._CACHES[tokens.VOCABULARY]) <= len(words)

    monkeypatch.setattr(alignment, "CACHED", 16)
    known, args = alignment.pair(alignment.BYTE_LEVEL, alignment.PIECES), (pretokens.classes(), (alignment.BYTE_LEVEL, alignment.PIECES))
    texts = [t for t in random_texts(40, 12) if t]
    for t in texts + texts:
        for text in (False, True):
            n = links = 0
            for _, _, which, rows, store in alignment.unit_windows(pa.array([t]), *args, text):
                n, links = n + store.counts[rows[which], 0].sum(), links + (store.off[rows[which] + 1] - store.off[rows[which]]).sum()
            assert (n, links) == brute_alignment([t])[0][:4:3]
        assert len(known.store.rows) <= max(16, len(rows))
