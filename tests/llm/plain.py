"""Brute-force versions in plain Python."""

import collections
import math
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def shingle_set(text, n=5):
    w = words(text)
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in nodes}


def jaccard_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


def without_repeats(docs, length=50):
    """{id: (bytes, removed, spans, kept)}"""
    first, out = {}, {}
    for i, t in sorted(docs):
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], i)
    for i, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(data)) if gone[p] and (not p or not gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone) if not g))
    return out


def quality(text):
    text = text or ""
    w = words(text, lower=False)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def lm(docs):
    """{id: (tokens, known, train tokens, base, score)} by the documented formulas."""
    tokens = {i: words(t) + [None] for i, t in docs}
    c, b, t3 = (collections.Counter() for _ in range(3))
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t)
            b.update(zip([None, *t[:-1]], t))
            t3.update(zip([None, *t[:-2]], t, t[1:]))
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 + n2 else 0.5
    most = 0.8 * (1 - sum(x == 1 for x in b.values()) / sum(b.values()))
    weight = lambda top, count: top * (count - 1) / (count + 4) if count > 1 else 0.0
    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for k, w in enumerate(t):
            h = t[k - 1] if k else None
            p = (c[w] - d if c[w] else d * v) / n
            x = weight(most, c[h])
            p = (x * b[(h, w)] / c[h] if x else 0) + (1 - x) * p
            if k:
                pair = (t[k - 2] if k > 1 else None, h)
                x = weight(0.8, b[pair])
                p = (x * t3[(*pair, w)] / b[pair] if x else 0) + (1 - x) * p
            score += math.log10(p)
        out[i] = (len(t), sum(c[w] > 0 for w in t), n, base, score)
    return out


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source): random prose with copies, near copies, shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgßéñ") for _ in range(r.randint(1, 8))) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    rows, shared = [], prose(70)
    for i in range(n):
        kind = i % 6
        text = prose(r.randint(1, 200))
        if kind == 1:
            text = text + "\n" + shared + "\n" + prose(20)
        elif kind == 2 and rows:
            text = r.choice(rows)[1] or ""
        elif kind == 3 and rows:
            w = (r.choice(rows)[1] or "x").split(" ")
            w[r.randrange(len(w))] = "edited"
            text = " ".join(w)
        rows.append((i, text, "en", f"s{i % 5}"))
    rows += [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, " \t\n ", "en", None), (n + 3, "The CAT", "xx", "s2"), (n + 4, "the cat", "de", "s2"), (n + 5, "ab " * 3000, "en", "s3"), (n + 6, "x" * 5000, "en", "s0")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
