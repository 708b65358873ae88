"""Splitting texts into pre-tokens as a byte-level BPE library does, many texts at a time.

A pre-token is one match of the library's pattern: a contraction, a run of letters, of digits or
of other characters with the space before it, or white space.  The classes of characters are read
from the library's own pattern engine, so they are those of its Unicode version.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np

from .common import CHUNK_BYTES, Bytes, mix

OTHER, LETTER, DIGIT, BLANK = range(4)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LENGTH_STEP = np.uint64(0xA24BAED4963EE407)


@lru_cache(maxsize=4)
def tokenizer(path: str, plain_specials: bool = False):
    """A library tokenizer without truncation and padding; ``plain_specials``: special strings in
    texts are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = plain_specials
    return out


@lru_cache(maxsize=1)
def classes() -> bytes:
    """The class of every code point, compressed: found once, on the driver, and sent with a function."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"[^\p{L}]+"), (DIGIT, r"[^\p{N}]+"), (BLANK, r"[^\s]+")):
        for a, z in ((0, 0xD800), (0xE000, 0x110000)):
            for _, (x, y) in Split(Regex(pattern), "removed").pre_tokenize_str("".join(map(chr, range(a, z)))):
                out[a + x : a + y] = kind
    return zlib.compress(out.tobytes())


@lru_cache(maxsize=2)
def char_kinds(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def windows(b: Bytes, size: int = CHUNK_BYTES):
    """(Bytes, owner): all texts in order, about ``size`` bytes at a time.  A longer text is cut
    before spaces between two ASCII letters, where the pieces of any of the tokenizers end too."""
    start, owner = [], []
    for i in np.flatnonzero(np.diff(b.off)):
        at, z = int(b.off[i]), int(b.off[i + 1])
        start.append(at)
        owner.append(i)
        at += size
        while at < z - 2:
            near = b.data[at : min(at + size, z)]
            safe = np.flatnonzero((near[1:-1] == 0x20) & _ASCII_LETTER[near[:-2]] & _ASCII_LETTER[near[2:]])
            if len(safe):
                at += int(safe[0]) + 1
                start.append(at)
                owner.append(i)
                at += size
            else:
                at += len(near) - 2 if len(near) > 2 else 3
    off, owner = np.array([*start, len(b.data)], np.int64), np.array(owner, np.int64)
    if not len(owner):
        return
    part = (off[:-1] - off[0]) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, z in zip(cuts, cuts[1:]):
        yield Bytes.of(b.data[off[a] : off[z]], off[a : z + 1] - off[a]), owner[a:z]


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 whose characters start at ``lead``."""
    if len(lead) == len(data):
        return data.astype(np.int32)
    size = np.diff(lead, append=len(data))
    out = data[lead].astype(np.int32)
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = np.flatnonzero(size == n)
        x = out[at] & mask
        for k in range(1, n):
            x = (x << 6) | (data[lead[at] + k] & 0x3F)
        out[at] = x
    return out


def split(b: Bytes, packed: bytes, special: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first, fixed): byte spans of the pre-tokens, those of text i first[i]:first[i+1];
    packed: ``classes``; fixed: the pre-tokens that are the special string, at which the text on both sides ends."""
    data = b.data
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(b.off), np.int64), z
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    m, cp = len(lead), code_points(data, lead)
    kind = char_kinds(packed)[cp]
    edge = np.zeros(m + 1, bool)
    edge[np.searchsorted(lead, b.off[:-1])], edge[m] = True, True
    spans = []
    if special:
        for found in re.finditer(re.escape(special), data.tobytes()):
            if not np.any((b.off > found.start()) & (b.off < found.end())):
                spans.append(np.searchsorted(lead, found.span()))
                edge[spans[-1]] = True
    new = edge[:m].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # the last of several blanks before other text stands alone, or with that text if it is a space
    last = np.flatnonzero((kind == BLANK) & np.append(new[1:], True) & ~edge[1:])
    new[last] = True
    new[last[cp[last] == 0x20] + 1] = False
    # contractions
    far, away = np.append(cp, [0, 0, 0]), np.append(edge, [True, True])
    q = np.flatnonzero((cp == 0x27) & new & ~edge[1:])
    q = q[kind[q + 1] == LETTER]
    one, two = far[q + 1], np.where(away[q + 2], 0, far[q + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & (((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l"))))
    q, end = q[short | long], (q + np.where(short, 2, 3))[short | long]
    new[q + 1] = False
    end = end[end < m]
    new[end[(kind[end] == LETTER) & ~edge[end]]] = True
    for x, y in spans:
        new[x + 1 : y] = False
    starts = lead[new]
    fixed = np.searchsorted(starts, lead[[x for x, _ in spans]]) if spans else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, b.off), fixed


def same_bytes(x: np.ndarray, at: np.ndarray, y: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether x[at:at + size] is y[to:to + size], for each span."""
    ends = np.cumsum(size)
    step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    equal = x[np.repeat(at, size) + step] == y[np.repeat(to, size) + step]
    right = np.concatenate([[0], np.cumsum(equal)])
    return right[ends] - right[ends - size] == size


def distinct(b: Bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, at, which) of the distinct spans: a span of each, and which of them every span is.
    Spans of equal hashes are compared byte by byte."""
    h = mix(b.span(b.sums(), starts, ends) + (ends - starts).astype(np.uint64) * _LENGTH_STEP)
    values, at, which = np.unique(h, return_index=True, return_inverse=True)
    size, own = ends - starts, at[which]
    if np.array_equal(size[own], size) and same_bytes(b.data, starts, b.data, starts[own], size).all():
        return values, at, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(b.data[x:y].tobytes(), len(seen)) for x, y in zip(starts, ends)], np.int64)
    _, at = np.unique(which, return_index=True)
    return h[at], at, which
