import collections
import gzip
import hashlib
import inspect
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from restgrid.llm import chains, common, jaccard, mixing, pieces, quality, scoring, suffixes, toxicity, warc

from . import plain

ROWS = plain.corpus()
DOCS = [(i, t) for i, t, _, _ in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    """Messy rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, i, "x", 1) for i, r in enumerate(ROWS)], plain.SCHEMA + ", key long, doc string, n int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], plain.SCHEMA)


def test_word_hashes_follow_the_words():
    b = common.Bytes(pa.array(["The cat\tsat", None, "", "the CAT sat on", "\x0b \x0c"]))
    h, first = common.word_hashes(b)
    assert first.tolist() == [0, 3, 3, 3, 7, 7]
    assert (h[:3] == h[3:6]).all() and len(set(h.tolist())) == 4


def test_packing_round_trips():
    x = np.array([0, 1, 300, 2**40 + 5], np.int64)
    assert (common.unpack(common.pack(x), 4, np.int64) == x).all()
    assert (common.unpack(common.pack(x, 6), 4, np.int64, 6) == x).all()
    assert (common.unsqueeze(common.squeeze(x), 4, np.int64) == x).all()
    assert len(common.unsqueeze(common.squeeze(x[:0]), 0, np.int64)) == 0


def test_shared_keys_spans_tasks(spark):
    df = spark.createDataFrame([(i, f"{i % 7} {i}") for i in range(50)], "doc_id long, text string").repartition(5)

    def words(batches):
        for part, b in common.chunks(batches):
            h, first = common.word_hashes(b)
            n = np.diff(first)
            yield h, np.repeat(common.ids_of(part), n), np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)

    got = common.shared_keys(df, words, 16).groupBy("key").agg(F.countDistinct("doc").alias("n")).collect()
    # 0..6 stand in 7 or 8 documents as first words, and once more as second words
    assert len(got) == 7 and all(r.n in (7, 8) for r in got)


def test_written_tables_go_at_exit(spark, tmp_path, monkeypatch):
    for module in (common, warc):
        monkeypatch.setattr(module, "shared_dir", lambda spark: str(tmp_path))
    common.stage(spark.range(3), "some-table")
    pages = spark.createDataFrame([(1, "http://a.example/", "x" * 200)], "page_id long, url string, html string")
    assert warc.convert(pages).count() == 1
    written = [p for p in tmp_path.iterdir() if p.is_dir()]
    assert len(written) >= 2
    for p in written:
        files, at = common._file_system(spark, str(p))
        assert files.cancelDeleteOnExit(at), p


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = plain.components({x for e in links for x in e}, links)
    loops = {a for a, b in links if a == b}
    assert {k: v for k, v in want.items() if k in got} == got
    assert set(want) - set(got) <= loops


# --- 1 ---


def test_sainte_lague_is_highest_quotients(spark):
    r = random.Random(5)
    for seats in (0, 1, 7, 50, 333):
        votes = {i: r.choice([0, 1, 5, 80, 1000]) for i in range(12)}
        df = spark.createDataFrame([(0, i, float(v), seats) for i, v in votes.items()], "g int, p int, votes double, to_fill long")
        got = {x.p: x.seats for x in mixing.sainte_lague(df, ["g"], "p").collect()}
        order = sorted(((-v / (2 * k + 1), p, k) for p, v in votes.items() if v for k in range(seats + 1)))
        want = {p: 0 for p in votes}
        for _, p, _ in order[:seats]:
            want[p] += 1
        assert got == want


def test_mix(spark, docs):
    sizes = docs.select("doc_id", "source", mixing.n_words().alias("size"))
    got = mixing.mix(sizes).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(sizes).collect()))
    size = {i: len(plain.words(t)) for i, t in DOCS}
    totals = {}
    for i, _, _, s in ROWS:
        totals[s] = totals.get(s, 0) + size[i]
    names = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(totals.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * totals[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        open_ -= over
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == totals[x.source]
        assert math.isclose(x.target, target[x.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= x.taken <= 3 * x.size
    for s in names:
        taken = sum(x.taken for x in got if x.source == s)
        assert abs(taken - target[s]) <= 2 * mixing.BLOCK + 0.02 * target[s]


# --- 2 ---


def _best(p, text):
    """Score of the best path, by the plain recurrence over characters."""
    if not text:
        return 0.0
    table = {w: p.score[i] for w, i in p.words.items()}
    t = "\0" + text.replace(" ", "\0")
    best = [0.0] + [-math.inf] * len(t)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - 16), e):
            if t[s:e] in table:
                best[e] = max(best[e], best[s] + table[t[s:e]])
        best[e] = max(best[e], best[e - 1] + p.byte_score * len((t[e - 1] if t[e - 1] != "\0" else " ").encode()))
    return best[-1]


def test_pieces_find_the_best_path():
    import sentencepiece

    p = pieces.pieces()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    p.words = {model.id_to_piece(i).replace("▁", "\0"): i for i in range(model.get_piece_size()) if p.score[i] < 0}
    texts = [t[:400] if t else t for _, t in DOCS] + ["  two  spaces ", "line\n\nline", "日本語 🎉 ▁", "naïve"]
    ids, off = pieces.encode_batch(p, common.Bytes(pa.array(texts), lower=False))
    data, cut = pieces.decode_batch(p, ids, off)
    for i, t in enumerate(texts):
        own = ids[off[i] : off[i + 1]]
        score = sum(p.byte_score if p.byte0 <= x < p.byte0 + 256 else p.score[x] for x in own)
        assert math.isclose(score, _best(p, t), rel_tol=1e-9, abs_tol=1e-9)
        assert data[cut[i] : cut[i + 1]].tobytes().decode() == (t or "")


def test_pieces_on_tables(docs, empty):
    got = pieces.decode(pieces.encode(docs, ["doc_id", "n"])).collect()
    assert len(got) == len(ROWS) and all(r.decoded == (r.text or "") for r in got)
    assert pieces.decode(pieces.encode(empty, ["doc_id"])).count() == 0


# --- 3 ---


@pytest.mark.parametrize("block", [1 << 22, 3_000])
def test_lm_scores(docs, empty, block):
    got, model = scoring.score(docs, block)
    want = plain.lm(DOCS)
    for r in got.collect():
        tokens, known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, model.tokens) == (tokens, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert got.count() == len(ROWS)
    assert scoring.score(empty)[0].count() == 0


def test_keys_of_requests():
    r = np.random.default_rng(5)
    for n in (1, 2, 5_000):
        keys = np.sort(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (scoring.unpack_keys(scoring.pack_keys(keys, 3), n, 3) == keys >> np.uint64(10)).all()
        assert (scoring.unpack_keys(scoring.pack_keys(keys, 1), n, 1) == keys & np.uint64((1 << 48) - 1)).all()
    dense = np.uint64(7 << 50) + np.sort(r.integers(0, 1 << 55, 4_000).astype(np.uint64))
    assert len(scoring.pack_keys(dense, 2)) == 8 + 5 * 4_000
    assert (scoring.unpack_keys(scoring.pack_keys(dense, 2), 4_000, 2) == dense >> np.uint64(10)).all()


def _automaton(texts):
    """The automaton of these texts, all of them learned from."""
    words = sorted({w for t in texts for w in t})
    hashes = np.array([hash((w, 7)) & (2**63 - 1) for w in words] + [int(scoring.END)], np.uint64)
    order = np.argsort(hashes)
    number = {w: int(np.flatnonzero(order == i)[0]) for i, w in enumerate([*words, None])}
    at = [number[w] for t in texts for w in [*t, None]]
    row = {"docs": len(texts), "tokens": len(at), "kinds": len(hashes), "ids": common.pack(np.arange(len(texts))), "known": np.ones(len(texts), bool).tobytes(), "held": np.zeros(len(texts), bool).tobytes()}
    row |= {"n": common.pack(np.array([len(t) + 1 for t in texts], np.int32)), "words": common.pack(hashes[order]), "at": common.squeeze(np.array(at, np.int32))}
    t = scoring.Tokens(row)
    grams = list(t.grams())
    counts = [np.bincount(w[w >= 0], minlength=len(k)) for k, _, w in grams]
    stats = [type("Row", (), {"size": i + 1, "tokens": int(c.sum()), "known": int((c > 0).sum()), "once": int((c == 1).sum()), "twice": int((c == 2).sum())}) for i, c in enumerate(counts)]
    smoothing = scoring.Smoothing(stats)
    return scoring.Automaton(t, grams, counts, smoothing), t, number


def test_automaton_weights_sum_to_one_in_every_state():
    r = random.Random(21)
    machine, t, number = _automaton([[r.choice("abcdef") for _ in range(r.randint(1, 30))] for _ in range(40)])
    used = {0, *machine.of_word.tolist(), *machine.next.tolist()}
    assert max(used) > 1 + len(t.words)
    for state in used:
        words = np.arange(len(t.words))
        _, weight = machine.step(np.full(len(words), state), words)
        # every word of the texts is known, and what unknown ones would have is left over
        assert 0.8 < (10**weight).sum() <= 1 + 1e-9


def test_automaton_fails_over_and_carries_its_state():
    texts = [list("abcabcabd"), list("bca")]
    machine, t, number = _automaton(texts)
    take = lambda state, w: machine.step(np.array([state]), np.array([number[w]]))[0][0]
    state = machine.of_word[number[None]]
    for w in "ab":
        state = take(state, w)
    # the pair is a state, and fails over to its last word
    assert state > len(t.words) and machine.fail[state] == machine.of_word[number["b"]] > 0
    # d stands once: there is an arc to it, but it is no state
    assert take(state, "d") == 0 == machine.of_word[number["d"]]
    # no arc for a after b: the failure arcs lead to the empty state, whose arc leads to the word
    assert take(state, "a") == machine.of_word[number["a"]]


def test_segments_do_not_change_scores():
    r = random.Random(22)
    machine, t, _ = _automaton([[r.choice("abcdefgh") for _ in range(r.randint(0, 200))] for _ in range(30)])
    whole = machine.traverse(t, 10_000)
    for segment in (2, 3, 7, 50):
        assert np.allclose(machine.traverse(t, segment), whole)


# --- 4 ---


def test_jaccard_components(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes_of(docs).collect()}
    assert got == plain.jaccard_components(DOCS)
    assert jaccard.classes_of(empty).count() == 0


def test_jaccard_of_null_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "x"), (3, "a b c d e f")]
    got = jaccard.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, None), (None, 0, None), (1, 2, 1), (2, 1, 2), (3, 2, 1)], key=str)


def test_jaccard_finds_near_copies_without_a_common_leader(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.jaccard_components(rows)


def test_prefix_bound_is_safe():
    for n in range(1, 300):
        assert jaccard.prefix_length(n) == n - math.ceil(0.8 * n - 1e-9) + 1


# --- 5 ---


def _wrong_chains(chain, r):
    """Of random seeds, how often the first chain isn't one of the best score, or chains don't ascend."""
    wrong = 0
    for _ in range(60):
        n, far = r.randint(1, 40), r.choice([30, 60, 400])
        a, o = (np.array([r.randrange(far) for _ in range(n)]) for _ in range(2))
        found = chain(a, o)
        assert sorted(i for c in found for i in c) == list(range(n))
        best = {}
        for i in sorted(range(n), key=lambda i: (a[i], o[i])):
            best[i] = 5 + max([0.0, *(best[j] - chains.GAP_COST * float(a[i] - a[j] + o[i] - o[j]) for j in best if a[j] < a[i] and o[j] < o[i])])
        c = found[0]
        score = 5 * len(c) - chains.GAP_COST * float(a[c[-1]] - a[c[0]] + o[c[-1]] - o[c[0]])
        ascend = all(a[i] < a[j] and o[i] < o[j] for c in found for i, j in zip(c, c[1:]))
        wrong += not ascend or abs(score - max(best.values())) > 1e-9
    return wrong


def test_chain_score_is_the_best(monkeypatch):
    monkeypatch.setattr(chains, "MIN_SEEDS", 1)
    assert _wrong_chains(chains.chain, random.Random(2)) == 0


@pytest.mark.parametrize("right, broken", [("if tree[r] > best:", "if best == -1e18:"), ("if value > tree[r]:", "if True:"), ("r -= r & -r", "r -= 1 if r % 3 else r"), ("r += r & -r", "r += r"), ("int(rank[i]) - 1,", "int(rank[i]),"), ("- here\n", "- here / 2\n")])
def test_a_broken_tree_is_noticed(monkeypatch, right, broken):
    """The test above fails for any of these changes to the tree."""
    monkeypatch.setattr(chains, "MIN_SEEDS", 1)
    source = inspect.getsource(chains.chain)
    assert source.count(right) == 1
    scope = dict(vars(chains))
    exec(source.replace(right, broken), scope)
    try:
        assert _wrong_chains(scope["chain"], random.Random(2)) > 0
    except (AssertionError, IndexError):
        pass


def test_texts_of_one_id_are_judged_apart(spark):
    r = random.Random(18)
    passage, plenty = _invented(r, 60), _invented(r, 90)
    rows = [(1, _invented(r, 20) + passage), (2, passage + _invented(r, 20)), (2, plenty), (3, _invented(r, 5) + passage), (4, plenty), (4, plenty)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(p.doc, p.start, p.end, p.other, p.other_start, p.other_end, p.matches) for p in chains.fuzzy_passages(docs).collect()}
    assert found >= {(2, 0, 60, 1, 20, 80, 60), (3, 5, 65, 1, 20, 80, 60), (3, 5, 65, 2, 0, 60, 60), (4, 0, 90, 2, 0, 90, 90)}
    assert all((e - s, m) in ((60, 60), (90, 90)) for _, s, e, _, _, _, m in found)
    spans = chains.fuzzy_passages(docs)
    assert {p.v for p in spans.where("doc = 2").collect()} == {docs.where("doc_id = 2").select(chains.version().alias("v")).first().v}


def test_seeds_count_once_their_words_are_compared():
    x, y = np.arange(100, dtype=np.uint32), np.arange(1000, 1100, dtype=np.uint32)
    places = np.arange(0, 90, 5)
    assert chains.pieces(places, places, x, 0, y, 0) == []
    assert chains.pieces(places + 50, places, x, 0, y, 0) == []  # beyond the text
    y[:60] = x[:60]
    assert chains.pieces(places, places, x, 0, y, 0) == [(0, 60, 0, 60, 60)]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_planted_fuzzy_passages_are_found(spark, monkeypatch, hot):
    """Copies with a tenth of their words changed, left out or put in, one passage in every third
    document: at least nine tenths of them are covered, and nothing else is."""
    monkeypatch.setattr(chains, "HOT_PAIRS", hot)
    r = random.Random(19)
    passages = [_invented(r, r.randint(60, 140)) for _ in range(12)]

    def copy(words):
        out = []
        for w in words:
            kind = r.random()
            out += [w] if kind > 0.1 else [] if kind < 0.03 else [f"e{r.randrange(10**9)}"] * (1 if kind < 0.07 else 2)
        return out

    texts, planted = [], []
    for i in range(120):
        k = 0 if i % 3 == 0 else 1 + i % 11
        head, own = _invented(r, r.randint(5, 60)), passages[k] if i < 24 else copy(passages[k])
        texts.append(head + own + _invented(r, r.randint(5, 60)))
        planted.append((k, len(head), len(head) + len(own)))
    found = {}
    for doc, _, s, e in _found(spark, texts):
        found.setdefault(doc - 1, set()).update(range(s, e))
    caught = total = 0
    for i in range(24, 120):
        k, s, e = planted[i]
        total += 1
        caught += len(found.get(i, set()) & set(range(s, e))) >= 0.8 * (e - s)
        assert len(found.get(i, set()) - set(range(s - 2, e + 2))) == 0
    print(f"recall of planted fuzzy passages: {caught / total:.3f}")
    assert caught >= 0.9 * total


def test_passages(docs, empty):
    found = chains.fuzzy_passages(docs).collect()
    spans = {}
    for p in found:
        assert p.other < p.doc and p.end - p.start >= chains.MIN_PASSAGE
        spans.setdefault(p.doc, []).append((p.start, p.end))
    # every run of over 50 words that an earlier document has is covered
    first = {}
    for i, t in sorted(DOCS):
        w = plain.words(t)
        for k in range(len(w) - 50):
            first.setdefault(tuple(w[k : k + 51]), i)
    missed = total = 0
    for i, t in DOCS:
        w = plain.words(t)
        if len(set(w)) < 20:
            continue
        for k in range(len(w) - 50):
            if first[tuple(w[k : k + 51])] < i:
                total += 1
                missed += not any(s <= k + 5 and e >= k + 46 for s, e in spans.get(i, []))
    assert total > 300 and missed <= 0.02 * total
    assert chains.fuzzy_passages(empty).count() == 0


def _invented(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def _found(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts, 1)], "doc_id long, text string")
    return sorted((p.doc, p.other, p.start, p.end) for p in chains.fuzzy_passages(docs).collect())


def test_two_passages_of_one_chain(spark):
    r = random.Random(11)
    head, foot = _invented(r, 60), _invented(r, 60)
    texts = [head + _invented(r, 200) + foot for _ in range(2)]
    assert _found(spark, texts) == [(2, 1, 0, 60), (2, 1, 260, 320)]


def test_earlier_places_of_hot_keys(spark, monkeypatch):
    r = random.Random(8)
    rows = [(key, r.randint(0, 1) * 10**6 + r.randint(0, 40), r.randint(0, 9), int(key == 3) + 2 * r.randint(0, 2**31 - 1)) for key, n in ((1, 90), (2, 4), (3, 60), (4, 11)) for _ in range(n)]
    rows += [(5, 7, a, 0) for a in range(30)]
    shared = spark.createDataFrame(rows, "key long, doc long, a long, b long")

    def best(key, doc, a, b):
        before = sorted((d, x, v // 2) for k, d, x, v in rows if k == key and d < doc)
        return (doc, a, b % 2, b // 2, before[0] if before else None, before[-1] if before and not b % 2 else None)

    want = sorted(map(repr, (best(*row) for row in rows)))
    for hot, sent in ((10, 10_000), (10, 0), (10_000, 10_000)):
        monkeypatch.setattr(chains, "HOT_ROWS", hot)
        monkeypatch.setattr(chains, "MOST_SENT", sent)
        got = chains.earlier_places(shared).collect()
        assert sorted(repr((p.doc, p.a, p.kind, p.v, p.first and tuple(p.first), p.before and tuple(p.before))) for p in got) == want


def test_pieces_hold_every_passage_of_a_chain():
    r = random.Random(12)
    for _ in range(40):
        a, o, x, y = [], [], [], []
        for _ in range(r.randint(3, 25)):
            seed = [r.randrange(10**9) for _ in range(5)]
            x, y = ([*z, *(r.randrange(10**9) for _ in range(r.choice([0, 0, 1, 3, 30])))] for z in (x, y))
            a.append(len(x))
            o.append(len(y))
            x, y = x + seed, y + seed
        n = len(a)
        got = chains.pieces(np.array(a), np.array(o), np.array(x, np.uint32), 0, np.array(y, np.uint32), 0)
        for s, e, t, f, m in got:
            assert e - s >= chains.MIN_PASSAGE and m >= chains.MIN_IDENTITY * max(e - s, f - t) - 1e-6
        for i in range(n):
            for j in range(i, n):
                wide = max(a[j] - a[i], o[j] - o[i]) + 5
                if a[j] + 5 - a[i] >= chains.MIN_PASSAGE and 5 * (j - i + 1) >= chains.MIN_IDENTITY * wide:
                    assert any(s <= a[i] and e >= a[j] + 5 for s, e, *_ in got)


@pytest.mark.parametrize("bits", [4096, 7])
def test_common_words_of_any_gap(monkeypatch, bits):
    monkeypatch.setattr(chains, "BITS", bits)
    r = random.Random(13)
    for n, m in [(0, 5), (1, 1), (9, 30), (70, 70), (150, 90), (40, 200)]:
        x, y = ([r.randrange(12) for _ in range(k)] for k in (n, m))
        row = [0] * (m + 1)
        for w in x:
            row = [0, *(max(row[j + 1], row[j] + 1) if w == v else row[j + 1] for j, v in enumerate(y))]
            for j in range(m):
                row[j + 1] = max(row[j + 1], row[j])
        assert chains._common(x, y) == row[-1]


def test_wide_gap_is_aligned(spark):
    r = random.Random(14)
    first = _invented(r, 200)
    second = [w if not 60 <= i < 140 or i % 4 else f"e{i}" for i, w in enumerate(first)]
    assert _found(spark, [first, second]) == [(2, 1, 0, 200)]


def test_parts_of_a_passage_in_an_earlier_document(spark):
    r = random.Random(15)
    passage = _invented(r, 60)
    edited = [w if i not in (10, 50) else f"e{i}" for i, w in enumerate(passage)]
    for last in (passage, edited):
        texts = [_invented(r, 30) + passage[15:45] + _invented(r, 30), _invented(r, 50) + passage + _invented(r, 40), _invented(r, 20) + last + _invented(r, 70)]
        assert (3, 2, 20, 80) in _found(spark, texts)


def test_first_half_of_a_passage_in_an_earlier_document(spark):
    r = random.Random(16)
    passage = _invented(r, 60)
    edited = [w if i not in (20, 40) else f"e{i}" for i, w in enumerate(passage)]
    texts = [_invented(r, 30) + passage[:30] + _invented(r, 30), _invented(r, 50) + passage + _invented(r, 40), _invented(r, 20) + edited + _invented(r, 70)]
    assert (3, 2, 20, 80) in _found(spark, texts)


def test_every_long_repeat_is_found_with_phrases_in_between(spark):
    """Many documents hold parts of each passage before its first copy."""
    r = random.Random(17)
    passages = [_invented(r, 51) for _ in range(30)]
    parts = [_invented(r, 9) + p[c : c + 20] + _invented(r, 9) for p in passages for c in (0, 7, 16, 25, 31)]
    whole = [_invented(r, 15) + p + _invented(r, 15) for p in passages]
    found = _found(spark, [*parts, *whole, *parts, *whole])
    late = len(parts) * 2 + len(whole)
    for k in range(len(passages)):
        at = [(s, e) for d, o, s, e in found if d == late + k + 1 and o == len(parts) + k + 1]
        assert any(s <= 20 and e >= 61 for s, e in at)


# --- 6 ---


def test_arc_versions_and_warc_round_trip(spark):
    long = "é" * 80
    rows = [(1, "http://a/ b", long), (2, None, None), (3, "http://c", long), (4, "http://d", "short"), (5, "http://e", "short"), (6, "http://f\n", "x\r\n\r\nWARC/1.1\r\n" * 40), (None, "http://g", long), (7, "http://c", "x\r\n\r\nWARC/1.1\r\n" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.convert(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        assert by[i].payload_bytes == len(data) and by[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert {i: (r.record_type, r.refers_to) for i, r in by.items() if r.record_type == "revisit"} == {3: ("revisit", 1), 7: ("revisit", 6)}
    assert by[1].date == "2024-01-15T14:30:00Z" and by[2].url == "urn:page:2" and by[1].url == "http://a/%20b"
    assert warc.convert(pages.limit(0)).count() == 0


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"{i:05d}" * 80_000) for i in range(1, 120)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "warc")
    records = warc.read_arc(warc.pages_to_arc(pages))
    warc.write_warc(records, warc.originals(warc.payloads(records)), path)
    files = list((tmp_path / "warc").rglob("*.gz"))
    assert len(files) > 1
    for file in files:
        data = gzip.decompress(file.read_bytes())
        assert len(data) <= warc.WARC_BYTES + 500_000
        kinds = [f[b"warc-type"] for f, _ in warc.parse_warc(data)]
        assert kinds[0] == b"warcinfo" and set(kinds[1:]) <= {b"response", b"revisit"}
    assert warc.read_warc(spark, path).count() == 119


def test_other_than_http_becomes_a_resource():
    record = warc.warc_record("dns:a", "10.0.0.1", "20010203040506", "text/dns", b"a record", None, hashlib.sha256(b"a record").hexdigest(), None) + b"\r\n"
    ((fields, block),) = warc.parse_warc(record)
    assert (fields[b"warc-type"], fields[b"content-type"], fields[b"warc-ip-address"], block) == (b"resource", b"text/dns", b"10.0.0.1", b"a record")


def test_arc_parser_reads_both_versions_and_refuses_damage():
    for version in (b"1", b"2"):
        data = warc.arc_head(version, b"x.arc") + warc.arc_entry(version, b"x.arc", 9, b"http://a", b"body\n\nmore") + warc.arc_entry(version, b"x.arc", 9, b"http://b", b"")
        assert [(u, c) for u, _, _, c, _ in warc.parse_arc(data)] == [(b"http://a", b"body\n\nmore"), (b"http://b", b"")]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-12]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 1 2 3 4\nxxxx\n"))


# --- 7 ---


def test_suffix_order_is_the_sorted_order():
    r = random.Random(4)
    data = bytes(r.choice(b"ab") for _ in range(600))
    starts = np.arange(0, 540)
    s = suffixes.Suffixes(np.frombuffer(data, np.uint8), starts)
    sets = np.repeat([3, 9, 11], 180)
    got = s.order(sets)
    want = sorted(range(540), key=lambda i: (sets[i], data[i : i + 50], i))
    assert got.tolist() == want
    kinds = s.classes(sets)
    for i in range(0, 540, 7):
        for j in range(i, 540, 11):
            assert (kinds[i] == kinds[j]) == (sets[i] == sets[j] and data[i : i + 50] == data[j : j + 50])


@pytest.mark.parametrize("most", [20_000, 1])
def test_repeats_go(docs, empty, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_VARIANTS", most)
    got = {r.c0: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(docs, ["doc_id"]).collect()}
    assert got == plain.without_repeats(DOCS)
    assert suffixes.without_repeats(empty, ["doc_id"]).count() == 0


def test_repeated_ids_with_other_texts(spark):
    same = "abcdefghij" * 8
    r = random.Random(31)
    noise = lambda n: "".join(r.choice("klmnopqrst") for _ in range(n))
    shared = noise(70)
    rows = [(1, same), (2, same), (2, "qq" + same + "zz"), (3, shared), (4, noise(90)), (4, noise(20) + shared), (4, noise(20) + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.c0, x.n_bytes, x.n_removed) for x in suffixes.without_repeats(docs, ["doc_id"]).collect())
    assert got == [(1, 80, 0), (2, 80, 80), (2, 84, 80), (3, 70, 0), (4, 90, 0), (4, 90, 70), (4, 90, 70)]


def test_hot_passages_are_sent(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    r = random.Random(32)
    noise = lambda n: "".join(r.choice("klmnopqrst") for _ in range(n))
    passage = noise(130)
    rows = [(i, noise(r.randint(0, 60)) + passage[r.choice([0, 0, 30]) :] + noise(r.randint(0, 60))) for i in range(30)] + [(None, passage), (31, None), (32, "")]
    got = {x.c0: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).where("c0 is not null").collect()}
    assert got == plain.without_repeats([x for x in rows if x[0] is not None])


@pytest.mark.parametrize("most", [20_000, 1])
def test_passages_that_a_later_document_has_twice(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_VARIANTS", most)
    r = random.Random(33)
    noise = lambda n: "".join(r.choice("klmnopqrst") for _ in range(n))
    rows = []
    for i in range(0, 80, 2):
        passage, before, behind = noise(90), noise(40), noise(40)
        twice = before + passage + behind
        rows += [(i, noise(60) + passage + noise(60)), (i + 1, twice + noise(r.randint(0, 30)) + twice + noise(9) + twice)]
    got = {x.c0: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == plain.without_repeats(rows)


# --- 9 ---


def test_toxicity_learns_insults(spark):
    r = random.Random(6)
    plain_words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain_words) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(30)] = r.choice(["Rotter,", "rotters", "ROTTEN."])
            w[r.randrange(30)] = "grubby"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "rotter grubby"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert len(model) == 1 and len(model[0].weights) == 8 * toxicity.BUCKETS
    assert toxicity.fit(docs.repartition(3), marks) == model
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = {r.doc_id for r in docs.where(toxicity.held_out(4, 2)).collect()}
    right = [(x.score >= 0.3) == (x.doc_id % 4 == 0) for x in got if x.doc_id in held and x.doc_id < 600]
    assert sum(right) >= 0.97 * len(right)
    none = toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect()
    assert all(x.score == 0 for x in none)


def test_machine_scores_pairs():
    w, v = np.array([0.1, -0.2, 0.3]), np.array([[1.0, 0], [0.5, 1], [0, 2]])
    z, _ = toxicity._machine(np.array([0, 0, 0]), np.array([0, 1, 2]), 1, w, v, 0.5)
    assert math.isclose(z[0], 0.5 + 0.2 + (0.5 + 0 + 2.0))


def test_machine_against_all_pairs(spark):
    r = random.Random(8)
    bucket = lambda term: int(toxicity._buckets(common.Bytes(pa.array([term])))[0][0])
    terms = ["ab", "fool", "fools", "naïve", "x", "été"]
    texts = [None, "", " ,.; ", *(" ".join(r.choice(terms) + r.choice([",", "", "!"]) for _ in range(r.randint(1, 12))) for _ in range(20))]
    rng = np.random.default_rng(1)
    w, v = rng.normal(0, 0.2, toxicity.BUCKETS), rng.normal(0, 0.2, (toxicity.BUCKETS, toxicity.FACTORS))
    model = [Row(bias=-0.3, weights=w.tobytes(), factors=v.tobytes())]
    got = dict(toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect())
    whole = {t: toxicity._buckets(common.Bytes(pa.array([t])))[0].tolist() for t in terms}
    assert whole["x"] == [bucket("x")] and len(whole["fools"]) == 2 and whole["fool"][0] in whole["fools"] + whole["fool"]
    for i, t in enumerate(texts):
        have = sorted({b for x in re.findall(r"[^\W\d_]+", t or "") for b in whole[x]})
        z = -0.3 + sum(w[b] for b in have) + sum(v[a] @ v[b] for k, a in enumerate(have) for b in have[:k])
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_fit_with_one_class_only(spark):
    docs = spark.createDataFrame([(i, f"word{i} same") for i in range(20)], "doc_id long, text string")
    for label in (0, 1):
        model = toxicity.fit(docs, spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, toxic int"))
        assert all((x.score >= 0.5) == bool(label) for x in toxicity.score(docs, model).collect())


# --- 10 ---


def test_quality_counts(docs, empty):
    got = quality.evaluate(docs, ["doc_id"]).select("doc_id", "quality.*").collect()
    assert len(got) == len(ROWS)
    texts = dict(DOCS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert quality.evaluate(empty, ["doc_id"]).count() == 0


def test_distance(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], [1.0, 1.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 4.0, 0.0]), ([3.0, 1.0, 0.0], [1.0, 1.0, 2.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality.distance(F.col("p"), F.col("q"))).collect()]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    p, q = [0.75, 0.25, 0], [0.25, 0.25, 0.5]
    m = [(x + y) / 2 for x, y in zip(p, q)]
    want = [0.0, 1.0, math.sqrt((kl(p, m) + kl(q, m)) / 2), 0.0]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want))


@pytest.mark.parametrize("common", [256, 2])
def test_a_copy_whose_seeds_have_other_first_and_last_holders(spark, monkeypatch, common):
    """Each stretch that a copy of 84 words kept also stands in an earlier and in a later document than the original."""
    monkeypatch.setattr(chains, "COMMON", common)
    monkeypatch.setattr(chains, "HOT_ROWS", 3)
    r = random.Random(21)
    words = _invented(r, 84)
    copy = [w if i % 12 != 11 else f"e{i}" for i, w in enumerate(words)]
    parts = [_invented(r, 20) + words[i : i + 11] + _invented(r, 20) for i in range(0, 84, 12)]
    texts = [*parts, _invented(r, 9) + words + _invented(r, 9), *[_invented(r, 3) + p[20:31] + _invented(r, 30) for p in parts], _invented(r, 7) + copy + _invented(r, 7)]
    found = _found(spark, texts)
    assert [(doc, other) for doc, other, _, _ in found] == [(16, 8)]
    assert found[0][2] <= 7 and found[0][3] >= 7 + 83


@pytest.mark.parametrize("common, hot", [(1, 2), (3, 10_000), (256, 10_000)])
def test_left_seeds_are_linked_to_all_earlier_texts(spark, monkeypatch, common, hot):
    monkeypatch.setattr(chains, "COMMON", common)
    monkeypatch.setattr(chains, "HOT_ROWS", hot)
    r = random.Random(22)
    rows = list({(key, doc, r.randint(0, 25), doc << 1) for doc in range(30) for key in r.sample(range(40), 6) for _ in range(r.randint(1, 2))})
    left = [(k, d, b >> 1, a) for k, d, a, b in rows if r.random() < 0.7]
    n = collections.Counter(k for k, _, _, _ in rows)
    want = set()
    for doc in range(30):
        for other in range(doc):
            both = [(k, a, o) for k, d, _, a in left if d == doc for key, e, o, _ in rows if key == k and e == other]
            places = [a for k, _, a in ((k, d, a) for k, d, _, a in left if d == doc) if k in {x[0] for x in both}]
            if len({x[0] for x in both}) >= chains.MIN_SEEDS and max(n[x[0]] for x in both) > 3 and max(places) - min(places) >= chains.MIN_REACH:
                want |= {(doc, other, a, o) for _, a, o in both}
    got = chains.links_of_left(spark.createDataFrame(rows, "key long, doc long, a long, b long"), spark.createDataFrame(left, "key long, doc long, v long, a long")).collect()
    assert want and {(x.doc, x.other, x.a, x.o) for x in got} == want and all(x.v == x.doc and x.ov == x.other and x.kind == 0 for x in got)


def _seed_tables(spark, texts):
    """(shared, left): texts of (key, place) rows, all of them left."""
    rows = [(k, doc, a, doc << 1) for doc, t in enumerate(texts) for k, a in t]
    left = [(k, d, b >> 1, a) for k, d, a, b in rows]
    return spark.createDataFrame(rows, "key long, doc long, a long, b long"), spark.createDataFrame(left, "key long, doc long, v long, a long")


def test_near_chains_are_the_chains_of_all_links(spark):
    """Texts with runs of one seed, two seeds in turn, and wide gaps."""
    r = random.Random(31)
    texts = []
    for _ in range(60):
        text, at = [], 0
        for _ in range(r.randint(2, 6)):
            some = r.sample(range(12), r.choice([1, 1, 2, 3]))
            for i in range(r.choice([1, 3, 5, 14, 40])):
                text.append((some[i % len(some)], at))
                at += r.choice([1, 1, 1, 4, 12])
            at += r.choice([1, 9, 60, 150, 600])
        texts.append(text)
    shared, left = _seed_tables(spark, texts)
    row = lambda x: (x.doc, x.v, x.other, x.ov, x.a, x.o)
    want = sorted(map(row, chains.chains(chains.links_of_left(shared, left)).collect()))
    assert len(want) > 300 and sorted(map(row, chains.near_chains(shared, left).collect())) == want


def test_scattered_seeds_bring_no_pairs(spark):
    """Thirty texts share three seeds, too far apart for a chain; two share them near each other."""
    far = [[(key, place) for key, place in ((1, 5), (2, 905 + i), (3, 1905 + i))] for i in range(30)]
    shared, left = _seed_tables(spark, [*far, [(1, 0), (2, 8), (3, 20)], [(1, 3), (2, 11), (3, 24)]])
    assert chains.links_of_left(shared, left).select("doc", "other").distinct().count() == 32 * 31 // 2
    assert [tuple(p) for p in chains.near_pairs(shared, left).collect()] == [(31, 31, 30, 30)]
    assert [(c.doc, c.other, c.a, c.o) for c in chains.near_chains(shared, left).collect()] == [(31, 30, [[3, 11, 24]], [[0, 8, 20]])]


def test_repeated_seeds_are_chained_without_objects_for_each_pair():
    """Runs of one word in both texts: every place of one meets every place of the other.  The same chains as seed by
    seed, in a third of its 230 bytes a pair, and no row of them holds all places."""
    r = random.Random(41)
    for n in (3, 30, 90):
        sides = [np.cumsum([r.choice([1, 1, 1, 1, 2, 30]) for _ in range(n * k)]) for k in (1, 2)]
        kind = [np.array([r.random() < 0.8 for _ in x]) for x in sides]
        at = [(x, y) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if kind[0][i] == kind[1][j]]
        a, o = (np.array(x, np.int32) for x in zip(*at))
        assert [c.tolist() for c in chains.crowded_chains(a, o)] == chains.chain(a, o)
    a, o = np.repeat(np.arange(500, dtype=np.int32), 400), np.tile(np.arange(400, dtype=np.int32), 500)
    tracemalloc.start()
    long = chains._long(a, o, np.zeros(len(a), np.int32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(a)
    rows = chains._split((1, 2, 3, 4), *long)
    assert len(rows) > 2 and max(sum(map(len, x[4])) for x in rows) < chains.MOST_PLACES + 400
    assert sum((x[4] for x in rows), []) == long[0] and {x[:4] for x in rows} == {(1, 2, 3, 4)}
    assert chains._chain_rows(rows).column(4).to_pylist()[0][0] == rows[0][4][0].tolist()


@pytest.mark.parametrize("reach", [0, chains.MIN_REACH])
def test_threes_of_seeds_come_in_parts(monkeypatch, reach):
    """The least words of each three seeds don't hang on how many are held at once."""
    r = random.Random(42)
    text = np.repeat(np.arange(4), 120)
    place = np.concatenate([np.cumsum([r.choice([1, 1, 4, 20]) for _ in range(120)]) for _ in range(4)]).astype(np.int32)
    key = np.array([r.choice([7, r.randint(10, 60)]) for _ in text], np.uint64)

    def least(most):
        monkeypatch.setattr(chains, "MOST_THREES", most)
        parts = [list(zip(*(x.tolist() for x in p))) for p in chains.triples(text, place, key, reach)]
        out = {}
        for t, sig, wide in sum(parts, []):
            out[t, sig] = min(wide, out.get((t, sig), wide))
        return out, max(map(len, parts))

    whole, largest = least(1 << 30)
    some, few = least(2_000)
    assert some == whole and few <= 2_000 < largest
