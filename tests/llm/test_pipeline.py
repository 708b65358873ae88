import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from restgrid.llm import jaccard, mixing, pieces, quality, suffixes

from . import plain

SCHEMA = plain.SCHEMA + ", n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or "")) for r in plain.corpus(7, 48)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def test_stages_keep_the_columns(spark, docs):
    for function in (quality.quality_stage, jaccard.jaccard_stage, suffixes.suffix_stage, mixing.mixing_stage):
        got = function(spark, docs, "")
        assert got.columns == docs.columns
        assert got.count() > 0
        assert function(spark, docs.limit(0), "").count() == 0


def test_stages_bear_clashing_names(spark, docs):
    """Columns named like those that the operators make in between."""
    names = "ref ref_lang ref_chars ref_common quality_verdict doc size row times taken shard bytes spans c0 c1 token_ids n_tokens round_trip key component_id".split()
    more = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for function in (quality.quality_stage, jaccard.jaccard_stage, suffixes.suffix_stage, mixing.mixing_stage):
        got, want = function(spark, more, ""), function(spark, docs, "")
        assert got.columns == more.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
        assert all(r[n] == i for r in got.collect() for i, n in enumerate(names))
    got = pieces.pieces_stage(spark, more, "")
    assert got.columns == [c for c in more.columns if c not in ("token_ids", "n_tokens", "round_trip")] + ["token_ids", "n_tokens", "round_trip"]
    assert all(r.round_trip for r in got.collect())


def test_quality_stage_drops_what_it_rejects(spark, docs):
    kept = {r.doc_id for r in quality.quality_stage(spark, docs, "").collect()}
    for r in docs.collect():
        if plain.quality(r.text)[-1]:
            assert r.doc_id not in kept


def test_jaccard_stage_keeps_one_of_each_group(spark, docs):
    got = sorted(r.doc_id for r in jaccard.jaccard_stage(spark, docs, "").collect())
    classes = plain.jaccard_components([(r.doc_id, r.text) for r in docs.collect()])
    assert got == sorted(i for i, c in classes.items() if c[1] == i)
    unique = docs.dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in jaccard.jaccard_stage(spark, unique, "").collect()) == got


def test_jaccard_stage_of_repeated_and_null_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " w40"), (None, text), (None, other), (None, other), (7, other), (7, "quite another text of seven words here"), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, _row int")
    got = jaccard.jaccard_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in got) == sorted([(0, ""), (1, text[:5]), (3, ""), (7, other[:5]), (7, "quite")])
    assert all(r["_row"] == 5 for r in got)


def test_quality_stage_rejects_by_divergence(spark):
    """Texts whose letters and words are far from their language's go, though no base rule fails; the
    others stay, and no text is held against a sum that it is part of."""
    import random

    r = random.Random(4)
    plain_text = lambda: " ".join(r.choice(["the", "of", "and", "to", "in", "a", "house", "river", "walks", "slowly", "green", "under", "bridge"]) + r.choice(["", "", "", ","]) for _ in range(120))
    odd = lambda: " ".join("".join(r.choice("XQZ#%&0123456789") for _ in range(7)) for _ in range(120))
    rows = [(i, odd() if i % 20 == 7 else plain_text(), "en", "s") for i in range(100)]
    docs = spark.createDataFrame(rows, plain.SCHEMA)
    assert not any(plain.quality(t)[-1] for _, t, _, _ in rows)
    kept = {x.doc_id for x in quality.quality_stage(spark, docs, "").collect()}
    assert kept == {i for i in range(100) if i % 20 != 7}
    parts = {x.doc_id: x.part for x in docs.select("doc_id", quality.part_of(docs).alias("part")).collect()}
    refs = {(x.ref_lang, x.ref_part): sum(x.ref_chars) for x in quality.references(quality.features(docs, ["doc_id"])).collect()}
    assert refs == {("en", 1 - p): sum(len(t) for i, t, _, _ in rows if parts[i] == p) for p in (0, 1)}
    alone = quality.evaluate(docs.where("doc_id = 7"), ["doc_id"]).first().quality
    assert alone.kept and alone.char_distance == 0


def test_mixing_stage_stands_rows_as_often_as_they_are_taken(spark):
    import math

    rows = [(i, " ".join(f"w{k}" for k in range(50 + i % 30)), "en", f"s{0 if i < 20 else 1}") for i in range(220)]
    docs = spark.createDataFrame(rows, plain.SCHEMA)
    taken = {x.doc_id: (x.taken, x["size"], x.source, x.target) for x in mixing.mix(docs.select("doc_id", "source", mixing.n_words().alias("size"))).collect()}
    got = {}
    for x in mixing.mixing_stage(spark, docs, "").collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + 1
    for i, (n, size, _, _) in taken.items():
        assert math.floor(n / size) <= got.get(i, 0) <= math.ceil(n / size) <= 3
    for s in ("s0", "s1"):
        words = sum(got.get(i, 0) * size for i, (_, size, source, _) in taken.items() if source == s)
        target = next(t for _, _, source, t in taken.values() if source == s)
        assert abs(words - target) < 0.15 * target


def test_suffix_stage_cuts_texts(spark, docs):
    want = plain.without_repeats([(r.doc_id, r.text) for r in docs.collect()])
    got = suffixes.suffix_stage(spark, docs, "").collect()
    for r in got:
        n, removed, _, kept = want[r.doc_id]
        if removed:
            assert r.text == kept.decode("utf-8", "ignore") and r.n_chars == len(r.text)
    assert {r.doc_id for r in got} == {i for i, x in want.items() if x[1] < x[0] or not x[0]}


def test_tokens_round_trip(spark, docs):
    got = pieces.pieces_stage(spark, docs, "")
    assert got.columns[: len(docs.columns)] == docs.columns
    assert all(r.round_trip and len(r.token_ids) == r.n_tokens for r in got.collect())


def test_whole_pipeline(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "mix_sources", "sentencepiece"]
    got = corpus_pipeline.run(spark, small).collect()
    assert 0 < len(got) and all(r.round_trip for r in got)
