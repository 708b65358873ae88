"""Quality rules: distribution divergence against language references.

A document's character-class histogram and its histogram over common words of its language are
compared with the language's own reference by Jensen-Shannon distance, base 2, 0 to 1.  The corpus has
two parts, by crc32 of the doc_id: a document's reference is the sum of the documents of that ``lang`` in
the other part which pass the base rules, so none is held against itself.  A minimum-length guard
leaves short texts to the base rules.  DataFrame functions only.

Defined cases: a null text has no words and fails the base rules; a null doc_id is of the first part; a
language that the other part lacks has no reference and distances of 0; a null or unknown ``lang`` is
a language of its own with no common words (its word distance is 0); repeated rows are judged
one by one; very long texts are judged whole; an empty table gives no rows; further columns of
any name pass through untouched, those that the operator itself makes in between get free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, stage

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: The character classes; what is in none of them is the last class.
CLASSES = {
    "lower": "a-z",
    "upper": "A-Z",
    "digit": "0-9",
    "space": r"\x20\x09-\x0D",
    "punctuation": r".,;:!?'\x22()\-",
    "symbol": "#*$%&|<>",
    "letter": "À-ɏ",
}
#: Production parameters: distances above these reject; texts below these lengths have none.
MAX_CHAR_DISTANCE = 0.34
MAX_WORD_DISTANCE = 0.29
MIN_CHARS = 150
MIN_WORDS = 60
BASE_WORDS = 20
BASE_REPEAT_PERCENT = 30
WINDOW = 8
#: A reference table of up to so many languages is sent to every task.
MOST_SENT = 10_000


def _size(x: Column) -> Column:
    return F.size(x).cast("long")


def _outside(text: Column, kind: str) -> Column:
    """Characters of one class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]+", ""))).cast("double")


def _sorted_windows(hashes: Column) -> Column:
    """(hash, place) of all windows by hash, only where a window stands twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def _twice(pairs: Column) -> Column:
    """Places of windows that stand twice or more.  ``pairs``: a plain column, as the lambda
    would work out an expression anew for each element."""
    same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))


def _covered(places: Column) -> Column:
    """Words inside windows that start at ``places``."""
    step = lambda s, i: F.struct((s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum"), i.alias("last"))
    got = F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), step, lambda s: s["sum"])
    return F.coalesce(got, F.lit(0)).cast("long")


def part_of(docs: DataFrame) -> Column:
    """Which of the two parts of the corpus a row is of."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2, F.lit(0)).cast("int") if "doc_id" in docs.columns else F.lit(0)


def features(docs: DataFrame, keep: list[str], name: str = "quality") -> DataFrame:
    """``keep`` and a struct ``name``: the base counts and both histograms."""
    made = [f"_q{i}_{name}" for i in range(8)]
    while set(made) & set(docs.columns):
        made = [f"_{c}" for c in made]
    words, hashes, lines, common, text, lang, places, part = made
    had = [F.col(f"`{c}`") for c in keep]
    df = docs.select(*had, F.coalesce("text", F.lit("")).alias(text), (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias(lang), part_of(docs).alias(part))
    df = df.select(*had, text, lang, part, F.array_remove(F.split(text, f"{SPACE}+"), "").alias(words))
    n = F.size(words)
    window = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    listed = F.coalesce(F.try_element_at(lists, F.coalesce(lang, F.lit(""))), F.array().cast("array<string>"))
    df = df.select(
        *had, text, lang, part, words,
        F.when(n > WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias(hashes),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")).alias(lines),
        listed.alias(common),
    )
    had_made = [*had, text, lang, part, words, lines, common]
    df = df.select(*had_made, _sorted_windows(F.col(hashes)).alias(hashes))
    df = df.select(*had_made, _twice(F.col(hashes)).alias(places))
    base = F.struct(
        _size(F.col(words)).alias("n_words"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (_size(F.col(lines)) - _size(F.array_distinct(lines))).alias("n_dup_lines"),
        _covered(F.col(places)).alias("n_repeat_words"),
        F.array(*[_outside(F.col(text), k) for k in CLASSES.values()], F.length(F.regexp_replace(text, "[" + "".join(CLASSES.values()) + "]+", "")).cast("double")).alias("chars"),
        F.transform(common, lambda c: F.size(F.filter(words, lambda w: w == c)).cast("double")).alias("common"),
        F.coalesce(lang, F.lit("")).alias("lang"),
        F.col(part).alias("part"),
    )
    df = df.select(*had, base.alias(name))
    q = F.col(name)
    failed = (q["n_words"] < BASE_WORDS) | (100 * q["n_repeat_words"] > BASE_REPEAT_PERCENT * q["n_words"])
    listed_words = F.aggregate(q["common"], F.lit(0.0), lambda s, x: s + x)
    return df.select(*had, q.withField("base_failed", failed).withField("common", F.concat(q["common"], F.array(q["n_words"] - listed_words))).alias(name))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of counts with equal bins."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    part = lambda x: F.aggregate(F.array(total(x)), F.array().cast("array<double>"), lambda _, t: F.transform(x, lambda v: v / t))
    js = F.aggregate(F.zip_with(part(p), part(q), lambda a, b: (term(a, b) + term(b, a)) / 2), F.lit(0.0), lambda s, x: s + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(js, F.lit(0.0)))).otherwise(0.0)


def references(scored: DataFrame, name: str = "quality") -> DataFrame:
    """(lang, part, chars, common): summed histograms of the documents of the other part that pass the
    base rules."""
    q = F.col(name)
    width = len(CLASSES) + 1
    most = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get(q["chars"], F.lit(i))).alias(f"c{i}") for i in range(width)] + [F.sum(F.get(q["common"], F.lit(i))).alias(f"w{i}") for i in range(most)]
    got = scored.where(~q["base_failed"]).groupBy(q["lang"].alias("ref_lang"), (1 - q["part"]).alias("ref_part")).agg(*sums)
    return got.select(
        "ref_lang", "ref_part",
        F.array(*[f"c{i}" for i in range(width)]).alias("ref_chars"),
        F.filter(F.array(*[f"w{i}" for i in range(most)]), lambda x: x.isNotNull()).alias("ref_common"),
    )


def evaluate(docs: DataFrame, keep: list[str], name: str = "quality") -> DataFrame:
    """``keep`` and struct ``name`` with base counts, ``char_distance``, ``word_distance``, ``kept``."""
    scored = stage(features(docs, keep, name), "quality")
    refs = stage(references(scored, name), "quality-references")
    if refs.count() <= MOST_SENT:
        refs = F.broadcast(refs)
    ref = "ref"
    while ref.lower() in {c.lower() for c in [*keep, name]}:
        ref += "_"
    q, r = F.col(name), F.col(ref)
    df = scored.join(refs.select(F.struct("*").alias(ref)), (q["lang"] == r["ref_lang"]) & (q["part"] == r["ref_part"]), "left")
    long = (F.aggregate(q["chars"], F.lit(0.0), lambda s, x: s + x) >= MIN_CHARS) & (q["n_words"] >= MIN_WORDS) & r.isNotNull()
    had = [F.col(f"`{c}`") for c in keep]
    far = lambda a, b: F.when(long, distance(a, b)).otherwise(0.0)
    df = df.select(*had, q.withField("char_distance", far(q["chars"], r["ref_chars"])).withField("word_distance", far(q["common"], r["ref_common"])).alias(name))
    kept = ~q["base_failed"] & (q["char_distance"] <= MAX_CHAR_DISTANCE) & (q["word_distance"] <= MAX_WORD_DISTANCE)
    return df.select(*had, q.withField("kept", kept).alias(name))


def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate(documents(spark, sf_dir), ["doc_id"])
    return got.select("doc_id", *[F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], *[F.round(F.col("quality")[c], 6).alias(c) for c in ("char_distance", "word_distance")])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with their own columns."""
    name = "quality_verdict"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return evaluate(docs, docs.columns, name).where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
