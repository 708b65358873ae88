"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Words are laid out shard by shard (a shard: a seeded share of one source's documents) and cut
into blocks of ``BLOCK`` words.  The blocks of the whole mix go to sources by highest quotients,
each source's blocks go to its shards the same way, and a seeded permutation picks the blocks
that a shard gives once more than the rest.  DataFrame functions only.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source
of its own, last in order; rows that repeat a doc_id count one by one; an empty table gives an
empty result; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stage

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK = 16
SHARD_WORDS = 16_384
MOST_SHARDS = 65_536
SEED = 20_240_115
#: Multipliers of the seeded permutation: primes above any number of blocks of a shard.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579)
#: A source table of up to so many rows is sent to every task.
MOST_SENT = 10_000


def sainte_lague(votes: DataFrame, group: list[str], party: str) -> DataFrame:
    """Adds ``seats``: columns ``votes`` and, equal within a group, ``to_fill`` are given.

    Highest quotients votes / (2k + 1), ties to the smaller party.  A seat that clears the
    divisor of the lower bound is won anyway, and one under the upper bound's never is, so only
    a few quotients of each party are ranked, however many seats there are.
    """
    by = Window.partitionBy(*group)
    df = votes.withColumns({"_v": F.sum("votes").over(by), "_n": F.sum((F.col("votes") > 0).cast("long")).over(by)})
    least = F.when((F.col("_v") > 0) & (F.col("to_fill") > F.col("_n") / 2), F.floor(F.col("votes") * (F.col("to_fill") - F.col("_n") / 2) / F.col("_v") + 0.5) - 1).otherwise(0)
    most = F.when(F.col("_v") > 0, F.floor(F.col("votes") * (F.col("to_fill") + F.col("_n") / 2) / F.col("_v") + 0.5) + 1).otherwise(0)
    df = df.withColumns({"_low": F.greatest(F.lit(0), least).cast("long"), "_high": F.when(F.col("votes") > 0, most).otherwise(0).cast("long")})
    df = df.withColumn("_left", F.col("to_fill") - F.sum("_low").over(by))
    open_ = df.where("_high > _low").select(*group, party, "_left", (F.col("votes") * 1.0).alias("_votes"), F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col("_votes") / (2 * F.col("_k") + 1)), party, "_k"))
    won = open_.withColumn("_rank", rank).where("_rank <= _left").groupBy(*group, party).agg(F.count("*").alias("_won"))
    df = df.join(won, [*group, party], "left").withColumn("seats", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return df.drop("_v", "_n", "_low", "_high", "_left", "_won")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, source_size, target) from rows (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    table = stage(totals.withColumn("source_no", no).withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * float(MOST_TIMES)
    words = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    # the level at which capped sources hold their cap and others weight x level; a round adds caps
    while True:
        full = cap <= F.col("weight") * level
        held, weight_left, n = table.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
        if not weight_left or n == before:
            break
        level, before = (words - held) / weight_left, n
    return table.withColumn("target", F.least(cap, F.col("weight") * level)).drop("weight")


def mix(sizes: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Adds source_size, target, taken to rows with doc_id, source, size (other columns stay)."""
    targets = source_targets(sizes.select("source", "size"))
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    votes = targets.select("source", "source_no", "source_size", "target", F.col("target").alias("votes"), F.lit(words // block).alias("to_fill"), F.lit(0).alias("all"))
    quotas = stage(
        sainte_lague(votes, ["all"], "source_no").select(
            "source", "source_no", "source_size", "target", F.col("seats").alias("quota"),
            F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("long").alias("shards"),
        ), "mix-quotas")
    sent = F.broadcast(quotas) if quotas.count() <= MOST_SENT else quotas
    placed = sizes.alias("d").join(sent.alias("q"), F.expr("d.source <=> q.source")).select("d.*", "q.source_no", "q.source_size", "q.target", "q.quota", "q.shards")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "shards")).drop("shards")
    shards = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("votes"), F.first("quota").alias("to_fill"))
    blocks = F.ceil(F.col("votes") / block).cast("long")
    given = F.least(F.col("seats"), MOST_TIMES * F.col("blocks"))
    drawn = F.xxhash64(F.lit(seed), "source_no", "shard")
    shards = sainte_lague(shards, ["source_no"], "shard").withColumn("blocks", blocks).withColumn("seats", given).where("blocks > 0").select(
        "source_no", "shard", "blocks", F.floor(F.col("seats") / F.col("blocks")).cast("long").alias("times"), (F.col("seats") % F.col("blocks")).alias("extra"),
        F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(drawn, F.lit(len(PRIMES))) + 1).cast("int")).cast("long").alias("step"),
        F.pmod(F.shiftright(drawn, 8), "blocks").alias("shift"),
    )
    order = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.drop("quota").withColumn("_from", F.coalesce(F.sum("size").over(order), F.lit(0)))
    laid = laid.join(stage(shards, "mix-shards"), ["source_no", "shard"], "left")
    to = F.col("_from") + F.col("size")
    picked = lambda j: F.pmod(F.pmod(j, F.col("blocks")) * F.pmod(F.col("step"), F.col("blocks")) + F.col("shift"), F.col("blocks")) < F.col("extra")
    overlap = lambda j: F.least((j + 1) * block, to) - F.greatest(j * block, F.col("_from"))
    more = F.aggregate(F.sequence(F.floor(F.col("_from") / block), F.floor((to - 1) / block)), F.lit(0).cast("long"), lambda s, j: s + F.when(picked(j), overlap(j)).otherwise(0))
    taken = F.when((F.col("size") > 0) & F.col("blocks").isNotNull(), F.col("times") * F.col("size") + more).otherwise(0).cast("long")
    return laid.withColumn("taken", taken).drop("source_no", "shard", "_from", "blocks", "times", "extra", "step", "shift")


def n_words(text: str = "text"):
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(documents(spark, sf_dir).select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document stands as often as the mix takes it, 0 to 3 times; a part
    of a document counts as a whole one with that probability, drawn by seed."""
    row = [F.col(f"`{c}`") for c in docs.columns]
    sizes = stage(docs.select("doc_id", "source", n_words().alias("size"), F.struct(*row).alias("row")), "mix-rows")
    got = mix(sizes)
    share = F.col("taken") / F.col("size")
    drawn = F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    times = F.when(F.col("size") > 0, F.floor(share) + (drawn < share - F.floor(share)).cast("long")).otherwise(0).cast("int")
    return got.withColumn("times", times).where("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
