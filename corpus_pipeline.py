"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to
the shared folder and read again as the next stage's docs.  The quality rules compare floating
sums of logarithms, the Jaccard stage is a closure over links, and the last stages are a suffix
sort, a seeded choice and a Viterbi search, so there is no SQL for the whole: tests hold every
stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from restgrid.llm.common import documents, stage
from restgrid.llm.jaccard import jaccard_stage
from restgrid.llm.mixing import mixing_stage
from restgrid.llm.pieces import pieces_stage
from restgrid.llm.quality import quality_stage
from restgrid.llm.suffixes import suffix_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_array_dedup", suffix_stage),
    ("mix_sources", mixing_stage),
    ("sentencepiece", pieces_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
