"""Part-of-text search at size: trigram postings give candidates, which are then compared."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import search_term

GRAM = 3


def postings(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(gram, key): the distinct trigrams of each row's lower-case texts; write it partitioned or sorted by
    gram, and a term reads its own grams only."""

    def grams(column: str) -> Column:
        text = F.lower(F.coalesce(F.col(column), F.lit("")))
        every = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substr(text, i, F.lit(GRAM)))
        return F.when(F.length(text) >= GRAM, every).otherwise(F.array().cast("array<string>"))

    return rows.select(F.explode(F.array_distinct(F.concat(*map(grams, columns)))).alias("gram"), key)


def grams_of(term: str, wildcards: bool = True) -> list[str]:
    """Trigrams that each text with the term has; % and _ stand for any text where ``wildcards``."""
    parts = re.split("[%_]", term) if wildcards else [term]
    return sorted({p[i : i + GRAM] for p in map(str.lower, parts) for i in range(len(p) - GRAM + 1)})


def search(rows: DataFrame, index: DataFrame, key: str, term: str, *columns: str, wildcards: bool = True) -> DataFrame:
    """Rows in which a column has the term, as ``filters.search_term`` finds them.  Keys that have all of the
    term's grams are candidates; terms without a gram are compared with every row."""
    found = search_term(term, *columns, wildcards=wildcards)
    grams = grams_of(term, wildcards)
    if not grams:
        return rows.where(found)
    wanted = reduce(lambda a, b: a | b, [F.col("gram") == g for g in grams])
    keys = index.where(wanted).groupBy(key).agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(grams)).select(key)
    return rows.join(keys, key, "left_semi").where(found)
