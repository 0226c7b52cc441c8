"""Suggestions: phrase counts and prefix look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import strip_diacritics


def by_prefix(counts: DataFrame, prefix: str, limit: int = 10, key: str = "term", display: str | None = None) -> DataFrame:
    """The most frequent keys with a prefix, 1 to 50 of them. Of keys with one display the most frequent counts."""
    limit = min(max(limit, 1), 50)
    rows = counts.where(F.col(key).startswith(prefix.lower()))
    if display:
        rows = rows.groupBy(display).agg(F.max("frequency").alias("frequency"))
    shown = display or key
    return rows.select(shown, "frequency").orderBy(F.desc("frequency"), shown).limit(limit)


def bigrams(rows: DataFrame, words: str, least: int = 3) -> DataFrame:
    """(phrase, frequency) of adjacent words, from an array column: no shuffle but the count's."""
    pairs = F.expr(f"transform(sequence(1, size({words}) - 1), i -> concat(element_at({words}, i), ' ', element_at({words}, i + 1)))")
    found = rows.where(F.size(words) > 1).select(F.explode(pairs).alias("phrase"))
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= least)


def phrases(rows: DataFrame, words: str, least: int = 3) -> DataFrame:
    """(phrase, frequency) of compounds (joined by _ in the column) and of adjacent words, written with spaces."""
    pairs = F.expr(f"transform(sequence(1, greatest(size({words}) - 1, 1)), i -> concat(element_at({words}, i), ' ', element_at({words}, i + 1)))")
    pairs = F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))
    compounds = F.filter(words, lambda w: F.contains(w, F.lit("_")))
    found = rows.select(F.explode(F.transform(F.concat(compounds, pairs), lambda p: F.replace(p, F.lit("_"), F.lit(" ")))).alias("phrase"))
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= least)


def both_forms(rows: DataFrame) -> DataFrame:
    """(key, display, frequency) from (display, frequency): each phrase by itself and without accents, shown as it is."""
    keys = F.array_distinct(F.array("display", strip_diacritics("display")))
    return rows.select(F.explode(keys).alias("key"), "display", F.col("frequency").cast("long").alias("frequency"))


def learned(counts: DataFrame, queries: DataFrame, weight: int = 1) -> DataFrame:
    """counts (key, display, frequency) with successful queries added under both forms; the last display wins, frequencies add up."""
    new = queries.select(F.lower(F.trim("query")).alias("display"), F.lit(weight).alias("frequency")).where("display <> ''")
    every = counts.select("key", "display", F.col("frequency").cast("long").alias("frequency"), F.lit(0).alias("_order")).unionByName(both_forms(new).withColumn("_order", F.lit(1)))
    return every.groupBy("key").agg(F.max_by("display", F.struct("_order", "display")).alias("display"), F.sum("frequency").alias("frequency"))
