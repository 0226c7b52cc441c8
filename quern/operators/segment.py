"""Vietnamese word segmentation by a dictionary of weights, and its comparison with longest match."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quern.functions.text import syllables

# Power of the logarithm and of the length, by number of syllables.
WEIGHTS = {1: (0.38, 1.00), 2: (0.14, 2.59), 3: (1.42, 4.42), 4: (1.45, 0.23)}
UNKNOWN = 0.5
BIGRAM_FREQUENCY = 10_000_000
LONGEST = 4


def weight(frequency: int, n: int) -> float:
    power, length = WEIGHTS[n]
    return math.log2(frequency + 3) ** power * n**length


def dictionary(words: DataFrame, most: int = 2_000_000) -> dict[str, float]:
    """The largest weight of each word of 1 to 4 syllables, from (word, frequency). It is sent to all tasks, so more than `most` words are an error."""
    rows = words.select(F.lower(F.trim(F.regexp_replace("word", r"\s+", " "))).alias("word"), "frequency").where("word <> ''")
    rows = rows.where(F.size(F.split("word", " ")) <= LONGEST).groupBy("word").agg(F.max("frequency").alias("f"))
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a dictionary of more than {most} words")
    return {(w := unicodedata.normalize("NFC", r["word"])): weight(r["f"], w.count(" ") + 1) for r in rows.collect()}


def segmented(parts: list[str], known: dict[str, float]) -> list[str]:
    """The cut of greatest total weight, the first of equal ones; compounds are joined by _."""
    best, cut = [0.0] + [-math.inf] * len(parts), [0] * (len(parts) + 1)
    for end in range(1, len(parts) + 1):
        for n in range(min(LONGEST, end), 0, -1):
            w = known.get(" ".join(parts[end - n : end]), UNKNOWN if n == 1 else None)
            if w is not None and best[end - n] + w > best[end]:
                best[end], cut[end] = best[end - n] + w, end - n
    out, end = [], len(parts)
    while end:
        out.append("_".join(parts[cut[end] : end]))
        end = cut[end]
    return out[::-1]


def longest_match(parts: list[str], known: dict[str, float]) -> list[str]:
    out, at = [], 0
    while at < len(parts):
        n = next((n for n in range(min(LONGEST, len(parts) - at), 1, -1) if " ".join(parts[at : at + n]) in known), 1)
        out.append("_".join(parts[at : at + n]))
        at += n
    return out


def segmenter(spark: SparkSession, known: dict[str, float], stopwords: frozenset[str] = frozenset(), cut=segmented):
    """A column function: text to terms. The dictionary is one broadcast; stop words are single syllables."""
    sent = spark.sparkContext.broadcast(known)

    @F.pandas_udf(ArrayType(StringType()))
    def terms(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: [w for w in cut([unicodedata.normalize("NFC", x) for x in p], sent.value) if w not in stopwords])

    return lambda text: terms(syllables(text))


def build_dictionary(lines: DataFrame) -> DataFrame:
    """(word, frequency) from raw 'word words frequency' lines: letters and digits only, 1 to 4 syllables, the largest frequency; single syllables only with an accent or if a compound has them."""
    clean = F.trim(F.regexp_replace(F.lower("line"), r"\s+", " "))
    rows = lines.select(F.regexp_extract(clean, r"^(.*) (\d+)$", 1).alias("word"), F.regexp_extract(clean, r"^(.*) (\d+)$", 2).alias("f"))
    rows = rows.where(F.col("word").rlike(r"^[\p{L}\p{N} ]+$") & (F.size(F.split("word", " ")) <= LONGEST))
    words = rows.groupBy("word").agg(F.max(F.col("f").cast("long")).alias("frequency"))
    used = words.where("word LIKE '% %'").select(F.explode(F.split("word", " ")).alias("word")).distinct()
    single = words.where("word NOT LIKE '% %'")
    kept = single.where(F.col("word").rlike(r"[^\x00-\x7F]")).union(single.where(~F.col("word").rlike(r"[^\x00-\x7F]")).join(used, "word", "left_semi"))
    return words.where("word LIKE '% %'").union(kept).orderBy(F.desc("frequency"), "word")


def boundaries(words: list[str]) -> set[int]:
    out, at = set(), 0
    for w in words:
        at += w.count("_") + 1
        out.add(at)
    return out


def compare(texts: list[list[str]], known: dict[str, float]) -> dict:
    """How often the two ways of cutting differ."""
    pairs = [(segmented(t, known), longest_match(t, known)) for t in texts]
    return {"texts": len(pairs), "different": sum(a != b for a, b in pairs), "boundaries": sum(len(boundaries(a) ^ boundaries(b)) for a, b in pairs)}
