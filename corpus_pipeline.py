"""A corpus, made ready for training: five stages, each on all that the one before it kept.

Documents of low quality go, one document of each group of near copies stays,
documents that hold benchmark passages go, personal data is replaced by its
kind, and what is left is mixed to the sources' target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import contamination, jaccard, kernel, mixing, pii, quality


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is trained on the labelled ones.

    Null and empty texts get the score of no words; repeated rows share a verdict; an empty table gives none; all columns stay.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, rows without an id last, and of rows that repeat it one.

    Null and blank texts are copies of none and all stay. An empty table gives none. All columns stay, whatever their names.
    """
    kernel.release(spark)
    row = kernel.free_name(docs, "_row")
    rows = kernel.numbered(docs, row)
    keyed = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text")
    groups = kernel.written(jaccard.groups(keyed, id_col="row").select("row", "component_id"), "groups")
    # groups of several rows: the smallest id of each, then the first row that has it
    several = groups.where("row <> component_id")
    heads = several.select("component_id").distinct()
    member = several.union(heads.select(F.col("component_id").alias("row"), "component_id")).join(keyed.select("row", "id"), "row")
    least = member.groupBy("component_id").agg(F.min("id").alias("least"))
    first = member.join(least, "component_id").where("id <=> least").groupBy("component_id").agg(F.min("row").alias("row"))
    copies = member.select("row").join(first.select("row"), "row", "left_anti").select(F.col("row").alias(row))
    return kernel.without(rows, kernel.written(copies, "copies"), row=row).select(*map(quoted, docs.columns))


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate.

    Null and empty texts stay; repeated rows share a verdict; an empty table, or benchmark, drops none; all columns stay, whatever their names.
    """
    row = kernel.free_name(docs, "_row")
    rows = kernel.numbered(docs, row)
    found = contamination.report(contamination.hits(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row))
    return kernel.without(rows, kernel.written(found.where("contaminated").select(row), "contaminated"), row=row).select(*map(quoted, docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced; n_chars follows the text.

    Null texts stay null and empty ones empty; repeated rows stay alike; an empty table gives none; all other columns stay as they are.
    """
    clean = pii.redact(docs, pii.train(spark, docs))
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies, size, target (of the source) and taken (words).

    Null and empty texts have no words and are never taken; of repeated rows each is a document; an empty table gives none.
    A column of docs that has one of the four names stays as it is, and the mix's own gets underscores.
    """
    kernel.release(spark)
    row = kernel.free_name(docs, "_row")
    rows = kernel.numbered(docs, row)
    taken = mixing.mix(rows, id_col=row).where("copies > 0")
    found = {"copies": F.col("copies"), "size": F.col("size"), "target": F.col("target"), "taken": F.col("size") * F.col("copies")}
    names = [kernel.free_name(docs, name) for name in found]
    taken = taken.select(row, *(value.alias(name) for value, name in zip(found.values(), names, strict=True)))
    return rows.join(taken, row).select(*map(quoted, docs.columns), *names)


def quoted(name: str) -> str:
    return f"`{name}`"


STAGES = [("quality", good), ("near_copies", distinct), ("decontamination", untested), ("personal_data", private), ("mixing", mixed)]

#: The classifiers and the rounding are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kernel.written(docs, name)
    return docs
