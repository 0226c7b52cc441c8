"""A registry of queries over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INDEXES: dict[tuple, object] = {}


class Tables:
    """The Parquet tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def index(self):
        """The index of documents' texts: stored once for a session and a state of the table, then read."""
        from quern.operators import index, scratch

        rows = self.documents
        files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
        key = (self.spark.sparkContext.applicationId, self.sf_dir, tuple(sorted(map(str, files))))
        if key not in INDEXES:
            # texts alone make the terms, and these without their accent-free forms
            built = index.build(rows.select("doc_id", rows["text"].alias("body_text")), folded=False)
            INDEXES[key] = index.stored(built, scratch.path(self.spark, "index"))
        return INDEXES[key]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add
