"""Readers: JSON documents, databases, text logs, dictionaries, judgements, events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas

FREQUENT = 10_000_000
MOST = 2**31 - 1


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of documents, or one a line; the schema is fixed."""
    rows = spark.read.schema(schemas.DOCUMENT).option("multiLine", True).json(path)
    return rows.withColumn("language", F.coalesce("language", F.lit("")))


def documents_jdbc(spark: SparkSession, url: str, properties: dict, partitions: int = 16, bounds: tuple[int, int] | None = None) -> DataFrame:
    """documents with their outlinks, both read in parallel by id where bounds are given; two scans and one join."""
    split = {"column": "doc_id", "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions} if bounds else {}
    docs = spark.read.jdbc(url, "documents", properties=properties, **split)
    links = spark.read.jdbc(url, "outlinks", properties=properties)
    return with_links(docs, links)


def with_links(docs: DataFrame, links: DataFrame) -> DataFrame:
    per = links.groupBy(F.col("from_doc_id").alias("doc_id")).agg(F.collect_list("to_url").alias("outlinks"))
    return docs.drop("outlinks").join(per, "doc_id", "left").withColumn("outlinks", F.coalesce("outlinks", F.array().cast("array<string>")))


def first_source(*loaders: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The first loader's frame that exists and has a row."""
    for load in loaders:
        try:
            rows = load()
            if rows is not None and not rows.isEmpty():
                return rows
        except AnalysisException:  # no such path
            continue
    return None


def images_json(spark: SparkSession, corpus_path: str) -> DataFrame:
    """The images beside a corpus file; none if there is no such file."""
    path = corpus_path.removesuffix(".json") + ".images.json"
    empty = spark.createDataFrame([], schemas.IMAGE)
    return first_source(lambda: spark.read.schema(schemas.IMAGE).option("multiLine", True).json(path)) or empty


def url_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def words(spark: SparkSession, path: str, default: int | None = None) -> DataFrame:
    """(word, frequency) of tab-separated lines, # begins a comment; lines without a number are skipped, or take the default."""
    line = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND v NOT LIKE '#%'")
    parts = F.split("v", "\t")
    n = F.try_to_number(F.trim(F.get(parts, F.lit(1))), F.lit("9999999999999999999")).cast("long")
    rows = line.select(F.trim(F.get(parts, F.lit(0))).alias("word"), F.coalesce(n, F.lit(default)).alias("frequency"))
    return rows.where("frequency IS NOT NULL").withColumn("frequency", F.least("frequency", F.lit(MOST)).cast("long"))


def qrels_json(spark: SparkSession, path: str) -> DataFrame:
    """(query, url, grade) of a map from query to a map from url to grade; a null grade is 0."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, int>>").alias("m"))
    return rows.select(F.explode("m").alias("query", "g")).select("query", F.explode("g").alias("url", "grade")).withColumn("grade", F.coalesce("grade", F.lit(0)))


def events_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USAGE).json(path)


def matches_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """Nested match data to typed rows; unknown leagues are 'unknown'."""
    kind = "struct<id: string, utcDate: timestamp, status: string, competition: struct<name: string>, homeTeam: struct<name: string>, awayTeam: struct<name: string>, score: struct<home: int, away: int>>"
    m = F.from_json(column, f"struct<matches: array<{kind}>>")
    return rows.select(F.explode(m["matches"]).alias("m")).select(
        F.col("m.id").alias("match_id"),
        F.coalesce("m.competition.name", F.lit("unknown")).alias("league"),
        F.col("m.homeTeam.name").alias("home"),
        F.col("m.awayTeam.name").alias("away"),
        F.col("m.utcDate").alias("kickoff"),
        F.col("m.status").alias("status"),
        F.col("m.score.home").alias("home_goals"),
        F.col("m.score.away").alias("away_goals"),
    )
