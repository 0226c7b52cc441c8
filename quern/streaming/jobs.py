"""Structured Streaming forms of ingest, counting and alerting.

Each function turns a streaming (or batch) frame into another, so that the same
plan is tested on batches; `run` starts a query that stops when its input is
used up, with a checkpoint from which it resumes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import urls as U
from quern.operators.crawl import outlinks


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines arriving in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw values of a topic; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"))


def split_bad(values: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of JSON text: what can't be read keeps its text."""
    parsed = values.withColumn("_r", F.from_json("value", schema + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return parsed.where(~bad).select("_r.*").drop("_corrupt"), parsed.where(bad).select("value")


def page_links(pages: DataFrame) -> DataFrame:
    """OUTLINKS rows of PAGE_EVENT rows."""
    return pages.select(F.col("url").alias("source_url"), "host", outlinks(F.col("html"), F.col("url")).alias("outlinks"), "job_id", "depth", "crawled_at")


def discovered(pages: DataFrame, max_depth: int, domains: tuple[str, ...] = (), late: str = "1 hour") -> DataFrame:
    """DISCOVERED rows: accepted links, each once within the watermark."""
    links = page_links(pages).select(F.explode("outlinks").alias("url"), "source_url", "job_id", (F.col("depth") + 1).alias("depth"), "crawled_at")
    good = links.where(U.reject_reason(F.col("url"), F.col("depth"), max_depth, domains).isNull())
    once = good.withWatermark("crawled_at", late).dropDuplicatesWithinWatermark(["url"]) if pages.isStreaming else good.dropDuplicates(["url"])
    return once.select("url", U.host(F.col("url")).alias("host"), "depth", "source_url", "job_id")


def crawl_counts(pages: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Pages, mean size and greatest depth by window and language."""
    return pages.withWatermark("crawled_at", late).groupBy(F.window("crawled_at", every), F.coalesce(F.nullif("language", F.lit("")), F.lit("und")).alias("language")).agg(F.count(F.lit(1)).alias("pages"), F.avg(F.length("html")).alias("mean_size"), F.max("depth").alias("max_depth"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event-time hours: sessions (approximately), searches, clicks."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour")).agg(F.approx_count_distinct("session_id").alias("sessions"), F.count_if(F.col("type") == "search").alias("searches"), F.count_if(F.col("type") == "click").alias("clicks"))


def sessions(events: DataFrame) -> DataFrame:
    """First and last time of each session, and its first user name."""
    return events.groupBy("session_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min_by("username", F.when(F.col("username").isNotNull(), F.col("ts"))).alias("username"))


def top_counts(events: DataFrame, key: Column, name: str) -> DataFrame:
    return events.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def best_image(images: DataFrame) -> DataFrame:
    """The best image of each page so far, as an aggregate's state of one row a page."""
    rank = F.struct(U.image_tier(F.col("image_url"), F.col("declared_width")).alias("tier"), "declared_width", (F.trim(F.coalesce("alt_text", F.lit(""))) != "").alias("alt"))
    return images.groupBy("page_url").agg(F.max_by(F.struct("image_url", "alt_text", "declared_width"), rank).alias("best"))


def routed(rows: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known jobs, and the others."""
    known = jobs.select("job_id", F.lit(True).alias("_known"))
    joined = rows.join(known, "job_id", "left")
    return joined.where("_known").drop("_known"), joined.where("_known IS NULL").drop("_known")


def alerts(samples: DataFrame, name: str, limit: float, hold: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Windows of `hold` in which every step's value of a metric is over the limit. samples: (ts, metric, value)."""
    steps = samples.where(F.col("metric") == name).groupBy(F.window("ts", step)).agg(F.max("value").alias("value"))
    wide = steps.select(F.window(F.col("window.start"), hold).alias("window"), (F.col("value") > limit).alias("over"))
    return wide.groupBy("window").agg(F.every("over").alias("firing")).where("firing").select("window")


# Rule, metric, how its samples of a step become one number, limit, whether it fires below or above, minutes to hold.
RULES = (
    ("down", "up", "least", 1.0, "below", 2),
    ("empty_index", "index_documents", "least", 1.0, "below", 10),
    ("slow_search", "search_p99_seconds", "most", 0.5, "above", 5),
    ("errors", "error_ratio", "most", 0.05, "above", 5),
    ("bus_failures", "bus_failures_in_5m", "most", 0.0, "above", 5),
    ("consumer_lag", "consumer_lag", "most", 10_000.0, "above", 10),
    ("dead_letters", "dead_letters_in_15m", "most", 10.0, "above", 15),
)


def held(samples: DataFrame, rules=RULES) -> DataFrame:
    """(rule, series, minute) of every minute that ends as many minutes as the rule asks for, each with a sample beyond its limit.

    samples: (ts, metric, series, value). A minute without samples breaks the row of minutes.
    """
    table = ", ".join(f"('{n}', '{m}', '{how}', {limit}D, '{side}', {hold})" for n, m, how, limit, side, hold in rules)
    known = samples.sparkSession.sql(f"SELECT * FROM VALUES {table} AS r(rule, metric, how, edge, side, hold)")
    minute = F.floor(F.unix_seconds("ts") / 60)
    steps = samples.groupBy("metric", "series", minute.alias("minute")).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    rows = steps.join(F.broadcast(known), "metric")  # seven rows
    value = F.when(F.col("how") == "least", F.col("least")).otherwise(F.col("most"))
    over = rows.where(F.when(F.col("side") == "below", value < F.col("edge")).otherwise(value > F.col("edge"))).select("rule", "series", "minute", "hold")
    # minutes in a row have one difference to their place
    place = F.row_number().over(Window.partitionBy("rule", "series").orderBy("minute"))
    runs = over.withColumn("_run", F.col("minute") - place)
    length = F.row_number().over(Window.partitionBy("rule", "series", "_run").orderBy("minute"))
    return runs.withColumn("_length", length).where("_length >= hold").select("rule", "series", "minute")


def increase(samples: DataFrame, name: str, every: str = "1 minute") -> DataFrame:
    """Growth of a counter by window; a counter that starts anew counts from 0."""
    return samples.where(F.col("metric") == name).groupBy(F.window("ts", every)).agg((F.max_by("value", "ts") - F.min_by("value", "ts")).alias("d")).select("window", F.greatest("d", F.lit(0.0)).alias("increase"))


def quantiles(samples: DataFrame, value: str, every: str = "1 minute") -> DataFrame:
    return samples.groupBy(F.window("ts", every)).agg(F.percentile_approx(value, [0.5, 0.95, 0.99]).alias("q"))


def run(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, table: str | None = None, mode: str = "append"):
    """Runs a query over what there is, to a folder, an in-memory table or a function of batches; resumes from its checkpoint."""
    w = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if sink is not None:
        w = w.foreachBatch(sink)
    elif table is not None:
        w = w.format("memory").queryName(table)
    else:
        w = w.format("parquet").option("path", path)
    q = w.start()
    q.awaitTermination()
    return q


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch overwrites: at-least-once delivery leaves each batch once."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return each


EVENT_SCHEMAS = {"pages": schemas.PAGE_EVENT, "urls": schemas.DISCOVERED, "outlinks": schemas.OUTLINKS, "images": schemas.IMAGE, "usage": schemas.USAGE}
