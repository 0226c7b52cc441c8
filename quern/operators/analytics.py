"""Usage analytics, corpus statistics, histograms and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U

# Fixed values.
LATENCY_BOUNDS = (10, 50, 100, 200, 500, 1000)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def checked_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted events with defaults filled in, and the rejected ones (unknown type)."""
    rows = raw.withColumn("type", F.lower(F.trim("type")))
    good = F.coalesce(F.col("type").isin("visit", "search", "click"), F.lit(False))
    filled = rows.where(good).withColumns({"result_count": F.coalesce("result_count", F.lit(0)), "took_ms": F.coalesce("took_ms", F.lit(-1)), "position": F.coalesce("position", F.lit(0))})
    return filled, rows.where(~good)


def usage(events: DataFrame, now: Column, active_minutes: int = 5) -> DataFrame:
    """One row of figures over USAGE events; sessions first, so that the last aggregate has one small row for each."""
    search, click = F.col("type") == "search", F.col("type") == "click"
    timed = F.when(search & (F.col("took_ms") >= 0), F.col("took_ms"))
    sessions = events.groupBy("session_id").agg(
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.count_if(search).alias("searches"),
        F.count_if(click).alias("clicks"),
        F.count_if(search & (F.col("result_count") == 0)).alias("zero"),
        F.sum(timed).alias("ms"),
        F.count(timed).alias("timed"),
        F.min_by("username", F.when(F.col("username").isNotNull(), F.col("ts"))).alias("username"),
    )
    out = sessions.agg(
        F.count("session_id").alias("visitors"),
        F.count_distinct("username").alias("signed_in"),
        F.count_if(F.col("last") >= now - F.expr(f"INTERVAL {active_minutes} MINUTES")).alias("active"),
        F.coalesce(F.sum("searches"), F.lit(0)).alias("searches"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("zero"), F.lit(0)).alias("zero_results"),
        ratio(F.sum("ms"), F.sum("timed")).alias("avg_latency_ms"),
        ratio(F.sum(F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 60_000_000, F.count("session_id")).alias("mean_session_minutes"),
    )
    return out.withColumn("ctr", ratio(F.col("clicks"), F.col("searches"))).withColumn("zero_result_rate", ratio(F.col("zero_results"), F.col("searches")))


def bucket(value: Column, bounds: tuple[int, ...] = LATENCY_BOUNDS) -> Column:
    """The number of bounds that value reaches: bucket 0 is below the first."""
    return sum(((value >= b).cast("int") for b in bounds), F.lit(0))


def histogram(events: DataFrame, value: str, bounds: tuple[int, ...] = LATENCY_BOUNDS) -> DataFrame:
    """(bucket, n) with all buckets; negative values don't count."""
    spine = events.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket"))
    counts = events.where(F.col(value) >= 0).groupBy(bucket(F.col(value), bounds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top(rows: DataFrame, key: str, n: int, *extra: Column) -> DataFrame:
    """The n most frequent keys, ties by key; n from 1 to 100."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *extra).orderBy(F.desc("n"), key).limit(min(max(n, 1), 100))


def top_queries(events: DataFrame, n: int) -> DataFrame:
    rows = events.where("type = 'search'").select(T.normal_query(F.col("query")).alias("query")).where("query <> ''")
    return top(rows, "query", n)


def top_users(events: DataFrame, n: int) -> DataFrame:
    return top(events.where("coalesce(username, '') <> ''"), "username", n)


def top_links(events: DataFrame, n: int) -> DataFrame:
    place = F.avg(F.when(F.col("position") > 0, F.col("position"))).alias("avg_position")
    return top(events.where("type = 'click' AND coalesce(url, '') <> ''"), "url", n, place)


def top_hosts(events: DataFrame, n: int) -> DataFrame:
    return top(events.where("type = 'click' AND coalesce(url, '') <> ''").withColumn("host", U.shown_host(F.col("url"))), "host", n)


def hourly(events: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(hour, sessions, searches, clicks) for each of the last hours up to now's, zeros where nothing was."""
    last = F.date_trunc("hour", now)
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(last - F.expr(f"INTERVAL {hours - 1} HOURS"), last, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    rows = events.where(F.col("ts") >= last - F.expr(f"INTERVAL {hours - 1} HOURS")).groupBy(F.date_trunc("hour", "ts").alias("hour"))
    counts = rows.agg(F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("type") == "search").alias("searches"), F.count_if(F.col("type") == "click").alias("clicks"))
    return spine.join(counts, "hour", "left").fillna(0, ["sessions", "searches", "clicks"])


def daily(rows: DataFrame, ts: str, today: Column, days: int = 14, zone: str = "UTC") -> DataFrame:
    """(day, n) for each of the last days in a zone, ending today, zeros where nothing was."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    counts = rows.groupBy(F.to_date(F.from_utc_timestamp(ts, zone)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def at_place(rows: DataFrame, value: str, share: float) -> Column:
    """sorted[min(n - 1, floor(share * n))] as an aggregate: exact, by counts of values, so a million equal values are one entry."""
    return F.expr(f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY {value})")


def placed(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at min(n - 1, floor(share * n)) in order. Values are counted first; the running sum is over distinct values."""
    from pyspark.sql.window import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ends = counts.select(value, upto.alias("upto")).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("total"))))
    return ends.agg(*(F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(s) * F.col("total"))), F.col(value))).alias(name) for name, s in shares.items()))


def corpus(docs: DataFrame) -> DataFrame:
    """One row over DOCUMENT rows with doc_length: counts, hosts, links, median length, crawl times."""
    links = F.coalesce(F.size("outlinks"), F.lit(0))
    one = docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct(U.shown_host(F.col("url"))).alias("hosts"),
        F.coalesce(F.sum(links), F.lit(0)).alias("outlinks"),
        F.coalesce(F.avg(links), F.lit(0.0)).alias("avg_outlinks"),
        F.count_if(links == 0).alias("dangling"),
        F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_length"),
        F.min("crawled_at").alias("first_crawled"),
        F.max("crawled_at").alias("last_crawled"),
    )
    targets = docs.select(F.explode("outlinks").alias("t")).distinct().agg(F.count(F.lit(1)).alias("link_targets"))
    return one.crossJoin(F.broadcast(targets)).crossJoin(F.broadcast(placed(docs, "doc_length", {"median_length": 0.5})))


def entropy(rows: DataFrame, n: str) -> DataFrame:
    """One row: entropy in bits over counts (negative ones are 0), and normalised by log2 of the number of positive ones."""
    v = F.greatest(F.col(n), F.lit(0)).cast("double")
    total = rows.agg(F.sum(v).alias("total"))
    p = v / F.col("total")
    out = rows.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(F.when(v > 0, p * F.log2(p))), F.lit(0.0)).alias("h"), F.count_if(v > 0).alias("k"))
    return out.select(F.abs("h").alias("entropy"), F.when(F.col("k") <= 1, 0.0).otherwise(F.abs("h") / F.log2(F.col("k").cast("double"))).alias("normalised"))


def head_share(rows: DataFrame, n: str, k: int) -> DataFrame:
    """One row: the share of the k largest."""
    head = rows.orderBy(F.desc(n)).limit(k).agg(F.sum(n).alias("head"))
    return rows.agg(F.sum(n).alias("total")).crossJoin(F.broadcast(head)).select(ratio(F.col("head"), F.col("total")).alias("share"))


def fold_tail(rows: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """The k largest, and the rest as 'other' if there is any."""
    head = rows.orderBy(F.desc(n), key).limit(k).select(key, n)
    rest = rows.agg(F.sum(n).alias("t")).crossJoin(F.broadcast(head.agg(F.sum(n).alias("h")))).select(F.lit("other").alias(key), (F.col("t") - F.col("h")).alias(n))
    return head.union(rest.where(F.col(n) > 0))
