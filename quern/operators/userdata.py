"""Per-user tables: upserts, history, downloads, settings, cached match data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import normal_query

# What a download may turn into.
TRANSITIONS = (
    ("IN_PROGRESS", "PAUSED"),
    ("IN_PROGRESS", "COMPLETED"),
    ("IN_PROGRESS", "CANCELLED"),
    ("IN_PROGRESS", "INTERRUPTED"),
    ("PAUSED", "IN_PROGRESS"),
    ("PAUSED", "CANCELLED"),
    ("PAUSED", "INTERRUPTED"),
    ("INTERRUPTED", "IN_PROGRESS"),
)
TERMINAL = ("COMPLETED", "CANCELLED", "INTERRUPTED")


def latest(rows: DataFrame, keys: list[str], order: str, *more: str) -> DataFrame:
    """The last row of each key: an aggregate with partial maxima, no window over a hot key."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(order, *more)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table with the last change of each key; a change beats the row that is there."""
    old = table.select("*", F.lit(0).alias("_new"))
    new = changes.select(*table.columns, F.lit(1).alias("_new"))
    return latest(old.unionByName(new), keys, "_new", order).drop("_new")


def upsert_visits(visits: DataFrame) -> DataFrame:
    """One row a user and url: visits add up, the last title and time, the first host; private ones are never kept."""
    rows = visits.where("NOT coalesce(incognito, false)")
    return rows.groupBy("username", "url").agg(F.max_by("title", "visited_at").alias("title"), F.min_by("host", "visited_at").alias("host"), F.max("visited_at").alias("visited_at"), F.sum("visit_count").alias("visit_count"))


def upsert_queries(queries: DataFrame) -> DataFrame:
    rows = queries.withColumn("normalized", normal_query(F.col("query"))).where("normalized <> ''")
    return rows.groupBy("username", "normalized").agg(F.max_by("query", "searched_at").alias("query"), F.max_by("result_count", "searched_at").alias("result_count"), F.max("searched_at").alias("searched_at"), F.count(F.lit(1)).alias("n"))


def upsert_downloads(table: DataFrame, changes: DataFrame) -> DataFrame:
    """New values win, but an unknown total or path keeps the old one; a row of another user stays as it is. Both tables have one row an id."""
    new = changes.select(*(F.col(c).alias(f"_{c}") for c in changes.columns))
    both = table.join(new, table["id"] == new["_id"], "full")
    ours = F.col("_id").isNotNull() & (F.col("id").isNull() | (F.col("username") == F.col("_username")))

    def pick(c: str) -> Column:
        value = F.coalesce(F.col(f"_{c}"), F.col(c)) if c in ("total_bytes", "local_path") else F.col(f"_{c}")
        return F.when(ours, value).otherwise(F.col(c)).alias(c)

    return both.select(*(pick(c) for c in table.columns))


def started(table: DataFrame, requests: DataFrame) -> DataFrame:
    """table with the requests whose id it doesn't have: a download that was started before stays as it is."""
    return table.unionByName(requests.join(table.select("id"), "id", "left_anti").select(*table.columns))


def merge_settings(table: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(username, settings MAP, version) merged with changes (username, patch, removed, replace, expected): the new table and the changes whose expected version was another."""
    both = table.join(changes, "username", "full")
    ok = F.col("expected").isNull() | (F.col("expected") == F.coalesce("version", F.lit(0)))
    empty = F.create_map().cast("map<string,string>")
    patch, old = F.coalesce("patch", empty), F.when(F.coalesce("replace", F.lit(False)), empty).otherwise(F.coalesce("settings", empty))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(patch, k))
    merged = F.map_filter(F.map_concat(kept, patch), lambda k, _: ~F.array_contains(F.coalesce("removed", F.array().cast("array<string>")), k))
    changed = F.col("patch").isNotNull() | F.col("removed").isNotNull()
    new = both.select("username", F.when(changed & ok, merged).otherwise(F.col("settings")).alias("settings"), (F.coalesce("version", F.lit(0)) + F.when(changed & ok, 1).otherwise(0)).alias("version"))
    return new.where("settings IS NOT NULL"), both.where(changed & ~ok).select("username", "expected", "version")


def history(visits: DataFrame, username: str, keyword: str | None = None, start=None, end=None) -> DataFrame:
    """A user's visits, newest first: by a literal keyword in title or url, else by time if both bounds are given."""
    rows = visits.where(F.col("username") == username)
    if keyword:
        q = keyword.lower()
        rows = rows.where(F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("url"), F.lit(q)))
    elif start is not None and end is not None:
        rows = rows.where(F.col("visited_at").between(start, end))
    return rows.orderBy(F.desc("visited_at"), "url")


def page(rows: DataFrame, number: int, size: int, most: int = 200) -> tuple[DataFrame, dict]:
    """A page (from 0) of ordered rows and its envelope."""
    size = min(max(size, 1), most)
    total = rows.count()
    return rows.limit((number + 1) * size).offset(number * size), {"page": number, "size": size, "total": total, "total_pages": -(-total // size)}


def suggest_queries(queries: DataFrame, username: str, prefix: str, limit: int = 10) -> DataFrame:
    rows = queries.where((F.col("username") == username) & F.col("normalized").startswith(" ".join(prefix.lower().split())))
    return rows.orderBy(F.desc("searched_at"), "normalized").limit(limit)


def percent(received: Column, total: Column) -> Column:
    """Whole percent, 100 at most, null without a positive total."""
    return F.when(total > 0, F.least(F.floor(received * 100 / total), F.lit(100)).cast("int"))


def download_faults(rows: DataFrame) -> DataFrame:
    """rows with faults, the names of the rules that a row breaks."""
    done = F.col("state").isin(*TERMINAL)
    rules = {
        "received": F.col("received_bytes") < 0,
        "total": F.col("total_bytes") < F.col("received_bytes"),
        "finished": F.col("finished_at").isNotNull() != done,
    }
    return rows.withColumn("faults", F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull()))


def bad_transitions(states: DataFrame, key: str, order: str, allowed=TRANSITIONS) -> DataFrame:
    """Changes of state that the table of transitions doesn't have."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(order))
    ok = F.concat_ws(">", "before", "state").isin(*(f"{a}>{b}" for a, b in allowed))
    return states.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("state"))).where(~ok)


def active(downloads: DataFrame) -> DataFrame:
    return downloads.where(F.col("state").isin("IN_PROGRESS", "PAUSED")).orderBy(F.desc("started_at"), "id")


def cache_verdict(has_key: Column, fresh: Column, cached: Column, calls: Column, budget: int, provider_ok: Column) -> Column:
    """unavailable without a key, cache if fresh, live within the budget, else stale or unavailable."""
    rest = F.when(cached, F.lit("stale")).otherwise("unavailable")
    return F.when(~has_key, "unavailable").when(fresh, "cache").when((calls >= budget) | ~provider_ok, rest).otherwise("live")


def by_day(visits: DataFrame, ts: str, zone: str) -> DataFrame:
    """(day, n, urls) of visits in the user's zone, newest first within a day."""
    day = F.to_date(F.from_utc_timestamp(ts, zone)).alias("day")
    return visits.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(ts, "url")))), lambda x: x["url"]).alias("urls"))


def recent_urls(visits: DataFrame, limit: int, ts: str = "visited_at") -> DataFrame:
    return visits.groupBy("url").agg(F.max(ts).alias(ts)).orderBy(F.desc(ts), "url").limit(limit)


def bookmarks(rows: DataFrame, prefix: str) -> DataFrame:
    """Those with a title word that begins with prefix; all for an empty one."""
    return rows.where(F.exists(F.split(F.lower("title"), r"\s+"), lambda w: w.startswith(prefix.lower().strip())))


def merged_downloads(local: DataFrame, remote: DataFrame) -> DataFrame:
    """By id, the local row wins; newest first."""
    both = local.withColumn("_mine", F.lit(1)).unionByName(remote.withColumn("_mine", F.lit(0)))
    return latest(both, ["id"], "_mine", "started_at").drop("_mine").orderBy(F.desc("started_at"), "id")


def ranked_matches(matches: DataFrame) -> DataFrame:
    """Live ones, then finished (newest first), then scheduled (soonest first)."""
    weight = F.when(F.col("status") == "LIVE", 0).when(F.col("status") == "FINISHED", 1).otherwise(2)
    at = F.unix_micros(F.col("kickoff").cast("timestamp"))
    return matches.orderBy(weight, F.when(F.col("status") == "FINISHED", -at).otherwise(at), "match_id")


def fixtures(matches: DataFrame, team: str | None = None, league: str | None = None, day=None) -> DataFrame:
    rows = matches
    if team is not None:
        rows = rows.where((F.col("home") == team) | (F.col("away") == team))
    if league is not None:
        rows = rows.where(F.col("league") == league)
    if day is not None:
        rows = rows.where(F.to_date("kickoff") == F.lit(day))
    return rows.orderBy("kickoff", "match_id")


def grouped_fixtures(matches: DataFrame, favourites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Favourites' matches, pinned; and the others by competition."""
    mine = matches.join(favourites.select("match_id").distinct(), "match_id", "left_semi")
    rest = matches.join(favourites.select("match_id").distinct(), "match_id", "left_anti")
    return mine.orderBy("kickoff", "match_id"), rest.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.min("kickoff").alias("first")).orderBy("league")


def appended(shown: DataFrame, page_rows: DataFrame, key: str = "image_url") -> DataFrame:
    """shown and the rows of a page whose key isn't shown yet."""
    return shown.unionByName(page_rows.dropDuplicates([key]).join(shown.select(key), key, "left_anti").select(*shown.columns))


def effective_ttl(kickoff: Column, now: Column, short_s: int, long_s: int) -> Column:
    """What is over changes no more and keeps longer."""
    return F.when(kickoff < now, F.lit(long_s)).otherwise(F.lit(short_s))


# States in which a job is over.
OVER = ("COMPLETED", "FAILED", "CANCELLED")


def retained(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """jobs (status, finished_at) less those that were over more than `minutes` ago."""
    gone = F.col("status").isin(*OVER) & (F.col("finished_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.where(~F.coalesce(gone, F.lit(False)))


def accounts(users: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    one = users.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("role") == "ADMIN").alias("admins"), F.count_if(~F.col("enabled")).alias("disabled"))
    return one.crossJoin(F.broadcast(sessions.where(F.col("expires_at") > now).agg(F.count(F.lit(1)).alias("active_sessions"))))


def dashboard(*parts: DataFrame) -> DataFrame:
    """One row from one-row frames."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out
