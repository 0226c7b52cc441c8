"""Crawl, analytics, evaluation and per-user queries over the driver's tables.

Where a table has no such columns, others stand in: a user is a session, a
view a search, value a latency, labels are judgements, orders are downloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import analytics as an
from quern.operators import crawl as cr
from quern.operators import evaluation as ev
from quern.operators import graph as gr
from quern.operators import userdata as ud
from quern.plans.base import Tables, query

SITE = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"
CANON = "regexp_replace(regexp_replace(url, '#.*$', ''), '^([^?]*?)/+(\\?.*)?$', '\\1\\2')"


@query("url_hosts", f"SELECT {SITE} AS host, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    return t.pages.groupBy(U.site(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("url_canonical", f"SELECT page_id, {CANON} AS canonical FROM pages")
def _(t):
    return t.pages.select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("url_first_seen", f"SELECT min(page_id) AS page_id FROM pages GROUP BY {CANON}")
def _(t):
    return t.pages.groupBy(U.canonical(F.col("url")).alias("u")).agg(F.min("page_id").alias("page_id")).select("page_id")


REASON = f"CASE WHEN page_id % 5 > 3 THEN 'depth' WHEN NOT ends_with({SITE}, 'example.com') AND NOT ends_with({SITE}, 'example.org') THEN 'domain' WHEN starts_with(regexp_extract(url, '//([^/]*)', 1), 'm.') THEN 'language' WHEN regexp_matches(regexp_extract(url, '//[^/]*([^?#]*)', 1), '\\.(pdf|zip|jpg)$') THEN 'extension' END"


@query("url_reject_reasons", f"SELECT coalesce({REASON}, 'accepted') AS reason, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    reason = U.reject_reason(F.col("url"), (F.col("page_id") % 5).cast("int"), 3, ("example.com", "example.org"), ("m.",))
    return t.pages.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("url_on_site", f"SELECT page_id FROM pages WHERE {SITE} = 'example.com' OR ends_with({SITE}, '.example.com')")
def _(t):
    return t.pages.where(U.on_site(F.col("url"), "example.com")).select("page_id")


@query("url_directory_counts", "SELECT regexp_extract(url, '//[^/]*/([a-z]*)/', 1) AS dir, count(*) AS n, count(DISTINCT regexp_extract(url, '//([^/]*)', 1)) AS hosts FROM pages GROUP BY 1")
def _(t):
    return t.pages.groupBy(F.regexp_extract(U.part(F.col("url"), 4), "^/([a-z]*)/", 1).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(U.host(F.col("url"))).alias("hosts"))


HREFS = "regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)"


@query("link_counts", f"SELECT page_id, len(list_distinct({HREFS}))::INT AS n_links FROM pages")
def _(t):
    return t.pages.select("page_id", F.size(cr.outlinks(F.col("html"), F.col("url"))).alias("n_links"))


@query("link_targets", f"SELECT regexp_extract(url, '^(https?://[^/]*)', 1) || h AS target, count(*) AS n FROM (SELECT url, unnest(list_distinct({HREFS})) AS h FROM pages) GROUP BY 1")
def _(t):
    links = t.pages.select(F.explode(cr.outlinks(F.col("html"), F.col("url"))).alias("target"))
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("frontier_hosts", f"SELECT {SITE} AS host, count(DISTINCT regexp_extract(url, '^(https?://[^/]*)', 1) || h) AS new_urls FROM (SELECT url, unnest({HREFS}) AS h FROM pages) GROUP BY 1")
def _(t):
    links = t.pages.select(F.explode(cr.outlinks(F.col("html"), F.col("url"))).alias("url"))
    new = cr.frontier(links, t.pages.select(U.canonical(F.col("url")).alias("url"))).where("known_host")
    return new.groupBy("host").agg(F.count(F.lit(1)).alias("new_urls"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<html[^>]*lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def _(t):
    p = t.pages.select("page_id", cr.parsed("html").alias("p"))
    return p.select("page_id", "p.lang")


@query("politeness_schedule", f"SELECT page_id, ((row_number() OVER (PARTITION BY {SITE} ORDER BY page_id % 5, page_id) - 1) * 1000)::BIGINT AS start_ms FROM pages")
def _(t):
    tasks = t.pages.select("page_id", U.site(F.col("url")).alias("host"), (F.col("page_id") % 5).alias("level"), F.col("page_id").alias("seq"))
    return cr.schedule(tasks).select("page_id", "start_ms")


def usage_events(t: Tables) -> DataFrame:
    """events as USAGE rows."""
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "click").otherwise("visit")
    return t.events.select(
        "ts",
        kind.alias("type"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), "user_id")).alias("username"),
        F.concat(F.lit("  Query "), F.get_json_object("props", "$.k")).alias("query"),
        F.concat(F.lit("http://www.site"), F.col("user_id") % 20, F.lit(".example/p")).alias("url"),
        (F.col("event_id") % 4).cast("int").alias("position"),
        (F.col("event_id") % 7).cast("int").alias("result_count"),
        F.floor("value").cast("long").alias("took_ms"),
    )


USAGE = """WITH u AS (SELECT ts, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'click' ELSE 'visit' END AS type, user_id::VARCHAR AS session_id,
 CASE WHEN user_id % 3 = 0 THEN 'u' || user_id END AS username, 'query ' || json_extract_string(props, '$.k') AS query, user_id % 20 AS site, (event_id % 4)::INT AS position, (event_id % 7)::INT AS result_count, floor(value)::BIGINT AS took_ms FROM events),
m AS (SELECT max(ts) AS now FROM u) """


def now(t: Tables):
    return F.lit(str(t.events.agg(F.max("ts")).first()[0])).cast("timestamp_ntz")


@query(
    "usage_snapshot",
    USAGE
    + """, x AS (SELECT session_id, min(ts) AS a, max(ts) AS b FROM u GROUP BY 1)
SELECT (SELECT count(*) FROM x) AS visitors, (SELECT count(DISTINCT username) FROM u) AS signed_in, (SELECT count(*) FROM x, m WHERE b >= now - INTERVAL 5 MINUTE) AS active,
 count(*) FILTER (type = 'search') AS searches, count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type = 'search' AND result_count = 0) AS zero_results,
 round(avg(took_ms) FILTER (type = 'search' AND took_ms >= 0), 6) AS avg_latency_ms, round((SELECT sum(epoch_us(b) - epoch_us(a))::DOUBLE / 60000000 / count(*) FROM x), 6) AS mean_session_minutes,
 round(count(*) FILTER (type = 'click') / count(*) FILTER (type = 'search'), 6) AS ctr, round(count(*) FILTER (type = 'search' AND result_count = 0) / count(*) FILTER (type = 'search'), 6) AS zero_result_rate FROM u""",
)
def _(t):
    rows = an.usage(usage_events(t), now(t))
    return rows.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in rows.dtypes))


@query("latency_histogram", USAGE + ", b AS (SELECT unnest(range(0, 7))::INT AS bucket) SELECT bucket, count(u.ts) AS n FROM b LEFT JOIN u ON took_ms >= 0 AND (took_ms >= 10)::INT + (took_ms >= 50)::INT + (took_ms >= 100)::INT + (took_ms >= 200)::INT + (took_ms >= 500)::INT + (took_ms >= 1000)::INT = bucket GROUP BY bucket")
def _(t):
    return an.histogram(usage_events(t), "took_ms")


@query("top_queries", USAGE + "SELECT query, count(*) AS n FROM u WHERE type = 'search' GROUP BY query ORDER BY n DESC, query LIMIT 10")
def _(t):
    return an.top_queries(usage_events(t), 10)


@query("top_links", USAGE + "SELECT 'http://www.site' || site || '.example/p' AS url, count(*) AS n, round(avg(position) FILTER (position > 0), 6) AS avg_position FROM u WHERE type = 'click' GROUP BY 1 ORDER BY n DESC, url LIMIT 10")
def _(t):
    return an.top_links(usage_events(t), 10).withColumn("avg_position", F.round("avg_position", 6))


@query("top_hosts", USAGE + "SELECT 'site' || site || '.example' AS host, count(*) AS n FROM u WHERE type = 'click' GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def _(t):
    return an.top_hosts(usage_events(t), 10)


@query("hourly_series", USAGE + ", h AS (SELECT unnest(generate_series(date_trunc('hour', now) - INTERVAL 23 HOUR, date_trunc('hour', now), INTERVAL 1 HOUR)) AS hour FROM m) SELECT hour, count(DISTINCT session_id) AS sessions, count(*) FILTER (type = 'search') AS searches, count(*) FILTER (type = 'click') AS clicks FROM h LEFT JOIN u ON date_trunc('hour', ts) = hour GROUP BY hour")
def _(t):
    return an.hourly(usage_events(t), now(t))


@query("daily_series", USAGE + ", d AS (SELECT unnest(generate_series(now::DATE - INTERVAL 13 DAY, now::DATE, INTERVAL 1 DAY))::DATE AS day FROM m) SELECT strftime(day, '%Y-%m-%d') AS day, count(u.ts) AS n FROM d LEFT JOIN u ON ts::DATE = day GROUP BY day")
def _(t):
    return an.daily(t.events, "ts", F.to_date(now(t))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("session_spans", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))


@query("event_json_values", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t.events.groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


_SRC = "(SELECT source, count(*) AS n FROM documents GROUP BY source)"


@query("source_entropy", f"SELECT round(-sum(n / s * log2(n / s)), 6) AS entropy, round(-sum(n / s * log2(n / s)) / log2(count(*)), 6) AS normalised FROM {_SRC}, (SELECT sum(n) AS s FROM {_SRC})")
def _(t):
    return an.entropy(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "n").select(F.round("entropy", 6).alias("entropy"), F.round("normalised", 6).alias("normalised"))


@query("source_head_share", f"SELECT round((SELECT sum(n) FROM (SELECT n FROM {_SRC} ORDER BY n DESC LIMIT 3)) / sum(n), 6) AS share FROM {_SRC}")
def _(t):
    return an.head_share(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "n", 3).select(F.round("share", 6).alias("share"))


@query("source_fold_tail", f"WITH r AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS k FROM {_SRC}) SELECT CASE WHEN k <= 5 THEN source ELSE 'other' END AS source, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def _(t):
    return an.fold_tail(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n", 5)


@query("length_places", "WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT max(n_chars) FILTER (k = least(n - 1, floor(0.5 * n))) AS median, max(n_chars) FILTER (k = least(n - 1, floor(0.9 * n))) AS p90 FROM s")
def _(t):
    return an.placed(t.documents, "n_chars", {"median": 0.5, "p90": 0.9})


@query("corpus_by_language", "SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_distinct("source").alias("sources"))


@query("table_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def _(t):
    out = None
    for name in ("customer", "orders", "lineitem", "events"):
        one = getattr(t, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


TRADE = "SELECT c.c_nationkey AS src, s.s_nationkey AS dst FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey"


def trade(t: Tables) -> DataFrame:
    """Edges from a customer's nation to a supplier's, a row for each item."""
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("src"))
    rows = c.join(t.orders.select("o_custkey", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.lineitem.select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("s_suppkey") == F.col("l_suppkey")).select("src", "dst").where("src <> dst")


def pagerank_sql(rounds: int) -> str:
    out = f"WITH e AS MATERIALIZED (SELECT src, dst FROM ({TRADE}) WHERE src <> dst), w AS MATERIALIZED (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS w FROM e GROUP BY src, dst), r0 AS (SELECT n_nationkey AS node, 1.0::DOUBLE / (SELECT count(*) FROM nation) AS rank FROM nation)"
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        out += f", r{k} AS MATERIALIZED (SELECT p.node, 0.15 / (SELECT count(*) FROM nation) + 0.85 * (coalesce((SELECT sum(q.rank * w.w) FROM {p} q JOIN w ON w.src = q.node WHERE w.dst = p.node), 0) + (SELECT coalesce(sum(rank), 0) FROM {p} WHERE node NOT IN (SELECT src FROM w)) / (SELECT count(*) FROM nation)) AS rank FROM {p} p)"
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank_fixed", pagerank_sql(5))
def _(t):
    ranks, _n = gr.pagerank(t.nation.select(F.col("n_nationkey").alias("node")), trade(t), fixed=5)
    return ranks.select("node", F.round("rank", 9).alias("rank"))


@query("sparse_product", f"SELECT src AS row, sum(n)::DOUBLE AS value FROM (SELECT src, dst, count(*) AS n FROM ({TRADE}) WHERE src <> dst GROUP BY ALL) GROUP BY src")
def _(t):
    cells = trade(t).groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return gr.multiply(cells, t.nation.select(F.col("n_nationkey").alias("col"), F.lit(1.0).alias("x")))


RUN = "SELECT d.lang AS query, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d"
JUDGED = f"WITH run AS (SELECT * FROM ({RUN}) WHERE rank <= 50), q AS (SELECT d.lang AS query, doc_id, toxic + quality AS grade FROM labels JOIN documents d USING (doc_id)), j AS (SELECT run.query, rank, coalesce(grade, 0) AS grade, sum((coalesce(grade, 0) > 0)::INT) OVER (PARTITION BY run.query ORDER BY rank) AS hits FROM run LEFT JOIN q USING (query, doc_id)), i AS (SELECT query, count(*) AS relevant, sum(CASE WHEN k <= 10 THEN (pow(2, grade) - 1) / log2(k + 1) END) AS idcg FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS k FROM q WHERE grade > 0) GROUP BY query)"


def judged_run(t: Tables) -> tuple[DataFrame, DataFrame]:
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    docs = t.documents.select("doc_id", "lang", "n_chars")
    run = docs.select(F.col("lang").alias("query"), F.col("doc_id").alias("url"), rank.alias("rank")).where("rank <= 50")
    qrels = t.labels.join(docs, "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("url"), (F.col("toxic") + F.col("quality")).alias("grade"))
    return run, qrels


@query(
    "ranking_metrics",
    JUDGED
    + " SELECT query, round(f / 10.0, 6) AS precision, round(f / relevant, 6) AS recall, round(ap / relevant, 6) AS ap, round(dcg / idcg, 6) AS ndcg, round(coalesce(1.0 / h, 0), 6) AS rr, coalesce(h <= 10, false)::INT AS success FROM (SELECT query, count(*) FILTER (grade > 0 AND rank <= 10) AS f, coalesce(sum(hits / rank) FILTER (grade > 0), 0) AS ap, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg, min(rank) FILTER (grade > 0) AS h FROM j GROUP BY query) JOIN i USING (query)",
)
def _(t):
    rows = ev.metrics(*judged_run(t))
    return rows.select("query", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "ap", "ndcg", "rr")), "success")


@query("pooled_results", f"SELECT query, doc_id AS url, string_agg(label, ',' ORDER BY label) AS found_by FROM (SELECT query, doc_id, 'long' AS label FROM ({RUN}) WHERE rank <= 10 UNION ALL SELECT lang, doc_id, 'first' FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 10) GROUP BY ALL")
def _(t):
    long, _q = judged_run(t)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    first = t.documents.select(F.col("lang").alias("query"), F.col("doc_id").alias("url"), rank.alias("rank"))
    return ev.pool({"long": long, "first": first}).withColumn("found_by", F.array_join("found_by", ","))


@query("latest_order", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(t):
    return ud.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderkey").alias("k")), ["o_custkey"], "o_orderdate", "k").select("o_custkey", "o_orderkey")


@query("visit_upsert", "SELECT user_id::VARCHAR AS username, event_type AS url, max(ts) AS visited_at, count(*) AS visit_count, max_by(props, ts) AS title, min_by(props, ts) AS host FROM events GROUP BY ALL")
def _(t):
    visits = t.events.select(F.col("user_id").cast("string").alias("username"), F.col("event_type").alias("url"), F.col("props").alias("title"), F.col("props").alias("host"), F.col("ts").alias("visited_at"), F.lit(1).alias("visit_count"), F.lit(False).alias("incognito"))
    return ud.upsert_visits(visits)


@query("history_page", "SELECT event_id FROM events WHERE user_id = 7 AND contains(lower(props), '1') ORDER BY ts DESC, event_id LIMIT 4 OFFSET 4")
def _(t):
    visits = t.events.select("event_id", F.col("user_id").cast("string").alias("username"), F.col("props").alias("title"), F.col("event_type").alias("url"), F.col("ts").alias("visited_at"))
    rows = ud.history(visits, "7", keyword="1").orderBy(F.desc("visited_at"), "event_id")
    return ud.page(rows, 1, 4)[0].select("event_id")


@query("days_of_history", "SELECT strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1")
def _(t):
    rows = t.events.where("user_id = 7").select("ts", F.col("event_type").alias("url"))
    return ud.by_day(rows, "ts", "Asia/Ho_Chi_Minh").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("percent_done", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN least(floor(l_linenumber * 100 / l_quantity), 100)::INT END AS percent FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", ud.percent(F.col("l_linenumber"), F.col("l_quantity")).alias("percent"))


@query("state_changes", "WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus AS state, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) SELECT before, state, count(*) AS n FROM s WHERE before <> state AND before || '>' || state NOT IN ('O>F', 'O>P', 'P>F') GROUP BY ALL")
def _(t):
    states = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("state"))
    return ud.bad_transitions(states, "o_custkey", "o_orderkey", (("O", "F"), ("O", "P"), ("P", "F"))).groupBy("before", "state").agg(F.count(F.lit(1)).alias("n"))


@query("conversation_roles", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def _(t):
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query("semi_and_anti", "SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, count(*) AS customers FROM customer GROUP BY 1")
def _(t):
    some = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1))
    return t.customer.join(some, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("has").alias("with_orders"), F.count(F.lit(1)).alias("customers"))


@query("folded_queries", "SELECT 'query ' || json_extract_string(props, '$.k') AS normalized, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def _(t):
    return usage_events(t).where("type = 'search'").groupBy(T.normal_query(F.col("query")).alias("normalized")).agg(F.count(F.lit(1)).alias("n"))
