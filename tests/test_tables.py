from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import urls
from quern.operators import analytics, crawl, evaluation, graph, userdata
from quern.plans.catalog import ORACLES, QUERIES
from quern.sources import readers, sinks
from quern.streaming import jobs

SF = "/root/testdata/sf0.001"
NOW = datetime(2026, 8, 10, 10, 0, 0)


def events(spark, rows):
    base = {"ts": NOW, "type": "search", "session_id": "s1", "username": None, "query": None, "url": None, "position": None, "result_count": None, "took_ms": None}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schemas.USAGE)


def test_usage(spark):
    rows = events(spark, [{"result_count": 7, "took_ms": 100}, {"result_count": 0, "took_ms": -1}, {"type": "click", "url": "http://www.vnexpress.net/a", "position": 1, "ts": NOW - timedelta(minutes=6)}, {"type": "Visit ", "session_id": "s2"}, {"type": "bad"}])
    good, bad = analytics.checked_events(rows)
    assert (good.count(), bad.count()) == (4, 1)
    r = analytics.usage(good, F.lit(NOW)).first()
    assert (r["visitors"], r["active"], r["ctr"], r["zero_result_rate"], r["avg_latency_ms"], r["mean_session_minutes"]) == (2, 2, 0.5, 0.5, 100.0, 3.0)
    empty = analytics.usage(good.limit(0), F.lit(NOW)).first()
    assert (empty["visitors"], empty["ctr"], empty["avg_latency_ms"]) == (0, 0.0, 0.0)


def test_tops_and_histogram(spark):
    rows = events(spark, [{"query": q, "took_ms": t} for q, t in (("Ha Noi", 5), ("  ha noi ", 150), ("ha  noi", 5000))])
    assert [tuple(r) for r in analytics.top_queries(rows, 5).collect()] == [("ha noi", 3)]
    assert [r["n"] for r in analytics.histogram(rows, "took_ms").orderBy("bucket").collect()] == [1, 0, 0, 1, 0, 0, 1]
    clicks = events(spark, [{"type": "click", "url": u, "position": p} for u, p in (("http://www.vnexpress.net/a", 1), ("http://www.vnexpress.net/a", 3), ("http://tuoitre.vn/b", 0))])
    assert tuple(analytics.top_links(clicks, 1).first()) == ("http://www.vnexpress.net/a", 2, 2.0)
    assert [tuple(r) for r in analytics.top_hosts(clicks, 5).collect()] == [("vnexpress.net", 2), ("tuoitre.vn", 1)]
    assert analytics.hourly(rows, F.lit(NOW)).count() == 24
    assert analytics.daily(rows, "ts", F.to_date(F.lit(NOW))).agg(F.sum("n")).first()[0] == 3


def test_shares(spark):
    def frame(*n):
        return spark.createDataFrame([(str(k), v) for k, v in enumerate(n)], "k string, n long")

    assert [analytics.entropy(frame(*n), "n").first()["entropy"] for n in ((10,), (5, 5), (1, 1, 1, 1))] == pytest.approx([0, 1, 2])
    assert analytics.head_share(frame(1, 50, 2, 30, 17), "n", 2).first()[0] == 0.8
    assert [r["n"] for r in analytics.fold_tail(frame(5, 3, 1), "k", "n", 2).collect()] == [5, 3, 1]
    assert tuple(analytics.placed(frame(1, 2, 3, 4), "n", {"median": 0.5, "p90": 0.9}).first()) == (3, 4)


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", k + 1, f"d{k + 1}") for k in range(5)], "query string, rank int, url string")
    qrels = spark.createDataFrame([("q", "d1", 1), ("q", "d3", 1), ("q", "d5", 2)], schemas.QRELS)
    r = evaluation.metrics(ranked, qrels, 5).first()
    assert (r["precision"], r["rr"], r["success"]) == (0.6, 1.0, 1) and r["ap"] == pytest.approx(0.755555, abs=1e-5)
    assert evaluation.metrics(ranked, qrels, 3).first()["precision"] == pytest.approx(2 / 3)
    more = spark.createDataFrame([("q", d, 1) for d in ("d1", "d3", "d5", "d9")], schemas.QRELS)
    assert evaluation.metrics(ranked.where("rank <= 3"), more, 3).first()["recall"] == 0.5
    assert evaluation.means(evaluation.metrics(ranked, qrels, 5).limit(0)).first()["ap"] == 0.0


def test_significance():
    assert evaluation.t_two_tailed(2.2281, 10) == pytest.approx(0.05, abs=1e-4)
    assert evaluation.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3)
    same = evaluation.paired_test([1, 2, 3], [1, 2, 3], 1000)
    assert same["p_t"] == 1 and not same["significant"]
    a = np.linspace(0, 1, 30)
    assert evaluation.paired_test(a + 0.2 + 0.01 * np.sin(np.arange(30)), a, 2000)["significant"]
    assert evaluation.paired_test([1], [0])["p_t"] == 1


def test_known_items_and_pool(spark):
    posts = spark.createDataFrame([("a", d, 2) for d in range(3)] + [("b", d, 1) for d in range(3)] + [("c", d, 1) for d in range(9)], "term string, doc_id long, tf int")
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    assert [tuple(r) for r in evaluation.known_items(posts, df, 10).collect()] == [(0, "a b")]
    run = spark.createDataFrame([("q", 1, "u"), ("q", 11, "v")], "query string, rank int, url string")
    assert [tuple(r) for r in evaluation.pool({"x": run, "y": run}).collect()] == [("q", "u", ["x", "y"])]


def test_robots(spark):
    text = ["User-agent: *", "Disallow: /", "User-agent: bot", "Disallow: /a", "Allow: /a/b", "Disallow: /a/b"]
    rules = crawl.robots_rules(spark.createDataFrame([("x.vn", k, line) for k, line in enumerate(text)], "host string, ord int, line string"))
    urls = spark.createDataFrame([(f"http://x.vn{p}",) for p in ("/a/c", "/a/b/c", "/z")] + [("http://other.vn/",)], "url string")
    assert {r["url"][7:]: r["allowed"] for r in crawl.robots_allowed(urls, rules, "Bot").collect()} == {"x.vn/a/c": False, "x.vn/a/b/c": True, "x.vn/z": True, "other.vn/": True}
    assert not any(r["allowed"] for r in crawl.robots_allowed(urls, rules, "else").where("url LIKE '%x.vn%'").collect())


HTML = '<html lang="vi"><head><title>A &amp; B</title><meta name="description" content="mô tả"></head><body><nav>menu</nav><p>Xin <b>chào</b></p><a href="/x">l</a><a href="/x#t">l</a><a href="/p">self</a><img data-src="/i.jpg" width="300"><img src="/j.jpg" width="1200" alt="to"><img src="/logo.png"><img src="/d.exe"></body></html>'


def test_pages(spark):
    rows = spark.createDataFrame([("http://a.vn/p", HTML), ("http://a.vn/q", None)], "url string, html string")
    p = rows.select(crawl.parsed("html").alias("p")).first()["p"]
    assert (p["title"], p["description"], p["lang"]) == ("A & B", "mô tả", "vi") and p["text"].startswith("Xin chào")
    assert [r[0] for r in rows.select(crawl.outlinks(F.col("html"), F.col("url"))).collect()] == [["http://a.vn/x"], []]
    found = crawl.images(rows)
    assert found.count() == 3
    best = crawl.best_images(found)
    assert best.first()["image_url"] == "http://a.vn/j.jpg"
    results = spark.createDataFrame([("http://a.vn/p", 1)], "url string, rank int")
    assert crawl.image_search(results, best).count() == 1


def test_crawl_tables(spark):
    links = spark.createDataFrame([("http://a.vn/1",), ("http://a.vn/1",), ("http://b.vn/2",)], "url string")
    crawled = spark.createDataFrame([("http://a.vn/0",)], "url string")
    assert sorted(tuple(r) for r in crawl.frontier(links, crawled).collect()) == [("http://a.vn/1", "a.vn", True), ("http://b.vn/2", "b.vn", False)]
    docs = spark.createDataFrame([(1, "x y"), (2, " X  y"), (3, ""), (4, None)], "doc_id long, text string")
    assert sorted(r[0] for r in crawl.first_by_content(docs).collect()) == [1, 3, 4]
    corpus = spark.createDataFrame([(0, "http://a.vn/1", "t", None, "b", ["http://a.vn/2", "http://c.vn"], None, ""), (1, "http://a.vn/2", "t", None, "b", [], None, "vi")], schemas.DOCUMENT)
    report = crawl.run_report(corpus, ("a.vn", "z.vn"))
    assert (report["edges"], report["internal"], report["density"]) == (1, 1, 0.25) and [r[0] for r in report["missing"].collect()] == ["z.vn"]
    tasks = spark.createDataFrame([("a", 1, 1), ("a", 0, 2), ("b", 0, 3)], "host string, level int, seq int")
    assert [r["start_ms"] for r in crawl.schedule(tasks).orderBy("seq").collect()] == [1000, 0, 0]
    pages = spark.createDataFrame([("u",)], "url string")
    seen = spark.createDataFrame([("u", ["x"], 1), ("u", ["y"], 2), ("w", ["z"], 1)], "source_url string, outlinks array<string>, seq int")
    joined, orphans = crawl.with_outlinks(pages, seen)
    assert joined.first()["outlinks"] == ["y"] and orphans.count() == 1


def test_settings_and_downloads(spark):
    table = spark.createDataFrame([("u", {"a": "1", "b": "2"}, 3)], "username string, settings map<string,string>, version int")
    changes = spark.createDataFrame([("u", {"b": "9"}, ["a"], False, 3), ("v", {"c": "1"}, None, False, 7)], "username string, patch map<string,string>, removed array<string>, replace boolean, expected int")
    new, conflicts = userdata.merge_settings(table, changes)
    assert [tuple(r) for r in new.collect()] == [("u", {"b": "9"}, 4)] and conflicts.count() == 1
    cols = "id string, username string, total_bytes long, local_path string, received_bytes long"
    old = spark.createDataFrame([("1", "u", 10, "/x", 1)], cols)
    out = userdata.upsert_downloads(old, spark.createDataFrame([("1", "u", None, None, 5), ("2", "w", 3, "/y", 0)], cols))
    assert sorted(tuple(r) for r in out.collect()) == [("1", "u", 10, "/x", 5), ("2", "w", 3, "/y", 0)]
    out = userdata.upsert_downloads(old, spark.createDataFrame([("1", "other", 99, "/z", 5)], cols))
    assert [tuple(r) for r in out.collect()] == [("1", "u", 10, "/x", 1)]
    rows = spark.createDataFrame([("COMPLETED", 5, 3, None), ("PAUSED", 1, 2, None)], "state string, received_bytes long, total_bytes long, finished_at timestamp")
    assert [r["faults"] for r in userdata.download_faults(rows).collect()] == [["total", "finished"], []]


def test_user_lists(spark):
    visits = spark.createDataFrame([("u", "x", "T1", "h1", NOW, 1, False), ("u", "x", "T2", "h2", NOW + timedelta(1), 1, False), ("u", "y", "T", "h", NOW, 1, True)], "username string, url string, title string, host string, visited_at timestamp, visit_count int, incognito boolean")
    assert [tuple(r) for r in userdata.upsert_visits(visits).collect()] == [("u", "x", "T2", "h1", NOW + timedelta(1), 2)]
    assert userdata.history(visits, "u", keyword="T2").count() == 1
    assert userdata.page(userdata.history(visits, "u"), 0, 2)[1] == {"page": 0, "size": 2, "total": 3, "total_pages": 2}
    marks = spark.createDataFrame([("Báo mới",), ("Tin",)], "title string")
    assert (userdata.bookmarks(marks, "M").count(), userdata.bookmarks(marks, "").count()) == (1, 2)
    m = spark.createDataFrame([(1, "SCHEDULED", NOW, "L"), (2, "LIVE", NOW, "L"), (3, "FINISHED", NOW, "K"), (4, "FINISHED", NOW + timedelta(1), "K")], "match_id int, status string, kickoff timestamp, league string")
    assert [r["match_id"] for r in userdata.ranked_matches(m).collect()] == [2, 4, 3, 1]
    mine, rest = userdata.grouped_fixtures(m, m.where("match_id = 1"))
    assert mine.count() == 1 and [tuple(r)[:2] for r in rest.collect()] == [("K", 2), ("L", 1)]


def test_readers_and_sinks(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "d.json").write_text('[{"doc_id": 1, "url": "u", "outlinks": ["x"]}, {"doc_id": 2}]')
    docs = readers.documents_json(spark, f"{path}/d.json")
    assert [r["language"] for r in docs.collect()] == ["", ""]
    assert readers.images_json(spark, f"{path}/d.json").count() == 0
    assert readers.first_source(lambda: spark.read.parquet(f"{path}/none"), lambda: docs.limit(0), lambda: docs).count() == 2
    (tmp_path / "w.txt").write_text("# c\nmáy tính\t12\nxe\tx\nto\t99999999999\n")
    assert {r["word"]: r["frequency"] for r in readers.words(spark, f"{path}/w.txt").collect()} == {"máy tính": 12, "to": 2**31 - 1}
    (tmp_path / "q.json").write_text('{"q": {"u": 2, "v": null}}')
    assert sorted(tuple(r) for r in readers.qrels_json(spark, f"{path}/q.json").collect()) == [("q", "u", 2), ("q", "v", 0)]
    links = spark.createDataFrame([(1, "a")], "from_doc_id long, to_url string")
    assert {r["doc_id"]: r["outlinks"] for r in readers.with_links(docs, links).collect()} == {1: ["a"], 2: []}
    sinks.append_urls(docs.where("url IS NOT NULL"), f"{path}/urls")
    assert [r["url"] for r in readers.url_log(spark, f"{path}/urls").collect()] == ["u"]
    sinks.save_documents(docs.unionByName(docs), f"{path}/saved")
    assert spark.read.parquet(f"{path}/saved/documents").count() == 2
    assert [sinks.due(*a) for a in ((100, 0, 100), (150, 100, 100), (500, 450, 50), (600, 450, 50))] == [True, False, False, True]
    assert "| u |" in sinks.report(docs.select("url"), "R")


def test_streaming_equals_batch(spark, tmp_path):
    rows = events(spark, [{"session_id": f"s{k % 3}", "ts": NOW + timedelta(minutes=k), "query": "a"} for k in range(10)])
    rows.write.json(f"{tmp_path}/in")
    stream = jobs.source(spark, f"{tmp_path}/in", schemas.USAGE)
    jobs.run(jobs.sessions(stream), f"{tmp_path}/c1", table="sessions_now", mode="complete")
    assert sorted(map(tuple, spark.table("sessions_now").collect())) == sorted(map(tuple, jobs.sessions(rows).collect()))
    jobs.run(jobs.source(spark, f"{tmp_path}/in", schemas.USAGE), f"{tmp_path}/c2", sink=jobs.once_per_batch(f"{tmp_path}/out"))
    jobs.run(jobs.source(spark, f"{tmp_path}/in", schemas.USAGE), f"{tmp_path}/c2", sink=jobs.once_per_batch(f"{tmp_path}/out"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    page = ("http://a.vn/p", "a.vn", 0, "t", "b", "vi", HTML, "h", NOW, "j")
    spark.createDataFrame([page, page], schemas.PAGE_EVENT).write.json(f"{tmp_path}/pages")
    pages = jobs.source(spark, f"{tmp_path}/pages", schemas.PAGE_EVENT)
    jobs.run(jobs.discovered(pages, 3), f"{tmp_path}/c3", path=f"{tmp_path}/found")
    assert [r["url"] for r in spark.read.parquet(f"{tmp_path}/found").collect()] == ["http://a.vn/x"]


def test_bad_records_and_routes(spark):
    values = spark.createDataFrame([('{"url": "u", "depth": 1}',), ("{bad",)], "value string")
    good, bad = jobs.split_bad(values, schemas.DISCOVERED)
    assert (good.first()["url"], bad.count()) == ("u", 1)
    rows = spark.createDataFrame([("a",), ("b",)], "job_id string")
    known, lost = jobs.routed(rows, rows.where("job_id = 'a'"))
    assert (known.count(), lost.count()) == (1, 1)
    failures: dict = {}

    def fails(_):
        raise RuntimeError

    got = []
    sinks.fan_out({"bad": fails, "good": lambda b: got.append(b.count())}, failures)(rows, 0)
    assert (got, failures) == ([2], {"bad": 1})
    samples = spark.createDataFrame([("lag", NOW + timedelta(minutes=k), float(v)) for k, v in enumerate([20, 20, 20, 20, 20, 1, 20])], "metric string, ts timestamp, value double")
    assert jobs.alerts(samples, "lag", 10).count() == 1
    assert jobs.increase(samples, "lag", "1 hour").first()["increase"] == 0.0


def ranks_of(nodes, edges, rounds):
    """PageRank by hand; the ranks of nodes without links out are spread over all."""
    rank, outs = dict.fromkeys(nodes, 1 / len(nodes)), {n: [d for s, d in edges if s == n] for n in nodes}
    for _ in range(rounds):
        loose = sum(rank[n] for n in nodes if not outs[n])
        got = {n: sum(rank[m] * outs[m].count(n) / len(outs[m]) for m in nodes if outs[m]) for n in nodes}
        rank = {n: 0.15 / len(nodes) + 0.85 * (got[n] + loose / len(nodes)) for n in nodes}
    return rank


def test_ranks_with_nodes_that_have_no_links(spark):
    edges = [("A", "B"), ("A", "B"), ("A", "C"), ("B", "C"), ("D", "A")]
    ranks, _ = graph.pagerank(spark.createDataFrame([(x,) for x in "ABCDE"], "node string"), spark.createDataFrame(edges, "src string, dst string"), fixed=5)
    assert {r["node"]: r["rank"] for r in ranks.collect()} == pytest.approx(ranks_of("ABCDE", edges, 5))


def test_trade_and_visits_of_whole_tables(spark):
    customer, orders, items, supplier, nation, seen = (spark.read.parquet(f"{SF}/{n}.parquet").toPandas() for n in ("customer", "orders", "lineitem", "supplier", "nation", "events"))
    rows = items.merge(orders, left_on="l_orderkey", right_on="o_orderkey").merge(customer, left_on="o_custkey", right_on="c_custkey").merge(supplier, left_on="l_suppkey", right_on="s_suppkey")
    edges = [(s, d) for s, d in zip(rows["c_nationkey"].tolist(), rows["s_nationkey"].tolist(), strict=True) if s != d]
    sums = {s: float(sum(a == s for a, _ in edges)) for s in {a for a, _ in edges}}
    assert {r["row"]: r["value"] for r in QUERIES["sparse_product"](spark, SF).collect()} == sums
    ranks = {r["node"]: r["rank"] for r in QUERIES["pagerank_fixed"](spark, SF).collect()}
    assert ranks == pytest.approx(ranks_of(nation["n_nationkey"].tolist(), edges, 5), abs=1e-8)
    assert QUERIES["visit_upsert"](spark, SF).agg(F.sum("visit_count")).first()[0] == len(seen)


def test_alert_rules(spark):
    """down needs two minutes in a row, and a gap breaks them; a lag at its limit is none."""
    at = lambda m: NOW + timedelta(minutes=m)
    rows = [(at(m), "up", "a", 0.0) for m in (0, 1, 2, 4)] + [(at(m), "consumer_lag", "g", 10_000.0) for m in range(12)] + [(at(m), "search_p99_seconds", "s", 0.6) for m in range(5)]
    found = jobs.held(spark.createDataFrame(rows, "ts timestamp, metric string, series string, value double"))
    first = found.agg(F.min("minute")).first()[0]
    assert sorted((r["rule"], r["minute"] - first) for r in found.collect()) == [("down", 0), ("down", 1), ("slow_search", 3)]


def test_blocked_hosts(spark):
    blocked = ["", " LOCALHOST", "x.localhost", "metadata", "127.0.0.1", "0.0.0.0", "[::1]", "::", "fe80::1", "fd00::1", "ff02::1", "::ffff:10.0.0.1", "100.64.0.1", "172.31.0.1"]
    free = ["example.org", "8.8.8.8", "100.128.0.1", "172.32.0.1", "256.0.0.1", "127.0.0.1.example.org", "2001:db8::1", "fd.example.org", "0.1.2.3"]
    rows = spark.createDataFrame([(h,) for h in [*blocked, *free]], "host string")
    assert [r[0] for r in rows.where(urls.blocked_host(F.col("host"))).collect()] == blocked


def test_jobs_are_kept_while_they_run(spark):
    rows = spark.createDataFrame([(1, "RUNNING", NOW - timedelta(days=1)), (2, "FAILED", NOW - timedelta(minutes=31)), (3, "COMPLETED", NOW - timedelta(minutes=30)), (4, "COMPLETED", None)], "id int, status string, finished_at timestamp")
    assert sorted(r["id"] for r in userdata.retained(rows, F.lit(NOW)).collect()) == [1, 3, 4]


def test_held_alerts_at_the_end_of_an_hour(spark, tmp_path):
    """The SQL rounds to the nearest second before it cuts hours: half a second before the end is in the even second, the hour itself."""
    end = datetime(2024, 1, 1, 3, 0, 0)
    half = timedelta(seconds=0.5)
    times = [end - timedelta(hours=h) - half for h in range(4)] + [end + timedelta(seconds=0.5)]
    rows = [(k, t, 100, kind) for kind in ("view", "click") for k, t in enumerate(times[1:] if kind == "view" else times)]
    rows += [(9, end - timedelta(hours=h) - half - timedelta(microseconds=1), 100, "error") for h in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    theirs = con.sql(ORACLES["alerts_held"]).fetchall()
    assert len(theirs) == 5 and sorted(map(tuple, QUERIES["alerts_held"](spark, str(tmp_path)).collect())) == sorted(theirs)
