"""Embeddings, pages, components, the pipeline and the registered queries."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import components, embeddings, kernel, pages, registry

SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(30, 31), (31, 32), (32, 30), (50, 50), (40, 99), (41, 99)]
    got = components.components(spark.createDataFrame(edges * 2, "x long, y long"), "x", "y")
    assert {r["node"]: r["label"] for r in got.collect()} == {**{k: 0 for k in range(21)}, 30: 30, 31: 30, 32: 30, 40: 40, 41: 40, 99: 40}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_without(spark):
    rows = kernel.numbered(spark.range(100).toDF("v"))
    dropped = rows.where("v % 3 = 0").select("_row")
    for bits in (24, 8):
        assert kernel.without(rows, dropped, bits).where("v % 3 = 0").count() == 0
        assert kernel.without(rows, dropped, bits).count() == 66


def brute(rows, threshold):
    def ok(r):
        return r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n, label = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok(rows[a]) and ok(rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    label[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(r[0], least.get(root(k), r[0]))
    return sorted((r[0], n[k], least[root(k)]) for k, r in enumerate(rows))


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 10))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.25 * rng.normal(size=10)], k % 3) for k in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 1), (204, [0.0] * 10, 1), (205, [float("nan")] * 10, 1), (206, [None] * 10, 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1), (209, [], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, p string")
    exact = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows]
    for tile in (512, 16):
        got = embeddings.groups(frame, tile=tile, block=3)
        assert sorted(tuple(r) for r in got.collect()) == brute(exact, 0.93)
    assert embeddings.groups(frame.limit(0)).count() == 0


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pages.common(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/a">Menu</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><article><h1>Head &amp; tail</h1><p><b>Bold\n start.<br><p>Second &lt;para&gt; x&nbsp;y<p class="ad">Buy</p>'
    '<div class="share-buttons">Share</div><ul><li>one<li>two</ul><form><label>Mail</label><input></form></article><aside>Side</aside><section id="comments"><p>Reader says</p></section><footer>&copy; F</footer>'
)


def test_lines():
    got = [t for t, prose in pages.lines_of(PAGE) if prose]
    assert got == ["Head & tail", "Bold start.", "Second <para> x y", "one", "two"]
    assert pages.lines_of(None) == [] and pages.lines_of("") == []
    assert [t for t, _ in pages.lines_of("plain text")] == ["plain text"]
    assert [t for t, _ in pages.lines_of("<div><p>a<script>x")] == ["a"]


def test_linked_lines_of_an_article():
    page = '<article><h1><a href="/x">Head</a></h1><p><a name="top">First<p>Second<ul><li><a href="/s">Source</a></ul></article><p><a href="/y">Outside</a>'
    assert pages.lines_of(page) == [("Head", True), ("First", True), ("Second", True), ("Source", True), ("Outside", False)]
    assert pages.kept_text(pages.lines_of(page), ()) == "Head\nFirst\nSecond\nSource"


def test_differencing(spark):
    def page(k, body):
        return (k, f"http://a.org/en/{k}", f"<body><div>Top links</div><div>{body}</div><div>Read more here</div></body>", "clash")

    rows = [page(k, f"Story number {k} is long") for k in range(6)]
    rows += [(10, "http://a.org/en/5?utm=1", rows[5][2], None), (11, None, None, None), (12, "x", "", None), (13, "http://b.org/1", "<p>Alone</p>", None), (13, "http://b.org/1", PAGE, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in pages.extract(frame).collect())
    assert got == sorted([*((k, f"Story number {k} is long") for k in range(6)), (10, "Story number 5 is long"), (11, ""), (12, ""), (13, "Alone"), (13, "Head & tail\nBold start.\nSecond <para> x y\none\ntwo")])
    assert pages.extract(frame.limit(0)).count() == 0


def test_runs_of_copies_and_short_hosts(spark):
    def page(host, k, story, notice="Call us now"):
        return (f"http://{host}.org/{k}", f"<article><p>{notice}<p>{story} begins<p>{story} ends</article>")

    # three copies in a row; three pages only; one neighbour only, which isn't enough
    rows = [page("a", k, f"Story {k // 3}") for k in range(9)] + [page("b", k, f"Tale {k}") for k in range(3)] + [page("c", k, f"Song {k}") for k in range(2)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(frame).collect()}
    assert [got[k] for k in range(9)] == [f"Story {k // 3} begins\nStory {k // 3} ends" for k in range(9)]
    assert [got[k] for k in range(9, 12)] == [f"Tale {k} begins\nTale {k} ends" for k in range(3)]
    assert [got[k] for k in range(12, 14)] == [f"Call us now\nSong {k} begins\nSong {k} ends" for k in range(2)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    assert sorted(map(str, ours[order].itertuples(index=False, name=None))) == sorted(map(str, theirs[order].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_cover_their_tables(spark, name):
    got = registry.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op5') else 'documents'}.parquet").count()
    assert got.count() == n


def test_pipeline(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        columns = columns or docs.columns
        assert docs.columns[: len(columns)] == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_copies":
            from quern.llm import jaccard

            groups = jaccard.groups(before)
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
        if name == "personal_data":
            assert docs.count() == before.count() and docs.where(F.col("text").rlike(r"@mail[0-9]")).count() == 0
    assert docs.where("copies NOT BETWEEN 1 AND 3").count() == 0
