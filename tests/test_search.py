import math

import pytest
from pyspark.sql import functions as F

from quern.operators import graph, index, query, ranking, segment, suggest
from quern.operators.query import And, Not, Or, Phrase, Term
from quern.plans.catalog import QUERIES
from quern.plans.engine import SearchEngine

BODIES = ["máy tính xách tay", "laptop giá rẻ", "máy tính giá rẻ", "điện thoại"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"http://{'a' if k % 2 else 'b'}.vn/{k}", f"Tài liệu {k}", None, b, [f"http://a.vn/{k + 1}", "http://none.vn/"], None, "vi") for k, b in enumerate(BODIES)]
    from quern import schemas

    return spark.createDataFrame(rows, schemas.DOCUMENT)


@pytest.fixture(scope="module")
def built(docs):
    return index.build(docs)


def ids(frame):
    return sorted(r["doc_id"] for r in frame.collect())


def test_parse():
    assert query.parse("máy tính").must == ["máy", "tính"]
    assert query.parse('"trình duyệt web"').phrases == [("trình", "duyệt", "web")]
    q = query.parse('"máy tính" giá -cũ site:VnExpress.net')
    assert (q.must, q.phrases, q.excluded, q.site) == (["giá"], [("máy", "tính")], ["cũ"], "vnexpress.net")
    assert query.parse('tin tức ""').phrases == []
    q = query.parse("trump OR iran OR mỹ chiến")
    assert (q.or_groups, q.must) == ([["trump", "iran", "mỹ"]], ["chiến"])
    assert query.parse("trump or iran").must == ["trump", "or", "iran"]


def test_or_binds_to_wanted_words_only():
    q = query.parse("x -a OR b")
    assert (q.must, q.excluded, q.or_groups) == ([], ["a"], [["x", "b"]])
    q = query.parse("site:b.vn OR y")
    assert (q.must, q.site, q.or_groups) == (["or", "y"], "b.vn", [])
    assert query.parse("a OR").must == ["a", "or"] and query.parse("OR a").must == ["or", "a"]
    assert query.parse("a OR b OR").or_groups == [["a", "b"]]
    assert query.parse("a OR !!").must == ["a"]


def test_compounds_in_index_query_and_suggestions(spark, docs):
    words = spark.createDataFrame([("máy tính", 1000), ("xách tay", 1000), ("giá rẻ", 1000)], "word string, frequency long")
    cut = index.compounds(spark, segment.dictionary(words), ("tính", "rẻ"))
    engine = SearchEngine(docs, tokenizer=cut)
    terms = {r["term"] for r in engine.index.postings.collect()}
    assert {"máy_tính", "may_tinh", "giá_rẻ", "tài", "laptop"} <= terms and not {"máy", "tính"} & terms
    assert [r["doc_id"] for r in engine.search("máy tính")] == [0, 2] and engine.search("tính") == []
    # a decomposed text has the same terms
    import unicodedata

    loose = docs.withColumn("body_text", F.lit(unicodedata.normalize("NFD", "máy tính giá")))
    assert "máy_tính" in {r["term"] for r in index.build(loose, tokenizer=cut).postings.collect()}
    rows = spark.createDataFrame([(["máy_tính", "mới"],)] * 3 + [(["một"],), ([],)], "w array<string>")
    assert {tuple(r) for r in suggest.phrases(rows, "w").collect()} == {("máy tính", 3), ("máy tính mới", 3)}


def test_trees(built):
    p = built.postings
    assert ids(query.evaluate(p, And((Term("máy"), Term("tính"))))) == [0, 2]
    assert ids(query.evaluate(p, Or((Term("laptop"), Term("điện"))))) == [1, 3]
    assert ids(query.evaluate(p, And((Term("giá"), Not(Term("laptop")))))) == [2]
    assert ids(query.evaluate(p, Phrase(("tính", "giá")))) == [2]
    assert ids(query.evaluate(p, And(()))) == []
    # a word without accents finds the accented ones
    assert ids(query.evaluate(p, Term("may"))) == [0, 2]
    for bad in (Not(Term("a")), And((Not(Term("a")),)), Or((Not(Term("a")),))):
        with pytest.raises(ValueError):
            query.evaluate(p, bad)


def test_relaxation_drops_unknown_then_common(spark):
    rows = spark.createDataFrame([(0, "sách xe"), (1, "sách"), (2, "sách"), (3, "hoa")], "doc_id long, t string")
    p = index.postings(index.tokens(rows, "doc_id", F.col("t")))
    found, dropped = query.resolve(p, query.parse("xe khongtontai"))
    assert (ids(found), dropped) == ([0], ["khongtontai"])
    found, dropped = query.resolve(p, query.parse("sách hoa"))
    assert (ids(found), dropped) == ([3], ["sách"])
    found, dropped = query.resolve(p, query.parse("hoa -hoa"))
    assert (ids(found), dropped) == ([], [])
    found, _ = query.resolve(p, query.parse("sách"), limit=2)
    assert ids(found) == [0, 1]


def test_registered_queries_see_more_than_10000_matches(spark, tmp_path):
    # the best documents have the highest ids
    text = F.when(F.col("id") >= 10_040, "the that").otherwise("the that and other words")
    spark.range(10_050).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("src3").alias("source"), F.lit("en").alias("lang")).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("site_restricted", "relaxed_unknown_term"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 10_050
    assert [r["doc_id"] for r in QUERIES["rank_bm25_top10"](spark, str(tmp_path)).collect()] == [*range(10_040, 10_050)]
    assert QUERIES["candidates_capped"](spark, str(tmp_path)).count() == 100


def test_worked_trace(spark):
    lens = spark.createDataFrame([(0, 44), (1, 26), (2, 27), (3, 25), (4, 21)], "doc_id long, doc_length int")
    tf = [(0, 5, 5), (1, 4, 4), (2, 3, 3), (4, 2, 1)]
    posts = spark.createDataFrame([(t, d, n[k], [0]) for d, *n in tf for k, t in enumerate(("a", "b"))], "term string, doc_id long, tf int, positions array<int>")
    got = {r["doc_id"]: r["score"] for r in ranking.bm25(posts, lens, ["a", "b", "a"]).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {0: 0.946802, 1: 0.989258, 2: 0.915114, 4: 0.750285}
    got = {r["doc_id"]: r["score"] for r in ranking.tfidf(posts, lens, {"a": 1, "b": 1}).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {0: 0.035103, 1: 0.04306, 2: 0.03896, 4: 0.034409}
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (3, 0), (4, 0), (4, 1), (4, 2)], "src long, dst long")
    ranks, n = graph.pagerank(lens.select(F.col("doc_id").alias("node")), edges)
    got = {r["node"]: r["rank"] for r in ranks.collect()}
    assert n == 20 and round(got[0], 6) == 0.363014 and round(got[3], 6) == 0.071918
    boosted = spark.createDataFrame([(0.946802, got[0], got[3], got[0])], "s double, r double, lo double, hi double")
    one = boosted.select(ranking.title_boost(ranking.pagerank_boost(F.col("s"), F.col("r"), F.col("lo"), F.col("hi")), F.lit(1.0))).first()[0]
    assert one == pytest.approx(1.353927, abs=2e-6)


def test_scalars():
    assert ranking.idf_of(10, 5) == pytest.approx(math.log(2))
    assert ranking.idf_of(100, 0) == 0
    assert ranking.page_bounds(0, 500) == (0, 20) and ranking.page_bounds(3, 10) == (20, 10)
    with pytest.raises(ValueError):
        ranking.Ranking(base="none")


@pytest.mark.parametrize(
    ("edges", "n", "check"),
    [
        ("AB BC CA", 3, lambda r: all(abs(v - 1 / 3) < 1e-4 for v in r.values())),
        ("AB AC BC CA DC", 5, lambda r: abs(sum(r.values()) - 1) < 1e-6),
        ("AB BA", 4, lambda r: abs(r["C"] - r["D"]) < 1e-9),
        ("AB AC BC CA DC", 4, lambda r: r["C"] > r["A"] > r["B"]),
    ],
)
def test_pagerank(spark, edges, n, check):
    nodes = spark.createDataFrame([(x,) for x in "ABCDE"[:n]], "node string")
    pairs = spark.createDataFrame([tuple(e) for e in edges.split()], "src string, dst string")
    ranks, _ = graph.pagerank(nodes, pairs)
    assert check({r["node"]: r["rank"] for r in ranks.collect()})


def test_empty_graph_and_product(spark):
    ranks, n = graph.pagerank(spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string"))
    assert (ranks.count(), n) == (0, 0)
    m = spark.createDataFrame([(0, 1, 0.5), (1, 2, 1.0), (2, 0, 0.5), (2, 1, 0.5)], "row int, col int, value double")
    v = spark.createDataFrame([(k, 1.0) for k in range(3)], "col int, x double")
    assert sorted(tuple(r) for r in graph.multiply(m, v).collect()) == [(0, 0.5), (1, 1.0), (2, 1.0)]


def test_save_and_load(built, spark, tmp_path):
    index.save(built, str(tmp_path / "ix"), 2)
    again = index.load(spark, str(tmp_path / "ix"))
    assert again.stats() == built.stats()
    spark.createDataFrame([(1, "old")], "version INT, tokenizer STRING").write.mode("overwrite").parquet(str(tmp_path / "ix/meta"))
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "ix"))


def test_engine(docs):
    engine = SearchEngine(docs)
    assert [r["doc_id"] for r in engine.search("giá rẻ")] == [1, 2]
    assert engine.search("giá rẻ") and engine.hits == 1
    assert [r["doc_id"] for r in engine.search("giá rẻ site:b.vn")] == [2]
    assert engine.rank_pages() > 0
    assert engine.stats()["total_docs"] == 4 and engine.health()["code"] == 200
    assert engine.corpus_stats().first()["documents"] == 4
    # both queries had results, and are found with and without accents
    assert engine.suggest("giá").count() == engine.suggest("gia").count() == 2
    engine.learn("giá rẻ", most=1)
    assert not engine.learned and ("giá rẻ", 2) in {tuple(r) for r in engine.suggest("gia").collect()}
    assert engine.run({"base": "bm25", "pagerank": 0.0, "title": 0.0, "recency": 0.0}, ["giá", "máy"]).count() == 4


def test_segmentation(spark):
    rows = spark.createDataFrame([("máy tính", 1000), ("xách tay", 1000), ("máy", 10), ("tính", 10), ("a b c d e", 9)], "word string, frequency long")
    known = segment.dictionary(rows)
    assert segment.segmented("máy tính xách tay".split(), known) == ["máy_tính", "xách_tay"]
    assert segment.longest_match("máy tính lạ".split(), known) == ["máy_tính", "lạ"]
    cut = segment.segmenter(spark, known, frozenset({"của"}))
    assert spark.createDataFrame([("Máy tính của tôi",), (None,)], "t string").select(cut(F.col("t"))).collect()[0][0] == ["máy_tính", "tôi"]
    lines = spark.createDataFrame([("Nhà  cửa 5",), ("nha cua 7",), ("nhà 3",), ("xyz 9",), ("cua 2",), ("b@d 3",)], "line string")
    assert [r["word"] for r in segment.build_dictionary(lines).collect()] == ["nha cua", "nhà cửa", "nhà", "cua"]
    assert segment.compare(["máy tính".split()], known)["different"] == 0


def test_learned_suggestions(spark):
    counts = spark.createDataFrame([("hà nội", "Hà Nội", 3), ("hà nam", "Hà Nam", 5)], "key string, display string, frequency long")
    more = suggest.learned(counts, spark.createDataFrame([("hà nội",)] * 3, "query string"))
    assert [tuple(r) for r in suggest.by_prefix(more, "HÀ", 5, "key").collect()] == [("hà nội", 6), ("hà nam", 5)]


def test_bigrams_of_whole_texts(spark, tmp_path):
    late = "x" + " y" * 20
    texts = [f"{late} hà nội", f"{late} hà nội", "hà nội", None, "", "một"]
    spark.createDataFrame(enumerate(texts), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in QUERIES["suggest_bigrams"](spark, str(tmp_path)).collect()} == {("hà nội", 3), ("y y", 38)}
