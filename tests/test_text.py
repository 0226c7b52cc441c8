from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_syllables_fold_and_fingerprint(spark):
    assert values(spark, [("Ông  Trump, dọa!",), (None,), ("  ",)], "t string", T.syllables(F.col("t"))) == [["ông", "trump", "dọa"], [], []]
    assert values(spark, [("Đường phố",), (None,)], "t string", T.strip_diacritics("t")) == ["Duong pho", None]
    a, b, c = values(spark, [("Ha  Noi ",), ("ha noi",), (" ",)], "t string", T.fingerprint(F.col("t")))
    assert a == b and c is None
    assert values(spark, [("  ha   NOI ",)], "t string", T.normal_query(F.col("t"))) == ["ha noi"]


def test_title_ratio_matches_loosely_one_way(spark):
    assert values(spark, [("Máy tính xách tay",)], "t string", T.title_ratio(F.col("t"), ["may", "tính"])) == [1.0]
    assert values(spark, [("may tinh",)], "t string", T.title_ratio(F.col("t"), ["máy"])) == [0.0]
    assert values(spark, [(None,)], "t string", T.title_ratio(F.col("t"), ["máy"])) == [0.0]


def test_snippet_marks_and_escapes():
    text = " ".join(["x"] * 40 + ["tin", "<b>", "tuc"])
    out = T.snippet_of(text, ["tin", "tuc"])
    assert out.startswith("... ") and "<mark>tin</mark> &lt;b&gt; <mark>tuc</mark>" in out
    assert T.snippet_of(None, ["a"]) == ""


def test_language(spark):
    rows = [("", "Người dân và chính quyền của thành phố"), ("en", "the cat of the house is in it and that was " * 8), ("", "Привет мир как дела"), ("vi-VN", ""), (None, None)]
    got = values(spark, rows, "h string, t string", T.detect_language(F.col("h"), F.col("t")))
    assert got == ["vi", "en", "ru", "vi", "und"]


def test_languages_that_are_neither(spark):
    french = "le chat est sur la table et il mange très bien à côté de la fenêtre où l'on voit les élèves " * 4
    spanish = "el niño está en la casa y come muy bien con su mamá porque así lo quiere la señora de aquí " * 4
    rows = [("fr", french), ("en", french), ("es", spanish), (None, "שלום עולם"), ("vi", "Καλημέρα κόσμε"), ("", "नमस्ते दुनिया"), ("", "გამარჯობა"), ("fr", "trop court"), ("en-US", "short"), ("fr", None), ("vi_VN", "123")]
    got = values(spark, rows, "h string, t string", T.detect_language(F.col("h"), F.col("t")))
    assert got == ["other", "other", "other", "he", "el", "hi", "georgian", "und", "en", "und", "vi"]


def test_language_of_the_whole_text(spark):
    rows = [("en", "the cat of the house " * 1000 + "và của là có các được " * 200)]
    assert values(spark, rows, "h string, t string", T.detect_language(F.col("h"), F.col("t"))) == ["vi"]
    assert values(spark, rows, "h string, t string", T.detect_language(F.col("h"), F.col("t"), 20_000)) == ["en"]


def test_canonical_urls(spark):
    rows = ["https://A.vn/x/", "http://a.vn:80/", "https://a.vn:8080/X?q=1#f", "no url#x", None, "", "https://u:p@a.vn:443/a"]
    got = values(spark, [(r,) for r in rows], "u string", U.canonical(F.col("u")))
    assert got == ["https://a.vn/x", "http://a.vn", "https://a.vn:8080/X?q=1", "no url", None, "", "https://a.vn/a"]


def test_reject_reasons_come_in_order(spark):
    rows = [("https://video.vnexpress.net/x", 1), ("https://facebook.com/gi-do", 1), ("https://vnexpress.net/a", 3), ("https://vnexpress.net/a.PDF", 0), ("mailto:x@y", 0), (None, 0), ("https://cn.vnexpress.net/", 0), ("ftp://vnexpress.net", 0)]
    got = values(spark, rows, "u string, d int", U.reject_reason(F.col("u"), F.col("d"), 2, ("vnexpress.net",)))
    assert got == [None, "domain", "depth", "extension", "scheme", "scheme", "language", "scheme"]


def test_links_resolve(spark):
    rows = [("https://a.vn/x/y.html", link) for link in ("z.html", "/q/", "//b.vn/p", "https://c.vn/#t", "mailto:a", "#top")]
    got = values(spark, rows, "b string, l string", U.resolved(F.col("b"), F.col("l")))
    assert got == ["https://a.vn/x/z.html", "https://a.vn/q", "https://b.vn/p", "https://c.vn", None, "https://a.vn/x/y.html"]


def test_image_tiers(spark):
    rows = [("https://a.vn/p/640x480/x.jpg", None), ("https://a.vn/logo.png", "900"), ("https://a.vn/x.svg", "900"), ("https://a.vn/x.jpg?w=120", None), ("https://a.vn/x.jpg", "")]
    frame = spark.createDataFrame(rows, "u string, w string").withColumn("n", U.declared_width(F.col("u"), F.col("w")))
    assert [r[0] for r in frame.select(U.image_tier(F.col("u"), F.col("n"))).collect()] == [3, 0, 0, 1, 2]


def test_image_sizes_and_words(spark):
    rows = [("https://a.vn/x.jpg?rw=640", 640), ("https://a.vn/x.jpg?mw=120&h=2", 120), ("https://a.vn/a_640x480_b.jpg", 640), ("https://a.vn/a-1200x630.jpg", 1200), ("https://a.vn/a.jpg", -1)]
    assert values(spark, rows, "u string, n int", U.declared_width(F.col("u"), F.lit(None).cast("string"))) == [n for _, n in rows]
    bad = [(f"https://a.vn/{w}/x.jpg",) for w in "thumbs blank badges button favicon watermark 1x1".split()] + [("https://a.vn/x.GIF?a=1",)]
    assert set(values(spark, bad, "u string", U.image_tier(F.col("u"), F.lit(900)))) == {0}


def test_blocked_extensions_and_editions(spark):
    rows = [(f"https://a.vn/x.{e}",) for e in "json xml rss woff2 exe 7z mkv csv apk webm".split()] + [(f"https://{p}a.vn/x",) for p in ("pt.", "ar.", "lo.", "km.", "en.")]
    got = values(spark, rows, "u string", U.reject_reason(F.col("u"), F.lit(0), 2))
    assert got == ["extension"] * 10 + ["language"] * 4 + [None]
