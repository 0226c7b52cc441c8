"""Crawl-side data quality: robots rules, links, images, frontier, reports."""

from __future__ import annotations

import html as references
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions import urls as U

HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def robots_rules(lines: DataFrame) -> DataFrame:
    """(host, agent, ord, allow, prefix) from (host, ord, line): a group's agents hold for the rules under them."""
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.select("host", "ord", F.lower(F.trim(F.regexp_extract(clean, r"^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).alias("value"))
    rows = rows.where(F.col("name").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("ord")
    # a group begins with an agent line that follows a rule
    begins = F.when((F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("allow")) != "user-agent"), 1).otherwise(0)
    rows = rows.withColumn("_b", begins).withColumn("group", F.sum("_b").over(order)).drop("_b")
    agents = rows.where("name = 'user-agent'").select("host", "group", F.lower("value").alias("agent")).distinct()
    rules = rows.where("name <> 'user-agent' AND value <> ''").select("host", "group", "ord", (F.col("name") == "allow").alias("allow"), F.col("value").alias("prefix"))
    return rules.join(agents, ["host", "group"]).select("host", "agent", "ord", "allow", "prefix")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """urls with allowed: the longest matching prefix decides, the first of equal ones; rules for the agent replace those for all."""
    mine = rules.where((F.col("agent") == agent.lower()) | (F.col("agent") == "*")).withColumn("_own", F.col("agent") == agent.lower())
    some = mine.groupBy("host").agg(F.max("_own").alias("_some"))
    mine = mine.join(some, "host").where("_own = _some").select("host", "ord", "allow", "prefix")
    rows = urls.withColumn("_id", F.monotonically_increasing_id()).withColumn("_host", U.host(F.col(url_col)))
    rows = rows.withColumn("_path", F.concat(F.when(U.part(F.col(url_col), 4) == "", "/").otherwise(U.part(F.col(url_col), 4)), U.part(F.col(url_col), 5)))
    # an equi-join on the host; the prefix is a filter on its rules
    hit = rows.join(mine, (F.col("_host") == F.col("host")) & F.col("_path").startswith(F.col("prefix")))
    best = hit.groupBy("_id").agg(F.max_by("allow", F.struct(F.length("prefix"), -F.col("ord"))).alias("allowed"))
    return rows.join(best, "_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("_id", "_host", "_path")


def outlinks(html: Column, base: Column) -> Column:
    """Distinct absolute http(s) links of a page in order, itself left out."""
    own = U.canonical(base)
    links = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), 1), lambda x: U.resolved(base, F.replace(x, F.lit("&amp;"), F.lit("&"))))
    return F.array_distinct(F.filter(links, lambda x: x.isNotNull() & (x != own)))


def discovered(pages: DataFrame, max_depth: int, domains: tuple[str, ...] = ()) -> DataFrame:
    """(url, depth, source_url, reason) of each page's links, one level deeper."""
    rows = pages.select(F.col("url").alias("source_url"), (F.col("depth") + 1).alias("depth"), F.explode("outlinks").alias("url"))
    return rows.withColumn("reason", U.reject_reason(F.col("url"), F.col("depth"), max_depth, domains))


def language_checked(docs: DataFrame) -> DataFrame:
    """docs with language as title and text show it, and accepted: Vietnamese, English or too little to tell."""
    text = F.concat(F.coalesce(F.concat("title", F.lit(" ")), F.lit("")), F.coalesce("body_text", F.lit("")))
    out = docs.withColumn("language", T.detect_language(F.col("language"), text))
    return out.withColumn("accepted", T.language_accepted(F.col("language")))


def language_counts(checked: DataFrame) -> DataFrame:
    """(language, accepted, n): the filter's counters."""
    return checked.groupBy("language", "accepted").agg(F.count(F.lit(1)).alias("n"))


PAGE = StructType([StructField(n, StringType()) for n in ("title", "description", "lang", "text")])
REMOVED = re.compile(r"<(script|style|noscript|nav|footer|header|iframe|svg)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)


def read_page(page: str | None) -> dict:
    """Title, meta description (by name, else og), declared language and visible text."""
    page = page or ""

    def first(pattern: str) -> str:
        m = re.search(pattern, page, re.S | re.I)
        return " ".join(references.unescape(m[1]).split()) if m else ""

    def meta(key: str) -> str:
        for tag in re.findall(r"<meta\b[^>]*>", page, re.I):
            if re.search(rf"""(?:name|property)\s*=\s*["']?{key}["'\s>]""", tag, re.I):
                m = re.search(r"""content\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag, re.I)
                return " ".join(references.unescape((m[1] or m[2] or "") if m else "").split())
        return ""

    body = REMOVED.sub(" ", re.sub(r"<head\b.*?</head\s*>", " ", page, flags=re.S | re.I))
    text = " ".join(references.unescape(re.sub(r"<[^>]*>", " ", body)).split())
    return {"title": first(r"<title[^>]*>(.*?)</title"), "description": meta("description") or meta("og:description"), "lang": first(r"""<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)"""), "text": text}


@F.pandas_udf(PAGE)
def parsed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=PAGE.names)


IMAGE_FIELDS = StructType([StructField(n, StringType()) for n in ("src", "alt", "width", "height")])


@F.pandas_udf(ArrayType(IMAGE_FIELDS))
def image_tags(html: pd.Series) -> pd.Series:
    """Of each img element the source (data-src, then data-original, then src), alternative text and declared size."""

    def of(tag: str) -> dict:
        found = {n.lower(): references.unescape(a or b or c) for n, a, b, c in re.findall(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", tag)}
        return {"src": found.get("data-src") or found.get("data-original") or found.get("src"), "alt": found.get("alt", ""), "width": found.get("width"), "height": found.get("height")}

    return html.map(lambda h: [of(t) for t in re.findall(r"<img\b[^>]*>", h or "", re.I)])


def images(pages: DataFrame, most: int = 50) -> DataFrame:
    """(page_url, host, image_url, alt_text, declared_width, place): allowed types, each once a page, the first `most`."""
    rows = pages.select(F.col("url").alias("page_url"), U.host(F.col("url")).alias("host"), F.posexplode(image_tags("html")).alias("place", "i"))
    rows = rows.withColumn("image_url", U.resolved(F.col("page_url"), F.col("i.src")))
    rows = rows.where(U.extension(F.col("image_url")).isin(*U.IMAGES))
    rows = rows.select("page_url", "host", "image_url", F.col("i.alt").alias("alt_text"), U.declared_width(F.col("image_url"), F.col("i.width")).alias("declared_width"), "place")
    once = Window.partitionBy("page_url", "image_url").orderBy("place")
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_url").orderBy("place"))).where(F.col("_n") <= most).drop("_n")


def best_images(found: DataFrame) -> DataFrame:
    """One image a page: best tier, widest, with alternative text, first seen. One aggregate, no sort."""
    rank = F.struct(U.image_tier(F.col("image_url"), F.col("declared_width")).alias("tier"), "declared_width", (F.trim(F.coalesce("alt_text", F.lit(""))) != "").alias("has_alt"), (-F.col("place")).alias("early"))
    best = found.groupBy("page_url").agg(F.max_by(F.struct("image_url", "alt_text", "declared_width"), rank).alias("b"), F.max(rank).alias("r"))
    return best.select("page_url", "b.image_url", "b.alt_text", "b.declared_width", F.col("r.tier").alias("tier"))


def image_statistics(found: DataFrame) -> DataFrame:
    """One row: images, distinct urls, pages with one, with and without alternative text, of known size."""
    alt = F.trim(F.coalesce("alt_text", F.lit(""))) != ""
    return found.agg(
        F.count(F.lit(1)).alias("images"),
        F.count_distinct("image_url").alias("urls"),
        F.count_distinct("page_url").alias("pages"),
        F.count_if(alt).alias("with_alt"),
        F.count_if(~alt).alias("missing_alt"),
        F.count_if(F.col("declared_width") > 0).alias("sized"),
    )


def by_host(rows: DataFrame, most: int) -> DataFrame:
    """(host, pages, chars, missing_alt) of the `most` hosts with the most pages."""
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.count_if(F.trim(F.coalesce("alt_text", F.lit(""))) == "").alias("missing_alt"))
    return counts.orderBy(F.desc("pages"), "host").limit(most)


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits (64 at least) and hashes of a filter for n keys with a share p of false positives."""
    bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def maybe_seen(seen: DataFrame, key: str, asked: DataFrame, p: float = 0.01) -> DataFrame:
    """asked with maybe: false only if no row of seen has the key. The filter is a table of words, so it may be of any size."""
    bits, hashes = bloom_size(seen.count(), p)
    places = lambda rows: rows.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.lit(hashes)), lambda k: F.pmod(F.xxhash64(F.col(key).cast("string"), k), F.lit(bits)))).alias("bit"))
    flags = places(seen).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("flags"))
    met = places(asked.distinct()).withColumn("word", F.shiftright("bit", 6)).join(flags, "word", "left")
    hit = F.coalesce(F.expr("shiftright(flags, cast(bit & 63 AS int)) & 1L"), F.lit(0))
    found = met.groupBy(key).agg((F.min(hit) == 1).alias("maybe"))
    return asked.join(found, key)


def image_search(results: DataFrame, best: DataFrame, most: int = 300) -> DataFrame:
    """results (url, rank) with their pages' images: a shared image goes to the first page; images with alternative text come first."""
    rows = results.join(best, F.col("url") == F.col("page_url"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("image_url").orderBy("rank"))).where("_n = 1").drop("_n")
    return first.orderBy((F.trim(F.coalesce("alt_text", F.lit(""))) == "").cast("int"), "rank").limit(most)


def feed(docs: DataFrame, best: DataFrame, most: int = 200) -> DataFrame:
    """Pages with an image, newest first."""
    rows = docs.where("trim(coalesce(url, '')) <> ''").join(best.select("page_url", "image_url"), F.col("url") == F.col("page_url"))
    snippet = T.shortened(F.coalesce(F.nullif(F.trim("meta_description"), F.lit("")), F.col("body_text")), 160, "…")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url"))
    return rows.select("doc_id", "url", title.alias("title"), snippet.alias("snippet"), "image_url", "crawled_at").orderBy(F.col("crawled_at").desc_nulls_last(), "doc_id").limit(most)


def first_by_content(docs: DataFrame, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """Rows less repeated texts (blank ones all stay): the first ids come from one aggregate, then a semi join of narrow rows."""
    key = F.coalesce(T.fingerprint(F.col(text_col)), F.concat(F.lit("blank"), F.col(order).cast("string")))
    first = docs.groupBy(key.alias("_k")).agg(F.min(order).alias(order)).select(order)
    return docs.join(first, order, "left_semi")


def first_by_url(rows: DataFrame, url: str = "url", order: str = "seq") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(order))).where("_n = 1").drop("_n")


def frontier(links: DataFrame, crawled: DataFrame) -> DataFrame:
    """(url, host, known_host): links not crawled yet, once each, with whether their host was."""
    new = links.select("url").distinct().join(crawled.select("url").distinct(), "url", "left_anti").withColumn("host", U.site(F.col("url")))
    hosts = crawled.select(U.site(F.col("url")).alias("host")).distinct().withColumn("known_host", F.lit(True))
    return new.join(hosts, "host", "left").select("url", "host", F.coalesce("known_host", F.lit(False)).alias("known_host"))


def level(depth: Column, url: Column, backlinks: Column) -> Column:
    """Priority 0 to 4: depth, one better for .vn and one for five backlinks or more."""
    return F.greatest(F.lit(0), F.least(F.lit(4), depth - U.host(url).endswith(".vn").cast("int") - (backlinks >= 5).cast("int")))


def queue_weights(tasks: DataFrame, levels: int = 5) -> DataFrame:
    """(level, n, weight, share) of the levels that hold tasks: each weighs twice the next, and share is its chance to be served next."""
    sizes = tasks.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    weighed = sizes.withColumn("weight", F.pow(F.lit(2.0), F.lit(levels - 1) - F.col("level")).cast("long"))
    whole = weighed.agg(F.sum("weight").alias("_whole"))
    return weighed.crossJoin(F.broadcast(whole)).withColumn("share", F.col("weight") / F.col("_whole")).drop("_whole")  # one row


def served_first(tasks: DataFrame, n: int) -> DataFrame:
    """The n tasks that a strict selector takes first: lowest level, then in order."""
    return tasks.orderBy("level", "seq").limit(n)


def progress(pages: Column, most: Column, elapsed_ms: Column) -> tuple[Column, Column]:
    """Pages a second, and the milliseconds left at that rate; null while there is no rate."""
    rate = F.when(elapsed_ms > 0, pages * 1000.0 / elapsed_ms).otherwise(0.0)
    return rate, F.when(rate > 0, (F.greatest(F.lit(0), most - pages) / rate * 1000).cast("long"))


def run_counters(events: DataFrame) -> DataFrame:
    """One row of what a crawl's events (kind, ok, tries, duplicate, reason) add up to; rates are 0 without events."""
    lookup, load = F.col("kind") == "dns", F.col("kind") == "download"
    return events.agg(
        F.coalesce(F.count_if(lookup & F.col("ok")) / F.nullif(F.count_if(lookup), F.lit(0)), F.lit(0.0)).alias("dns_hit_rate"),
        F.count_if(load & F.col("ok")).alias("downloads"),
        F.count_if(load & ~F.col("ok")).alias("failures"),
        F.coalesce(F.sum(F.when(load, F.greatest(F.col("tries") - 1, F.lit(0)))), F.lit(0)).cast("long").alias("retries"),
        F.count_if(F.col("duplicate")).alias("duplicates"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )


def schedule(tasks: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """tasks (host, level, seq) with start_ms: at least gap_ms between two fetches of a host, best level first, then in order."""
    place = F.row_number().over(Window.partitionBy("host").orderBy("level", "seq")) - 1
    return tasks.withColumn("start_ms", (place * gap_ms).cast("long"))


def with_outlinks(pages: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages with the last outlinks event of their url; and the events that have no page."""
    last = events.groupBy("source_url").agg(F.max_by("outlinks", "seq").alias("outlinks"))
    joined = pages.join(last, F.col("url") == F.col("source_url"), "left").drop("source_url")
    return joined, last.join(pages.select(F.col("url").alias("source_url")), "source_url", "left_anti")


def run_report(docs: DataFrame, domains: tuple[str, ...] = ()) -> dict:
    """Figures of a crawl: pages, links, pages by host and language, edges inside the corpus, density."""
    row = docs.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("outlinks")).alias("outlinks")).first()
    hosts = docs.groupBy(U.site(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host")
    langs = docs.groupBy(F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("(chua gan)")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    langs = langs.withColumn("share", F.col("n") / F.lit(max(row["pages"], 1)))
    links = docs.select(F.col("url").alias("src"), F.explode("outlinks").alias("dst"))
    inside = links.join(docs.select(F.col("url").alias("dst")).distinct(), "dst", "left_semi")
    same = U.site(F.col("src")) == U.site(F.col("dst"))
    edges = inside.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(same.cast("int")), F.lit(0)).alias("internal")).first()
    spark = docs.sparkSession
    missing = spark.createDataFrame([(d,) for d in domains], "host STRING").join(hosts, "host", "left_anti") if domains else None
    pages = row["pages"]
    return {
        "pages": pages,
        "outlinks": row["outlinks"] or 0,
        "mean_outlinks": (row["outlinks"] or 0) / pages if pages else 0.0,
        "edges": edges["edges"],
        "internal": edges["internal"],
        "crossing": edges["edges"] - edges["internal"],
        "density": edges["edges"] / pages**2 if pages else 0.0,
        "by_host": hosts,
        "by_language": langs.orderBy(F.desc("n"), "language"),
        "missing": missing,
    }
