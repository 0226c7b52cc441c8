"""Scores and the search itself."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import snippet, title_ratio
from quern.functions.urls import on_site, site
from quern.operators.index import SearchIndex, totals
from quern.operators.query import MAX_CANDIDATES, ParsedQuery, parse, resolve


def bm25_idf(n: Column, df: Column) -> Column:
    return F.when(df <= 0, 0.0).otherwise(F.log(1 + (n - df + 0.5) / (df + 0.5)))


def tfidf_idf(n: Column, df: Column) -> Column:
    return F.when((df <= 0) | (n <= 0), 0.0).otherwise(F.log10(n / df))


def tf_weight(tf: Column) -> Column:
    return F.when(tf <= 0, 0.0).otherwise(1 + F.log10(tf.cast("double")))


@dataclass(frozen=True)
class Known:
    """What a stored index has counted already: (term, df), and one row of totals."""

    df: DataFrame | None = None
    totals: DataFrame | None = None


def term_rows(posts: DataFrame, lens: DataFrame, terms: list[str], candidates: DataFrame | None = None, known: Known = Known()) -> DataFrame:
    """(doc_id, term, tf, df, doc_length, n_docs, avgdl) of the query's terms. Everything but the postings of these terms is one row or is joined by document."""
    rows = posts.where(F.col("term").isin(*terms or [""])).select("term", "doc_id", "tf")
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if known.df is None else known.df.where(F.col("term").isin(*terms or [""])).select("term", "df")
    sums = totals(lens) if known.totals is None else known.totals.select("n_docs", "avgdl")
    if candidates is not None:
        rows = rows.join(candidates.select("doc_id"), "doc_id", "left_semi")
    rows = rows.join(F.broadcast(df), "term")  # one row a query term
    return rows.join(lens.select("doc_id", "doc_length"), "doc_id").crossJoin(F.broadcast(sums))


def bm25(posts: DataFrame, lens: DataFrame, terms: list[str], candidates: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, known: Known = Known()) -> DataFrame:
    """(doc_id, score); a term counts once however often the query has it."""
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 >= 0 and 0 <= b <= 1")
    rows = term_rows(posts, lens, sorted(set(terms)), candidates, known)
    norm = k1 * (1 - b + b * F.col("doc_length") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    part = bm25_idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))


def tfidf(posts: DataFrame, lens: DataFrame, terms: dict[str, int], candidates: DataFrame | None = None, known: Known = Known()) -> DataFrame:
    """(doc_id, score): cosine over the query's norm and the square root of the document's length; terms that every document has drop out."""
    rows = term_rows(posts, lens, sorted(terms), candidates, known)
    times = F.element_at(F.create_map(*(F.lit(x) for t in sorted(terms) for x in (t, terms[t]))), F.col("term")) if terms else F.lit(1)
    idf = tfidf_idf(F.col("n_docs"), F.col("df"))
    rows = rows.withColumn("_idf", idf).where("_idf > 0").withColumn("_q", tf_weight(times) * F.col("_idf"))
    norm = rows.select("term", "_q").distinct().agg(F.sqrt(F.sum(F.col("_q") * F.col("_q"))).alias("_norm"))
    rows = rows.crossJoin(F.broadcast(norm))
    part = F.col("_q") * tf_weight(F.col("tf")) * F.col("_idf") / (F.col("_norm") * F.sqrt(F.greatest(F.col("doc_length"), F.lit(1)).cast("double")))
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))


def pagerank_boost(score: Column, rank: Column, low: Column, high: Column, weight: float = 0.3) -> Column:
    """x (1 + w log1p(pr/min) / log1p(max/min)); min over positive ranks, a missing rank counts as min."""
    value = F.coalesce(F.when(rank > 0, rank), low)
    return F.when(F.coalesce(low, F.lit(0.0)) <= 0, score).otherwise(score * (1 + weight * F.log1p(value / low) / F.greatest(F.log1p(high / low), F.lit(1e-9))))


def title_boost(score: Column, ratio: Column, weight: float = 0.1) -> Column:
    return score * (1 + weight * ratio)


def recency_boost(score: Column, at: Column, first: Column, last: Column, weight: float = 0.2) -> Column:
    """x (1 + w (t - min) / (max - min)), the range one millisecond at least; no time, no boost."""
    ms = lambda c: F.unix_millis(c)
    share = (ms(at) - ms(first)) / F.greatest(ms(last) - ms(first), F.lit(1))
    return F.when(at.isNull(), score).otherwise(score * (1 + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))


@dataclass(frozen=True)
class Ranking:
    base: str = "tfidf"
    pagerank: float = 0.3
    title: float = 0.1
    recency: float = 0.2

    def __post_init__(self):
        if self.base not in ("tfidf", "tf-idf", "bm25"):
            raise ValueError(f"unknown scorer {self.base}")


def score(index: SearchIndex, q: ParsedQuery, candidates: DataFrame, how: Ranking = Ranking(), ranks: DataFrame | None = None) -> DataFrame:
    """Candidates with their documents' columns and score."""
    terms = q.terms()
    known = Known(index.terms, index.totals)
    base = bm25(index.postings, index.docs, [*terms], candidates, known=known) if how.base == "bm25" else tfidf(index.postings, index.docs, terms, candidates, known)
    rows = candidates.join(index.docs, "doc_id").join(base, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if ranks is not None and how.pagerank:
        positive = F.when(F.col("rank") > 0, F.col("rank"))
        ends = ranks.agg(F.min(positive).alias("_low"), F.max(positive).alias("_high"))
        rows = rows.join(ranks.select("doc_id", "rank"), "doc_id", "left").crossJoin(F.broadcast(ends))
        rows = rows.withColumn("score", pagerank_boost(F.col("score"), F.col("rank"), F.col("_low"), F.col("_high"), how.pagerank)).drop("rank", "_low", "_high")
    if how.title:
        rows = rows.withColumn("score", title_boost(F.col("score"), title_ratio(F.col("title"), [*terms]), how.title))
    if how.recency:
        ends = index.docs.agg(F.min("crawled_at").alias("_first"), F.max("crawled_at").alias("_last"))
        rows = rows.crossJoin(F.broadcast(ends)).withColumn("score", recency_boost(F.col("score"), F.col("crawled_at"), F.col("_first"), F.col("_last"), how.recency)).drop("_first", "_last")
    return rows


def top_k(rows: DataFrame, k: int, by: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best k: one TakeOrdered, no full sort."""
    return rows.orderBy(F.desc(by), F.asc(tie)).limit(max(k, 0))


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """(offset, size): pages 1 to 1000, sizes 1 to 100, else 20."""
    size = size if 1 <= size <= 100 else 20
    return (min(max(page, 1), 1000) - 1) * size, size


def search(index: SearchIndex, raw: str, page: int = 1, size: int = 20, how: Ranking = Ranking(), ranks: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """A page of results (rank, doc_id, url, title, score, snippet) and the dropped terms."""
    q = parse(raw, index.tokenizer.words)
    where = index.docs.where(on_site(F.col("url"), q.site)).select("doc_id") if q.site else None
    found, dropped = resolve(index.postings, q, where, MAX_CANDIDATES, index.terms)
    offset, size = page_bounds(page, size)
    best = score(index, q, found, how, ranks).orderBy(F.desc("score"), F.asc("doc_id")).limit(offset + size).offset(offset)
    return best.select("doc_id", "url", "title", site(F.col("url")).alias("host"), "score", snippet([*q.terms()])("body_text").alias("snippet")), dropped


def idf_of(n: int, df: int) -> float:
    """BM25's, for a driver-side look."""
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) if df > 0 else 0.0
