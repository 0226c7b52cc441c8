"""Index, boolean, ranking and suggestion queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import crawl as cr
from quern.operators import index as ix
from quern.operators import query as qy
from quern.operators import ranking as rk
from quern.operators import suggest
from quern.operators.scratch import numbered
from quern.plans.base import Tables, query

FLAT = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = f"""w AS (SELECT doc_id, source, lang, CASE WHEN {FLAT} = '' THEN [] ELSE string_split({FLAT}, ' ') END AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS term, unnest(range(0, len(ws))) AS position FROM w),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id, len(ws) AS doc_length FROM w),
s AS (SELECT count(*) AS n, avg(doc_length) AS avgdl FROM l)"""
WITH = f"WITH {TOKENS} "


def toks(t: Tables) -> DataFrame:
    return ix.tokens(t.documents, "doc_id", F.col("text"))


def posts(t: Tables, *terms: str) -> DataFrame:
    """Stored postings; of the given terms only, the scan skips the others."""
    rows = t.index.postings
    return rows.where(F.col("term").isin(*terms)) if terms else rows


def lens(t: Tables) -> DataFrame:
    return t.index.docs.select("doc_id", "doc_length")


def known(t: Tables) -> rk.Known:
    return rk.Known(t.index.terms, t.index.totals)


@query("index_postings", WITH + "SELECT t.term, t.doc_id, count(*)::INT AS tf, min(position)::INT AS first_position, max(position)::INT AS last_position FROM t GROUP BY ALL")
def _(t):
    p = posts(t)
    return p.select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first_position"), F.element_at("positions", -1).alias("last_position"))


@query("index_document_frequency", WITH + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def _(t):
    return posts(t).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("index_totals", WITH + "SELECT n AS n_docs, (SELECT sum(doc_length) FROM l)::BIGINT AS total_length, round(avgdl, 6) AS avgdl, (SELECT count(DISTINCT term) FROM t) AS term_count FROM s")
def _(t):
    return t.index.totals.select("n_docs", "total_length", F.round("avgdl", 6).alias("avgdl"), F.col("terms").alias("term_count"))


@query("index_doc_lengths", WITH + "SELECT doc_id, doc_length::INT AS doc_length FROM l")
def _(t):
    return lens(t)


@query("index_folded_terms", WITH + ", f AS (SELECT doc_id, replace(strip_accents(term), 'đ', 'd') AS term FROM t) SELECT term, count(DISTINCT doc_id) AS df FROM f GROUP BY term")
def _(t):
    # folding comes after the distinct: each form of a word is folded once a document
    pairs = posts(t).select("doc_id", "term")
    return pairs.select("doc_id", T.strip_diacritics("term").alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("index_renumbered", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS new_id FROM documents")
def _(t):
    return numbered(t.documents.select("doc_id"), ["doc_id"], "new_id").select("doc_id", F.col("new_id").cast("int").alias("new_id"))


def has(term: str) -> str:
    return f"SELECT DISTINCT doc_id FROM t WHERE term = '{term}'"


@query("boolean_and", WITH + f"{has('the')} INTERSECT {has('that')}")
def _(t):
    return qy.evaluate(posts(t, "the", "that"), qy.And((qy.Term("the"), qy.Term("that"))))


@query("boolean_or", WITH + f"{has('que')} UNION {has('der')}")
def _(t):
    return qy.evaluate(posts(t, "que", "der"), qy.Or((qy.Term("que"), qy.Term("der"))))


@query("boolean_and_not", WITH + f"{has('the')} EXCEPT {has('this')}")
def _(t):
    return qy.evaluate(posts(t, "the", "this"), qy.And((qy.Term("the"), qy.Not(qy.Term("this")))))


@query("boolean_all_of_four", WITH + "SELECT doc_id FROM t WHERE term IN ('the', 'and', 'of', 'in') GROUP BY doc_id HAVING count(DISTINCT term) = 4")
def _(t):
    words = ("the", "and", "of", "in")
    return qy.evaluate(posts(t, *words), qy.And(tuple(qy.Term(w) for w in words)))


@query("boolean_nested", WITH + f"(({has('the')}) INTERSECT (({has('was')}) UNION ({has('with')}))) EXCEPT ({has('by')})")
def _(t):
    tree = qy.And((qy.Term("the"), qy.Or((qy.Term("was"), qy.Term("with"))), qy.Not(qy.Term("by"))))
    return qy.evaluate(posts(t, "the", "was", "with", "by"), tree)


@query("phrase_of_the", WITH + "SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the'")
def _(t):
    return qy.evaluate(posts(t, "of", "the"), qy.Phrase(("of", "the")))


@query("phrase_three_words", WITH + "SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.position = a.position + 1 JOIN t c ON a.doc_id = c.doc_id AND c.position = a.position + 2 WHERE a.term = 'of' AND b.term = 'the' AND c.term = 'and'")
def _(t):
    return qy.evaluate(posts(t, "of", "the", "and"), qy.Phrase(("of", "the", "and")))


@query("site_restricted", WITH + "SELECT DISTINCT t.doc_id FROM t JOIN documents d USING (doc_id) WHERE term = 'the' AND d.source = 'src3'")
def _(t):
    q = qy.ParsedQuery(must=["the"])
    return qy.resolve(posts(t, "the"), q, t.documents.where("source = 'src3'"))[0]


@query("candidates_capped", WITH + "SELECT DISTINCT doc_id FROM t WHERE term = 'the' ORDER BY doc_id LIMIT 100")
def _(t):
    return qy.resolve(posts(t, "the"), qy.ParsedQuery(must=["the"]), limit=100)[0]


@query("relaxed_unknown_term", WITH + f"{has('the')} INTERSECT {has('that')}")
def _(t):
    q = qy.parse("the that nosuchwordatall")
    return qy.resolve(posts(t, *q.terms()), q)[0]


BM25 = """SELECT p.doc_id, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.doc_length / s.avgdl))) AS score
FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) d USING (term) JOIN l USING (doc_id), s WHERE p.term IN ({terms}) GROUP BY p.doc_id"""
TFIDF = """SELECT p.doc_id, sum(qw * (1 + log10(p.tf)) * idf) / (any_value(qn) * sqrt(greatest(any_value(l.doc_length), 1))) AS score
FROM p JOIN (SELECT term, log10(s.n / df) AS idf, log10(s.n / df) AS qw, sqrt(sum(log10(s.n / df) ** 2) OVER ()) AS qn
  FROM (SELECT term, count(*) AS df FROM p WHERE term IN ({terms}) GROUP BY term), s WHERE log10(s.n / df) > 0) d USING (term) JOIN l USING (doc_id) GROUP BY p.doc_id"""


def top10(rows: str) -> str:
    return f"SELECT doc_id, round(score, 6) AS score FROM ({rows}) ORDER BY round(score, 6) DESC, doc_id LIMIT 10"


def best(rows: DataFrame, k: int = 10) -> DataFrame:
    return rk.top_k(rows.withColumn("score", F.round("score", 6)), k)


@query("rank_bm25_top10", WITH + top10(BM25.format(terms="'the', 'that'") + " HAVING count(*) = 2"))
def bm25_top10(t):
    p = posts(t, "the", "that")
    found, _ = qy.resolve(p, qy.ParsedQuery(must=["the", "that"]), df=t.index.terms)
    return best(rk.bm25(p, lens(t), ["the", "that"], found, known=known(t)))


@query("rank_bm25_all", WITH + "SELECT doc_id, round(score, 6) AS score FROM (" + BM25.format(terms="'was', 'with', 'from'") + ")")
def _(t):
    return rk.bm25(posts(t, "was", "with", "from"), lens(t), ["was", "with", "from"], known=known(t)).withColumn("score", F.round("score", 6))


@query("rank_tfidf_top10", WITH + top10(TFIDF.format(terms="'was', 'with'")))
def _(t):
    return best(rk.tfidf(posts(t, "was", "with"), lens(t), {"was": 1, "with": 1}, known=known(t)))


@query("rank_page_two", WITH + f"SELECT doc_id, round(score, 6) AS score FROM ({BM25.format(terms=repr('and'))}) ORDER BY round(score, 6) DESC, doc_id LIMIT 10 OFFSET 10")
def _(t):
    offset, size = rk.page_bounds(2, 10)
    rows = rk.bm25(posts(t, "and"), lens(t), ["and"], known=known(t)).withColumn("score", F.round("score", 6))
    return rows.orderBy(F.desc("score"), "doc_id").limit(offset + size).offset(offset)


@query("score_scale", WITH + "SELECT round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count(*) AS n FROM (" + TFIDF.format(terms="'was', 'with'") + ")")
def _(t):
    rows = rk.tfidf(posts(t, "was", "with"), lens(t), {"was": 1, "with": 1}, known=known(t))
    return rows.agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("max_score"), F.count(F.lit(1)).alias("n"))


@query(
    "rank_boosted",
    WITH
    + "SELECT doc_id, round(score * (1 + 0.1 * (CASE WHEN len(list_filter(ws[1:8], lambda x: x IN ('the', 'that'))) > 2 THEN 2 ELSE len(list_filter(ws[1:8], lambda x: x IN ('the', 'that'))) END) / 2.0), 6) AS score FROM ("
    + BM25.format(terms="'the', 'that'")
    + ") JOIN w USING (doc_id)",
)
def _(t):
    rows = rk.bm25(posts(t, "the", "that"), lens(t), ["the", "that"], known=known(t)).join(t.documents.select("doc_id", F.array_join(F.slice(T.syllables(F.col("text")), 1, 8), " ").alias("title")), "doc_id")
    return rows.select("doc_id", F.round(rk.title_boost(F.col("score"), T.title_ratio(F.col("title"), ["the", "that"])), 6).alias("score"))


@query("suggest_prefix", WITH + "SELECT term, sum(tf)::BIGINT AS frequency FROM p WHERE starts_with(term, 'the') GROUP BY term ORDER BY frequency DESC, term LIMIT 10")
def _(t):
    return suggest.by_prefix(posts(t).groupBy("term").agg(F.sum("tf").alias("frequency")), "the", 10)


@query("suggest_bigrams", WITH + "SELECT a.term || ' ' || b.term AS phrase, count(*) AS frequency FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.position = a.position + 1 GROUP BY ALL HAVING count(*) >= 3")
def _(t):
    return suggest.bigrams(t.documents.select(T.syllables(F.col("text")).alias("words")), "words", 3)


@query("content_duplicates", r"SELECT fp, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS fp FROM documents WHERE trim(regexp_replace(lower(text), '\s+', ' ', 'g')) <> '') GROUP BY fp HAVING count(*) > 1")
def _(t):
    rows = t.documents.select("doc_id", T.fingerprint(F.col("text")).alias("fp")).where("fp IS NOT NULL")
    return rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("content_first_seen", r"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS f FROM documents) GROUP BY CASE WHEN f = '' THEN 'b' || doc_id ELSE f END")
def _(t):
    # blank texts are never duplicates of each other
    key = F.coalesce(T.fingerprint(F.col("text")), F.concat(F.lit("blank"), F.col("doc_id").cast("string")))
    return t.documents.groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("text_cards", r"SELECT doc_id, CASE WHEN length(f) > 160 THEN substring(f, 1, 160) || '…' ELSE f END AS card, CASE WHEN length(f) > 200 THEN substring(f, 1, 200) || '...' ELSE f END AS pooled FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)")
def _(t):
    return t.documents.select("doc_id", T.shortened(F.col("text"), 160, "…").alias("card"), T.shortened(F.col("text"), 200, "...").alias("pooled"))


@query("language_counts", "SELECT coalesce(nullif(trim(lang), ''), 'und') AS lang, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


VI_SQL = "'của','và','là','được','trong','người','những','các','có','không','cho','với','để','này','đã','khi','một','đến','về','như','từ','cũng','thì','sẽ','tại','theo','đó','nhiều','năm','trên','ở','vào','nhưng','hơn','phải','làm','việc'"
EN_SQL = "'the','of','and','to','in','is','that','for','it','with','was','on','are','be','this','have','from','has','not','but','they','which','said','will','would','about','more','been','were','their','its','than','when','who','what','into','also','after','over','only','other','these','such','there','his','her','our','you','he','she','we','at','by'"
#: Texts in the tables are in Latin letters; other scripts are tested on a fixture.
LANGUAGE_SQL = f"""x AS (SELECT doc_id, CASE WHEN lang IN ('vi', 'en') THEN lang ELSE 'und' END AS hint, len(regexp_extract_all(coalesce(text, ''), '\\p{{L}}')) AS letters,
  len(regexp_extract_all(coalesce(text, ''), '[ơưăđƠƯĂĐ\\x{{1EA0}}-\\x{{1EF9}}]')) AS marks, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda w: w <> '') AS ws FROM documents),
y AS (SELECT *, len(list_filter(ws, lambda w: w IN ({VI_SQL}))) / len(ws) AS vi, len(list_filter(ws, lambda w: w IN ({EN_SQL}))) / len(ws) AS en FROM x),
lang AS (SELECT doc_id, CASE WHEN letters = 0 THEN hint WHEN marks >= 0.005 * letters THEN 'vi' WHEN len(ws) < 40 THEN hint WHEN vi >= 0.05 THEN 'vi'
  WHEN en >= 0.12 OR hint = 'en' AND en >= 0.05 THEN 'en' ELSE 'other' END AS detected FROM y)"""


@query("language_detected", f"WITH {LANGUAGE_SQL} SELECT doc_id, detected FROM lang")
def _(t):
    return t.documents.select("doc_id", T.detect_language(F.col("lang"), F.col("text")).alias("detected"))


@query("language_filter", f"WITH {LANGUAGE_SQL} SELECT detected AS language, detected IN ('vi', 'en', 'und') AS accepted, count(*) AS n FROM lang GROUP BY ALL")
def _(t):
    rows = t.documents.select(F.col("lang").alias("language"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body_text"))
    return cr.language_counts(cr.language_checked(rows))


@query("looks_vietnamese", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN false WHEN length(trim(text)) < 15 THEN true ELSE replace(replace(strip_accents(trim(text)), 'đ', 'd'), 'Đ', 'D') <> trim(text) END AS yes FROM documents")
def _(t):
    return t.documents.select("doc_id", T.looks_vietnamese(F.col("text")).alias("yes"))
