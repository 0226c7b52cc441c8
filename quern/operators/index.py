"""The inverted index as tables: tokens, postings, document lengths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import strip_diacritics, syllables
from quern.operators import segment
from quern.operators.query import words_of

VERSION = 4


@dataclass(frozen=True)
class Tokenizer:
    """name: what an index was built with; terms: the terms of a text column, in order; words: the same for a query's text."""

    name: str
    terms: Callable[[Column], Column]
    words: Callable[[str], list[str]] = words_of


def plain(stopwords: tuple[str, ...] = ()) -> Tokenizer:
    """Syllables; a stop word takes no position."""

    def terms(text: Column) -> Column:
        words = syllables(text)
        return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words

    return Tokenizer(f"syllables-{len(stopwords)}", terms, lambda t: [w for w in words_of(t) if w not in stopwords])


def compounds(spark: SparkSession, known: dict[str, float], stopwords: tuple[str, ...] = ()) -> Tokenizer:
    """The dictionary's words, joined by _; only single syllables can be stop words."""
    stop = frozenset(stopwords)
    return Tokenizer(f"compounds-{len(known)}-{len(stop)}", segment.segmenter(spark, known, stop), lambda t: [w for w in segment.segmented(words_of(t), known) if w not in stop])


def tokens(docs: DataFrame, id_col: str, text, stopwords: tuple[str, ...] = (), tokenizer: Tokenizer | None = None) -> DataFrame:
    """(doc_id, position, term): a stop word takes no position."""
    words = (tokenizer or plain(stopwords)).terms(text)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words).alias("position", "term"))


def index_text(title, meta, body):
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(meta, F.lit("")), F.coalesce(body, F.lit("")))


def postings(toks: DataFrame, folded: bool = False) -> DataFrame:
    """(term, doc_id, tf, positions), positions ascending. With folded, a term with accents is indexed without them as well, at the same place."""
    if folded:
        toks = toks.select("doc_id", "position", F.explode(F.array_distinct(F.array("term", strip_diacritics("term")))).alias("term"))
    return toks.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """One posting a document, so a count is enough."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(docs: DataFrame, id_col: str, text) -> DataFrame:
    """(doc_id, doc_length): tokens of each document, without exploding them."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(syllables(text)).alias("doc_length"))


def totals(lens: DataFrame) -> DataFrame:
    """One row: n_docs, total_length, avgdl (0 if there are no documents)."""
    return lens.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("total_length"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avgdl"))


@dataclass
class SearchIndex:
    postings: DataFrame  # term, doc_id, tf, positions
    docs: DataFrame  # doc_id, url, title, body_text, crawled_at, doc_length
    tokenizer: Tokenizer = field(default_factory=plain)
    terms: DataFrame | None = None  # term, df; known once the index is stored
    totals: DataFrame | None = None  # one row: n_docs, total_length, avgdl, terms

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def stats(self) -> dict:
        row = (totals(self.docs) if self.totals is None else self.totals).first()
        terms = self.postings.select("term").distinct().count() if self.terms is None else row["terms"]
        return {"total_docs": row["n_docs"], "avg_doc_length": row["avgdl"], "terms": terms}


def build(docs: DataFrame, stopwords: tuple[str, ...] = (), folded: bool = True, tokenizer: Tokenizer | None = None) -> SearchIndex:
    """From DOCUMENT rows, not computed yet. Missing columns count as null."""
    tokenizer = tokenizer or plain(stopwords)
    names = ("url", "title", "meta_description", "body_text", "crawled_at")
    rows = docs.select("doc_id", *(F.col(n) if n in docs.columns else F.lit(None).cast("timestamp" if n == "crawled_at" else "string").alias(n) for n in names))
    text = index_text(F.col("title"), F.col("meta_description"), F.col("body_text"))
    toks = tokens(rows, "doc_id", text, tokenizer=tokenizer)
    return SearchIndex(postings(toks, folded), rows.withColumn("doc_length", F.size(tokenizer.terms(text))), tokenizer)


def save(index: SearchIndex, path: str, partitions: int | None = None) -> None:
    """Postings sorted by term within hash partitions, so that the scan of a term skips all other row groups; their counts, lengths and totals beside them."""
    parts = [partitions] if partitions else []
    index.postings.repartition(*parts, "term").sortWithinPartitions("term", "doc_id").write.option("parquet.block.size", 4 << 20).mode("overwrite").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark = index.spark
    document_frequency(spark.read.parquet(f"{path}/postings")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    spark.read.parquet(f"{path}/docs").select("doc_id", "doc_length").write.mode("overwrite").parquet(f"{path}/lengths")
    count = spark.read.parquet(f"{path}/terms").agg(F.count(F.lit(1)).alias("terms"))
    totals(spark.read.parquet(f"{path}/lengths")).crossJoin(F.broadcast(count)).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    spark.createDataFrame([(VERSION, index.tokenizer.name)], "version INT, tokenizer STRING").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, tokenizer: Tokenizer | None = None) -> SearchIndex:
    tokenizer = tokenizer or plain()
    row = spark.read.parquet(f"{path}/meta").first()
    if (row["version"], row["tokenizer"]) != (VERSION, tokenizer.name):
        raise ValueError(f"index of version {row['version']}, tokenizer {row['tokenizer']}; {VERSION}, {tokenizer.name} wanted")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "terms", "totals")}
    return SearchIndex(tables["postings"], tables["docs"], tokenizer, tables["terms"], tables["totals"])


def stored(index: SearchIndex, path: str, partitions: int | None = None) -> SearchIndex:
    """The index, computed once and read back."""
    save(index, path, partitions)
    return load(index.spark, path, index.tokenizer)
