"""The engine's face: what callers can ask."""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.operators import analytics, crawl, graph, index, ranking, scratch, suggest
from quern.operators.query import parse


class SearchEngine:
    """An index with ranks, suggestions and images; results are cached by parsed query and page until the next build.

    A build stores the index and the suggestions in the shared folder (or under `path`): searches read them, never the texts.
    """

    def __init__(self, docs: DataFrame, stopwords: tuple[str, ...] = (), images: DataFrame | None = None, cached: int = 500, tokenizer: index.Tokenizer | None = None, path: str | None = None):
        self.tokenizer, self.cached, self.path = tokenizer or index.plain(stopwords), cached, path
        self.build(docs, images)

    def build(self, docs: DataFrame, images: DataFrame | None = None) -> None:
        self.docs, self.images = docs, images
        path = f"{self.path}/index" if self.path else scratch.path(docs.sparkSession, "index")
        self.index = index.stored(index.build(docs, tokenizer=self.tokenizer), path)
        self.ranks: DataFrame | None = None
        self.iterations = 0
        titles = docs.where(T.looks_vietnamese(F.col("title"))).select(self.tokenizer.terms(F.col("title")).alias("words"))
        phrases = suggest.phrases(titles, "words", 3).withColumnRenamed("phrase", "display")
        self.counts = scratch.written(suggest.both_forms(phrases), "suggestions")
        self.learned: Counter = Counter()
        self._cache: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def rank_pages(self) -> int:
        """PageRank over the links inside the corpus; the number of iterations."""
        nodes = self.docs.select(F.col("doc_id").alias("node"))
        ranks, self.iterations = graph.pagerank(nodes, graph.link_edges(self.docs))
        self.ranks = ranks.withColumnRenamed("node", "doc_id")
        self._cache.clear()
        return self.iterations

    def search(self, q: str, page: int = 1, size: int = 20, how: ranking.Ranking = ranking.Ranking()) -> list[dict]:
        """A page of at most 100 results."""
        key = (repr(parse(q, self.tokenizer.words)), page, size, how)
        if key in self._cache:
            self.hits += 1
            self._cache.move_to_end(key)
            return self._cache[key]
        self.misses += 1
        rows = [r.asDict() for r in ranking.search(self.index, q, page, size, how, self.ranks)[0].collect()]
        self._cache[key] = rows
        if len(self._cache) > self.cached:
            self._cache.popitem(last=False)
        if rows:
            self.learn(q)
        return rows

    def learn(self, q: str, most: int = 1000) -> None:
        """Successful queries are kept aside, `most` of them at once, then folded into the stored suggestions."""
        self.learned[" ".join(q.lower().split())] += 1
        if len(self.learned) >= most:
            before, self.counts = self.counts, scratch.written(self.known_phrases(), "suggestions")
            self.learned.clear()
            scratch.discard(before)

    def known_phrases(self) -> DataFrame:
        if not self.learned:
            return self.counts
        new = self.counts.sparkSession.createDataFrame([(q, n) for q, n in self.learned.items()], "query STRING, n INT")
        return suggest.learned(self.counts, new.select("query", F.explode(F.sequence(F.lit(1), "n"))).select("query"))

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        return suggest.by_prefix(self.known_phrases(), prefix, limit, "key", "display")

    def search_images(self, q: str, size: int = 30) -> DataFrame:
        """Images of the best 300 pages, in their order."""
        found, _ = ranking.search(self.index, q, 1, 100, ranks=self.ranks)
        for page in (2, 3):
            found = found.unionByName(ranking.search(self.index, q, page, 100, ranks=self.ranks)[0])
        order = Window.orderBy(F.desc("score"), "doc_id")
        results = found.select("url", F.row_number().over(order).alias("rank"))
        return crawl.image_search(results, crawl.best_images(self.images)).limit(size if 1 <= size <= 100 else 30)

    def feed(self, page: int = 1, size: int = 12) -> DataFrame:
        size = size if 1 <= size <= 50 else 12
        return crawl.feed(self.docs, crawl.best_images(self.images)).offset((max(page, 1) - 1) * size).limit(size)

    def health(self) -> dict:
        n = self.docs.limit(1).count()
        return {"status": "up" if n else "empty", "code": 200 if n else 503}

    def stats(self) -> dict:
        seen = self.hits + self.misses
        return {**self.index.stats(), "cache_hit_rate": self.hits / seen if seen else 0.0, "pagerank_iterations": self.iterations}

    def corpus_stats(self) -> DataFrame:
        return analytics.corpus(self.docs.join(self.index.docs.select("doc_id", "doc_length"), "doc_id"))

    def run(self, config: dict, queries: list[str], depth: int = 10) -> DataFrame:
        """(query, rank, url) of each query under a configuration, for the evaluation."""
        how = ranking.Ranking(**config)
        out = None
        for q in queries:
            rows = ranking.search(self.index, q, 1, depth, how, self.ranks)[0]
            rows = rows.select(F.lit(q).alias("query"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "url")
            out = rows if out is None else out.unionByName(rows)
        return out


def from_sources(*loaders: Callable[[], DataFrame | None], **options) -> SearchEngine | None:
    """An engine over the first source that has documents."""
    from quern.sources.readers import first_source

    docs = first_source(*loaders)
    return None if docs is None else SearchEngine(docs, **options)
