"""Link graphs: resolution, PageRank, sparse products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.scratch import discard, written


def link_edges(docs: DataFrame) -> DataFrame:
    """(src, dst) of outlinks that lead to another page of the corpus; a repeated link is a repeated edge. Of pages with one url the last is the target."""
    target = docs.groupBy("url").agg(F.max("doc_id").alias("dst"))
    links = docs.select(F.col("doc_id").alias("src"), F.explode("outlinks").alias("url"))
    return links.join(target, "url").where("src <> dst").select("src", "dst")


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w): repeated edges add up; a source's weights sum to 1."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    return pairs.join(out, "src").select("src", "dst", (F.col("c") / F.col("n")).alias("w"))


def multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, value) of a sparse product: matrix (row, col, value), vector (col, x). Repeated cells add up."""
    return matrix.join(vector, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def step(ranks: DataFrame, edges: DataFrame, n: int, damping: float) -> DataFrame:
    """One iteration: (node, rank) to (node, rank, before). Ranks of nodes without links out are spread over all."""
    got = ranks.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
    linked = edges.select(F.col("src").alias("node")).distinct()
    loose = ranks.join(linked, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
    new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
    return ranks.join(got, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(loose)).select("node", new.alias("rank"), F.col("rank").alias("before"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, epsilon: float = 1e-6, most: int = 100, fixed: int | None = None) -> tuple[DataFrame, int]:
    """(node, rank) and iterations, until the ranks move by less than epsilon in all; or `fixed` iterations.

    Every iteration is written to the shared folder: its plan doesn't grow, and a lost executor costs one iteration.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank")), 0
    w = written(weighted(edges), "edges")
    ranks, last = nodes.select("node", F.lit(1.0 / n).alias("rank")), None
    for k in range(1, (fixed or most) + 1):
        after = written(step(ranks, w, n, damping), "ranks")
        if last is not None:
            discard(last)
        last = after
        ranks = after.select("node", "rank")
        if fixed is None and after.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < epsilon:
            return ranks, k
    return ranks, fixed or most
