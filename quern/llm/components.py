"""Connected components of an edge table, as DataFrame rounds.

Each round hooks every node's neighbours to the smallest label around it
(large star, then small star), written to the shared folder, until nothing
changes. Hubs are safe: stars are minima and joins, never lists of neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernel


def _minima(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): for each node of an edge, the smallest node that it can reach. Self-loops and repeats do no harm."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = kernel.written(pairs, "edges")
    before = None
    while True:
        # large star: larger neighbours of a node move to its smallest one
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = _minima(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = kernel.written(small.where("u <> v").distinct(), "edges")
        row = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == before:
            break
        before, pairs = (row["n"], row["x"]), after
    nodes = after.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(after.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
