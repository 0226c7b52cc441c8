"""Benchmark decontamination: Wu-Manber search over words.

Words are runs of ASCII letters (folded to lower case), digits and non-ASCII
characters. A pattern is a window of `window` consecutive words of an item, or
all its words if it has fewer. Patterns of one length make one searcher:

* the shift table gives, by a hash of two adjacent words, how far the search
  may move on without passing an occurrence (the largest move where no pattern
  has the block; hash collisions only shorten moves);
* where it gives 0, patterns are looked up by a hash of their last words (the
  suffix bucket), and the hash of all their words is compared;
* what is left is confirmed byte by byte.

All texts of a chunk move on together, one array step at a time, and long
texts are cut into lanes that overlap by a window, so that steps stay few.

The shift table grows with the patterns, so that at most one slot in sixteen is
taken by a block of theirs. The patterns are sent to the executors in blocks of
`block` patterns, each one a pass over the documents whose hits are written before
the next block is built: the bound on what is broadcast holds at any size of the
benchmark. Hits of different blocks meet as word ranges, by document.

Null and empty texts have no words and no hits; texts of any length are searched
whole. Null or empty items match nothing. Rows that repeat an id are searched each
on their own; item ids that repeat count once. A null id is kept. An empty table
gives no rows, an empty benchmark no hits. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernel

LANE = 512  # words that a lane moves over
BLOCKS_PER_SLOT = 1 / 16  # of the shift table that are taken, at most: the rest lets the search move on


class Words:
    """The words of a chunk: folded bytes, spans, hashes and each text's first word."""

    def __init__(self, chunk: kernel.Chunk):
        self.buf = kernel.LOWER[chunk.buf]
        self.starts, self.ends, self.firsts = kernel.word_spans(chunk, kernel.PUNCTUATION)
        self.hashes = kernel.span_hashes(self.buf, self.starts, self.ends)

    def phrase(self, first: int, count: int) -> bytes:
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.starts[first : first + count], self.ends[first : first + count]))


def rolled(hashes: np.ndarray, count: int) -> np.ndarray:
    """A hash of every `count` consecutive words."""
    n = len(hashes) - count + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(count if n > 0 else 0):
        out = kernel.mix(out + hashes[k : k + n])
    return out


class Searcher:
    """Patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[bytes, list]):
        self.length, self.block = length, min(2, length)
        self.items = [patterns[p] for p in sorted(patterns)]
        self.phrases = sorted(patterns)
        blocks = len(self.phrases) * (length - self.block + 1)
        self.bits = max(16, int(np.ceil(np.log2(blocks / BLOCKS_PER_SLOT + 1))))
        size, top = 1 << self.bits, np.uint64(64 - self.bits)
        self.shift = np.full(size, min(length - self.block + 1, 127), np.int8)
        words = Words(next(kernel.chunks(pa.array(self.phrases, pa.binary()), 1 << 62)))
        suffixes, wholes = [], []
        for k in range(len(self.phrases)):
            own = words.hashes[words.firsts[k] : words.firsts[k + 1]]
            blocks = rolled(own, self.block)
            np.minimum.at(self.shift, (blocks >> top).astype(np.int64), np.minimum(length - self.block - np.arange(len(blocks)), 127).astype(np.int8))
            suffixes.append(blocks[-1])
            wholes.append(rolled(own, length)[0])
        self.suffixes = np.unique(np.array(suffixes, np.uint64))
        by_whole = np.argsort(np.array(wholes, np.uint64), kind="stable")
        self.wholes, self.order = np.array(wholes, np.uint64)[by_whole], by_whole

    def find(self, words: Words) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence; none runs over the end of its text."""
        m, b = self.length, self.block
        lo, hi = words.firsts[:-1], words.firsts[1:] - m + 1  # where an occurrence may start
        lanes = np.maximum((hi - lo + LANE - 1) // LANE, 0)
        text = np.repeat(np.arange(len(lo)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = lo[text] + nth * LANE
        end = np.minimum(at + LANE, hi[text])
        blocks = rolled(words.hashes, b)
        moves, found = self.shift[(blocks >> np.uint64(64 - self.bits)).astype(np.int64)] if len(blocks) else self.shift[:0], []
        while len(at):
            step = moves[at + m - b]
            stopped = at[step == 0]
            if len(stopped):
                ends = blocks[stopped + m - b]
                slot = np.minimum(np.searchsorted(self.suffixes, ends), len(self.suffixes) - 1)
                found.append(stopped[self.suffixes[slot] == ends])
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        starts = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        whole = np.zeros(len(starts), np.uint64)
        for k in range(m):
            whole = kernel.mix(whole + words.hashes[starts + k])
        slot = np.searchsorted(self.wholes, whole)
        alike = self.wholes[np.minimum(slot, len(self.wholes) - 1)] == whole
        hits = []
        for first, h, k in zip(starts[alike].tolist(), whole[alike], slot[alike].tolist(), strict=True):
            while k < len(self.wholes) and self.wholes[k] == h:
                pattern = int(self.order[k])
                if words.phrase(first, m) == self.phrases[pattern]:
                    hits.append((first, pattern))
                k += 1
        return hits


def windows(items: list[tuple], window: int) -> dict[bytes, list]:
    """Each distinct pattern, and the ids of the items that hold it."""
    out: dict[bytes, set] = defaultdict(set)
    for c in kernel.chunks(pa.array([t for _, t in items], pa.string())):
        words = Words(c)
        for k in range(len(c)):
            first, count = int(words.firsts[k]), int(words.firsts[k + 1] - words.firsts[k])
            for at in range(max(count - window, 0) + 1 if count else 0):
                out[words.phrase(first + at, min(count, window))].add(items[c.first + k][0])
    return {p: sorted(ids, key=str) for p, ids in out.items()}


def searchers(patterns: dict[bytes, list]) -> list[Searcher]:
    by_length = defaultdict(dict)
    for p, ids in patterns.items():
        by_length[p.count(b" ") + 1][p] = ids
    return [Searcher(n, own) for n, own in sorted(by_length.items())]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with touching ranges joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(texts: pa.Array, found_by: list[Searcher]) -> tuple[list[int], list[list], list[list[str]]]:
    """Of each text: words, hit word ranges, and item ids as text, sorted."""
    n_words, ranges, items = [], [], []
    for c in kernel.chunks(texts):
        words = Words(c)
        own, ids = defaultdict(list), defaultdict(set)
        for s in found_by:
            for first, pattern in s.find(words):
                k = int(np.searchsorted(words.firsts, first, "right")) - 1
                at = first - int(words.firsts[k])
                own[k].append((at, at + s.length))
                ids[k].update(str(i) for i in s.items[pattern])
        n_words += np.diff(words.firsts).tolist()
        ranges += [merge(own[k]) if k in own else [] for k in range(len(c))]
        items += [sorted(ids[k]) if k in ids else [] for k in range(len(c))]
    return n_words, ranges, items


HITS = "n_words long, ranges array<struct<a:int,b:int>>, items array<string>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, block: int = 200_000, id_col="doc_id", text_col="text", item_col="item_id") -> DataFrame:
    """(id, n_words, ranges, items) for each document: its hit words as ranges, the items that occur in it.

    The benchmark is read in slices of at most about `block` windows, the size of what is broadcast at once.
    """
    items = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    # an item of n characters has n / 2 windows at most
    sizes = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    slices = max(1, -(-int(sizes) // (block * 4)))
    array_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def searched(frame: DataFrame, own: DataFrame, key: str, text: str) -> DataFrame:
        found_by = searchers(windows([tuple(r) for r in own.collect()], window))

        def each(texts):
            n, ranges, names = search(texts, found_by)
            pairs = [[{"a": a, "b": b} for a, b in r] for r in ranges]
            return [pa.array(n, pa.int64()), pa.array(pairs, array_type), pa.array(names, pa.list_(pa.string()))]

        return kernel.by_batch(frame, key, text, each, HITS)

    if slices == 1:
        return searched(docs, items, id_col, text_col)
    # more slices: rows are numbered so that repeated ids stay apart, searched for each slice, and joined by number
    numbered = kernel.written(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("_text")), "numbered")
    every = None
    for k in range(slices):
        one = kernel.written(searched(numbered, items.where(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == k), "_row", "_text").where((F.size("items") > 0) | F.lit(k == 0)), "hits")
        every = one if every is None else every.unionByName(one)
    joined = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("ranges"))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = "(acc, x) -> if(size(acc) > 0 and x.a <= element_at(acc, -1).b, concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(x.b, element_at(acc, -1).b)))), concat(acc, array(x)))"
    merged = joined.withColumn("ranges", F.expr(f"aggregate(r, cast(array() as array<struct<a:int,b:int>>), {step})"))
    return numbered.select("_row", F.col("_key").alias(id_col)).join(merged, "_row").select(id_col, "n_words", "ranges", "items")


def report(found: DataFrame) -> DataFrame:
    """hits() with n_hit, n_items, items_sha256 and contaminated: 5 % of the words or more are hit."""
    n_hit = F.expr("aggregate(ranges, 0L, (n, r) -> n + r.b - r.a)")
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
