"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of `words` words (words are runs
of anything but ASCII white space, A-Z folded). Two sets link when their
Jaccard similarity reaches `threshold`. The result is exact: every link
between different sets is found or implied by other links of its component.

1. Frequent shingles. Counts of shingles that repeat within a task's block of
   documents are added up; the `frequent` largest (a fixed number, so a fixed
   size) are known to all tasks. They only order shingles and estimate costs.
2. Prefixes. A set is ordered rarest first. Sets that share t shingles share at
   least l of them within the first n - t + l of either. Each document picks the
   l for which the estimated cost of candidates is least: longer prefixes meet
   more documents, but each must be met l times before it is verified.
   Equal sets are one class from here on.
3. Stars. Shingles that only one class has are dropped. In each other shingle's
   list, every class is tried against one centre, the class that has the fewest
   rarer shingles: a list makes as many pairs as it has members. Pairs that share
   min(l, l') shingles of their prefixes are verified by whole sets; links give
   components.
4. The rest. Only lists that still hold classes of several components go on, and
   only pairs across components, again verified if they share enough.

A large group of near copies so costs about one comparison a member. Only classes
that share a shingle of their prefixes without being connected are paired one by
one in step 4: a list of m such classes gives up to m * m / 2 candidates, of two
numbers each. The number of matches that a document asks for, l, lengthens its
prefix, and decides which of the candidates are verified, not which are listed.

Classes are known by a 64-bit hash of their set, shingles by one of their words.
Null and empty texts have an empty set and link with nothing. A text of fewer
words is one shingle. Rows that repeat an id or a text are linked by their
texts like any others. A null id takes part; component ids are the smallest
non-null id, null only if there is none. Texts of any length are read whole; pairs
at the threshold exactly link. An empty table gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernel
from quern.llm.components import components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    share: tuple[int, int] = (80, 100)  # the threshold as a fraction
    matches: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)  # what a document may ask for
    verify: float = 40.0  # cost of verifying a pair, in entries of a list
    chance: float = 0.05  # other documents that have a shingle which isn't known to be frequent
    frequent: int = 1 << 18
    bitmap_bits: int = 25  # of the filters that are sent to all tasks: 4 MB each


def sets_of(texts: pa.Array, words: int):
    """Of each text, its shingles' hashes, sorted and distinct."""
    for c in kernel.chunks(texts):
        starts, ends, firsts = kernel.word_spans(c, kernel.WHITE)
        hashes = kernel.span_hashes(kernel.LOWER[c.buf], starts, ends)
        rolled = np.zeros(len(hashes), np.uint64)
        full = max(len(hashes) - words + 1, 0)
        for k in range(words):
            rolled[:full] = kernel.mix(rolled[:full] + hashes[k : k + full])
        for k in range(len(c)):
            a, b = firsts[k], firsts[k + 1]
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1]).view(np.int64)
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    one = kernel.mix(one + hashes[j : j + 1])
                yield one.view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def class_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def frequent_shingles(docs: DataFrame, s: Settings, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and about how many documents have them."""
    block = 2_000_000

    def work(batches):
        held, size = [], 0

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1]), pa.array(n[n > 1])], names=["token", "n"])

        for batch in batches:
            for own in sets_of(batch.column(0), s.words):
                held.append(own)
                size += len(own)
                if size >= block:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    texts = docs.select(F.col(text_col).cast("string").alias("_text"))
    counts = texts.mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where("n >= 8").orderBy(F.desc("n"), "token").limit(s.frequent).toArrow().sort_by("token")
    return top["token"].to_numpy(), top["n"].to_numpy()


def prefix(own: np.ndarray, known: tuple[np.ndarray, np.ndarray], s: Settings) -> tuple[np.ndarray, int]:
    """The first shingles in the global order, and how many matches the document asks for."""
    num, den = s.share
    tokens, counts = known
    n = len(own)
    need = -(-num * n // den)  # the least overlap that a link of this set has
    count = np.zeros(n, np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        count = np.where(tokens[at] == own, counts[at], 0)
    # a class of about equal counts is ordered by hash; own is sorted by hash already
    level = np.ceil(4 * np.log2(count + 1.0)).astype(np.int64)
    order = np.argsort(level, kind="stable")[: n - need + s.matches[-1]]
    met = np.cumsum(count[order] + s.chance)
    best, cost = 1, None
    for matches in (m for m in s.matches if m <= need):
        looks = float(met[n - need + matches - 1])
        total = n - need + matches + looks + s.verify * looks / matches  # entries made, entries met, pairs verified
        if cost is None or total < cost:
            best, cost = matches, total
    return own[order[: n - need + best]], best


def prefixes(docs: DataFrame, known, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h, l, tokens); of equal sets in a task only the first has tokens."""
    array = pa.list_(pa.int64())

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for own in sets_of(batch.column(1), s.words):
                h = class_of(own) if len(own) else 0
                if not len(own) or h in seen:
                    rows.append((len(own), h, 0, None))
                    continue
                seen.add(h)
                tokens, matches = prefix(own, known, s)
                rows.append((len(own), h, matches, tokens))
            n, h, matches, tokens = zip(*rows, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(matches, pa.int32()), pa.array(tokens, array)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "h", "l", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    return kept.mapInArrow(work, f"id {kind}, n long, h long, l int, tokens array<long>")


def required(s: Settings, a: str, b: str) -> str:
    """SQL: the overlap that sets of a and b shingles need to link."""
    num, den = s.share
    return f"(({num}L * ({a} + {b}) + {num + den - 1}) div {num + den})"


def lists(pre: DataFrame, s: Settings) -> DataFrame:
    """(token, h, n, l, rank) of all shingles that several classes have, with each list's centre: ch, cn, crank."""
    several = pre.select("h", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("token")
    several = kernel.written(several, "several")
    flags, bits = kernel.bitmap(several, "token", s.bitmap_bits), s.bitmap_bits

    def spread(batches):
        for batch in batches:
            h, n, l, tokens = (batch.column(k) for k in range(4))
            sizes = np.diff(np.asarray(tokens.offsets))
            flat = tokens.flatten().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = kernel.in_bitmap(flags, flat, bits)
            at = owner[keep]
            columns = [flat[keep], h.to_numpy()[at], n.to_numpy()[at], l.to_numpy()[at], rank[keep].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "h", "n", "l", "rank"])

    entries = pre.where("tokens IS NOT NULL").select("h", "n", "l", "tokens").mapInArrow(spread, "token long, h long, n long, l int, rank int")
    entries = entries.join(several, "token").distinct()
    entries = kernel.written(entries, "entries")
    centre = entries.groupBy("token").agg(F.min(F.struct("rank", "h", "n")).alias("c"))
    out = kernel.written(entries.join(centre.select("token", F.col("c.h").alias("ch"), F.col("c.n").alias("cn"), F.col("c.rank").alias("crank")), "token"), "lists")
    kernel.discard(several, entries)
    return out


def packed(own: np.ndarray) -> bytes:
    """The upper 48 bits of each shingle: two sets of a thousand agree by chance in one of 2**28 comparisons."""
    return own.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


def verify(pairs: DataFrame, pre: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Those of pairs (a, b) of classes that link. a may be in very many pairs, b in few.

    Sets are made again from the texts, for one document of each class in pairs: bitmaps of classes and of
    these documents' ids choose them (should another copy pass as well, its pairs are only found twice).
    """
    num, den = s.share
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    chosen = pre.where("n > 0").select("id", "h").join(wanted, "h").groupBy("h").agg(F.min("id").alias("id"))
    chosen = kernel.written(chosen.select("h", F.xxhash64("id").alias("m")), "chosen")
    bits = s.bitmap_bits
    classes, ids = kernel.bitmap(chosen, "h", bits), kernel.bitmap(chosen, "m", bits)

    def work(batches):
        for batch in batches:
            batch = batch.filter(pa.array(kernel.in_bitmap(ids, batch.column(0).to_numpy(), bits)))
            h_out, s_out = [], []
            for own in sets_of(batch.column(1), s.words):
                if len(own):
                    h = class_of(own)
                    if kernel.in_bitmap(classes, np.array([h]), bits)[0]:
                        h_out.append(h)
                        s_out.append(packed(own))
            yield pa.RecordBatch.from_arrays([pa.array(h_out, pa.int64()), pa.array(s_out, pa.binary())], names=["h", "own"])

    sets = docs.select(F.xxhash64(id_col).alias("_m"), F.col(text_col).cast("string").alias("_text")).mapInArrow(work, "h long, own binary")

    def compare(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            good = []
            for k in range(batch.num_rows):
                left, right = unpacked(x[k].as_py()), unpacked(y[k].as_py())
                both = np.concatenate([left, right])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(den * shared >= num * (len(both) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    # the sets are dealt out once, by class, for both joins; a class in very many pairs is split by the skew join
    met = pairs.join(sets.withColumnRenamed("h", "b").withColumnRenamed("own", "y"), "b")
    met = met.join(sets.withColumnRenamed("h", "a").withColumnRenamed("own", "x"), "a")
    return kernel.written(met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")


def enough(pairs: DataFrame, entries: DataFrame, s: Settings) -> DataFrame:
    """Those of pairs (a, b) that share as many shingles as both ask for, within prefixes that are longer by as many."""
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    own = entries.select("h", "n", "l", "rank", "token").join(wanted, "h", "left_semi")
    own = own.groupBy("h").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.collect_list(F.struct("rank", "token")).alias("p"))
    x, y = (own.select(*(F.col(c).alias(c + k) for c in own.columns)) for k in ("x", "y"))
    both = pairs.join(x, F.col("a") == F.col("hx")).join(y, F.col("b") == F.col("hy"))
    need, asked = required(s, "nx", "ny"), "least(lx, ly)"
    first = [f"transform(filter(p{k}, t -> t.rank < n{k} - {need} + {asked}), t -> t.token)" for k in ("x", "y")]
    return both.where(f"size(array_intersect({first[0]}, {first[1]})) >= {asked}").select("a", "b")


def class_links(pre: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between classes whose components are those of all links; and pre without its shingles."""
    entries = lists(pre, s)
    wide, pre = pre, kernel.written(pre.select("id", "n", "h"), "classes")
    kernel.discard(wide)
    need = required(s, "n", "cn")
    star = entries.where("h <> ch").where(f"least(n, cn) >= {need} AND rank <= n - {need} AND crank <= cn - {need}")
    star = star.select(F.col("ch").alias("a"), F.col("h").alias("b")).distinct()
    found = verify(kernel.written(enough(star, entries, s), "stars"), pre, docs, s, id_col, text_col)
    label = components(found, "a", "b")
    kernel.release(docs.sparkSession)  # plans of many rounds
    rest = entries.select("token", "h", "n", "l", "rank").join(label.withColumnRenamed("node", "h"), "h", "left")
    rest = kernel.written(rest.withColumn("label", F.coalesce("label", "h")), "labelled")
    open_ = rest.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    rest = kernel.written(rest.join(open_, "token"), "open")
    # sets that link share a shingle at places that allow the overlap; each such pair is a candidate once
    x, y = rest.alias("x"), rest.alias("y")
    need = required(s, "x.n", "y.n")
    near = f"x.token = y.token AND x.h < y.h AND x.label <> y.label AND least(x.n, y.n) >= {need} AND x.rank <= x.n - {need} AND y.rank <= y.n - {need}"
    met = x.join(y, F.expr(near)).select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct()
    across = enough(met, rest, s)
    more = verify(kernel.written(across, "across"), pre, docs, s, id_col, text_col)
    return found.union(more), pre


def groups(docs: DataFrame, s: Settings = Settings(), id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs."""
    known = frequent_shingles(docs, s, text_col)
    pre = kernel.written(prefixes(docs, known, s, id_col, text_col), "prefixes")
    links, pre = class_links(pre, docs, s, id_col, text_col)
    label = components(links, "a", "b")
    classes = pre.where("n > 0").groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = classes.join(label.withColumnRenamed("node", "h"), "h", "left")
    linked = classes.where("label IS NOT NULL")
    of_label = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    # classes of one document that link with nothing need no entry
    entry = linked.join(of_label, "label").select("h", "component_id").union(classes.where("label IS NULL AND size > 1").select("h", F.col("least").alias("component_id")))
    entry = kernel.written(entry, "classes")
    rows = pre.select("id", "n", F.when(F.col("n") > 0, F.col("h")).alias("h"))
    out = rows.join(entry, "h", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
