"""Mixing sources to target weights by entropy balancing.

Every source has a target in words. Documents are the units: their rates are the
ones nearest to 1 (in relative entropy) under which each source's words, size
times rate, add up to its target, and none above LIMIT. The dual of that problem
is convex with one multiplier for each source, and a document's rate is
exponentially tilted by its size: min(LIMIT, exp(multiplier * size / mean size
of its source)). A source that must shrink keeps more of its short documents, one
that must grow repeats more of its long ones.

The dual is solved by Newton steps, for all sources at once. Documents of one
source and size share a rate, so one aggregate over all documents counts them by
source and size, and a step is an aggregate over those counts: the words that
the rates give (the gradient, less the target) and the curvature, for each
source. As a document counts for one constraint only, the Hessian is diagonal. Steps are
taken on the logarithm of the words and kept within the bracket that earlier
steps have shown; a source is done when it meets its target to 1e-9. Sums are
exact decimals, so that they don't depend on the order of rows.

Rates become copies without chance: along a source's documents in order of size,
rates add up, and a document has as many copies as whole numbers are passed. So
a source's words differ from the target by no more than about its largest
document. A last step evens that out: from a bounded list of documents of each
size class, one copy more or less is given where it brings the source nearer.
The order is a range-partitioned sort and sums run within its ranges first, so
that no task holds a source.

Null and empty texts have size 0 and are never taken; texts of any length count
whole. A null source is a source of its own, the last one. Rows that repeat an id
are documents of their own. An empty table gives no rows. All ties are broken by
a hash of the row's id and text, then by id; equal rows are interchangeable. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import kernel

LIMIT = 3  # copies of a document, and its source's size, at most
OFFERS = 24  # documents of a size class that the last step may give a copy or take one from
SCALE_BITS = 24  # rates are added up as multiples of 2**-24
TOLERANCE = 1e-9
STEPS = 100


def word_count(text):
    """Number of runs of anything but ASCII white space."""
    # one space for each gap, none at the ends: a gap is counted, not a word list built
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(trimmed, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """sources (source, source_size) with target: shares by weight, the excess over LIMIT sizes dealt again.

    In order of the level (words for each unit of weight) at which sources are full, the first that isn't full
    when all before it are gives the level. One row a source: these are ordered in one task, documents never are.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("_weight", weight).withColumn("_most", F.lit(float(LIMIT)) * F.col("source_size"))
    ranked = ranked.withColumn("_full_at", F.col("_most") / F.col("_weight"))
    before = Window.orderBy("_full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", rest / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("_open", F.col("_weight") * F.col("_level") < F.col("_most"))
    level = F.min_by("_level", F.when(F.col("_open"), F.col("_full_at"))).over(every)
    out = ranked.withColumn("_share", F.when(F.max("_open").over(every), F.col("_weight") * level))
    # least() passes over the null that stands where all sources are full
    return out.withColumn("target", F.least("_most", "_share")).drop("_weight", "_most", "_full_at", "_level", "_open", "_share")


def tilt(x: str = "x", size: str = "size", unit: str = "_unit") -> str:
    """SQL: a document's rate."""
    return f"exp(least({math.log(LIMIT)!r}D, {x} * {size} / {unit}))"


def balanced(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (_src, source, source_size, target) with x, the dual's multiplier, and _unit, the mean size; null x: all rates are 0, or LIMIT.

    counts: (_src, size, n), documents of each size, none of size 0.
    """
    mean = counts.groupBy("_src").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("_unit"))
    inner = (F.col("target") > 0) & (F.col("target") < LIMIT * F.col("source_size"))
    start = F.when(inner, F.log(F.col("target") / F.col("source_size")))
    state = sources.join(mean, "_src", "left").withColumn("x", start)
    state = state.withColumn("_low", F.lit(None).cast("double")).withColumn("_high", F.lit(None).cast("double")).withColumn("_off", F.when(inner, 1.0))
    state = kernel.written(state, "balance")
    exact = "decimal(38,6)"
    for _ in range(STEPS):
        rows = counts.join(state.where(f"_off > {TOLERANCE!r}").select("_src", "x", "_unit"), "_src")
        words = F.expr(f"n * size * {tilt()}")
        slope = F.expr(f"if(x * size / _unit < {math.log(LIMIT)!r}D, n * size * (size / _unit) * {tilt()}, 0D)")
        step = rows.groupBy("_src").agg(F.sum(words.cast(exact)).cast("double").alias("_words"), F.sum(slope.cast(exact)).cast("double").alias("_slope"))
        after = state.join(step, "_src", "left").withColumn("_gone", F.col("_words").isNull())
        over = F.col("_words") > F.col("target")
        after = after.withColumns({
            "_off": F.when(F.col("_gone"), F.col("_off")).otherwise(F.abs(F.col("_words") / F.col("target") - 1)),
            "_high": F.when(~F.col("_gone") & over, F.col("x")).otherwise(F.col("_high")),
            "_low": F.when(~F.col("_gone") & ~over, F.col("x")).otherwise(F.col("_low")),
        })
        newton = F.col("x") - F.log(F.greatest("_words", F.lit(1e-6)) / F.col("target")) * F.col("_words") / F.col("_slope")
        newton = F.when((F.col("_slope") > 0) & (F.col("_words") > 0), newton)
        # outside what is known, or without a slope: half way, or further out where one side is still unknown
        inside = (newton > F.coalesce("_low", F.lit(-math.inf))) & (newton < F.coalesce("_high", F.lit(math.inf)))
        wider = F.coalesce((F.col("_low") + F.col("_high")) / 2, F.col("_low") + F.abs("_low") + 1, F.col("_high") - F.abs("_high") - 1)
        move = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(wider)
        after = after.withColumn("x", F.when(F.col("_gone") | (F.col("_off") <= TOLERANCE), F.col("x")).otherwise(move))
        state, before = kernel.written(after.drop("_words", "_slope", "_gone"), "balance"), state
        kernel.discard(before)
        # halving stops where neighbouring numbers meet
        if not state.where(f"_off > {TOLERANCE!r} AND NOT coalesce(_high - _low <= 1e-13 * greatest(1, abs(x)), false)").limit(1).count():
            break
    return state.drop("_low", "_high", "_off")


def rate_units(of: DataFrame) -> DataFrame:
    """of (with x, _unit, target, source_size, size) with _q, the rate in multiples of 2**-SCALE_BITS."""
    rate = F.when(F.col("x").isNotNull(), F.expr(tilt())).when(F.col("target") > 0, F.lit(float(LIMIT))).otherwise(0.0)
    return of.withColumn("_q", F.when(F.col("size") > 0, F.round(rate * (1 << SCALE_BITS)).cast("long")).otherwise(0).cast("long"))


def running(batches):
    """Sums of _q within each source of a task's rows, which come ordered by source; (all columns, _upto)."""
    last, carry = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        src, q = batch.column("_src"), batch.column("_q").to_numpy()
        new = np.append(True, pc.not_equal(src.slice(1), src.slice(0, n - 1)).to_numpy(zero_copy_only=False))
        first, total = np.flatnonzero(new), np.cumsum(q)
        upto = total - np.repeat(total[first] - q[first], np.diff(np.append(first, n)))
        if src[0].as_py() == last:
            upto[: first[1] if len(first) > 1 else n] += carry
        last, carry = src[n - 1].as_py(), int(upto[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto)], names=[*batch.schema.names, "_upto"])


def repair(frame: pd.DataFrame) -> pd.DataFrame:
    """One source's offers: gives or takes single copies, the largest first, while that brings it nearer."""
    gap, change = float(frame["_gap"].iloc[0]), {}
    frame = frame.sort_values(["size", "_tie", "_key"], ascending=[False, True, True])
    for row, size, copies in zip(frame["_row"], frame["size"], frame["copies"], strict=True):
        sign = 1 if gap > 0 else -1
        if 2 * abs(gap) > size and 0 <= copies + sign <= LIMIT:
            change[row] = sign
            gap -= sign * size
    return pd.DataFrame({"_row": list(change), "_change": list(change.values())}, columns=["_row", "_change"]).astype("int64")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) for each row of docs."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_key"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        # a key without nulls, so that plain equality joins it
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("_src"),
        word_count(text).alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("_tie"),
    )
    rows = kernel.written(rows.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    counts = kernel.written(rows.groupBy("source", "_src", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = targets(counts.groupBy("source", "_src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights)
    solved = balanced(counts.where("size > 0").select("_src", "size", "n"), kernel.written(sources, "targets"))
    placed = rate_units(rows.where("size > 0").drop("source").join(solved, "_src")).select("_src", "size", "_tie", "_key", "_row", "_q")
    order = ["_src", "size", "_tie", "_key", "_row"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    fields = ", ".join(f"`{name}` {kind}" for name, kind in ranged.dtypes)
    ranged = kernel.written(ranged.mapInArrow(running, f"{fields}, _upto long"), "ranged")
    # a source's sum up to a task: one row for each task that has some of it
    parts = ranged.groupBy("_src", "_part").agg(F.sum("_q").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_src", "_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    half, upto = 1 << (SCALE_BITS - 1), F.col("_before") + F.col("_upto")
    whole = lambda c: F.shiftright(c + half, SCALE_BITS)
    dealt = ranged.join(parts, ["_src", "_part"]).withColumn("copies", F.least(whole(upto) - whole(upto - F.col("_q")), F.lit(LIMIT)).cast("long"))
    dealt = kernel.written(dealt.drop("_part", "_upto", "_before"), "dealt")
    got = dealt.groupBy("_src").agg(F.sum(F.col("size") * F.col("copies")).alias("_got"))
    gaps = got.join(solved.select("_src", "target"), "_src").select("_src", (F.col("target") - F.col("_got")).alias("_gap"))
    # offers: a few documents of each size class, found within 64 slices of it first; only the first rows of a slice move
    offers = dealt.withColumn("_class", F.ceil(4 * F.log2(F.col("size") + 1.0)).cast("int")).withColumn("_slot", F.pmod(F.shiftright("_tie", 8), F.lit(64)).cast("int"))
    for keys, most in ((["_src", "_class", "_slot"], 2), (["_src", "_class"], OFFERS)):
        nth = Window.partitionBy(*keys).orderBy("_tie", "_key", "_row")
        offers = offers.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= most)
    offers = offers.join(gaps, "_src").select("_src", "_row", "_key", "_tie", "size", "copies", "_gap")
    change = offers.withColumn("_key", F.col("_key").cast("string")).groupBy("_src").applyInPandas(repair, "_row long, _change long")
    taken = dealt.join(kernel.written(change, "repairs"), "_row", "left").select("_key", "_src", "size", "_q", (F.col("copies") + F.coalesce("_change", F.lit(0))).alias("copies"))
    blank = rows.where("size = 0").select("_key", "_src", "size", F.lit(0).cast("long").alias("_q"), F.lit(0).cast("long").alias("copies"))
    out = taken.unionByName(blank).join(solved.select("_src", "source", "source_size", "target"), "_src")
    return out.select(F.col("_key").alias(id_col), "source", "size", "source_size", "target", (F.col("_q") / F.lit(float(1 << SCALE_BITS))).alias("rate"), "copies")
