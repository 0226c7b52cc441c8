"""Repeated byte strings by a logarithmic family of suffix arrays.

Every byte that lies in a string of `length` bytes which also starts anywhere
else in the corpus is removed. A window is such a string; its key is the
smallest hash of the k-byte strings in it, so equal windows have equal keys,
and consecutive windows mostly share theirs. A run of windows with one key is
the unit that moves.

1. Runs are listed without their bytes, with a digest each. Keys of a single run
   (that doesn't hold its key twice) can't repeat. Where all runs of a key have
   the same digest, all their windows repeat, as do those of any run whose digest
   comes twice. All this is settled by counting.
2. The bytes of all other runs, once for each digest, go to the index: keys are
   dealt over tasks, and each task takes its runs batch by batch. A batch gets a
   suffix array of its windows; it is merge-scanned against the suffix array
   of each level there is, equal windows are marked on both sides, and levels of
   about one size merge into the next, so that a window is merged a
   logarithmic number of times.
3. Keys with more than `hot` runs would fill one task. Their runs are split: windows
   that hold their key at about one place (places are dealt by `widths`) have the
   bytes around it in common, and these name a new key. The parts are treated
   like runs, by 1 and 2, and keys that are still hot are split by the next width.
   At a width of 1 a part is one window and its key names all its bytes, so that a
   key's parts are alike however many there are: 1 settles them.

A text's result depends on nothing but the text and the set of all windows, so
texts are known by a 128-bit hash, and equal texts of `length` bytes or more are
removed whole without a look at their runs.

Null and empty texts, and ones shorter than `length`, lose nothing. Repeated
rows are copies of each other. Ids are only carried along; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernel


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 24
    hot: int = 4000  # runs of a key that one task may hold
    widths: tuple[int, ...] = (32, 1)  # windows in a part of a run, where a key is split; the last is 1
    task_bytes: int = 12 << 20  # of runs in a task of the index
    batch_bytes: int = 3 << 19
    bitmap_bits: int = 24


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = np.append(x, np.full(-len(x) % w, x[-1], x.dtype)).reshape(-1, w)
    left = pick.accumulate(blocks, axis=1).ravel()
    right = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(right[:n], left[w - 1 : w - 1 + n])


def gram_keys(c: kernel.Chunk, k: int) -> np.ndarray:
    """A hash of every k consecutive bytes; none is 0."""
    prefix = np.zeros(len(c.buf) + 1, np.uint64)
    np.cumsum((c.buf.astype(np.uint64) + np.uint64(1)) * kernel.powers(kernel.MULTIPLIER, len(c.buf)), out=prefix[1:])
    return kernel.mix((prefix[k:] - prefix[:-k]) * kernel.powers(kernel.INVERSE, len(c.buf) + 1)[: len(prefix) - k]) | np.uint64(1)


def runs(c: kernel.Chunk, s: Settings) -> tuple[np.ndarray, ...]:
    """Of all runs: text, first window (in the buffer), number of windows, key, and whether the run holds its key twice."""
    width = s.length - s.gram + 1
    none = np.zeros(0, np.int64)
    if len(c.buf) <= s.length:
        return none, none, none, none.view(np.uint64), none.astype(bool)
    grams = gram_keys(c, s.gram)
    keys = sliding(grams, width, np.minimum)
    count = np.maximum(c.ends - c.starts - s.length + 1, 0)
    edge = np.zeros(len(c.buf) + 1, np.int32)
    np.add.at(edge, c.starts[count > 0], 1)
    np.add.at(edge, (c.starts + count)[count > 0], -1)
    inside = np.cumsum(edge)[: len(keys)] > 0
    keys = np.where(inside, keys, np.uint64(0))  # no key is 0
    turn = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    turn = np.union1d(turn, c.starts[count > 0])
    sizes = np.diff(np.append(turn, len(keys)))
    live = keys[turn] != 0
    first, sizes, key = turn[live], sizes[live], keys[turn[live]]
    text = np.searchsorted(c.starts, first, "right") - 1
    # places where some window's key stands, by key and place: does a run's region hold two of its key?
    padded = np.concatenate([np.zeros(width - 1, np.uint64), keys, np.zeros(max(len(grams) - len(keys), 0), np.uint64)])
    at = np.flatnonzero(sliding(padded, width, np.maximum)[: len(grams)] == grams)
    names, code = np.unique(grams[at], return_inverse=True)
    places = np.sort(code.astype(np.int64) << 32 | at)
    own = np.searchsorted(names, key).astype(np.int64) << 32
    second = np.searchsorted(places, own | first) + 1
    twice = (second < len(places)) & (places[np.minimum(second, len(places) - 1)] <= (own | (first + sizes - 1 + width - 1)))
    # smallest hashes are small numbers; bitmaps go by the upper bits, so the keys are spread again
    return text, first, sizes, kernel.mix(key), twice


def units(c: kernel.Chunk, s: Settings, levels: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """runs(); or, where levels has bitmaps of keys to split, the parts of those keys' runs after as many splits.

    Windows of a part hold their key first at one place, at distances that one number of width steps covers, so they
    all hold the bytes from the last one's start to the first one's end. A part's key names these bytes, the number of
    steps and the key before: equal windows, wherever they stand, are in parts of one key. No two windows of a part
    are equal, as their distances differ. A bitmap may let other keys' runs through; these are settled already, and what
    is found among them again is no more than was found.
    """
    found = runs(c, s)
    if not levels:
        return found
    none = tuple(x[:0] for x in found)
    keep = kernel.in_bitmap(levels[0], signed(found[3]), s.bitmap_bits)
    if not keep.any():
        return none
    text, first, sizes, key = (x[keep] for x in found[:4])
    run = np.repeat(np.arange(len(text)), sizes)
    at = np.arange(len(run)) - (np.cumsum(sizes) - sizes)[run] + first[run]
    # the place where each window's key stands first
    spread, names = kernel.mix(gram_keys(c, s.gram)), np.unique(key)
    code = np.minimum(np.searchsorted(names, spread), len(names) - 1)
    stands = np.flatnonzero(names[code] == spread)
    places = np.sort(code[stands].astype(np.int64) << 32 | stands)
    stand = places[np.searchsorted(places, np.searchsorted(names, key).astype(np.int64)[run] << 32 | at)] & 0xFFFFFFFF
    text, base = text[run], key[run]
    for k, width in enumerate(s.widths[: len(levels)]):
        if k:
            keep = np.repeat(kernel.in_bitmap(levels[k], signed(key), s.bitmap_bits), sizes)
            if not keep.any():
                return none
            text, at, stand, base = text[keep], at[keep], stand[keep], base[keep]
        steps = (stand - at) // width
        turn = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (stand[1:] != stand[:-1]) | (steps[1:] != steps[:-1])))
        sizes = np.diff(np.append(turn, len(at)))
        shared = stand[turn] - width * steps[turn]
        key = kernel.mix(base[turn] ^ kernel.mix(kernel.span_hashes(c.buf, shared, shared + s.length - width + 1) + steps[turn].astype(np.uint64)))
    return text[turn], at[turn], sizes, key, np.zeros(len(turn), bool)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def of_texts(column: pa.Array, flags: np.ndarray | None, bits: int) -> pa.Array:
    """The texts that a bitmap of their hashes knows; all without one."""
    if flags is None:
        return column
    names = [xxhash.xxh3_128_digest(x or b"") for x in column.cast(pa.binary()).to_pylist()]
    return column.filter(pa.array(kernel.in_bitmap(flags, np.array([int.from_bytes(x[:8], "big") for x in names], np.uint64).view(np.int64), bits)))


def lead(t: str):
    """The first eight bytes of a hash, as of_texts() reads them."""
    return F.conv(F.hex(F.substring(t, 1, 8)), 16, -10).cast("long")


def list_units(docs: DataFrame, s: Settings, text_col: str, levels: list[np.ndarray], texts: np.ndarray | None) -> DataFrame:
    """(t, at, n, m, d, twice) of units() of every text (that a bitmap knows) that a task sees for the first time."""

    def work(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for c in kernel.chunks(of_texts(batch.column(0), texts, s.bitmap_bits)):
                text, first, sizes, key, twice = units(c, s, levels)
                if not len(text):
                    continue
                names = [xxhash.xxh3_128_digest(c.buf[a:b].tobytes()) for a, b in zip(c.starts, c.ends)]
                fresh = np.zeros(len(c), bool)
                for k, name in enumerate(names):
                    fresh[k] = name not in seen
                    seen.add(name)
                keep = fresh[text]
                text, first, sizes, key, twice = text[keep], first[keep], sizes[keep], key[keep], twice[keep]
                raw = c.buf.tobytes()
                digest = [xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(first.tolist(), (first + sizes + s.length - 1).tolist())]
                columns = [
                    pa.array([names[k] for k in text.tolist()], pa.binary()),
                    pa.array((first - c.starts[text]).astype(np.int64)),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(signed(key)),
                    pa.array(digest, pa.int64()),
                    pa.array(twice),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "at", "n", "m", "d", "twice"])

    return docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(work, "t binary, at long, n long, m long, d long, twice boolean")


class Level:
    """Windows in the order of their bytes: places in the family's text, one for each distinct window."""

    def __init__(self, places: np.ndarray):
        self.places = places


class Family:
    """The levels of one task. text: all runs' bytes, as words to compare by; marks: windows that were met twice."""

    def __init__(self, length: int, capacity: int):
        self.length, self.used = length, 0
        self.text = np.zeros(capacity + 8, np.uint8)
        self.marks = np.zeros(capacity, bool)
        self.same = np.arange(capacity, dtype=np.int64)  # of each window, the equal one that stands in a level
        self.levels: list[Level] = []

    def word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place, as numbers that order like the bytes."""
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out = out << np.uint64(8) | self.text[at + k]
        return out

    def offsets(self) -> list[int]:
        # the last word overlaps the one before it, so that length needn't be a multiple of 8
        return [*range(0, self.length - 7, 8), *([self.length - 8] if self.length % 8 else [])]

    def suffix_array(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows in order, and for each whether it equals the one before it: groups of ties are refined by doubling."""
        lo, hi = int(windows.min()), int(windows.max()) + self.length
        at = np.arange(lo, hi)
        rank = np.unique(self.word(np.minimum(at, len(self.text) - 8)), return_inverse=True)[1].astype(np.int64)
        size = 8
        while size < self.length:
            step = min(size, self.length - size)
            ahead = np.append(rank[step:], np.full(step, -1))
            pair = rank * (len(at) + 1) + ahead + 1
            size += step
            if size == self.length:
                pair = pair[windows - lo]
                order = np.argsort(pair, kind="stable")
                return windows[order], np.append(False, pair[order][1:] == pair[order][:-1])
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        raise AssertionError

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for windows at a against windows at b; only ties look at further words."""
        out, open_ = np.zeros(len(a), np.int8), np.arange(len(a))
        for k in self.offsets():
            x, y = self.word(a[open_] + k), self.word(b[open_] + k)
            out[open_] = (x > y).astype(np.int8) - (x < y)
            open_ = open_[x == y]
            if not len(open_):
                break
        return out

    def scan(self, level: Level, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ordered windows, their places in the level's order and whether they equal what stands there."""
        heads = self.word(level.places)
        own = self.word(windows)
        lo, hi = np.searchsorted(heads, own, "left"), np.searchsorted(heads, own, "right")
        equal = np.zeros(len(windows), bool)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            sign = self.compare(windows[open_], level.places[mid])
            equal[open_[sign == 0]] = True
            lo[open_] = np.where(sign > 0, mid + 1, np.where(sign == 0, mid, lo[open_]))
            hi[open_] = np.where(sign > 0, hi[open_], mid)
            open_ = open_[(lo[open_] < hi[open_]) & ~equal[open_]]
        return lo, equal

    def add(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """Puts a batch of runs into the family; returns the place and number of windows of each."""
        spans, start = [], self.used
        for text in texts:
            self.text[self.used : self.used + len(text)] = np.frombuffer(text, np.uint8)
            spans.append((self.used, len(text) - self.length + 1))
            self.used += len(text)
        windows = np.concatenate([np.arange(a, a + n) for a, n in spans]) if spans else np.zeros(0, np.int64)
        if not len(windows):
            return spans
        order, tied = self.suffix_array(windows)
        leader = order[np.maximum.accumulate(np.where(tied, 0, np.arange(len(order))))]
        self.same[order] = leader
        self.marks[leader[tied]] = True
        distinct = order[~tied]
        for level in self.levels:
            place, equal = self.scan(level, distinct)
            held = level.places[place[equal]]
            self.marks[held] = True
            self.same[distinct[equal]] = held
            distinct = distinct[~equal]
        self.levels.append(Level(distinct))
        while len(self.levels) > 1 and len(self.levels[-1].places) * 2 >= len(self.levels[-2].places):
            b, a = self.levels.pop(), self.levels.pop()
            place, _ = self.scan(a, b.places)
            self.levels.append(Level(np.insert(a.places, place, b.places)))
        return spans

    def marked(self, at: int, n: int) -> np.ndarray:
        """Which windows of a run were met twice."""
        own = np.arange(at, at + n)
        while True:  # a leader may have been found equal to an older one
            up = self.same[own]
            if (up == own).all():
                return self.marks[own]
            own = up


def ranges_of(flags: np.ndarray) -> list[dict]:
    """Runs of true values as [a, b)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def index(frames, s: Settings):
    """One task: (m, d, raw) batches in, (m, d, ranges) of repeated windows out. Runs come ordered by key."""

    def closed(held: list[tuple[int, int, bytes]]):
        capacity = sum(len(raw) for _, _, raw in held)
        family, spans = Family(s.length, capacity), []
        batch, size = [], 0
        for _, _, raw in held:
            batch.append(raw)
            size += len(raw)
            if size >= s.batch_bytes:
                spans += family.add(batch)
                batch, size = [], 0
        spans += family.add(batch)
        found = [ranges_of(family.marked(a, n)) for a, n in spans]
        some = [k for k, f in enumerate(found) if f]
        columns = [pa.array([held[k][0] for k in some], pa.int64()), pa.array([held[k][1] for k in some], pa.int64()), pa.array([found[k] for k in some], RANGES)]
        return pa.RecordBatch.from_arrays(columns, names=["m", "d", "ranges"])

    held: list[tuple[int, int, bytes]] = []
    size, last, seen = 0, None, set()
    for batch in frames:
        for m, d, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if m != last:
                seen = set()
                if size >= s.task_bytes:  # a family may end between keys: windows of different keys are never equal
                    yield closed(held)
                    held, size = [], 0
                last = m
            if d not in seen:
                seen.add(d)
                held.append((m, d, raw))
                size += len(raw)
    if held:
        yield closed(held)


def repeated(docs: DataFrame, s: Settings, text_col: str) -> DataFrame:
    """(t, a, b): byte ranges of texts that windows cover which also start elsewhere; ranges may overlap."""
    levels, texts, parts = [], None, []
    while True:
        found, hot, texts = settled(docs, s, text_col, levels, texts)
        parts += found
        if hot is None:
            break
        levels = [*levels, hot]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def settled(docs: DataFrame, s: Settings, text_col: str, levels: list[np.ndarray], texts: np.ndarray | None) -> tuple[list[DataFrame], np.ndarray | None, np.ndarray | None]:
    """Frames of (t, a, b) from all units but those of hot keys, and bitmaps of these keys and of the texts that hold them, if there are any."""
    split = len(levels) < len(s.widths)
    listed = kernel.written(list_units(docs, s, text_col, levels, texts), "runs")
    keys = listed.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("twice").alias("twice"))
    keys = keys.where("c > 1 OR twice")
    hot = f"WHEN c > {s.hot} THEN 'hot'" if split else ""
    kind = F.expr(f"CASE WHEN lo = hi AND NOT twice THEN 'all' {hot} ELSE 'index' END")
    keys = kernel.written(keys.select("m", kind.alias("kind"), "c"), "keys")
    flags, bits = kernel.bitmap(keys, "m", s.bitmap_bits), s.bitmap_bits

    def known(batches):
        for batch in batches:
            yield batch.filter(pa.array(kernel.in_bitmap(flags, batch.column(3).to_numpy(), bits)))

    some = listed.drop("twice").mapInArrow(known, "t binary, at long, n long, m long, d long")
    some = kernel.written(some.join(keys.select("m", "kind"), "m"), "some-runs")
    kernel.discard(listed)
    sizes = {r["kind"]: r["c"] for r in keys.groupBy("kind").agg(F.sum("c").alias("c")).collect()}
    whole = some.where("kind = 'all'").select("t", F.col("at").alias("a"), (F.col("at") + F.col("n") + s.length - 1).alias("b"))
    parts = [whole]
    if sizes.get("index"):
        chosen = keys.where("kind = 'index'")
        raw = pieces(docs, chosen, s, text_col, levels, texts).join(chosen.select("m"), "m", "left_semi")
        tasks = int(max(2, -(-sizes["index"] * 2 * s.length // s.task_bytes)))
        dealt = raw.repartition(tasks, "m").sortWithinPartitions("m", "d")
        found = kernel.written(dealt.mapInArrow(lambda frames: index(frames, s), "m long, d long, ranges array<struct<a:long,b:long>>"), "indexed")
        # a run that stands twice repeats as a whole; the index sees it once
        twin = some.where("kind = 'index'").groupBy("m", "d").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m", "d")
        twins = some.where("kind = 'index'").join(twin, ["m", "d"])
        parts.append(twins.select("t", F.col("at").alias("a"), (F.col("at") + F.col("n") + s.length - 1).alias("b")))
        met = some.where("kind = 'index'").join(found, ["m", "d"]).select("t", "at", F.explode("ranges").alias("r"))
        parts.append(met.select("t", (F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b") + s.length - 1).alias("b")))
    if not sizes.get("hot"):
        return parts, None, None
    return parts, kernel.bitmap(keys.where("kind = 'hot'"), "m", bits), kernel.bitmap(some.where("kind = 'hot'").select(lead("t").alias("m")), "m", bits)


def pieces(docs: DataFrame, keys: DataFrame, s: Settings, text_col: str, levels: list[np.ndarray], texts: np.ndarray | None) -> DataFrame:
    """(m, d, raw): the bytes of units of keys (and of a few others: a bitmap decides), in texts that a bitmap knows."""
    flags, bits = kernel.bitmap(keys, "m", s.bitmap_bits), s.bitmap_bits

    def work(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for c in kernel.chunks(of_texts(batch.column(0), texts, s.bitmap_bits)):
                _, first, sizes, key, _ = units(c, s, levels)
                key = signed(key)
                keep = kernel.in_bitmap(flags, key, bits)
                if not keep.any():
                    continue
                out, raw = [], c.buf.tobytes()
                for m, a, b in zip(key[keep].tolist(), first[keep].tolist(), (first + sizes + s.length - 1)[keep].tolist()):
                    d = xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63)
                    if (m, d) not in seen:
                        seen.add((m, d))
                        out.append((m, d, raw[a:b]))
                m, d, own = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(d, pa.int64()), pa.array(own, pa.binary())], names=["m", "d", "raw"])

    return docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(work, "m long, d long, raw binary")


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of raw, bytes removed and maximal removed runs."""
    flags = np.zeros(len(raw) + 1, np.int32)
    for a, b in spans:
        flags[a] += 1
        flags[b] -= 1
    gone = np.cumsum(flags[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), len(ranges_of(gone))


def removed(docs: DataFrame, s: Settings = Settings(), id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""

    def name(texts):
        raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        return [pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw])]

    rows = kernel.written(kernel.by_batch(docs, id_col, text_col, name, "t binary, n_bytes long, sha string"), "texts")
    copies = rows.where(f"n_bytes >= {s.length}").groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.max("n_bytes").alias("n")).where("c > 1")
    gone = copies.select("t", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    gone = kernel.written(gone, "copies")
    found = repeated(docs, s, text_col).join(gone.select("t"), "t", "left_anti")
    # overlapping ranges of one text are joined before they meet its bytes
    spans = kernel.written(found.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    flags, bits = kernel.bitmap(spans.select(lead("t").alias("m")), "m", s.bitmap_bits), s.bitmap_bits

    def wanted(batches):
        seen: set[bytes] = set()
        for batch in batches:
            raw = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
            names = [xxhash.xxh3_128_digest(x) for x in raw]
            heads = np.array([int.from_bytes(x[:8], "big") for x in names], np.uint64).view(np.int64)
            keep = kernel.in_bitmap(flags, heads, bits)
            out = []
            for k in np.flatnonzero(keep):
                if names[k] not in seen:
                    seen.add(names[k])
                    out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in out], pa.binary()), pa.array([raw[k] for k in out], pa.binary())], names=["t", "raw"])

    texts = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(wanted, "t binary, raw binary")

    def work(batches):
        for batch in batches:
            t, raw, spans_ = (batch.column(k) for k in range(3))
            done = [cut(x, [(r["a"], r["b"]) for r in r_]) for x, r_ in zip(raw.to_pylist(), spans_.to_pylist(), strict=True)]
            columns = [t, pa.array([n for _, n, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _, _ in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "n_removed", "n_spans", "kept"])

    part = texts.join(spans, "t").select("t", "raw", "spans").mapInArrow(work, "t binary, n_removed long, n_spans long, kept string")
    part = kernel.written(part, "cut").dropDuplicates(["t"])
    out = rows.join(part.unionByName(gone), "t", "left")
    return out.select(
        id_col,
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )
