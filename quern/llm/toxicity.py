"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower-case runs of letters, digits and non-ASCII characters) are hashed
whole into two tables and by their first bytes (`Settings.stem`) into a third;
the three vectors add up, so that two words behave alike only if they collide
in both of the first, and inflections of one stem share the third. Filters of several widths run over a text's word
vectors, each keeps its maximum over the whole text, and a logistic layer reads
the maxima. Training is on the driver, on a bounded sample of labelled rows
(`Settings.sample`); scoring covers every word of every text.

Words and stems that stand in fewer than `Settings.known` fitted rows have the
zero vector: they can't be learned by heart, and words never seen add no noise.
In each pass a share of the words is left out at random for the same reason, and of all
passes the one that does best on rows kept back counts.

Thresholds are calibrated by language on all usable labelled rows but those that
were fitted on: the lowest score, in steps of 1 / `STEPS`, at which clean rows are
flagged at no more than `Settings.clean`. (fit() alone, which only knows its own
rows, takes those that were kept back.) Of rows that repeat an id the highest score counts.
They only decide `flagged`; the score never sees the language. A language with
too few clean rows, and a null one, take the threshold of all rows.

Null and empty texts have no words; every filter's maximum is then 0. A word
sequence shorter than a filter is padded with zero vectors; texts of any length
are scored whole. Equal texts have equal scores. Labels that are null, or that
differ for one id, teach nothing; of rows that repeat an id the smallest text
teaches. With one class only, every score is that class's share (0.5 with no
labels). An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernel
from quern.llm.quality import training_rows, usable


STEPS = 10_000  # of the scores that thresholds are looked for among: what is counted stays small


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    dim: int = 8
    filters: int = 8  # of each width
    widths: tuple[int, ...] = (1, 2, 3)
    stem: int = 4
    epochs: int = 8  # at least; small samples are passed over more often
    steps: int = 2400  # at least, while they read no more than `words` words
    words: int = 40_000_000
    batch: int = 24
    rate: float = 0.02
    decay: float = 1e-4
    known: int = 4  # fitted rows that a word or stem must stand in to have a vector
    drop: float = 0.3  # share of words left out of a fitted row, anew each time
    sample: int = 2000  # rows of each class that are fitted on, at most
    sample_chars: int = 24_000_000  # of their texts together, at most
    clean: float = 0.005
    least: int = 40  # clean rows that a language needs for a threshold of its own
    seed: int = 11


def word_buckets(c: kernel.Chunk, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Three rows of the table for each word, and each text's first word."""
    starts, ends, firsts = kernel.word_spans(c, kernel.PUNCTUATION)
    lower, size = kernel.LOWER[c.buf], 1 << s.bits
    whole = kernel.span_hashes(lower, starts, ends)
    stems = kernel.span_hashes(lower, starts, np.minimum(ends, starts + s.stem))
    top = np.uint64(64 - s.bits)
    rows = [whole >> top, (whole & np.uint64(size - 1)) + np.uint64(size), (stems >> top) + np.uint64(2 * size)]
    return np.stack(rows).astype(np.int32), firsts


@dataclass
class Model:
    settings: Settings
    bias: float
    table: np.ndarray | None = None  # of the three hashes, one below the other
    kernels: list[np.ndarray] = field(default_factory=list)  # (width, dim, filters) of each width
    shift: np.ndarray | None = None
    out: np.ndarray | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    fitted: list[int] = field(default_factory=list)  # places of the rows that were fitted on

    def maxima(self, rows: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and filter, the largest response and the word where it starts (-1: none above 0)."""
        s, n, texts = self.settings, rows.shape[1], len(firsts) - 1
        best = np.zeros((texts, s.filters * len(s.widths)), np.float32)
        where = np.full(best.shape, -1)
        some = np.flatnonzero(np.diff(firsts))
        if not len(some):
            return best, where
        vectors = self.table[rows].sum(0)
        rest = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)  # words up to the text's end
        for k, (width, filters) in enumerate(zip(s.widths, self.kernels, strict=True)):
            response = vectors @ filters[0]
            for j in range(1, width):
                ahead = vectors[j:] @ filters[j]
                ahead[rest[: n - j] <= j] = 0
                response[: n - j] += ahead
            own = slice(k * s.filters, (k + 1) * s.filters)
            response += self.shift[own]
            top = np.maximum.reduceat(response, firsts[:-1][some], axis=0)
            best[some, own] = np.maximum(top, 0)
            if self.tracing:
                for t, row in zip(some, top, strict=True):
                    at = response[firsts[t] : firsts[t + 1]].argmax(0) + firsts[t]
                    where[t, own] = np.where(row > 0, at, -1)
        return best, where

    tracing: bool = False

    def score(self, texts: pa.Array) -> np.ndarray:
        logits = np.full(len(texts), float(self.bias))
        if self.table is not None:
            for c in kernel.chunks(texts):
                best, _ = self.maxima(*word_buckets(c, self.settings))
                logits[c.first : c.first + len(c)] += best @ self.out
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def fit(texts: list[str | None], labels: list[int], s: Settings = Settings(), langs: list[str | None] | None = None, shift: float = 0.0) -> Model:
    """shift: log-odds from the shares of these rows to those of all, see quality.Sample."""
    y = np.asarray(labels, np.float32)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    if len(set(labels)) < 2:
        return Model(s, float(np.log(share / (1 - share))))
    rng, rows = np.random.default_rng(s.seed), []
    for c in kernel.list_chunks(texts):
        buckets, firsts = word_buckets(c, s)
        rows += [buckets[:, a:b] for a, b in zip(firsts, firsts[1:])]
    back = rng.random(len(rows)) < 0.15  # kept back for the thresholds
    used = np.flatnonzero(~back) if len(set(y[~back])) > 1 and langs is not None else np.arange(len(rows))
    # what stands in few rows says nothing of the class, and what stands in none was never fitted: no vector
    seen = np.zeros(3 << s.bits, np.int32)
    for i in used:
        seen[np.unique(rows[i])] += 1
    alive = np.flatnonzero(seen >= s.known)
    place = np.zeros(3 << s.bits, np.int32)  # in the table that is fitted, whose row 0 stays 0
    place[alive] = np.arange(1, len(alive) + 1)
    rows = [place[r] for r in rows]
    total = s.filters * len(s.widths)
    m = Model(s, 0.0, rng.normal(0, 0.1, (len(alive) + 1, s.dim)).astype(np.float32), tracing=True)
    m.table[0] = 0
    m.kernels = [rng.normal(0, 1 / np.sqrt(s.dim), (w, s.dim, s.filters)).astype(np.float32) for w in s.widths]
    m.shift, m.out = np.zeros(total, np.float32), rng.normal(0, 0.3, total).astype(np.float32)
    m.out[::2], m.out[1::2] = abs(m.out[::2]), -abs(m.out[1::2])
    bias, tables = np.array([np.log(share / (1 - share))], np.float32), [m.table, *m.kernels, m.shift, m.out]
    tables.append(bias)
    first, second, steps = [np.zeros_like(p) for p in tables], [np.zeros_like(p) for p in tables], 0
    checked = (np.concatenate([rows[i] for i in np.flatnonzero(back)], axis=1), np.append(0, np.cumsum([rows[i].shape[1] for i in np.flatnonzero(back)]))) if back.any() else None
    least, kept = np.inf, None
    # more passes over a small sample, but not over long texts again and again
    most = min(200, s.words // max(sum(rows[i].shape[1] for i in used), 1))
    epochs = max(s.epochs, min(-(-s.steps * s.batch // max(len(used), 1)), most))
    for epoch in range(epochs):
        order = rng.permutation(used)
        for at in range(0, len(order), s.batch):
            own = order[at : at + s.batch]
            left = [rows[i][:, rng.random(rows[i].shape[1]) >= s.drop] for i in own]
            words = np.concatenate(left, axis=1)
            firsts = np.append(0, np.cumsum([r.shape[1] for r in left]))
            best, where = m.maxima(words, firsts)
            error = (1 / (1 + np.exp(-(best @ m.out + bias[0]))) - y[own]) / len(own)
            grads = [np.zeros_like(p) for p in tables]
            grads[-1][0], grads[-2][:] = error.sum(), best.T @ error
            t, f = np.nonzero(where >= 0)
            g, at_word, end = error[t] * m.out[f], where[t, f], firsts[t + 1]
            np.add.at(grads[-3], f, g)
            for k, width in enumerate(s.widths):
                mine = f // s.filters == k
                for j in range(width):
                    ok = mine & (at_word + j < end)
                    w, fk = at_word[ok] + j, f[ok] % s.filters
                    np.add.at(grads[1 + k][j].T, fk, g[ok, None] * m.table[words[:, w]].sum(0))
                    back_to = g[ok, None] * m.kernels[k][j].T[fk]
                    for table_rows in words[:, w]:
                        np.add.at(grads[0], table_rows, back_to)
            steps += 1
            rate = s.rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for p, m1, m2, g in zip(tables, first, second, grads, strict=True):
                if p is m.table:  # only the rows that had a gradient move
                    hit = np.flatnonzero(g.any(1))
                    hit = hit[hit > 0]
                    m1[hit] = 0.9 * m1[hit] + 0.1 * g[hit]
                    m2[hit] = 0.999 * m2[hit] + 0.001 * g[hit] ** 2
                    p[hit] -= rate * m1[hit] / (np.sqrt(m2[hit]) + 1e-8)
                else:
                    m1 *= 0.9
                    m1 += 0.1 * g
                    m2 *= 0.999
                    m2 += 0.001 * g * g
                    p -= rate * (m1 / (np.sqrt(m2) + 1e-8) + s.decay * p)
        # the state that does best on the rows kept back is the one that stays
        if checked is not None and len(used) < len(rows):
            m.tracing = False
            best, _ = m.maxima(*checked)
            m.tracing = True
            logits = best @ m.out + bias[0]
            loss = float(np.logaddexp(0, np.where(y[back] > 0, -logits, logits)).mean())
            if loss < least:
                least, kept = loss, [p.copy() for p in tables]
    if kept is not None:
        for p, q in zip(tables, kept, strict=True):
            p[:] = q
    m.bias, m.tracing = float(bias[0]) + shift, False
    whole = np.zeros((3 << s.bits, s.dim), np.float32)
    whole[alive] = m.table[1:]
    m.table = whole
    m.fitted = [int(i) for i in used]
    if langs is not None:
        kept = [i for i in np.flatnonzero(back)] or [*used]
        calibrate(m, m.score(pa.array([texts[i] for i in kept], pa.string())), y[kept], [langs[i] for i in kept])
    return m


def calibrate(m: Model, scores: np.ndarray, y: np.ndarray, langs: list[str | None]) -> None:
    """Sets the thresholds: no lower than 0.2, no higher than 0.8."""

    def lowest(clean: np.ndarray) -> float:
        return float(np.clip(np.quantile(clean, 1 - m.settings.clean) + 1e-6, 0.2, 0.8))

    m.threshold = lowest(scores[y == 0]) if (y == 0).any() else 0.5
    for lang in sorted({x for x in langs if x is not None}):
        own = scores[(y == 0) & np.array([x == lang for x in langs])]
        if len(own) >= m.settings.least:
            m.thresholds[lang] = lowest(own)


def calibrate_all(m: Model, docs: DataFrame, labels: DataFrame, fitted: list, id_col: str, text_col: str, lang_col: str) -> None:
    """Sets the thresholds by all clean rows that may be learned from and weren't fitted on; without such rows they stay."""
    spark = docs.sparkSession
    clean = usable(labels, "toxic", id_col).where("_y = 0").select("_id")
    used = spark.createDataFrame([(i,) for i in fitted], clean.schema)  # 2 * Settings.sample ids at most
    clean = clean.join(F.broadcast(used), "_id", "left_anti")
    keyed = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    scored = score(keyed, m, "key", "text").select(F.col("key.id").alias("_id"), F.col("key.lang").alias("lang"), "score")
    rows = scored.join(clean, "_id").groupBy("_id").agg(F.min("lang").alias("lang"), F.max("score").alias("score"))
    # beyond the bounds of a threshold only the number of rows matters
    step = F.ceil(F.greatest(F.lit(0.2), F.least(F.lit(0.8), F.col("score"))) * STEPS)
    rows = kernel.written(rows.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n")), "scores")
    lowest = (F.expr(f"percentile(step, {1 - m.settings.clean}D, n)") / STEPS + 1e-6).alias("lowest")
    of_all = rows.agg(lowest).first()[0]
    if of_all is not None:
        m.threshold = float(np.clip(of_all, 0.2, 0.8))
        found = rows.where("lang IS NOT NULL").groupBy("lang").agg(lowest, F.sum("n").alias("n")).where(F.col("n") >= m.settings.least)
        m.thresholds = {r["lang"]: float(np.clip(r["lowest"], 0.2, 0.8)) for r in found.orderBy("lang").collect()}
    kernel.discard(rows)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col="doc_id", text_col="text", lang_col: str | None = "lang") -> Model:
    sample = training_rows(docs, labels, "toxic", s, id_col, text_col, lang_col)
    model = fit(sample.texts, sample.labels, s, sample.langs if lang_col is not None else None, sample.shift)
    fitted, model.fitted = [sample.ids[i] for i in model.fitted], []
    del sample
    if lang_col is not None and model.table is not None:
        calibrate_all(model, docs, labels, fitted, id_col, text_col, lang_col)
    kernel.release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) for each row."""
    return kernel.by_batch(docs, id_col, text_col, lambda texts: [pa.array(model.score(texts))], "score double")


def threshold_column(model: Model, lang):
    """The threshold of a language, as a column."""
    out = F.lit(model.threshold)
    for known, value in model.thresholds.items():
        out = F.when(lang == known, F.lit(value)).otherwise(out)
    return out


def flagged(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """(id, score, flagged): flagged at the threshold of the row's language, which the score doesn't see."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).alias("key"), F.col(text_col).alias("text"))
    scored = score(keyed, model, "key", "text")
    return scored.select(F.col("key.id").alias(id_col), "score", (F.col("score") >= threshold_column(model, F.col("key.lang"))).alias("flagged"))
