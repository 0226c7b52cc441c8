"""Quality classifier: supervised subword embeddings.

Words and character n-grams (of code points) are hashed into one table of learned vectors; a
document is the mean of its vectors, and a softmax over two classes reads it.
The families (words, pairs of adjacent words, character n-grams of each length) are
averaged one by one first, so that the long lists of n-grams don't drown words.
All is trained together by numpy stochastic gradient descent on the driver,
from a bounded sample of labelled rows (`Settings.sample` rows of each class and
`Settings.sample_chars` characters, the first by a hash of the id).

Once trained, the mean and the output layer are both linear, so the table
folds to one number a bucket and a text is scored by gathers and one sum.

Null and empty texts have no features; they get the score of the bias alone.
Texts of any length are scored whole, and equal texts have equal scores. Labels
that are null, or that differ for one id, teach nothing; of rows that repeat an
id the smallest text teaches. With no labelled rows, or only one class, every
score is that class's share (0.5 with none). An empty table gives no rows. keep()
hands on all columns, whatever their names; score() ignores all but two.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernel


WEIGHTS = 4096  # small weights of long texts so stay within half precision


@dataclass(frozen=True)
class Settings:
    bits: int = 15
    grams: tuple[int, ...] = (2, 4)
    dim: int = 12
    epochs: int = 8
    batch: int = 64
    rate: float = 0.05
    sample: int = 3000  # rows of each class that are fitted on, at most
    sample_chars: int = 24_000_000  # of their texts together, at most
    seed: int = 7


def features(chunk: kernel.Chunk, s: Settings):
    """Yields, for each family of features, buckets and each text's first feature as an offset."""
    starts, ends, firsts = kernel.word_spans(chunk, kernel.WHITE)
    words = kernel.span_hashes(chunk.buf, starts, ends)
    top = np.uint64(64 - s.bits)
    yield (words >> top).astype(np.uint32), firsts
    # a pair is keyed by a difference: any word that follows itself has the same key
    pairs = kernel.mix(words[1:] - words[:-1]) >> top
    inside = np.ones(len(words), bool)
    inside[firsts[:-1][np.diff(firsts) > 0]] = False
    yield pairs[inside[1:]].astype(np.uint32), np.append(0, np.cumsum(np.maximum(np.diff(firsts) - 1, 0)))
    codes, begin, end = kernel.characters(chunk)
    for n in s.grams:
        # grams run over the space after a text, and a gram that would run into the next text is cut off
        buckets = kernel.gram_hashes(codes, n, s.bits)
        own = np.maximum(end - begin - n + 2, 0)
        keep = np.zeros(len(buckets) + 1, np.int8)
        np.add.at(keep, begin[own > 0], 1)
        np.add.at(keep, (begin + own)[own > 0], -1)
        yield buckets[np.cumsum(keep[:-1]).astype(bool)], np.append(0, np.cumsum(own))


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[i]:firsts[i+1]]; 0 for an empty run."""
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return total[firsts[1:]] - total[firsts[:-1]]


@dataclass
class Model:
    settings: Settings
    weight: np.ndarray  # the log-odds that one feature of a bucket adds
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for c in kernel.chunks(texts):
            total, families = np.zeros(len(c)), 0
            for buckets, firsts in features(c, self.settings):
                total += sums(self.weight[buckets], firsts) / np.maximum(np.diff(firsts), 1)
                families += 1
            out[c.first : c.first + len(c)] = total / families + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def histograms(texts: list[str | None], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its buckets and their weights in the mean, times WEIGHTS: four bytes a feature, as thousands of texts are held."""
    rows = []
    for c in kernel.list_chunks(texts):
        families = [*features(c, s)]
        for i in range(len(c)):
            own = [b[f[i] : f[i + 1]] for b, f in families]
            weights = np.concatenate([np.full(len(b), 1 / (len(b) or 1) / len(own)) for b in own])
            buckets, place = np.unique(np.concatenate(own), return_inverse=True)
            rows.append((buckets.astype(np.uint16 if s.bits <= 16 else np.uint32), (np.bincount(place, weights, len(buckets)) * WEIGHTS).astype(np.float16)))
    return rows


def fit(texts: list[str | None], labels: list[int], s: Settings = Settings(), shift: float = 0.0) -> Model:
    """shift: log-odds from the shares of these rows to those of all, see Sample."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Model(s, np.zeros(1 << s.bits, np.float32), float(np.log(share / (1 - share))))
    rng, rows, size = np.random.default_rng(s.seed), histograms(texts, s), 1 << s.bits
    # vectors are scaled up so that a mean over thousands of features still moves the output
    table = rng.normal(0, 1, (size, s.dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (s.dim, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    moment = [np.full_like(p, 1e-8) for p in (table, out, bias)]
    x = np.zeros((s.batch, size), np.float32)
    for epoch in range(s.epochs):
        order = rng.permutation(len(rows))
        step = s.rate * (1 - epoch / s.epochs)
        for at in range(0, len(order), s.batch):
            own = order[at : at + s.batch]
            for k, i in enumerate(own):
                x[k, rows[i][0]] = rows[i][1].astype(np.float32) / WEIGHTS
            mean = x[: len(own)] @ table
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            grads = (x[: len(own)].T @ (p @ out.T), mean.T @ p, p.sum(0))
            for value, m, g in zip((table, out, bias), moment, grads, strict=True):
                m += g * g  # steps by each weight's own history of gradients
                value -= step * 4 * g / np.sqrt(m)
            for k, i in enumerate(own):
                x[k, rows[i][0]] = 0
    fold = table @ (out[:, 1] - out[:, 0])
    return Model(s, fold.astype(np.float32), float(bias[1] - bias[0]) + shift)


@dataclass
class Sample:
    """Rows to fit on, by id, and the log-odds that take their class shares to those of all labels."""

    texts: list[str | None]
    labels: list[int]
    langs: list[str | None]
    shift: float = 0.0
    ids: list = field(default_factory=list)


def usable(labels: DataFrame, label_col: str, id_col="doc_id") -> DataFrame:
    """(_id, _y) of the labels that aren't held out and don't contradict each other."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~kernel.held_out("_id", 5, 0))
    return known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_max")).where("_y = _max").select("_id", "_y")


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, s, id_col="doc_id", text_col="text", lang_col: str | None = None) -> Sample:
    """At most s.sample rows of each class and s.sample_chars characters in all, chosen by a hash of the id, of those that aren't held out."""
    known = kernel.written(usable(labels, label_col, id_col).withColumn("_rank", F.xxhash64("_id", F.lit(s.seed))), "labels")
    total = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    first = [known.where(F.col("_y") == y).orderBy("_rank", "_id").limit(s.sample) for y in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # 2 * s.sample rows at most
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), lang.alias("_lang"))
    rows = texts.join(chosen, "_id").groupBy("_id", "_y", "_rank").agg(F.min("_text").alias("_text"), F.min("_lang").alias("_lang"))
    rows = kernel.written(rows.withColumn("_n", F.coalesce(F.length("_text"), F.lit(0))), "sample")
    found, _ = kernel.first_rows(rows, s.sample_chars)
    met = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    kernel.discard(known, rows)
    kernel.release(docs.sparkSession)
    # shares: all labels of a class for each one that was looked for, those found for each one that fits
    shift = 0.0
    for y, sign in ((1, 1), (0, -1)):
        kept = sum(r["_y"] == y for r in found)
        if kept:
            shift += sign * float(np.log(total[y] / min(total[y], s.sample)) + np.log(met[y] / kept))
    return Sample([r["_text"] for r in found], [r["_y"] for r in found], [r["_lang"] for r in found], shift, [r["_id"] for r in found])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label_col="quality", id_col="doc_id", text_col="text") -> Model:
    sample = training_rows(docs, labels, label_col, s, id_col, text_col)
    model = fit(sample.texts, sample.labels, s, sample.shift)
    del sample
    kernel.release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) for each row."""
    return kernel.by_batch(docs, id_col, text_col, lambda texts: [pa.array(model.score(texts))], "score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text_col="text") -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns: texts go to Python, rows stay in the JVM."""
    kernel.bounded(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts))

    return docs.where(scored(F.col(f"`{text_col}`").cast("string")) >= threshold)
