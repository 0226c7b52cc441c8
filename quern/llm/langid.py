"""Language identification by error-correcting output codes.

Each language gets a codeword; for every bit a binary classifier over hashed
byte n-grams of letters learns on which side of the bit a text's language
falls. A text gets the language whose codeword is nearest by the sum of the
bits' logistic losses, each weighted by how well its bit did on rows kept back.

Up to seven languages use the exhaustive code (every split of the set, so any
two codewords differ in 2**(K-2) bits); more use balanced pseudo-random bits,
`Settings.redundancy` for each doubling of their number.

Every language is learned, from a bounded sample of its rows, the first by a hash
of their ids (`Settings.sample`, `rows`, `sample_chars`); every text is scored
whole, however long. A null text, and one without a letter, is `und` with score 0
and is ambiguous. With one language learned every other text gets it, with score
1; with none, as from an empty table, everything is `und`. Of rows that repeat an
id the smallest language and text teach. Of codewords at one distance the first
language by name wins. An empty table gives no rows. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import kernel

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 14
    grams: tuple[int, ...] = (2, 3)
    epochs: int = 6
    batch: int = 64
    rate: float = 0.5
    sample: int = 800  # rows of each language that are fitted on, at most
    rows: int = 24_000  # of all languages: with more than 30, each has as many fewer
    sample_chars: int = 48_000_000  # of their texts together, at most
    redundancy: int = 8
    margin: float = 0.1  # a decision by less is ambiguous
    seed: int = 5


def codewords(k: int, s: Settings) -> np.ndarray:
    """(languages, bits) of -1 and 1; columns are distinct splits."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 7:
        splits = np.arange(1, 1 << (k - 1))  # language 0 is always on one side
        code = np.stack([np.zeros(len(splits), int), *((splits >> i) & 1 for i in range(k - 1))])
        return (2 * code - 1).astype(np.float32)
    rng, n = np.random.default_rng(s.seed), s.redundancy * int(np.ceil(np.log2(k)))
    return np.stack([rng.permutation(np.where(np.arange(k) % 2, 1, -1)) for _ in range(n)], axis=1).astype(np.float32)


LETTERS = kernel.LOWER.copy()
LETTERS[kernel.PUNCTUATION] = 32
LETTERS[0x30:0x3A] = 32


def shares(chunk: kernel.Chunk, s: Settings) -> np.ndarray:
    """(texts, buckets): the square roots of the n-grams' shares, of unit length."""
    buf, size, n = LETTERS[chunk.buf], 1 << s.bits, len(chunk)
    # upper-case letters of the two-byte range after 0xC3 fold by the same distance as ASCII ones
    upper = (chunk.buf[1:] >= 0x80) & (chunk.buf[1:] <= 0x9E) & (chunk.buf[:-1] == 0xC3)
    buf[1:][upper] += 0x20
    owner = np.repeat(np.arange(n), chunk.ends - chunk.starts + 1)
    out = np.zeros(n * size, np.float32)
    for g in s.grams:
        buckets = kernel.gram_hashes(buf, g, s.bits)
        own = owner[: len(buckets)]
        keep = (own == owner[g - 1 :]) & ((buf[: len(buckets)] != 32) | (buf[1 : len(buckets) + 1] != 32))
        out += np.bincount(own[keep] * size + buckets[keep], minlength=n * size)
    out = np.sqrt(out.reshape(n, size))
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


#: Texts whose histograms are held at once.
ROWS = 128


def blocks(texts: pa.Array, s: Settings):
    """(first text, shares) of at most ROWS texts and about a chunk of bytes."""
    for at in range(0, len(texts), ROWS):
        for c in kernel.chunks(texts.slice(at, ROWS)):
            yield at + c.first, shares(c, s)


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray | None = None  # (buckets, bits)
    bias: np.ndarray | None = None
    trust: np.ndarray | None = None  # of each bit, summing to 1

    def outputs(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), self.code.shape[1]), np.float32)
        for at, x in blocks(texts, self.settings):
            out[at : at + len(x)] = x @ self.weight + self.bias
        return out

    def decode(self, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, score and margin: losses are summed for every codeword, and turned into shares."""
        loss = np.logaddexp(0, -np.clip(outputs[:, None, :] * self.code[None], -30, 30)) @ self.trust
        p = np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        second = np.partition(p, -2, axis=1)[:, -2]
        return best, p[np.arange(len(p)), best], p.max(1) - second

    def predict(self, texts: pa.Array) -> list[pa.Array]:
        """lang_pred, score, ambiguous."""
        n = len(texts)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
        if self.weight is None:
            best, p, margin = np.zeros(n, int), np.ones(n), np.ones(n)
        elif n:
            best, p, margin = self.decode(self.outputs(texts))
        else:
            best, p, margin = np.zeros(0, int), np.zeros(0), np.zeros(0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        p = np.where(lettered, p, 0.0).astype(np.float64)
        return [pa.array(names, pa.string()), pa.array(p), pa.array(~lettered | (margin < self.settings.margin))]


def fit(texts: list[str], langs: list[str], s: Settings = Settings()) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names), s)
    m = Model(s, names, code)
    if len(names) < 2:
        return m
    rng, array = np.random.default_rng(s.seed), pa.array(texts, pa.string())
    target = code[[names.index(x) for x in langs]]
    back = rng.random(len(texts)) < 0.2
    if back.all() or not back.any():
        back = np.arange(len(texts)) % 5 == 0
    m.weight, m.bias = np.zeros((1 << s.bits, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    order = rng.permutation(np.flatnonzero(~back))
    held = [array.take(pa.array(order[at : at + s.batch])) for at in range(0, len(order), s.batch)]
    sparse = []  # of each batch; a dense one is 4 MB
    for batch in held:
        for _, x in [(0, np.concatenate([x for _, x in blocks(batch, s)]))]:
            row, col = np.nonzero(x)
            sparse.append((x.shape, row.astype(np.int16), col.astype(np.int32), x[row, col]))
    for epoch in range(s.epochs):
        for k in rng.permutation(len(sparse)):
            shape, row, col, value = sparse[k]
            x = np.zeros(shape, np.float32)
            x[row, col] = value
            y = target[order[k * s.batch : (k + 1) * s.batch]]
            # d/df log(1 + exp(-y f)); steps are large as rows have unit length
            g = -y / (1 + np.exp(np.clip(y * (x @ m.weight + m.bias), -30, 30))) / len(y)
            step = s.rate * 60 * (1 - epoch / s.epochs)
            m.weight -= step * (x.T @ g + 1e-6 * m.weight)
            m.bias -= step * 0.05 * g.sum(0)
    check = np.flatnonzero(back)
    right = (np.sign(m.outputs(array.take(pa.array(check)))) == target[check]).mean(0)
    m.trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    m.trust = (m.trust / m.trust.sum()).astype(np.float32)
    return m


def train(docs: DataFrame, s: Settings = Settings(), id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """From rows with a text, a language and an id whose crc32 modulo 4 isn't 2."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.where(F.col("_lang").isNotNull() & ~kernel.held_out("_id", 4, 2) & F.col("_text").rlike(r"\p{L}"))
    counts = kernel.written(rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_count")), "languages")
    most = max(1, min(s.sample, s.rows // max(counts.count(), 1)))
    # a hash under a bound that about `most` rows of the language keep, with room for chance; then the first of those
    rank = F.xxhash64("_id", F.lit(s.seed))
    room = most + 6 * most**0.5 + 10
    part = F.shiftrightunsigned("_rank", 11) / F.lit(float(1 << 53))
    near = rows.select("_id", "_lang").withColumn("_rank", rank).join(counts, "_lang").where(part * F.col("_count") <= room)
    order = Window.partitionBy("_lang").orderBy("_rank", "_id")
    chosen = near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)
    chosen = F.broadcast(chosen.select("_id", "_rank").distinct())  # s.rows rows, or one for each language, at most
    held = rows.join(chosen, "_id").groupBy("_id", "_rank").agg(F.min(F.struct("_lang", "_text")).alias("_r"))
    held = kernel.written(held.select("_id", "_rank", "_r.*", F.length("_r._text").alias("_n")), "sample")
    found, _ = kernel.first_rows(held, s.sample_chars)
    kernel.discard(counts, held)
    kernel.release(docs.sparkSession)
    model = fit([r["_text"] for r in found], [r["_lang"] for r in found], s)
    del found
    kernel.release(docs.sparkSession)
    return model


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for each row."""
    return kernel.by_batch(docs, id_col, text_col, model.predict, "lang_pred string, score double, ambiguous boolean")
