"""Vectorised byte kernels shared by the text operators.

Texts arrive as Arrow string arrays. They are joined, one space after each,
into byte chunks of a bounded size (a text is never cut: a longer one is a
chunk of its own), and all hashing is array arithmetic on that buffer.
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20  # of an Arrow batch, about
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are no part of a word of ASCII letters, digits and non-ASCII characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[0x30:0x3A] = PUNCTUATION[0x41:0x5B] = PUNCTUATION[0x61:0x7B] = PUNCTUATION[0x80:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = {MULTIPLIER: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    known = _powers[base]
    while len(known) < n:
        factor = np.uint64(pow(base, len(known), 1 << 64))
        known = np.concatenate([known, known * factor])
    _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Some consecutive texts of a batch: buf, and text i at buf[starts[i]:ends[i]]."""

    def __init__(self, first: int, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.first, self.buf, self.starts, self.ends = first, buf, starts, ends

    def __len__(self) -> int:
        return len(self.starts)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Null texts are empty. Each text is followed by one space."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, len(texts))
        own = offsets[i : j + 1] - offsets[i]
        buf = np.insert(data[offsets[i] : offsets[j]], own[1:], 32)
        shift = np.arange(j - i)
        yield Chunk(i, buf, own[:-1] + shift, own[1:] + shift)
        i = j


def list_chunks(texts: list[str | None], rows: int = 256) -> Iterator[Chunk]:
    """chunks() of a list, a part of it at a time: no second copy of all texts is made."""
    for at in range(0, len(texts), rows):
        for c in chunks(pa.array(texts[at : at + rows], pa.string())):
            c.first += at
            yield c


def word_spans(chunk: Chunk, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word as an offset into them (one more than texts)."""
    inner = np.zeros(len(chunk.buf) + 1, bool)
    inner[1:] = ~separators[chunk.buf]
    turns = np.flatnonzero(inner[1:] != inner[:-1])
    starts, ends = turns[::2], turns[1::2]
    return starts, ends, np.append(np.searchsorted(starts, chunk.starts), len(starts))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end], by differences of one prefix sum."""
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, len(buf)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(buf) + 1)[starts])


def gram_hashes(buf: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket under 2**bits for every n consecutive bytes."""
    if len(buf) < n:
        return np.zeros(0, np.uint32)
    size, key = len(buf) - n + 1, np.zeros(len(buf) - n + 1, np.uint32)
    for k in range(n):
        key *= np.uint32(0x01000193)
        key += buf[k : k + size]
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D + 2 * n)
    return key >> np.uint32(32 - bits)


def characters(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each character (its UTF-8 bytes), and each text's start and end among them."""
    buf = chunk.buf
    tail = (buf & 0xC0) == 0x80
    if not tail.any():
        return buf, chunk.starts, chunk.ends
    lead = np.flatnonzero(~tail)
    codes = buf[lead].astype(np.uint32)
    size = np.diff(np.append(lead, len(buf)))
    for k in range(1, 4):
        own = np.flatnonzero(size > k)
        codes[own] = codes[own] << np.uint32(8) | buf[lead[own] + k]
    return codes, np.searchsorted(lead, chunk.starts), np.searchsorted(lead, chunk.ends)


def by_batch(
    df: DataFrame,
    id_col: str,
    text_col: str,
    each: Callable[[pa.Array], list],
    schema: str,
) -> DataFrame:
    """each(texts) gives the columns after the id, for each Arrow batch; other columns of df are ignored."""
    bounded(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    kept = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *each(batch.column(1))], names=names)

    names = [id_col, *StructType.fromDDL(schema).names]
    return kept.mapInArrow(work, f"`{id_col}` {id_type}, {schema}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Only where driver and executors are one process, as in tests, it may be unset: then /tmp/checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well, unless the session has a bound of its own: long texts make small batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    bounded(spark)
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what written() wrote for frames that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves that remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """Whether a bucket of the column's top bits holds a value: 2**bits flags, whatever the number of rows."""
    bucket = F.shiftrightunsigned(column, 64 - bits)
    words = values.select(bucket.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("flags"))
    found = words.toArrow()  # as arrays: rows would be Python objects, up to half a million of them
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["w"].to_numpy().astype(np.int64)] = found["flags"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(flags: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    bucket = values.view(np.uint64) >> np.uint64(64 - bits)
    return flags[(bucket >> np.uint64(6)).astype(np.int64)] >> (bucket & np.uint64(63)) & np.uint64(1) == 1


def in_order(df: DataFrame, order: list[str], name: str, place: str = "_nth") -> DataFrame:
    """df, written, with each row's place from 0 in the order of the columns: sorted ranges, then the sizes of the ranges before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one number a partition
    before, total = [], 0
    for row in sorted(sizes):
        before.append((row["_part"], total))
        total += row["n"]
    known = df.sparkSession.createDataFrame(pa.table({"_part": pa.array([b[0] for b in before], pa.int64()), "_before": pa.array([b[1] for b in before], pa.int64())}))
    out = ranged.withColumn("_part", part).join(F.broadcast(known), "_part")  # one row a partition
    return out.withColumn(place, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def first_rows(rows: DataFrame, chars: int) -> tuple[list, list]:
    """Of written rows (_rank, _id, _n, ...) the first by rank that hold at most `chars` characters (_n) together; and (_rank, _id, _n) of all."""
    sizes = sorted(tuple(r) for r in rows.select("_rank", "_id", "_n").collect())
    fits = int(np.searchsorted(np.cumsum([r[2] for r in sizes]), chars, "right")) if sizes else 0
    taken = {r[1] for r in sizes[:fits]}
    held = rows if fits == len(sizes) else rows.where(F.col("_rank") <= sizes[fits - 1][0] if fits else F.lit(False))
    return sorted((r for r in held.collect() if r["_id"] in taken), key=lambda r: r["_id"]), sizes


def trim_jvm(spark: SparkSession) -> str | None:
    """jcmd's System.trim_native_heap, of the driver's JVM itself; None where a JVM or C library has no such command."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName

    def of(kind, *values):
        out = array(kind, len(values))
        for k, value in enumerate(values):
            out[k] = value
        return out

    try:
        types = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        # the server's own class isn't public: the interface's method is called
        invoke = named("javax.management.MBeanServer").getMethod("invoke", of(jvm.java.lang.Class, *types))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(server, of(jvm.Object, command, "systemTrimNativeHeap", of(jvm.Object, of(jvm.String)), of(jvm.String, "[Ljava.lang.String;")))
    except Py4JError:
        return None


def release(spark: SparkSession) -> None:
    """Gives back what the driver holds unused, before and after a fit and between long steps.

    Its JVM's heap shrinks by a full collection; what its hundreds of threads freed outside the heap, and Python's, by a trim.
    """
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library has no such call, and gives memory back by itself


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until no column of df has the name, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(docs: DataFrame, row: str = "_row", name: str = "numbered") -> DataFrame:
    """docs, written with a number for each row, in column `row`, that later reads agree on."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name)


def without(rows: DataFrame, dropped: DataFrame, bits: int = 24, row: str = "_row") -> DataFrame:
    """numbered() rows less those whose number is in dropped. Rows that a bitmap clears stay where they are; only the others are joined."""
    bounded(rows.sparkSession)
    flags = bitmap(dropped.select(F.xxhash64(row).alias("m")), "m", bits)

    @F.arrow_udf("boolean")
    def marked(values: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(flags, values.to_numpy(), bits))

    hit = marked(F.xxhash64(row))
    return rows.where(~hit).unionByName(rows.where(hit).join(dropped.select(row), row, "left_anti"))
