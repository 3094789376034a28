"""Helpers shared by the operators of this folder: written intermediate tables, connected components, byte-level hashing."""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedwise.sources.work import shared_dir, ship_package


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch: whole texts and shingle sets travel in them, and a batch of Spark's 10,000 can exceed a worker's memory.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as --py-files would; needed where it is not installed.

    Also bounds the rows of an Arrow batch, unless the session has its own number.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def give_back() -> None:
    """Memory that this worker has freed goes back to the system: Spark keeps workers for later tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends here, and lost executors take nothing with them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table made by ``cut`` that nothing reads any more."""
    jvm, root = spark.sparkContext._jvm, shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of longs: ``(id, comp)``, comp the smallest id reachable.

    Alternating large-star and small-star steps, each a grouped minimum (combined before the shuffle) and
    one join. A step never makes more edges than it gets. Ids without an edge are absent from the result.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        nxt = cut(small.where("a <> b").distinct(), "edges")
        drop_table(spark, large)
        drop_table(spark, e)
        e = nxt
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("comp"))).distinct()


def bloom_bits(count: int, most: int) -> int:
    """A power of two of at least 16 bits for each of ``count`` values (about 1 in 70 others passes), at most ``most``."""
    return min(most, max(1 << 16, 1 << (16 * max(1, count) - 1).bit_length()))


def bloom(frame: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes: a bitmap of ``bits`` bits, two set for each value.

    It is made in groups of 64 bits, so what reaches the driver is at most bits / 8 bytes and as many for cell numbers.
    """
    shift = bits.bit_length() - 1
    places = frame.select(F.explode(F.array(F.expr(f"`{column}` & {bits - 1}L"), F.expr(f"shiftrightunsigned(`{column}`, {shift}) & {bits - 1}L"))).alias("p"))
    cells = places.groupBy(F.shiftright("p", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v"))
    table = cells.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table["cell"].to_numpy()] = table["v"].to_numpy().view(np.uint64)
    return out


def in_bloom(filter_bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter; those that are in it always may."""
    bits = len(filter_bits) * 64
    mask, shift = np.uint64(bits - 1), np.uint64(bits.bit_length() - 1)
    found = np.ones(len(values), bool)
    for p in (values & mask, (values >> shift) & mask):
        found &= ((filter_bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


# --- bytes and words in numpy -------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base & MASK, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums H so that the hash of buf[s:e] is (H[e] - H[s]) * INVERSE ** s."""
    h = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[buf] * powers(BASE, len(buf)), out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes in any buffer."""
    return mix((h[ends] - h[starts]) * powers(INVERSE, len(h))[starts] + (ends - starts).astype(np.uint64))


def word_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


def byte_chunks(column: pa.Array, limit: int = 1 << 18):
    """Runs of rows of at most ``limit`` bytes, a longer row alone: (first row, end row, bytes, offsets). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the words, and for each row the index of its first word (one entry more at the end)."""
    w = is_word[buf]
    before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    first, last = off[:-1], off[1:] - 1
    full = last >= first
    before[first[full]] = False
    after[last[full]] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def runs_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(BASE)
        out += values[k:k + n]
    return mix(out + np.uint64(width))


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
