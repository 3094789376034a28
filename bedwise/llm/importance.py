"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel scores, a distributed radix sort.

Runs of one to three words fall into buckets by crc32; a bucket's gain is the log ratio of its smoothed shares in the
target and in the documents. A document's weight is the sum of its gains. A Gumbel draw from the document's id is added,
so the highest scores are a sample without replacement in proportion to the exponential of the weights.

The ranking is an LSD radix sort of tables. A pass takes one digit of the composite key, least significant first. Rows
are numbered by their position; blocks of consecutive positions rank their rows by digit, a prefix sum over (digit, block)
counts gives every such run its place, and a row's new position is that place plus its rank. Blocks have equal sizes
whatever the keys are, so hot keys make no hot task, and every pass is a written table.

Defined results. Null or wordless text: no features, weight 0. Documents below the least number of words have a score, but
take no part in the draw. A null doc_id is drawn as the text ``42:`` and ranks behind other ids of its score. Every row
gives one row; rows equal in score and id take neighbouring ranks. Empty tables: no rows, or gains from the smoothing
alone. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedwise.llm.common import LOWER, byte_chunks, cut, drop_table, word_spans, word_table

BUCKETS = 10_000
RUN = 3
IS_WORD = word_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
DIGIT = 12
BLOCK_BITS = 17
SHORT = 64


def _crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def _zeros_behind(c: np.ndarray) -> np.ndarray:
    return CRC[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a crc, with value b, becomes when n bytes follow; a crc's bytes add up by xor."""
    out = np.empty((SHORT + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(out)):
        out[n] = _zeros_behind(out[n - 1])
    return out


SHIFT = _shift_tables()


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The crc's part in that of a longer string: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    short = np.minimum(n, SHORT + 1)
    out = np.zeros(len(c), np.uint32)
    for k in range(4):
        out ^= SHIFT[short, k, (c >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(n > SHORT + 1).tolist():
        v, left, step = c[i:i + 1], int(n[i]), SHIFT[1]
        while left:  # by squaring: the step doubles with every bit of the length
            if left & 1:
                v = step[0][v & 255] ^ step[1][(v >> 8) & 255] ^ step[2][(v >> 16) & 255] ^ step[3][v >> 24]
            step = step[0][step & 255] ^ step[1][(step >> 8) & 255] ^ step[2][(step >> 16) & 255] ^ step[3][step >> 24]
            left >>= 1
        out[i] = v[0]
    return out


def span_crc(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of byte spans: all short spans advance by a byte at a time."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    long = int((size > SHORT).sum())
    out = np.empty(len(size), np.uint32)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(buf[starts[i]:ends[i]])
    rest = order[long:]
    at, left, c = starts[rest], size[rest], np.full(len(rest), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        n = len(left) - int(np.searchsorted(left[::-1], j, "right"))
        c[:n] = CRC[(c[:n] ^ buf[at[:n] + j]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[rest] = ~c
    return out


def feature_buckets(column: pa.Array, buckets: int):
    """For runs of rows: first row, end row, index of each row's first word, and [(word index, bucket)] by run length.

    The word index is that of a run's last word.
    """
    space = np.uint32(zlib.crc32(b" "))
    for lo, hi, buf, off in byte_chunks(column):
        buf = LOWER[buf]
        starts, ends, first = word_spans(buf, off, IS_WORD)
        size = ends - starts
        run = span_crc(buf, starts, ends)
        behind = shifted(np.full(len(run), space), size) ^ run  # crc of a space and the word
        place = np.arange(len(run)) - np.repeat(first[:-1], np.diff(first))
        out = [(np.arange(len(run)), run % np.uint32(buckets))]
        for k in range(1, RUN):
            longer = np.zeros(len(run), np.uint32)
            longer[1:] = shifted(run[:-1], size[1:] + 1) ^ behind[1:]
            run = longer
            inside = np.flatnonzero(place >= k)
            out.append((inside, run[inside] % np.uint32(buckets)))
        yield lo, hi, first, out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. A task sends one number per bucket; the driver gets one per bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, features in feature_buckets(batch.column(0), buckets):
                for _, b in features:
                    total += np.bincount(b, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    table = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A thousand times the log ratio of each bucket's share in the target and in the documents, rounded down."""
    s, t = bucket_counts(docs, buckets), bucket_counts(target, buckets)
    in_docs, in_target = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * in_docs / ((a + 1.0) * in_target))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def run(batches):
        for batch in batches:
            for lo, hi, first, features in feature_buckets(batch.column(1), len(shared.value)):
                gain, number = np.zeros(int(first[-1]) + 1, np.int64), np.zeros(int(first[-1]) + 1, np.int64)
                for at, b in features:
                    gain[at + 1] += shared.value[b]
                    number[at + 1] += 1
                gain, number = np.cumsum(gain), np.cumsum(number)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(np.diff(number[first])), pa.array(np.diff(gain[first])),
                ], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """A thousand times a Gumbel draw that a document's id fixes, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _digits(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> list[Column]:
    """The digits of the composite key, least significant first. As many as the range of the values needs."""
    wanted = [f(F.col(c)).alias(f"{n}{i}") for i, (c, _) in enumerate(keys) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null{i}") for i, (c, _) in enumerate(keys)]
    found, out = df.agg(*wanted, *nulls).first(), []
    for i, (column, descending) in reversed(list(enumerate(keys))):
        lo, hi = found[f"lo{i}"], found[f"hi{i}"]
        if lo is None:
            continue
        value, bits = F.col(column).cast("long"), (hi - lo).bit_length()
        if bits < 64:
            offset = F.lit(hi) - value if descending else value - F.lit(lo)
        else:  # the difference would overflow: flip the sign bit, which orders the values without sign
            offset = value.bitwiseXOR(F.lit(-(1 << 63)))
            offset = F.bitwise_not(offset) if descending else offset
        passes = max(1 if found[f"null{i}"] else 0, math.ceil(bits / DIGIT))
        width = max(1, math.ceil(bits / passes)) if passes else 0
        for k in range(passes):
            digit = F.shiftrightunsigned(offset, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
            out.append(F.coalesce(digit, F.lit(1 << width if k == passes - 1 else 0)))  # nulls last
    return out


def radix_rank(df: DataFrame, keys: Sequence[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """``df`` with ranks 1, 2, 3... by long columns ``[(column, descending)]``, most significant first, nulls last.

    Every pass writes its rows once, moves them once, and sends one row per digit and block of 2 ** BLOCK_BITS rows through
    the prefix sums.
    """
    columns = df.columns
    rows = cut(df, "radix")
    # Any numbering serves the first pass; it names the file's part and the row in it, so its blocks are bounded too.
    state, written = rows.withColumn("_pos", F.monotonically_increasing_id()), rows
    digits = _digits(rows, keys) or [F.lit(0)]
    for digit in digits:
        dealt = state.select(*columns, "_pos", F.shiftright("_pos", BLOCK_BITS).alias("_block"), digit.alias("_digit"))
        ranked = cut(dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_pos"))).drop("_pos"), "radix")
        drop_table(df.sparkSession, written)
        written = ranked
        counts = ranked.groupBy("_block", "_digit").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        totals = counts.groupBy("_digit").agg(F.sum("n").alias("all"))  # at most 2 ** DIGIT + 1 rows
        start = totals.select("_digit", F.coalesce(F.sum("all").over(Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        base = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(start, "_digit").select("_block", "_digit", (F.col("start") + F.col("before")).alias("base"))
        state = ranked.join(base, ["_block", "_digit"]).withColumn("_pos", F.col("base") + F.col("_r") - 1)
    return state.select(*columns, (F.col("_pos") + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) for every row; rank is null for those not drawn."""
    marks = cut(weighted(docs, bucket_gains(docs, target, buckets)), "weights").withColumn("score", F.col("weight") + gumbel(seed))
    fit = marks.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = radix_rank(fit, [("score", True), ("doc_id", False)]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(marks.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
