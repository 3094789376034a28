"""Benchmark decontamination as a prefix-filtered set join.

An item gives windows of 13 consecutive words (a shorter item one window of all its words). A window is a set of
3-word shingles with their places. To occur in a document it must share every shingle with it, so one shingle is prefix
enough: the one that is rarest in the corpus. Documents send only the places of such shingles to the join; the place of
the shingle in the window bounds the start and the length, and the words around it decide exactly.

What goes to every task is one bitmap of fixed size (a Bloom filter of the shingles), whatever the benchmark's size;
false positives are dropped by the join. Documents are read twice: to count the shingles, and to find them.

Defined results. Null or wordless text: no words, no hits, not contaminated. Null or wordless items have no window; an
item without an id marks words but is not listed. Every row of ``docs`` gives one row; equal rows give equal rows. Equal
items are listed once each by id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedwise.llm.common import LOWER, bloom, byte_chunks, cut, in_bloom, list_array, prefix_hash, runs_hash, span_hash, word_spans, word_table

WIDTH, GRAM = 13, 3
BLOOM_BITS = 1 << 24
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IS_WORD = word_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOW), F.lit(WORD), 0)


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id string, window string, width): the windows of every item, words joined by a space."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    width = F.least(F.lit(WIDTH), F.size("w"))
    at = words.select("item_id", "w", width.alias("width"), F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)).alias("i"))
    return at.select("item_id", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("width"))).alias("window"), "width").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, width, k, gram): every shingle of a window and its place in it."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in byte_chunks(batch.column(0)):
                starts, ends, first = word_spans(buf, off, IS_WORD)
                words, grams, places, rows = span_hash(prefix_hash(buf), starts, ends), [], [], []
                for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    g = runs_hash(words[a:b], min(GRAM, b - a))
                    grams.append(g)
                    places.append(np.arange(len(g)))
                    rows.append(np.full(len(g), lo + row))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.concatenate(rows))), batch.column(1).take(pa.array(np.concatenate(rows))),
                    pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(grams).view(np.int64)),
                ], ["window", "width", "k", "gram"])

    return windows.select("window", "width").mapInArrow(run, "window string, width int, k int, gram long")


def shingle_places(column: pa.Array, sizes: list[int], filter_bits: np.ndarray):
    """For runs of rows: the bytes, word spans, first word of each row, and (row, word, gram) of every shingle in the filter."""
    for lo, hi, buf, off in byte_chunks(column):
        buf = LOWER[buf]
        starts, ends, first = word_spans(buf, off, IS_WORD)
        words, rows, places, grams = span_hash(prefix_hash(buf), starts, ends), [], [], []
        for g in sizes:
            h = runs_hash(words, g)
            at = np.flatnonzero(in_bloom(filter_bits, h))
            row = np.searchsorted(first, at, "right") - 1
            inside = at + g <= first[row + 1]
            rows.append(row[inside])
            places.append(at[inside])
            grams.append(h[at[inside]])
        yield lo, hi, buf, starts, ends, first, np.concatenate(rows), np.concatenate(places), np.concatenate(grams)


def benchmark_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, tid, n_words), occurrences (doc_id, tid, start, width, window) counted in words from 0, and the windows."""
    spark = docs.sparkSession
    windows = item_windows(items)
    shingles = cut(window_shingles(windows.select("window", "width").distinct()), "shingles")
    sizes = sorted({min(GRAM, r["width"]) for r in shingles.select("width").distinct().collect()})  # at most three
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tid"), "text")
    every = spark.sparkContext.broadcast(bloom(shingles, "gram", BLOOM_BITS))

    def count(batches):
        for batch in batches:
            for *_, grams in shingle_places(batch.column(0), sizes, every.value):
                gram, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    counts = source.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # A window with a shingle that no document has cannot occur; of the others the rarest shingle is the prefix.
    prefixes = shingles.join(counts, "gram", "left").groupBy("window", "width").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "k")).alias("p"))
    prefixes = cut(prefixes.where("p.n > 0").select("window", "width", "p.gram", "p.k"), "prefixes")
    rare = spark.sparkContext.broadcast(bloom(prefixes, "gram", BLOOM_BITS))
    reach = WIDTH - 1

    def find(batches):
        for batch in batches:
            for lo, hi, buf, starts, ends, first, rows, places, grams in shingle_places(batch.column(2), sizes, rare.value):
                order = np.argsort(rows, kind="stable")
                rows, places, grams = rows[order], places[order], grams[order]
                low, high = np.maximum(places - reach, first[rows]), np.minimum(places + reach + 1, first[rows + 1])
                data = buf.tobytes()
                around = [data[a:b] for a, b in zip(starts[low].tolist(), ends[high - 1].tolist())] if len(rows) else []
                hits = pa.StructArray.from_arrays([
                    pa.array(grams.view(np.int64)), pa.array(places - first[rows], pa.int64()), pa.array(places - low, pa.int32()), pa.array(around, pa.binary()).cast(pa.string()),
                ], ["gram", "pos", "at", "around"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()),
                    list_array(hits, np.searchsorted(rows, np.arange(hi - lo + 1))),
                ], ["doc_id", "tid", "n_words", "hits"])

    found = cut(source.mapInArrow(find, "doc_id long, tid long, n_words long, hits array<struct<gram:long,pos:long,at:int,around:string>>"), "hits")
    near = found.select("doc_id", "tid", F.explode("hits").alias("h")).select("doc_id", "tid", "h.*")
    met = near.join(prefixes, "gram").where("at >= k").withColumn("w", F.regexp_extract_all("around", F.lit(WORD), 0))
    met = met.where("at - k + width <= size(w)").where(F.concat_ws(" ", F.slice("w", F.col("at") - F.col("k") + 1, F.col("width"))) == F.col("window"))
    met = met.select("doc_id", "tid", (F.col("pos") - F.col("k")).alias("start"), "width", "window")
    rows = found.select("doc_id", "tid", "n_words")
    return rows, met, windows


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, tid) for every row of ``docs``; tid hashes the text."""
    rows, met, windows = benchmark_hits(docs, items)
    met = cut(met, "matches")
    same = ["doc_id", "tid"]
    spans = met.groupBy(*same).agg(F.sort_array(F.collect_set(F.struct("start", F.col("width").cast("long").alias("width")))).alias("s"))
    covered = F.aggregate(
        "s", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["width"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["width"] - F.greatest(acc["end"], x["start"]))).alias("n")),
        lambda acc: acc["n"])
    spans = spans.select(*same, covered.alias("n_hit"))
    named = met.select(*same, "window").distinct().join(windows.where("item_id IS NOT NULL").select("window", "item_id"), "window")
    named = named.groupBy(*same).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    both = spans.join(named, (spans["tid"] == named["tid"]) & spans["doc_id"].eqNullSafe(named["doc_id"]), "left").select(spans["doc_id"], spans["tid"], "n_hit", "items")
    out = rows.join(both, (rows["tid"] == both["tid"]) & rows["doc_id"].eqNullSafe(both["doc_id"]), "left")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        rows["doc_id"], rows["n_words"], n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), rows["tid"])
