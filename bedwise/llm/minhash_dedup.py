"""MinHash near-duplicates with odd sketches.

Every text becomes the set of its 5-word shingles. Texts with equal sets are one class. Classes meet in bands of
MinHash values; an odd sketch (the MinHash samples folded to a bitmap of parities) drops pairs that cannot reach the
threshold, and the full sets decide the rest.

Inside a bucket not all pairs are made. First every class is compared with one centre of its bucket; then, where a
bucket still holds several components, with other centres; then classes of different components that remain are
compared in blocks, and only links that join components come out. Pairs within one component need no test, as the result
names components.

Defined results. Null or wordless text: empty set, linked with nothing. Rows with one doc_id are one document: they
share a component. Null doc_id: n_shingles as usual, linked with nothing, component_id null, kept true. An empty table
gives an empty result. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedwise.llm.common import LOWER, bloom, bloom_bits, byte_chunks, components, cut, drop_table, in_bloom, list_array, mix, prefix_hash, runs_hash, span_hash, word_spans, word_table

WIDTH = 5
BANDS, ROWS = 24, 5
BITS = 512
BLOOM_BITS = 1 << 27  # at most: 16 MB
DEAL = 512
BLOCK = 1024
STARS = 3
PERCENT = 85
SPACE = word_table(lambda b: not (b == 32 or 9 <= b <= 13))
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLY, ADD = (_SEEDS[:BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[BANDS * ROWS:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array):
    """(first row, end row, sorted distinct shingle hashes of all rows, offsets) for runs of rows."""
    for lo, hi, buf, off in byte_chunks(column):
        buf = LOWER[buf]
        starts, ends, first = word_spans(buf, off, SPACE)
        words = span_hash(prefix_hash(buf), starts, ends)
        grams = runs_hash(words, WIDTH)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= WIDTH:
                sets.append(np.unique(grams[a:b - WIDTH + 1]))
            else:
                sets.append(runs_hash(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        offsets = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=offsets[1:])
        yield lo, hi, np.concatenate(sets), offsets


def min_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of MinHash values per non-empty set."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(full), BANDS * ROWS), np.uint32)
    if len(full):
        x, at = (values >> np.uint64(32)).astype(np.uint32), offsets[full]
        for k in range(BANDS * ROWS):
            out[:, k] = np.minimum.reduceat(x * MULTIPLY[k] + ADD[k], at)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.empty((len(mins), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(mins), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, b * ROWS + r])
        keys[:, b] = key
    return keys


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps: every sample (index, value) flips one of BITS bits."""
    k = np.arange(1, mins.shape[1] + 1, dtype=np.uint64) << np.uint64(32)
    bit = mix(mins.astype(np.uint64) + k) % np.uint64(BITS)
    counts = np.zeros((len(mins), BITS), np.uint8)
    np.add.at(counts, (np.arange(len(mins))[:, None], bit.astype(np.int64)), 1)
    return np.packbits(counts & 1, axis=1)


def sketch_limit(percent: int) -> int:
    """Largest XOR population count that a pair at the threshold can show, five deviations of both estimates allowed."""
    k, p = BANDS * ROWS, 1 - percent / 100
    differing = 2 * (k * p + 5 * math.sqrt(k * p * (1 - p)))
    flipped = (1 - math.exp(-2 * differing / BITS)) / 2
    return math.ceil(BITS * flipped + 5 * math.sqrt(BITS * flipped * (1 - flipped)))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_id binary, keys array<long>, sketch array<long>) for every row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, values, offsets in shingle_sets(batch.column(1)):
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                mins = min_hashes(values, offsets)
                set_id = np.zeros((hi - lo, 2), np.uint64)
                if len(full):
                    for c in range(2):  # sums of two mixes of the members: equal sets, equal ids
                        set_id[full, c] = np.add.reduceat(mix(values + np.uint64(77 * (c + 1))), offsets[full])
                keys = np.ascontiguousarray(band_keys(mins)).view(np.int64)
                sketch = odd_sketches(mins).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array(size, pa.int64()),
                    pa.array([r.tobytes() for r in set_id], pa.binary()),
                    list_array(pa.array(keys.ravel()), np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])),
                    list_array(pa.array(sketch.ravel()), np.concatenate([[0], np.cumsum(np.where(size > 0, BITS // 64, 0))])),
                ], ["doc_id", "n", "set_id", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, set_id binary, keys array<long>, sketch array<long>")


def id_bitmap(ids: DataFrame, count: int):
    """A bitmap of ``count`` ids, broadcast; a few others are in it too. Its size follows their number up to BLOOM_BITS."""

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["k"])

    return ids.sparkSession.sparkContext.broadcast(bloom(ids.mapInArrow(hashed, "k long"), "k", bloom_bits(count, BLOOM_BITS)))


def repeated_ids(rows: DataFrame):
    """The bitmap of the ids that several rows share, None where no id is shared."""
    ids = cut(rows.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "repeated")
    count = ids.count()
    found = id_bitmap(ids, count) if count else None
    drop_table(rows.sparkSession, ids)
    return found


def member_sets(docs: DataFrame, ids: DataFrame, repeated=None) -> DataFrame:
    """(id, grams binary): the full shingle sets of the wanted documents, and of few others; a table made by ``cut``.

    A bitmap picks them while the texts are read, so no text is shuffled; what it lets through by chance falls out of the
    joins that follow. It is enough for some ten million ids; beyond, more sets pass it than are needed.
    Rows of one id with equal sets give one row, or else each would meet every partner of its id in the joins. Only sets of ids in
    the bitmap ``repeated`` are compared for that.
    """
    wanted = id_bitmap(ids, ids.count())

    def run(batches):
        for batch in batches:
            some = pa.array(np.flatnonzero(in_bloom(wanted.value, mix(batch.column(0).to_numpy().view(np.uint64)))))
            batch = batch.take(some)
            for lo, hi, values, offsets in shingle_sets(batch.column(1)):
                own = batch.column(0).slice(lo, hi - lo)
                again = np.zeros(hi - lo, bool) if repeated is None else in_bloom(repeated.value, mix(own.to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    own, pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary()), pa.array(again),
                ], ["id", "grams", "again"])

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = cut(known.mapInArrow(run, "id long, grams binary, again boolean"), "sets")
    if repeated is None:
        return sets.select("id", "grams")
    return sets.where("NOT again").select("id", "grams").unionAll(cut(sets.where("again").select("id", "grams").distinct(), "sets"))


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int, repeated=None) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    A pair's second set goes once to every DEAL partners of it, so neither a popular document nor its partners meet in one task.
    """
    spark = docs.sparkSession
    ids = cut(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = member_sets(docs, ids, repeated)
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    partners = dealt.join(sets.withColumnRenamed("id", "a"), "a").select("b", "part", "a", "grams")
    centres = parts.join(sets.withColumnRenamed("id", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "grams")

    def run(batches):
        centre, own = None, None
        for batch in batches:
            b, a, grams, keep = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), []
            for i, partner in enumerate(a):
                members = np.frombuffer(grams[i].as_buffer(), np.uint64)
                if partner is None:  # sorted before its partners
                    centre, own = b[i], members.copy()
                elif centre == b[i]:
                    shared = int((own[np.minimum(np.searchsorted(own, members), len(own) - 1)] == members).sum())
                    if 100 * shared >= percent * (len(own) + len(members) - shared):
                        keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(keep), batch.column(0).take(keep)], ["a", "b"])

    both = partners.unionByName(centres).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    linked = both.mapInArrow(run, "a long, b long")
    links = cut(linked.distinct(), "links")
    for table in (sets, ids):
        drop_table(spark, table)
    return links


def block_pairs(rows: DataFrame) -> DataFrame:
    """The rows of every bucket in pairs (i, j) of blocks, ``own`` the one of the row; a row is repeated for each pair it is in.

    The largest component of a bucket has blocks of its own, which meet those of the others only, so that its rows are
    repeated by the number of other rows and not by their own.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    blocks = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("all"))
    number = lambda m: F.greatest(F.lit(1), F.ceil(m / BLOCK)).cast("int")
    blocks = blocks.select("key", F.col("main.comp").alias("main"), number(F.col("all") - F.col("main.m")).alias("nb"), number(F.col("main.m")).alias("mb"))
    dealt, main = rows.join(blocks, "key"), F.col("comp") == F.col("main")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    dealt = dealt.withColumn("own", F.when(main, F.col("nb") + block("mb")).otherwise(block("nb")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1 + F.when(main, 0).otherwise(F.col("mb")))))
    return dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rows.columns)


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a bucket, as many as join them.

    ``rows``: key, id, comp, n, keys, sketch, grams. Large buckets are dealt out as pairs of blocks. A pair is tested in the
    first band that it shares only, by its sketches and then on the full sets; what a task has joined it tests no more.
    """
    limit = sketch_limit(percent)
    rows = block_pairs(rows).select("key", "i", "j", "own", "id", "comp", "n", "keys", "sketch", "grams")

    def run(key, table):
        own, ids, comp, n = (table.column(c).to_numpy() for c in ("own", "id", "comp", "n"))
        sketch, keys = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1) for c in ("sketch", "keys"))
        sketch = sketch.view(np.uint64)
        grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        band = int(np.flatnonzero(keys[0] == key[0].as_py())[0])
        right = np.flatnonzero(own == key[2].as_py())
        comp, links = comp.copy(), []
        for x in np.flatnonzero(own == key[1].as_py()).tolist():
            y = right[(comp[right] != comp[x])]
            y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
            y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int32) <= limit]
            y = y[~(keys[y, :band] == keys[x, :band]).any(axis=1)]
            if not len(y):
                continue
            own_set, sets = grams[x], [grams[k] for k in y.tolist()]
            flat, size = np.concatenate(sets), np.array([len(g) for g in sets])
            found = own_set[np.minimum(np.searchsorted(own_set, flat), len(own_set) - 1)] == flat
            common = np.add.reduceat(found, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
            for k in y[100 * common >= percent * (len(own_set) + size - common)].tolist():
                if comp[k] != comp[x]:
                    links.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
                    comp[comp == comp[k]] = comp[x]
        return pa.table({"a": pa.array([l[0] for l in links], pa.int64()), "b": pa.array([l[1] for l in links], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; linked at 100 * common >= percent * union."""
    marks = cut(signatures(docs), "signatures")
    full = marks.where("n > 0 AND doc_id IS NOT NULL")
    # One representative per distinct set; its copies are linked with it.
    reps = full.groupBy("set_id", "n").agg(F.min(F.struct("doc_id", "keys", "sketch")).alias("r"))
    reps = cut(reps.select("set_id", "n", F.col("r.doc_id").alias("id"), F.col("r.keys").alias("keys"), F.col("r.sketch").alias("sketch")), "classes")
    copies = full.select("doc_id", "set_id", "n").join(reps.select("set_id", "n", "id"), ["set_id", "n"]).where("doc_id <> id")
    copies = copies.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    buckets = reps.select("id", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = buckets.join(shared, "key")
    # The class that shares most with others is likely the one that the others were made from.
    shares = buckets.groupBy("id").agg(F.sum("m").alias("shares"))
    buckets = cut(buckets.join(shares, "id").select("key", "id", "shares"), "buckets")
    sketches = reps.select("id", "n", "sketch")
    limit = sketch_limit(percent)
    differing = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda t, x: t + x)

    def likely(pairs: DataFrame) -> DataFrame:
        one, two = (sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        met = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return met.where(differing <= limit).select("a", "b")

    spark, repeated = docs.sparkSession, repeated_ids(full)
    apart, links, before = buckets.withColumn("comp", F.col("id")), None, []
    for turn in range(STARS):
        # A centre per bucket, by one order for all buckets, so that most buckets name the same pairs.
        order = F.struct(-F.col("shares"), "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)), "id")
        centre = apart.groupBy("key").agg(F.min_by(F.struct("id", "comp"), order).alias("c"))
        pairs = apart.join(centre, "key").where("comp <> c.comp").select(F.greatest("id", "c.id").alias("a"), F.least("id", "c.id").alias("b")).distinct()
        tested = cut(likely(pairs), "pairs")
        new = confirmed(docs, tested, percent, repeated)
        drop_table(spark, tested)
        links = new if links is None else links.unionAll(new)
        comp = components(links)
        named = buckets.join(comp, "id", "left").select("key", "id", "shares", F.coalesce("comp", "id").alias("comp"))
        mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        apart = cut(named.join(mixed, "key"), "apart")
        for table in before:
            drop_table(spark, table)
        before = [apart, comp]
        if apart.isEmpty():
            break
    else:
        sets = member_sets(docs, apart.select("id").distinct(), repeated)
        rows = apart.join(reps.select("id", "n", "keys", "sketch"), "id").join(sets, "id")
        links = links.unionAll(cut(across(rows.select("key", "id", "comp", "n", "keys", "sketch", "grams"), percent), "links"))
        drop_table(spark, sets)
    whole = components(links.unionAll(copies))
    for table in (*before, links, buckets, reps):
        drop_table(spark, table)
    named = whole.select(F.col("id").alias("doc_id"), "comp")
    out = marks.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
