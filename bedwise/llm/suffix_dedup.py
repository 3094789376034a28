"""Repeated passages: every byte of a string of 200 bytes that starts in two places is removed.

All places that can hold a repeat are found without sorting all suffixes in one task:

1. Anchors. In every 200-byte window the 64-byte string with the smallest hash is an anchor, so equal windows have equal anchors
   at equal distances. Anchors seen at one place only are dropped. What tasks get is a bitmap of fixed size.
2. Around an anchor lie all windows that contain it. Where this whole neighbourhood occurs twice, all of them repeat.
3. The others lie at the ends of repeats. Their windows, and those of one place of each repeated neighbourhood with the same
   anchor, are dealt to ``RANGES`` ranges of starts; those of a range share a core
   of some 166 bytes, by which rows meet. A core seen once ends it; equal ranges repeat as a whole; the rest is divided once
   more in the task, and what remains is decided by a suffix array over the strings around their common cores.

The suffix array is built by grouping (``suffix_array``): suffixes are put into groups of their Lyndon prefixes, highest group
first, by pointers to the previous smaller suffix, and a second pass writes every group in order. Neighbours in the array that
agree over a whole window are repeats; cores are compared by 64-bit hashes, all around them by its bytes.

A group of rows with one core that is larger than ``LARGE`` is not gathered: its single windows are counted by Spark instead.

Defined results. Null text is empty. A text under 200 bytes loses nothing. Texts that occur in several rows (repeated rows as
well) are wholly repeated. Rows are told apart by a 64-bit hash of their text; doc_id may be null or repeated. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedwise.llm.common import INVERSE, bloom, byte_chunks, cut, in_bloom, mix, powers, prefix_hash, span_hash

WIDTH, ANCHOR = 200, 64
REACH = WIDTH - ANCHOR
RANGES, PARTS = 4, 4
BLOOM_BITS = 1 << 25
LARGE = 20_000
LOW = np.array([-REACH + (REACH + 1) * r // RANGES for r in range(RANGES)])
HIGH = np.append(LOW[1:] - 1, 0)
SIDE = int((HIGH - LOW).max())


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order. Its last symbol is smaller than all others.

    First pass: groups start as suffixes of one first symbol. The highest open group is closed; each member's previous
    smaller suffix lies in an open group, and its Lyndon prefix grows by the closed group's. Suffixes that grow leave the
    others of their group for a new one right above; more steps, higher group. Second pass: a suffix that is in its place
    puts those whose next smaller suffix it is at the front of their groups.
    """
    n = len(text)
    members: list[set[int]] = [set() for _ in range(max(text) + 1)]
    for i, c in enumerate(text):
        members[c].add(i)
    group = list(text)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    back = list(range(-1, n - 1))  # towards the nearest place before that lies in an open group
    smaller, closed = [-1] * n, bytearray(n)
    lowest, g = 0, len(members) - 1
    while g >= 0:
        rows = members[g]
        for i in rows:
            closed[i] = 1
        steps: dict[int, int] = {}
        for i in rows:
            p = back[i]
            if p >= 0 and closed[p]:
                while p >= 0 and closed[p]:
                    p = back[p]
                q = i
                while q != p and back[q] != p:
                    back[q], q = p, back[q]
            if p >= 0:
                smaller[i] = p
                steps[p] = steps.get(p, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, k in steps.items():
            parts.setdefault((-k, group[p]), []).append(p)
        for (_, h), some in sorted(parts.items()) if len(parts) > 1 else parts.items():
            if len(some) < len(members[h]):
                members[h].difference_update(some)
                x, up = len(members), above[h]
                members.append(set(some))
                below.append(h)
                above.append(up)
                above[h] = x
                if up >= 0:
                    below[up] = x
                for i in some:
                    group[i] = x
        g = below[g]
    free, at, g = [0] * len(members), 0, lowest
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [0] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        i = out[r] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = 1
            i = smaller[i]
    return out


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` consecutive values."""
    out, step, n = x, 1, len(x) - width + 1
    while 2 * step <= width:
        out = op(out[:-step], out[step:])
        step *= 2
    return op(out[:n], out[width - step:width - step + n]) if step < width else out[:n]


def anchors(buf: np.ndarray, off: np.ndarray):
    """Hash sums, and for every anchor its place, row, hash, and first and last window start."""
    none = np.zeros(0, np.int64)
    if len(buf) < WIDTH:
        return np.zeros(1, np.uint64), none, none, none.astype(np.uint64), none, none
    h = prefix_hash(buf)
    n = len(buf) - ANCHOR + 1
    weight = (((h[ANCHOR:] - h[:-ANCHOR]) * powers(INVERSE, n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    least = slide(weight, REACH + 1, np.minimum)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):  # windows that reach over a text's end are none
        least[max(a, b - WIDTH + 1):b] = 0
    edge = np.zeros(REACH, np.uint32)
    place = np.flatnonzero(slide(np.concatenate([edge, least, edge]), REACH + 1, np.maximum) == weight)
    row = np.searchsorted(off, place, "right") - 1
    first, last = np.maximum(off[row], place - REACH), np.minimum(place, off[row + 1] - WIDTH)
    good = first <= last
    place, row, first, last = place[good], row[good], first[good], last[good]
    return h, place, row, span_hash(h, place, place + ANCHOR), first, last


def around(h, place, first, last) -> np.ndarray:
    """Hash of all windows with the anchor, and of where it stands in them."""
    return mix(span_hash(h, first, last + WIDTH) + (place - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def occurrence(f: np.ndarray, t: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix(mix(f + t.view(np.uint64)) + pos.astype(np.uint64))


def repeated(rows: DataFrame, key: str, *place: str) -> DataFrame:
    """Keys that occur at two places or more."""
    at = F.struct(*place)
    return rows.groupBy(key).agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select(key)


def sides(column: pa.Array, length: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, from the core outwards; 256 where a string has ended."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if offsets[-1] > offsets[0] else np.zeros(1, np.uint8)
    size = np.diff(offsets)
    k = np.arange(length)
    at = offsets[1:, None] - 1 - k if backwards else offsets[:-1, None] + k
    out = data[np.clip(at, 0, len(data) - 1)].astype(np.int64)
    out[k >= size[:, None]] = 256
    return out, size


def running(matrix: np.ndarray, salt: int) -> np.ndarray:
    """Column k: hash of the first k bytes of each row."""
    out = np.zeros((len(matrix), matrix.shape[1] + 1), np.uint64)
    for k in range(matrix.shape[1]):
        out[:, k + 1] = mix(out[:, k] + matrix[:, k].astype(np.uint64) + np.uint64(salt * 1000 + k + 1))
    return out


def several(key: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which rows' key occurs with at least two items."""
    _, key = np.unique(key, return_inverse=True)
    pairs = np.unique(np.stack([key, item]), axis=1)
    return (np.bincount(pairs[0], minlength=key.max() + 1 if len(key) else 0) > 1)[key]


def repeats_by_suffixes(core: np.ndarray, left: np.ndarray, right: np.ndarray, d: int) -> np.ndarray:
    """(string, x) of windows that occur in two strings: x bytes of the left side, the core, and d - x of the right.

    ``left`` and ``right`` have d columns, from the core outwards, 256 where there is nothing.
    """
    m = len(core)
    _, kind = np.unique(core, return_inverse=True)
    table = np.concatenate([
        left[:, ::-1] + m + 1, (kind + m + 258)[:, None], right + m + 1, np.arange(1, m + 1)[:, None]], axis=1)
    there = table != m + 257
    text = np.append(table[there], 0)
    # Window starts: x from d (leftmost column) to 0 (the core), where all d + 1 symbols are there.
    x = np.arange(d, -1, -1)
    n_left, n_right = (left < 256).sum(axis=1), (right < 256).sum(axis=1)
    begins = np.zeros(table.shape, bool)
    begins[:, :d + 1] = (x <= n_left[:, None]) & (d - x <= n_right[:, None])
    begins = np.append(begins[there], False)
    order = np.array(suffix_array(text.tolist()))
    one, two = order[:-1], order[1:]
    both = begins[one] & begins[two]
    one, two = one[both], two[both]
    equal = (text[one[:, None] + np.arange(d + 1)] == text[two[:, None] + np.arange(d + 1)]).all(axis=1)
    hit = np.zeros(len(text), bool)
    hit[one[equal]] = hit[two[equal]] = True
    string, column = np.nonzero(there)
    found = np.flatnonzero(hit[:-1])
    return np.stack([string[found], d - column[found]])


def decided(core, t, pos, r, left, right):
    """(t, first start, last start) of repeated windows among rows that are whole groups of one core."""
    out = []
    lm, n_left = sides(left, SIDE, True)
    rm, n_right = sides(right, SIDE, False)
    lh, rh = running(lm, 1), running(rm, 2)
    span = (HIGH - LOW)[r]
    rows = np.arange(len(core))
    first_x, last_x = np.maximum(0, span - n_right), np.minimum(n_left, span)
    _, place = np.unique(np.stack([t, pos]), axis=1, return_inverse=True)
    place = place.ravel()

    def found(i, x0, x1):
        out.append((t[i], pos[i] + HIGH[r[i]] - x1, pos[i] + HIGH[r[i]] - x0))

    whole = mix(core + lh[:, SIDE] * np.uint64(3) + rh[:, SIDE])
    again = several(whole, place)
    found(rows[again], first_x[again], last_x[again])
    _, one = np.unique(whole, return_index=True)  # one row of each string
    single = ~again
    for q in range(PARTS):
        x0, x1 = q * (span + 1) // PARTS, (q + 1) * (span + 1) // PARTS - 1
        ok = one[(np.maximum(first_x, x0) <= np.minimum(last_x, x1))[one]]
        ok = ok[(x0[ok] <= n_left[ok]) & (span[ok] - x1[ok] <= n_right[ok])]
        if not len(ok):
            continue
        inner = mix(core[ok] + lh[ok, x0[ok]] * np.uint64(5) + rh[ok, span[ok] - x1[ok]] + np.uint64(q))
        met = several(inner, ok)
        ok, inner = ok[met], inner[met]
        if not len(ok):
            continue
        outer = mix(inner + lh[ok, np.minimum(x1[ok], SIDE)] * np.uint64(7) + rh[ok, span[ok] - x0[ok]])
        same = several(outer, ok)
        hit = ok[same & single[ok]]
        found(hit, np.maximum(first_x, x0)[hit], np.minimum(last_x, x1)[hit])
        _, rep = np.unique(outer, return_index=True)
        ok, inner, same = ok[rep], inner[rep], same[rep]
        open_ = several(inner, ok)
        needed = np.isin(inner, inner[~same & single[ok]])
        ok, inner = ok[open_ & needed], inner[open_ & needed]
        for d in np.unique(x1[ok] - x0[ok]).tolist():
            at = np.flatnonzero(x1[ok] - x0[ok] == d)
            at = at[np.argsort(inner[at], kind="stable")]
            edges = np.append(np.flatnonzero(np.append(True, inner[at][1:] != inner[at][:-1])), len(at))
            lo = 0
            while lo < len(edges) - 1:  # whole groups, some ten thousand strings at once
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 10_000, "right")) - 1)
                some = at[edges[lo]:edges[hi]]
                i = ok[some]
                cols = np.arange(d)
                l, rr = lm[i[:, None], x0[i][:, None] + cols], rm[i[:, None], (span[i] - x1[i])[:, None] + cols]
                string, x = repeats_by_suffixes(inner[some], l, rr, d)
                found(i[string], x0[i[string]] + x, x0[i[string]] + x)
                lo = hi
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(t, s0, s1): starts s0 to s1 of windows that occur at another place too, by the hash t of their text."""
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64("text").alias("t"), "text")
    stack = lambda x: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)

    def all_anchors(batches):
        for batch in batches:
            t = batch.column(0).to_numpy()
            for lo, _, buf, off in byte_chunks(batch.column(1)):
                _, place, row, hashes, _, _ = anchors(buf, off)
                yield pa.RecordBatch.from_arrays([stack(hashes), pa.array(t[lo + row]), pa.array((place - off[row]).astype(np.int32))], ["h", "t", "pos"])

    twice = spark.sparkContext.broadcast(bloom(repeated(texts.mapInArrow(all_anchors, "h long, t long, pos int"), "h", "t", "pos"), "h", BLOOM_BITS))

    def neighbourhoods(batches):
        for batch in batches:
            t = batch.column(0).to_numpy()
            for lo, _, buf, off in byte_chunks(batch.column(1)):
                h, place, row, hashes, first, last = anchors(buf, off)
                keep = in_bloom(twice.value, hashes)
                place, row, first, last = place[keep], row[keep], first[keep], last[keep]
                base, f = off[row], around(h, place, first, last)
                yield pa.RecordBatch.from_arrays([
                    stack(f), stack(hashes[keep]), stack(occurrence(f, t[lo + row], place - base)), pa.array(t[lo + row]), *(pa.array((x - base).astype(np.int32)) for x in (place, first, last))],
                    ["f", "h", "k", "t", "pos", "s0", "s1"])

    near = texts.mapInArrow(neighbourhoods, "f long, h long, k long, t long, pos int, s0 int, s1 int")
    near = near.repartition("f").dropDuplicates(["f", "t", "pos"])
    by = Window.partitionBy("f")
    at = F.struct("t", "pos")
    near = near.withColumn("low", F.min(at).over(by)).withColumn("again", F.col("low") != F.max(at).over(by))
    near = cut(near.withColumn("lead", F.col("low") == at).drop("pos", "low"), "neighbourhoods")
    # Neighbourhoods that occur once, and one place of each other that has the same anchor: their windows may still agree.
    once = near.where("NOT again")
    partners = near.where("again AND lead").join(once.select("h").distinct(), "h", "left_semi")
    open_ = spark.sparkContext.broadcast(bloom(once.select("k").unionAll(partners.select("k")), "k", BLOOM_BITS))

    def cores(batches):
        for batch in batches:
            t = batch.column(0).to_numpy()
            for lo, _, buf, off in byte_chunks(batch.column(1)):
                h, place, row, hashes, first, last = anchors(buf, off)
                keep = in_bloom(twice.value, hashes)
                place, row, first, last = place[keep], row[keep], first[keep], last[keep]
                keep = in_bloom(open_.value, occurrence(around(h, place, first, last), t[lo + row], place - off[row]))
                place, row, first, last = place[keep], row[keep], first[keep], last[keep]
                data = buf.tobytes()
                for r in range(RANGES):
                    low, high = place + LOW[r], place + HIGH[r]
                    ok = np.maximum(low, first) <= np.minimum(high, last)
                    p, d, low, high = place[ok], row[ok], low[ok], high[ok]
                    key = mix(span_hash(h, high, low + WIDTH) + np.uint64(r))
                    lefts = [data[a:b] for a, b in zip(np.maximum(low, off[d]).tolist(), high.tolist())]
                    rights = [data[a:b] for a, b in zip((low + WIDTH).tolist(), np.minimum(high + WIDTH, off[d + 1]).tolist())]
                    yield pa.RecordBatch.from_arrays([
                        stack(key), pa.array(t[lo + d]), pa.array((p - off[d]).astype(np.int32)), pa.array(np.full(len(p), r, np.int32)), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()),
                    ], ["core", "t", "pos", "r", "l", "rr"])

    def decide(batches):
        def parts(table):
            core, t, pos, r = (table.column(c).to_numpy() for c in range(4))
            return core.view(np.uint64), t, pos.astype(np.int64), r, table.column(4), table.column(5)

        def result(t, s0, s1, w=None):
            return pa.RecordBatch.from_arrays([
                pa.array(t, pa.int64()), pa.array(s0, pa.int32()), pa.array(s1, pa.int32()), pa.nulls(len(t), pa.int64()) if w is None else stack(w)], ["t", "s0", "s1", "w"])

        def windows(table):
            """All windows of rows with a core that too many rows share, to be counted elsewhere."""
            core, t, pos, r, left, right = parts(table)
            (lm, n_left), (rm, n_right) = sides(left, SIDE, True), sides(right, SIDE, False)
            lh, rh, span, start = running(lm, 1), running(rm, 2), (HIGH - LOW)[r], pos + HIGH[r]
            for x in range(SIDE + 1):
                i = np.flatnonzero((x <= span) & (x <= n_left) & (span - x <= n_right))
                yield result(t[i], start[i] - x, start[i] - x, mix(core[i] + lh[i, x] * np.uint64(11) + rh[i, span[i] - x] + np.uint64(x)))

        def settled(table):
            if table.num_rows > 1:
                core = table.column(0).to_numpy()
                same = np.concatenate([[False], core[1:] == core[:-1]])
                same[:-1] |= same[1:]
                some = table.take(pa.array(np.flatnonzero(same)))
                if some.num_rows:
                    yield result(*decided(*parts(some)))

        held, large = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            held = None
            core = table.column(0).to_numpy()
            if large is not None:
                n = int(np.searchsorted(core != large, True)) if (core != large).any() else len(core)
                yield from windows(table.slice(0, n))
                table, core = table.slice(n), core[n:]
                if not len(core):
                    continue
                large = None
            tail = int(np.flatnonzero(core != core[-1])[-1]) + 1 if (core != core[-1]).any() else 0
            yield from settled(table.slice(0, tail))
            held = table.slice(tail)
            if held.num_rows > LARGE:
                yield from windows(held)
                held, large = None, core[-1]
        if held is not None:
            yield from settled(held)

    met = texts.mapInArrow(cores, "core long, t long, pos int, r int, l binary, rr binary")
    # The partial sums of a grouped count would hold every core; here rows are sorted by core and read in one go.
    found = met.repartition("core").sortWithinPartitions("core").mapInArrow(decide, "t long, s0 int, s1 int, w long")
    found = cut(found, "windows")
    single = found.where("w IS NOT NULL")
    single = single.join(repeated(single, "w", "t", "s0"), "w", "left_semi")
    return near.where("again").select("t", "s0", "s1").unionAll(found.where("w IS NULL").select("t", "s0", "s1")).unionAll(single.select("t", "s0", "s1"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    copies = texts.groupBy(F.xxhash64("text").alias("t")).count().where("count > 1").select("t", F.lit(-1).alias("s0"), F.lit(-1).alias("s1"))
    marks = repeated_windows(texts).unionAll(copies).groupBy("t").agg(F.collect_set(F.struct("s0", "s1")).alias("marks"))

    def run(batches):
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for text, marks in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2)):
                n = len(text)
                cover = np.zeros(n + 1, np.int64)
                if marks.is_valid and n >= WIDTH:
                    s0, s1 = (marks.values.field(k).to_numpy() for k in range(2))
                    if (s0 < 0).any():
                        s0, s1 = np.array([0]), np.array([n - WIDTH])
                    np.add.at(cover, s0, 1)
                    np.add.at(cover, s1 + WIDTH, -1)
                gone = np.cumsum(cover)[:n] > 0
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                sizes.append(n)
                removed.append(n - len(rest))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if n else 0)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = texts.withColumn("t", F.xxhash64("text")).join(marks, "t", "left").select(F.col("doc_id").cast("long"), "text", "marks")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
