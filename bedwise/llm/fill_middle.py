"""Fill-in-the-middle by secondary sort: pieces keyed by document and output position, streamed into digests or texts.

A text is cut into lines. Hashes of the document's id choose where prefix and middle end and which form is written. Every
segment leaves as pieces of at most PIECE bytes, keyed by document and place in the output. One shuffle by document and a
sort inside each partition bring them into that order; a pass over the sorted pieces feeds an incremental digest and gives
each piece its place in the original text, which it reads from the output's marks alone; a second sort of the same
partitions, without a shuffle, restores the text, and a second pass digests that. No document is held whole.

The shuffle and the sort are ``repartition`` and ``sortWithinPartitions``, the DataFrame form of
``repartitionAndSortWithinPartitions``: rows stay in Spark's binary format and the sort spills.

Defined results. Null or empty text: plain and empty, no lines. A text that holds a mark is plain. A null doc_id hashes like the
empty string. Every row gives one row: rows are told apart by their place in the input, so equal rows give equal rows, and
equal ids may hold different texts. The input must be read from files (as after ``cut``), so that this place is the same
when a task runs again. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PIECE = 8192
ROWS = 1024
KEY = ["doc_id", "tid", "rid"]
KEY_TYPE = "doc_id long, tid long, rid long"
NOTE_TYPE = "n long, form string, prefix_chars long, middle_chars long"
NOTES = ["n", "form", "prefix_chars", "middle_chars"]
_KEY_SCHEMA = [(c, pa.int64()) for c in KEY]
_NOTE_SCHEMA = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def batches_of(rows, schema: pa.Schema):
    """Record batches of tuples, at most ROWS in one: a batch of pieces stays below ROWS * PIECE bytes."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def code_points(buf: np.ndarray) -> int:
    return int(len(buf) - ((buf & 0xC0) == 0x80).sum())


def segments(data: bytes, h: list[int], rate: int, spm: int):
    """(n, form, prefix_chars, middle_chars, [(mark, start, end)] in the order of the output)."""
    buf = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(buf == 10) + 1
    if len(buf) and buf[-1] != 10:
        ends = np.append(ends, len(buf))
    n = len(ends)
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h[2] % 100 >= rate:
        return n, "plain", None, None, [(b"", 0, len(data))]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m = int(ends[a - 1]) if a else 0, int(ends[b - 1]) if b else 0
    parts = [(PREFIX, 0, p), (SUFFIX, m, len(data)), (MIDDLE, p, m)]
    form = "spm" if h[3] % 100 < spm else "psm"
    if form == "spm":
        parts[:2] = parts[1::-1]
    return n, form, code_points(buf[:p]), code_points(buf[p:m]), parts


def pieces(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, tid, rid, place, piece, n, form, ...): the output's pieces; a document's first piece carries its form."""
    schema = pa.schema([*_KEY_SCHEMA, ("place", pa.int64()), ("piece", pa.binary()), *_NOTE_SCHEMA])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time, as a batch may hold long ones
                doc_id, tid, rid, digest, text = (c[i].as_py() for c in batch.columns)
                data = (text or "").encode()
                h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
                n, form, prefix_chars, middle_chars, parts = segments(data, h, rate, spm)
                place, notes = 0, (n, form, prefix_chars, middle_chars)
                for mark, start, end in parts:
                    for at in range(start, max(end, start + 1), PIECE):
                        yield doc_id, tid, rid, place, (mark if at == start else b"") + data[at:min(at + PIECE, end)], *notes
                        place, notes = place + 1, (None, None, None, None)

    def run(batches):
        yield from batches_of(rows(batches), schema)

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.monotonically_increasing_id().alias("rid"), digest.alias("digest"), "text")
    return source.mapInArrow(run, f"{KEY_TYPE}, place long, piece binary, {NOTE_TYPE}")


def in_output_order(found: DataFrame) -> DataFrame:
    return found.repartition(*KEY).sortWithinPartitions(*KEY, "place")


def documents_of(batches):
    """The sorted rows of a partition, as (key, iterator of rows) of one document after another."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    return groupby(rows(), key=lambda r: r[:3])


def outputs(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, form, output) of every row: the texts as written for training."""
    def run(batches):
        for key, rows in documents_of(batches):
            rows = list(rows)
            text = b"".join(r[4] for r in rows).decode()
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([rows[0][6]], pa.string()), pa.array([text], pa.string())], ["doc_id", "form", "output"])

    return in_output_order(pieces(docs, **options)).mapInArrow(run, "doc_id long, form string, output string")


def restored(written: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, form, output): the original text."""
    parts = F.split("output", "<[PSM]>")
    joined = F.when(F.col("form") == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col("form") == "spm", F.concat(parts[2], parts[3], parts[1]))
    return written.select("doc_id", F.coalesce(joined, F.col("output")).alias("text"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    middle_schema = pa.schema([*_KEY_SCHEMA, ("place", pa.int64()), ("piece", pa.binary()), *_NOTE_SCHEMA])
    order = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

    def read_output(batches):
        for key, rows in documents_of(batches):
            digest, notes, segment, place = hashlib.sha256(), None, 0, 0
            for row in rows:
                piece = row[4]
                digest.update(piece)
                if notes is None:
                    notes = row[5:]
                if notes[1] != "plain" and piece[:3] in order:  # no text of this form holds a mark
                    segment, piece = order[piece[:3]], piece[3:]
                if piece:
                    place += 1
                    yield *key, (segment << 48) + place, piece, None, None, None, None
            # The digest goes ahead of the pieces in the second order.
            yield *key, -1, digest.digest(), *notes

    def first(batches):
        yield from batches_of(read_output(batches), middle_schema)

    last_schema = pa.schema([("doc_id", pa.int64()), *_NOTE_SCHEMA, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def read_text(batches):
        for key, rows in documents_of(batches):
            head, digest = next(rows), hashlib.sha256()
            for row in rows:
                digest.update(row[4])
            yield key[0], *head[5:], head[4].hex(), digest.hexdigest()

    def second(batches):
        yield from batches_of(read_text(batches), last_schema)

    written = in_output_order(pieces(docs, **options)).mapInArrow(first, f"{KEY_TYPE}, place long, piece binary, {NOTE_TYPE}")
    return written.sortWithinPartitions(*KEY, "place").mapInArrow(second, f"doc_id long, {NOTE_TYPE}, output_sha256 string, restored_sha256 string")
