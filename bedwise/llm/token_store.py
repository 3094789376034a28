"""Token ids of whole texts in files, compressed by Re-Pair grammars.

Documents in ascending doc_id order (null first, equal ids by text) are encoded, each followed by an end id. Runs of
documents form shards of about ``SHARD_IDS`` ids. A shard's ids are compressed by repeatedly replacing frequent pairs by
nonterminals; a round replaces many pairs at once, the more frequent one where two overlap, and rounds go on until no pair
occurs ``LEAST`` times in a row of symbols. The file keeps rules and
expansion lengths, so any range of ids is decoded without the rest.

Files are Parquet, one row per shard, written by Spark's committer: a lost executor's shard is made again. Columns:
part, seq (shard order), before (ids of the part before the shard), n_ids, and payload, little-endian:

    4s  magic b"RPG1"
    u4  vocabulary size V, documents D, rounds R, rules N, symbols S, bytes per symbol (2 or 4)
    u4  [R] rules of each round
    i8  [D] doc_id, then u1 [D] 1 where it is not null
    u4  [D] ids of each document
    u4  [N] left symbol, then u4 [N] right symbol: rule i is symbol V + i and refers to earlier symbols only
    u4  [N] expansion lengths
    u2 or u4 [S] symbols

Encoding looks up pieces: the tokenizer encodes runs of letters, single digits, runs of other signs and contractions one
by one, so their ids do not depend on their neighbours. Pieces that the cache lacks go to the model of the tokenizers library;
words that hold a character beyond ASCII and the letters of Latin-1 go whole through the library's tokenizer.

Defined results. Null or empty text: only the end id. Rows with equal doc_id are separate documents, one after another.
An empty table writes no shard and reads back as no rows. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedwise.llm.common import give_back, new_path

END_ID = 2
SHARD_IDS = 1 << 20
LEAST = 8
CACHE_WORDS, CACHE_PIECES = 50_000, 400_000
RUN_CHARS = 1 << 20
MAGIC = b"RPG1"

# White space of ASCII, at which words are taken apart, and characters of which the pieces below are known: ASCII and the
# letters of Latin-1. "<|" may begin a special token.
WHITE = re.compile(r"[\t-\r ]")
WORD = re.compile(r"[^\t-\r ]+")
PLAIN = re.compile(r"[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
# The parts that this tokenizer encodes one by one, in lower case: letters, single digits, other signs, and contractions, which
# are a lone apostrophe and what it begins. Kinds of the bytes of such a text, and bytes after an apostrophe.
SPACE, LETTER, DIGIT, SIGN = range(4)
KIND = np.full(256, SIGN, np.uint8)
KIND[[*b"\t\n\v\f\r "]], KIND[[*range(97, 123), *range(128, 256)]], KIND[48:58] = SPACE, LETTER, DIGIT
SHORT_FORMS, LONG_FORMS = np.isin(np.arange(256), [*b"stmd"]), [b"re", b"ve", b"ll"]
KEEP_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

# Byte-level tokenizers write a byte as the character of that number where it prints, and the others as characters from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SIGN_OF = np.arange(256, dtype="<u4")
SIGN_OF[sorted(set(range(256)) - set(PRINTED))] = 256 + np.arange(256 - len(PRINTED))
SIGN_OF[10] = 10  # stands between pieces


def is_odd(text: str) -> bool:
    return PLAIN.fullmatch(text) is None or "<|" in text


def piece_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of lower-case bytes that end in white space."""
    kind = KIND[buf]
    new = kind == DIGIT
    new[0] = True
    new[1:] |= kind[1:] != kind[:-1]
    edges = np.flatnonzero(new)
    solid = kind[edges] != SPACE
    starts, ends = edges[solid], np.append(edges[1:], len(buf))[solid]
    lone = np.flatnonzero((buf[starts] == 39) & (ends - starts == 1) & (kind[ends % len(buf)] == LETTER))
    one, two = buf[ends[lone]], buf[ends[lone] + 1]
    form = np.where(SHORT_FORMS[one], 1, 0)
    for a, b in LONG_FORMS:
        form[(one == a) & (two == b)] = 2
    # The letters that a contraction takes are no longer the next piece's.
    ends[lone] += form
    starts[lone[form > 0] + 1] += form[form > 0]
    left = ends > starts
    return starts[left], ends[left]


class WordEncoder:
    """Ids of texts as little-endian u4 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """An empty cache of pieces: arrays of counts and ids, and where in them a piece is, the short ones in order."""
        self.short, self.short_at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.long: dict[bytes, int] = {}
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, short: np.ndarray, long: list[bytes]) -> None:
        """Put pieces into the cache, those of up to eight bytes given as little-endian numbers of them.

        A piece is lower-cased and apart already, so the tokenizer's model alone gives its ids, of its bytes as signs.
        """
        raw = b"\n".join(short.astype("<u8").view("S8").tolist() + long)
        tokenize = self.tokenizer.model.tokenize
        found = [[token.id for token in tokenize(signs)] for signs in SIGN_OF[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le").split("\n")]
        at, have = np.searchsorted(self.short, short), len(self.count)
        self.short, self.short_at = np.insert(self.short, at, short), np.insert(self.short_at, at, np.arange(have, have + len(short)))
        self.long.update(zip(long, range(have + len(short), have + len(found))))
        self.count = np.append(self.count, [len(f) for f in found])
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), "<u4"))
        self.first = np.cumsum(self.count) - self.count

    def _places(self, short: np.ndarray, long: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Where pieces are in the cache, which learns those that it lacks and begins anew when full; ``short`` in order and distinct."""
        for _ in range(2):
            at = np.searchsorted(self.short, short)
            there = at < len(self.short)
            there[there] = self.short[at[there]] == short[there]
            new, names = short[~there], list(dict.fromkeys(p for p in long if p not in self.long))
            if len(self.count) + len(new) + len(names) <= CACHE_PIECES:
                break
            self._forget()
        if len(new) or names:
            self._learn(new, names)
        return self.short_at[np.searchsorted(self.short, short)], list(map(self.long.__getitem__, long))

    def _of_plain(self, texts: list[str]) -> list[bytes]:
        """Texts of known characters, all pieces at once: each is looked up once and its ids are put where it stands."""
        raws = [t.lower().encode() for t in texts]
        raw = b"\n".join(raws) + b"\n" * 8
        first = np.cumsum([0] + [len(r) + 1 for r in raws])
        starts, ends = piece_spans(np.frombuffer(raw, np.uint8))
        size = ends - starts
        short = size <= 8
        eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        keys, at = np.unique(eights[starts[short]] & KEEP_BYTES[size[short]], return_inverse=True)
        short_at, long_at = self._places(keys, [raw[a:b] for a, b in zip(starts[~short].tolist(), ends[~short].tolist())])
        entry = np.empty(len(starts), np.int64)
        entry[short], entry[~short] = short_at[at], long_at
        n = self.count[entry]
        upto = np.concatenate([[0], np.cumsum(n)])
        data = self.ids[np.repeat(self.first[entry] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        cut = (4 * upto[np.searchsorted(starts, first)]).tolist()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _of_words(self, text: str) -> bytes:
        """A text with characters that ``KIND`` does not know: its words are looked up whole."""
        words = WORD.findall(text)
        new = [w for w in set(words) if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = list(set(words))
        odd = [w for w in new if is_odd(w)]
        plain = [w for w in new if not is_odd(w)]
        self.words.update(zip(odd, self._encode(odd)))
        self.words.update(zip(plain, self._of_plain(plain)))
        return b"".join(map(self.words.__getitem__, words))

    def _run(self, texts: list[str]) -> list[bytes]:
        odd = [is_odd(t) for t in texts]
        plain = iter(self._of_plain([t for t, o in zip(texts, odd) if not o]))
        return [self._of_words(t) if o else next(plain) for t, o in zip(texts, odd)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Runs of texts of about ``RUN_CHARS`` characters at a time; a longer text is cut at white space."""
        out, run, size = [], [], 0
        for text in texts:
            if len(text) > RUN_CHARS:
                out += self._run(run)
                run, size = [], 0
                out.append(b"".join(d for part in cut_at_white(text) for d in self._run([part])))
                continue
            run.append(text)
            size += len(text)
            if size >= RUN_CHARS:
                out += self._run(run)
                run, size = [], 0
        return out + self._run(run)


def cut_at_white(text: str):
    """Parts of a text of at least ``RUN_CHARS`` characters that end before white space."""
    at = 0
    while at < len(text):
        white = WHITE.search(text, at + RUN_CHARS)
        end = white.start() if white else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def compress(ids: np.ndarray, vocabulary: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Rules per round, left and right symbols of all rules, and the remaining symbols.

    The first round counts all pairs. A round only takes places from pairs of older symbols, so after it no pair can be
    frequent but those that hold one of its new symbols and those that were frequent before: only they are counted again.
    """
    seq, rounds, lefts, rights, size = ids.astype(np.uint32), [], [], [], vocabulary
    none = np.iinfo(np.int32).max
    there = np.arange(max(0, len(seq) - 1))  # places of pairs that may be frequent
    while len(seq) >= 2 * LEAST:
        same = seq[there] == seq[there + 1]
        if same.any():
            # Of a run of one symbol only every second pair counts: the others overlap it.
            run = there[same]
            first = np.concatenate([[True], np.diff(run) > 1])
            count_it = np.ones(len(there), bool)
            count_it[same] = (run - run[first][np.cumsum(first) - 1]) % 2 == 0
            there = there[count_it]
        pairs = seq[there].astype(np.uint64) << np.uint64(32) | seq[there + 1]
        # A cell counts all pairs of one hash, so a pair in a cell below LEAST is rare; only the others are sorted.
        bits = min(18, len(pairs).bit_length() + 2)  # counts that fit a cache
        cell = (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
        common = np.bincount(cell, minlength=1 << bits)[cell] >= LEAST
        there, pairs = there[common], pairs[common]
        order = np.argsort(pairs)
        ordered = pairs[order]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else there
        count = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(count >= LEAST)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")]
        rule, place = ordered[edge[often]], np.full(len(edge), none, np.int32)
        place[often] = np.arange(len(often), dtype=np.int32)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.repeat(place, count)
        there, rank = there[rank < none], rank[rank < none]
        apart = np.diff(there) > 1
        best = np.ones(len(there), bool)
        best[1:] &= apart | (rank[1:] < rank[:-1])
        best[:-1] &= apart | (rank[:-1] <= rank[1:])
        # The most frequent pair is replaced wherever it stands, so each round shortens the row.
        used = np.bincount(rank[best], minlength=len(rule))
        number = np.cumsum(used > 1) - 1
        best &= used[rank] > 1
        at = there[best]
        seq[at] = (size + number[rank[best]]).astype(np.uint32)
        stay, again = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        stay[at + 1] = False
        again[there] = True
        seq, again = seq[stay], again[stay]
        fresh = seq >= size
        again |= fresh
        again[:-1] |= fresh[1:] | (seq[1:] == seq[:-1])
        there = np.flatnonzero(again[:-1])
        kept = rule[used > 1]
        rounds.append(len(kept))
        lefts.append((kept >> np.uint64(32)).astype(np.uint32))
        rights.append(kept.astype(np.uint32))
        size += len(kept)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return rounds, join(lefts), join(rights), seq


def pack(doc_ids: list, sizes: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    rounds, left, right, seq = compress(ids, vocabulary)
    lengths = np.ones(vocabulary + len(left), np.int64)
    at = 0
    for n in rounds:
        lengths[vocabulary + at:vocabulary + at + n] = lengths[left[at:at + n]] + lengths[right[at:at + n]]
        at += n
    width = 2 if vocabulary + len(left) <= 1 << 16 else 4
    head = MAGIC + struct.pack("<6I", vocabulary, len(doc_ids), len(rounds), len(left), len(seq), width)
    return b"".join([
        head, np.array(rounds, "<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], "u1").tobytes(),
        np.array(sizes, "<u4").tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), lengths[vocabulary:].astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """A payload with its parts unpacked; ids are expanded on demand."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        self.vocabulary, docs, n_rounds, rules, symbols, width = struct.unpack("<6I", payload[4:28])
        at = 28

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rounds = take(n_rounds, "<u4").tolist()
        self.doc_ids, self.known = take(docs, "<i8"), take(docs, "u1").astype(bool)
        self.sizes = take(docs, "<u4").astype(np.int64)
        self.left, self.right, self.lengths = take(rules, "<u4"), take(rules, "<u4"), take(rules, "<u4")
        self.seq = take(symbols, f"<u{width}")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def _expanded(self, seq: np.ndarray) -> np.ndarray:
        seq, base = seq.astype(np.uint32), self.vocabulary + sum(self.rounds)
        for n in reversed(self.rounds):
            base -= n
            at = np.flatnonzero(seq >= base)
            of = seq[at] - self.vocabulary
            seq[at] = self.left[of]
            seq = np.insert(seq, at + 1, self.right[of])
        return seq

    def ids(self) -> np.ndarray:
        return self._expanded(self.seq)

    def between(self, start: int, end: int) -> np.ndarray:
        """ids[start:end] without expanding what lies outside."""
        length = np.ones(len(self.seq), np.int64)
        rule = self.seq >= self.vocabulary
        length[rule] = self.lengths[self.seq[rule] - self.vocabulary]
        ends = np.cumsum(length)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expanded(self.seq[a:b])[start - before:end - before]

    def document(self, i: int) -> np.ndarray:
        return self.between(int(self.starts[i]), int(self.starts[i + 1]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text and write the shards to ``path``."""

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        vocabulary, state = max(enc.vocabulary(), end_id + 1), {"seq": 0, "before": 0}
        end = np.array([end_id], "<u4").tobytes()
        ids, sizes, parts, total = [], [], [], 0

        def shard():
            whole = np.frombuffer(b"".join(parts), "<u4")
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "seq": state["seq"], "before": state["before"], "n_ids": len(whole), "payload": pack(ids, sizes, whole, vocabulary)}], SCHEMA)
            state["seq"] += 1
            state["before"] += len(whole)
            give_back()
            return row

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                texts = some.column(1).cast(pa.large_string()).fill_null("").to_pylist()
                for doc, data in zip(some.column(0).to_pylist(), enc.encode(texts)):
                    ids.append(doc)
                    sizes.append(len(data) // 4 + 1)
                    parts += [data, end]
                    total += sizes[-1]
                    if total >= SHARD_IDS:
                        yield shard()
                        ids, sizes, parts, total = [], [], [], 0
        if ids:
            yield shard()
        del ids, sizes, parts
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(run, "part int, seq int, before long, n_ids long, payload binary").write.parquet(path)


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``."""

    def run(batches):
        for batch in batches:
            for part, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                shard = Shard(payload)
                data = memoryview(np.ascontiguousarray(shard.ids(), "<u4")).cast("B")
                starts = shard.starts.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(shard.sizes), pa.int32()), pa.array(shard.doc_ids, mask=~shard.known), pa.array(shard.starts[:-1] + before), pa.array(shard.sizes),
                    pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts[:-1], starts[1:])], pa.int64()),
                ], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])
        give_back()

    shards = spark.read.schema("part int, seq int, before long, n_ids long, payload binary").parquet(path)
    # One row per written partition, never more.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = shards.select("part", "before", "payload").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(base, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the token files (into the shared folder if no path is given) and describe them as read back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
