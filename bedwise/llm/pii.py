"""Personal data: fixed patterns, and what a linear-chain conditional random field finds besides.

The patterns (email, ip, card, phone) give the base spans. The field reads words, numbers and signs by their shapes,
is trained on a small labelled table and decoded by Viterbi in numpy batches. It finds other spellings: phone numbers
without a country code, card numbers and addresses with other separators, "name at host dot com". A span of the field
counts if it passes the kind's own check (digits, Luhn, parts) and touches no base span; base spans always stay.

The labelled table is made by a rule: lines of words from a bounded sample of the documents with personal data and
look-alikes (versions, dates, keys, prices) put in at seeded places.

A whole line is a chain, however long. Lines in which no span could pass a check are not decoded, whatever the field says:
those without nine digits or four numbers that no letter parts, and without "@" or "at" before a word and "." or "dot".

Defined results. Null or empty text: no spans. Repeated rows give equal rows; doc_id may be null. An empty table gives
an empty result, and a model trained without words of documents works too. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]")

LINES, SAMPLE_DOCS, SEED = 800, 200, 7
STEPS, RATE, PENALTY = 80, 0.15, 1e-3
LABELS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and without overlap in a kind, ordered by kind and start."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        m = EMAIL_DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                spans.append(("email", start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGITS.search(text):
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return spans


# --- tokens and shapes --------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
WORDS = {w: i for i, w in enumerate("at dot com org net example mail tel phone call fax mobile ip host server card visa version v license".split())}
PLAIN_MARKS = ".,;:!?'\"|"  # the marks from the third on are one shape

N_WORD, N_NUMBER = 6, 20
N_SHAPES = 2 * (N_WORD + N_NUMBER + 128 + 1 + len(WORDS)) + 1
PAD = N_SHAPES - 1
OFFSETS = (-2, -1, 0, 1, 2)


def shape(token: str, spaced: bool) -> int:
    """Class of a token: letters by case, numbers by length, signs by themselves; and whether space stands before it."""
    low = token.lower()
    if low in WORDS:
        s = N_WORD + N_NUMBER + 129 + WORDS[low]
    elif token[0].isalpha():
        case = 0 if token == low else 1 if token[0] != low[0] and token[1:] == low[1:] else 2
        s = 2 * case + (len(token) > 1)
    elif token[0] in "0123456789":
        s = N_WORD + min(len(token), N_NUMBER - 1)
    else:
        s = N_WORD + N_NUMBER + (ord(";") if token in PLAIN_MARKS[2:] else ord(token) if ord(token) < 128 else 128)
    return 2 * s + spaced


_shapes: dict[tuple[str, bool], int] = {}


def known_shape(token: str, spaced: bool) -> int:
    """``shape``, remembered for short tokens; the memory is emptied when it is full."""
    found = _shapes.get((token, spaced))
    if found is None:
        found = shape(token, spaced)
        if len(token) <= 16:
            if len(_shapes) >= 50_000:
                _shapes.clear()
            _shapes[token, spaced] = found
    return found


def chain(line: str, at: int):
    """(token starts, token ends, shapes) of a line that begins at ``at``."""
    spans = [m.span() for m in TOKEN.finditer(line)]
    shapes = [known_shape(line[a:b], a != last) for (a, b), last in zip(spans, [-1] + [b for _, b in spans])]
    return [at + a for a, _ in spans], [at + b for _, b in spans], shapes


def chains(text: str, everything: bool = True):
    """(token starts, token ends, shapes) for each line, or for those that may hold a credible span."""
    if everything:
        bounds, at = [], 0
        for line in text.split("\n"):
            bounds.append((at, at + len(line)))
            at += len(line) + 1
    else:
        bounds = sorted(set(maybe_lines(text)))
    for a, b in bounds:
        found = chain(text[a:b], a)
        if found[0]:
            yield found


#: A character that is neither a letter nor one of 0-9, and space, both inside a line.
_OTHER, _GAP = r"(?:[^\w\n]|_|[^\D0-9])", r"[^\S\n]*"
#: What every span that ``credible`` accepts has: four numbers or nine digits without a letter between them, or the "at", word, and "dot" of an address.
NUMBERS = re.compile(rf"[0-9]+(?:{_OTHER}+[0-9]+){{3}}|[0-9](?:{_OTHER}*[0-9]){{8}}")
#: Space is never given back and stands on one side of a bracket in one way only, so that no text is tried in many ways.
ADDRESS = re.compile(rf"(?:@|[aA][tT]){_GAP}+(?:[\])]{_GAP}+)?[\w-]+{_GAP}+(?:[\[(]{_GAP}+)?(?:\.|[dD][oO][tT]){_GAP}+(?:[\])]{_GAP}+)?[\w-]")


def maybe_lines(text: str):
    """Bounds of the lines that hold such a piece."""
    for pattern in (NUMBERS, ADDRESS):
        at = 0
        while m := pattern.search(text, at):
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            at = end = len(text) if end < 0 else end
            yield start, end


# --- the field ----------------------------------------------------------------------------------------------------

ALLOWED = np.array([[not (b.startswith("I") and (a == "O" or a[2:] != b[2:])) for b in LABELS] for a in LABELS])
FORBIDDEN = np.where(ALLOWED, 0.0, -1e4)


def padded(sequences: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sequences])
    out = np.full((len(sequences), int(size.max()) + 4), PAD)
    for i, s in enumerate(sequences):
        out[i, 2:2 + len(s)] = s
    return out, size


class Field:
    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions  # [offset, shape, label], [label, label]

    def emissions(self, shapes: np.ndarray) -> np.ndarray:
        n = shapes.shape[1] - 4
        return sum(self.weights[k][shapes[:, 2 + o:2 + o + n]] for k, o in enumerate(OFFSETS))

    def decode(self, sequences: list[list[int]]) -> list[np.ndarray]:
        """Viterbi labels of chains, in batches of similar length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        step = self.transitions + FORBIDDEN
        into = np.ascontiguousarray(step.T)
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo) * len(sequences[order[hi]]) < 200_000:
                hi += 1
            some = order[lo:hi]
            lo = hi
            shapes, size = padded([sequences[i] for i in some])
            e = self.emissions(shapes)
            n = e.shape[1]
            back = np.zeros((n, len(some), len(LABELS)), np.int8)
            score = e[:, 0] + step[0]  # a chain begins and ends next to "outside"
            for t in range(1, n):
                way = score[:, None, :] + into  # [chain, label, label before]
                back[t] = best = way.argmax(axis=2)
                new = np.take_along_axis(way, best[:, :, None], 2)[:, :, 0] + e[:, t]
                score = np.where((t < size)[:, None], new, score)
            label = (score + step[:, 0]).argmax(axis=1)
            path = np.zeros((len(some), n), int)
            rows = np.arange(len(some))
            for t in range(n - 1, -1, -1):
                inside = t < size
                path[:, t] = np.where(inside, label, 0)
                if t:
                    label = np.where(inside, back[t, rows, label], label)
            for r, i in enumerate(some):
                out[i] = path[r, :size[r]]
        return out

    @staticmethod
    def fit(sequences: list[list[int]], labels: list[list[int]]) -> "Field":
        """Penalised maximum likelihood by Adam on all rows."""
        shapes, size = padded(sequences)
        n, k = shapes.shape[1] - 4, len(LABELS)
        gold = np.zeros((len(labels), n), int)
        for i, row in enumerate(labels):
            gold[i, :len(row)] = row
        there = np.arange(n) < size[:, None]
        eye = np.eye(k)
        weights, trans = np.zeros((len(OFFSETS), N_SHAPES, k)), np.zeros((k, k))
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, trans)]
        pairs = np.zeros((k, k))
        np.add.at(pairs, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
        rows, last = np.arange(len(size)), size - 1
        np.add.at(pairs[0], gold[:, 0], 1)
        np.add.at(pairs[:, 0], gold[rows, last], 1)

        def lse(x, axis):
            m = x.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        # Where each shape stands, seen from each offset: sums by shape are sums of runs of the sorted places.
        runs = []
        for at in OFFSETS:
            flat = shapes[:, 2 + at:2 + at + n].ravel()
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            runs.append((order, first, flat[order][first]))
        for step in range(1, STEPS + 1):
            e = Field(weights, trans).emissions(shapes)
            move = trans + FORBIDDEN
            alpha, beta = np.zeros(e.shape), np.zeros(e.shape)
            alpha[:, 0] = e[:, 0] + move[0]
            beta[:, -1] = move[:, 0]
            for t in range(1, n):
                alpha[:, t] = np.where(there[:, t, None], lse(alpha[:, t - 1, :, None] + move, 1) + e[:, t], alpha[:, t - 1])
            for t in range(n - 2, -1, -1):
                beta[:, t] = np.where(there[:, t + 1, None], lse(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), move[:, 0])
            z = lse(alpha[:, -1] + move[:, 0], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * there[:, :, None]
            grad_e = (p - eye[gold]) * there[:, :, None]
            grad_w, grad_t = PENALTY * weights, PENALTY * trans - pairs / len(sequences)
            for o, (order, first, shape_) in enumerate(runs):
                grad_w[o, shape_] += np.add.reduceat(grad_e.reshape(-1, k)[order], first, axis=0) / len(sequences)
            for t in range(1, n):
                both = np.exp(alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
                grad_t = grad_t + both[there[:, t]].sum(axis=0) / len(sequences)
            grad_t[0] += p[:, 0].sum(axis=0) / len(sequences)
            grad_t[:, 0] += p[rows, last].sum(axis=0) / len(sequences)
            for x, g, (m, v) in zip((weights, trans), (grad_w, grad_t), moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return Field(weights, trans)


# --- the labelled table -------------------------------------------------------------------------------------------

def _made(rng: np.random.Generator, word) -> tuple[str, str | None]:
    """A piece of text and its kind; None for look-alikes."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    host = f"{pick('mail', 'host', word())}{pick('', d(1))}.{pick('example', word())}.{pick('com', 'org', 'net')}"
    number = f"({d(3)}) {d(3)}-{d(4)}"
    part = lambda: str(rng.integers(0, 256))
    makers = [
        (lambda: f"{word()}{pick('.', '_', '')}{d(2)}@{host}", "email"), (lambda: f"{word()} at {word()} dot {pick('com', 'org', 'net')}", "email"),
        (lambda: f"{word()} at {word()}.{pick('com', 'org', 'net', 'co')}", "email"),
        (lambda: f"{word()} (at) {word()} (dot) {pick('com', 'org', 'net')}", "email"), (lambda: f"{word()}[at]{word()}[dot]{pick('com', 'org')}", "email"),
        (lambda: ".".join(part() for _ in range(4)), "ip"), (lambda: "[.]".join(part() for _ in range(4)), "ip"),
        (lambda: d(16), "card"), (lambda: "-".join(d(4) for _ in range(4)), "card"), (lambda: " ".join(d(4) for _ in range(4)), "card"), (lambda: ".".join(d(4) for _ in range(4)), "card"),
        (lambda: f"+{d(1)} {number}", "phone"), (lambda: f"+{d(2)} {d(3)} {d(7)}", "phone"), (lambda: number, "phone"), (lambda: f"{d(3)}-{d(3)}-{d(4)}", "phone"), (lambda: f"{d(3)}.{d(3)}.{d(4)}", "phone"),
        (lambda: f"{pick('version', 'v', 'CC BY-NC')} {d(1)}.{d(1)}{pick('', '.', '.' + d(1))}", None), (lambda: f"20{d(2)}-{d(2)}-{d(2)}", None), (lambda: f"{d(2)}/{d(2)}/20{d(2)}", None),
        (lambda: f"password={hashlib.md5(d(5).encode()).hexdigest()[:18]}", None), (lambda: f'token = "{hashlib.sha1(d(5).encode()).hexdigest()}"', None),
        (lambda: "AKIA" + hashlib.md5(d(5).encode()).hexdigest()[:16].upper(), None), (lambda: d(rng.integers(1, 8)), None), (lambda: f"${d(2)}.{d(2)}", None), (lambda: f"({d(2)})", None),
        (lambda: f"{word()}{pick('###', '%%%', '***', '&&&', '$$$')} {word()}", None), (lambda: f"{word()} | {word()}", None), (lambda: f"{word()} at {word()}", None), (lambda: f"{d(4)}-{d(4)}", None),
        (lambda: " ".join(pick(str.upper, str.title, str.lower)(word()) + pick("", "", ".", ",", "!!", "?", ":", ";", "'s") for _ in range(6)), None), (lambda: " ".join(pick(*WORDS, word()) for _ in range(5)).replace("dot", "at"), None),
    ]
    make, kind = makers[rng.integers(len(makers))]
    return make(), kind


def labelled_table(spark: SparkSession, docs: DataFrame, lines: int = LINES, seed: int = SEED) -> DataFrame:
    """(line, spans array of (kind, start, end)), made by a rule from the words of a bounded sample of documents."""
    # The hashes are ordered without the texts, so that no task sends texts to the driver.
    usable = docs.where("length(text) BETWEEN 1 AND 20000").select(F.xxhash64("doc_id", "text").alias("h"), "text")
    words = usable.join(F.broadcast(usable.select("h").orderBy("h").limit(SAMPLE_DOCS)), "h", "left_semi")  # SAMPLE_DOCS numbers
    words = words.select(F.explode(F.slice(F.split(F.substring("text", 1, 2000), r"[^\p{L}]+"), 1, 40)).alias("w")).where("length(w) > 1").distinct().orderBy("w")
    known = [r["w"] for r in words.collect()] or ["word", "text", "line"]
    rng, rows = np.random.default_rng(seed), []
    word = lambda: known[rng.integers(len(known))]
    for _ in range(lines):
        line, spans = "", []
        for part in range(rng.integers(1, 4)):
            line += " ".join(word() for _ in range(rng.integers(0, 8)))
            piece, kind = _made(rng, lambda: word().lower())
            line += ("" if not line or line.endswith(" ") else " ")
            if kind:
                spans.append((kind, len(line), len(line) + len(piece)))
            line += piece + ("." if rng.random() < 0.2 else ",") * int(rng.random() < 0.3) + " "
        rows.append((line.strip(), spans))
    return spark.createDataFrame(rows, "line string, spans array<struct<kind:string,start:int,end:int>>")


def quality(field: Field, table: DataFrame) -> dict[str, float]:
    """Precision and recall of whole spans on a labelled table of a bounded number of lines, after each kind's own check."""
    right = found = wanted = 0
    for row in table.collect():
        line, gold = row["line"], {(k, a, b) for k, a, b in row["spans"]}
        got = set(base_spans(line))
        got |= {(k, int(a), int(b)) for k, a, b in field_spans([line], field)[0] if credible(k, line[a:b]) and all(b <= s or a >= e for _, s, e in got)}
        gold = {(k, a, b) for k, a, b in gold if credible(k, line[a:b]) or (k, a, b) in got}
        right, found, wanted = right + len(got & gold), found + len(got), wanted + len(gold)
    return {"precision": right / max(1, found), "recall": right / max(1, wanted)}


def train(table: DataFrame) -> Field:
    sequences, labels = [], []
    for row in table.collect():  # LINES short rows
        for starts, ends, shapes in chains(row["line"]):
            tags = [0] * len(starts)
            for kind, a, b in row["spans"]:
                inside = [i for i, (s, e) in enumerate(zip(starts, ends)) if s >= a and e <= b]
                for i in inside:
                    tags[i] = LABELS.index(("B-" if i == inside[0] else "I-") + kind)
            sequences.append(shapes)
            labels.append(tags)
    return Field.fit(sequences, labels)


# --- spans --------------------------------------------------------------------------------------------------------

LOCAL_PART, HOST_PART, AT, DOT = re.compile(r"[\w.%+-]+"), re.compile(r"[\w-]+"), re.compile("at", re.I), re.compile("dot", re.I)
#: "at" and "dot" with the space and brackets around them, before a word.
AT_SIGN = re.compile(r"\s*+(?:[\[(]\s*+)?(?:@|at)\s*+(?:[\])]\s*+)?(?=[\w-])", re.I)
DOT_SIGN = re.compile(r"\s*+(?:[\[(]\s*+)?(?:\.|dot)\s*+(?:[\])]\s*+)?(?=[\w-])", re.I)


def spelled_address(piece: str) -> bool:
    """Whether all of ``piece`` is a local part, an "at", and words with a "dot" between any two.

    "at" and "dot" may be letters of a word. Places where a word can begin are followed from left to right, so the work
    grows with the length, where a pattern with repeats would try all ways to cut the words.
    """
    local = LOCAL_PART.match(piece)
    if not local:
        return False
    runs = [m.end() for m in HOST_PART.finditer(piece)]
    run = lambda at: runs[bisect_right(runs, at)]  # the end of the word characters that begin at or before ``at``
    first: dict[int, int] = {}  # end of a run of word characters: the first place in it where a word can begin
    for at in [m.start() for m in AT.finditer(piece, 1, local.end())] + [local.end()]:
        if m := AT_SIGN.match(piece, at):
            first.setdefault(run(m.end()), m.end())
    for at, end in sorted([(m.start(), run(m.start())) for m in DOT.finditer(piece)] + [(r, r) for r in runs]):
        if first.get(end, at) < at and (m := DOT_SIGN.match(piece, at)):
            if run(m.end()) == len(piece):
                return True
            first[run(m.end())] = min(m.end(), first.get(run(m.end()), m.end()))
    return False


def credible(kind: str, piece: str) -> bool:
    numbers = re.findall(r"[0-9]+", piece)
    digits = "".join(numbers)
    if kind == "email":
        return spelled_address(piece)
    if re.search(r"[^\W\d_]", piece):
        return False
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and 2 < len(numbers) and max(map(len, numbers)) <= 8


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    owners, parts = [], []
    for i, text in enumerate(texts):
        for chain in chains(text, everything=False):
            owners.append(i)
            parts.append(chain)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, (starts, ends, _), path in zip(owners, parts, field.decode([p[2] for p in parts])):
        inside = np.flatnonzero(path)
        at = 0
        while at < len(inside):
            first = last = inside[at]
            kind = LABELS[path[first]][2:]
            at += 1
            while at < len(inside) and inside[at] == last + 1 and LABELS[path[inside[at]]] == f"I-{kind}":
                last = inside[at]
                at += 1
            out[i].append((kind, starts[first], ends[last]))
    return out


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, added) for every row: spans as arrays of (kind, start, end) in code points, end exclusive."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                texts = [t or "" for t in some.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                added = []
                for text, known, found in zip(texts, base, field_spans(texts, shared.value)):
                    new = [(k, int(a), int(b)) for k, a, b in found if credible(k, text[a:b]) and all(b <= s or a >= e for _, s, e in known)]
                    added.append(new)
                cast = lambda rows: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], pa.list_(span))
                yield pa.RecordBatch.from_arrays([some.column(0), cast(base), cast(added)], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def span_digest(spans):
    """kind:start:end by kind as listed, then start, joined by commas."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_report(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; the counts are those of the base spans."""
    found = find_personal_data(docs, field)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"), span_digest(F.concat("base", "added")).alias("spans"))
