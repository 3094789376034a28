"""Importance resampling, the permutation index and fill-in-the-middle against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedwise.llm import fill_middle, importance, permutation_index
from bedwise.llm.common import cut, ship

DOCS = "doc_id long, text string, rank string, weight int, place string, h1 int, n string"


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship(spark)


def docs_of(spark, rows):
    """Documents with further columns whose names operators use inside, read from files."""
    return cut(spark.createDataFrame([(i, t, "r", 1, "p", 2, "n") for i, t in rows], DOCS), "documents")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "  \n\n"), (4, "One, two"), (5, "x" * 500 + " Y " + "z" * 70), (6, words(rng, 40)), (6, words(rng, 41)), (None, words(rng, 30)), (None, words(rng, 30))]
    rows += [(10 + k, words(rng, rng.randint(1, 60)) + "\n" * (k % 3) + words(rng, 5)) for k in range(120)]
    rows += [(200, words(rng, 30))] * 3 + [(300, words(rng, 30_000))]
    rows += [(400 + k, "\n".join(words(rng, 4) for _ in range(k))) for k in range(20)] + [(450, "a<P>b\nc"), (451, "a<S\n>b<M"), (452, "\n" * 3000), (453, "é\n" * 9000 + "end")]
    return rows


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def drawn(rows, target, percent=5):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for into, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            np.add.at(into, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        n, f = features(text)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(fit[:len(fit) * percent // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_importance_sample_equals_a_plain_sort(spark, corpus, percent):
    target = [words(random.Random(9), 80), None, "one two three"]
    found = importance.resample(docs_of(spark, corpus), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), percent)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == drawn(corpus, target, percent)


def test_importance_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).count() == 0
    one = importance.resample(docs_of(spark, [(1, "a b " * 20)]), empty).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in one] == [(1, 117, None)]


def test_radix_rank_of_extreme_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_BITS", 4)
    monkeypatch.setattr(importance, "DIGIT", 3)
    rng = random.Random(1)
    rows = [(rng.choice([None, 5, 5, 5, -(1 << 63), (1 << 63) - 1, 0, rng.randint(-99, 99)]), rng.choice([None, rng.randint(0, 1000)]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(3)
    for a_down in (True, False):
        found = importance.radix_rank(df.where("a IS NULL OR abs(b) < 10000"), [("a", a_down), ("b", False), ("c", True)], "place").collect()
        rows_ = [tuple(r)[:3] for r in sorted(found, key=lambda r: r["place"])]
        wanted = sorted((r for r in rows if r[0] is None or r[1] is not None), key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0] if a_down else r[0], r[1] is None, r[1] or 0, -r[2]))
        assert rows_ == wanted and sorted(r["place"] for r in found) == list(range(1, len(wanted) + 1))


def test_radix_rank_of_one_value(spark):
    same = spark.createDataFrame([(7, 7)] * 10, "a long, b long")
    assert sorted(r["rank"] for r in importance.radix_rank(same, [("a", True), ("b", False)]).collect()) == list(range(1, 11))


def vectors(spark, rows, type_="double"):
    return spark.createDataFrame([(i, e, "l", 1, 2) for i, e in rows], f"vec_id long, embedding array<{type_}>, label string, block int, h1 int")


def brute(rows, top):
    fine = {}
    for i, e in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            fine[i] = e
    out = {}
    for q, x in fine.items():
        if q % 20 == 0:
            scores = []
            for i, e in fine.items():
                if i != q and len(e) == len(x):
                    s = 0.0
                    for a, b in zip(e, x):
                        s += a * b
                    scores.append((-s, i))
            out[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return out


def as_lists(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_permutation_index_on_copies_ties_and_broken_vectors(spark, monkeypatch):
    """Fewer rows than are reranked: the answer is exact, in blocks of any size."""
    monkeypatch.setattr(permutation_index, "LEAST", 10_000)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6))
    rows = [(k, list(map(float, base[k % 40] * (1 + k % 3)))) for k in range(260)] + [(1000 + k, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for k in range(200)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 6), (2060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2080, [float("nan")] * 6), (2100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2120, [1.0, 2.0]), (2121, [3.0, 1.0])]
    rows += [rows[40], rows[40]]
    wanted = {q: f for q, f in brute(rows, 20).items() if f}
    for block in (1 << 14, 64):
        monkeypatch.setattr(permutation_index.build_index, "__defaults__", (block,))
        monkeypatch.setattr(permutation_index.search, "__defaults__", (20, 64, block))
        assert as_lists(permutation_index.nearest(vectors(spark, rows))) == wanted


def test_permutation_index_of_nothing(spark):
    assert permutation_index.nearest(vectors(spark, [])).count() == 0
    assert permutation_index.nearest(vectors(spark, [(20, None), (40, [0.0])])).count() == 0
    assert permutation_index.nearest(vectors(spark, [(20, [1.0])])).count() == 0


def test_permutation_index_recall(spark):
    """Vectors far above the number that is reranked, without any structure, and a dense group of near copies."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(9000, 32))
    v[:1500] = v[0] + 0.05 * v[:1500]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(8)
    found = permutation_index.nearest(rows).cache()
    assert found.count() == 450 * 20
    assert permutation_index.recall(found, rows) >= 0.9


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def fill(doc_id, text):
    text = text or ""
    u = lines(text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")):
        return len(u), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("piece", [8192, 7])
def test_fill_in_the_middle(spark, corpus, piece, monkeypatch):
    if piece == 7:
        corpus = [r for r in corpus if len(r[1] or "") < 2000]
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    docs = docs_of(spark, corpus)
    wanted = [(i, t or "", fill(i, t)) for i, t in corpus]
    found = fill_middle.digests(docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, *f[:4], sha(f[4]), sha(t)) for i, t, f in wanted), key=str)
    assert {"plain", "spm", "psm"} == {f[1] for *_, f in wanted}
    texts = cut(fill_middle.outputs(docs), "outputs")
    assert sorted(map(tuple, texts.collect()), key=str) == sorted(((i, f[1], f[4]) for i, _, f in wanted), key=str)
    assert sorted(map(tuple, fill_middle.restored(texts).collect()), key=str) == sorted(((i, t) for i, t, _ in wanted), key=str)


def test_fill_in_the_middle_rate_and_empty_table(spark, corpus):
    docs = docs_of(spark, corpus)
    assert fill_middle.digests(docs.limit(0)).count() == 0
    assert {r["form"] for r in fill_middle.digests(docs, rate=0).collect()} == {"plain"}
    assert fill_middle.digests(docs, spm=0).where(F.col("form") == "spm").count() == 0
